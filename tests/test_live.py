"""Streams with state against plain versions of them: order, stops, lifetimes, retries."""

import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tributary.session import scratch
from tributary.streaming import refresh, state
from tributary.streaming.events import drain, read_stream


def _stream(spark, batches, schema):
    path = scratch(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b-{i}")
        time.sleep(0.02)
    return read_stream(spark, f"{path}/b-*", spark.createDataFrame([], schema).schema, 1)


CHANGES = "id int, v long, operation string, ts timestamp, value string"


def _changes(rng, n, batches):
    rows = [(rng.randrange(6), i, rng.choice(("insert", "update", "update", "delete")), i * 60, f"x{i}") for i in range(n)]
    rng.shuffle(rows)
    rows += rows[:5]  # some arrive twice
    size = -(-len(rows) // batches)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("broken", [(), (0,), (2,), (1, 3)])
def test_a_stopped_stream_ends_in_the_same_table(spark, broken):
    rng = random.Random(3)
    batches = _changes(rng, 60, 4)
    stamped = [[(i, v, o, datetime.fromtimestamp(t), x) for i, v, o, t, x in b] for b in batches]
    last = {}
    for i, v, o, _, x in sorted((r for b in batches for r in b), key=lambda r: r[1]):
        last[i] = (v, o, x)
    path = scratch(spark)
    changes = state.last_changes(_stream(spark, stamped, CHANGES), "id", ["v"], "ts", "30 days", 40 * 86_400)
    for n in broken:
        with pytest.raises(Exception, match="broke off"):
            state.land(changes, f"{path}/out", f"{path}/state", lambda m, n=n: m == n).awaitTermination()
    state.land(changes, f"{path}/out", f"{path}/state").awaitTermination()
    want = {i: (v, x) for i, (v, o, x) in last.items() if o != "delete"}
    read = lambda rows: {r["id"]: (r["v"], r["value"]) for r in state.table_of(rows, "id", ["v"]).collect()}
    assert read(state.landed(spark, f"{path}/out")) == want
    state.compacted(spark, f"{path}/out", f"{path}/sums", "id", ["v"], 2)
    assert read(state.landed(spark, f"{path}/out", f"{path}/sums")) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_tombstones_are_forgotten_in_time(spark):
    day = 86_400
    at = lambda seconds: datetime.fromtimestamp(1_000 * day + seconds)
    batches = [
        [(1, 5, "delete", at(0), "gone"), (2, 5, "delete", at(0), "gone")],
        [(1, 4, "update", at(3 * day), "late")],  # the tombstone still stands
        [(3, 9, "insert", at(40 * day), "later")],
        [(4, 9, "insert", at(41 * day), "later")],
        [(2, 4, "update", at(41 * day), "late")],  # and is gone by now
    ]
    changes = state.last_changes(_stream(spark, batches, CHANGES), "id", ["v"], "ts", "1 day", 7 * day)
    path = scratch(spark)
    state.land(changes, f"{path}/out", f"{path}/state").awaitTermination()
    assert sorted((r["id"], r["v"]) for r in state.landed(spark, f"{path}/out").where("operation = 'update'").collect()) == [(2, 4)]


def test_events_are_tried_again_in_time(spark):
    at = datetime.fromtimestamp
    events = [[(i, at(1_000 + i), i, 0) for i in range(6)] + [(3, at(1_003), 3, 0)], [(100, at(1_000_000), 0, 0)]]

    def handler(event, attempt):
        if event["fails"] == 5 and attempt == 1:
            raise ValueError("five")
        return f"no {attempt}" if attempt <= event["fails"] else None

    stream = _stream(spark, events, "id int, ts timestamp, fails int, replays int")
    delays = state.waits(3, 10.0, 25.0, "exponential")
    assert delays == [10.0, 20.0, 25.0]
    with state.settings(spark, state.STORE):
        made = drain(state.retried(stream, handler, "id", "ts", delays, "1 minute"), scratch(spark)).where("id < 100")
    got = {(r["id"], r["attempt"]): (r["at"].timestamp(), r["outcome"], r["error"]) for r in made.collect()}
    want = {}
    for i in range(6):
        now = 1_000.0 + i
        for attempt in range(1, min(i, 3) + 2):
            outcome = "done" if attempt > i else "dead" if attempt == 4 else "retry"
            want[i, attempt] = (now, outcome, None if outcome == "done" else "five" if (i, attempt) == (5, 1) else f"no {attempt}")
            now += delays[attempt - 1] if attempt <= 3 else 0
    assert got == want
    assert made.count() == len(want)

    to = scratch(spark)
    assert state.replay(made, to, "id", "ts", "2024-01-01") == 2  # those that fail 4 and 5 times
    assert state.replay(made, to, "id", "ts", "2024-01-01") == 0
    assert sorted((r["id"], r["replays"]) for r in spark.read.parquet(to).collect()) == [(4, 1), (5, 1)]


def test_waits():
    assert state.waits(4, 1.0, 9.0, "fixed") == [1.0] * 4
    assert state.waits(4, 1.0, 3.0, "linear") == [1.0, 2.0, 3.0, 3.0]
    assert state.waits(5, 1.0, 9.0, "fibonacci") == [1.0, 1.0, 2.0, 3.0, 5.0]
    with pytest.raises(ValueError):
        state.waits(1, strategy="other")


def test_a_side_lives_for_its_lifetime(spark):
    path, loads = scratch(spark), []

    def load(now):
        loads.append(now)
        return spark.range(1).select(F.lit(now).alias("now"))

    see = lambda batch, now: refresh.side_of_batch(spark, load, path, batch, now, 300).first()["now"]
    assert [see(0, 1_000.0), see(1, 1_299.0), see(2, 1_300.0), see(3, 1_599.9)] == [1_000.0, 1_000.0, 1_300.0, 1_300.0]
    assert see(1, 9_000.0) == 1_000.0 and see(3, 9_000.0) == 1_300.0  # batches that run again
    assert see(4, 9_000.0) == 9_000.0 and loads == [1_000.0, 1_300.0, 9_000.0]
    refresh.forget(spark, path, 3)
    assert [b[:2] for b in refresh.bookings(spark, path)] == [(3, 2), (4, 3)]
    assert see(4, 9_100.0) == 9_000.0 and see(5, 9_299.0) == 9_000.0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{path}/copy-1").count()


def test_rules_of_a_table(spark):
    rules = spark.createDataFrame(
        [
            ("a", "r1", "x", "range", 1.0, 5.0, None, None, "error"), ("a", "r2", "y", "pattern", None, None, "^[a-c]+$", None, "warning"), ("a", "r3", "y", "required", None, None, None, None, "critical"),
            ("b", "r4", "y", "allowed", None, None, None, ["k"], "error"), ("b", "r5", "none", "required", None, None, None, None, "info"),
        ],
        "s string, rule_id string, field string, kind string, low double, high double, pattern string, allowed array<string>, severity string",
    )
    rows = spark.createDataFrame([(1, "a", "3", "abc"), (2, "a", "9", "xyz"), (3, "a", "n/a", " "), (4, "a", None, None), (5, "b", "0", "k"), (6, "b", "0", "q"), (7, "c", "0", "q"), (8, None, "0", "q")], "id int, s string, x string, y string")
    got = {r["id"]: ([i["rule_id"] for i in r["issues"]], r["valid"], r["score"]) for r in refresh.checked(rows, rules, "s").collect()}
    assert got == {1: ([], True, 100.0), 2: (["r1", "r2"], False, 88.0), 3: (["r1", "r2", "r3"], False, 78.0), 4: (["r3"], False, 90.0), 5: (["r5"], True, 100.0), 6: (["r4", "r5"], False, 90.0), 7: ([], True, 100.0), 8: ([], True, 100.0)}


@pytest.mark.parametrize("buckets", [1, 3])
def test_keys_of_a_bucket_share_calls_and_a_timer(spark, buckets):
    """Many keys meet in few calls of Python; a repeated key, an early timer after a late one, and a key that comes back."""
    at = lambda s: datetime.fromtimestamp(1_000_000 + s)
    events = [[(i, at(500 - i), i % 3, 0) for i in range(60)] + [(59, at(441), 2, 0)], [(60, at(90_000), 0, 0)], [(61, at(180_000), 0, 0)]]
    stream = _stream(spark, events, "id int, ts timestamp, fails int, replays int")
    seen = lambda event, attempt: "no" if attempt <= event["fails"] else None
    with state.settings(spark, state.STORE):
        made = drain(state.retried(stream, seen, "id", "ts", [60.0, 86_400.0], "1 minute", buckets), scratch(spark)).collect()
    want = sorted((i, a, 1_000_500.0 - i + (0, 60, 86_460)[a - 1], "done" if a > i % 3 else "retry") for i in range(60) for a in range(1, i % 3 + 2))
    assert sorted((r["id"], r["attempt"], r["at"].timestamp(), r["outcome"]) for r in made if r["id"] < 60) == want

    day = 86_400
    at = lambda s: datetime.fromtimestamp(1_000 * 86_400 + s)
    changes = [[(i, 5, "delete" if i % 2 else "insert", at(-i * day), "x") for i in range(20)], [(i, 4, "update", at(day), "late") for i in range(20)], [(50, 1, "insert", at(9 * day), "x")], [(51, 1, "insert", at(10 * day), "x")], [(i, 4, "update", at(10 * day), "late") for i in range(20)]]
    path = scratch(spark)
    state.land(state.last_changes(_stream(spark, changes, CHANGES), "id", ["v"], "ts", "30 days", 35 * day, buckets), f"{path}/out", f"{path}/state").awaitTermination()
    late = sorted(r["id"] for r in state.landed(spark, f"{path}/out").where("operation = 'update'").collect())
    assert late == []  # no tombstone has ended: the watermark is 20 days back


def test_a_call_reads_and_writes_its_bucket_once():
    import pandas as pd

    class Value:
        def __init__(self):
            self.held, self.calls = None, []

        exists = lambda self: self.held is not None
        get = lambda self: (self.calls.append("get"), self.held)[1]
        update = lambda self, new: (self.calls.append("update"), setattr(self, "held", new))
        clear = lambda self: (self.calls.append("clear"), setattr(self, "held", None))

    class Handle:
        def __init__(self):
            self.value, self.timers = Value(), []

        getValueState = lambda self, name, schema: self.value  # noqa: E731, N815
        registerTimer = lambda self, at: self.timers.append(at)  # noqa: E731, N815

    class Now:
        at = 0
        getCurrentWatermarkInMs = lambda self: self.at  # noqa: E731, N815

    writer, handle, now = state.LastWriter("id", ["id", "v", "operation", "ts"], ["v"], "ts", 10), Handle(), Now()
    writer.init(handle)
    rows = lambda v, operation, second, ids: pd.DataFrame({"id": ids, "v": v, "operation": operation, "ts": pd.Timestamp(second, unit="s")})
    take = lambda *batches: sorted(x for out in writer.handleInputRows((0,), iter(batches), now) for x in out["id"])
    assert take(rows(5, "insert", 1, range(500)), rows(6, "delete", 2, range(300, 600))) == list(range(600))
    assert take(rows(5, "update", 3, range(600)), rows(7, "insert", 3, [300])) == [300]
    assert handle.value.calls == ["update", "get", "update"] and handle.timers == [12_000]
    now.at = 12_000
    assert list(writer.handleExpiredTimer((0,), now, None)) == []
    assert take(rows(4, "update", 20, range(600))) == list(range(301, 600))  # tombstones have ended, what came back has not
    assert handle.timers == [12_000] and handle.value.calls.count("update") == 4
