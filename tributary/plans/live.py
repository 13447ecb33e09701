"""Queries on streams that go on after a stop, try again later, and check by rules that are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import scratch, table
from tributary.streaming import events as ev
from tributary.streaming import refresh, state
from tributary.streaming.events import drain


def _slices(spark, rows, number, path):
    """(number of a slice, stream of all slices so far) for so many slices, written one after the other; slice is a column from 0. A query that goes on for each takes a slice a batch, in as many files as it has."""
    for i in range(number):
        rows.where(F.col("slice") == i).write.parquet(f"{path}/slice-{i}")
        yield i, ev.read_stream(spark, f"{path}/slice-*", rows.schema)


def _documents_changed(spark, d):
    """Events as changes of a document by user, dealt to slices that are not in order of time."""
    operation = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return table(spark, d, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("moved"), F.col("ts").cast("timestamp").alias("ts"), operation.alias("operation"), "value", F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int").alias("slice")
    )


def stream_merge_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The last change of each user's document, from a stream that breaks off in its third slice, starts again, and is summed up in between."""
    path = scratch(spark)
    for i, stream in _slices(spark, _documents_changed(spark, d), 4, f"{path}/in"):
        changes = state.last_changes(stream.drop("slice"), "user_id", ["moved", "event_id"], "ts", "60 days", 90 * 86_400)
        if i == 2:
            try:
                state.land(changes, f"{path}/out", f"{path}/state", lambda n: True).awaitTermination()
            except Exception as e:
                if "broke off" not in str(e):
                    raise
            state.compacted(spark, f"{path}/out", f"{path}/sums", "user_id", ["moved", "event_id"], 2)
        state.land(changes, f"{path}/out", f"{path}/state").awaitTermination()
    return state.table_of(state.landed(spark, f"{path}/out", f"{path}/sums"), "user_id", ["moved", "event_id"]).drop("ts", "moved")


DELAYS = state.waits(3, 60.0, 3_600.0)


def _attempt(event: dict, attempt: int) -> str | None:
    """A service that fails as often as the event's number says, and a little better for events that are sent again."""
    fails = event["event_id"] % 6 - 2 * event["replays"]
    return f"try {attempt} failed" if attempt <= fails else None


def _offered(spark, d, path):
    """Events in two slices by time, and a heartbeat after them all, which lets the last ones' timers run."""
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("replays"), (F.dayofmonth("ts") > 15).cast("int").alias("slice"))
    late = spark.createDataFrame([(-6, 0, 2)], "event_id long, replays int, slice int").select("event_id", F.lit("2030-01-01").cast("timestamp").alias("ts"), "replays", "slice")
    return _slices(spark, rows.unionByName(late), 3, path)


def _attempts(spark, slices, path):
    with state.settings(spark, state.STORE):
        for _, stream in slices:
            made = drain(state.retried(stream.drop("slice"), _attempt, "event_id", "ts", DELAYS, "40 days").drop("ts"), path)
    return made


def stream_retries(spark: SparkSession, d: str) -> DataFrame:
    """All attempts at all events, tried again after one, two and four minutes."""
    path = scratch(spark)
    made = _attempts(spark, _offered(spark, d, f"{path}/in"), path)
    return made.where("event_id >= 0").select("event_id", "attempt", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "outcome", "error")


def stream_replays(spark: SparkSession, d: str) -> DataFrame:
    """Dead letters of a stream sent again twice (the second time finds them sent), and what became of them."""
    path = scratch(spark)
    made = _attempts(spark, _offered(spark, d, f"{path}/in"), f"{path}/first").withColumn("ts", F.col("at"))
    sent = [state.replay(made, f"{path}/again", "event_id", "ts", "2024-06-01 00:00:00") for _ in range(2)]
    rows = spark.read.parquet(f"{path}/again")
    late = spark.createDataFrame([(-6, 1)], "event_id long, replays int").withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    slices = rows.withColumn("slice", F.lit(0)).unionByName(late.withColumn("slice", F.lit(1)))
    second = _attempts(spark, _slices(spark, slices, 2, f"{path}/next"), f"{path}/second")
    return second.where("event_id >= 0 and outcome <> 'retry'").groupBy("replays", "attempt", "outcome").agg(F.count("*").alias("n"), F.lit(sent[0]).cast("long").alias("sent"), F.lit(sent[1]).cast("long").alias("sent_again"))


_DAYS = 12  # a lifetime of the rules, in days


def _rules(spark, d, now: float):
    """Every user's rule for values and one for kinds of events, as they are at a time: the bound rises by one a day."""
    users = table(spark, d, "events").select("user_id").distinct()
    day = F.floor((F.lit(now) - 1_704_067_200) / 86_400)
    value = users.select("user_id", F.lit("value").alias("rule_id"), F.lit("value").alias("field"), F.lit("range").alias("kind"), F.lit(5.0).alias("low"), (30 + F.col("user_id") % 9 + day).cast("double").alias("high"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("array<string>").alias("allowed"), F.lit("error").alias("severity"))
    kinds = users.where("user_id % 3 = 0").select("user_id", F.lit("kind").alias("rule_id"), F.lit("event_type").alias("field"), F.lit("pattern").alias("kind"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit("^[a-r]").alias("pattern"), F.lit(None).cast("array<string>").alias("allowed"), F.lit("warning").alias("severity"))
    return value.unionByName(kinds)


def stream_rules_reread(spark: SparkSession, d: str) -> DataFrame:
    """Events of five days a batch, checked by rules that are read again when they are older than twelve days of event time."""
    path = scratch(spark)
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.least(F.floor((F.dayofmonth("ts") - 1) / 5), F.lit(5)).cast("int").alias("slice"))
    clock = lambda batch: batch.agg(F.max(F.unix_micros("ts"))).first()[0] / 1e6
    for _, stream in _slices(spark, rows, 6, f"{path}/in"):
        refresh.validate(stream, lambda now: _rules(spark, d, now), "user_id", f"{path}/out", f"{path}/state", _DAYS * 86_400.0, clock).awaitTermination()
    done = spark.read.parquet(f"{path}/out/data")
    return done.select("event_id", "slice", "score", "valid", F.array_join(F.transform("issues", lambda x: x.rule_id), ",").alias("rules"))


QUERIES = {f.__name__: f for f in (stream_merge_resumed, stream_retries, stream_replays, stream_rules_reread)}
_TRIES = """f AS (SELECT event_id, ts, event_id % 6 AS fails FROM events), t AS (SELECT event_id, ts, fails, unnest(range(1, least(fails, 3) + 2)) AS attempt FROM f)"""
ORACLE = {
    "stream_merge_resumed": """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'""",
    "stream_retries": f"""WITH {_TRIES} SELECT event_id, attempt::INTEGER AS attempt, strftime(ts + to_seconds(60 * ((1 << (attempt - 1)) - 1)), '%Y-%m-%d %H:%M:%S') AS at,
        CASE WHEN attempt > fails THEN 'done' WHEN attempt = 4 THEN 'dead' ELSE 'retry' END AS outcome, CASE WHEN attempt <= fails THEN 'try ' || attempt || ' failed' END AS error FROM t""",
    "stream_replays": """WITH dead AS (SELECT event_id, event_id % 6 - 2 AS fails FROM events WHERE event_id % 6 > 3)
        SELECT 1 AS replays, (fails + 1)::INTEGER AS attempt, 'done' AS outcome, count(*) AS n, (SELECT count(*) FROM dead) AS sent, 0::BIGINT AS sent_again FROM dead GROUP BY fails""",
    "stream_rules_reread": f"""WITH RECURSIVE e AS (SELECT *, least((day(ts) - 1) // 5, 5) AS slice FROM events), c AS (SELECT slice, max(ts) AS now, row_number() OVER (ORDER BY slice) AS i FROM e GROUP BY slice),
        r(i, read_at) AS (SELECT i, now FROM c WHERE i = 1 UNION ALL SELECT c.i, CASE WHEN epoch(c.now) - epoch(r.read_at) < {_DAYS} * 86400 THEN r.read_at ELSE c.now END FROM r JOIN c ON c.i = r.i + 1),
        x AS (SELECT e.*, value < 5 OR value > 30 + user_id % 9 + floor((epoch(read_at) - 1704067200) / 86400) AS a, user_id % 3 = 0 AND NOT regexp_matches(event_type, '^[a-r]') AS b FROM e JOIN c USING (slice) JOIN r USING (i))
        SELECT event_id, slice::INTEGER AS slice, (CASE WHEN a THEN 90 ELSE 100 END - CASE WHEN b THEN 2 ELSE 0 END)::DOUBLE AS score, NOT a AS valid, concat_ws(',', CASE WHEN b THEN 'kind' END, CASE WHEN a THEN 'value' END) AS rules FROM x""",
}
