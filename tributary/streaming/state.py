"""Streams with state by key: the last change of a document wins, and failed events are offered again later.

Both keep their state in the stream's own store (RocksDB, which spills to disk), by key, and end
it by timers of event time, so it holds the live keys of a window and not all that ever was. A
query that is stopped anywhere goes on from its checkpoint; sinks write a batch to a folder of its
own, so a batch that is run again replaces what it left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tributary.session import cut, file_system

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of a session for as long as it takes to start a query; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


BUCKETS = 1_024  # groups that a stream's keys are dealt to by a hash, so that one call of Python takes many keys


def dealt(rows: DataFrame, key: str, buckets: int):
    """rows grouped by the bucket of their key."""
    return rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("__bucket")


class LastWriter(StatefulProcessor):
    """By key of a bucket the version of the last change seen; only changes with a later one get through. A bucket is one value of the store, so a call reads and writes it once, and has one timer, for the next of its tombstones that ends."""

    def __init__(self, key: str, names: Sequence[str], version: Sequence[str], stamp: str, forget: int):
        self.key, self.names, self.version, self.stamp, self.forget = key, list(names), list(version), stamp, forget

    def init(self, handle):
        self.handle = handle
        self.kept = handle.getValueState("kept", "next long, rows binary")

    def _load(self):
        """When the bucket's timer is set for (0: not), and (version, end of the tombstone or 0) by key."""
        import pickle

        if not self.kept.exists():
            return 0, {}
        at, rows = self.kept.get()
        return at, pickle.loads(bytes(rows))

    def _save(self, seen: dict, at: int) -> None:
        import pickle

        self.kept.update((at, pickle.dumps(seen))) if seen else self.kept.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        last = lambda b: b.sort_values(self.version, kind="stable").drop_duplicates(self.key, keep="last")
        best = last(pd.concat([last(b[self.names]) for b in rows]))
        (at, seen), now, ends, through = self._load(), timerValues.getCurrentWatermarkInMs(), [], []
        keys = [None if pd.isna(k) else k for k in best[self.key].tolist()]
        for k, operation, stamp, *version in zip(keys, best["operation"], best[self.stamp], *[best[v].tolist() for v in self.version], strict=True):
            version, before = tuple(map(int, version)), seen.get(k)
            through.append(before is None or before[0] < version)
            if through[-1]:
                until = int(stamp.timestamp() * 1000) + self.forget * 1000 if operation == "delete" else 0
                seen[k] = (version, until)
                if until:
                    ends.append(max(until, now + 1))
        if ends and (not at or min(ends) < at):
            at = min(ends)
            self.handle.registerTimer(at)
        self._save(seen, at)
        yield best[through]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        (at, seen), now = self._load(), timerValues.getCurrentWatermarkInMs()
        if not at or at > now:
            return  # an earlier tombstone's timer was set since
        seen = {k: v for k, v in seen.items() if not 0 < v[1] <= now}
        at = min((until for _, until in seen.values() if until), default=0)
        if at:
            self.handle.registerTimer(at)
        self._save(seen, at)
        yield from ()

    def close(self):
        pass


def last_changes(changes: DataFrame, key: str, version: Sequence[str], stamp: str, delay: str = "1 day", forget: int = 7 * 86_400, buckets: int = BUCKETS) -> DataFrame:
    """The changes (key, operation, version columns of type long, stamp, ...) of a stream that are later than all before of their key.

    Of a batch a key's last change counts; what comes late and is older than what was seen is
    dropped. A deletion is a tombstone: it stays in state for `forget` seconds of event time, so
    an older change that arrives in that time does not bring the document back.
    Python holds one bucket's keys at a time; with many more than a million keys a bucket, ask for
    more buckets.
    """
    marked = changes.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay)
    schema = ", ".join(f"`{c}` {t}" for c, t in marked.dtypes)
    return dealt(marked, key, buckets).transformWithStateInPandas(LastWriter(key, marked.columns, version, stamp, forget), schema, "update", "eventtime")


def land(stream: DataFrame, path: str, checkpoint: str, broken: Callable[[int], bool] | None = None):
    """Start a query that writes each batch of changes to path/batch=<n>. broken(n) makes a batch fail when half of it is written, for tests."""

    def write(rows: DataFrame, number: int) -> None:
        if broken is not None and broken(number):
            rows.limit(max(rows.count() // 2, 1)).write.mode("overwrite").parquet(f"{path}/batch={number}")
            raise RuntimeError(f"batch {number} broke off")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with settings(stream.sparkSession, STORE):
        return stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, path: str, compact: str | None = None) -> DataFrame:
    """All changes that land() wrote; of the batches that compacted() summed up, only their sum."""
    rows = spark.read.option("basePath", path).parquet(path)
    if compact is None:
        return rows.drop("batch")
    sums = spark.read.option("basePath", compact).parquet(compact)
    upto = sums.agg(F.max("before")).first()[0]
    return rows.where(F.col("batch") >= upto).drop("batch").unionByName(sums.where(F.col("before") == upto).drop("before"))


def table_of(landed: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """The documents that a table of landed changes amounts to: each key's last change, if that is no deletion."""
    names = [c for c in landed.columns if c != key]
    last = landed.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*version)).alias("r"))
    return last.where("r.operation <> 'delete'").select(key, *[F.col(f"r.{c}").alias(c) for c in names if c != "operation"])


def compacted(spark: SparkSession, path: str, to: str, key: str, version: Sequence[str], before: int) -> None:
    """Write the last change of each key of the batches before a number to another folder, tombstones included; a reader unites it with later batches."""
    rows = spark.read.option("basePath", path).parquet(path).where(F.col("batch") < before).drop("batch")
    newest = Window.partitionBy(key).orderBy(*[F.desc(v) for v in version])
    rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n").write.mode("overwrite").parquet(f"{to}/before={before}")


def waits(retries: int, base: float = 1.0, most: float = 60.0, strategy: str = "exponential") -> list[float]:
    """Seconds to wait before each attempt after the first."""
    if strategy not in ("fixed", "linear", "exponential", "fibonacci"):
        raise ValueError(f"no such strategy: {strategy}")
    out, a, b = [], 1.0, 1.0
    for n in range(retries):
        out.append(min(base * {"fixed": 1.0, "linear": n + 1.0, "exponential": 2.0**n, "fibonacci": a}[strategy], most))
        a, b = b, a + b
    return out


OUTCOME = "attempt int, at timestamp, outcome string, error string"


class Retries(StatefulProcessor):
    """By key of a bucket the event that waits and the attempts made so far. A bucket has one timer, for the next event that is offered again, until it is handled or given up."""

    def __init__(self, key: str, stamp: str, names: Sequence[str], handler: Callable, delays: Sequence[float]):
        self.key, self.stamp, self.names, self.handler, self.delays = key, stamp, list(names), handler, list(delays)

    def init(self, handle):
        self.handle = handle
        self.pending = handle.getValueState("pending", "next long, rows binary")

    def _load(self):
        """When the bucket's timer is set for, and (due, attempts made, event) by key of what waits."""
        import pickle

        if not self.pending.exists():
            return None, {}
        at, rows = self.pending.get()
        return at, pickle.loads(bytes(rows))

    def _save(self, waiting: dict, at: int | None) -> None:
        import pickle

        if not waiting:
            self.pending.clear()
            return
        first = min(due for due, _, _ in waiting.values())
        if at is None or first < at:
            at = first
            self.handle.registerTimer(at)
        self.pending.update((at, pickle.dumps(waiting)))

    def _tries(self, row, attempt: int, at_ms: int, now_ms: int, waiting: dict, made: list) -> None:
        """This attempt, and those after it whose time the watermark has passed already."""
        import pandas as pd

        while True:
            try:
                error = self.handler(row, attempt)
            except Exception as e:  # a handler may fail in any way
                error = str(e)[:500] or type(e).__name__
            outcome = "done" if error is None else "dead" if attempt > len(self.delays) else "retry"
            made.append((*(row[n] for n in self.names), attempt, pd.Timestamp(at_ms, unit="ms"), outcome, error))
            if outcome != "retry":
                return
            at_ms += int(self.delays[attempt - 1] * 1000)
            if at_ms > now_ms:
                waiting[row[self.key]] = (at_ms, attempt, row)
                return
            attempt += 1

    def _table(self, made: list):
        import pandas as pd

        return pd.DataFrame(made, columns=[*self.names, "attempt", "at", "outcome", "error"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        (at, waiting), now = self._load(), timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            made = []
            for row in batch[self.names].to_dict("records"):
                if row[self.key] not in waiting:  # an event that waits already is not tried out of turn
                    self._tries(row, 1, int(row[self.stamp].timestamp() * 1000), now, waiting, made)
            yield self._table(made)
        self._save(waiting, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        (at, waiting), now, made = self._load(), timerValues.getCurrentWatermarkInMs(), []
        if at is None or at > now:
            return  # an earlier event's timer was set since
        for k in [k for k, (due, _, _) in waiting.items() if due <= now]:
            due, attempt, row = waiting.pop(k)
            self._tries(row, attempt + 1, due, now, waiting, made)
        self._save(waiting, None)
        yield self._table(made)

    def close(self):
        pass


def retried(events: DataFrame, handler: Callable[[dict, int], str | None], key: str, stamp: str, delays: Sequence[float], delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Every attempt at every event of a stream: the event with attempt (from 1), at, outcome (done, retry, dead) and error.

    handler(event as a dict, attempt) returns None, or says or raises what went wrong; it runs where
    the event's state is. An event that failed waits for delays[attempt - 1] seconds of event time,
    counted from the attempt before, and is given up after len(delays) more attempts. A repeated
    event is taken once while it waits. Nothing is tried again before the watermark has passed its
    time, so a stream's last failures wait for later events (or for a heartbeat). Python holds what
    waits of one bucket of keys at a time.
    """
    marked = events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay)
    schema = ", ".join(f"`{c}` {t}" for c, t in marked.dtypes)
    return dealt(marked, key, buckets).transformWithStateInPandas(Retries(key, stamp, marked.columns, handler, delays), f"{schema}, {OUTCOME}", "update", "eventtime")


def replay(dead: DataFrame, to: str, key: str, stamp: str, at: str) -> int:
    """Append dead letters (of retried, with a column `replays`) to a folder that the stream reads, `replays` one higher and their time set to `at`; returns how many.

    What the folder already holds is not sent twice, so a replay that broke off, or is asked for
    again, sends what is missing. Of an event that died several times the last death counts.
    """
    spark = dead.sparkSession
    names = [c for c in dead.columns if c not in ("attempt", "at", "outcome", "error", "batch")]
    last = dead.where("outcome = 'dead'").groupBy(key).agg(F.max_by(F.struct(*[c for c in names if c != key]), F.struct("replays", "at")).alias("r"))
    fresh = last.select(key, "r.*").select(names).withColumn("replays", F.col("replays") + 1).withColumn(stamp, F.lit(at).cast("timestamp"))
    place, fs = file_system(spark, to)
    if fs.exists(place):
        fresh = fresh.join(spark.read.schema(fresh.schema).parquet(to).select(key, "replays"), [key, "replays"], "left_anti")
    fresh = cut(fresh)
    fresh.write.mode("append").parquet(to)
    return fresh.count()
