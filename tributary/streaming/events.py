"""Streams of changes: mapped to events, routed, validated, deduplicated and throttled; failures to a dead-letter table.

Functions take and give streaming DataFrames, so the same code runs on batches in tests. Delivery is
exactly once for each event and handler: a batch that is run again overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.scores import realtime_score
from tributary.operators.quality import Rule, issues

# Events of operations, urgent collections and topics.
OPERATIONS = {"insert": "data.created", "update": "data.updated", "replace": "data.updated", "delete": "data.deleted"}
URGENT = ("data_reviews", "data_lineage", "error_logs")
TOPICS = {
    "data": ("data.created", "data.updated", "data.deleted"),
    "validation": ("data.validated", "data.validation_failed"),
    "review": ("review.requested", "review.started", "review.completed", "review.rejected", "review.correction_applied"),
    "promotion": ("promotion.requested", "promotion.completed", "promotion.failed", "promotion.rolled_back"),
    "crawl": ("crawl.started", "crawl.completed", "crawl.failed"),
    "system": ("system.health_check", "system.alert"),
    "batch": ("batch.started", "batch.completed", "batch.reprocessing"),
}
PRIORITY = {"high": 1, "normal": 2, "low": 3}


def read_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A stream of Parquet files under a path or pattern, so many files a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def to_events(changes: DataFrame) -> DataFrame:
    """changes (operation, collection, document_id, before, after as maps) with event_type, priority and change_fields."""
    kind = F.coalesce(*[F.when(F.col("operation") == o, F.lit(e)) for o, e in OPERATIONS.items()], F.lit("data.updated"))
    names = F.array_sort(F.array_union(F.coalesce(F.map_keys("before"), F.array().cast("array<string>")), F.coalesce(F.map_keys("after"), F.array().cast("array<string>"))))
    changed = F.filter(names, lambda k: ~F.try_element_at("before", k).eqNullSafe(F.try_element_at("after", k)))
    return changes.withColumn("event_type", kind).withColumn("priority", F.when(F.col("collection").isin(*URGENT), "high").otherwise("normal")).withColumn("change_fields", F.when(F.col("operation").isin("update", "replace"), changed).otherwise(F.array().cast("array<string>")))


def topic(event_type: Column) -> Column:
    return F.coalesce(*[F.when(event_type.isin(*kinds), F.lit(name)) for name, kinds in TOPICS.items()], F.lit("default"))


def routed(events: DataFrame) -> DataFrame:
    return events.withColumn("topic", topic(F.col("event_type")))


def wanted(events: DataFrame, types: Sequence[str] = (), collections: Sequence[str] = ()) -> DataFrame:
    """Events of some types and collections; without either, all."""
    if types:
        events = events.where(F.col("event_type").isin(*types))
    return events.where(F.col("collection").isin(*collections)) if collections else events


def validated(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """events with issues, score and valid: an error or worse makes an event invalid."""
    checked = issues(events, rules)
    bad = lambda *kinds: F.size(F.filter("issues", lambda x: x.severity.isin(*kinds)))
    return checked.withColumn("score", realtime_score(bad("error", "critical"), bad("warning"))).withColumn("valid", bad("error", "critical") == 0)


def totals(checked: DataFrame, key: str) -> DataFrame:
    """Running counts by key: events, invalid ones, and issues."""
    return checked.groupBy(key).agg(F.count("*").alias("events"), F.count_if(~F.col("valid")).alias("invalid"), F.sum(F.size("issues")).alias("issues"))


def first_seen(events: DataFrame, key: str, stamp: str, delay: str) -> DataFrame:
    """Each key once within the delay; state is dropped behind the watermark."""
    return events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, stamp: str, size: str, delay: str, *by: str, slide: str | None = None) -> DataFrame:
    """Counts in windows of event time, an extension of the hourly and daily buckets."""
    marked = events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay)
    return marked.groupBy(F.window(stamp, size, slide) if slide else F.window(stamp, size), *by).agg(F.count("*").alias("n"))


def throttled(events: DataFrame, key: str, stamp: str, most: int, seconds: int, delay: str = "1 day") -> DataFrame:
    """(key, stamp, sent): at most `most` sends of a key in any trailing window; only sends count.

    A key's events of one micro-batch are taken in order of time, whatever Arrow batches they come
    in; events later than `delay` are dropped. State is the sends of one window, and goes when the
    watermark has passed the last of them by a window.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(events.dtypes)

    def step(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        times = pd.concat([batch[stamp] for batch in batches]).sort_values()
        out = []
        for at in times:
            now = at.timestamp()
            kept = [x for x in kept if now - x < seconds]
            out.append((k[0], at, len(kept) < most))
            if out[-1][2]:
                kept.append(now)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((max(kept, default=0.0) + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, stamp, "sent"])

    rows = events.select(key, F.col(stamp).cast("timestamp").alias(stamp)).withWatermark(stamp, delay)
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{stamp}` timestamp, sent boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def handle(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], out: str, checkpoint: str, retries: int = 3, order: Sequence[str] = ("priority", "event_id")):
    """Run every handler on every batch of its topic, urgent events first; events of a handler that fails `retries` times go to out/dead.

    Returns the started query. Ledger and dead letters are folders by batch and handler, so repeats overwrite.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rank = F.coalesce(*[F.when(F.col("priority") == p, F.lit(n)) for p, n in PRIORITY.items()], F.lit(2))
        rows = rows.withColumn("priority_rank", rank).persist()
        try:
            for name, handler in handlers.items():
                mine = rows.where(F.col("topic") == name).orderBy(*["priority_rank" if c == "priority" else c for c in order])
                said = None
                for _attempt in range(retries):
                    try:
                        handler(mine)
                        said = None
                        break
                    except Exception as e:  # a handler may fail in any way
                        said = str(e)[:500]
                if said is not None:
                    dead = mine.withColumn("error", F.lit(said)).withColumn("retry_count", F.lit(retries))
                    dead.write.mode("overwrite").parquet(f"{out}/dead/batch={number}/handler={name}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead_letters(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/dead").parquet(f"{out}/dead")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream has, as a table: run until its source is empty. Other modes than append keep the last state."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/data")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.schema(stream.schema).parquet(f"{path}/data/batch={last}")
