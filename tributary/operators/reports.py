"""Reports over runs of validation, snapshots, staging, reviews and test crawls, and a registry of schemas as a table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.scores import percent, rounded
from tributary.operators.schemas import Field, compatible, fingerprint

LEVELS = ("critical", "error", "warning")


def quality_timeline(validations: DataFrame, interval: str, *by: str) -> DataFrame:
    """Ten measures by hour or day (bucket) of validations (created_at, records, score, issues as severity and rule)."""
    form = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd"}[interval]
    count = lambda kind: F.size(F.filter("issues", lambda x: x.severity == kind))
    score = F.col("score").cast("decimal(24,6)")
    return validations.groupBy(*by, F.date_format("created_at", form).alias("bucket")).agg(
        F.count("*").alias("validations"), F.sum("records").alias("records"), rounded(F.sum(score).cast("double") / F.count("score"), 1).alias("avg_score"), rounded(F.min("score"), 1).alias("min_score"), rounded(F.max("score"), 1).alias("max_score"),
        F.sum(F.size("issues")).alias("issues"), *[F.sum(count(k)).alias(k) for k in LEVELS], F.count_if(F.size("issues") == 0).alias("clean"),
    )


def quality_trend(validations: DataFrame, by: str, most: int = 10) -> DataFrame:
    """By source: overall average, lowest and highest score, validations, issues, and the `most` frequent rules (rule:count, ties by rule)."""
    score = F.col("score").cast("decimal(24,6)")
    overall = validations.groupBy(by).agg(rounded(F.sum(score).cast("double") / F.count("score"), 4).alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count("*").alias("validations"), F.sum(F.size("issues")).alias("issues"))
    rules = validations.select(by, F.explode("issues.rule").alias("rule")).groupBy(by, "rule").agg(F.count("*").alias("n"))
    best = rules.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "rule"))).where(F.col("place") <= most)
    told = best.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rule", "n"))), lambda x: F.concat_ws(":", x.rule, x.n.cast("string"))).alias("top_rules"))
    return overall.join(told, by, "left").withColumn("top_rules", F.coalesce("top_rules", F.array().cast("array<string>")))


def snapshot_statistics(snapshots: DataFrame, by: str) -> DataFrame:
    """By source and status: snapshots, bytes before and after compression, records; of active ones by kind, and the percent saved by those that are not deleted."""
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "kinds"))))
    counted = snapshots.groupBy(by, "status", "kind").agg(F.count("*").alias("kinds"), F.sum("original").alias("original"), F.sum("stored").alias("stored"), F.sum("records").alias("records"))
    out = counted.groupBy(by, "status").agg(F.sum("kinds").alias("snapshots"), F.sum("original").alias("original"), F.sum("stored").alias("stored"), F.sum("records").alias("records"), kinds.alias("by_kind"))
    saved = percent(F.col("original") - F.col("stored"), F.col("original"))
    active = F.when(F.col("status") == "active", F.array_join(F.transform(F.map_entries("by_kind"), lambda e: F.concat_ws(":", e.key, e.value.cast("string"))), ",")).otherwise("")
    return out.select(by, "status", "snapshots", "original", "stored", "records", active.alias("by_kind"), F.when(F.col("status") != "deleted", F.coalesce(saved, F.lit(0.0))).alias("saved"))


def staging_statistics(tables: dict[str, DataFrame], statuses: Sequence[str] = ("pending", "promoted", "rolled_back")) -> DataFrame:
    """(collection, one count for each status) of staging tables (_review_status), and their sum as `total`; tables without any such row are left out."""
    rows = None
    for name, table in tables.items():
        one = table.select(F.lit(name).alias("collection"), "_review_status")
        rows = one if rows is None else rows.unionByName(one)
    every = rows.select(F.explode(F.array("collection", F.lit("total"))).alias("collection"), "_review_status")
    out = every.groupBy("collection").agg(*[F.count_if(F.col("_review_status") == s).alias(s) for s in statuses])
    return out.where(sum((F.col(s) for s in statuses), F.lit(0)) > 0)


def review_details(reviews: DataFrame, sources: DataFrame, results: DataFrame) -> DataFrame:
    """reviews (source_id, result_id) with their source and crawl result as structs, null where they are gone."""
    of = lambda rows, key, name: rows.select(F.col(key), F.struct(*[c for c in rows.columns if c != key]).alias(name))
    return reviews.join(of(sources, "source_id", "source"), "source_id", "left").join(of(results, "result_id", "result"), "result_id", "left")


def pipeline_status(sources: DataFrame, runs: DataFrame, sessions: DataFrame, last: int = 10) -> DataFrame:
    """sources (source_id, status) with the success rate and mean time of their `last` runs (source_id, run_id, started_at, status, ms), and as healing where a session (source_id, session_id, status) is open."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    recent = runs.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= last)
    rates = recent.groupBy("source_id").agg(F.round(F.count_if(F.col("status") == "success") * 100.0 / F.count("*"), 1).cast("double").alias("success_rate"), F.floor(F.sum(F.coalesce("ms", F.lit(0.0)).cast("decimal(24,6)")) / F.count("*")).cast("long").alias("mean_ms"))
    open_ones = sessions.where(F.col("status").isin("diagnosing", "ai_solving", "source_check")).groupBy("source_id").agg(F.min("session_id").alias("session_id"))
    both = sources.join(rates, "source_id", "left").join(open_ones, "source_id", "left")
    return both.withColumn("status", F.when(F.col("session_id").isNotNull(), "healing").otherwise(F.coalesce("status", F.lit("unknown")))).na.fill(0, ["success_rate", "mean_ms"])


def preview(records: DataFrame, key: str, fields: Sequence[str], most: int = 10) -> DataFrame:
    """By page of extracted records: how many there are, how many a preview shows, per field found and empty ones, and warnings."""
    there = lambda f: F.col(f).isNotNull() & (F.trim(f) != "")
    out = records.groupBy(key).agg(F.count("*").alias("total_found"), *[F.count_if(there(f)).alias(f"{f}_found") for f in fields])
    warned = [F.when(F.col(f"{f}_found") == 0, F.lit(f"{f}: never found")).when(F.col(f"{f}_found") * 2 < F.col("total_found"), F.lit(f"{f}: mostly empty")) for f in fields]
    shown = F.least("total_found", F.lit(most).cast("long"))
    return out.select(key, "total_found", shown.alias("shown"), *[x for f in fields for x in (f"{f}_found", (F.col("total_found") - F.col(f"{f}_found")).alias(f"{f}_empty"))], F.array_compact(F.array(*warned)).alias("warnings"))


REGISTRY = "source_id string, version int, fingerprint string, schema string, active boolean, reason string, created_at string"


def newest_schema(registry: DataFrame, source_id: str) -> tuple[int, str | None, list[Field] | None]:
    """Version, fingerprint and fields of a source's newest active schema; the number is that of its newest version of any kind."""
    rows = registry.where(F.col("source_id") == source_id).orderBy(F.desc("version")).select("version", "fingerprint", "schema", "active").collect()  # a source's versions
    live = next((r for r in rows if r["active"]), None)
    return (rows[0]["version"] if rows else 0, live["fingerprint"] if live else None, loaded(live["schema"]) if live else None)


def dumped(schema: Sequence[Field]) -> str:
    return json.dumps([asdict(f) for f in sorted(schema, key=lambda f: f.name)], sort_keys=True)


def loaded(text: str) -> list[Field]:
    return [Field(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items()}) for f in json.loads(text)]


def register(registry: DataFrame, source_id: str, schema: Sequence[Field], stamp: str, mode: str = "backward") -> tuple[DataFrame, list[str]]:
    """registry with a source's schema as its next version, and what stands against it, in which case (or if it is the newest one already) nothing is added."""
    number, known, old = newest_schema(registry, source_id)
    problems = compatible(old, schema, mode) if old is not None else []
    if problems or known == fingerprint(schema):
        return registry, problems
    row = [(source_id, number + 1, fingerprint(schema), dumped(schema), True, None, stamp)]
    return registry.unionByName(registry.sparkSession.createDataFrame(row, REGISTRY)), []


def deprecated(registry: DataFrame, source_id: str, version: int, reason: str) -> DataFrame:
    mine = (F.col("source_id") == source_id) & (F.col("version") == version)
    return registry.withColumn("active", F.col("active") & ~mine).withColumn("reason", F.when(mine, F.lit(reason)).otherwise(F.col("reason")))


def exported(registry: DataFrame) -> DataFrame:
    """Every version as one line of JSON (document), which imported() takes."""
    return registry.select(F.to_json(F.struct("source_id", "version", "fingerprint", "schema", "created_at")).alias("document"))


def imported(registry: DataFrame, source_id: str, document: str, stamp: str, mode: str = "backward") -> tuple[DataFrame, list[str]]:
    """registry with a schema of another registry, by exported()'s line, as a source's next version."""
    return register(registry, source_id, loaded(json.loads(document)["schema"]), stamp, mode)


def registered_sources(registry: DataFrame) -> DataFrame:
    """By source: versions, newest one, newest active one, and when the first and the last came."""
    live: Column = F.max(F.when(F.col("active"), F.col("version")))
    return registry.groupBy("source_id").agg(F.count("*").alias("versions"), F.max("version").alias("newest"), live.alias("active"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
