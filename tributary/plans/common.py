"""The driver's tables under the names that the engine's domain gives them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import table

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def exact(c):
    """A double as a decimal, so that sums do not depend on their order."""
    return c.cast("decimal(24,6)")


def total(c):
    return F.sum(exact(c)).cast("double")


def mean(c):
    return F.sum(exact(c)).cast("double") / F.count(c)


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Pipeline runs: run_id, source_id, status, category, ms, started_at."""
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").otherwise("partial")
    return table(spark, d, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("source_id"),
        status.alias("status"),
        F.col("event_type").alias("category"),
        F.col("value").alias("ms"),
        F.col("ts").cast("timestamp_ntz").alias("started_at"),
        "props",
    )


RUNS = """runs AS (SELECT event_id AS run_id, user_id AS source_id, event_type AS category, value AS ms, ts AS started_at, props,
    CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'partial' END AS status FROM events)"""


def news(spark: SparkSession, d: str) -> DataFrame:
    """Raw news rows: doc_id, title (first line), content, press, lang."""
    return table(spark, d, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.col("source").alias("press"), "lang"
    )


NEWS = r"news AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content, source AS press, lang FROM documents)"


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of documents: status from labels, pending without one; created_at and confidence derived from the id."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    made = F.timestamp_add("HOUR", F.col("doc_id").cast("int") % 700, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("source_id"),
        F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending").alias("status"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("needs_number_review"),
        (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("confidence"),
        made.alias("created_at"),
    )


REVIEWS = """reviews AS (SELECT d.doc_id AS review_id, d.source AS source_id,
    CASE l.quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS status,
    coalesce(l.toxic, 0) = 1 AS needs_number_review, ((d.doc_id * 37) % 101) / 100.0::DOUBLE AS confidence,
    TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id % 700 AS INTEGER)) AS created_at
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
