"""Tables clustered by key: stored in buckets, so an upsert moves the batch only.

A table is a folder of versions, each a table in the session's catalog that is bucketed and sorted
by its keys. Joining a batch with it, and looking for keys that repeat, needs no exchange of the
stored rows: each task reads a bucket, meets the batch's rows of that bucket, and writes it again.
A version that is not whole is never pointed to; versions before stay until they are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.changes import last_by_key
from tributary.session import file_system


def _version(spark: SparkSession, name: str) -> int:
    """The number of the newest version that was finished, which its property tells."""
    found = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}_v")]
    whole = [int(n.removeprefix(f"{name}_v")) for n in found if spark.sql(f"SHOW TBLPROPERTIES {n} ('whole')").first()["value"] == "true"]
    return max(whole, default=0)


def stored(spark: SparkSession, name: str) -> DataFrame:
    """The newest whole version, with _key, the hash of the keys that buckets and joins go by."""
    return spark.table(f"{name}_v{_version(spark, name)}")


def current(spark: SparkSession, name: str) -> DataFrame:
    return stored(spark, name).drop("_key")


def _store(rows: DataFrame, name: str, path: str, buckets: int, number: int) -> None:
    spark, table = rows.sparkSession, f"{name}_v{number}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")  # left by a run that broke off
    rows.write.mode("overwrite").bucketBy(buckets, "_key").sortBy("_key").option("path", f"{path}/v-{number}").saveAsTable(table)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('whole' = 'true')")


def create(rows: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Store rows as the first version of a table, in so many buckets."""
    _store(rows.withColumn("_key", F.xxhash64(*keys)).repartition(buckets, "_key"), name, path, buckets, _version(rows.sparkSession, name) + 1)
    return current(rows.sparkSession, name)


def repeated(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows of a stored table have, with their number; a null in a key is a value like any other. Each bucket is counted by itself."""
    return table.groupBy("_key", *keys).agg(F.count("*").alias("n")).where("n > 1").drop("_key")


def _equal(key: str):
    """Null-safe equality in a form that does not become a key of the join, which would ask for another partitioning."""
    return F.when(F.col(key).isNull(), F.col(f"__{key}").isNull()).otherwise(F.col(key) == F.col(f"__{key}"))


def merged(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """A stored table after a batch of upserts (and of deletions, where the batch has `_op` delete): rows of the batch win. Only the batch is exchanged.

    Keys with one hash are told apart by themselves, nulls included.
    """
    new = last_by_key(batch, keys, order)
    names = [c for c in table.columns if c not in keys and c != "_key"]
    gone = (F.col("_op") == "delete") if "_op" in new.columns else F.lit(False)
    new = new.select(F.xxhash64(*keys).alias("__key"), *[F.col(k).alias(f"__{k}") for k in keys], gone.alias("__gone"), F.struct(*names).alias("__new"))
    old = table.select("_key", *keys, F.struct(*names).alias("__old"))
    both = old.hint("merge").join(new, [F.col("_key") == F.col("__key"), *[_equal(k) for k in keys]], "full_outer")
    key = [F.when(F.col("__old").isNotNull(), F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys]
    row = F.coalesce("__new", "__old")
    return both.where(~F.coalesce("__gone", F.lit(False))).select(F.coalesce("_key", "__key").alias("_key"), *key, *[row[c].alias(c) for c in names])


def upsert(spark: SparkSession, name: str, path: str, batch: DataFrame, keys: Sequence[str], buckets: int, order: str | None = None) -> DataFrame:
    """Store the table after a batch as its next version; the old one stays."""
    number = _version(spark, name)
    _store(merged(stored(spark, name), batch, keys, order), name, path, buckets, number + 1)
    return current(spark, name)


def drop_before(spark: SparkSession, name: str, path: str, keep: int = 2) -> None:
    """Drop all but the last `keep` versions, with their files."""
    last = _version(spark, name)
    for number in range(1, last - keep + 1):
        spark.sql(f"DROP TABLE IF EXISTS {name}_v{number}")
        place, fs = file_system(spark, f"{path}/v-{number}")
        fs.delete(place, True)
