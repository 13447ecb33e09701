"""Sinks: flat and safe columns, delimited, JSON and workbook files, partitions, and snapshots of a table.

A snapshot is a folder of its own; the table's pointer names the current one, and is written last.
A reader sees the old or the new table whole, and a run that dies leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructType, TimestampNTZType, TimestampType

from tributary.functions.text import sql_text
from tributary.operators.changes import upsert
from tributary.session import file_system, write_bytes


def flat(rows: DataFrame, deep: bool = True) -> DataFrame:
    """Struct fields as columns named a.b, _id as id; one level only if not deep."""

    def leaves(schema: StructType, path: tuple, level: int):
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, StructType) and (deep or level == 0):
                yield from leaves(f.dataType, here, level + 1)
            else:
                name = ".".join(here)
                yield F.col(".".join(f"`{p}`" for p in here)).alias("id" if name == "_id" else name)

    return rows.select(*leaves(rows.schema, (), 0))


def safe(c: Column, kind) -> Column:
    """A value as text for a spreadsheet."""
    if isinstance(kind, StringType):
        return sql_text(c)
    if isinstance(kind, BooleanType):
        return F.when(c, "TRUE").when(~c, "FALSE").otherwise("")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def sanitized(rows: DataFrame) -> DataFrame:
    rows = flat(rows)
    return rows.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])


def to_csv(rows: DataFrame, path: str, limit: int | None = None, encoding: str = "utf-8", columns=None) -> None:
    out = sanitized(rows.select(*columns) if columns else rows)
    (out.limit(limit) if limit else out).write.option("header", "true").option("encoding", encoding).option("quoteAll", "true").option("escape", '"').csv(path)


def to_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def to_workbook(rows: DataFrame, path: str, limit: int = 50_000) -> None:
    """At most `limit` rows (what one sheet is meant to hold) as one workbook file, by any path that Spark can write; workbooks.workbooks() makes many of all rows."""
    from tributary.sources.workbooks import to_xlsx

    shown = sanitized(rows).limit(limit)
    data = to_xlsx({"Sheet1": [shown.columns, *map(list, shown.collect())]})
    write_bytes(rows.sparkSession, path, data, overwrite=True)


def selected(rows: DataFrame, equal: dict | None = None, stamp: str | None = None, first=None, last=None) -> DataFrame:
    """Rows by optional equalities and an inclusive range of dates."""
    for name, value in (equal or {}).items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if first is not None:
        rows = rows.where(F.col(stamp) >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        rows = rows.where(F.col(stamp) <= F.lit(last).cast("timestamp_ntz"))
    return rows


PARTITIONS = {"date": "yyyy-MM-dd", "month": "yyyy-MM"}


def load(rows: DataFrame, path: str, partition: str | None = None, stamp: str = "_data_date", source: str = "_source_id") -> None:
    """Append rows, in folders by day, month or source of each row. Rows are dealt by folder, so folders hold few files."""
    if partition is None:
        rows.write.mode("append").parquet(path)
        return
    key = F.col(source).cast("string") if partition == "source" else F.date_format(F.col(stamp).cast("date"), PARTITIONS[partition])
    keyed = rows.withColumn("_part", key)
    keyed.hint("rebalance", "_part").write.mode("append").partitionBy("_part").parquet(path)


def by_category(rows: DataFrame, category: str, tables: dict[str, list[str]], default: str) -> dict[str, DataFrame]:
    """A table for each category with its columns; others go to the default."""
    known = F.coalesce(F.col(category).isin([*tables]), F.lit(False))
    return {name: rows.where((~known | (F.col(category) == name)) if name == default else (F.col(category) == name)).select(*columns) for name, columns in tables.items()}


def _pointers(spark: SparkSession, path: str):
    """The folder of pointers, its file system, and the names in it in order: <number>-<snapshot>."""
    place, fs = file_system(spark, f"{path}/_current")
    names = sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
    return place, fs, names


def publish(rows: DataFrame, path: str, compression: str = "zstd") -> str:
    """Write rows as the table's next snapshot and point to it; returns its folder.

    A pointer is the name of an empty file, made after the snapshot is whole. Nothing is
    overwritten, so a reader or a crash in between still has the pointer before.
    """
    spark = rows.sparkSession
    name = f"s-{uuid.uuid4().hex}"
    rows.write.option("compression", compression).parquet(f"{path}/{name}")
    place, fs, names = _pointers(spark, path)
    number = int(names[-1].partition("-")[0]) + 1 if names else 1
    fs.createNewFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, f"{number:012d}-{name}"))
    return f"{path}/{name}"


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's current snapshot; None if it has none yet."""
    names = _pointers(spark, path)[2]
    return spark.read.parquet(f"{path}/{names[-1].partition('-')[2]}") if names else None


def merge_into(batch: DataFrame, path: str, keys: list[str], stamp: Column, order: str | None = None) -> dict[str, int]:
    """Upsert a batch into a table of snapshots; returns counts by outcome. Running a batch again gives only `same`."""
    spark, old = batch.sparkSession, current(batch.sparkSession, path)
    if old is None:
        old = batch.limit(0).withColumn("_first_seen", stamp)
    made = upsert(old.drop("_outcome"), batch, keys, stamp, order)
    done = publish(made, path)
    return {r["_outcome"]: r["n"] for r in spark.read.parquet(done).groupBy("_outcome").agg(F.count("*").alias("n")).collect()}
