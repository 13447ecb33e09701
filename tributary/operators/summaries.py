"""Summaries of every field in one pass: samples, lengths, quantiles, frequent values and forms.

Each is mergeable: a task sums up its rows, and what tasks hand on is as large as the summary, not
as the data. Samples are the k different values with the smallest hashes, so they do not depend
on how rows are dealt; forms are what is left of a value when its letters and digits are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shape(value: Column) -> Column:
    """A value's form: runs of upper-case letters as A, of lower-case and other letters as a, of digits as 9; the rest as it is; of its first 64 characters."""
    text = F.substring(value, 1, 64)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Nd}+", "9"), r"\p{Lu}+", "A"), r"[\p{L}&&[^A]]+", "a")


def _least_hashes(k: int):
    """(field, value) to the k values of each field with the smallest hashes in a task."""

    def work(batches):
        import heapq

        import pyarrow as pa

        held: dict = {}
        bound: dict = {}
        for batch in batches:
            for field, value, h in zip(*(batch.column(c).to_pylist() for c in ("field", "value", "h")), strict=True):
                if field not in bound or h <= bound[field]:
                    mine = held.setdefault(field, set())
                    mine.add((h, value))
                    if len(mine) >= 8 * k:
                        held[field] = set(heapq.nsmallest(k, mine))
                        bound[field] = max(held[field])[0]
        rows = [(field, value, h) for field, mine in held.items() for h, value in heapq.nsmallest(k, mine)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["field", "value", "h"])

    return work


def _cells(rows: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    names = [c for c in (columns or rows.columns) if not c.startswith("_")]
    return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])))


def samples(rows: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """(field, samples): k different values of each field, or all if it has fewer, in order of their hashes."""
    cells = _cells(rows, columns).where("value is not null").withColumn("h", F.xxhash64("value"))
    some = cells.mapInArrow(_least_hashes(k), "field string, value string, h long").distinct()
    ranked = some.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("h", "value"))).where(F.col("n") <= k)
    return ranked.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x.value).alias("samples"))


def lengths(rows: DataFrame, columns: Sequence[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """(field, shortest, longest, mean, median, p90, number_median): lengths of values and the middle of those that are numbers, from sketches of so much accuracy."""
    n, x = F.length("value"), F.col("value").try_cast("double")
    return _cells(rows, columns).groupBy("field").agg(
        F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.percentile_approx(n, 0.5, accuracy).alias("median"), F.percentile_approx(n, 0.9, accuracy).alias("p90"), F.percentile_approx(x, 0.5, accuracy).alias("number_median")
    )


def forms(rows: DataFrame, columns: Sequence[str] | None = None, most: int = 3) -> DataFrame:
    """(field, form, n, rank): the `most` frequent forms of each field, ties by the form."""
    counted = _cells(rows, columns).where("value is not null").groupBy("field", shape(F.col("value")).alias("form")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("field").orderBy(F.desc("n"), "form")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
