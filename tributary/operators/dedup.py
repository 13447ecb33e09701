"""Duplicates by whole row, by key, by hash and by likeness, and records merged from groups of them.

Which row stays is set by an order column, never by chance. Likeness is defined without regard to
order: a row is a duplicate if a row before it is as near as asked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(order: str, keep: str) -> list[Column]:
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    return [F.asc(order) if keep == "first" else F.desc(order)]


def mark(rows: DataFrame, keys: Sequence[str | Column], order: str, keep: str = "first", ignore_null: bool = True) -> DataFrame:
    """rows with _duplicate. Rows with a null in their key are no duplicates, unless nulls count."""
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order, keep)))
    whole = F.lit(True)
    for k in keys if ignore_null else ():
        whole = whole & k.isNotNull()
    return rows.withColumn("_duplicate", whole & (place > 1))


def by_key(rows: DataFrame, keys: Sequence[str], order: str, keep: str = "first", case: bool = True, ignore_null: bool = True) -> DataFrame:
    return mark(rows, keys if case else [F.lower(F.col(k).cast("string")) for k in keys], order, keep, ignore_null)


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as JSON, by name; nulls count."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def exact(rows: DataFrame, order: str, keep: str = "first") -> DataFrame:
    """Whole rows but for the order column and names that begin with _."""
    names = [c for c in rows.columns if c != order and not c.startswith("_")]
    return mark(rows, [row_hash(names)], order, keep)


def by_hash(rows: DataFrame, columns: Sequence[str], order: str, keep: str = "first", case: bool = True) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    whole = F.concat_ws("|", *[p if case else F.lower(p) for p in parts])
    return mark(rows, [F.substring(F.sha2(whole, 256), 1, 16)], order, keep)


def groups(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Each key with two rows at least: its number of rows, and the first and last in order."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last")).where("n > 1")


def grams(c: Column, n: int = 2) -> Column:
    """The different runs of n characters; a shorter text is its own."""
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(runs)).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def similar_pairs(rows: DataFrame, key: str, text: str, threshold: float = 0.8, n: int = 2) -> DataFrame:
    """(a, b, similarity) of all pairs of different texts whose gram sets are near enough, and each text's rows.

    Prefix filtering: in one global order of grams, rarest first, two near sets share a gram among
    their first size - ceil(threshold * size) + 1. Only those are joined, and pairs of too different
    sizes fall away at once, so frequent grams do not bring all rows together.
    """
    sets = rows.select(F.col(key).alias("id"), grams(F.lower(text), n).alias("set")).where(F.size("set") > 0)
    classes = sets.groupBy(F.array_sort("set").alias("set")).agg(F.min("id").alias("id"))
    entries = classes.select("id", F.explode("set").alias("gram"))
    rare = entries.groupBy("gram").agg(F.count("*").alias("n"))
    ordered = entries.join(rare, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("o"))
    m = F.size("o")
    head = F.slice("o", 1, (m - F.ceil(m * threshold) + 1).cast("int"))
    heads = ordered.select("id", m.alias("m"), F.explode(F.transform(head, lambda x: x.gram)).alias("gram"))
    right = heads.select(F.col("id").alias("b"), F.col("m").alias("bm"), "gram")
    near_size = (F.col("m") >= threshold * F.col("bm")) & (F.col("bm") >= threshold * F.col("m"))
    found = heads.withColumnRenamed("id", "a").join(right, "gram").where((F.col("a") < F.col("b")) & near_size).select("a", "b").distinct()
    both = found.join(classes.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(classes.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


def fuzzy(rows: DataFrame, key: str, text: str, threshold: float = 0.8, n: int = 2) -> DataFrame:
    """rows with _duplicate: another row with a smaller key is as near as asked, or has the same grams."""
    sets = rows.select(F.col(key).alias("__id"), F.array_sort(grams(F.lower(text), n)).alias("set"))
    classes = sets.where(F.size("set") > 0).groupBy("set").agg(F.min("__id").alias("rep"))
    late = similar_pairs(rows, key, text, threshold, n).select(F.col("b").alias("rep"), F.lit(True).alias("late")).distinct()
    known = sets.join(classes, "set", "left").join(late, "rep", "left")
    flags = known.select("__id", (F.coalesce("late", F.lit(False)) | (F.col("rep") != F.col("__id"))).alias("d"))
    return rows.join(flags, F.col(key) == F.col("__id"), "left").withColumn("_duplicate", F.coalesce("d", F.lit(False))).drop("__id", "d")


def composite(rows: DataFrame, steps: Sequence, order: str) -> DataFrame:
    """rows with _duplicate and _reason: the first of the steps (name, function of rows giving _duplicate) that finds one."""
    reason = F.lit(None).cast("string")
    for i, (name, step) in enumerate(steps):
        rows = step(rows).withColumnRenamed("_duplicate", f"__d{i}")
        reason = F.coalesce(reason, F.when(F.col(f"__d{i}"), name))
    return rows.withColumn("_reason", reason).withColumn("_duplicate", F.col("_reason").isNotNull()).drop(*[f"__d{i}" for i in range(len(steps))])


def merge(rows: DataFrame, keys: Sequence[str], order: str, fields: dict[str, str] | None = None, default: str = "first") -> DataFrame:
    """One row for each key; each field's non-null values by first, last, max, min, sum or concat (in order, by "; ")."""
    by = F.struct(order)
    how = {
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), by)),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), by)),
        "max": F.max,
        "min": F.min,
        "sum": F.sum,
        "concat": lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).cast("string").alias("v"))))), lambda x: x.v), "; "),
    }
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(*[how[(fields or {}).get(c, default)](c).alias(c) for c in rest], F.count("*").alias("_merged"))


def new_rows(rows: DataFrame, seen: DataFrame, digest: Column) -> DataFrame:
    """rows whose digest is in no row of seen (digest), the first of each; for batches against a store of hashes."""
    return rows.withColumn("digest", digest).join(seen.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
