"""Change detection, diffs of data sets, patches and versions.

Everything compares by key with null-safe equality, so a null key is a key like any other. Where
a key repeats, its last row by `order` counts; without an order keys are taken to be distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    if order is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def _renamed(rows: DataFrame, keys: Sequence[str], *columns: Column) -> DataFrame:
    """Keys under other names, to be compared by _same, and columns."""
    return rows.select(*[F.col(k).alias(f"__{k}") for k in keys], *columns)


def _same(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]


def _either(keys: Sequence[str], here: str) -> list[Column]:
    """Keys after a full join: a side's key counts where the side is there, be it null or not."""
    return [F.when(F.col(here).isNotNull(), F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys]


def detect(batch: DataFrame, store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """batch with _change: new, modified or unchanged by content_hash against the store (keys, content_hash)."""
    old = _renamed(store, keys, F.col("content_hash").alias("__hash"))
    change = F.when(F.col("__hash").isNull(), "new").when(F.col("__hash") == F.col("content_hash"), "unchanged").otherwise("modified")
    return batch.join(old, _same(keys), "left").withColumn("_change", change).select(*batch.columns, "_change")


def deleted(batch: DataFrame, store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the store without a row in the batch."""
    return _without(store, batch, keys)


def updated_store(batch: DataFrame, store: DataFrame, keys: Sequence[str], stamp: Column) -> DataFrame:
    """The store after a batch: first_seen stays, last_seen moves."""
    new = _renamed(batch, keys, F.col("content_hash").alias("__new"))
    both = store.withColumn("__here", F.lit(True)).join(new, _same(keys), "full_outer")
    moved = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("content_hash"))
    return both.select(
        *_either(keys, "__here"), F.coalesce("__new", "content_hash").alias("content_hash"), F.coalesce(F.col("first_seen"), stamp).alias("first_seen"), F.when(moved, stamp).otherwise(F.coalesce(F.col("last_seen"), stamp)).alias("last_seen")
    )


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], ignore: Sequence[str] = (), order: str | None = None, case: bool = True) -> DataFrame:
    """keys, change (added, deleted, modified, unchanged) and fields: (field, change, before, after) of each that differs.

    A column on one side only counts as null on the other.
    """
    skip = {*keys, *ignore, order}
    left, right = last_by_key(old, keys, order), last_by_key(new, keys, order)
    names = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c not in skip]
    side = lambda df, s: df.select(*[F.col(k).alias(f"{s}_{k}") for k in keys], F.lit(True).alias(f"{s}_here"), *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(f"{s}_{c}") for c in names])
    fold = lambda c: c if case else F.lower(c)
    both = side(left, "a").join(side(right, "b"), [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys], "full_outer")
    found = []
    for c in names:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        kind = F.when(a.isNull(), "added").when(b.isNull(), "deleted").otherwise("modified")
        found.append(F.when(~fold(a).eqNullSafe(fold(b)), F.struct(F.lit(c).alias("field"), kind.alias("change"), a.alias("before"), b.alias("after"))))
    here = F.col("a_here").isNotNull() & F.col("b_here").isNotNull()
    fields = F.when(here, F.array_compact(F.array(*found))).otherwise(F.array().cast("array<struct<field:string,change:string,before:string,after:string>>"))
    change = F.when(F.col("a_here").isNull(), "added").when(F.col("b_here").isNull(), "deleted").when(F.size("fields") > 0, "modified").otherwise("unchanged")
    return both.withColumn("fields", fields).withColumn("change", change).select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], "change", "fields")


def summary(changes: DataFrame) -> DataFrame:
    c = F.col("change")
    kinds = ("added", "deleted", "modified", "unchanged")
    out = changes.agg(*[F.count_if(c == k).alias(k) for k in kinds])
    before, after = F.col("deleted") + F.col("modified") + F.col("unchanged"), F.col("added") + F.col("modified") + F.col("unchanged")
    out = out.withColumns({"total_changes": F.col("added") + F.col("deleted") + F.col("modified"), "before": before, "after": after})
    return out.withColumn("change_rate", F.round(F.coalesce(F.try_divide(F.col("total_changes") * 100.0, F.greatest("before", "after").cast("double")), F.lit(0.0)), 2))


def field_counts(changes: DataFrame) -> DataFrame:
    return changes.where("change = 'modified'").select(F.inline("fields")).groupBy("field", "change").agg(F.count("*").alias("n"))


def warnings(counts: DataFrame) -> DataFrame:
    """A row for each share that is out of line: counts as of summary."""
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.greatest("before", "after")), F.lit(0.0))
    bounds = (("total_changes", 0.5), ("deleted", 0.3), ("added", 0.8))
    found = [F.when(share(c) > b, F.struct(F.lit(f"many_{c}").alias("warning"), F.round(share(c), 4).alias("share"))) for c, b in bounds]
    return counts.select(F.inline(F.array_compact(F.array(*found))))


def delta(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """What turns old into new: new's changed and added rows with _op upsert, and deleted keys with _op delete."""
    old, new = last_by_key(old, keys, order), last_by_key(new, keys, order)
    kinds, there = dict(new.dtypes), set(old.columns)
    names = [c for c in new.columns if c not in keys]
    row = lambda have: F.struct(*[(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in names])
    before = _renamed(old, keys, row(there).alias("__old"))
    changed = new.withColumn("__new", row(kinds)).join(before, _same(keys), "left").where(~F.col("__new").eqNullSafe(F.col("__old"))).select(*new.columns, F.lit("upsert").alias("_op"))
    gone = _without(old.select(*keys), new, keys).withColumn("_op", F.lit("delete"))
    return changed.unionByName(gone, allowMissingColumns=True)


def _without(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows whose keys (nulls equal nulls) are not among those of others."""
    return rows.join(_renamed(others, keys).distinct(), _same(keys), "left_anti")


def apply(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base without the patch's keys, and the patch's upserts."""
    rest = _without(base, patch, keys)
    return rest.unionByName(patch.where("_op = 'upsert'").drop("_op"), allowMissingColumns=True)


def materialized(base: DataFrame, patches: Sequence[DataFrame], keys: Sequence[str], order: str = "__v") -> DataFrame:
    """A chain of patches on a base at once: of all rows of a key the latest counts, so a chain costs one shuffle."""
    rows = base.withColumns({"_op": F.lit("upsert"), order: F.lit(0)})
    for i, p in enumerate(patches, 1):
        rows = rows.unionByName(p.withColumn(order, F.lit(i)), allowMissingColumns=True)
    names = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("r"))
    return newest.where("r._op = 'upsert'").select(*keys, *[F.col(f"r.{c}").alias(c) for c in names if c not in ("_op", order)])


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], stamp: Column, order: str | None = None) -> DataFrame:
    """target after a batch: its rows by key from the batch, _first_seen as it was, with _outcome (kept, updated, same, inserted)."""
    new = last_by_key(batch, keys, order)
    names = [c for c in new.columns if c not in keys]
    both = target.select(*keys, F.struct(*names).alias("__t"), "_first_seen").join(_renamed(new, keys, F.struct(*names).alias("__b")), _same(keys), "full_outer")
    outcome = F.when(F.col("__b").isNull(), "kept").when(F.col("__t").isNull(), "inserted").when(F.col("__t").eqNullSafe(F.col("__b")), "same").otherwise("updated")
    row = F.coalesce("__b", "__t")
    return both.select(*_either(keys, "__t"), *[row[c].alias(c) for c in names], F.coalesce(F.col("_first_seen"), stamp).alias("_first_seen"), outcome.alias("_outcome"))


def promote(staging: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Approved staging rows with corrections (key, field, value) applied, without names that begin with _; and corrected: the fields that were."""
    given = corrections.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__c"))
    names = [c for c in staging.columns if not c.startswith("_") and c != key]
    both = staging.where("_review_status = 'approved'").join(given, key, "left")
    fixed = [F.coalesce(F.try_element_at("__c", F.lit(c)).cast(dict(staging.dtypes)[c]), F.col(c)).alias(c) for c in names]
    return both.select(key, *fixed, F.coalesce(F.array_sort(F.map_keys("__c")), F.array().cast("array<string>")).alias("corrected"))


def rollback(production: DataFrame, log: DataFrame, key: str) -> DataFrame:
    return _without(production, log, [key])


def savings(versions: DataFrame) -> DataFrame:
    """Rows, bytes and percent saved by kind of version (kind, records, original_bytes, stored_bytes)."""
    out = versions.groupBy("kind").agg(F.count("*").alias("versions"), F.sum("records").alias("records"), F.sum("original_bytes").alias("original_bytes"), F.sum("stored_bytes").alias("stored_bytes"))
    return out.withColumn("saved", F.round(F.coalesce(F.try_divide((F.col("original_bytes") - F.col("stored_bytes")) * 100.0, F.col("original_bytes").cast("double")), F.lit(0.0)), 2))
