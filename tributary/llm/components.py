"""Connected components by alternating large-star and small-star steps, as joins and aggregates.

Edges are (u, v), two ids of one orderable type. Minimum neighbours come from partial
aggregates and are joined back, so a hub with many neighbours is never gathered in one place.
Every step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.store import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(id, root) of every id in edges; root is the smallest id of its component. Raises if `max_steps` (enough for 2^60 ids in a chain) do not end it."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_steps):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        old, now = now, materialize(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        discard(old)
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not end after {max_steps} steps")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
