"""What changes reach: schema changes through the lineage of columns, and dependencies of data sets.

Column edges are (source, target), ids of columns; walks keep where they began, so many changes are
followed at once, one join with the edges a step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.schemas import Field, compare, compatible
from tributary.session import cut

SMALL = 100_000  # rows of a front that are sent to all tasks
LEVELS = ("low", "medium", "high", "critical")


def walked(edges: DataFrame, starts: DataFrame, depth: int = 10, upstream: bool = False) -> DataFrame:
    """(origin, id, distance) of every node within `depth` steps of each start (origin, id), which is left out.

    Edges are read anew in every step and neither copied nor freed of repeated ones, since what a
    step reaches is; edges that cost much to make should be a table.
    """
    edges = edges.select("source", "target").where("source is not null and target is not null")
    if upstream:
        edges = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    front = cut(starts.select("origin", "id").distinct().withColumn("distance", F.lit(0)))
    seen, n = front, front.count()
    for step in range(1, depth + 1):
        # a small front goes to the edges, so that these are not dealt out again for each step
        near = (F.broadcast(front) if n <= SMALL else front).join(edges, F.col("id") == F.col("source")).select("origin", F.col("target").alias("id")).distinct()
        front = cut(near.join(seen, ["origin", "id"], "left_anti").withColumn("distance", F.lit(step)))
        n = front.count()
        if not n:
            break
        seen = seen.union(front)
    return seen.where("distance > 0")


def schema_changes(old: Sequence[Field], new: Sequence[Field]) -> list[tuple[str, str, bool, str]]:
    """(column, change, breaking, findings) of every column that differs: added, removed or changed, and whether old data or old readers break."""
    kinds = compare(old, new)
    said: dict[str, list[str]] = {}
    for finding in compatible(old, new, "backward") + compatible(old, new, "forward"):
        said.setdefault(finding.split()[1], []).append(finding)
    return sorted((name, kind, name in said, "; ".join(sorted(said.get(name, [])))) for kind, names in kinds.items() for name in names)


def schema_impact(changes: DataFrame, edges: DataFrame, columns: DataFrame, depth: int = 10) -> DataFrame:
    """(id, data_set, kind, distance, level, breaking, changes) of every column that a change reaches.

    changes: (id, change, breaking) of changed columns; columns: (id, data_set, kind of data set).
    A near column matters more, and one of a report or model, or behind a removed column, one
    level more; of several changes the worst counts. What a column that was added may reach is not
    hit.
    """
    starts = changes.where("change <> 'added'").select(F.col("id").alias("origin"), "id")
    far = walked(edges, starts, depth).join(changes.select(F.col("id").alias("origin"), "change", "breaking"), "origin").join(columns, "id", "left")
    points = F.when(F.col("distance") == 1, 3).when(F.col("distance") <= 3, 2).otherwise(1)
    points = points + F.when(F.col("kind").isin("report", "model"), 1).otherwise(0) + F.when(F.col("change") == "removed", 1).otherwise(0)
    worst = far.groupBy("id", "data_set", "kind").agg(F.min("distance").alias("distance"), F.max(F.least(points, F.lit(4))).alias("points"), F.bool_or("breaking").alias("breaking"), F.array_sort(F.collect_set(F.concat_ws(":", "change", F.col("origin").cast("string")))).alias("changes"))
    return worst.select("id", "data_set", "kind", "distance", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("points").cast("int")).alias("level"), "breaking", "changes")


def dependencies(edges: DataFrame, nodes: DataFrame, depth: int = 10) -> DataFrame:
    """By node (id): direct and all sources, the longest shortest way to one, direct and all users, and `only`: users that have no other source."""
    starts = nodes.select(F.col("id").alias("origin"), "id")
    up, down = walked(edges, starts, depth, upstream=True), walked(edges, starts, depth)
    count = lambda rows, name: rows.groupBy("origin").agg(F.count_if(F.col("distance") == 1).alias(f"direct_{name}"), F.count("*").alias(f"all_{name}"), F.max("distance").alias(f"far_{name}"))
    alone = edges.select("source", "target").distinct().groupBy("target").agg(F.count("*").alias("n"), F.max("source").alias("source")).where("n = 1")
    only = alone.groupBy(F.col("source").alias("origin")).agg(F.count("*").alias("only"))
    out = starts.select("origin").distinct()
    for part in (count(up, "sources"), count(down, "users"), only):
        out = out.join(part, "origin", "left")
    return out.na.fill(0).withColumnRenamed("origin", "id")
