"""Graphs of data sets: reach, paths, components, cycles, order and impact.

Edges are (source, target). Every walk is a loop over frontiers: one join with the edges a step,
nothing gathered. Each step's frontier is cut from its history by a checkpoint in the folder that
the session names, so that a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import cut, scratch

SMALL = 65_536  # nodes of a front that is sent to the edges


def _clean(edges: DataFrame) -> DataFrame:
    return cut(edges.select("source", "target").where("source is not null and target is not null").distinct())


def reach(edges: DataFrame, start: DataFrame, depth: int = 10, upstream: bool = False) -> DataFrame:
    """(id, distance) of every node within `depth` steps of the starting nodes (id), which are left out."""
    edges = _clean(edges)
    if upstream:
        edges = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    front = start.select("id").distinct().withColumn("distance", F.lit(0))
    seen = front
    for step in range(1, depth + 1):
        near = front.join(edges, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct()
        front = cut(near.join(seen, "id", "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("distance > 0")


def impact(edges: DataFrame, start: DataFrame, types: DataFrame, deleted: bool = False, depth: int = 10) -> DataFrame:
    """What a change of the starting nodes reaches: (id, type, distance, level), low to critical.

    Near nodes matter more; reports and models, and deletions, one level more.
    """
    far = reach(edges, start, depth).join(types, "id", "left")
    level = F.when(F.col("distance") == 1, 3).when(F.col("distance") <= 3, 2).otherwise(1) + F.when(F.col("type").isin("report", "model"), 1).otherwise(0) + int(deleted)
    names = F.array(*map(F.lit, ("low", "medium", "high", "critical")))
    return far.select("id", "type", "distance", F.element_at(names, F.least(level, F.lit(4))).alias("level"))


def _kept(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, which is read again in every step of a walk."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed(rows: DataFrame) -> DataFrame:
    """(id, level, length) of the nodes neither on nor behind a cycle: the most edges, and the most weight, of a way from a root to a node; rows: (source, target, weight), each edge once.

    A node is placed in the step that brings the last of its edges, so a step holds a front and the
    nodes that wait for more edges, not all that is left. A small front is sent to the edges.
    """
    start = roots(rows).select("id", F.lit(0).cast(dict(rows.dtypes)["weight"]).alias("length"))
    rows = _kept(rows.join(rows.groupBy("target").agg(F.count("*").alias("needed")), "target"))
    front, waiting, out, level = _kept(start), None, None, 0
    while n := front.count():
        here = front.select("id", F.lit(level).alias("level"), "length")
        out = here if out is None else out.union(here)
        front = front.withColumnRenamed("id", "source")
        near = (F.broadcast(front) if n <= SMALL else front).join(rows, "source").select(F.col("target").alias("id"), "needed", F.lit(1).cast("long").alias("come"), (F.col("length") + F.col("weight")).alias("length"))
        near = near if waiting is None else near.unionByName(waiting)
        near = _kept(near.groupBy("id").agg(F.max("needed").alias("needed"), F.sum("come").alias("come"), F.max("length").alias("length")))
        front, waiting = near.where("come = needed").select("id", "length"), near.where("come < needed")
        level += 1
    return start.select("id", F.lit(0).alias("level"), "length") if out is None else out


def critical_paths(edges: DataFrame, most: int = 10, weight: str | None = None) -> DataFrame:
    """(path, length) of the `most` longest ways from a root to a leaf; with equal lengths, by their nodes from the last back.

    Forward, each node gets the length of the longest way to it, one row a node. Backward from the
    `most` best leaves, each way is continued to all predecessors, and the `most` stay whose longest
    completion, known from the first walk, comes first: every other one has as many ways before it.
    Edges that lead into or out of a cycle take no part. length counts edges, or sums their weights
    (not negative, summed from the root); of edges between the same nodes the heaviest counts.
    """
    rows = edges.where("source is not null and target is not null")
    rows = _kept(rows.groupBy("source", "target").agg((F.max(weight) if weight else F.lit(1)).cast("double" if weight else "long").alias("weight")))
    zero = F.lit(0).cast(dict(rows.dtypes)["weight"])
    placed = _placed(rows)
    steps = _kept(rows.join(placed.select(F.col("id").alias("source"), (F.col("level") == 0).alias("first"), F.col("length").alias("upto")), "source"))
    order = [F.desc("total"), F.reverse("path")]
    ways = placed.join(rows.select(F.col("source").alias("id")).distinct(), "id", "left_anti")
    ways = ways.select(F.array("id").alias("path"), F.array_repeat(zero, 0).alias("weights"), F.col("length").alias("total"), zero.alias("behind"), F.lit(False).alias("done"))
    ways = _kept(ways.orderBy(*order).limit(most))
    while not ways.where("not done").isEmpty():
        met = steps.join(F.broadcast(ways.where("not done").drop("done", "total")), F.col("target") == F.element_at("path", 1))  # `most` ways
        behind = F.col("weight") + F.col("behind")
        moved = met.select(F.concat(F.array("source"), "path").alias("path"), F.concat(F.array("weight"), "weights").alias("weights"), (F.col("upto") + behind).alias("total"), behind.alias("behind"), F.col("first").alias("done"))
        ways = _kept(moved.unionByName(ways.where("done")).orderBy(*order).limit(most))
    return ways.select("path", F.aggregate("weights", zero, lambda a, w: a + w).alias("length"))


def paths(edges: DataFrame, start, end, depth: int = 10, most: int | None = None, shortest: bool = False) -> DataFrame:
    """(path, length) of the simple paths from one node to another; with shortest, of the first of the shortest.

    Paths grow by one step at a time from nodes that can still reach the end in what is left of
    `depth`; with `most`, steps end once so many are found, since later ones are longer.
    """
    edges = _clean(edges)
    goal = edges.sparkSession.createDataFrame([(end,)], edges.select(F.col("source").alias("id")).schema)
    near = reach(edges, goal, depth, upstream=True).select(F.col("id").alias("target"), "distance").union(goal.select("id", F.lit(0)))
    edges = cut(edges.join(near, "target"))
    front = edges.sparkSession.createDataFrame([(start, [start])], edges.select(F.col("source").alias("id"), F.array("source").alias("path")).schema)
    found = front.where("false").withColumn("length", F.lit(0))
    for step in range(1, depth + 1):
        front = front.join(edges, F.col("id") == F.col("source")).where(~F.array_contains("path", F.col("target"))).where(F.col("distance") <= depth - step)
        front = front.select(F.col("target").alias("id"), F.array_append("path", F.col("target")).alias("path"))
        if shortest:
            front = front.groupBy("id").agg(F.min("path").alias("path"))
        front = cut(front)
        here = front.where(F.col("id") == end).withColumn("length", F.lit(step))
        found = found.union(here)
        if shortest and not here.isEmpty() or most and found.count() >= most:
            break
        front = front.where(F.col("id") != end)
        if front.isEmpty():
            break
    out = found.select("path", "length")
    return out.orderBy("length", "path").limit(most) if most else out


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that a node is linked with, in either direction."""
    edges = _clean(edges)
    both = edges.union(edges.select("target", "source"))
    ids = both.select(F.col("source").alias("id")).union(nodes.select("id")) if nodes is not None else both.select(F.col("source").alias("id"))
    labels = cut(ids.distinct().withColumn("component", F.col("id")))
    while True:
        low = both.join(labels, F.col("target") == F.col("id")).groupBy("source").agg(F.min("component").alias("low"))
        new = labels.join(low, F.col("id") == F.col("source"), "left").select("id", F.least("component", "low").alias("component"), "component")
        new = new.toDF("id", "component", "old")
        # a node also takes the label of its label, which halves long chains
        hop = new.select(F.col("id").alias("hop_id"), F.col("component").alias("hop"))
        new = cut(new.join(hop, F.col("component") == F.col("hop_id"), "left").select("id", F.least("component", "hop").alias("component"), "old"))
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): the length of the longest way to a node from any root; nodes on or behind a cycle have none."""
    rows = _kept(edges.select("source", "target").where("source is not null and target is not null").distinct().withColumn("weight", F.lit(1)))
    placed = _placed(rows).select("id", "level")
    nodes = rows.select(F.col("source").alias("id")).union(rows.select("target")).distinct()
    return placed.union(nodes.join(placed, "id", "left_anti").withColumn("level", F.lit(None).cast("int")))


def _peeled(rest: DataFrame) -> DataFrame:
    """Edges that lie on a cycle or between cycles: what is left when roots and leaves are peeled off."""
    while True:
        inner = rest.join(rest.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(rest.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
        inner = cut(inner)
        if inner.count() == rest.count():
            return inner
        rest = inner


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, label) after every node has taken the least label of all nodes with a way to it."""
    while True:
        low = edges.join(labels, F.col("source") == F.col("id")).groupBy("target").agg(F.min("label").alias("low"))
        new = cut(labels.join(low, F.col("id") == F.col("target"), "left").select("id", F.least("label", "low").alias("label"), F.col("label").alias("old")))
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node on a cycle: nodes with ways to each other share the least id among them.

    Each node takes the least id that has a way to it; those of one colour that also have a way to
    the colour's own node are a component. They go, and the rest is peeled and coloured again.
    """
    rest, found = _peeled(_clean(edges)), None
    while not rest.isEmpty():
        nodes = rest.select(F.col("source").alias("id")).union(rest.select("target")).distinct()
        colours = _spread(cut(nodes.withColumn("label", F.col("id"))), rest)
        inside = rest.join(colours.toDF("source", "a"), "source").join(colours.toDF("target", "b"), "target").where("a = b")
        inside = cut(inside.select("source", "target"))
        front = cut(colours.where("id = label"))
        seen = front
        while not front.isEmpty():
            near = inside.join(front, F.col("target") == F.col("id")).select(F.col("source").alias("id"), "label").distinct()
            front = cut(near.join(seen.select("id"), "id", "left_anti"))
            seen = cut(seen.union(front))
        found = seen if found is None else cut(found.union(seen))
        gone = seen.select("id")
        left = rest.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
        rest = _peeled(cut(left.select("source", "target")))
    if found is None:
        found = edges.select(F.col("source").alias("id"), F.col("source").alias("label")).where("false")
    here = edges.where("source = target").select(F.col("source").alias("id"))
    sizes = found.groupBy("label").agg(F.count("*").alias("n"))
    # a node by itself is a component only if it leads to itself
    return found.join(sizes, "label").join(here.distinct().withColumn("self", F.lit(True)), "id", "left").where("n > 1 or self").select("id", F.col("label").alias("component"))


def cyclic(edges: DataFrame) -> DataFrame:
    """Edges that lie on a cycle: both ends are in one strong component."""
    of = strong_components(edges)
    return edges.select("source", "target").distinct().join(of.toDF("source", "a"), "source").join(of.toDF("target", "b"), "target").where("a = b").select("source", "target")


def _ends(edges: DataFrame, wanted: str, other: str) -> DataFrame:
    """(id) of every node that is an edge's `wanted` end and no edge's `other` one: one grouping by node, no join."""
    both = edges.select(F.inline(F.array(F.struct(F.col(wanted).alias("id"), F.lit(False).alias("other")), F.struct(F.col(other).alias("id"), F.lit(True).alias("other")))))
    return both.where("id is not null or not other").groupBy("id").agg(F.bool_or("other").alias("other")).where("not other").select("id")


def roots(edges: DataFrame) -> DataFrame:
    return _ends(edges, "source", "target")


def leaves(edges: DataFrame) -> DataFrame:
    return _ends(edges, "target", "source")


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, incoming, outgoing, role): role is isolated, source, sink or inner."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))
    out = nodes.select("id").distinct().join(counted, "id", "left").select("id", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))
    i, o = F.col("incoming") > 0, F.col("outgoing") > 0
    return out.withColumn("role", F.when(~i & ~o, "isolated").when(~i, "source").when(~o, "sink").otherwise("inner"))


def column_origins(mapping: DataFrame, depth: int = 10) -> DataFrame:
    """(dataset, column, origin_dataset, origin_column, hops) of every column, from (dataset, column, from_dataset, from_column)."""
    link = mapping.select(F.struct("dataset", "column").alias("target"), F.struct(F.col("from_dataset").alias("dataset"), F.col("from_column").alias("column")).alias("source"))
    link = cut(link.distinct())
    up = link.select(F.col("target").alias("low"), F.col("source").alias("high"))
    front = link.select("target", "source", F.lit(1).alias("hops"))
    out = None
    for _ in range(depth):
        onward = front.join(up, F.col("source") == F.col("low"), "left")
        done = onward.where("low is null").select("target", "source", "hops")
        out = done if out is None else out.union(done)
        front = cut(onward.where("low is not null").select("target", F.col("high").alias("source"), (F.col("hops") + 1).alias("hops")).distinct())
        if front.isEmpty():
            break
    return out.select("target.*", F.col("source.dataset").alias("origin_dataset"), F.col("source.column").alias("origin_column"), "hops")


def infer_edges(names: DataFrame) -> DataFrame:
    """(source, target, kind) by name: staging_x is copied to x, agg_x and summary_x aggregate x; names: (name)."""
    base = F.regexp_replace("name", "^(staging_|agg_|summary_)", "")
    other = names.select("name", base.alias("base")).where("name <> base").join(names.select(F.col("name").alias("whole")), F.col("base") == F.col("whole"))
    copied = F.col("name").startswith("staging_")
    return other.select(F.when(copied, F.col("name")).otherwise(F.col("base")).alias("source"), F.when(copied, F.col("base")).otherwise(F.col("name")).alias("target"), F.when(copied, "copies").otherwise("aggregates").alias("kind"))


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements of a graph view, a JSON text each."""
    n = nodes.select(F.to_json(F.struct(F.struct(*nodes.columns).alias("data"))).alias("element"))
    return n.union(edges.select(F.to_json(F.struct(F.struct(*edges.columns).alias("data"))).alias("element")))
