"""Merkle manifest of a table: a hash for every row, a root for them all, and proofs that can be checked.

A row's leaf is the digest of its fields, each written as its length and value. The leaves of a
group (a language) ascend by doc_id; eight consecutive nodes become one until one is left, the
group's subroot, and the subroots, ordered by group, become the root in the same way.

A place in a group is found without a global sort. doc_id is written as hexadecimal digits; a
histogram of its first digits gives the count of every cell, cells with more than CELL rows get
a histogram of their next digits, and so on. Sums of a parent's earlier children (a window over
at most 16^STEP rows), added from the top down, give where each cell begins; inside a cell a
window of at most CELL keys gives the rest. Places written in base 8 are the keys of the trie:
the longest prefixes are reduced first, and each reduction is a grouping of eight rows, an
eighth of the one before. Siblings go down again from the root, one join a level, in which a
run of eight stands for its rows, so a row itself is never joined.

Defined results: null ids come first in their group and are left untampered; rows with one
doc_id stand in the order of their leaves, equal rows have a place each (their count is carried,
and spread out in blocks when places are known); a null group is its own and comes first; null
fields are written `-`; an empty table has no rows; other columns, whatever their names, take
no part.
"""

from __future__ import annotations

from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.store import documents, materialize

FANOUT = 8
#: hexadecimal digits of a step of the histogram
STEP = 3
#: keys of a cell that are put in order by one window
CELL = 4_096
#: copies of a row that are spread out by one task at a time
BLOCK = 65_536
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _written(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, in their order; `changed` replaces some."""
    return digest(*[_written(changed.get(name, F.col(name))) for name in FIELDS])


def _by_bytes(text: Column) -> Column:
    """A string whose order is that of the UTF-8 bytes, nulls first."""
    return F.when(text.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.lower(F.hex(text.cast("binary")))))


def _by_number(number: Column) -> Column:
    digits = F.lower(F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.when(number.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), digits))


def ranked(rows: DataFrame, cell: int = CELL, step: int = STEP) -> DataFrame:
    """rows (g, k, n, ...): distinct keys k of a group g, n copies each. Adds `start`, the copies before in the group, and `leaves`, those of the group."""
    low, high = rows.agg(F.min("k"), F.max("k")).first()
    skip = len(list(takewhile(lambda pair: pair[0] == pair[1], zip(low or "", high or "", strict=False))))
    cut = lambda depth: F.substring("k", skip + 1, depth)
    pending, parents, sizes, depth, found = rows, None, None, 0, []
    while True:
        depth += step
        above = F.substring("cell", 1, depth - step)
        cells = pending.groupBy("g", cut(depth).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("keys"))
        earlier = Window.partitionBy("g", "parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("parent", above).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        if parents is not None:
            placed = placed.join(parents, ["g", "parent"]).withColumn("start", F.col("start") + F.col("base"))
        placed = materialize(placed.select("g", "cell", "keys", "n", "start"))
        if sizes is None:
            sizes = placed.groupBy("g").agg(F.sum("n").alias("leaves"))
        large = placed.where(F.col("keys") > cell)
        small = placed.where(F.col("keys") <= cell).join(sizes, "g").select("g", "cell", F.col("start").alias("base"), "leaves")
        found.append(pending.withColumn("cell", cut(depth)).join(small, ["g", "cell"]))
        if large.isEmpty():
            break
        pending = pending.withColumn("cell", cut(depth)).join(large.select("g", "cell"), ["g", "cell"], "left_semi").drop("cell")
        parents = large.select("g", F.col("cell").alias("parent"), F.col("start").alias("base"))
    inside = Window.partitionBy("g", "cell").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("cell", "base", "k")


def _spread(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each of a key's n copies, with its place i."""
    rows = materialize(rows)
    one = rows.where("n = 1").withColumn("i", F.col("start"))
    parts = rows.where("n > 1").withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})"))).repartition("g", "start", "part")
    first = f"start + part * {block}"
    many = parts.withColumn("i", F.explode(F.expr(f"sequence({first}, least({first} + {block}, start + n) - 1)"))).drop("part")
    return one.unionByName(many).drop("n", "start")


def trie(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """leaves (g, leaves, i, h, p): places, digests and anything else of a row. The runs of every level, and each group's root (g, h).

    A run (g, i, left, items, h) holds up to eight nodes (i, h, p) of the `left` nodes of its level.
    """
    most = leaves.agg(F.max("leaves")).first()[0] or 0
    nodes, levels = leaves.withColumnRenamed("leaves", "left"), []
    while True:
        run = nodes.groupBy("g", "left", F.expr(f"i div {FANOUT}").alias("r")).agg(F.array_sort(F.collect_list(F.struct("i", "h", "p"))).alias("items"))
        joined = F.sha2(F.array_join(F.transform("items", lambda x: x["h"]), ""), 256)
        levels.append(materialize(run.select("g", F.col("r").alias("i"), "left", "items", F.when(F.col("left") > 1, joined).otherwise(F.col("items")[0]["h"]).alias("h"))))
        if most <= FANOUT:
            break
        most = -(-most // FANOUT)
        nodes = levels[-1].where(F.col("left") > FANOUT).select("g", F.expr(f"(left + {FANOUT - 1}) div {FANOUT}").alias("left"), "i", "h", F.lit(None).cast("int").alias("p"))
    tops = levels[0].where(F.col("left") <= FANOUT).select("g", "h")
    for level in levels[1:]:
        tops = tops.unionByName(level.where(F.col("left") <= FANOUT).select("g", "h"))
    return levels, tops


def descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tops (g, path, ...) of every group's root. Each leaf (g, h, p) with its path, the siblings on both sides from its own level up, and the other columns of its top."""
    also = [c for c in tops.columns if c not in ("g", "path")]
    below = None
    for level in reversed(levels):
        here = level.where(F.col("left") <= FANOUT).join(tops, "g")
        if below is not None:
            here = here.unionByName(level.where(F.col("left") > FANOUT).join(below.drop("h", "p"), ["g", "i"]))
        each = here.select("g", "left", "path", *also, F.transform("items", lambda x: x["h"]).alias("hs"), F.posexplode("items").alias("at", "item"))
        side = lambda first, n: F.array_join(F.slice("hs", first, n), "")
        step = F.array(F.struct(side(F.lit(1), F.col("at")).alias("before"), side(F.col("at") + 2, F.lit(FANOUT)).alias("after")))
        path = F.when(F.col("left") > 1, F.concat(step, F.col("path"))).otherwise(F.col("path"))
        below = each.select("g", F.col("item.i").alias("i"), F.col("item.h").alias("h"), F.col("item.p").alias("p"), path.alias("path"), *also)
    return below.drop("i")


def manifest(docs: DataFrame, group: str = "lang", tampered: Column | None = None, cell: int = CELL) -> DataFrame:
    """doc_id, leaf, group's subroot, root, path and `shown` of every row: the leaf of the row whose text is `tampered`, where that is not null."""
    changed = F.lit(None) if tampered is None else F.when(tampered.isNotNull(), leaf(text=tampered))
    rows = docs.select(_by_bytes(F.col(group)).alias("g"), _by_number(F.col("doc_id")).alias("id"), "doc_id", leaf().alias("h"), changed.alias("changed"))
    row = F.struct("doc_id", F.coalesce("changed", "h").alias("shown"))
    keyed = rows.groupBy("g", F.concat("id", "h").alias("k"), "h", row.alias("p")).agg(F.count("*").alias("n"))
    levels, subroots = trie(_spread(ranked(materialize(keyed), cell)))
    groups = subroots.select(F.lit("").alias("g"), F.col("g").alias("k"), "h", F.struct(F.col("g").alias("group")).alias("p"), F.lit(1).cast("long").alias("n"))
    upper, root = trie(_spread(ranked(materialize(groups), cell)))
    tops = descended(upper, root.select("g", F.col("h").alias("root"), F.array().cast(PATH).alias("path")))
    leaves = descended(levels, tops.select(F.col("p.group").alias("g"), "path", "root", F.col("h").alias("subroot")))
    return leaves.select("p.doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", "p.shown")


def folded(path: str | Column, start: str | Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, F.col(start) if isinstance(start, str) else start, lambda h, s: digest(s["before"], h, s["after"]))


def lowered_thirds(docs: DataFrame) -> Column:
    """The text with A-Z lower-cased where 3 divides the CRC-32 of the decimal doc_id, else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = manifest(docs, "lang", lowered_thirds(docs))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded("path", "shown").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(name: str, value: str | None = None) -> str:
    value = value or name
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value}::VARCHAR)) || ':' || {value} END"


_CRC = "list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"
_LEAF = "sha256(" + " || ".join(_field(f) for f in FIELDS) + ")"
_SHOWN = "sha256(" + " || ".join(_field(f, f"translate(text, '{UPPER}', '{LOWER}')" if f == "text" else None) for f in FIELDS) + ")"


def _oracle() -> str:
    # two recursions of one form: nodes of every level by group, then each leaf's way up, one level at a time
    def nodes(name: str, source: str) -> str:
        return f"""{name}(g, i, h, n, lvl) AS (SELECT g, i, h, n, 0 FROM {source} UNION ALL
            SELECT g, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8, lvl + 1 FROM {name} WHERE n > 1 GROUP BY g, i // 8, n, lvl)"""

    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {_LEAF} AS h, CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 THEN {_SHOWN} ELSE {_LEAF} END AS shown FROM documents),
    a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
    {nodes("t", "a")},
    s AS (SELECT '' AS g, g AS item, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
    {nodes("u", "s")},
    every AS (SELECT g, i, h, n, lvl FROM t UNION ALL SELECT '/', i, h, n, lvl + 1000 FROM u),
    starts AS (SELECT a.doc_id, a.g, a.h AS leaf, a.shown, a.i, s.h AS subroot, s.i AS place, (SELECT max(lvl) FROM t WHERE t.g = a.g) AS top, row_number() OVER () AS row FROM a JOIN s ON s.item = a.g),
    w(row, g, lvl, i, h, above) AS (
        SELECT row, g, 0, i, shown, '' FROM starts UNION ALL
        SELECT w.row, w.g, w.lvl + 1, w.i // 8, sha256(string_agg(CASE WHEN e.i = w.i THEN w.h ELSE e.h END, '' ORDER BY e.i)), w.above || coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (WHERE e.i <> w.i), '')
        FROM w JOIN every e ON e.g = w.g AND e.lvl = w.lvl AND e.i // 8 = w.i // 8 AND e.n > 1 GROUP BY w.row, w.g, w.lvl, w.i, w.h, w.above),
    v(row, lvl, i, h, above) AS (
        SELECT w.row, 1000, st.place, w.h, w.above FROM w JOIN starts st ON st.row = w.row AND st.top = w.lvl UNION ALL
        SELECT v.row, v.lvl + 1, v.i // 8, sha256(string_agg(CASE WHEN e.i = v.i THEN v.h ELSE e.h END, '' ORDER BY e.i)), v.above || coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (WHERE e.i <> v.i), '')
        FROM v JOIN every e ON e.g = '/' AND e.lvl = v.lvl AND e.i // 8 = v.i // 8 AND e.n > 1 GROUP BY v.row, v.lvl, v.i, v.h, v.above)
    SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(above) AS proof_sha256, v.h AS folded_root, v.h = (SELECT h FROM u WHERE n = 1) AS verified
    FROM v JOIN starts USING (row) WHERE v.lvl = 1000 + (SELECT max(lvl) FROM u)"""


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE = {"op11_merkle_manifest": _oracle()}
