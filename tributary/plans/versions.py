"""Queries on versions: keys that are null or repeat, merge bases and merges, chains of snapshots, longest ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.operators import branches as b
from tributary.operators import changes as c
from tributary.operators import lineage as lin
from tributary.session import scratch, table
from tributary.sources import snapshots as snap


def _odd(spark, d):
    """Documents with a null key, and a key that two rows share, of which the one with the higher n counts."""
    k = F.col("doc_id")
    key = F.when(k == 13, None).when(k % 50 == 25, k - 1).otherwise(k)
    return table(spark, d, "documents").select(key.alias("doc_id"), k.alias("n"), F.md5("text").alias("hash"), "lang")


def _odd_next(rows):
    """Some gone, some edited, some new; what has no key is edited, too."""
    n = F.col("n")
    kept = rows.where(n % 10 != 0).withColumn("lang", F.when((n % 10 == 3) | (n == 25), F.lit("xx")).otherwise(F.col("lang")))
    return kept.unionByName(rows.where(n % 10 == 2).withColumn("doc_id", F.col("doc_id") + 1_000_000_000))


_ODD = """odd AS (SELECT CASE WHEN doc_id = 13 THEN NULL WHEN doc_id % 50 = 25 THEN doc_id - 1 ELSE doc_id END AS doc_id, doc_id AS n, md5(text) AS hash, lang FROM documents),
    next AS (SELECT doc_id, n, hash, CASE WHEN n % 10 = 3 OR n = 25 THEN 'xx' ELSE lang END AS lang FROM odd WHERE n % 10 <> 0 UNION ALL SELECT doc_id + 1000000000, n, hash, lang FROM odd WHERE n % 10 = 2),
    a AS (SELECT * FROM odd QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1), z AS (SELECT * FROM next QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1),
    f AS (SELECT a.n AS an, z.n AS zn, CASE WHEN a.n IS NULL THEN z.doc_id ELSE a.doc_id END AS doc_id, a.lang AS al, z.lang AS zl, a.hash AS ah, z.hash AS zh FROM a FULL JOIN z ON a.doc_id IS NOT DISTINCT FROM z.doc_id)"""


def diff_odd_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _odd(spark, d)
    return c.diff(rows, _odd_next(rows), ["doc_id"], order="n").select("doc_id", "change", F.array_join(F.transform("fields", lambda x: x.field), ",").alias("fields"))


def delta_odd_keys(spark: SparkSession, d: str) -> DataFrame:
    """The delta of two versions, applied to the first."""
    rows = _odd(spark, d)
    old, new = (c.last_by_key(x, ["doc_id"], "n").drop("n") for x in (rows, _odd_next(rows)))
    return c.apply(old, c.delta(_odd(spark, d), _odd_next(rows), ["doc_id"], "n").drop("n"), ["doc_id"]).unionByName(new.where("false"))


def upserted_odd_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _odd(spark, d)
    target = c.last_by_key(rows, ["doc_id"], "n").drop("n").withColumn("_first_seen", F.lit("t1"))
    batch = c.last_by_key(_odd_next(rows), ["doc_id"], "n").drop("n")
    return c.upsert(target, batch, ["doc_id"], F.lit("t2"))


def hash_store_odd_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _odd(spark, d)
    hashed = lambda x: c.last_by_key(x, ["doc_id"], "n").select("doc_id", F.concat_ws("/", "hash", "lang").alias("content_hash"))
    store = hashed(rows).withColumns({"first_seen": F.lit("t1"), "last_seen": F.lit("t1")})
    return c.updated_store(hashed(_odd_next(rows)), store, ["doc_id"], F.lit("t2"))


def _history(spark, d):
    """Each customer's orders as versions: most follow the one before, some an earlier one, some merge two."""
    mine = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = F.row_number().over(mine)
    up = [F.lag("o_orderkey", i).over(mine) for i in (1, 2, 3)]
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version_id"), n.alias("n"), *[u.alias(f"p{i}") for i, u in enumerate(up, 1)])
    parents = F.when(F.col("n") % 5 == 0, F.array("p1", "p2")).when(F.col("n") % 3 == 0, F.array("p2")).when(F.col("n") % 4 == 0, F.array("p1", "p3")).otherwise(F.array("p1"))
    return rows.withColumn("parents", F.array_compact(parents))


def merge_base_versions(spark: SparkSession, d: str) -> DataFrame:
    """The merge bases of every two successive orders of a customer."""
    rows = _history(spark, d)
    pairs = rows.where("p1 is not null").select(F.col("p1").alias("ours"), F.col("version_id").alias("theirs"))
    wide = rows.where("p2 is not null").select(F.col("p2").alias("ours"), F.col("version_id").alias("theirs"))
    return b.merge_bases(rows, pairs.unionByName(wide), "n")


def _sides(spark, d):
    base = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    k = F.col("doc_id")
    ours = base.where(k % 11 != 0).withColumn("lang", F.when(k % 3 == 0, "aa").when(k % 7 == 0, None).otherwise(F.col("lang"))).withColumn("n_chars", F.when(k % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    theirs = base.where(k % 13 != 0).withColumn("lang", F.when(k % 6 == 0, "aa").when(k % 5 == 0, "bb").otherwise(F.col("lang"))).withColumn("source", F.when(k % 4 == 0, "moved").otherwise(F.col("source")))
    fresh = base.where(k % 9 == 0).withColumn("doc_id", -k - 1)
    return base, ours.unionByName(fresh), theirs.unionByName(fresh.where("doc_id % 2 = 0").withColumn("n_chars", F.lit(0).cast("long")))


_SIDES = """base AS (SELECT doc_id, lang, source, n_chars FROM documents),
    ours AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'aa' WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang, source, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM base WHERE doc_id % 11 <> 0
        UNION ALL SELECT -doc_id - 1, lang, source, n_chars FROM base WHERE doc_id % 9 = 0),
    theirs AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'aa' WHEN doc_id % 5 = 0 THEN 'bb' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN 'moved' ELSE source END AS source, n_chars FROM base WHERE doc_id % 13 <> 0
        UNION ALL SELECT -doc_id - 1, lang, source, 0 FROM base WHERE doc_id % 9 = 0 AND (doc_id + 1) % 2 = 0)"""


def merged_versions(spark: SparkSession, d: str) -> DataFrame:
    """A three-way merge of documents in which both sides edit, delete and add."""
    out = b.merged(*_sides(spark, d), ["doc_id"], prefer="theirs")
    return out.withColumn("_conflicts", F.array_join(F.transform("_conflicts", lambda x: x.field), ","))


def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """All conflicts by field, with how often a side deleted the row."""
    rows = b.conflicts(b.merged(*_sides(spark, d), ["doc_id"]), ["doc_id"])
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("ours").isNull()).alias("no_ours"), F.count_if(F.col("theirs").isNull()).alias("no_theirs"), F.count_if(F.col("base").isNull()).alias("no_base"))


def snapshot_restores(spark: SparkSession, d: str) -> DataFrame:
    """Orders in five states, taken as full, incremental, differential and incremental snapshots; two are expired, what is left is restored."""
    path, keys, k = scratch(spark), ["o_orderkey"], F.col("o_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    kinds, made = ("full", "incremental", "differential", "incremental", "full"), []
    for i, kind in enumerate(kinds):
        state = orders.where(k % 7 > i).withColumn("o_orderstatus", F.when(k % 5 < i, F.lit(f"v{i}")).otherwise(F.col("o_orderstatus")))
        made.append(snap.take(state, path, keys, kind, f"2024-01-0{i + 1}"))
    snap.expire(spark, path, "2024-01-04")
    left = snap.manifest(spark, path)
    out = None
    for e in left:
        rows = snap.restore(spark, path, keys, e["id"])
        one = rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers")).withColumn("state", F.lit(made.index(e["id"]))).withColumn("stored", F.lit(e["stored"]))
        out = one if out is None else out.unionByName(one)
    return out


def _links(spark, d):
    """A sparser forest of orders with links across, as edges with a weight."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").where(k > 0)
    up = orders.select(F.floor(k / 3).alias("source"), k.alias("target"), (k % 5).alias("weight"))
    return up.union(orders.where((k % 49 == 0) & (k > 700)).select((k - 650).alias("source"), k.alias("target"), (k % 3 + 2).alias("weight")))


_LINKS = "links AS (SELECT o_orderkey // 3 AS source, o_orderkey AS target, o_orderkey % 5 AS weight FROM orders WHERE o_orderkey > 0 UNION ALL SELECT o_orderkey - 650, o_orderkey, o_orderkey % 3 + 2 FROM orders WHERE o_orderkey % 49 = 0 AND o_orderkey > 700)"


def _told(ways):
    return ways.select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), F.col("length").cast("double").alias("length"))


def critical_paths(spark: SparkSession, d: str) -> DataFrame:
    return _told(lin.critical_paths(_links(spark, d).drop("weight")))


def heaviest_paths(spark: SparkSession, d: str) -> DataFrame:
    return _told(lin.critical_paths(_links(spark, d), 25, "weight"))


def _ways(weight: str, most: int) -> str:
    return f"""WITH RECURSIVE {_LINKS}, e AS (SELECT source, target, max({weight}) AS w FROM links GROUP BY ALL),
        p AS (SELECT DISTINCT source AS id, [source] AS path, 0::DOUBLE AS length FROM e WHERE source NOT IN (SELECT target FROM e) UNION ALL
              SELECT e.target, list_append(p.path, e.target), p.length + e.w FROM p JOIN e ON e.source = p.id)
        SELECT array_to_string(path, '>') AS path, length FROM (SELECT path, length FROM p WHERE id NOT IN (SELECT source FROM e) ORDER BY length DESC, list_reverse(path) LIMIT {most})"""


QUERIES = {f.__name__: f for f in (diff_odd_keys, delta_odd_keys, upserted_odd_keys, hash_store_odd_keys, merge_base_versions, merged_versions, merge_conflicts, snapshot_restores, critical_paths, heaviest_paths)}
_HASH = "{0}h || '/' || {0}l"
# of the three values of a field, and whether a row is there at all
_MERGED = f"""{_SIDES}, k AS (SELECT doc_id FROM base UNION SELECT doc_id FROM ours UNION SELECT doc_id FROM theirs),
    j AS (SELECT k.doc_id, b.doc_id IS NOT NULL AS bh, o.doc_id IS NOT NULL AS oh, t.doc_id IS NOT NULL AS th, b.lang AS bl, o.lang AS ol, t.lang AS tl, b.source AS bs, o.source AS os, t.source AS ts, b.n_chars AS bn, o.n_chars AS xn, t.n_chars AS tn
        FROM k LEFT JOIN base b USING (doc_id) LEFT JOIN ours o USING (doc_id) LEFT JOIN theirs t USING (doc_id)),
    m AS (SELECT *, (oh <> bh OR ol IS DISTINCT FROM bl OR os IS DISTINCT FROM bs OR xn IS DISTINCT FROM bn) AS om, (th <> bh OR tl IS DISTINCT FROM bl OR ts IS DISTINCT FROM bs OR tn IS DISTINCT FROM bn) AS tm,
        oh AND th AND ol IS DISTINCT FROM tl AND ol IS DISTINCT FROM bl AND tl IS DISTINCT FROM bl AS cl, oh AND th AND os IS DISTINCT FROM ts AND os IS DISTINCT FROM bs AND ts IS DISTINCT FROM bs AS cs,
        oh AND th AND xn IS DISTINCT FROM tn AND xn IS DISTINCT FROM bn AND tn IS DISTINCT FROM bn AS cn FROM j),
    r AS (SELECT *, bh AND oh <> th AND CASE WHEN oh THEN om ELSE tm END AS torn FROM m)"""
ORACLE = {
    "diff_odd_keys": f"""WITH {_ODD} SELECT doc_id, CASE WHEN an IS NULL THEN 'added' WHEN zn IS NULL THEN 'deleted' WHEN al IS DISTINCT FROM zl OR ah <> zh THEN 'modified' ELSE 'unchanged' END AS change,
        CASE WHEN an IS NULL OR zn IS NULL THEN '' ELSE concat_ws(',', CASE WHEN ah <> zh THEN 'hash' END, CASE WHEN al IS DISTINCT FROM zl THEN 'lang' END) END AS fields FROM f""",
    "delta_odd_keys": f"WITH {_ODD} SELECT doc_id, hash, lang FROM z",
    "upserted_odd_keys": f"""WITH {_ODD} SELECT doc_id, CASE WHEN zn IS NULL THEN ah ELSE zh END AS hash, CASE WHEN zn IS NULL THEN al ELSE zl END AS lang, CASE WHEN an IS NULL THEN 't2' ELSE 't1' END AS _first_seen,
        CASE WHEN an IS NULL THEN 'inserted' WHEN zn IS NULL THEN 'kept' WHEN al IS DISTINCT FROM zl OR ah <> zh THEN 'updated' ELSE 'same' END AS _outcome FROM f""",
    "hash_store_odd_keys": f"""WITH {_ODD} SELECT doc_id, coalesce({_HASH.format('z')}, {_HASH.format('a')}) AS content_hash, CASE WHEN an IS NULL THEN 't2' ELSE 't1' END AS first_seen,
        CASE WHEN an IS NULL OR zn IS NOT NULL AND (al IS DISTINCT FROM zl OR ah <> zh) THEN 't2' ELSE 't1' END AS last_seen FROM f""",
    "merge_base_versions": """WITH RECURSIVE h AS (SELECT o_custkey, o_orderkey AS id, row_number() OVER w AS n, lag(o_orderkey, 1) OVER w AS p1, lag(o_orderkey, 2) OVER w AS p2, lag(o_orderkey, 3) OVER w AS p3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
        e AS (SELECT DISTINCT id, parent FROM (SELECT id, unnest(CASE WHEN n % 5 = 0 THEN [p1, p2] WHEN n % 3 = 0 THEN [p2] WHEN n % 4 = 0 THEN [p1, p3] ELSE [p1] END) AS parent FROM h) WHERE parent IS NOT NULL),
        anc(id, up) AS (SELECT id, id FROM h UNION SELECT anc.id, e.parent FROM anc JOIN e ON e.id = anc.up),
        pairs AS (SELECT p1 AS ours, id AS theirs FROM h WHERE p1 IS NOT NULL UNION SELECT p2, id FROM h WHERE p2 IS NOT NULL),
        c AS (SELECT ours, theirs, x.up FROM pairs JOIN anc x ON x.id = ours JOIN anc y ON y.id = theirs AND y.up = x.up)
        SELECT ours, theirs, up AS base FROM c WHERE NOT EXISTS (SELECT 1 FROM c o JOIN anc ON anc.id = o.up AND anc.up = c.up WHERE o.ours = c.ours AND o.theirs = c.theirs AND o.up <> c.up)""",
    "merged_versions": f"""WITH {_MERGED} SELECT doc_id, CASE WHEN NOT oh THEN tl WHEN NOT th THEN ol WHEN ol IS NOT DISTINCT FROM bl OR cl THEN tl ELSE ol END AS lang, CASE WHEN NOT oh THEN ts WHEN NOT th THEN os WHEN os IS NOT DISTINCT FROM bs OR cs THEN ts ELSE os END AS source,
        CASE WHEN NOT oh THEN tn WHEN NOT th THEN xn WHEN xn IS NOT DISTINCT FROM bn OR cn THEN tn ELSE xn END AS n_chars, CASE WHEN torn OR cl OR cs OR cn THEN 'conflict' WHEN om AND tm THEN 'both' WHEN om THEN 'ours' WHEN tm THEN 'theirs' ELSE 'same' END AS _merge,
        concat_ws(',', CASE WHEN torn THEN '*' END, CASE WHEN cl THEN 'lang' END, CASE WHEN cs THEN 'source' END, CASE WHEN cn THEN 'n_chars' END) AS _conflicts FROM r WHERE oh AND th OR NOT bh OR torn AND th""",
    "merge_conflicts": f"""WITH {_MERGED}, x AS (SELECT '*' AS field, oh AS o, th AS t, true AS b FROM r WHERE torn UNION ALL SELECT 'lang', ol IS NOT NULL, tl IS NOT NULL, bl IS NOT NULL FROM r WHERE cl
        UNION ALL SELECT 'source', os IS NOT NULL, ts IS NOT NULL, bs IS NOT NULL FROM r WHERE cs UNION ALL SELECT 'n_chars', xn IS NOT NULL, tn IS NOT NULL, bn IS NOT NULL FROM r WHERE cn)
        SELECT field, count(*) AS n, count(*) FILTER (NOT o) AS no_ours, count(*) FILTER (NOT t) AS no_theirs, count(*) FILTER (NOT b) AS no_base FROM x GROUP BY field""",
    # the last incremental one needs the differential one, and that one the first
    "snapshot_restores": """WITH s AS (SELECT i AS state, o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 < i THEN 'v' || i ELSE o_orderstatus END AS o_orderstatus FROM orders, range(0, 5) t(i) WHERE o_orderkey % 7 > i),
        stored AS (SELECT 0 AS state, count(*) AS stored FROM s WHERE state = 0 UNION ALL SELECT 4, count(*) FROM s WHERE state = 4
            UNION ALL SELECT n.state, count(*) FROM (VALUES (2, 0), (3, 2)) n(state, before) JOIN s o ON o.state = n.before LEFT JOIN s x ON x.state = n.state AND x.o_orderkey = o.o_orderkey WHERE x.o_orderstatus IS DISTINCT FROM o.o_orderstatus GROUP BY 1)
        SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS customers, state::INTEGER AS state, any_value(stored)::BIGINT AS stored FROM s JOIN stored USING (state) GROUP BY o_orderstatus, state""",
    "critical_paths": _ways("1", 10),
    "heaviest_paths": _ways("weight", 25),
}
