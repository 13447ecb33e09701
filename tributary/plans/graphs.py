"""Queries on the catalog of parts and on the lineage of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import catalog as cat
from tributary.operators import lineage as lin
from tributary.session import table


def _sets(spark, d):
    """Parts as data sets."""
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(
        k.alias("id"),
        F.concat_ws("_", words).alias("name"),
        F.col("p_name").alias("display_name"),
        F.concat(F.lit("all about "), F.col("p_brand")).alias("description"),
        F.col("p_brand").alias("domain"),
        (k % 3).cast("string").alias("subdomain"),
        F.col("p_type").alias("dataset_type"),
        F.when(k % 4 == 0, "deprecated").otherwise("active").alias("status"),
        F.array_distinct(F.concat(words, F.array(F.concat(F.lit("size"), (F.col("p_size") % 5).cast("string"))))).alias("tags"),
        F.array(
            F.struct(F.lit("id").alias("name"), F.lit(None).cast("string").alias("description")),
            F.struct(F.concat(F.lit("col_"), F.element_at(words, 1)).alias("name"), F.concat(F.lit("the "), F.element_at(words, -1)).alias("description")),
            F.struct(F.concat(F.lit("c"), (k % 7).cast("string")).alias("name"), F.lit("").alias("description")),
        ).alias("columns"),
        F.when(k % 10 != 9, (k % 101).cast("double")).alias("score"),
    )


_SETS = """sets AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, p_name AS display_name, 'all about ' || p_brand AS description, p_brand AS domain, (p_partkey % 3)::VARCHAR AS subdomain, p_type AS dataset_type,
    CASE WHEN p_partkey % 4 = 0 THEN 'deprecated' ELSE 'active' END AS status, list_distinct(list_concat(string_split(p_name, ' '), ['size' || (p_size % 5)])) AS tags,
    ['id', 'col_' || string_split(p_name, ' ')[1], 'c' || (p_partkey % 7)] AS names, 'the ' || string_split(p_name, ' ')[-1] AS about, CASE WHEN p_partkey % 10 <> 9 THEN (p_partkey % 101)::DOUBLE END AS score FROM part)"""


def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    return cat.search(_sets(spark, d), "red", 5, 40, statuses=["active"], low=10.0).select("id", "relevance")


def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    return cat.filtered(_sets(spark, d), types=["ECONOMY", "STANDARD"], tags=["red", "size1"], every_tag=True, high=90.0).select("id")


def catalog_facets(spark: SparkSession, d: str) -> DataFrame:
    return cat.facets(cat.matching(_sets(spark, d), "red"))


def similar_sets(spark: SparkSession, d: str) -> DataFrame:
    return cat.similar(_sets(spark, d), 7, 20)


def column_search(spark: SparkSession, d: str) -> DataFrame:
    return cat.column_search(_sets(spark, d), "red", 30).select("id", "dataset", "name", "points")


def completions(spark: SparkSession, d: str) -> DataFrame:
    return cat.complete(_sets(spark, d), "re", 12)


def catalog_statistics(spark: SparkSession, d: str) -> DataFrame:
    return cat.statistics(_sets(spark, d))


def popular_queries(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "part").select(F.upper(F.substring_index("p_name", " ", 1)).alias("query"), (F.col("p_size") % 3).alias("results"))
    return cat.popular(log, 5, empty=True)


def _edges(spark, d):
    """A forest of orders, each under a smaller one, with some links across."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").where(k > 0)
    up = orders.select(F.floor(k / 3).alias("source"), k.alias("target"))
    return up.union(orders.where((k % 7 == 0) & (k > 700)).select((k - 650).alias("source"), k.alias("target")))


_EDGES = "edges AS (SELECT o_orderkey // 3 AS source, o_orderkey AS target FROM orders WHERE o_orderkey > 0 UNION SELECT o_orderkey - 650, o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey > 700)"


def _start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def lineage_downstream(spark: SparkSession, d: str) -> DataFrame:
    return lin.reach(_edges(spark, d), _start(spark, 40), 5)


def lineage_upstream(spark: SparkSession, d: str) -> DataFrame:
    return lin.reach(_edges(spark, d), _start(spark, 9_800), 10, upstream=True)


def impact(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "report").otherwise("table").alias("type"))
    return lin.impact(_edges(spark, d), _start(spark, 40), types, depth=4)


def impact_levels(spark: SparkSession, d: str) -> DataFrame:
    return impact(spark, d).groupBy("type", "distance", "level").agg(F.count("*").alias("n"))


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return lin.paths(_edges(spark, d), 1, 9_800, 12, shortest=True).select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), "length")


def all_paths(spark: SparkSession, d: str) -> DataFrame:
    return lin.paths(_edges(spark, d), 40, 9_800, 12).select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), "length")


def linked_parts(spark: SparkSession, d: str) -> DataFrame:
    """Components of parts that are linked by a modular rule, with their sizes."""
    k = F.col("p_partkey")
    edges = table(spark, d, "part").where(k % 5 > 0).select(k.alias("source"), (k - k % 5).alias("target"))
    return lin.components(edges).groupBy("component").agg(F.count("*").alias("n"))


def order_levels(spark: SparkSession, d: str) -> DataFrame:
    return lin.levels(_edges(spark, d)).groupBy("level").agg(F.count("*").alias("n"))


def node_roles(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return lin.degrees(_edges(spark, d).distinct(), nodes).groupBy("role").agg(F.count("*").alias("n"), F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))


def roots_and_leaves(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return lin.roots(edges).withColumn("kind", F.lit("root")).union(lin.leaves(edges).withColumn("kind", F.lit("leaf")))


def cycles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    ring = table(spark, d, "nation").select(k.cast("long").alias("source"), F.when(k % 5 == 4, k - 4).otherwise(k + 1).cast("long").alias("target")).where("source < 20")
    tail = table(spark, d, "nation").where(k >= 20).select(k.cast("long").alias("source"), (k - 20).cast("long").alias("target"))
    bridge = table(spark, d, "nation").where(k % 5 == 2).where(k < 15).select(k.cast("long").alias("source"), (k + 5).cast("long").alias("target"))
    return lin.cyclic(ring.union(tail).union(bridge))


def inferred_edges(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.explode(F.array(F.col("n_name"), F.concat(F.lit("staging_"), "n_name"), F.concat(F.lit("agg_"), "n_name"))).alias("name"))
    return lin.infer_edges(names)


def column_origins(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").where(k > 0)
    mapping = rows.select(F.concat(F.lit("t"), k.cast("string")).alias("dataset"), F.lit("c").alias("column"), F.concat(F.lit("t"), F.floor(k / 4).cast("string")).alias("from_dataset"), F.lit("c").alias("from_column"))
    return lin.column_origins(mapping)


QUERIES = {
    f.__name__: f
    for f in (
        catalog_search, catalog_filter, catalog_facets, similar_sets, column_search, completions, catalog_statistics, popular_queries, lineage_downstream, lineage_upstream, impact_levels, shortest_path, all_paths,
        linked_parts, order_levels, node_roles, roots_and_leaves, cycles, inferred_edges, column_origins,
    )
}
_MATCH = "(contains(lower(name), 'red') OR contains(lower(display_name), 'red') OR contains(lower(description), 'red') OR contains(lower(domain), 'red') OR len(list_filter(tags, lambda x: contains(x, 'red'))) > 0 OR len(list_filter(names, lambda x: contains(x, 'red'))) > 0 OR contains(about, 'red'))"
_WALK = "WITH RECURSIVE {edges}, w AS (SELECT {start} AS id, 0 AS distance UNION SELECT {next}, distance + 1 FROM w JOIN edges ON {prev} = w.id WHERE distance < {depth})"
_DOWN = _WALK.format(edges=_EDGES, start="40::BIGINT", next="target", prev="source", depth="{depth}")
_PATHS = f"WITH RECURSIVE {_EDGES}, w AS (SELECT {{start}}::BIGINT AS id, [{{start}}::BIGINT] AS path UNION ALL SELECT target, list_append(path, target) FROM w JOIN edges ON source = w.id WHERE NOT list_contains(path, target) AND target <= 9800 AND w.id <> 9800 AND len(path) <= 12)"
ORACLE = {
    "catalog_search": f"""WITH {_SETS} SELECT id, round(CASE WHEN contains(lower(name), 'red') THEN 3.0 ELSE 0 END + CASE WHEN lower(name) = 'red' THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(display_name), 'red') THEN 2.5 ELSE 0 END
        + CASE WHEN contains(lower(description), 'red') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(domain), 'red') THEN 0.5 ELSE 0 END + len(list_filter(tags, lambda x: contains(x, 'red'))) * 0.8 + len(list_filter(names, lambda x: contains(x, 'red'))) * 1.0
        + CASE WHEN contains(about, 'red') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(name || ' ' || display_name || ' ' || description), 'red') THEN 0.3 ELSE 0 END, 4)::DOUBLE AS relevance
        FROM sets WHERE status = 'active' AND score >= 10 AND {_MATCH} ORDER BY relevance DESC, id LIMIT 40 OFFSET 5""",
    "catalog_filter": f"WITH {_SETS} SELECT id FROM sets WHERE dataset_type IN ('ECONOMY', 'STANDARD') AND list_has_all(tags, ['red', 'size1']) AND score <= 90",
    "catalog_facets": f"""WITH {_SETS}, m AS (SELECT * FROM sets WHERE {_MATCH}), f AS (SELECT 'type' AS facet, dataset_type AS value FROM m UNION ALL SELECT 'status', status FROM m UNION ALL SELECT 'domain', domain FROM m UNION ALL SELECT 'tag', unnest(tags) FROM m
        UNION ALL SELECT 'score', CASE WHEN score >= 95 THEN '95' WHEN score >= 85 THEN '85' WHEN score >= 70 THEN '70' WHEN score >= 50 THEN '50' WHEN score >= 0 THEN '0' ELSE 'unknown' END FROM m),
        c AS (SELECT facet, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY facet, value), g AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS p FROM c)
        SELECT facet, value, n FROM g WHERE p <= CASE facet WHEN 'domain' THEN 10 WHEN 'tag' THEN 15 ELSE 1000000 END""",
    "similar_sets": f"""WITH {_SETS}, t AS (SELECT * FROM sets WHERE id = 7), s AS (SELECT s.id, s.name, CASE WHEN s.domain = t.domain THEN 30 ELSE 0 END + CASE WHEN s.subdomain = t.subdomain THEN 10 ELSE 0 END + CASE WHEN s.dataset_type = t.dataset_type THEN 15 ELSE 0 END
        + least(len(list_intersect(s.tags, t.tags)) * 5, 20) + least(len(list_intersect(s.names, t.names)) * 3, 25) AS points FROM sets s, t WHERE s.id <> 7 AND (s.domain = t.domain OR list_has_any(s.tags, t.tags)))
        SELECT id, name, points::INTEGER AS points FROM s ORDER BY points DESC, id LIMIT 20""",
    "column_search": f"""WITH {_SETS}, c AS (SELECT id, name AS dataset, unnest([names[1], names[2], names[3]]) AS col, unnest([NULL, about, '']) AS description FROM sets),
        p AS (SELECT id, dataset, col AS name, (CASE WHEN lower(col) = 'red' THEN 2.0 WHEN contains(lower(col), 'red') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(description), 'red') THEN 0.5 ELSE 0 END)::DOUBLE AS points FROM c)
        SELECT * FROM p WHERE points > 0 ORDER BY points DESC, id, name LIMIT 30""",
    "completions": f"""WITH {_SETS}, x AS (SELECT name AS text, 'dataset' AS kind FROM sets UNION ALL SELECT domain, 'domain' FROM sets UNION ALL SELECT unnest(tags), 'tag' FROM sets UNION ALL SELECT unnest(names), 'column' FROM sets),
        o AS (SELECT lower(text) AS low, kind, min(text) AS text FROM x WHERE contains(lower(text), 're') GROUP BY ALL) SELECT text, kind FROM o ORDER BY NOT starts_with(low, 're'), length(text), text, kind LIMIT 12""",
    "catalog_statistics": f"WITH {_SETS} SELECT dataset_type, count(*) AS n, (count(*) * 3)::BIGINT AS columns, count(*)::BIGINT AS documented, round(avg(score) FILTER (score > 0), 4) AS mean_score FROM sets GROUP BY 1",
    "popular_queries": "SELECT lower(split_part(p_name, ' ', 1)) AS query, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY 1 ORDER BY n DESC, query LIMIT 5",
    "lineage_downstream": _DOWN.format(depth=5) + " SELECT id, min(distance) AS distance FROM w GROUP BY id HAVING min(distance) > 0",
    "lineage_upstream": _WALK.format(edges=_EDGES, start="9800::BIGINT", next="source", prev="target", depth=10) + " SELECT id, min(distance) AS distance FROM w GROUP BY id HAVING min(distance) > 0",
    "impact_levels": _DOWN.format(depth=4)
    + """, m AS (SELECT id, min(distance) AS distance FROM w GROUP BY id HAVING min(distance) > 0),
        l AS (SELECT CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderstatus = 'P' THEN 'report' ELSE 'table' END AS type, distance, CASE WHEN distance = 1 THEN 3 WHEN distance <= 3 THEN 2 ELSE 1 END + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS v FROM m LEFT JOIN orders ON o_orderkey = id)
        SELECT type, distance, ['low', 'medium', 'high', 'critical'][least(v, 4)] AS level, count(*) AS n FROM l GROUP BY ALL""",
    "shortest_path": _PATHS.format(start=1) + " SELECT array_to_string(path, '>') AS path, len(path)::INTEGER - 1 AS length FROM w WHERE id = 9800 ORDER BY len(path), path LIMIT 1",
    "all_paths": _PATHS.format(start=40) + " SELECT array_to_string(path, '>') AS path, len(path)::INTEGER - 1 AS length FROM w WHERE id = 9800",
    "linked_parts": "SELECT p_partkey - p_partkey % 5 AS component, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "order_levels": f"""WITH RECURSIVE {_EDGES}, n AS (SELECT source AS id FROM edges UNION SELECT target FROM edges), r AS (SELECT id FROM n WHERE id NOT IN (SELECT target FROM edges)),
        w AS (SELECT id, 0 AS level FROM r UNION SELECT target, level + 1 FROM w JOIN edges ON source = id), m AS (SELECT id, max(level) AS level FROM w GROUP BY id) SELECT level, count(*) AS n FROM m GROUP BY level""",
    "node_roles": f"""WITH {_EDGES}, d AS (SELECT o_orderkey AS id, (SELECT count(*) FROM edges WHERE target = o_orderkey) AS i, (SELECT count(*) FROM edges WHERE source = o_orderkey) AS o FROM orders)
        SELECT CASE WHEN i = 0 AND o = 0 THEN 'isolated' WHEN i = 0 THEN 'source' WHEN o = 0 THEN 'sink' ELSE 'inner' END AS role, count(*) AS n, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing FROM d GROUP BY 1""",
    "roots_and_leaves": f"WITH {_EDGES} SELECT DISTINCT source AS id, 'root' AS kind FROM edges WHERE source NOT IN (SELECT target FROM edges) UNION ALL SELECT DISTINCT target, 'leaf' FROM edges WHERE target NOT IN (SELECT source FROM edges)",
    "cycles": "SELECT n_nationkey::BIGINT AS source, (CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 4 ELSE n_nationkey + 1 END)::BIGINT AS target FROM nation WHERE n_nationkey < 20",
    "inferred_edges": "SELECT 'staging_' || n_name AS source, n_name AS target, 'copies' AS kind FROM nation UNION ALL SELECT n_name, 'agg_' || n_name, 'aggregates' FROM nation",
    "column_origins": """WITH RECURSIVE w AS (SELECT s_suppkey AS id, s_suppkey // 4 AS up, 1 AS hops FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT id, up // 4, hops + 1 FROM w WHERE up > 0)
        SELECT 't' || id AS dataset, 'c' AS "column", 't0' AS origin_dataset, 'c' AS origin_column, hops::INTEGER AS hops FROM w WHERE up = 0""",
}
