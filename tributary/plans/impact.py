"""Queries on what a change of schema reaches, and on what data sets depend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import impact as im
from tributary.plans.checks import _SCHEMAS, _versions
from tributary.plans.graphs import _EDGES, _edges
from tributary.session import table

#: columns of the customers' delivery, by their place in each order's data set
_PLACES = ("balance", "code", "id", "level", "mail", "name", "segment", "since")
_FROM = 40


def _columns(spark, d):
    """Eight columns for every order as a data set; a column's id is eight times the order's and its place."""
    kind = F.when(F.col("o_orderstatus") == "P", "report").otherwise("table")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("data_set"), kind.alias("kind"), F.explode(F.array(*[F.lit(i) for i in range(8)])).alias("place")).select((F.col("data_set") * 8 + F.col("place")).alias("id"), "data_set", "kind")


def _column_edges(spark, d):
    """Each column feeds the one at the next place in every data set that its own feeds, and the one at its own place in every third."""
    places = F.explode(F.array(*[F.lit(i) for i in range(8)]))
    edges = _edges(spark, d).select("source", "target", places.alias("place"))
    moved = edges.select((F.col("source") * 8 + F.col("place")).alias("source"), (F.col("target") * 8 + (F.col("place") + 1) % 8).alias("target"))
    return moved.unionByName(edges.where("target % 3 = 0").select((F.col("source") * 8 + F.col("place")).alias("source"), (F.col("target") * 8 + F.col("place")).alias("target")))


def schema_change_impact(spark: SparkSession, d: str) -> DataFrame:
    """All columns that the next delivery's changes of schema reach, from one data set on."""
    found = [(_FROM * 8 + _PLACES.index(name), change, breaking) for name, change, breaking, _ in im.schema_changes(*_versions(spark, d))]
    changes = spark.createDataFrame(found, "id long, change string, breaking boolean")  # a row for each column that differs
    out = im.schema_impact(changes, _column_edges(spark, d), _columns(spark, d), 6)
    return out.withColumn("changes", F.array_join("changes", ","))


def dependency_report(spark: SparkSession, d: str) -> DataFrame:
    """What every order as a data set is made of and used by, up to four steps away."""
    return im.dependencies(_edges(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 4)


QUERIES = {f.__name__: f for f in (schema_change_impact, dependency_report)}
_PLACE = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(_PLACES))
ORACLE = {
    "schema_change_impact": f"""WITH RECURSIVE {_SCHEMAS}, {_EDGES}, p AS (SELECT unnest(range(0, 8)) AS place), e AS (SELECT source * 8 + place AS source, target * 8 + (place + 1) % 8 AS target FROM edges, p UNION SELECT source * 8 + place, target * 8 + place FROM edges, p WHERE target % 3 = 0),
        ch AS (SELECT {_FROM} * 8 + CASE field {_PLACE} END AS id, kind, field IN (SELECT field FROM breaks) AS breaking FROM differ),
        w(origin, id, distance) AS (SELECT id, id, 0 FROM ch WHERE kind <> 'added' UNION SELECT origin, e.target, distance + 1 FROM w JOIN e ON e.source = w.id WHERE distance < 6),
        f AS (SELECT origin, id, min(distance) AS distance FROM w GROUP BY ALL HAVING min(distance) > 0),
        x AS (SELECT f.id, o_orderkey AS data_set, CASE WHEN o_orderstatus = 'P' THEN 'report' WHEN o_orderkey IS NOT NULL THEN 'table' END AS kind, distance, ch.kind AS change, breaking, origin FROM f JOIN ch ON ch.id = f.origin LEFT JOIN orders ON o_orderkey = f.id // 8)
        SELECT id, data_set, kind, min(distance)::INTEGER AS distance, ['low', 'medium', 'high', 'critical'][max(least(4, CASE WHEN distance = 1 THEN 3 WHEN distance <= 3 THEN 2 ELSE 1 END + CASE WHEN kind = 'report' THEN 1 ELSE 0 END + CASE WHEN change = 'removed' THEN 1 ELSE 0 END))] AS level,
        bool_or(breaking) AS breaking, array_to_string(list_sort(list(DISTINCT change || ':' || origin)), ',') AS changes FROM x GROUP BY id, data_set, kind""",
    "dependency_report": f"""WITH RECURSIVE {_EDGES}, up(origin, id, distance) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders UNION SELECT origin, source, distance + 1 FROM up JOIN edges ON target = id WHERE distance < 4),
        down(origin, id, distance) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders UNION SELECT origin, target, distance + 1 FROM down JOIN edges ON source = id WHERE distance < 4),
        u AS (SELECT origin, id, min(distance) AS distance FROM up GROUP BY ALL HAVING min(distance) > 0), w AS (SELECT origin, id, min(distance) AS distance FROM down GROUP BY ALL HAVING min(distance) > 0),
        a AS (SELECT origin, count(*) FILTER (distance = 1) AS direct_sources, count(*) AS all_sources, max(distance) AS far_sources FROM u GROUP BY origin), b AS (SELECT origin, count(*) FILTER (distance = 1) AS direct_users, count(*) AS all_users, max(distance) AS far_users FROM w GROUP BY origin),
        o AS (SELECT source AS origin, count(*) AS "only" FROM (SELECT target, max(source) AS source FROM edges GROUP BY target HAVING count(*) = 1) GROUP BY source)
        SELECT o_orderkey AS id, coalesce(direct_sources, 0) AS direct_sources, coalesce(all_sources, 0) AS all_sources, coalesce(far_sources, 0)::INTEGER AS far_sources, coalesce(direct_users, 0) AS direct_users, coalesce(all_users, 0) AS all_users, coalesce(far_users, 0)::INTEGER AS far_users, coalesce("only", 0) AS "only"
        FROM orders LEFT JOIN a ON a.origin = o_orderkey LEFT JOIN b ON b.origin = o_orderkey LEFT JOIN o ON o.origin = o_orderkey""",
}
