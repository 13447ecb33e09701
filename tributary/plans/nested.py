"""Queries on nested records: orders with their lines as JSON documents."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import nested as n
from tributary.operators.schemas import Field
from tributary.session import file_system, scratch, table


def _json(spark, d):
    """An order as JSON text, with holes: no tier for some customers, no lines for some orders, a price that is no number, text that is no JSON."""
    k, part = F.col("o_orderkey"), F.col("l_partkey")
    price = F.when(part % 11 == 0, "n/a").otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("qty"), price.alias("price"), F.struct(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("status")).alias("state"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    customer = F.struct(F.col("o_custkey").alias("key"), F.when(F.col("o_custkey") % 7 != 0, F.substring("o_orderpriority", 1, 1)).alias("tier"))
    order = F.struct(k.alias("id"), customer.alias("customer"), F.when(k % 13 != 0, F.col("lines")).alias("lines"))
    rows = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    return rows.select("o_orderkey", F.when(k % 17 == 0, "{no json").otherwise(F.to_json(order)).alias("doc"))


_NESTED = """o AS (SELECT *, o_orderkey % 17 <> 0 AS good FROM orders), g AS (SELECT * FROM o WHERE good),
    l AS (SELECT l.*, CASE WHEN l_partkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS price, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag
        FROM lineitem l JOIN g ON l_orderkey = o_orderkey WHERE o_orderkey % 13 <> 0),
    v AS (SELECT 'doc' AS path, CASE WHEN good THEN 'object' END AS kind, NULL AS v FROM o UNION ALL SELECT 'doc.id', 'integer', o_orderkey::VARCHAR FROM g UNION ALL SELECT 'doc.customer', 'object', NULL FROM g
        UNION ALL SELECT 'doc.customer.key', 'integer', o_custkey::VARCHAR FROM g UNION ALL SELECT 'doc.customer.tier', CASE WHEN o_custkey % 7 <> 0 THEN 'integer' END, CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority[1] END FROM g
        UNION ALL SELECT 'doc.lines', CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'array' END, NULL FROM g UNION ALL SELECT 'doc.lines[]', 'object', NULL FROM l
        UNION ALL SELECT 'doc.lines[].no', 'integer', l_linenumber::VARCHAR FROM l UNION ALL SELECT 'doc.lines[].qty', 'float', l_quantity::VARCHAR FROM l UNION ALL SELECT 'doc.lines[].price', CASE WHEN price = 'n/a' THEN 'string' ELSE 'float' END, price FROM l
        UNION ALL SELECT 'doc.lines[].state', 'object', NULL FROM l UNION ALL SELECT 'doc.lines[].state.flag', CASE WHEN flag IS NOT NULL THEN 'string' END, flag FROM l UNION ALL SELECT 'doc.lines[].state.status', 'string', l_linestatus FROM l)"""
_KINDS = ("integer", "float", "string", "array", "object")


def _docs(spark, d):
    """The documents as structs: their text is read for its type and once more to be parsed, then it goes."""
    path = scratch(spark)
    _json(spark, d).write.parquet(f"{path}/text")
    docs = n.from_json(spark.read.schema("o_orderkey long, doc string").parquet(f"{path}/text"), "doc").select("doc")
    docs.write.parquet(f"{path}/docs")
    place, files = file_system(spark, f"{path}/text")
    files.delete(place, True)
    return spark.read.schema(docs.schema).parquet(f"{path}/docs")


def nested_profile(spark: SparkSession, d: str) -> DataFrame:
    return n.profile(_docs(spark, d), ["doc"]).select("path", "total", "nulls", *_KINDS, "shortest", "longest", "low", "high")


def nested_schema(spark: SparkSession, d: str) -> DataFrame:
    """The schema that the documents themselves show, a row for each path."""
    found = [astuple(f)[:4] + (f.low, f.high, f.shortest, f.longest) for f in n.infer(_docs(spark, d))]
    return spark.createDataFrame(found, "path string, kind string, required boolean, nullable boolean, low double, high double, shortest int, longest int")


def nested_errors(spark: SparkSession, d: str) -> DataFrame:
    schema = [
        Field("doc", "object", True), Field("doc.id", "integer", True), Field("doc.customer", "object", True), Field("doc.customer.tier", "string", True, values=("1", "2", "3")), Field("doc.lines", "array", True),
        Field("doc.lines[].qty", "float", low=3.0, high=45.0), Field("doc.lines[].price", "float"), Field("doc.lines[].note", "string", True), Field("doc.lines[].state", "object"), Field("doc.lines[].state.flag", "string", True, longest=1, pattern="[A-M]"), Field("doc.customer.key", "string", shortest=2),
    ]
    return n.error_counts(n.errors(_docs(spark, d), schema, extra=False))


QUERIES = {f.__name__: f for f in (nested_profile, nested_schema, nested_errors)}
_PROFILE = f"""WITH {_NESTED}, p AS (SELECT path, count(*) AS total, count(*) FILTER (kind IS NULL) AS nulls, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in _KINDS)}, min(length(v))::INTEGER AS shortest, max(length(v))::INTEGER AS longest,
    min(TRY_CAST(v AS DOUBLE)) FILTER (kind IN ('integer', 'float')) AS low, max(TRY_CAST(v AS DOUBLE)) FILTER (kind IN ('integer', 'float')) AS high FROM v GROUP BY path)"""
ORACLE = {
    "nested_profile": f"{_PROFILE} SELECT * FROM p",
    "nested_schema": f"""{_PROFILE}, k AS (SELECT *, CASE WHEN object > 0 THEN 'object' WHEN "array" > 0 THEN 'array' WHEN integer >= greatest(float, string) THEN 'integer' WHEN float >= string THEN 'float' ELSE 'string' END AS kind FROM p)
        SELECT path, kind, 1 - nulls / total::DOUBLE >= 0.95 AS required, nulls > 0 AS nullable, CASE WHEN kind IN ('integer', 'float') THEN low END AS low, CASE WHEN kind IN ('integer', 'float') THEN high END AS high,
        CASE WHEN kind = 'string' THEN shortest END AS shortest, CASE WHEN kind = 'string' THEN longest END AS longest FROM k""",
    "nested_errors": f"""WITH {_NESTED}, e AS (SELECT 'doc' AS path, 'missing_required' AS error, o_orderkey AS row FROM o WHERE NOT good UNION ALL SELECT 'doc.customer.tier', 'missing_required', o_orderkey FROM g WHERE o_custkey % 7 = 0
        UNION ALL SELECT 'doc.customer.tier', 'not_allowed', o_orderkey FROM g WHERE o_custkey % 7 <> 0 AND o_orderpriority[1] NOT IN ('1', '2', '3') UNION ALL SELECT 'doc.lines', 'missing_required', o_orderkey FROM g WHERE o_orderkey % 13 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
        UNION ALL SELECT 'doc.lines[].qty', 'too_small', l_orderkey FROM l WHERE l_quantity < 3 UNION ALL SELECT 'doc.lines[].qty', 'too_large', l_orderkey FROM l WHERE l_quantity > 45 UNION ALL SELECT 'doc.lines[].price', 'wrong_type', l_orderkey FROM l WHERE price = 'n/a'
        UNION ALL SELECT 'doc.lines[].note', 'missing_required', l_orderkey FROM l UNION ALL SELECT 'doc.lines[].state.flag', 'missing_required', l_orderkey FROM l WHERE flag IS NULL UNION ALL SELECT 'doc.lines[].state.flag', 'wrong_pattern', l_orderkey FROM l WHERE NOT regexp_matches(flag, '^[A-M]')
        UNION ALL SELECT 'doc.customer.key', 'too_short', o_orderkey FROM g WHERE o_custkey < 10 UNION ALL SELECT 'doc.lines[].no', 'unknown_field', l_orderkey FROM l UNION ALL SELECT 'doc.lines[].state.status', 'unknown_field', l_orderkey FROM l)
        SELECT path, error, count(DISTINCT row) AS rows, count(*) AS places FROM e GROUP BY ALL""",
}
