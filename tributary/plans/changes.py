"""Queries on duplicates, changes, diffs, versions and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import text as t
from tributary.operators import changes as c
from tributary.operators import dedup as dd
from tributary.session import table

_STAMP = "2024-01-31"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _second(docs):
    """Version two: a tenth gone, a tenth edited, a tenth new."""
    k, top = F.col("doc_id") % 10, 1_000_000_000
    kept = docs.where(k != 0).withColumn("text", F.when(k == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))).withColumn("lang", F.when(k == 3, F.lit(None)).otherwise(F.col("lang")))
    return kept.unionByName(docs.where(k == 2).withColumn("doc_id", F.col("doc_id") + top))


_SECOND = """docs AS (SELECT doc_id, text, lang, source FROM documents),
    second AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN text || ' edited' ELSE text END AS text, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE lang END AS lang, source FROM docs WHERE doc_id % 10 <> 0
        UNION ALL SELECT doc_id + 1000000000, text, lang, source FROM docs WHERE doc_id % 10 = 2)"""


def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return dd.exact(_docs(spark, d), "doc_id").select("doc_id", "_duplicate")


def dedup_key(spark: SparkSession, d: str) -> DataFrame:
    """The last order of each customer and priority stays."""
    return dd.by_key(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", "last").where("not _duplicate").select("o_orderkey")


def dedup_hash(spark: SparkSession, d: str) -> DataFrame:
    return dd.by_hash(_docs(spark, d), ["text", "lang"], "doc_id", case=False).groupBy("_duplicate").agg(F.count("*").alias("n"))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return dd.groups(_docs(spark, d).withColumn("hash", F.md5("text")), ["hash"], "doc_id")


def dedup_composite(spark: SparkSession, d: str) -> DataFrame:
    steps = [("exact", lambda r: dd.exact(r, "doc_id")), ("hash", lambda r: dd.by_hash(r, ["text"], "doc_id", case=False)), ("key", lambda r: dd.by_key(r, ["source", "lang", "size"], "doc_id"))]
    rows = _docs(spark, d).withColumn("size", F.length("text"))
    return dd.composite(rows, steps, "doc_id").groupBy("_reason").agg(F.count("*").alias("n"))


def merged_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("largest"))
    return dd.merge(rows, ["o_custkey"], "o_orderkey", {"o_orderstatus": "concat", "priority": "last", "largest": "max"})


def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of part names whose pairs of letters agree for four fifths."""
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return dd.similar_pairs(names, "p_partkey", "p_name", 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    return dd.fuzzy(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", 0.5).groupBy("_duplicate").agg(F.count("*").alias("n"))


def _hashed(docs):
    return docs.select("source", F.col("doc_id").alias("record_id"), t.field_hash(text=F.col("text"), lang=F.col("lang")).alias("content_hash"))


def change_detection(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return c.detect(_hashed(_second(docs)), _hashed(docs), ["source", "record_id"]).groupBy("source", "_change").agg(F.count("*").alias("n"))


def deleted_records(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return c.deleted(_hashed(_second(docs)), _hashed(docs), ["source", "record_id"]).select("source", "record_id", "content_hash")


def hash_store(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    store = _hashed(docs).withColumns({"first_seen": F.lit("2024-01-01"), "last_seen": F.lit("2024-01-01")})
    return c.updated_store(_hashed(_second(docs)), store, ["source", "record_id"], F.lit(_STAMP)).groupBy("first_seen", "last_seen").agg(F.count("*").alias("n"))


def diff_records(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return c.diff(docs, _second(docs), ["doc_id"]).select("doc_id", "change", F.array_join(F.transform("fields", lambda x: F.concat(x.field, F.lit(":"), x.change)), ",").alias("fields"))


def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return c.summary(c.diff(docs, _second(docs), ["doc_id"]))


def diff_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return c.field_counts(c.diff(docs, _second(docs), ["doc_id"]))


def _moved(docs: DataFrame) -> DataFrame:
    """docs with a new key for every second one."""
    return docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 1, F.col("doc_id") + 2_000_000_000).otherwise(F.col("doc_id")))


def diff_warnings(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return c.warnings(c.summary(c.diff(docs, _moved(_second(docs)), ["doc_id"])))


def applied_delta(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    done = c.apply(docs, c.delta(docs, _second(docs), ["doc_id"]), ["doc_id"])
    return done.select("doc_id", F.md5("text").alias("hash"), "lang", "source")


def version_chain(spark: SparkSession, d: str) -> DataFrame:
    """A base and two deltas, materialised at once."""
    docs = _docs(spark, d)
    second = _second(docs)
    third = second.where("doc_id % 10 <> 4").withColumn("source", F.when(F.col("doc_id") % 10 == 5, "moved").otherwise(F.col("source")))
    done = c.materialized(docs, [c.delta(docs, second, ["doc_id"]), c.delta(second, third, ["doc_id"])], ["doc_id"])
    return done.select("doc_id", F.md5("text").alias("hash"), "lang", "source")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    done = c.upsert(docs.withColumn("_first_seen", F.lit("2024-01-01")), _second(docs), ["doc_id"], F.lit(_STAMP))
    return done.groupBy("_outcome", "_first_seen").agg(F.count("*").alias("n"))


def promoted(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending")
    staging = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", status.alias("_review_status"))
    k = F.col("o_orderkey")
    fixes = table(spark, d, "orders").where(k % 5 == 0).select("o_orderkey", F.lit("o_orderpriority").alias("field"), F.lit("1-URGENT").alias("value"))
    fixes = fixes.unionByName(table(spark, d, "orders").where(k % 10 == 0).select("o_orderkey", F.lit("o_totalprice").alias("field"), F.lit("1.5").alias("value")))
    return c.promote(staging, fixes, "o_orderkey").withColumn("corrected", F.array_join("corrected", ","))


def rolled_back(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return c.rollback(orders, orders.where("o_orderstatus = 'P'"), "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def storage_savings(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 4 == 0, "full").when(F.col("o_orderkey") % 4 == 1, "delta").otherwise("snapshot")
    size = F.round("o_totalprice").cast("long")
    versions = table(spark, d, "orders").select(kind.alias("kind"), F.lit(1).cast("long").alias("records"), size.alias("original_bytes"), F.floor(size / (F.col("o_orderkey") % 3 + 1)).alias("stored_bytes"))
    return c.savings(versions)


QUERIES = {
    f.__name__: f
    for f in (
        dedup_exact, dedup_key, dedup_hash, duplicate_groups, dedup_composite, merged_orders, similar_names, fuzzy_names, change_detection, deleted_records, hash_store, diff_records, diff_summary, diff_fields,
        diff_warnings, applied_delta, version_chain, upserted, promoted, rolled_back, storage_savings,
    )
}
_CHANGES = f"""WITH {_SECOND}, pairs AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id AS ai, b.doc_id AS bi, a.text AS ta, b.text AS tb, a.lang AS al, b.lang AS bl FROM docs a FULL JOIN second b ON a.doc_id = b.doc_id),
    ch AS (SELECT doc_id, ai, bi, CASE WHEN ai IS NULL THEN 'added' WHEN bi IS NULL THEN 'deleted' WHEN tb <> ta OR bl IS DISTINCT FROM al THEN 'modified' ELSE 'unchanged' END AS change,
        CASE WHEN ai IS NULL OR bi IS NULL THEN '' ELSE concat_ws(',', CASE WHEN ta <> tb THEN 'text:modified' END, CASE WHEN bl IS DISTINCT FROM al THEN 'lang:deleted' END) END AS fields FROM pairs)"""
_HASHED = "md5(concat_ws('|', 'lang:' || lang, 'text:' || text))"
_GRAMS = """g AS (SELECT p_partkey, p_name, list_sort(list_distinct([substr(lower(p_name), i, 2) FOR i IN range(1, length(p_name))])) AS s FROM {})"""
ORACLE = {
    "dedup_exact": "SELECT doc_id, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) > 1 AS _duplicate FROM documents",
    "dedup_key": "SELECT max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderpriority",
    "dedup_hash": "SELECT n > 1 AS _duplicate, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY lower(text), lower(lang) ORDER BY doc_id) AS n FROM documents) GROUP BY 1",
    "duplicate_groups": 'SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS "first", max(doc_id) AS "last" FROM documents GROUP BY text HAVING count(*) > 1',
    "dedup_composite": """WITH r AS (SELECT row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS b, row_number() OVER (PARTITION BY source, lang, length(text) ORDER BY doc_id) AS k FROM documents)
        SELECT CASE WHEN a > 1 THEN 'exact' WHEN b > 1 THEN 'hash' WHEN k > 1 THEN 'key' END AS _reason, count(*) AS n FROM r GROUP BY 1""",
    "merged_orders": """SELECT o_custkey, string_agg(o_orderstatus, '; ' ORDER BY o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS priority, max(o_orderkey) AS largest, count(*) AS _merged FROM orders GROUP BY o_custkey""",
    "similar_names": f"""WITH n AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name), {_GRAMS.format('n')},
        u AS (SELECT min(p_partkey) AS k, s FROM g GROUP BY s), p AS (SELECT x.k AS a, y.k AS b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS t FROM u x JOIN u y ON x.k < y.k)
        SELECT a, b, round(i / (t - i)::DOUBLE, 6) AS similarity FROM p WHERE i / (t - i)::DOUBLE >= 0.5""",
    "fuzzy_names": f"""WITH {_GRAMS.format('part')}, u AS (SELECT min(p_partkey) AS k, s FROM g GROUP BY s),
        l AS (SELECT DISTINCT y.k FROM u x JOIN u y ON x.k < y.k WHERE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::DOUBLE >= 0.5)
        SELECT u.k <> p_partkey OR l.k IS NOT NULL AS _duplicate, count(*) AS n FROM g JOIN u USING (s) LEFT JOIN l ON l.k = u.k GROUP BY 1""",
    "change_detection": f"""WITH {_SECOND}, x AS (SELECT b.source, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN a.text = b.text AND a.lang IS NOT DISTINCT FROM b.lang THEN 'unchanged' ELSE 'modified' END AS _change FROM second b LEFT JOIN docs a ON a.doc_id = b.doc_id)
        SELECT source, _change, count(*) AS n FROM x GROUP BY ALL""",
    "deleted_records": f"SELECT source, doc_id AS record_id, {_HASHED} AS content_hash FROM documents WHERE doc_id % 10 = 0",
    "hash_store": f"""WITH {_SECOND}, x AS (SELECT CASE WHEN a.doc_id IS NULL THEN '2024-01-31' ELSE '2024-01-01' END AS first_seen,
        CASE WHEN a.doc_id IS NULL OR b.doc_id IS NOT NULL AND (a.text <> b.text OR a.lang IS DISTINCT FROM b.lang) THEN '2024-01-31' ELSE '2024-01-01' END AS last_seen FROM docs a FULL JOIN second b ON a.doc_id = b.doc_id)
        SELECT first_seen, last_seen, count(*) AS n FROM x GROUP BY ALL""",
    "diff_records": f"{_CHANGES} SELECT doc_id, change, fields FROM ch",
    "diff_summary": f"""{_CHANGES}, k AS (SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged FROM ch)
        SELECT *, added + deleted + modified AS total_changes, deleted + modified + unchanged AS "before", added + modified + unchanged AS "after", round((added + deleted + modified) * 100.0::DOUBLE / greatest(deleted + modified + unchanged, added + modified + unchanged), 2) AS change_rate FROM k""",
    "diff_fields": f"{_CHANGES}, f AS (SELECT unnest(string_split(fields, ',')) AS f FROM ch WHERE change = 'modified') SELECT split_part(f, ':', 1) AS field, split_part(f, ':', 2) AS change, count(*) AS n FROM f GROUP BY ALL",
    "diff_warnings": f"""WITH {_SECOND}, a AS (SELECT * FROM docs), b AS (SELECT * REPLACE (CASE WHEN doc_id % 2 = 1 THEN doc_id + 2000000000 ELSE doc_id END AS doc_id) FROM second),
        k AS (SELECT count(*) FILTER (a.doc_id IS NULL) AS added, count(*) FILTER (b.doc_id IS NULL) AS deleted, count(*) FILTER (a.text <> b.text OR a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.lang IS DISTINCT FROM b.lang) AS modified, greatest(count(a.doc_id), count(b.doc_id))::DOUBLE AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id),
        s AS (SELECT 'many_total_changes' AS warning, (added + deleted + modified) / n AS share, 0.5 AS bound FROM k UNION ALL SELECT 'many_deleted', deleted / n, 0.3 FROM k UNION ALL SELECT 'many_added', added / n, 0.8 FROM k)
        SELECT warning, round(share, 4) AS share FROM s WHERE share > bound""",
    "applied_delta": f"WITH {_SECOND} SELECT doc_id, md5(text) AS hash, lang, source FROM second",
    "version_chain": f"WITH {_SECOND} SELECT doc_id, md5(text) AS hash, lang, CASE WHEN doc_id % 10 = 5 THEN 'moved' ELSE source END AS source FROM second WHERE doc_id % 10 <> 4",
    "upserted": f"""{_CHANGES} SELECT CASE change WHEN 'added' THEN 'inserted' WHEN 'deleted' THEN 'kept' WHEN 'modified' THEN 'updated' ELSE 'same' END AS _outcome, CASE change WHEN 'added' THEN '2024-01-31' ELSE '2024-01-01' END AS _first_seen, count(*) AS n FROM ch GROUP BY ALL""",
    "promoted": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 10 = 0 THEN 1.5 ELSE o_totalprice END::DOUBLE AS o_totalprice,
        CASE WHEN o_orderkey % 10 = 0 THEN 'o_orderpriority,o_totalprice' WHEN o_orderkey % 5 = 0 THEN 'o_orderpriority' ELSE '' END AS corrected FROM orders WHERE o_orderstatus = 'F'""",
    "rolled_back": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "storage_savings": """WITH v AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'delta' ELSE 'snapshot' END AS kind, CAST(round(o_totalprice) AS BIGINT) AS b, o_orderkey % 3 + 1 AS k FROM orders)
        SELECT kind, count(*) AS versions, count(*)::BIGINT AS records, sum(b)::BIGINT AS original_bytes, sum(b // k)::BIGINT AS stored_bytes, round((sum(b) - sum(b // k)) * 100.0::DOUBLE / sum(b), 2) AS saved FROM v GROUP BY kind""",
}
