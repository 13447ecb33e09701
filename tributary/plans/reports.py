"""Queries on quality over time, snapshots, staging, reviews, pipelines, previews and the registry of schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import contracts as c
from tributary.operators import reports as r
from tributary.operators.schemas import loosened
from tributary.plans.checks import _NEXT, _PEOPLE, _people, _shown, _versions
from tributary.plans.common import REVIEWS, RUNS, reviews, runs
from tributary.session import table
from tributary.sources import html


def _validations(spark, d):
    """Events as validations: a score and up to three issues each."""
    k = F.col("event_id")
    issue = lambda test, severity, rule: F.when(test, F.struct(F.lit(severity).alias("severity"), F.concat(F.lit(rule), (k % 4).cast("string")).alias("rule")))
    issues = F.array_compact(F.array(issue(k % 5 == 0, "critical", "c"), issue(k % 3 == 0, "error", "e"), issue(k % 2 == 0, "warning", "w")))
    return table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("created_at"), (k % 100).alias("records"), F.round(F.least(F.col("value"), F.lit(100.0)), 3).alias("score"), issues.alias("issues"))


_VALIDATIONS = """v AS (SELECT user_id, ts, event_id % 100 AS records, round(least(value, 100), 3) AS score, event_id % 5 = 0 AS c, event_id % 3 = 0 AS e, event_id % 2 = 0 AS w, event_id % 4 AS k FROM events)"""


def quality_hours(spark: SparkSession, d: str) -> DataFrame:
    return r.quality_timeline(_validations(spark, d), "hour")


def quality_days(spark: SparkSession, d: str) -> DataFrame:
    return r.quality_timeline(_validations(spark, d), "day", "user_id")


def quality_trends(spark: SparkSession, d: str) -> DataFrame:
    return r.quality_trend(_validations(spark, d), "user_id", 5).withColumn("top_rules", F.array_join("top_rules", ","))


def snapshot_statistics(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("o_orderkey"), F.round("o_totalprice").cast("long")
    status = F.when(k % 3 == 0, "active").when(k % 3 == 1, "archived").otherwise("deleted")
    kind = F.when(k % 4 == 0, "full").when(k % 4 == 1, "differential").otherwise("incremental")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), status.alias("status"), kind.alias("kind"), size.alias("original"), F.floor(size / 2).alias("stored"), (k % 9).alias("records"))
    return r.snapshot_statistics(rows, "source")


def staging_statistics(spark: SparkSession, d: str) -> DataFrame:
    status = lambda k: F.when(F.col(k) % 4 == 0, "pending").when(F.col(k) % 4 == 1, "promoted").when(F.col(k) % 4 == 2, "rolled_back").otherwise("rejected").alias("_review_status")
    of = {"staging_news": ("documents", "doc_id"), "staging_orders": ("orders", "o_orderkey"), "staging_parts": ("part", "p_partkey")}
    tables = {name: table(spark, d, t).select(status(k)) for name, (t, k) in of.items()}
    return r.staging_statistics(tables | {"staging_none": table(spark, d, "region").select(F.lit("rejected").alias("_review_status"))})


def review_details(spark: SparkSession, d: str) -> DataFrame:
    """Reviews with their source (some are gone) and result."""
    rows = reviews(spark, d).withColumn("result_id", F.col("review_id")).select("review_id", "source_id", "result_id", "status")
    sources = table(spark, d, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("documents")).where("source_id <> 'src3'")
    results = table(spark, d, "documents").where("doc_id % 6 <> 0").select(F.col("doc_id").alias("result_id"), "lang", "n_chars")
    done = r.review_details(rows, sources, results)
    return done.select("review_id", "source_id", "status", "source.documents", "result.lang", "result.n_chars")


def pipeline_status(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.when(F.col("source_id") % 6 != 0, "active").alias("status"))
    sessions = users.select("source_id", F.concat(F.lit("h"), F.col("source_id").cast("string")).alias("session_id"), F.when(F.col("source_id") % 4 == 0, "diagnosing").otherwise("done").alias("status"))
    return r.pipeline_status(users, runs(spark, d), sessions)


def crawl_previews(spark: SparkSession, d: str) -> DataFrame:
    """What a test crawl of each page would show."""
    fields = [{"name": "item", "selector": "li"}, {"name": "link", "selector": "a", "attr": "href"}, {"name": "charset", "selector": "meta", "attr": "charset"}, {"name": "price", "selector": ".price"}]
    rows = html.extract_lists(table(spark, d, "pages"), "page_id", "html", fields)
    return r.preview(rows, "page_id", [f["name"] for f in fields], 4).withColumn("warnings", F.array_join("warnings", ","))


def schema_registrations(spark: SparkSession, d: str) -> DataFrame:
    """A registry after two deliveries' schemas: one again, one that is refused, one in another mode, one deprecated, and one brought in from its own export."""
    old, new = _versions(spark, d)
    none = spark.createDataFrame([], r.REGISTRY)
    one, _ = r.register(none, "people", old, "t1")
    same, _ = r.register(one, "people", old, "t2")
    refused, problems = r.register(same, "people", new, "t3")
    both, _ = r.register(refused, "people", new, "t4", "none")
    gone = r.deprecated(both, "people", 2, "wrong")
    line = r.exported(gone.where("version = 2")).first()["document"]
    done, _ = r.imported(gone, "copy", line, "t5")
    more, _ = r.register(done, "people", loosened(old), "t6")  # the newest active one
    return r.registered_sources(more).withColumn("problems", F.lit(len(problems)))


def contract_skips(spark: SparkSession, d: str) -> DataFrame:
    """A contract of which some expectations ask for columns that are not there."""
    contract = [c.not_null("name", 0.5), c.in_range("age", 0, 120), c.unique("nick"), c.match_regex("mail", "email", 0.5, severity="warning"), c.pair_equal("name", "alias"), c.row_count_between(1)]
    return c.measure_all(_people(spark, d), contract).withColumnRenamed("column", "of").drop("ratio")


QUERIES = {f.__name__: f for f in (quality_hours, quality_days, quality_trends, snapshot_statistics, staging_statistics, review_details, pipeline_status, crawl_previews, schema_registrations, contract_skips)}


def _timeline(form: str, by: str = "") -> str:
    return f"""WITH {_VALIDATIONS} SELECT {by} strftime(ts, '{form}') AS bucket, count(*) AS validations, sum(records)::BIGINT AS records, round(sum(CAST(score AS DECIMAL(24,6)))::DOUBLE / count(*), 1) AS avg_score, round(min(score), 1) AS min_score, round(max(score), 1) AS max_score,
        sum(c::INT + e::INT + w::INT)::BIGINT AS issues, count(*) FILTER (c) AS critical, count(*) FILTER (e) AS error, count(*) FILTER (w) AS warning, count(*) FILTER (NOT c AND NOT e AND NOT w) AS clean FROM v GROUP BY ALL"""


ORACLE = {
    "quality_hours": _timeline("%Y-%m-%d %H:00"),
    "quality_days": _timeline("%Y-%m-%d", "user_id,"),
    "quality_trends": f"""WITH {_VALIDATIONS}, i AS (SELECT user_id, 'c' || k AS rule FROM v WHERE c UNION ALL SELECT user_id, 'e' || k FROM v WHERE e UNION ALL SELECT user_id, 'w' || k FROM v WHERE w),
        n AS (SELECT user_id, rule, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, rule) AS place FROM i GROUP BY user_id, rule), t AS (SELECT user_id, string_agg(rule || ':' || n, ',' ORDER BY place) AS top_rules FROM n WHERE place <= 5 GROUP BY user_id)
        SELECT user_id, round(sum(CAST(score AS DECIMAL(24,6)))::DOUBLE / count(*), 4) AS avg_score, min(score) AS min_score, max(score) AS max_score, count(*) AS validations, sum(c::INT + e::INT + w::INT)::BIGINT AS issues, coalesce(any_value(top_rules), '') AS top_rules FROM v LEFT JOIN t USING (user_id) GROUP BY user_id""",
    "snapshot_statistics": """WITH s AS (SELECT o_orderpriority AS source, ['active', 'archived', 'deleted'][o_orderkey % 3 + 1] AS status, ['full', 'differential', 'incremental', 'incremental'][o_orderkey % 4 + 1] AS kind, CAST(round(o_totalprice) AS BIGINT) AS original, o_orderkey % 9 AS records FROM orders),
        k AS (SELECT source, status, string_agg(kind || ':' || n, ',' ORDER BY kind) AS by_kind FROM (SELECT source, status, kind, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL)
        SELECT source, status, count(*) AS snapshots, sum(original)::BIGINT AS original, sum(original // 2)::BIGINT AS stored, sum(records)::BIGINT AS records, CASE WHEN status = 'active' THEN any_value(by_kind) ELSE '' END AS by_kind,
        CASE WHEN status <> 'deleted' THEN round((sum(original) - sum(original // 2)) * 100.0::DOUBLE / sum(original), 2) END AS saved FROM s JOIN k USING (source, status) GROUP BY source, status""",
    "staging_statistics": """WITH s AS (SELECT 'staging_news' AS collection, doc_id % 4 AS k FROM documents UNION ALL SELECT 'staging_orders', o_orderkey % 4 FROM orders UNION ALL SELECT 'staging_parts', p_partkey % 4 FROM part), e AS (SELECT * FROM s UNION ALL SELECT 'total', k FROM s)
        SELECT collection, count(*) FILTER (k = 0) AS pending, count(*) FILTER (k = 1) AS promoted, count(*) FILTER (k = 2) AS rolled_back FROM e GROUP BY collection""",
    "review_details": f"""WITH {REVIEWS}, s AS (SELECT source AS source_id, count(*) AS documents FROM documents WHERE source <> 'src3' GROUP BY 1) SELECT review_id, source_id, status, documents, lang, n_chars FROM reviews LEFT JOIN s USING (source_id) LEFT JOIN (SELECT * FROM documents WHERE doc_id % 6 <> 0) ON doc_id = review_id""",
    "pipeline_status": f"""WITH {RUNS}, t AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) <= 10)
        SELECT source_id, CASE WHEN source_id % 4 = 0 THEN 'healing' WHEN source_id % 6 <> 0 THEN 'active' ELSE 'unknown' END AS status, round(count(*) FILTER (status = 'success') * 100.0 / count(*), 1)::DOUBLE AS success_rate, floor(sum(CAST(ms AS DECIMAL(24,6)))::DOUBLE / count(*))::BIGINT AS mean_ms,
        CASE WHEN source_id % 4 = 0 THEN 'h' || source_id END AS session_id FROM t GROUP BY source_id""",
    "crawl_previews": """WITH l AS (SELECT page_id, len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>')) AS n FROM pages)
        SELECT page_id, greatest(n, 1)::BIGINT AS total_found, least(greatest(n, 1), 4)::BIGINT AS shown, n::BIGINT AS item_found, (greatest(n, 1) - n)::BIGINT AS item_empty, n::BIGINT AS link_found, (greatest(n, 1) - n)::BIGINT AS link_empty, 1::BIGINT AS charset_found, (greatest(n, 1) - 1)::BIGINT AS charset_empty,
        0::BIGINT AS price_found, greatest(n, 1)::BIGINT AS price_empty, concat_ws(',', CASE WHEN n > 2 THEN 'charset: mostly empty' END, 'price: never found') AS warnings FROM l""",
    "schema_registrations": f"""WITH {_PEOPLE}, {_NEXT}, a AS ({_shown("people", "id name balance mail since segment code")}), z AS ({_shown("next", "id name balance since segment code level")}),
        p AS (SELECT count(*) FILTER (z.required AND NOT a.required) + count(*) FILTER (a.nullable AND NOT z.nullable) + count(*) FILTER (a.kind = 'float' AND z.kind = 'integer') AS n FROM a JOIN z USING (field)), q AS (SELECT count(*) AS n FROM z ANTI JOIN a USING (field) WHERE required)
        SELECT source_id, versions::BIGINT AS versions, newest::INTEGER AS newest, active::INTEGER AS active, first_at, last_at, (p.n + q.n)::INTEGER AS problems FROM (VALUES ('people', 2, 2, 1, 't1', 't4'), ('copy', 1, 1, 1, 't5', 't5')) v(source_id, versions, newest, active, first_at, last_at), p, q""",
    "contract_skips": f"""WITH {_PEOPLE}, n AS (SELECT count(*) AS n, count(*) FILTER (name IS NULL) AS a, count(*) FILTER (mail NOT LIKE '%@%') AS m FROM people)
        SELECT 0::INTEGER AS id, 'not_null' AS expectation, 'name' AS of, 'info' AS severity, n AS elements, a AS unexpected, true AS success, 'passed' AS status FROM n UNION ALL SELECT 1, 'in_range', 'age', 'error', 0, 0, false, 'skipped' UNION ALL SELECT 2, 'unique', 'nick', 'warning', 0, 0, false, 'skipped'
        UNION ALL SELECT 3, 'match_regex', 'mail', 'info', n, m, true, 'passed' FROM n UNION ALL SELECT 4, 'pair_equal', 'name,alias', 'error', 0, 0, false, 'skipped' UNION ALL SELECT 5, 'row_count_between', '', 'info', n, 0, true, 'passed' FROM n""",
}
