"""Queries over raw news, financial and exchange rows: cleaning, typing, scoring and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import text as t
from tributary.operators import transform
from tributary.plans.common import NEWS, as_of, news
from tributary.session import table

_WS = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


def _clean(name: str) -> str:
    return rf"regexp_replace(regexp_replace(replace(regexp_replace(nfc_normalize({name}), '{_WS}+', ' ', 'g'), chr(8203), ''), '^{_WS}+', ''), '{_WS}+$', '')"


def _dated(spark, d):
    day = F.date_format(F.date_add(F.lit("2023-12-01").cast("date"), (F.col("doc_id") % 60).cast("int")), "yyyy.MM.dd")
    stamp = F.when(F.col("doc_id") % 3 == 0, day).when(F.col("doc_id") % 3 == 1, F.concat((F.col("doc_id") % 20).cast("string"), F.lit("시간 전"))).otherwise("no date")
    return news(spark, d).select("doc_id", "title", "content", stamp.alias("date"), F.concat(F.lit(" //example.org/"), F.col("doc_id").cast("string")).alias("link"))


def news_transform(spark: SparkSession, d: str) -> DataFrame:
    done = transform.routed(transform.transform(_dated(spark, d), "news_article", as_of(), F.col("doc_id")))
    return done.select(
        "doc_id",
        F.md5("title").alias("title_md5"),
        "title_length",
        "content_length",
        F.length("summary").alias("summary_length"),
        "url",
        "content_hash",
        "_data_date",
        F.round("_quality_score", 4).alias("quality_score"),
        "_quality_level",
        "_outcome",
    )


_NEWS_SQL = rf"""
    WITH {NEWS},
    c AS (SELECT doc_id, {_clean('title')} AS title, {_clean('content')} AS content, 'https://example.org/' || doc_id AS url,
        CASE doc_id % 3 WHEN 0 THEN CAST(DATE '2023-12-01' + CAST(doc_id % 60 AS INTEGER) AS TIMESTAMP)
             WHEN 1 THEN TIMESTAMP '2024-01-31' - to_hours(CAST(doc_id % 20 AS INTEGER)) END AS moment FROM news),
    s AS (SELECT *, 1.0::DOUBLE - CASE WHEN title = '' THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN content = '' THEN 0.2::DOUBLE ELSE 0 END
        - CASE WHEN title = '' THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN moment IS NULL THEN 0.2::DOUBLE ELSE 0 END AS q FROM c)
    SELECT doc_id, md5(nullif(title, '')) AS title_md5, length(title)::INTEGER AS title_length, length(content)::INTEGER AS content_length,
        nullif(CASE WHEN length(content) > 200 THEN 203 ELSE length(content) END, 0)::INTEGER AS summary_length, url,
        md5(concat_ws('|', nullif(title, ''), url)) AS content_hash, strftime(coalesce(moment, TIMESTAMP '2024-01-31'), '%Y-%m-%d') AS _data_date,
        round(q, 4) AS quality_score, CASE WHEN q >= 0.8 THEN 'high' WHEN q >= 0.6 THEN 'medium' WHEN q >= 0.4 THEN 'low' ELSE 'invalid' END AS _quality_level,
        CASE WHEN q >= 0.7 THEN 'loaded' ELSE 'rejected' END AS _outcome
    FROM s"""


def financial_transform(spark: SparkSession, d: str) -> DataFrame:
    sign = F.element_at(F.array(F.lit("▲"), F.lit("▼"), F.lit("+"), F.lit("-"), F.lit("")), (F.col("p_partkey") % 5 + 1).cast("int"))
    cents = F.col("p_retailprice").cast("decimal(18,2)")
    raw = table(spark, d, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.concat(F.lit("₩"), F.format_number(cents, 2)).alias("price"),
        F.concat(sign, F.col("p_size").cast("string"), F.lit("원")).alias("change"),
        F.concat((F.col("p_size") * 2).cast("string"), F.lit("만")).alias("volume"),
        F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("code"),
        F.lit("2024-01-15T10:30:00").alias("date"),
    )
    done = transform.transform(raw, "financial_data", as_of(), F.col("p_partkey"))
    return done.select("p_partkey", "price", "change", "change_rate", "volume", "stock_code", F.date_format("trade_date", "yyyy-MM-dd HH:mm:ss").alias("trade_date"), "_quality_level")


_FINANCIAL_SQL = """
    WITH p AS (SELECT p_partkey, p_retailprice AS price, p_size * CASE p_partkey % 5 WHEN 1 THEN -1 WHEN 3 THEN -1 ELSE 1 END::DOUBLE AS change,
        p_size * 20000.0::DOUBLE AS volume FROM part)
    SELECT p_partkey, price, change, CASE WHEN price - change <> 0 AND change <> 0 THEN round(change / (price - change) * 100, 2) END AS change_rate, volume,
        CASE WHEN length(p_partkey::VARCHAR) < 6 THEN lpad(p_partkey::VARCHAR, 6, '0') ELSE p_partkey::VARCHAR END AS stock_code,
        '2024-01-15 00:00:00' AS trade_date, 'high' AS _quality_level FROM p"""


def exchange_transform(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "nation").select(
        "n_nationkey",
        F.concat(F.lower("n_name"), F.lit(" 100")).alias("currency"),
        F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(",300.5")).alias("base_rate"),
        F.when(F.col("n_nationkey") % 4 != 0, "1.2.3").otherwise("$ 7_000").alias("buy_rate"),
    )
    done = transform.transform(raw, "exchange_rate", as_of(), F.col("n_nationkey"))
    return done.select("n_nationkey", "currency_code", "base_rate", "buy_rate", "_quality_level")


def number_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form of number that the parser knows, over the suppliers' balances."""
    plain = F.abs(F.col("s_acctbal")).cast("decimal(12,2)").cast("string")
    forms = F.array(
        plain, F.concat(F.lit("▼"), plain), F.concat(plain, F.lit("%")), F.concat(F.lit("3억 "), F.lit("5만")), F.concat(F.lit("약 "), plain, F.lit("원")), F.lit(""), F.lit("-"), F.lit("nan"), F.lit("1e3")
    )
    rows = table(spark, d, "supplier").select("s_suppkey", F.posexplode(forms).alias("form", "raw"))
    return rows.select("s_suppkey", "form", t.parse_number(F.col("raw")).alias("number"))


_NUMBER_SQL = """
    WITH s AS (SELECT s_suppkey, abs(CAST(s_acctbal AS DECIMAL(12,2)))::DOUBLE AS x FROM supplier)
    SELECT s_suppkey, form::INTEGER AS form, CASE form WHEN 0 THEN x WHEN 1 THEN -x WHEN 2 THEN x WHEN 3 THEN 300000000.0 WHEN 4 THEN x WHEN 8 THEN 1000.0 END::DOUBLE AS number
    FROM s, range(0, 9) r(form)"""


def date_forms(spark: SparkSession, d: str) -> DataFrame:
    forms = ["2024년 1월 5일 9:05", "2024.1.5", "2024-01-15T10:30:00Z", "2024-1-5 9:05:07", "01/15/2024", "14:30", "방금", "어제", "3일 전", "2024-02-30", "20240115", "soon", " 2시간 전 "]
    rows = table(spark, d, "region").select("r_regionkey", F.posexplode(F.array(*map(F.lit, forms))).alias("form", "raw"))
    at = F.timestamp_add("DAY", F.col("r_regionkey"), as_of())
    return rows.select("r_regionkey", "form", F.date_format(t.parse_date(F.col("raw"), at), "yyyy-MM-dd HH:mm:ss").alias("moment"))


_DATE_SQL = """
    WITH r AS (SELECT r_regionkey, TIMESTAMP '2024-01-31' + to_days(r_regionkey) AS t FROM region),
    f AS (SELECT r_regionkey, form, CASE form WHEN 0 THEN TIMESTAMP '2024-01-05 09:05:00' WHEN 1 THEN TIMESTAMP '2024-01-05' WHEN 2 THEN TIMESTAMP '2024-01-15'
        WHEN 3 THEN TIMESTAMP '2024-01-05 09:05:07' WHEN 5 THEN date_trunc('day', t) + to_minutes(870) WHEN 6 THEN t WHEN 7 THEN date_trunc('day', t) - to_days(1)
        WHEN 8 THEN t - to_days(3) WHEN 10 THEN TIMESTAMP '2024-01-15' WHEN 12 THEN t - to_hours(2) END AS moment FROM r, range(0, 13) x(form))
    SELECT r_regionkey, form::INTEGER AS form, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment FROM f"""


def etl_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Counts and mean score of loaded and rejected news rows, as one summary."""
    done = transform.routed(transform.transform(_dated(spark, d), "news_article", as_of(), F.col("doc_id")))
    return done.groupBy("_outcome", "_quality_level").agg(F.count("*").alias("n"), F.round(F.avg("_quality_score"), 6).alias("mean_score"))


def announcement_types(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ["분기 실적 발표", "현금 배당 결정", "유상증자", "흡수 합병", "정기 공지", "영업 배당"]))
    title = F.concat(F.element_at(words, (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit(" "), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select(t.announcement_type(title).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def error_codes(spark: SparkSession, d: str) -> DataFrame:
    said = ["Read timed out", "no such element: #x", "HTTP 403 Forbidden", "layout looks different", "429 Too Many Requests", "JSONDecodeError at 3", "ConnectionRefused", "502 bad gateway", "File a.pdf not found", "odd"]
    message = F.element_at(F.array(*map(F.lit, said)), (F.col("event_id") % 10 + 1).cast("int"))
    rows = table(spark, d, "events").select(message.alias("message"))
    return rows.groupBy(t.error_code(F.col("message")).alias("code"), t.error_pattern(F.col("message")).alias("pattern")).agg(F.count("*").alias("n"))


_ERROR_SQL = """
    WITH m(i, code, shape) AS (VALUES (0, 'E001_TIMEOUT', 'Read timed out'), (1, 'E002_SELECTOR_FAIL', 'no such element: #x'), (2, 'E003_AUTH_REQUIRED', 'HTTP N Forbidden'),
        (3, 'E004_SITE_CHANGED', 'layout looks different'), (4, 'E005_BLOCKED', 'N Too Many Requests'), (5, 'E006_PARSE_ERROR', 'JSONDecodeError at N'),
        (6, 'E007_CONNECTION_ERROR', 'ConnectionRefused'), (7, 'E008_INVALID_RESPONSE', 'N bad gateway'), (8, 'E009_FILE_ERROR', 'File a.pdf not found'), (9, 'E010_UNKNOWN', 'odd'))
    SELECT code, substr(md5(shape), 1, 12) AS pattern, count(*) AS n FROM events JOIN m ON event_id % 10 = i GROUP BY ALL"""


def url_and_language(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    bare = F.regexp_replace("url", "^https?:", "")
    return pages.select("page_id", t.normalize_url(F.concat(F.lit(" "), bare)).alias("url"), t.language(F.col("html")).alias("language"), t.sql_text(F.concat(F.lit("="), F.col("url"))).alias("cell"))


QUERIES = {
    "news_transform": news_transform,
    "financial_transform": financial_transform,
    "exchange_transform": exchange_transform,
    "number_forms": number_forms,
    "date_forms": date_forms,
    "etl_outcomes": etl_outcomes,
    "announcement_types": announcement_types,
    "error_codes": error_codes,
    "url_and_language": url_and_language,
}
ORACLE = {
    "news_transform": _NEWS_SQL,
    "financial_transform": _FINANCIAL_SQL,
    "exchange_transform": """
        SELECT n_nationkey, upper(substr(n_name, 1, 3)) AS currency_code, (n_nationkey + 1) * 1000 + 300.5::DOUBLE AS base_rate,
               CASE WHEN n_nationkey % 4 = 0 THEN 7000.0::DOUBLE END AS buy_rate, 'high' AS _quality_level FROM nation""",
    "number_forms": _NUMBER_SQL,
    "date_forms": _DATE_SQL,
    "etl_outcomes": f"SELECT _outcome, _quality_level, count(*) AS n, round(avg(quality_score), 6) AS mean_score FROM ({_NEWS_SQL}) GROUP BY ALL",
    "announcement_types": """
        SELECT CASE o_orderkey % 6 WHEN 0 THEN 'earnings' WHEN 1 THEN 'dividend' WHEN 2 THEN 'capital' WHEN 3 THEN 'ma' WHEN 4 THEN 'other' ELSE 'earnings' END AS kind, count(*) AS n
        FROM orders GROUP BY 1""",
    "error_codes": _ERROR_SQL,
    "url_and_language": """
        SELECT page_id, 'https:' || regexp_replace(url, '^https?:', '') AS url, CASE WHEN regexp_matches(html, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language, '''=' || url AS cell FROM pages""",
}
