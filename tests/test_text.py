import datetime as dt

import pytest
from pyspark.sql import functions as F

from tributary.functions import scores, text as t
from tributary.operators import transform

def as_of():
    return F.lit("2024-03-01 12:30:15").cast("timestamp_ntz")


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_clean_text(spark):
    raw = ["  a  b\t\nc ", None, "", "é", "x​y", "한", "\t \n"]
    assert values(spark, raw, t.clean_text) == ["a b c", "", "", "é", "xy", "한", ""]


def test_numbers(spark):
    raw = ["", " ", "-", "1.2.3", "3억 5만", "1_000", "nan", "₩1,000", "▼", "▼1,500", "+2.5%", "↑ 7", "약 12원", "1e3", None, "2만", "true", "-0"]
    got = values(spark, raw, t.parse_number)
    assert got == [None, None, None, None, 300000000.0, 1000.0, None, 1000.0, None, -1500.0, 2.5, 7.0, 12.0, 1000.0, None, 20000.0, None, 0.0]


def test_dates(spark):
    raw = ["01/15/2024", "2024-01-15T10:30:00Z", "2024.1.5 9:05", "2024-02-30", "방금", "14:30", "5분 전", "오늘", "어제", "", None, "2024년 12월 1일"]
    got = values(spark, raw, lambda c: t.parse_date(c, as_of()))
    d = dt.datetime
    assert got == [None, d(2024, 1, 15), d(2024, 1, 5, 9, 5), None, d(2024, 3, 1, 12, 30, 15), d(2024, 3, 1, 14, 30), d(2024, 3, 1, 12, 25, 15), d(2024, 3, 1), d(2024, 2, 29), None, None, d(2024, 12, 1)]


def test_codes_and_urls(spark):
    assert values(spark, ["5930", "A005930", "1234567", "", None], t.stock_code) == ["005930", "005930", "1234567", "", ""]
    assert values(spark, [" //a.b/c ", "/x", "http://y", None], t.normalize_url) == ["https://a.b/c", "/x", "http://y", ""]
    assert values(spark, ["안녕하세요", "hello", "안녕하 hello", "123"], t.language) == ["ko", "en", "mixed", "unknown"]
    assert values(spark, ["=1", "ok", None, "-x"], t.sql_text) == ["'=1", "ok", "", "'-x"]


def test_error_codes(spark):
    raw = ["ReadTimeout", "access denied", "selector .x not found", "odd", None]
    assert values(spark, raw, t.error_code) == ["E001_TIMEOUT", "E003_AUTH_REQUIRED", "E002_SELECTOR_FAIL", "E010_UNKNOWN", "E010_UNKNOWN"]
    assert values(spark, ["odd"], lambda c: t.error_code(c, F.lit("please Sign In"))) == ["E003_AUTH_REQUIRED"]


@pytest.mark.parametrize(("strategy", "expected"), [("fixed", [2, 2, 2, 2]), ("linear", [2, 4, 6, 8]), ("exponential", [2, 4, 8, 10]), ("fibonacci", [2, 2, 4, 6])])
def test_retry_delay(spark, strategy, expected):
    rows = spark.range(4).orderBy("id").select(t.retry_delay(F.col("id"), 2.0, 10.0, strategy)).collect()
    assert [r[0] for r in rows] == expected


def test_news_scores(spark):
    rows = spark.createDataFrame([("T", "c", "2024.1.5", "//a"), ("", "c", "?", None), ("T", None, "2025.1.5", "x")], "title string, content string, date string, link string")
    out = transform.transform(rows, "news_article", as_of(), F.monotonically_increasing_id()).collect()
    assert [round(r["_quality_score"], 6) for r in out] == [1.0, 0.3, 0.5]
    assert [r["_quality_level"] for r in out] == ["high", "invalid", "low"]
    assert out[0]["url"] == "https://a" and out[0]["_data_date"] == "2024-01-05"


def test_categories():
    assert transform.detect_category(["Currency", "x"]) == "exchange_rate"
    assert transform.detect_category(["title"]) == "news_article"
    assert transform.detect_category(["x"]) == "generic"


def test_empty_input(spark):
    rows = spark.createDataFrame([], "name string, price string, change string, date string")
    out = transform.routed(transform.transform(rows, "financial_data", as_of(), F.lit(0)))
    assert out.count() == 0 and "_outcome" in out.columns


def test_scores(spark):
    row = spark.range(1).select(scores.quality_score(F.lit(5.0), F.lit(2)), scores.quality_score(F.lit(0.0), F.lit(0)), scores.realtime_score(F.lit(3), F.lit(40)), scores.percent(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (50.0, 100.0, 0.0, None)
