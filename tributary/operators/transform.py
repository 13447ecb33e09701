"""Category transforms of raw records and their quality scores.

Records are rows of strings. Each transform adds the typed columns of its category, and `finish`
adds order, date, score and level. A column that is not there is treated as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import text as t
from tributary.functions.scores import quality_level

# Numeric fields, date fields, and what each category requires.
NUMBERS = ("price", "value", "open", "high", "low", "close", "volume", "change", "change_rate", "market_cap", "per", "pbr", "eps")
RATES = ("base_rate", "buy_rate", "sell_rate", "send_rate", "receive_rate")
DATES = ("date", "published_at", "created_at", "datetime")
REQUIRED = {
    "news_article": ("title", "content"),
    "announcement": ("title",),
    "financial_data": ("name", "price"),
    "stock_price": ("name", "price"),
    "exchange_rate": ("currency", "base_rate"),
    "market_index": ("name", "value"),
}
# Which keys tell a category, in order.
CATEGORY_KEYS = (
    ("exchange_rate", {"currency", "base_rate", "exchange_rate"}),
    ("stock_price", {"stock_code", "code", "close"}),
    ("market_index", {"index_value", "index_code"}),
    ("financial_data", {"price", "volume", "change"}),
    ("announcement", {"announcement_type", "disclosure"}),
    ("news_article", {"title", "content", "headline"}),
)


def detect_category(columns: list[str]) -> str:
    """The first category any of whose keys is a column."""
    names = {c.lower() for c in columns}
    return next((name for name, keys in CATEGORY_KEYS if keys & names), "generic")


def rename_fields(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def news(df: DataFrame, as_of: Column, nfc: bool = True) -> DataFrame:
    had = set(df.columns)
    for name in ("title", "content"):
        if name in had:
            df = df.withColumn(name, t.clean_text(F.col(name), nfc)).withColumn(f"{name}_length", F.length(name))
    if "content" in had and "summary" not in had:
        short = F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content"))
        df = df.withColumn("summary", short)
    stamp = next((c for c in DATES if c in had), None)
    if stamp:
        df = df.withColumn("published_at", t.parse_date(F.col(stamp), as_of))
    if "link" in had:
        df = df.withColumn("url", t.normalize_url(F.col("link")))
    elif "url" not in had:
        df = df.withColumn("url", F.lit(None).cast("string"))
    return df.withColumn("content_hash", t.content_hash(F.col("title") if "title" in had else F.lit(""), F.col("url")))


def financial(df: DataFrame, as_of: Column) -> DataFrame:
    had = set(df.columns)
    df = df.withColumns({c: t.parse_number(F.col(c)) for c in NUMBERS if c in had and dict(df.dtypes)[c] == "string"})
    if {"change", "price"} <= had:
        before = F.col("price") - F.col("change")
        rate = F.when((F.col("price") != 0) & (F.col("change") != 0) & (before != 0), F.round(F.col("change") / before * 100, 2))
        df = df.withColumn("change_rate", F.coalesce(rate, F.col("change_rate")) if "change_rate" in had else rate)
    if "date" in had:
        df = df.withColumn("trade_date", t.parse_date(F.col("date"), as_of))
    if "code" in had:
        df = df.withColumn("stock_code", t.stock_code(F.col("code")))
    return df


def exchange_rate(df: DataFrame, as_of: Column) -> DataFrame:
    df = financial(df, as_of)
    if "currency" in df.columns:
        df = df.withColumn("currency_code", F.substring(F.upper("currency"), 1, 3))
    return df.withColumns({c: t.parse_number(F.col(c)) for c in RATES if c in df.columns and dict(df.dtypes)[c] == "string"})


def market_index(df: DataFrame, as_of: Column) -> DataFrame:
    df = financial(df, as_of)
    return df.withColumn("index_code", t.index_code(F.col("name"))) if "name" in df.columns else df


def announcement(df: DataFrame, as_of: Column, nfc: bool = True) -> DataFrame:
    df = news(df, as_of, nfc)
    return df.withColumn("announcement_type", t.announcement_type(F.col("title"))) if "title" in df.columns else df


TRANSFORMS = {
    "news_article": news,
    "announcement": announcement,
    "financial_data": financial,
    "stock_price": financial,
    "exchange_rate": exchange_rate,
    "market_index": market_index,
}


def quality(df: DataFrame, category: str, as_of: Column) -> Column:
    """0 to 1: one less fixed penalties, taken off in one order, since results are compared at 0.6 and 0.7."""
    missing = lambda c: F.col(c).isNull() if c in df.columns else F.lit(True)
    falsy = lambda c: (F.col(c).isNull() | (F.col(c).cast("string") == "")) if c in df.columns else F.lit(True)
    off = [(missing(c), 0.2) for c in REQUIRED.get(category, REQUIRED["news_article"])]
    if category == "news_article":
        off += [(falsy("title"), 0.3), (falsy("published_at"), 0.2)]
    elif category in ("financial_data", "stock_price"):
        off += [(missing("price"), 0.3)]
    when = [F.col(c) for c in ("published_at", "trade_date") if c in df.columns]
    if when:
        off += [(F.coalesce(*when) > as_of + F.make_dt_interval(days=F.lit(1)), 0.3)]
    score = F.lit(1.0)
    for test, penalty in off:
        score = score - F.when(test, penalty).otherwise(0.0)
    return F.greatest(F.lit(0.0), score)


def finish(df: DataFrame, category: str, as_of: Column, order: Column) -> DataFrame:
    """Blank strings to null; order, date, category, score and level. order: the rows' place in their source."""
    df = df.withColumns({n: t.blank_to_null(F.col(n)) for n, kind in df.dtypes if kind == "string" and not n.startswith("_")})
    when = [F.col(c) for c in ("published_at", "trade_date") if c in df.columns]
    return (
        df.withColumn("_order_index", order)
        .withColumn("_data_category", F.lit(category))
        .withColumn("_data_date", F.date_format(F.coalesce(*when, as_of), "yyyy-MM-dd"))
        .withColumn("_quality_score", quality(df, category, as_of))
        .withColumn("_quality_level", quality_level(F.col("_quality_score")))
    )


def transform(df: DataFrame, category: str, as_of: Column, order: Column, mapping: dict[str, str] | None = None, custom: dict | None = None) -> DataFrame:
    """Rename, transform by category, then custom columns (name: function of a column), then `finish`."""
    df = rename_fields(df, mapping or {})
    df = TRANSFORMS.get(category, lambda d, _: d)(df, as_of)
    df = df.withColumns({n: f(F.col(n)) for n, f in (custom or {}).items()})
    return finish(df, category, as_of, order)


def routed(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """df with _outcome: loaded where the score reaches the threshold, else rejected. One pass feeds both sinks."""
    return df.withColumn("_outcome", F.when(F.col("_quality_score") >= threshold, "loaded").otherwise("rejected"))
