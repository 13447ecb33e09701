"""Column functions on text: cleaning, numbers, dates, hashes, codes and classifications.

White space is Unicode's plus the four ASCII separators. Nothing here throws on bad input: what
cannot be read is null. `as_of` stands for the present wherever a text is relative to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters, units, patterns and codes that results must agree on.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
NEGATIVE, POSITIVE = "-▼↓", "+▲↑"
SYMBOLS = ",%원$₩"
UNITS = (("억", 100_000_000.0), ("만", 10_000.0), ("천", 1_000.0))
ERROR_PATTERNS = {
    "E001_TIMEOUT": ["timeout", "timed out"],
    "E002_SELECTOR_FAIL": [
        "no such element",
        "element not found",
        "selector.*not found",
        "nonetype.*has no attribute",
        "resultset.*is not found",
        "find.*returned none",
        "indexerror.*list index out of range",
    ],
    "E003_AUTH_REQUIRED": ["401", "403", "unauthorized", "forbidden", "login required", "authentication required", "access denied"],
    "E004_SITE_CHANGED": ["unexpected.*structure", "schema.*changed", "layout.*different", "page.*redesigned"],
    "E005_BLOCKED": ["429", "too many requests", "rate limit", "blocked", "captcha", "bot.*detected", "access.*denied.*temporarily"],
    "E006_PARSE_ERROR": ["jsondecodeerror", "valueerror.*could not convert", "parsing.*error", "invalid.*format", "decode.*error", "unicodedecodeerror"],
    "E007_CONNECTION_ERROR": ["connectionerror", "connectionrefused", "dns.*failed", "network.*unreachable", "host.*not found", "nameresolutionerror"],
    "E008_INVALID_RESPONSE": ["500", "502", "503", "504", "internal server error", "bad gateway", "service unavailable"],
    "E009_FILE_ERROR": ["file.*not found", "permission denied", "invalid.*pdf", "corrupt.*file", "unsupported.*format"],
}
INDEX_NAMES = (("코스피", "KOSPI"), ("코스닥", "KOSDAQ"), ("다우존스", "DJI"), ("나스닥", "NASDAQ"), ("S&P500", "SPX"))
NOTICE_KINDS = (("실적|영업", "earnings"), ("배당", "dividend"), ("증자|감자", "capital"), ("합병|인수", "ma"))


def strip(c: Column) -> Column:
    """c without white space at either end."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return c.rlike(rf"^{SPACE}*$")


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for batch in batches:
        yield batch.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def clean_text(c: Column, nfc: bool = True) -> Column:
    """Composed characters, single spaces, no zero-width spaces, stripped; null is empty.

    Only values with characters beyond ASCII go through Python.
    """
    if nfc:
        c = F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " ")
    return strip(F.replace(spaced, F.lit("​"), F.lit("")))


_FLOAT = r"^[+-]?([0-9][0-9_]*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(c: Column) -> Column:
    """A double: sign glyphs, thousands marks, currency marks and one Korean unit are understood."""
    text = strip(c)
    head = F.substring(text, 1, 1)
    negative = head.isin(*NEGATIVE)
    body = F.when(negative | head.isin(*POSITIVE), F.substring(text, 2, 1 << 30)).otherwise(text)
    body = F.translate(body, SYMBOLS, "")
    factor, plain = F.lit(1.0), body
    for unit, value in reversed(UNITS):
        factor = F.when(body.contains(unit), F.lit(value)).otherwise(factor)
        plain = F.when(body.contains(unit), F.replace(body, F.lit(unit), F.lit(""))).otherwise(plain)
    plain = strip(plain)
    whole = F.when(plain.rlike(_FLOAT), F.replace(plain, F.lit("_"), F.lit(""))).otherwise(F.regexp_extract(plain, r"[0-9.]+", 0))
    number = F.when(whole.rlike(r"[0-9]"), whole.try_cast("double")) * factor
    return F.when(negative, -number).otherwise(number)


def _parts(c: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(c, pattern, i).try_cast("int") for i in range(1, n + 1)]


def parse_date(c: Column, as_of: Column) -> Column:
    """A timestamp: relative texts first, then absolute ones from the fullest form down; null if none fits.

    A date with a letter between day and time keeps its day only; month/day/year is not read.
    """
    text = strip(c)
    zero = F.lit(0)
    day = F.date_trunc("day", as_of)
    out = F.when(text.rlike(r"[0-9]+분\s*전"), as_of - F.make_dt_interval(mins=F.regexp_extract(text, r"([0-9]+)분\s*전", 1).try_cast("int")))
    out = out.when(text.rlike(r"[0-9]+시간\s*전"), as_of - F.make_dt_interval(hours=F.regexp_extract(text, r"([0-9]+)시간\s*전", 1).try_cast("int")))
    out = out.when(text.rlike(r"[0-9]+일\s*전"), as_of - F.make_dt_interval(days=F.regexp_extract(text, r"([0-9]+)일\s*전", 1).try_cast("int")))
    out = out.when(text.contains("방금"), as_of).when(text.contains("오늘"), day)
    out = out.when(text.contains("어제"), day - F.make_dt_interval(days=F.lit(1)))
    forms = (
        (r"([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일\s*([0-9]{1,2}):([0-9]{2})", 5),
        (r"([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일", 3),
        (r"([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})\s*([0-9]{1,2}):([0-9]{2})", 5),
        (r"([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})", 3),
        (r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\s*([0-9]{1,2}):([0-9]{2}):([0-9]{2})", 6),
        (r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\s*([0-9]{1,2}):([0-9]{2})", 5),
        (r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", 3),
    )
    found = []
    for pattern, n in forms:
        y, mo, d, *rest = _parts(text, pattern, n)
        h, mi, s = [*rest, *[zero] * (3 - len(rest))]
        found.append(F.try_make_timestamp(y, mo, d, h, mi, s))
    hour, minute = _parts(text, r"([0-9]{2}):([0-9]{2})", 2)
    found.append(F.try_make_timestamp(F.year(as_of), F.month(as_of), F.dayofmonth(as_of), hour, minute, zero))
    y, mo, d = _parts(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", 3)
    found.append(F.try_make_timestamp(y, mo, d, zero, zero, zero))
    return out.otherwise(F.coalesce(*found))


def normalize_url(c: Column) -> Column:
    url = strip(F.coalesce(c, F.lit("")))
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def stock_code(c: Column) -> Column:
    """Digits only, filled with zeros to six, never cut."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)


def content_hash(*fields: Column) -> Column:
    """MD5 of the non-empty fields, joined by bars."""
    return F.md5(F.concat_ws("|", *[F.nullif(f, F.lit("")) for f in fields]))


def field_hash(**fields: Column) -> Column:
    """MD5 of name:value pairs by name, without nulls: the hash that change detection compares."""
    return F.md5(F.concat_ws("|", *[F.when(c.isNotNull(), F.concat(F.lit(f"{n}:"), c.cast("string"))) for n, c in sorted(fields.items())]))


def record_id(*candidates: Column) -> Column:
    """16 hex digits from the first non-empty candidate."""
    return F.substring(F.md5(F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])), 1, 16)


def py_match(c: Column, pattern: str) -> Column:
    """Whether the pattern matches at the start of c, with Unicode classes."""
    return c.rlike(f"(?U)^(?:{pattern})")


def error_code(message: Column, html: Column | None = None) -> Column:
    """The first code whose patterns match; else by words of the page; else unknown."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = None
    for code, patterns in ERROR_PATTERNS.items():
        test = low.rlike("|".join(patterns))
        out = F.when(test, code) if out is None else out.when(test, code)
    page = F.lower(F.coalesce(html, F.lit(""))) if html is not None else F.lit("")
    out = out.when(page.rlike("login|sign in|password"), "E003_AUTH_REQUIRED").when(page.rlike("captcha|verify|robot"), "E005_BLOCKED")
    return out.otherwise("E010_UNKNOWN")


def error_pattern(message: Column) -> Column:
    """A key of 12 hex digits for messages that differ in numbers, addresses and quoted names only."""
    shape = F.regexp_replace(F.coalesce(message, F.lit("")), r"[0-9]+", "N")
    shape = F.regexp_replace(F.regexp_replace(shape, r"'[^']*'", "'X'"), r'"[^"]*"', '"X"')
    return F.substring(F.md5(shape), 1, 12)


def index_code(name: Column) -> Column:
    out = None
    for part, code in INDEX_NAMES:
        out = F.when(name.contains(part), code) if out is None else out.when(name.contains(part), code)
    return out


def announcement_type(title: Column) -> Column:
    out = None
    for words, kind in NOTICE_KINDS:
        out = F.when(title.rlike(words), kind) if out is None else out.when(title.rlike(words), kind)
    return F.when(title.isNotNull(), out.otherwise("other"))


def language(c: Column) -> Column:
    """ko, en or mixed by the share of Hangul among letters; unknown without letters."""
    hangul = F.length(F.regexp_replace(c, r"[^가-힣]", ""))
    latin = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    share = hangul / F.nullif(hangul + latin, F.lit(0))
    return F.when(share > 0.7, "ko").when(share < 0.3, "en").when(share.isNotNull(), "mixed").otherwise("unknown")


def sql_text(c: Column) -> Column:
    """A value as exports write it: empty for null, and a quote before what a spreadsheet would run."""
    return F.when(c.isNull(), "").when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def retry_delay(attempt: Column, base: float = 1.0, most: float = 60.0, strategy: str = "exponential") -> Column:
    """Seconds to wait before an attempt, counted from 0, without jitter."""
    n = attempt.cast("double")
    if strategy == "fixed":
        delay = F.lit(base)
    elif strategy == "linear":
        delay = base * (n + 1)
    elif strategy == "exponential":
        delay = base * F.pow(F.lit(2.0), n)
    elif strategy == "fibonacci":
        pair = F.aggregate(F.sequence(F.lit(0), attempt.cast("int")), F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")), lambda s, _: F.struct(s.b.alias("a"), (s.a + s.b).alias("b")))
        delay = base * pair.a
    else:
        raise ValueError(f"no such strategy: {strategy}")
    return F.least(delay, F.lit(most))
