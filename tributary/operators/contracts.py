"""Contracts: expectations over a table, all measured in one aggregate, and rows routed by what fails.

An expectation has a test that is true for unexpected rows and a filter for the rows that count.
`measure` gives one row for each expectation; `route` tags rows of failed expectations by the worst
severity: nothing is valid, critical goes to quarantine, all else is invalid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import text as t

SEVERITIES = ("info", "warning", "error", "critical")


@dataclass(frozen=True)
class Expectation:
    name: str
    column: str
    severity: str
    counted: Column  # rows that make up the denominator
    unexpected: Column  # unexpected ones among them
    mostly: float = 1.0
    whole: str = ""  # "unique" or "rows": measured on the table rather than by rows
    low: int | None = None
    high: int | None = None


def _nullable(column: str, bad: Column, allow_null: bool) -> tuple[Column, Column]:
    c = F.col(column)
    if allow_null:
        return c.isNotNull(), c.isNotNull() & F.coalesce(bad, F.lit(True))
    return F.lit(True), c.isNull() | F.coalesce(bad, F.lit(True))


def not_null(column: str, mostly: float = 1.0, severity: str = "error") -> Expectation:
    return Expectation("not_null", column, severity, F.lit(True), F.col(column).isNull(), mostly)


def unique(column: str, mostly: float = 1.0, severity: str = "warning") -> Expectation:
    """Distinct values over rows, so that nulls lower the ratio; all members of a repeated value are at fault. Nulls are dealt out, so they do not meet in one task."""
    some = F.when(F.col(column).isNull(), F.monotonically_increasing_id())
    many = F.count(column).over(Window.partitionBy(column, some)) > 1
    return Expectation("unique", column, severity, F.lit(True), F.col(column).isNotNull() & many, mostly, "unique")


def in_range(column: str, low: float | None = None, high: float | None = None, strict_low: bool = False, strict_high: bool = False, mostly: float = 1.0, allow_null: bool = True, severity: str = "error") -> Expectation:
    x = F.regexp_replace(F.col(column).cast("string"), r"[, $%원₩]", "").try_cast("double")
    bad = x.isNull()
    if low is not None:
        bad = bad | ((x <= low) if strict_low else (x < low))
    if high is not None:
        bad = bad | ((x >= high) if strict_high else (x > high))
    return Expectation("in_range", column, severity, *_nullable(column, bad, allow_null), mostly)


# Named patterns of contracts.
PRESETS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_kr": r"^(01[016789]|02|0[3-9][0-9])-?[0-9]{3,4}-?[0-9]{4}$",
    "url": r"^https?://[^\s]+$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "datetime_iso": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "stock_code_kr": r"^\d{6}$",
    "business_number_kr": r"^\d{3}-\d{2}-\d{5}$",
}


def match_regex(column: str, pattern: str, mostly: float = 1.0, allow_null: bool = True, severity: str = "error") -> Expectation:
    return Expectation("match_regex", column, severity, *_nullable(column, ~t.py_match(F.col(column).cast("string"), PRESETS.get(pattern, pattern)), allow_null), mostly)


def in_set(column: str, values: Sequence, mostly: float = 1.0, allow_null: bool = True, severity: str = "error") -> Expectation:
    return Expectation("in_set", column, severity, *_nullable(column, ~F.col(column).isin(list(values)), allow_null), mostly)


def length_between(column: str, low: int | None = None, high: int | None = None, mostly: float = 1.0, allow_null: bool = True, severity: str = "error") -> Expectation:
    n = F.length(F.col(column).cast("string"))
    bad = F.lit(False)
    if low is not None:
        bad = bad | (n < low)
    if high is not None:
        bad = bad | (n > high)
    return Expectation("length_between", column, severity, *_nullable(column, bad, allow_null), mostly)


# How a string of each type looks.
TYPE_FORMS = {
    "integer": r"\s*[+-]?[0-9]+\s*$",
    "float": r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$",
    "boolean": r"(?i)\s*(true|false|yes|no|1|0)\s*$",
    "date_string": r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}",
    "string": r"",
    "number": r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$",
    "list": r"(?s)\[.*\]$",
    "dict": r"(?s)\{.*\}$",
    "datetime": r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$",
}


def of_type(column: str, kind: str, mostly: float = 1.0, allow_null: bool = True, severity: str = "error") -> Expectation:
    return Expectation("of_type", column, severity, *_nullable(column, ~t.py_match(F.col(column).cast("string"), TYPE_FORMS[kind]), allow_null), mostly)


def pair_equal(left: str, right: str, ignore: str = "neither", mostly: float = 1.0, severity: str = "error") -> Expectation:
    """ignore: which rows do not count: "both_null", "either_null" or "neither"."""
    a, b = F.col(left), F.col(right)
    counted = {"both_null": a.isNotNull() | b.isNotNull(), "either_null": a.isNotNull() & b.isNotNull(), "neither": F.lit(True)}[ignore]
    return Expectation("pair_equal", f"{left},{right}", severity, counted, counted & ~a.eqNullSafe(b), mostly)


def row_count_between(low: int | None = None, high: int | None = None, severity: str = "error") -> Expectation:
    return Expectation("row_count_between", "", severity, F.lit(True), F.lit(False), 1.0, "rows", low, high)


def measure(rows: DataFrame, contract: Sequence[Expectation]) -> DataFrame:
    """(id, expectation, column, severity, elements, unexpected, ratio, success) of each expectation, from one aggregate."""
    made = []
    for i, e in enumerate(contract):
        counted = F.count("*") if e.whole else F.count_if(e.counted)
        unexpected = F.count("*") - F.count_distinct(e.column) if e.whole == "unique" else F.lit(0).cast("long") if e.whole else F.count_if(e.unexpected)
        made += [counted.alias(f"n{i}"), unexpected.alias(f"u{i}")]
    one = rows.agg(*made)
    parts = []
    for i, e in enumerate(contract):
        n, u = F.col(f"n{i}"), F.col(f"u{i}")
        ratio = F.coalesce(1 - F.try_divide(u.cast("double"), n), F.lit(1.0))
        ok = ratio >= e.mostly
        if e.whole == "rows":
            ok = F.lit(True) if e.low is None else n >= e.low
            ok = ok if e.high is None else ok & (n <= e.high)
        parts.append(
            F.struct(
                F.lit(i).alias("id"), F.lit(e.name).alias("expectation"), F.lit(e.column).alias("column"), F.when(ok, "info").otherwise(e.severity).alias("severity"), n.alias("elements"), u.alias("unexpected"),
                F.round(ratio, 6).alias("ratio"), ok.alias("success"),
            )
        )
    return one.select(F.inline(F.array(*parts)))


def measure_all(rows: DataFrame, contract: Sequence[Expectation]) -> DataFrame:
    """As measure, with status: an expectation that cannot be evaluated on these rows (a column is missing, or of a type that it cannot read) is skipped and fails, and does not stop the others."""
    from pyspark.errors import AnalysisException

    skipped = {}
    for i, e in enumerate(contract):
        try:
            rows.select(e.counted.alias("c"), e.unexpected.alias("u"), *([e.column] if e.whole == "unique" else [])).schema  # analysed, not run
        except AnalysisException as problem:
            skipped[i] = str(problem).splitlines()[0][:200]
    left = [i for i in range(len(contract)) if i not in skipped]
    out = measure(rows, [contract[i] for i in left] or [row_count_between()])
    out = out if left else out.where("false")
    numbers = F.array(*[F.lit(i) for i in left]) if left else F.array().cast("array<int>")
    done = out.withColumn("id", F.try_element_at(numbers, F.col("id") + 1)).withColumn("status", F.when(F.col("success"), "passed").otherwise("failed"))
    none = [(i, contract[i].name, contract[i].column, contract[i].severity, 0, 0, 0.0, False, "skipped") for i in skipped]
    return done.unionByName(rows.sparkSession.createDataFrame(none, done.schema)) if none else done


def holds(results: Sequence, fail_on_error: bool = True, fail_on_warning: bool = False) -> bool:
    """Whether a contract holds, from measured rows: critical always counts, the rest as asked."""
    failing = {"critical"} | ({"error"} if fail_on_error else set()) | ({"warning"} if fail_on_warning else set())
    return not any(not r["success"] and r["severity"] in failing for r in results)


def route(rows: DataFrame, contract: Sequence[Expectation]) -> DataFrame:
    """rows with _validation_issue (the worst severity of a failed expectation, or null) and _route.

    The contract is measured first; only failed expectations flag rows.
    """
    failed = [contract[r["id"]] for r in measure(rows, contract).collect() if not r["success"]]  # one row for each expectation
    failed = [e for e in failed if e.whole != "rows"]
    tested = rows.withColumns({f"__e{i}": e.unexpected for i, e in enumerate(failed)})
    worst = F.greatest(F.lit(-1), F.lit(-1), *[F.when(F.coalesce(F.col(f"__e{i}"), F.lit(False)), SEVERITIES.index(e.severity)).otherwise(-1) for i, e in enumerate(failed)])
    named = F.when(worst >= 0, F.element_at(F.array(*map(F.lit, SEVERITIES)), worst + 1))
    return (
        tested.withColumn("_validation_issue", named)
        .drop(*[f"__e{i}" for i in range(len(failed))])
        .withColumn("_route", F.when(F.col("_validation_issue").isNull(), "valid").when(F.col("_validation_issue") == "critical", "quarantine").otherwise("invalid"))
    )


# The contracts that sources of a kind get, and their bounds.
TEMPLATES = {
    "news_articles": lambda: [not_null("title"), not_null("url"), unique("url", 0.99), length_between("title", 5, 300, severity="warning"), match_regex("url", "url", 0.95), row_count_between(1)],
    "financial_data": lambda: [not_null("name"), not_null("price"), in_range("price", 0), of_type("price", "number"), row_count_between(1)],
    "stock_prices": lambda: [not_null("stock_code"), not_null("price"), match_regex("stock_code", "stock_code_kr", 0.95), in_range("price", 0), in_range("volume", 0), row_count_between(1)],
    "exchange_rates": lambda: [not_null("currency_code"), not_null("base_rate"), length_between("currency_code", 3, 3, severity="warning"), in_range("base_rate", 0), row_count_between(1)],
    "generic_table": lambda columns=(): [row_count_between(1), *map(not_null, columns)],
}
