"""Validation rules as column expressions, one pass for all of them, and what follows from their issues.

A rule is a Rule(name, field, severity, test, message): test is true where the value is at fault.
`issues` gathers a row's faults in an array, so a table is read once however many rules there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import text as t
from tributary.functions.scores import quality_score, realtime_score, severity_weight

# Formats and signs of broken encodings that results must agree on.
FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_kr": r"^(01[016789]|02|0[3-9][0-9])-?[0-9]{3,4}-?[0-9]{4}$",
    "url": r"^https?://[^\s]+$",
    "korean_name": r"^[가-힣]{2,10}$",
    "business_number": r"^\d{3}-\d{2}-\d{5}$",
    "postal_code_kr": r"^\d{5}$",
}
BROKEN = (r"\ufffd", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", r"\x00", r"â€™|â€œ|â€|Ã©|Ã¨|Ã ", r"ï»¿", r"\\x[0-9a-fA-F]{2}")
BROKEN_KOREAN = (r"[가-힣]+[\x80-\xff]+[가-힣]*", r"占쏙옙")
UNUSUAL = r"[\p{Cn}\p{Co}\p{Cs}]"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy년 MM월 dd일")


@dataclass(frozen=True)
class Rule:
    name: str
    field: str
    severity: str
    test: Column
    message: str = ""


def required(field: str, severity: str = "error") -> Rule:
    c = F.col(field)
    return Rule("required", field, severity, c.isNull() | t.is_blank(c.cast("string")), "missing")


def encoding(field: str, korean: bool = True, severity: str = "error") -> list[Rule]:
    """Broken characters at the given severity; else unassigned or private ones as a warning."""
    c = F.col(field)
    broken = c.rlike("|".join((*BROKEN, *(BROKEN_KOREAN if korean else ()))))
    return [Rule("encoding", field, severity, broken, "broken characters"), Rule("encoding", field, "warning", ~broken & c.rlike(UNUSUAL), "unusual characters")]


def in_range(field: str, low: float | None = None, high: float | None = None, negative: bool = True, zero: bool = True, severity: str = "error") -> Rule:
    """The first of: not a number, negative, zero, too small, too large."""
    c = F.col(field)
    x = c.try_cast("double")
    bad = x.isNull()
    for wrong in ([] if negative else [x < 0]) + ([] if zero else [x == 0]) + ([x < low] if low is not None else []) + ([x > high] if high is not None else []):
        bad = bad | wrong
    return Rule("range", field, severity, c.isNotNull() & F.coalesce(bad, F.lit(True)), "out of range")


def matches(field: str, pattern: str, severity: str = "error") -> Rule:
    """The text must match a pattern, or a named format, from its start."""
    return Rule("format", field, severity, ~t.py_match(F.col(field), FORMATS.get(pattern, pattern)), "wrong format")


def dated(field: str, as_of: Column, future_days: int | None = 0, earliest: str = "1900-01-01", latest: str | None = None, form: str | None = None, severity: str = "error") -> Rule:
    """A readable date, not more than so many whole days ahead (None: any), and within bounds."""
    c = F.col(field)
    at = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ([form] if form else []) + list(DATE_FORMATS)])
    bad = at.isNull() | (at < F.lit(earliest).cast("timestamp"))
    if future_days is not None:
        bad = bad | (F.floor(F.timestamp_diff("SECOND", as_of.cast("timestamp"), at) / 86_400) > future_days)
    if latest:
        bad = bad | (at > F.lit(latest).cast("timestamp"))
    return Rule("date", field, severity, c.isNotNull() & F.coalesce(bad, F.lit(True)), "bad date")


def unique(field: str, order: str, severity: str = "error") -> Rule:
    """All but the first row of each value, in the given order; nulls are never repeats."""
    place = F.row_number().over(Window.partitionBy(field).orderBy(order))
    return Rule("unique", field, severity, F.col(field).isNotNull() & (place > 1), "repeated")


def custom(name: str, field: str, test: Callable[[Column], Column], severity: str = "error") -> Rule:
    return Rule(name, field, severity, test(F.col(field)), name)


def unreferenced(rows: DataFrame, field: str, valid: DataFrame, key: str) -> DataFrame:
    """Rows whose value is in no row of the reference table; nulls pass."""
    return rows.where(F.col(field).isNotNull()).join(valid.select(F.col(key).alias("__key")).distinct(), F.col(field) == F.col("__key"), "left_anti")


ISSUE = "array<struct<rule:string,field:string,severity:string,message:string>>"


def issues(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows with issues: an array with an entry for each rule that a row breaks."""
    # window functions may not stand inside a conditional, so tests are columns first
    tested = rows.withColumns({f"__t{i}": r.test for i, r in enumerate(rules)})
    found = [
        F.when(F.coalesce(F.col(f"__t{i}"), F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.field).alias("field"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message")))
        for i, r in enumerate(rules)
    ]
    return tested.withColumn("issues", F.array_compact(F.array(*found))).drop(*[f"__t{i}" for i in range(len(rules))])


def staged(rows: DataFrame, stages: Sequence[tuple[str, Sequence[Rule]]], go_on: bool = True) -> DataFrame:
    """rows with stages, (stage, passed, score, issues) in order, and passed, whether all that ran were.

    A stage fails with an error or worse. Without go_on, stages behind a row's first failing one do
    not run for it, and leave no entry.
    """
    for i, (name, rules) in enumerate(stages):
        rows = issues(rows, rules).withColumnRenamed("issues", f"__s{i}")
    made = []
    for i, (name, _) in enumerate(stages):
        bad = lambda kinds, i=i: F.size(F.filter(f"__s{i}", _of(kinds)))
        score = realtime_score(bad(("error", "critical")), bad(("warning",)))
        made.append(F.struct(F.lit(name).alias("stage"), (bad(("error", "critical")) == 0).alias("passed"), score.alias("score"), F.size(f"__s{i}").alias("issues")))
    every = F.array(*made)
    if not go_on:
        failing = F.array_position(F.transform(every, lambda s: s.passed), F.lit(False))
        every = F.when(failing > 0, F.slice(every, 1, failing.cast("int"))).otherwise(every)
    out = rows.withColumn("stages", every).drop(*[f"__s{i}" for i in range(len(stages))])
    return out.withColumn("passed", F.forall("stages", lambda s: s.passed))


def _of(kinds: Sequence[str]):
    return lambda x: x.severity.isin(*kinds)


def issue_counts(checked: DataFrame, *by: str) -> DataFrame:
    """Issues by any of rule, field and severity; checked as of issues."""
    return checked.select(F.inline("issues")).groupBy(*by).agg(F.count("*").alias("n"))


def batch_score(checked: DataFrame, *by: str) -> DataFrame:
    """Rows, rows with issues, issues and the quality score, over all or by columns."""
    weight = F.aggregate(F.transform("issues", lambda x: severity_weight(x.severity)), F.lit(0.0), lambda a, x: a + x)
    out = checked.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.size("issues") > 0).alias("bad_rows"), F.sum(F.size("issues")).alias("issues"), F.sum(weight).alias("__w"))
    return out.withColumn("score", F.round(quality_score(F.col("__w"), F.col("n")), 4)).drop("__w")


def field_stats(rows: DataFrame, fields: Sequence[str], approximate: bool = False) -> DataFrame:
    """For each field: rows, nulls, blanks, distinct values (of their first 100 characters) and rates, in one pass.

    Exact distinct counts of several columns expand every row; approximate ones do not.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    values = {f: F.col(f).cast("string") for f in fields}
    measured = [(f"{f}__{k}", e) for f, c in values.items() for k, e in (("null", F.count_if(c.isNull())), ("blank", F.count_if(t.is_blank(c))), ("unique", distinct(F.when(~t.is_blank(c), F.substring(c, 1, 100)))))]
    one = rows.agg(F.count("*").alias("total"), *[e.alias(n) for n, e in measured])
    parts = [F.struct(F.lit(f).alias("field"), F.col("total").alias("total"), *[F.col(f"{f}__{k}").alias(k) for k in ("null", "blank", "unique")]) for f in fields]
    out = one.select(F.inline(F.array(*parts)))
    rate = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("total")), 4)
    return out.withColumns({"null_rate": rate("null"), "blank_rate": rate("blank"), "unique_rate": F.round(F.try_divide(F.col("unique").cast("double"), F.col("total") - F.col("null") - F.col("blank")), 4)})


def anomalies(now: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Drops of the score and jumps of issues against a baseline (key, runs, score, issues) of three runs at least."""
    both = now.join(baseline.where("runs >= 3").select(key, F.col("score").alias("base_score"), F.col("issues").alias("base_issues")), key, "left")
    drop = F.col("base_score") - F.col("score")
    found = F.array_compact(
        F.array(
            F.when(drop >= 20, F.struct(F.lit("score_drop").alias("anomaly"), F.lit("error").alias("severity"))).when(drop >= 10, F.struct(F.lit("score_drop").alias("anomaly"), F.lit("warning").alias("severity"))),
            F.when((F.col("base_issues") > 0) & (F.col("issues") >= 2 * F.col("base_issues")), F.struct(F.lit("issue_jump").alias("anomaly"), F.lit("warning").alias("severity"))),
            F.when(F.col("score") < 70, F.struct(F.lit("low_score").alias("anomaly"), F.lit("error").alias("severity"))),
        )
    )
    return both.select(key, "score", F.inline(found))


# Texts for those who read a report, by what the numbers show.
def recommendations(score: float, rules: dict[str, int]) -> list[str]:
    out = []
    if score < 70:
        out.append("The score is under 70: hold this source back until its worst rule is met.")
    elif score < 90:
        out.append("The score is under 90: look at the rules with most issues.")
    advice = {"encoding": "Check the encoding that the source declares.", "required": "Check the selectors of the required fields.", "date": "Check the date formats.", "range": "Check units and signs.", "unique": "Remove repeats before loading."}
    return out + [advice[r] for r, _ in sorted(rules.items(), key=lambda x: -x[1]) if r in advice]
