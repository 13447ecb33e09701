"""Dashboards, service levels, freshness, trends and alerts over runs.

Runs are rows of (run_id, source_id, status, category, ms, started_at, ...). Every function makes
its counts in one conditional aggregate, and takes `as_of` where the answer depends on the present.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.scores import freshness_state, percent, rounded, sla_state


def exact_sum(c: Column) -> Column:
    """A sum of doubles that does not depend on their order, to the millionth."""
    return F.sum(c.cast("decimal(24,6)")).cast("double")


def exact_mean(c: Column) -> Column:
    return exact_sum(c) / F.count(c)


def hours_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later) / 3600.0


def status_counts(status: Column = F.col) -> list[Column]:
    s = F.col("status")
    return [F.count("*").alias("total"), F.count_if(s == "success").alias("success"), F.count_if(s == "failed").alias("failed")]


def by_status(runs: DataFrame) -> DataFrame:
    """Runs, sum and mean of time by status, with each status's share."""
    grouped = runs.groupBy("status").agg(F.count("*").alias("runs"), rounded(exact_sum(F.col("ms")), 2).alias("total_ms"), rounded(exact_mean(F.col("ms")), 4).alias("mean_ms"))
    every = grouped.agg(F.sum("runs").alias("all_runs"))
    return grouped.join(F.broadcast(every)).withColumn("share", percent(F.col("runs"), F.col("all_runs"))).drop("all_runs")  # one row


def by_source(runs: DataFrame, top: int | None = 50) -> DataFrame:
    out = (
        runs.groupBy("source_id")
        .agg(*status_counts(), rounded(exact_sum(F.col("ms")), 2).alias("total_ms"), rounded(exact_mean(F.col("ms")), 4).alias("mean_ms"), F.max("started_at").alias("last_run"))
        .withColumn("success_rate", percent(F.col("success"), F.col("total")))
    )
    return out.orderBy(F.desc("total"), "source_id").limit(top) if top else out


def bucketed(runs: DataFrame, unit: str, shape: str) -> DataFrame:
    """Counts by hour or day: unit is a date_trunc unit, shape the label's format."""
    return (
        runs.groupBy(F.date_format(F.date_trunc(unit, F.col("started_at").cast("timestamp_ntz")), shape).alias("bucket"))
        .agg(*status_counts(), rounded(exact_mean(F.col("ms")), 4).alias("mean_ms"))
        .withColumn("success_rate", percent(F.col("success"), F.col("total")))
    )


def entry_totals(rows: DataFrame, entries: Column, top: int) -> DataFrame:
    """Sums of a map column's values by key, the largest first."""
    return rows.select(F.explode(entries).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total")).orderBy(F.desc("total"), "key").limit(top)


def sla_values(runs: DataFrame, hours: int) -> DataFrame:
    """One row of levels; without runs all is well and nothing flows."""
    s = F.col("status")
    return runs.agg(
        F.coalesce(percent(F.count_if(s.isin("success", "partial")), F.count("*")), F.lit(100.0)).alias("availability"),
        F.coalesce(percent(F.count_if(s == "success"), F.count("*")), F.lit(100.0)).alias("success_rate"),
        F.coalesce(percent(F.count_if(s == "failed"), F.count("*")), F.lit(0.0)).alias("error_rate"),
        F.coalesce(rounded(exact_mean(F.col("ms")), 2), F.lit(0.0)).alias("latency"),
        rounded(F.count("*") / float(max(hours, 1)), 2).alias("throughput"),
    )


def sla_states(values: DataFrame, levels: Sequence[tuple[str, float, float, float]]) -> DataFrame:
    """A row for each level: (kind, target, warning, critical) with actual and state."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(t)).alias("target"), F.lit(float(w)).alias("warning"), F.lit(float(c)).alias("critical"), F.col(k).alias("actual")) for k, t, w, c in levels])
    return values.select(F.inline(rows)).withColumn("state", sla_state(*[F.col(c) for c in ("kind", "actual", "target", "warning", "critical")]))


def freshness(runs: DataFrame, as_of: Column, warning: float, critical: float) -> DataFrame:
    """Each source's age in hours since its last run that gave data."""
    last = runs.groupBy("source_id").agg(F.max(F.when(F.col("status").isin("success", "partial"), F.col("started_at"))).alias("last_data"))
    age = rounded(hours_between(as_of, F.col("last_data")), 4)
    return last.withColumn("age_hours", age).withColumn("state", freshness_state(F.col("age_hours"), F.lit(warning), F.lit(critical)))


def expected_interval(runs: DataFrame, last: int = 10, default: float = 24.0) -> DataFrame:
    """Hours between each source's latest successful runs, and the warning and critical ages that follow."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    good = runs.where("status = 'success'").select("source_id", "started_at", "run_id", F.row_number().over(newest).alias("n"), F.lag("started_at").over(newest).alias("next"))
    gap = F.timestamp_diff("SECOND", F.col("started_at"), F.col("next"))
    out = good.where(F.col("n") <= last).groupBy("source_id").agg(F.count("*").alias("runs"), (F.sum(gap) / F.count(gap) / 3600.0).alias("mean_gap"))
    hours = F.when(F.col("runs") >= 2, F.col("mean_gap")).otherwise(F.lit(default))
    levels = (("expected_hours", 1.0), ("warning_hours", 1.5), ("critical_hours", 2.0))
    return out.select("source_id", "runs", *[rounded(hours * k, 6).alias(n) for n, k in levels])


def consecutive_failures(runs: DataFrame, most: int = 10) -> DataFrame:
    """How many of each source's newest runs failed before one did not."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    ok = F.sum(F.when(F.col("status") != "failed", 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    seen = runs.select("source_id", F.row_number().over(newest).alias("n"), ok.alias("ok"))
    return seen.where(F.col("n") <= most).groupBy("source_id").agg(F.count_if(F.col("ok") == 0).alias("failures"))


def period_change(runs: DataFrame, as_of: Column, hours: int, measure: Column, margin: float = 5.0) -> DataFrame:
    """The mean of a measure in the last hours and in as many before, and whether it rose or fell by more than margin."""
    start, before = (F.timestamp_add("HOUR", F.lit(-hours * k), as_of) for k in (1, 2))
    at = F.col("started_at")
    now, old = F.when((at >= start) & (at < as_of), measure), F.when((at >= before) & (at < start), measure)
    out = runs.where((at >= before) & (at < as_of)).agg(rounded(exact_mean(now), 4).alias("current"), rounded(exact_mean(old), 4).alias("previous"))
    move = F.col("current") - F.col("previous")
    return out.withColumn("trend", F.when(move.isNull(), "unknown").when(move > margin, "up").when(move < -margin, "down").otherwise("stable"))


def first_last(runs: DataFrame, measure: str, margin: float = 5.0) -> DataFrame:
    """Each source's first and last value of a measure, by time, and the trend between them."""
    order = F.struct("started_at", "run_id")
    out = runs.groupBy("source_id").agg(F.count("*").alias("runs"), F.min_by(measure, order).alias("first"), F.max_by(measure, order).alias("last"))
    move = F.col("last") - F.col("first")
    return out.withColumn("trend", F.when(move > margin, "improving").when(move < -margin, "declining").otherwise("stable"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def newest(rows: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def expired(rows: DataFrame, keys: Sequence[str], keep: int, stamp: str, cutoff: Column, order: Sequence[Column]) -> DataFrame:
    """Rows beyond the newest `keep` of their key that are older than the cutoff."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where((F.col("__n") > keep) & (F.col(stamp) < cutoff)).drop("__n")


def histogram(rows: DataFrame, key: str, value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative buckets, sum and count of a value by key, as (key, le, n); le is null for the whole."""
    counted = rows.groupBy(key).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("n"))
    parts = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("n"))]
    return counted.select(key, F.inline(F.array(*parts)))


def exposition(rows: DataFrame, name: str, labels: Sequence[str], value: str) -> DataFrame:
    """Lines of the Prometheus text format."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return rows.select(F.concat(F.lit(f"{name}{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


ALERTS = {
    "threshold_above": lambda v, t: v.try_cast("double") > t,
    "threshold_below": lambda v, t: v.try_cast("double") < t,
    "equals": lambda v, t: v.try_cast("double") == t,
    "not_equals": lambda v, t: v.try_cast("double") != t,
}


def alerts(metrics: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """metrics with a row for each rule that holds: rule, severity and value.

    A rule has name, field, condition (of ALERTS, missing_data or pattern_match), threshold or
    pattern, and severity. A missing value only meets missing_data.
    """
    found = []
    for r in rules:
        value = F.col(r["field"]).cast("string")
        if r["condition"] == "missing_data":
            test = value.isNull()
        elif r["condition"] == "pattern_match":
            test = value.rlike(r["pattern"])
        else:
            test = ALERTS[r["condition"]](value, F.lit(float(r["threshold"])))
        found.append(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["severity"]).alias("severity"), value.alias("value"))))
    return metrics.withColumn("__a", F.explode(F.array_compact(F.array(*found)))).select(*metrics.columns, "__a.*")


def cooled(fired: DataFrame, keys: Sequence[str], stamp: str, minutes: int) -> DataFrame:
    """Alerts that are sent: one is skipped if the last of its key that was not skipped is less than so many minutes old."""
    return throttled(fired, keys, stamp, 1, minutes * 60).where("sent").drop("sent")


def throttled(fired: DataFrame, keys: str | Sequence[str], stamp: str, most: int, seconds: int) -> DataFrame:
    """fired with sent: at most `most` sends of a key in any trailing window. What counts is what was sent.

    A key's rows are cut where it was silent for longer than the window, by the buckets of one
    window's length in which it fired (a partial aggregate), since two empty buckets apart nothing
    can count. Such stretches are dealt to tasks and sorted there by Spark; Python goes through a
    task's rows once, whatever stretches they are of, and holds the sends of one window.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    at = F.unix_micros(F.col(stamp).cast("timestamp"))
    rows = fired.withColumn("__bucket", F.floor(at / (seconds * 1_000_000)).cast("long"))
    busy = rows.groupBy(*keys, "__bucket").agg(F.lit(1).alias("__one"))
    order = Window.partitionBy(*keys).orderBy("__bucket")
    apart = F.coalesce((F.col("__bucket") - F.lag("__bucket").over(order) > 1).cast("int"), F.lit(0))
    stretch = busy.withColumn("__apart", apart).withColumn("__stretch", F.sum("__apart").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__one", "__apart")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__bucket"]]
    rows = rows.alias("a").join(stretch.alias("b"), same).select(*[F.col(f"a.`{c}`") for c in fired.columns], "b.__stretch")
    first = F.row_number().over(Window.partitionBy(*keys, "__stretch").orderBy(F.asc_nulls_last(stamp))) == 1  # and rows lie in this order
    names, length = fired.columns, seconds * 1_000_000

    def send(batches):
        kept = []
        for batch in batches:
            sent = []
            for now, begins in zip(batch["__at"].tolist(), batch["__first"].tolist(), strict=True):
                kept = [] if begins or now != now else [k for k in kept if now - k < length]
                sent.append(len(kept) < most)
                if sent[-1] and now == now:  # no number: no time
                    kept.append(now)
            yield batch[names].assign(sent=sent)

    kinds = ", ".join(f"`{n}` {k}" for n, k in fired.dtypes)
    return rows.withColumns({"__at": at.cast("double"), "__first": first}).drop("__stretch").mapInPandas(send, f"{kinds}, sent boolean")
