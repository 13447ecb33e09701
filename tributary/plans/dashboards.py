"""Queries over runs, orders and reviews: counts, rates, trends, levels and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.scores import percent, source_score
from tributary.operators import metrics as m
from tributary.plans.common import AS_OF, REVIEWS, RUNS, as_of, mean, reviews, runs, total
from tributary.session import table

LEVELS = (("availability", 99, 97, 95), ("success_rate", 95, 90, 85), ("error_rate", 1, 3, 5), ("latency", 60, 120, 300), ("throughput", 1, 0.5, 0.1))
T = f"TIMESTAMP '{AS_OF}'"
_MEAN = "round(CAST(sum(CAST(ms AS DECIMAL(24,6))) AS DOUBLE) / count(ms), 4)"
_COUNTS = "count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed"
_RATE = "round(count(*) FILTER (status = 'success') * 100.0::DOUBLE / count(*), 2) AS success_rate"


def runs_by_status(spark: SparkSession, d: str) -> DataFrame:
    return m.by_status(runs(spark, d))


def runs_by_source(spark: SparkSession, d: str) -> DataFrame:
    return m.by_source(runs(spark, d)).withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss"))


def runs_by_category(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).where("category is not null").groupBy("category").agg(F.count("*").alias("runs"), F.countDistinct("source_id").alias("sources"), F.round(mean(F.col("ms")), 4).alias("mean_ms"))


def hourly_trend(spark: SparkSession, d: str) -> DataFrame:
    return m.bucketed(runs(spark, d), "hour", "yyyy-MM-dd'T'HH:00:00'Z'")


def daily_trend(spark: SparkSession, d: str) -> DataFrame:
    return m.bucketed(runs(spark, d), "day", "yyyy-MM-dd")


def error_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Sums of a map of error counts by kind, here by the tens of the runs' detail."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = runs(spark, d).where("status = 'failed'").select(F.create_map(F.concat(F.lit("kind_"), (k / 10).cast("int").cast("string")), F.lit(1).cast("long"), F.lit("all"), k).alias("errors"))
    return m.entry_totals(rows, F.col("errors"), 20)


def dashboard_facets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_acctbal")
    return table(spark, d, "customer").agg(F.count("*").alias("total"), F.count_if(c > 0).alias("active"), F.count_if(c < 0).alias("error"), F.count_if(c.isNull()).alias("unknown"))


def last_runs_rate(spark: SparkSession, d: str) -> DataFrame:
    last = runs(spark, d).orderBy(F.desc("started_at"), F.desc("run_id")).limit(100)
    return last.agg(*m.status_counts()).withColumn("success_rate", percent(F.col("success"), F.col("total"), 1))


def sla_levels(spark: SparkSession, d: str) -> DataFrame:
    return m.sla_states(m.sla_values(runs(spark, d), 24 * 30), LEVELS)


_SLA_SQL = f"""
    WITH {RUNS}, v AS (SELECT round(count(*) FILTER (status <> 'failed') * 100.0::DOUBLE / count(*), 2) AS availability, {_RATE},
        round(count(*) FILTER (status = 'failed') * 100.0::DOUBLE / count(*), 2) AS error_rate,
        round(CAST(sum(CAST(ms AS DECIMAL(24,6))) AS DOUBLE) / count(ms), 2) AS latency, round(count(*) / 720.0::DOUBLE, 2) AS throughput FROM runs),
    l(kind, target, warning, critical) AS (VALUES ('availability', 99.0::DOUBLE, 97.0::DOUBLE, 95.0::DOUBLE), ('success_rate', 95, 90, 85), ('error_rate', 1, 3, 5), ('latency', 60, 120, 300), ('throughput', 1, 0.5, 0.1)),
    a AS (SELECT l.*, CASE kind WHEN 'availability' THEN availability WHEN 'success_rate' THEN success_rate WHEN 'error_rate' THEN error_rate WHEN 'latency' THEN latency ELSE throughput END AS actual FROM l, v)
    SELECT *, CASE WHEN kind IN ('error_rate', 'latency') THEN CASE WHEN actual <= target THEN 'compliant' WHEN actual <= warning THEN 'at_risk' ELSE 'breached' END
        ELSE CASE WHEN actual >= target THEN 'compliant' WHEN actual >= warning THEN 'at_risk' WHEN actual >= critical THEN 'breached' ELSE 'critical' END END AS state FROM a"""


def freshness_states(spark: SparkSession, d: str) -> DataFrame:
    return m.freshness(runs(spark, d), as_of(), 26.0, 30.0).withColumn("last_data", F.date_format("last_data", "yyyy-MM-dd HH:mm:ss"))


def freshness_summary(spark: SparkSession, d: str) -> DataFrame:
    states = m.freshness(runs(spark, d), as_of(), 26.0, 30.0)
    return states.groupBy("state").agg(F.count("*").alias("sources"), F.round(F.avg("age_hours"), 2).alias("mean_age"))


_FRESH_SQL = f"""
    WITH {RUNS}, l AS (SELECT source_id, max(started_at) FILTER (status <> 'failed') AS last_data FROM runs GROUP BY source_id),
    a AS (SELECT source_id, last_data, round(floor(epoch_us({T} - last_data) / 1000000) / 3600.0, 4)::DOUBLE AS age_hours FROM l)
    SELECT source_id, strftime(last_data, '%Y-%m-%d %H:%M:%S') AS last_data, age_hours,
        CASE WHEN age_hours IS NULL OR age_hours >= 30 THEN 'critical' WHEN age_hours >= 26 THEN 'stale' ELSE 'fresh' END AS state FROM a"""


def expected_intervals(spark: SparkSession, d: str) -> DataFrame:
    return m.expected_interval(runs(spark, d))


_INTERVAL_SQL = f"""
    WITH {RUNS}, g AS (SELECT source_id, started_at, row_number() OVER o AS n, lag(started_at) OVER o AS nxt FROM runs WHERE status = 'success' WINDOW o AS (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC)),
    a AS (SELECT source_id, count(*) AS runs, sum(CAST(floor(epoch_us(nxt - started_at) / 1000000) AS BIGINT))::DOUBLE / count(nxt) / 3600.0::DOUBLE AS gap FROM g WHERE n <= 10 GROUP BY source_id),
    h AS (SELECT source_id, runs, (CASE WHEN runs >= 2 THEN gap ELSE 24 END)::DOUBLE AS g FROM a)
    SELECT source_id, runs, round(g, 6) AS expected_hours, round(g * 1.5::DOUBLE, 6) AS warning_hours, round(g * 2.0::DOUBLE, 6) AS critical_hours FROM h"""


def failures_in_a_row(spark: SparkSession, d: str) -> DataFrame:
    return m.consecutive_failures(runs(spark, d))


def quality_change(spark: SparkSession, d: str) -> DataFrame:
    return m.period_change(runs(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 24, F.col("ms"), 0.5)


def source_trends(spark: SparkSession, d: str) -> DataFrame:
    return m.first_last(runs(spark, d), "ms")


def source_scores(spark: SparkSession, d: str) -> DataFrame:
    stats = m.by_source(runs(spark, d), None).join(m.freshness(runs(spark, d), as_of(), 26.0, 30.0).select("source_id", "state"), "source_id")
    score = source_score(F.col("success_rate"), F.least(F.col("mean_ms"), F.lit(100.0)), F.col("state"), F.col("total") * 10, F.col("total"))
    return stats.select("source_id", score.alias("score"))


def alert_hits(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        {"name": "slow", "field": "mean_ms", "condition": "threshold_above", "threshold": 20, "severity": "warning"},
        {"name": "failing", "field": "success_rate", "condition": "threshold_below", "threshold": 18, "severity": "error"},
        {"name": "odd", "field": "source_id", "condition": "pattern_match", "pattern": "^1.3$", "severity": "info"},
        {"name": "silent", "field": "last_run", "condition": "missing_data", "severity": "critical"},
    ]
    hits = m.alerts(m.by_source(runs(spark, d), None), rules)
    return hits.groupBy("rule", "severity").agg(F.count("*").alias("sources"))


def alert_bursts(spark: SparkSession, d: str) -> DataFrame:
    return m.cooled(runs(spark, d).where("status = 'failed'"), ["source_id"], "started_at", 600).groupBy("source_id").agg(F.count("*").alias("bursts"))


def alert_throttle(spark: SparkSession, d: str) -> DataFrame:
    sent = m.throttled(runs(spark, d).where("status = 'failed'").select("source_id", "started_at"), "source_id", "started_at", 2, 86_400)
    return sent.groupBy("source_id").agg(F.count_if("sent").alias("sent"), F.count("*").alias("fired"))


def time_histogram(spark: SparkSession, d: str) -> DataFrame:
    return m.histogram(runs(spark, d), "status", "ms", (1, 5, 10, 25, 50))


def metric_lines(spark: SparkSession, d: str) -> DataFrame:
    return m.exposition(runs(spark, d).groupBy("status", "category").agg(F.count("*").alias("n")), "runs_total", ["status", "category"], "n")


def review_facets(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return reviews(spark, d).agg(
        F.count("*").alias("total"),
        *[F.count_if(s == k).alias(k) for k in ("pending", "approved", "rejected")],
        F.count_if("needs_number_review").alias("needs_number_review"),
        F.round(mean(F.col("confidence")), 4).alias("mean_confidence"),
    )


def review_trends(spark: SparkSession, d: str) -> DataFrame:
    """Reviews by day and status, a row for each day of the range."""
    rows = reviews(spark, d).groupBy(F.to_date("created_at").alias("day")).pivot("status", ["pending", "approved", "rejected"]).count()
    days = reviews(spark, d).agg(F.explode(F.sequence(F.to_date(F.min("created_at")), F.date_add(F.to_date(F.max("created_at")), 3))).alias("day"))
    return days.join(rows, "day", "left").fillna(0).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    page = reviews(spark, d).where("status = 'pending'").orderBy(F.desc("needs_number_review"), "confidence", "created_at", "review_id").offset(20).limit(20)
    return page.select("review_id", "source_id", "confidence")


def review_by_source(spark: SparkSession, d: str) -> DataFrame:
    top = reviews(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "approved").alias("approved"))
    return top.orderBy(F.desc("n"), "source_id").limit(5)


def review_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Next and previous review of each source's queue, and the place in it."""
    queue = Window.partitionBy("source_id").orderBy("created_at", "review_id")
    return reviews(spark, d).select("review_id", F.lead("review_id").over(queue).alias("next_id"), F.lag("review_id").over(queue).alias("previous_id"), F.row_number().over(queue).alias("place"))


def sources_with_runs(spark: SparkSession, d: str) -> DataFrame:
    """A page of sources with their newest order and number of orders."""
    page = table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_name").offset(10).limit(50)
    orders = table(spark, d, "orders")
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))
    return page.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), "newest")


def code_groups(spark: SparkSession, d: str) -> DataFrame:
    """Code groups with their active codes; groups without any stay."""
    groups, codes = table(spark, d, "region"), table(spark, d, "nation")
    on = (F.col("r_regionkey") == F.col("n_regionkey")) & (F.col("n_nationkey") % 2 == 0)
    return groups.join(codes, on, "left").groupBy("r_regionkey", "r_name").agg(F.count("n_nationkey").alias("codes"))


def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    """The newest orders with their customer's name and nation: top-k first, joins after."""
    recent = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    named = recent.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return named.select("o_orderkey", F.coalesce("c_name", F.lit("Unknown")).alias("source"), F.coalesce("n_name", F.lit("Unknown")).alias("nation"))


def newest_per_source(spark: SparkSession, d: str) -> DataFrame:
    rows = m.newest(runs(spark, d), ["source_id"], 10, [F.desc("started_at"), F.desc("run_id")])
    return rows.groupBy("source_id").agg(F.count("*").alias("runs"), F.round(mean(F.col("ms")), 4).alias("mean_ms"), F.count_if(F.col("status") == "failed").alias("failed"))


def retention(spark: SparkSession, d: str) -> DataFrame:
    """How many old orders each customer loses when the newest three stay."""
    gone = m.expired(table(spark, d, "orders"), ["o_custkey"], 3, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return gone.groupBy("o_custkey").agg(F.count("*").alias("expired"))


def domain_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows and newest stamp of each table, as one union of aggregates."""
    parts = [(n, s) for n, s in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    out = None
    for name, stamp in parts:
        one = table(spark, d, name).agg(F.lit(name).alias("domain"), F.count("*").alias("n"), F.date_format(F.max(stamp), "yyyy-MM-dd").alias("newest"))
        out = one if out is None else out.unionByName(one)
    return out


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status and priority with totals, in one pass over grouping sets."""
    rows = table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(total(F.col("o_totalprice")), 2).alias("value"), F.grouping_id().cast("int").alias("level"))
    return rows


def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources without any order since a day: an anti-join on the recent ones."""
    recent = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).select("o_custkey")
    return table(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


QUERIES = {
    f.__name__: f
    for f in (
        runs_by_status, runs_by_source, runs_by_category, hourly_trend, daily_trend, error_distribution, dashboard_facets, last_runs_rate, sla_levels, freshness_states, freshness_summary,
        expected_intervals, failures_in_a_row, quality_change, source_trends, source_scores, alert_hits, alert_bursts, alert_throttle, time_histogram, metric_lines, review_facets, review_trends,
        review_queue, review_by_source, review_neighbours, sources_with_runs, code_groups, recent_activity, newest_per_source, retention, domain_stats, status_rollup, stale_sources,
    )
}
_SOURCES = f"SELECT source_id, {_COUNTS}, round(CAST(sum(CAST(ms AS DECIMAL(24,6))) AS DOUBLE), 2) AS total_ms, {_MEAN} AS mean_ms, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last_run, {_RATE} FROM runs GROUP BY source_id"
ORACLE = {
    "runs_by_status": f"WITH {RUNS} SELECT status, count(*) AS runs, round(CAST(sum(CAST(ms AS DECIMAL(24,6))) AS DOUBLE), 2) AS total_ms, {_MEAN} AS mean_ms, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS share FROM runs GROUP BY status",
    "runs_by_source": f"WITH {RUNS} {_SOURCES} ORDER BY total DESC, source_id LIMIT 50",
    "runs_by_category": f"WITH {RUNS} SELECT category, count(*) AS runs, count(DISTINCT source_id) AS sources, {_MEAN} AS mean_ms FROM runs GROUP BY category",
    "hourly_trend": f"WITH {RUNS} SELECT strftime(date_trunc('hour', started_at), '%Y-%m-%dT%H:00:00Z') AS bucket, {_COUNTS}, {_MEAN} AS mean_ms, {_RATE} FROM runs GROUP BY 1",
    "daily_trend": f"WITH {RUNS} SELECT strftime(started_at, '%Y-%m-%d') AS bucket, {_COUNTS}, {_MEAN} AS mean_ms, {_RATE} FROM runs GROUP BY 1",
    "error_distribution": f"""WITH {RUNS}, k AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM runs WHERE status = 'failed'),
        e AS (SELECT 'kind_' || (k // 10) AS key, 1 AS v FROM k UNION ALL SELECT 'all', k FROM k) SELECT key, sum(v)::BIGINT AS total FROM e GROUP BY key ORDER BY total DESC, key LIMIT 20""",
    "dashboard_facets": "SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (c_acctbal < 0) AS error, count(*) FILTER (c_acctbal IS NULL) AS unknown FROM customer",
    "last_runs_rate": f"WITH {RUNS}, l AS (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 100) SELECT {_COUNTS}, round(count(*) FILTER (status = 'success') * 100.0::DOUBLE / count(*), 1) AS success_rate FROM l",
    "sla_levels": _SLA_SQL,
    "freshness_states": _FRESH_SQL,
    "freshness_summary": f"SELECT state, count(*) AS sources, round(avg(age_hours), 2) AS mean_age FROM ({_FRESH_SQL}) GROUP BY state",
    "expected_intervals": _INTERVAL_SQL,
    "failures_in_a_row": f"""WITH {RUNS}, s AS (SELECT source_id, row_number() OVER o AS n, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC ROWS UNBOUNDED PRECEDING) AS ok
        FROM runs WINDOW o AS (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC)) SELECT source_id, count(*) FILTER (ok = 0) AS failures FROM s WHERE n <= 10 GROUP BY source_id""",
    "quality_change": f"""WITH {RUNS}, w AS (SELECT ms, started_at >= TIMESTAMP '2024-01-19' AS now FROM runs WHERE started_at >= TIMESTAMP '2024-01-18' AND started_at < TIMESTAMP '2024-01-20'),
        v AS (SELECT round(CAST(sum(CAST(ms AS DECIMAL(24,6))) FILTER (now) AS DOUBLE) / count(ms) FILTER (now), 4) AS current, round(CAST(sum(CAST(ms AS DECIMAL(24,6))) FILTER (NOT now) AS DOUBLE) / count(ms) FILTER (NOT now), 4) AS previous FROM w)
        SELECT *, CASE WHEN current - previous IS NULL THEN 'unknown' WHEN current - previous > 0.5 THEN 'up' WHEN current - previous < -0.5 THEN 'down' ELSE 'stable' END AS trend FROM v""",
    "source_trends": f"""WITH {RUNS}, v AS (SELECT source_id, count(*) AS runs, arg_min(ms, row(started_at, run_id)) AS first, arg_max(ms, row(started_at, run_id)) AS last FROM runs GROUP BY source_id)
        SELECT *, CASE WHEN last - first > 5 THEN 'improving' WHEN last - first < -5 THEN 'declining' ELSE 'stable' END AS trend FROM v""",
    "source_scores": f"""WITH {RUNS}, s AS ({_SOURCES}), f AS (SELECT source_id, state FROM ({_FRESH_SQL.replace('WITH ' + RUNS + ',', 'WITH')}))
        SELECT source_id, round(0.3::DOUBLE * success_rate + 0.25::DOUBLE * least(mean_ms, 100.0::DOUBLE) + 0.25::DOUBLE * CASE state WHEN 'fresh' THEN 100 WHEN 'stale' THEN 50 ELSE 0 END + 0.2::DOUBLE * least(100.0::DOUBLE, total * 10 / total::DOUBLE), 1) AS score
        FROM s JOIN f USING (source_id)""",
    "alert_hits": f"""WITH {RUNS}, s AS ({_SOURCES}), h AS (SELECT 'slow' AS rule, 'warning' AS severity FROM s WHERE mean_ms > 20 UNION ALL SELECT 'failing', 'error' FROM s WHERE success_rate < 18
        UNION ALL SELECT 'odd', 'info' FROM s WHERE regexp_matches(source_id::VARCHAR, '^1.3$')) SELECT rule, severity, count(*) AS sources FROM h GROUP BY ALL""",
    "alert_bursts": f"""WITH RECURSIVE {RUNS}, f AS (SELECT source_id, started_at AS t, row_number() OVER (PARTITION BY source_id ORDER BY started_at) AS i FROM runs WHERE status = 'failed'),
        s AS (SELECT source_id, i, t FROM f WHERE i = 1 UNION ALL SELECT f.source_id, min(f.i), min(f.t) FROM s JOIN f ON f.source_id = s.source_id AND f.i > s.i AND f.t >= s.t + INTERVAL 10 HOUR GROUP BY f.source_id)
        SELECT source_id, count(*) AS bursts FROM s GROUP BY source_id""",
    "alert_throttle": f"""WITH RECURSIVE {RUNS}, f AS (SELECT source_id, started_at AS t, row_number() OVER (PARTITION BY source_id ORDER BY started_at) AS i FROM runs WHERE status = 'failed'),
        s AS (SELECT source_id, i, t, NULL::TIMESTAMP AS before FROM f WHERE i = 1 UNION ALL
              SELECT f.source_id, min(f.i), min(f.t), min(s.t) FROM s JOIN f ON f.source_id = s.source_id AND f.i > s.i AND (s.before IS NULL OR f.t >= s.before + INTERVAL 1 DAY) GROUP BY f.source_id),
        c AS (SELECT source_id, count(*) AS sent FROM s GROUP BY source_id) SELECT source_id, sent, count(*) AS fired FROM f JOIN c USING (source_id) GROUP BY source_id, sent""",
    "time_histogram": f"""WITH {RUNS} SELECT status, le::DOUBLE AS le, count(*) FILTER (le IS NULL OR ms <= le) AS n FROM runs, (VALUES (1), (5), (10), (25), (50), (NULL)) b(le) GROUP BY ALL""",
    "metric_lines": f"""WITH {RUNS} SELECT 'runs_total{{status="' || status || '",category="' || category || '"}} ' || count(*) AS line FROM runs GROUP BY status, category""",
    "review_facets": f"""WITH {REVIEWS} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected,
        count(*) FILTER (needs_number_review) AS needs_number_review, round(CAST(sum(CAST(confidence AS DECIMAL(24,6))) AS DOUBLE) / count(confidence), 4) AS mean_confidence FROM reviews""",
    "review_trends": f"""WITH {REVIEWS}, g AS (SELECT CAST(created_at AS DATE) AS day, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected FROM reviews GROUP BY 1),
        c AS (SELECT CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM g)
        SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(pending, 0) AS pending, coalesce(approved, 0) AS approved, coalesce(rejected, 0) AS rejected FROM c LEFT JOIN g USING (day)""",
    "review_queue": f"WITH {REVIEWS} SELECT review_id, source_id, confidence FROM reviews WHERE status = 'pending' ORDER BY needs_number_review DESC, confidence, created_at, review_id LIMIT 20 OFFSET 20",
    "review_by_source": f"WITH {REVIEWS} SELECT source_id, count(*) AS n, count(*) FILTER (status = 'approved') AS approved FROM reviews GROUP BY source_id ORDER BY n DESC, source_id LIMIT 5",
    "review_neighbours": f"WITH {REVIEWS} SELECT review_id, lead(review_id) OVER o AS next_id, lag(review_id) OVER o AS previous_id, CAST(row_number() OVER o AS INTEGER) AS place FROM reviews WINDOW o AS (PARTITION BY source_id ORDER BY created_at, review_id)",
    "sources_with_runs": """WITH p AS (SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 50 OFFSET 10), c AS (SELECT o_custkey, count(*) AS orders, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY 1)
        SELECT c_custkey, c_name, coalesce(orders, 0) AS orders, newest FROM p LEFT JOIN c ON c_custkey = o_custkey""",
    "code_groups": "SELECT r_regionkey, r_name, count(n_nationkey) AS codes FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_nationkey % 2 = 0 GROUP BY ALL",
    "recent_activity": """WITH r AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) SELECT o_orderkey, coalesce(c_name, 'Unknown') AS source, coalesce(n_name, 'Unknown') AS nation
        FROM r LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "newest_per_source": f"""WITH {RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS place FROM runs)
        SELECT source_id, count(*) AS runs, {_MEAN} AS mean_ms, count(*) FILTER (status = 'failed') AS failed FROM n WHERE place <= 10 GROUP BY source_id""",
    "retention": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
        SELECT o_custkey, count(*) AS expired FROM n WHERE n > 3 AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1""",
    "domain_stats": """SELECT 'orders' AS domain, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS newest FROM orders UNION ALL SELECT 'lineitem', count(*), strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem
        UNION ALL SELECT 'events', count(*), strftime(max(ts), '%Y-%m-%d') FROM events""",
    "status_rollup": """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(24,6))) AS DOUBLE), 2) AS value, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INTEGER) AS level
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "stale_sources": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-01-01')",
}
