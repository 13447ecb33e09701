"""Queries on trends, histories, ledgers, versions, health and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import history as h
from tributary.plans import graphs
from tributary.plans.common import RUNS, as_of, runs
from tributary.session import table

STEPS = ("crawl", "transform", "validate", "load")


def freshness_trend(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("ms") <= 25, "fresh").when(F.col("ms") <= 50, "stale").otherwise("critical")
    return h.freshness_trend(runs(spark, d).select(F.col("started_at").alias("evaluated_at"), F.col("ms").alias("age_hours"), status.alias("status")))


def change_totals(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("run_id") % 100 + 1
    log = runs(spark, d).select("source_id", F.col("started_at").alias("logged_at"), total.alias("total"), F.floor(total / 4).alias("new"), F.floor(total / 5).alias("modified"), "ms")
    log = log.withColumn("unchanged", F.col("total") - F.col("new") - F.col("modified"))
    return h.change_totals(log.withColumn("skip_ratio", F.col("unchanged") * 100.0 / F.col("total")), as_of(), 10)


def _diffs(spark, d):
    k = F.col("o_orderkey")
    fields = F.create_map("o_orderpriority", F.lit(1).cast("long"), F.concat(F.lit("status_"), "o_orderstatus"), k % 4)
    return table(spark, d, "orders").select((k % 7).alias("added"), (k % 3).alias("deleted"), (k % 5).alias("modified"), (k % 100 / 100.0).alias("change_rate"), fields.alias("fields"))


def diff_trends(spark: SparkSession, d: str) -> DataFrame:
    return h.diff_trends(_diffs(spark, d))


def changed_most(spark: SparkSession, d: str) -> DataFrame:
    return h.changed_most(_diffs(spark, d), 6)


def registered_schemas(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"))
    return h.registered(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("version"), made.alias("created_at")))


def catalog_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = {"mean_null_rate": k % 30, "records": F.col("p_size"), "errors": k % 5, "accuracy": k % 100, "consistency": 100 - F.col("p_size"), "timeliness": F.lit(50), "uniqueness": 90 - k % 2}
    entries = table(spark, d, "part").select(k.alias("id"), *[(F.when(k % 11 > 0, c) if n == "mean_null_rate" else c).cast("double").alias(n) for n, c in parts.items()])
    return h.catalog_scores(entries).select("id", "completeness", "validity", "overall")


def system_health(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    rate = lambda test: F.round(F.count_if(test) * 100.0 / F.count("*"), 2)
    levels = runs(spark, d).groupBy("category").agg(
        rate(s != "failed").alias("success_rate"), rate(F.col("ms") < 60).alias("compliance_rate"), F.count_if(F.col("ms") > 400).alias("critical_sources"), F.count_if(F.col("ms") > 100).alias("stale_sources"),
        F.count_if(s == "failed").alias("critical_alerts"), F.count_if(F.col("ms") > 90).alias("active_alerts"),
    )
    return h.system_health(levels).select("category", "metrics", "freshness", "sla", "alerts", "score", "status")


def _history(spark, d):
    return runs(spark, d).select(F.col("run_id").alias("id"), "source_id", F.col("category").alias("action"), F.col("started_at").alias("timestamp"), F.col("props").alias("message"))


def history_page(spark: SparkSession, d: str) -> DataFrame:
    return h.entries(_history(spark, d), {"source_id": None}, ["view", "error"], "2024-01-03", "2024-01-25", text="1", limit=50, skip=10).select("id", "source_id", "action")


def crawlers_to_back_up(spark: SparkSession, d: str) -> DataFrame:
    crawlers = table(spark, d, "part").select(F.col("p_partkey").alias("crawler_id"), F.col("p_size").cast("long").alias("version"))
    return h.versions_to_back_up(crawlers, table(spark, d, "lineitem").where("l_linenumber < 4").select(F.col("l_partkey").alias("crawler_id"), (F.col("l_linenumber") * 10).cast("long").alias("version")))


def _saves(spark, d):
    return runs(spark, d).select("source_id", F.col("category").alias("branch"), F.col("started_at").alias("created_at"), F.col("run_id").alias("save_id"))


def numbered_versions(spark: SparkSession, d: str) -> DataFrame:
    return h.numbered_versions(_saves(spark, d)).select("save_id", "source_id", "branch", "version_number", "parent", "status")


def restore_chains(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("run_id")
    kind = F.when(k % 10 == 0, "full").when(k % 3 == 0, "differential").otherwise("incremental")
    return h.restore_chains(runs(spark, d).select("source_id", F.col("started_at").alias("taken_at"), k.alias("snapshot_id"), kind.alias("kind"))).select("snapshot_id", "base_id", F.col("depth").cast("long").alias("depth"))


def run_keys(spark: SparkSession, d: str) -> DataFrame:
    params = F.create_map(F.lit("type"), "category", F.lit("k"), F.get_json_object("props", "$.k"))
    key = h.run_key(F.col("source_id").cast("string"), F.lit("crawl"), params, F.col("started_at"))
    return runs(spark, d).select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def run_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).select(F.col("source_id").alias("key"), F.col("run_id").alias("owner"), "started_at", "category")
    asked = rows.where("category = 'view'").select("key", "owner", F.col("started_at").alias("asked_at"))
    ledger = rows.where("category = 'purchase'").select("key", "owner", F.when(F.col("owner") % 3 == 0, "completed").otherwise("running").alias("status"), F.col("started_at").alias("updated_at"))
    return h.claimed(asked, ledger, as_of(), 14_400).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("owner").alias("owners"))


def resume_points(spark: SparkSession, d: str) -> DataFrame:
    step = F.element_at(F.array(*map(F.lit, STEPS)), (F.col("run_id") % 4 + 1).cast("int"))
    ledger = runs(spark, d).select(F.concat_ws(":", "source_id", F.date_format("started_at", "yyyy-MM-dd")).alias("key"), step.alias("step"), F.when(F.col("status") == "failed", "failed").otherwise("completed").alias("status"), F.col("run_id").alias("updated_at"))
    return h.resume_points(ledger, STEPS)


def job_progress(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "R", "failed").otherwise("pending")
    return h.job_progress(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), status.alias("status")))


def _validations(spark, d):
    return runs(spark, d).select(F.col("category").alias("contract"), F.col("started_at").alias("validated_at"), (F.col("ms") < 50).alias("success"), (F.col("run_id") % 3).alias("failed_expectations"))


def contract_days(spark: SparkSession, d: str) -> DataFrame:
    return h.contract_days(_validations(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def contract_health(spark: SparkSession, d: str) -> DataFrame:
    return h.contract_health(_validations(spark, d), as_of())


def contract_report(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "part").select(
        F.col("p_brand").alias("contract"), F.concat(F.lit("rule_"), F.col("p_partkey").cast("string")).alias("expectation"), F.lit("size").alias("column"), (F.col("p_size") > 10).alias("success"), (F.col("p_partkey") % 50).alias("failed_rows")
    )
    return h.contract_report(results)


def _errors(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return runs(spark, d).where("status = 'failed'").select(
        F.concat(F.lit("E"), F.floor(k / 10).cast("string")).alias("error_code"), F.col("props").alias("message"), "source_id", F.col("started_at").alias("occurred_at"), F.col("run_id").alias("error_id"), (F.col("run_id") % 4 == 0).alias("resolved")
    )


def error_codes(spark: SparkSession, d: str) -> DataFrame:
    return h.error_codes(_errors(spark, d)).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


def unresolved_sources(spark: SparkSession, d: str) -> DataFrame:
    return h.unresolved_sources(_errors(spark, d))


def source_report(spark: SparkSession, d: str) -> DataFrame:
    return h.source_report(graphs.impact(spark, d))


def likely_causes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(h.diagnosis(F.col("text")).alias("cause")).agg(F.count("*").alias("n"))


def collection_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(h.collection_kind(F.col("html"), F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


_NAMES = tuple(dict.fromkeys(n for own in h.INDICATORS.values() for n in own))


def field_categories(spark: SparkSession, d: str) -> DataFrame:
    fields = F.slice(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"), (F.col("p_size") % 8).cast("int"))
    return table(spark, d, "part").select("p_partkey", h.field_category(fields).alias("category"))


def page_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each page against the one with the next id."""
    pages = table(spark, d, "pages").select("page_id", "html")
    both = pages.toDF("page_id", "before").join(pages.select((F.col("page_id") - 1).alias("page_id"), F.col("html").alias("after")), "page_id")
    out = h.page_changes(both, "before", "after")
    text = lambda c: F.array_join(c, ",")
    tags = F.transform("tag_changes", lambda x: F.concat(x.tag, F.lit(":"), x.before.cast("string"), F.lit(">"), x.after.cast("string")))
    return out.select("page_id", text("removed_ids").alias("removed_ids"), text("added_ids").alias("added_ids"), F.size("removed_classes").alias("removed_classes"), text(tags).alias("tags"), "structure_changed")


def events_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Events to JSON and back, each kind by its own schema."""
    rows = runs(spark, d).select(F.col("run_id").alias("event_id"), F.concat(F.when(F.col("status") == "failed", "crawl").when(F.col("status") == "success", "data").otherwise("odd"), F.lit("."), "category").alias("event_type"), "source_id", "ms")
    back = h.deserialized(h.serialized(rows), {"crawl": "source_id long, ms double", "data": "source_id long, ms double"})
    typed = back["crawl"].unionByName(back["data"]).select("event_type", "source_id")
    rest = back["other"].select("event_type", F.get_json_object("payload", "$.source_id").cast("long").alias("source_id"))
    return typed.unionByName(rest).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("source_id").alias("sources"))


def page_encodings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(h.encoding_of(F.col("html").cast("binary")).alias("encoding")).agg(F.count("*").alias("n"))


def document_tables(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as small documents, read back by a parser of bars and lines."""
    text = F.concat(F.lit("|\n Supplier Key |junk|Name\n\n"), F.col("s_suppkey").cast("string"), F.lit("|x|"), "s_name", F.lit("\n|| \n"), F.col("s_nationkey").cast("string"), F.lit("|y"))
    documents = table(spark, d, "supplier").select("s_suppkey", F.encode(text, "utf-8").alias("content"))
    return h.tables_of(documents, "s_suppkey", "content", lambda data: [[line.split("|") for line in data.decode().split("\n")]], ["supplier_key", "name"])


QUERIES = {
    f.__name__: f
    for f in (
        freshness_trend, change_totals, diff_trends, changed_most, registered_schemas, catalog_scores, system_health, history_page, crawlers_to_back_up, numbered_versions, restore_chains,
        run_keys, run_claims, resume_points, job_progress, contract_days, contract_health, contract_report, error_codes, unresolved_sources, source_report, likely_causes, collection_kinds,
        field_categories, page_changes, events_by_prefix, page_encodings, document_tables,
    )
}
_MEAN = "CAST(sum(CAST({} AS DECIMAL(24,6))) AS DOUBLE) / count({})"
_ERRORS = f"""{RUNS}, e AS (SELECT 'E' || (CAST(json_extract(props, '$.k') AS INTEGER) // 10) AS error_code, props AS message, source_id, started_at, run_id, run_id % 4 = 0 AS resolved FROM runs WHERE status = 'failed')"""
_VALID = f"{RUNS}, v AS (SELECT category AS contract, started_at AS t, ms < 50 AS ok, run_id % 3 AS bad FROM runs)"


def _has(column: str, words) -> str:
    return " OR ".join(f"contains({column}, '{w}')" for w in words)


def _ladder(column: str, ladder, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(column, words)} THEN '{name}'" for name, words in ladder) + f" ELSE '{other}' END"


_LISTS = ", ".join(f"('{name}', {i}, [{', '.join(repr(f) for f in own)}])" for i, (name, own) in enumerate(h.INDICATORS.items()))
_ATTR = r"""array_to_string(regexp_extract_all({}, '(?is)<[a-z][^<>]*?\s{}\s*=\s*["'']([^"'']*)["'']', 1), ' ')"""
_MARKS = "list_sort(list_distinct(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')))"
_COUNT = "len(regexp_extract_all({}, '(?i)<{}[\\s>/]'))"
ORACLE = {
    "freshness_trend": f"""WITH {RUNS} SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) FILTER (ms <= 25) AS fresh, count(*) FILTER (ms > 25 AND ms <= 50) AS stale, count(*) FILTER (ms > 50 OR ms IS NULL) AS critical,
        round({_MEAN.format('ms', 'ms')}, 2) AS mean_age_hours, round(count(*) FILTER (ms <= 25) * 100.0::DOUBLE / count(*), 2) AS health_rate FROM runs GROUP BY 1""",
    "change_totals": f"""WITH {RUNS}, l AS (SELECT source_id, run_id % 100 + 1 AS total, (run_id % 100 + 1) // 4 AS new, (run_id % 100 + 1) // 5 AS modified, ms FROM runs WHERE started_at >= TIMESTAMP '2024-01-21' AND started_at <= TIMESTAMP '2024-01-31'),
        k AS (SELECT *, total - new - modified AS unchanged, (total - new - modified) * 100.0::DOUBLE / total AS skip FROM l)
        SELECT source_id, count(*) AS runs, sum(total)::BIGINT AS total, sum(new)::BIGINT AS new, sum(modified)::BIGINT AS modified, sum(unchanged)::BIGINT AS unchanged, round({_MEAN.format('skip', 'skip')}, 1) AS mean_skip_ratio,
        CAST(sum(CAST(ms AS DECIMAL(24,6))) AS DOUBLE) AS ms, round(sum(unchanged) * 100.0::DOUBLE / greatest(sum(total), 1), 1) AS saved FROM k GROUP BY source_id""",
    "diff_trends": f"""WITH k AS (SELECT o_orderkey AS k, (o_orderkey % 100) / 100.0::DOUBLE AS r FROM orders) SELECT count(*) AS diffs, sum(k % 7)::BIGINT AS added, sum(k % 3)::BIGINT AS deleted, sum(k % 5)::BIGINT AS modified,
        round({_MEAN.format('r', 'r')} * 100, 2) AS mean_rate, (sum(k % 7) - sum(k % 3))::BIGINT AS growth FROM k""",
    "changed_most": "SELECT field, sum(n)::BIGINT AS n FROM (SELECT o_orderpriority AS field, 1 AS n FROM orders UNION ALL SELECT 'status_' || o_orderstatus, o_orderkey % 4 FROM orders) GROUP BY field ORDER BY n DESC, field LIMIT 6",
    "registered_schemas": "SELECT p_brand AS name, count(*) AS versions, max(p_size) AS latest_version, min(t) AS created_at, max(t) AS updated_at FROM (SELECT *, '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS t FROM part) GROUP BY 1",
    "catalog_scores": """WITH e AS (SELECT p_partkey AS id, round(100 - coalesce(CASE WHEN p_partkey % 11 > 0 THEN (p_partkey % 30)::DOUBLE END, 0), 2) AS completeness,
            round(CASE WHEN p_size > 0 THEN greatest(0, 100 - (p_partkey % 5)::DOUBLE / p_size::DOUBLE * 100) ELSE 100 END, 2) AS validity, (p_partkey % 100)::DOUBLE AS accuracy, (100 - p_size)::DOUBLE AS consistency, (90 - p_partkey % 2)::DOUBLE AS uniqueness FROM part)
        SELECT id, completeness, validity, CAST(round(CAST(completeness AS DECIMAL(12,4)) * CAST(0.2 AS DECIMAL(3,2)) + CAST(accuracy AS DECIMAL(12,4)) * CAST(0.25 AS DECIMAL(3,2)) + CAST(consistency AS DECIMAL(12,4)) * CAST(0.15 AS DECIMAL(3,2)) + CAST(50 AS DECIMAL(12,4)) * CAST(0.1 AS DECIMAL(3,2)) + CAST(uniqueness AS DECIMAL(12,4)) * CAST(0.15 AS DECIMAL(3,2)) + CAST(validity AS DECIMAL(12,4)) * CAST(0.15 AS DECIMAL(3,2)), 2) AS DOUBLE) AS overall FROM e""",
    "system_health": f"""WITH {RUNS}, l AS (SELECT category, round(count(*) FILTER (status <> 'failed') * 100.0::DOUBLE / count(*), 2) AS ok, round(count(*) FILTER (ms < 60) * 100.0::DOUBLE / count(*), 2) AS sla, count(*) FILTER (ms > 400) AS c, count(*) FILTER (ms > 100) AS s,
            count(*) FILTER (status = 'failed') AS ca, count(*) FILTER (ms > 90) AS aa FROM runs GROUP BY category),
        t AS (SELECT category, CASE WHEN ok < 80 THEN 'unhealthy' WHEN ok < 95 THEN 'degraded' ELSE 'healthy' END AS metrics, CASE WHEN c > 0 THEN 'unhealthy' WHEN s > 0 THEN 'degraded' ELSE 'healthy' END AS freshness,
            CASE WHEN sla < 90 THEN 'unhealthy' WHEN sla < 95 THEN 'degraded' ELSE 'healthy' END AS sla, CASE WHEN ca > 0 THEN 'unhealthy' WHEN aa > 5 THEN 'degraded' ELSE 'healthy' END AS alerts FROM l)
        SELECT *, round(list_sum(list_transform([metrics, freshness, sla, alerts], lambda x: CASE x WHEN 'healthy' THEN 100 WHEN 'degraded' THEN 70 ELSE 30 END)) / 4.0::DOUBLE, 1) AS score,
            CASE WHEN list_contains([metrics, freshness, sla, alerts], 'unhealthy') THEN 'unhealthy' WHEN list_contains([metrics, freshness, sla, alerts], 'degraded') THEN 'degraded' ELSE 'healthy' END AS status FROM t""",
    "history_page": f"""WITH {RUNS} SELECT run_id AS id, source_id, category AS action FROM runs WHERE category IN ('view', 'error') AND started_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25' AND contains(lower(props), '1') ORDER BY started_at DESC, run_id DESC LIMIT 50 OFFSET 10""",
    "crawlers_to_back_up": """WITH l AS (SELECT l_partkey, max(l_linenumber * 10)::BIGINT AS v FROM lineitem WHERE l_linenumber < 4 GROUP BY 1)
        SELECT p_partkey AS crawler_id, p_size::BIGINT AS version, coalesce(v, 0) AS last_version, CASE WHEN v IS NULL THEN 'initial' ELSE 'update' END AS kind FROM part LEFT JOIN l ON l_partkey = p_partkey WHERE v IS NULL OR v < p_size""",
    "numbered_versions": f"""WITH {RUNS}, n AS (SELECT run_id AS save_id, source_id, category AS branch, CAST(row_number() OVER w AS INTEGER) AS version_number, lead(1) OVER w IS NULL AS last FROM runs WINDOW w AS (PARTITION BY source_id, category ORDER BY started_at, run_id))
        SELECT save_id, source_id, branch, version_number, CASE WHEN version_number > 1 THEN version_number - 1 END AS parent, CASE WHEN last THEN 'active' ELSE 'archived' END AS status FROM n""",
    "restore_chains": f"""WITH {RUNS}, k AS (SELECT source_id, started_at, run_id, CASE WHEN run_id % 10 = 0 THEN 'full' WHEN run_id % 3 = 0 THEN 'differential' ELSE 'incremental' END AS kind FROM runs),
        b AS (SELECT *, last_value(CASE WHEN kind = 'full' THEN run_id END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base_id FROM k),
        c AS (SELECT *, count(*) FILTER (kind = 'incremental') OVER (PARTITION BY source_id, base_id ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS steps FROM b)
        SELECT run_id AS snapshot_id, base_id, CASE WHEN base_id IS NULL THEN NULL WHEN kind = 'full' THEN 1 WHEN kind = 'differential' THEN 2 ELSE steps + 1 END::BIGINT AS depth FROM c""",
    "run_keys": f"""WITH {RUNS} SELECT source_id || ':crawl:' || substr(sha256('{{"k":"_date"}}{{"v":"' || strftime(started_at, '%Y-%m-%d') || '"}},{{"k":"k"}}{{"v":"' || CAST(json_extract(props, '$.k') AS VARCHAR) || '"}},{{"k":"type"}}{{"v":"' || category || '"}}'), 1, 16) AS key, count(*) AS n FROM runs GROUP BY 1""",
    "run_claims": f"""WITH {RUNS}, l AS (SELECT source_id, arg_max(row(run_id, started_at), row(started_at, run_id)) AS r FROM runs WHERE category = 'purchase' GROUP BY source_id),
        a AS (SELECT source_id, run_id, row_number() OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS n FROM runs WHERE category = 'view'),
        o AS (SELECT run_id, CASE WHEN r[1] % 3 = 0 THEN 'done' WHEN coalesce(r[2] > TIMESTAMP '2024-01-21', false) OR n > 1 THEN 'held' ELSE 'acquired' END AS outcome FROM a LEFT JOIN l USING (source_id))
        SELECT outcome, count(*) AS n, sum(run_id)::BIGINT AS owners FROM o GROUP BY outcome""",
    "resume_points": f"""WITH {RUNS}, s AS (SELECT source_id || ':' || strftime(started_at, '%Y-%m-%d') AS key, ['crawl', 'transform', 'validate', 'load'][run_id % 4 + 1] AS step, arg_max(status, run_id) = 'failed' AS bad FROM runs GROUP BY 1, 2),
        g AS (SELECT key, coalesce(list(step) FILTER (NOT bad), []) AS ok, bool_or(bad) AS failed FROM s GROUP BY key)
        SELECT key, len(ok)::INTEGER AS done, list_filter(['crawl', 'transform', 'validate', 'load'], lambda x: NOT list_contains(ok, x))[1] AS next_step, failed FROM g""",
    "job_progress": """WITH j AS (SELECT l_orderkey AS job_id, count(*) AS total, count(*) FILTER (l_returnflag IN ('A', 'R')) AS processed, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1)
        SELECT *, round(processed * 100.0::DOUBLE / total, 2) AS percent, CASE WHEN processed < total THEN 'running' WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS state FROM j""",
    "contract_days": f"""WITH {_VALID}, g AS (SELECT contract, strftime(t, '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (ok) AS passed, sum(bad)::BIGINT AS failed_expectations, round(count(*) FILTER (ok) * 100.0::DOUBLE / count(*), 2) AS success_rate FROM v GROUP BY ALL)
        SELECT *, round(success_rate - lag(success_rate) OVER (PARTITION BY contract ORDER BY day), 2) AS change FROM g""",
    "contract_health": f"""WITH {_VALID}, k AS (SELECT *, t <= TIMESTAMP '2024-01-31' AND t >= TIMESTAMP '2024-01-01' AS a, t <= TIMESTAMP '2024-01-31' AND t >= TIMESTAMP '2024-01-24' AS b FROM v),
        g AS (SELECT contract, round(count(*) FILTER (ok AND a) * 100.0::DOUBLE / nullif(count(*) FILTER (a), 0), 2) AS rate_30d, round(count(*) FILTER (ok AND b) * 100.0::DOUBLE / nullif(count(*) FILTER (b), 0), 2) AS rate_7d FROM k GROUP BY contract)
        SELECT *, CASE WHEN rate_7d - rate_30d IS NULL THEN 'unknown' WHEN rate_7d - rate_30d > 5 THEN 'improving' WHEN rate_7d - rate_30d < -5 THEN 'declining' ELSE 'stable' END AS trend FROM g""",
    "contract_report": """WITH g AS (SELECT p_brand AS contract, count(*) AS n, count(*) FILTER (p_size > 10) AS ok FROM part GROUP BY 1)
        SELECT contract, 0 AS place, contract || ': ' || CASE WHEN ok = n THEN 'PASSED' ELSE 'FAILED' END || ' (' || ok || ' of ' || n || ' expectations)' AS line FROM g
        UNION ALL SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 50 DESC, 'rule_' || p_partkey) AS INTEGER), '- rule_' || p_partkey || ' on size: ' || (p_partkey % 50) || ' rows' FROM part WHERE p_size <= 10""",
    "error_codes": f"""WITH {_ERRORS} SELECT error_code, count(*) AS n, count(*) FILTER (NOT resolved) AS unresolved, arg_min(message, row(started_at, run_id)) AS first_message, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last_at, count(DISTINCT source_id) AS sources FROM e GROUP BY error_code""",
    "unresolved_sources": f"WITH {_ERRORS} SELECT source_id, count(*) AS n FROM e WHERE NOT resolved GROUP BY source_id ORDER BY n DESC, source_id LIMIT 10",
    "source_report": f"SELECT type, sum(n)::BIGINT AS n, min(distance) AS nearest, coalesce(sum(n) FILTER (level = 'critical'), 0)::BIGINT AS critical FROM ({graphs.ORACLE['impact_levels']}) GROUP BY type",
    "likely_causes": f"SELECT {_ladder('lower(text)', h.CAUSES, 'unknown')} AS cause, count(*) AS n FROM documents GROUP BY 1",
    "collection_kinds": f"SELECT {_ladder('(lower(html) || chr(10) || lower(url))', h.KINDS, 'generic')} AS kind, count(*) AS n FROM pages GROUP BY 1",
    "field_categories": f"""WITH f AS (SELECT p_partkey, list_slice([{', '.join(repr(n) for n in _NAMES)}], p_partkey % {len(_NAMES)} + 1, p_partkey % {len(_NAMES)} + p_size % 8) AS fields FROM part), i(name, place, own) AS (VALUES {_LISTS}),
        s AS (SELECT p_partkey, name, place, len(list_intersect(fields, own)) / len(own)::DOUBLE AS share FROM f, i), b AS (SELECT p_partkey, max(row(share, -place, name)) AS m FROM s GROUP BY p_partkey)
        SELECT p_partkey, CASE WHEN m[1] >= 0.3 THEN m[3] ELSE 'generic' END AS category FROM b""",
    "page_changes": f"""WITH p AS (SELECT a.page_id, a.html AS x, b.html AS y FROM pages a JOIN pages b ON b.page_id = a.page_id + 1),
        m AS (SELECT page_id, {_MARKS.format(_ATTR.format('x', 'id'))} AS xi, {_MARKS.format(_ATTR.format('y', 'id'))} AS yi, {_MARKS.format(_ATTR.format('x', 'class'))} AS xc, {_MARKS.format(_ATTR.format('y', 'class'))} AS yc,
            list_filter([{', '.join(f"CASE WHEN {_COUNT.format('x', t)} <> {_COUNT.format('y', t)} THEN '{t}:' || {_COUNT.format('x', t)} || '>' || {_COUNT.format('y', t)} END" for t in h.TAGS)}], lambda z: z IS NOT NULL) AS tags FROM p),
        c AS (SELECT page_id, list_filter(xi, lambda z: NOT list_contains(yi, z)) AS ri, list_filter(yi, lambda z: NOT list_contains(xi, z)) AS ai, len(list_filter(xc, lambda z: NOT list_contains(yc, z))) AS rc, tags FROM m)
        SELECT page_id, coalesce(array_to_string(ri, ','), '') AS removed_ids, coalesce(array_to_string(ai, ','), '') AS added_ids, rc::INTEGER AS removed_classes, coalesce(array_to_string(tags, ','), '') AS tags, len(ri) > 0 OR rc > 5 OR len(tags) > 3 AS structure_changed FROM c""",
    "events_by_prefix": f"WITH {RUNS} SELECT CASE status WHEN 'failed' THEN 'crawl' WHEN 'success' THEN 'data' ELSE 'odd' END || '.' || category AS event_type, count(*) AS n, sum(source_id)::BIGINT AS sources FROM runs GROUP BY 1",
    "page_encodings": """SELECT coalesce(nullif(regexp_extract(lower(left(html, 2048)), '(?:charset|encoding)\\s*=\\s*["'']?([a-z0-9_-]+)', 1), ''), 'utf-8') AS encoding, count(*) AS n FROM pages GROUP BY 1""",
    "document_tables": """SELECT s_suppkey, 0 AS "table", 0 AS "row", s_suppkey::VARCHAR AS supplier_key, s_name AS name FROM supplier UNION ALL SELECT s_suppkey, 0, 1, s_nationkey::VARCHAR, NULL FROM supplier""",
}
