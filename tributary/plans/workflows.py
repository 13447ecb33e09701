"""Queries on reviews, decisions, cascades, versions, activity and kinds of content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import pages as pg
from tributary.operators import workflow as w
from tributary.operators.history import numbered_versions
from tributary.plans.common import REVIEWS, RUNS, reviews, runs
from tributary.session import table
from tributary.sources.files import union_all


def new_reviews(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(x.role.alias("role"), (x.turn / 10).alias("confidence")))
    results = turns.groupBy(F.col("conv_id").alias("result_id")).agg(items.alias("data"))
    known = turns.where("turn % 2 = 0").select(F.col("conv_id").alias("result_id"), F.col("turn").cast("int").alias("item_index"))
    return w.new_reviews(results, known)


def bulk_decisions(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.range(0, 400, 3).select(F.col("id").alias("review_id"))
    done, failed = w.decide(reviews(spark, d), ids, "approved")
    out = done.groupBy("status").agg(F.count("*").alias("n")).unionByName(failed.groupBy(F.concat(F.lit("failed: "), "reason").alias("status")).agg(F.count("*").alias("n")))
    return out


def filtered_decisions(spark: SparkSession, d: str) -> DataFrame:
    test = (F.col("confidence") >= 0.7) & (F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz")) & F.col("source_id").isin("src0", "src1")
    return w.decide_where(reviews(spark, d), test, "approved").groupBy("source_id", "status").agg(F.count("*").alias("n"))


def cascaded(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("source_id"))
    left = w.without_sources({"customer": (table(spark, d, "customer"), "c_custkey"), "orders": (table(spark, d, "orders"), "o_custkey")}, gone)
    return union_all([rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, rows in left.items()])


def resolved_errors(spark: SparkSession, d: str) -> DataFrame:
    errors = runs(spark, d).where("status = 'failed'").select("source_id", "started_at", (F.col("run_id") % 4 == 0).alias("resolved"), F.when(F.col("run_id") % 4 == 0, "2024-01-30").alias("resolved_at"))
    return w.resolve(errors, F.col("source_id") < 50, F.lit("2024-01-31")).groupBy("resolved", "resolved_at").agg(F.count("*").alias("n"))


def latest_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).select(F.col("source_id").alias("sla_id"), F.when(F.col("source_id") % 2 == 0, "latency").otherwise("success_rate").alias("kind"), "status", F.struct("started_at", "run_id").alias("evaluated_at"))
    return w.latest_states(rows)


def _history(spark, d):
    return runs(spark, d).select(F.col("category").alias("action"), (F.col("source_id") % 20).cast("string").alias("actor"), F.col("started_at").alias("timestamp"), (F.col("status") != "failed").alias("success"))


def activity_timeline(spark: SparkSession, d: str) -> DataFrame:
    return w.activity(_history(spark, d), "hour", "yyyy-MM-dd HH:00")


def history_totals(spark: SparkSession, d: str) -> DataFrame:
    return w.history_totals(_history(spark, d), 5)


def version_log(spark: SparkSession, d: str) -> DataFrame:
    """A source's versions after two more, tagged and looked up."""
    saves = runs(spark, d).select(
        F.col("source_id").cast("string").alias("source_id"), F.lit("main").alias("branch"), F.col("started_at").cast("string").alias("created_at"), F.col("run_id").alias("save_id"), (F.col("run_id") % 100).alias("records"),
        F.md5("props").alias("data_hash"), F.array().cast("array<string>").alias("tags"),
    )
    versions = numbered_versions(saves).drop("save_id")
    versions = w.tag_version(versions, F.col("version_number") == 1, ["first"])
    versions = w.add_version(w.add_version(versions, "7", 7, "h2", "2024-02-02"), "7", 8, "h3", "2024-02-03")
    versions = w.tag_version(versions, (F.col("source_id") == "7") & (F.col("status") == "active"), ["best", "last"], ["last"])
    picked = w.find_version(versions, "7").unionByName(w.find_version(versions, "7", tag="first")).unionByName(w.find_version(versions, "3", number=2))
    return picked.select("source_id", "version_number", "parent", "status", "records", F.array_join("tags", ",").alias("tags"))


def best_cases(spark: SparkSession, d: str) -> DataFrame:
    errors = table(spark, d, "part").select(F.col("p_partkey").alias("error_id"), F.col("p_name").alias("pattern"), F.col("p_brand").alias("category"))
    k = F.col("p_partkey")
    cases = table(spark, d, "part").select(k.alias("case_id"), F.col("p_name").alias("pattern"), F.col("p_brand").alias("category"), ((k % 9) / 10.0).alias("success_rate"), F.col("p_size").alias("success_count"))
    return w.best_cases(errors, cases)


def order_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderpriority", F.round("o_totalprice").cast("long").alias("size"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    return w.conditional_totals(rows, ["o_orderpriority"], "size", F.col("o_orderstatus") == "F", "at")


def source_counters(spark: SparkSession, d: str) -> DataFrame:
    counters = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"), F.lit(1).cast("long").alias("recrawls"), F.lit(0).cast("long").alias("changed"), F.lit(2).cast("long").alias("same"))
    rejected = table(spark, d, "events").select((F.col("user_id") % 30).alias("source_id"), F.when(F.col("event_type") == "view", "recrawl").when(F.col("event_type") == "error", "source_changed").otherwise("not_updated").alias("reason"))
    return w.refresh(counters, rejected)


def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(pg.page_kind(F.col("url"), F.col("html")).alias("kind")).agg(F.count("*").alias("n"))


def content_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(pg.content_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def masked_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers out of every text and back in: the text is as it was."""
    masked, numbers = pg.mask_numbers(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", "text", masked.alias("masked"), numbers.alias("numbers"))
    return rows.select("doc_id", F.size("numbers").alias("n"), F.md5("masked").alias("hash"), (pg.restore_numbers(F.col("masked"), F.col("numbers")) == F.col("text")).alias("same"))


QUERIES = {
    f.__name__: f
    for f in (
        new_reviews, bulk_decisions, filtered_decisions, cascaded, resolved_errors, latest_levels, activity_timeline, history_totals, version_log, best_cases, order_totals, source_counters, page_kinds, content_kinds, masked_numbers,
    )
}
_HISTORY = f"WITH {RUNS}, h AS (SELECT category AS action, (source_id % 20)::VARCHAR AS actor, started_at AS t, status <> 'failed' AS success FROM runs)"
ORACLE = {
    "new_reviews": """WITH c AS (SELECT conv_id AS result_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS item_index, role, turn / 10.0::DOUBLE AS confidence FROM conversations)
        SELECT result_id, item_index, role, confidence, 'pending' AS status FROM c WHERE (result_id, item_index) NOT IN (SELECT (conv_id, turn::INTEGER) FROM conversations WHERE turn % 2 = 0)""",
    "bulk_decisions": f"""WITH {REVIEWS}, i AS (SELECT range AS review_id FROM range(0, 400, 3)), s AS (SELECT CASE WHEN status = 'pending' AND review_id IN (SELECT review_id FROM i) THEN 'approved' ELSE status END AS status FROM reviews),
        f AS (SELECT 'failed: ' || coalesce(status, 'missing') AS status FROM i LEFT JOIN reviews USING (review_id) WHERE status IS DISTINCT FROM 'pending') SELECT status, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM f) GROUP BY status""",
    "filtered_decisions": f"""WITH {REVIEWS}, s AS (SELECT source_id, CASE WHEN status = 'pending' AND confidence >= 0.7 AND created_at < TIMESTAMP '2024-01-20' AND source_id IN ('src0', 'src1') THEN 'approved' ELSE status END AS status FROM reviews) SELECT source_id, status, count(*) AS n FROM s GROUP BY ALL""",
    "cascaded": """SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "resolved_errors": f"""WITH {RUNS}, e AS (SELECT run_id % 4 = 0 AS was, source_id < 50 AS hit FROM runs WHERE status = 'failed') SELECT was OR hit AS resolved, CASE WHEN was THEN '2024-01-30' WHEN hit THEN '2024-01-31' END AS resolved_at, count(*) AS n FROM e GROUP BY ALL""",
    "latest_levels": f"""WITH {RUNS}, l AS (SELECT source_id, arg_max(status, row(started_at, run_id)) AS status FROM runs GROUP BY source_id) SELECT CASE WHEN source_id % 2 = 0 THEN 'latency' ELSE 'success_rate' END AS kind, status, count(*) AS n FROM l GROUP BY ALL""",
    "activity_timeline": f"{_HISTORY} SELECT strftime(t, '%Y-%m-%d %H:00') AS bucket, count(*) AS entries, count(DISTINCT actor) AS actors, array_to_string(list_sort(list(DISTINCT action)), ',') AS actions FROM h GROUP BY 1",
    "history_totals": f"""{_HISTORY}, g AS (SELECT 'action' AS "by", action AS value, count(*) AS n, count(*) FILTER (NOT success) AS failed FROM h GROUP BY action), a AS (SELECT 'actor' AS "by", actor AS value, count(*) AS n, count(*) FILTER (NOT success) AS failed FROM h GROUP BY actor ORDER BY n DESC, value LIMIT 5)
        SELECT * FROM g UNION ALL SELECT * FROM a""",
    "best_cases": """WITH c AS (SELECT p_partkey AS case_id, p_name, p_brand, p_size FROM part WHERE (p_partkey % 9) / 10.0::DOUBLE >= 0.6),
        g AS (SELECT p_name AS k, max(row(p_size, case_id)) AS b FROM c GROUP BY 1 UNION ALL SELECT p_brand, max(row(p_size, case_id)) FROM c GROUP BY 1)
        SELECT e.p_partkey AS error_id, arg_max(b[2], b) AS case_id FROM part e JOIN g ON k IN (p_name, p_brand) GROUP BY 1""",
    "order_totals": """WITH o AS (SELECT o_orderpriority, CAST(round(o_totalprice) AS BIGINT) AS s, o_orderstatus = 'F' AS ok, strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders)
        SELECT o_orderpriority, count(*) AS n, count(*) FILTER (ok) AS good, coalesce(sum(s) FILTER (ok), 0)::BIGINT AS bytes, round(avg(s) FILTER (ok), 2) AS mean_bytes, min(t) AS "first", max(t) AS "last" FROM o GROUP BY 1""",
    "source_counters": """WITH r AS (SELECT user_id % 30 AS source_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'error') AS b, count(*) FILTER (event_type NOT IN ('view', 'error')) AS c FROM events GROUP BY 1),
        n AS (SELECT n_nationkey::BIGINT AS source_id FROM nation) SELECT coalesce(n.source_id, r.source_id) AS source_id, CASE WHEN n.source_id IS NULL THEN 0 ELSE 1 END + coalesce(a, 0) AS recrawls, coalesce(b, 0) AS changed, CASE WHEN n.source_id IS NULL THEN 0 ELSE 2 END + coalesce(c, 0) AS same FROM n FULL JOIN r ON n.source_id = r.source_id""",
    "version_log": f"""WITH {RUNS}, n AS (SELECT source_id, run_id % 100 AS records, row_number() OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS v FROM runs), m AS (SELECT max(v) AS m FROM n WHERE source_id = 7)
        SELECT '7' AS source_id, (m + 2)::INTEGER AS version_number, (m + 1)::INTEGER AS parent, 'active' AS status, 8::BIGINT AS records, 'best' AS tags FROM m
        UNION ALL SELECT '7', 1, NULL, 'archived', records, 'first' FROM n WHERE source_id = 7 AND v = 1 UNION ALL SELECT '3', 2, 1, CASE WHEN (SELECT max(v) FROM n WHERE source_id = 3) > 2 THEN 'archived' ELSE 'active' END, records, '' FROM n WHERE source_id = 3 AND v = 2""",
    "page_kinds": f"SELECT CASE {' '.join(f"WHEN regexp_matches(lower({c}), '{k[i]}') THEN '{k[0]}'" for c, i in (('url', 1), ('html', 2)) for k in pg.PAGE_KINDS)} ELSE 'general' END AS kind, count(*) AS n FROM pages GROUP BY 1",
    "content_kinds": r"""WITH l AS (SELECT text, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM documents), s AS (SELECT text, len(list_filter(ls, lambda x: regexp_matches(x, '\t|\|| {3,}'))) / nullif(len(ls), 0)::DOUBLE AS share FROM l)
        SELECT CASE WHEN share >= 0.5 THEN 'table' WHEN length(text) > 200 AND regexp_matches(text, '[.!?。]\s') THEN 'news' ELSE 'general' END AS kind, count(*) AS n FROM s GROUP BY 1""",
    "masked_numbers": r"""SELECT doc_id, len(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?%?'))::INTEGER AS n, md5(regexp_replace(text, '[0-9][0-9,]*(?:\.[0-9]+)?%?', '{{N}}', 'g')) AS hash, true AS same FROM documents""",
}
