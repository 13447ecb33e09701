"""Queries on pages, exports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import quality as q
from tributary.session import scratch, table
from tributary.sources import exports, files, html
from tributary.streaming import events as ev


def page_records(spark: SparkSession, d: str) -> DataFrame:
    """Title, description and first link of every page."""
    fields = [{"name": "title", "selector": "title"}, {"name": "charset", "selector": "meta", "attr": "charset"}, {"name": "link", "selector": "a", "attr": "href"}]
    return html.extract(table(spark, d, "pages"), "page_id", "html", fields)


def page_items(spark: SparkSession, d: str) -> DataFrame:
    return html.extract(table(spark, d, "pages"), "page_id", "html", [{"name": "item", "selector": ""}], items="li")


def page_lists(spark: SparkSession, d: str) -> DataFrame:
    return html.extract_lists(table(spark, d, "pages"), "page_id", "html", [{"name": "item", "selector": "li"}, {"name": "link", "selector": "a", "attr": "href"}])


def page_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language that each page's first tag names, by pattern alone."""
    rows = files.extract_patterns(table(spark, d, "pages"), "html", {"language": r'<html[^>]* lang="([^"]*)"', "kind": r"<!doctype [a-z]+>"})
    return rows.groupBy("language", "kind").agg(F.count("*").alias("n"))


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    shaped = orders.select(
        F.col("o_orderkey").alias("_id"), F.struct("o_custkey", F.struct("o_orderstatus").alias("state")).alias("of"), F.concat(F.lit("="), "o_orderpriority").alias("priority"), (F.col("o_orderkey") % 200 == 0).alias("even"), "o_orderdate",
        F.array("o_orderstatus", "o_orderpriority").alias("parts"), F.when(F.col("o_orderkey") % 300 == 0, "x").alias("gap"),
    )
    out = exports.sanitized(shaped)
    return out.toDF(*[c.replace(".", "_") for c in out.columns])


def category_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the table that their category sends them to."""
    rows = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("category"))
    tables = exports.by_category(rows, "category", {"building": ["c_custkey"], "machinery": ["c_custkey"], "generic": ["c_custkey", "category"]}, "generic")
    return files.union_all([t.agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, t in tables.items()])


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written as CSV and read back, mapped to fields and typed."""
    path = scratch(spark)
    exports.to_csv(table(spark, d, "supplier").select(F.col("s_suppkey").alias("Supplier Key"), F.col("s_name").alias("Name"), F.col("s_acctbal").alias("Account Balance")), path)
    fields = [{"name": "key", "data_type": "number"}, {"name": "name"}, {"name": "balance", "data_type": "number"}]
    return files.typed(files.mapped(files.read_delimited(spark, path), fields), fields)


def _changes(spark, d):
    """Events as changes of documents."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = ev.read_stream(spark, f"{d}/event[s].parquet", schema)
    k = F.get_json_object("props", "$.k")
    return raw.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "replace").otherwise("update").alias("operation"),
        F.when(F.col("user_id") % 10 == 0, "error_logs").otherwise("staging_news").alias("collection"),
        F.create_map(F.lit("k"), k, F.lit("type"), F.col("event_type")).alias("before"),
        F.create_map(F.lit("k"), (k.cast("int") % 50).cast("string"), F.lit("value"), F.col("value").cast("string")).alias("after"),
        "value",
    )


def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """All changes mapped and routed by a stream, then counted."""
    events = ev.routed(ev.to_events(_changes(spark, d))).withColumn("fields", F.concat_ws(",", "change_fields")).select("event_type", "priority", "topic", "fields")
    return ev.drain(events, scratch(spark)).groupBy("event_type", "priority", "topic", "fields").agg(F.count("*").alias("n"))


def stream_validation(spark: SparkSession, d: str) -> DataFrame:
    rules = [q.in_range("value", 1, 100), q.matches("operation", "insert|update|delete", "warning")]
    return ev.drain(ev.totals(ev.validated(_changes(spark, d), rules), "user_id"), scratch(spark), "complete")


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Every event once, though the stream has each twice."""
    doubled = _changes(spark, d).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return ev.drain(ev.first_seen(doubled, "event_id", "ts", "40 days").select("event_id"), scratch(spark))


def stream_hours(spark: SparkSession, d: str) -> DataFrame:
    counts = ev.windowed(_changes(spark, d), "ts", "1 hour", "1 day", "operation")
    rows = ev.drain(counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "operation", "n"), scratch(spark), "complete")
    return rows.groupBy(F.substring("hour", 1, 10).alias("day"), "operation").agg(F.sum("n").alias("n"), F.count("*").alias("hours"))


def stream_throttle(spark: SparkSession, d: str) -> DataFrame:
    sent = ev.throttled(_changes(spark, d).where("operation = 'delete'"), "user_id", "ts", 2, 86_400, "40 days")
    return ev.drain(sent, scratch(spark)).groupBy("user_id").agg(F.count_if("sent").alias("sent"), F.count("*").alias("fired"))


def stream_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """A handler that always fails: its events end in the dead-letter table after three tries, the others' do not."""
    out = scratch(spark)
    events = ev.routed(ev.to_events(_changes(spark, d))).withColumn("topic", F.when(F.col("operation") == "delete", "crawl").otherwise(F.col("topic")))

    def fail(rows: DataFrame) -> None:
        raise RuntimeError("out of order")

    ev.handle(events, {"data": lambda rows: rows.write.mode("overwrite").parquet(f"{out}/data"), "crawl": fail}, out, f"{out}/state").awaitTermination()
    dead = ev.dead_letters(spark, out).select("topic", "error", "retry_count").groupBy("topic", "error", "retry_count").agg(F.count("*").alias("n"))
    return dead.unionByName(spark.read.parquet(f"{out}/data").groupBy("topic").agg(F.count("*").alias("n")), allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (page_records, page_items, page_lists, page_languages, export_rows, category_tables, csv_round_trip, stream_events, stream_validation, stream_first_seen, stream_hours, stream_throttle, stream_dead_letters)}
_OPERATION = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'replace' ELSE 'update' END"
_LINKS = r"""regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', {})"""
ORACLE = {
    # the pages' own markup is regular, so patterns find what the parser does
    "page_records": r"""SELECT page_id, 0::INTEGER AS place, nullif(trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '') AS title,
        nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset, nullif(regexp_extract(html, '<a href="([^"]*)"', 1), '') AS link FROM pages""",
    "page_items": f"""SELECT page_id, (i - 1)::INTEGER AS place, l[i] AS item FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, {_LINKS.format(2)} AS l FROM pages))""",
    "page_lists": f"""SELECT page_id, (i - 1)::INTEGER AS place, l[i] AS item, h[i] AS link FROM (SELECT page_id, l, h, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, {_LINKS.format(2)} AS l, {_LINKS.format(1)} AS h FROM pages))""",
    "page_languages": """SELECT nullif(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), '') AS language, nullif(regexp_extract(html, '(?i)<!doctype [a-z]+>', 0), '') AS kind, count(*) AS n FROM pages GROUP BY ALL""",
    "export_rows": """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS of_o_custkey, o_orderstatus AS of_state_o_orderstatus, '''=' || o_orderpriority AS priority, CASE WHEN o_orderkey % 200 = 0 THEN 'TRUE' ELSE 'FALSE' END AS even,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS parts, CASE WHEN o_orderkey % 300 = 0 THEN 'x' ELSE '' END AS gap FROM orders""",
    "category_tables": "SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) ELSE 'generic' END AS table_name, count(*) AS n FROM customer GROUP BY 1",
    "csv_round_trip": "SELECT s_suppkey::DOUBLE AS key, s_name AS name, s_acctbal AS balance FROM supplier",
    "stream_events": f"""WITH c AS (SELECT {_OPERATION} AS operation, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT CASE operation WHEN 'insert' THEN 'data.created' WHEN 'delete' THEN 'data.deleted' ELSE 'data.updated' END AS event_type, CASE WHEN user_id % 10 = 0 THEN 'high' ELSE 'normal' END AS priority, 'data' AS topic,
        CASE WHEN operation IN ('insert', 'delete') THEN '' WHEN k < 50 THEN 'type,value' ELSE 'k,type,value' END AS fields, count(*) AS n FROM c GROUP BY ALL""",
    "stream_validation": f"""WITH c AS (SELECT user_id, value < 1 OR value > 100 AS a, {_OPERATION} = 'replace' AS b FROM events)
        SELECT user_id, count(*) AS events, count(*) FILTER (a) AS invalid, (count(*) FILTER (a) + count(*) FILTER (b))::BIGINT AS issues FROM c GROUP BY user_id""",
    "stream_first_seen": "SELECT event_id FROM events",
    "stream_hours": f"""SELECT strftime(ts, '%Y-%m-%d') AS day, {_OPERATION} AS operation, count(*)::BIGINT AS n, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY ALL""",
    "stream_throttle": """WITH RECURSIVE f AS (SELECT user_id, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type = 'error'),
        s AS (SELECT user_id, i, t, NULL::TIMESTAMP AS before FROM f WHERE i = 1 UNION ALL
              SELECT f.user_id, min(f.i), min(f.t), min(s.t) FROM s JOIN f ON f.user_id = s.user_id AND f.i > s.i AND (s.before IS NULL OR f.t >= s.before + INTERVAL 1 DAY) GROUP BY f.user_id),
        c AS (SELECT user_id, count(*) AS sent FROM s GROUP BY user_id) SELECT user_id, sent, count(*) AS fired FROM f JOIN c USING (user_id) GROUP BY user_id, sent""",
    "stream_dead_letters": """SELECT 'crawl' AS topic, 'out of order' AS error, 3 AS retry_count, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'data', NULL, NULL, count(*) FROM events WHERE event_type <> 'error'""",
}
