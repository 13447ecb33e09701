"""Queries that validate, hold to contracts, infer schemas and migrate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import contracts as c
from tributary.operators import quality as q
from tributary.operators import schemas as s
from tributary.plans.common import as_of
from tributary.session import table


def _people(spark, d):
    """Customers as raw strings, with holes and faults at fixed places."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"),
        F.when(k % 7 != 0, F.col("c_name")).alias("name"),
        F.when(k % 11 == 0, "n/a").otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("balance"),
        F.when(k % 5 == 0, "bad at example").otherwise(F.concat(F.lit("user"), k.cast("string"), F.lit("@example.org"))).alias("mail"),
        F.when(k % 13 == 0, "2031-05-05").when(k % 17 == 0, "soon").otherwise("2020-02-02").alias("since"),
        F.when(k % 9 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("segment"),
        (k % 400).alias("code"),
    )


_PEOPLE = """people AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name,
    CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) END AS balance,
    CASE WHEN c_custkey % 5 = 0 THEN 'bad at example' ELSE 'user' || c_custkey || '@example.org' END AS mail,
    CASE WHEN c_custkey % 13 = 0 THEN '2031-05-05' WHEN c_custkey % 17 = 0 THEN 'soon' ELSE '2020-02-02' END AS since,
    CASE WHEN c_custkey % 9 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS segment, c_custkey % 400 AS code FROM customer)"""


def _checked(spark, d):
    rules = [
        q.required("name", "critical"),
        q.in_range("balance", high=9000, negative=False),
        q.matches("mail", "email", "warning"),
        q.dated("since", as_of()),
        q.unique("code", "id", "warning"),
        *q.encoding("segment"),
    ]
    return q.issues(_people(spark, d), rules)


_ISSUES = f"""{_PEOPLE},
    u AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY id) AS n FROM people),
    issues AS (SELECT id, 'required' AS rule, 'name' AS field, 'critical' AS severity, 5.0 AS w FROM people WHERE name IS NULL
        UNION ALL SELECT id, 'range', 'balance', 'error', 2.0 FROM people WHERE coalesce(TRY_CAST(balance AS DOUBLE), -1) < 0 OR TRY_CAST(balance AS DOUBLE) > 9000
        UNION ALL SELECT id, 'format', 'mail', 'warning', 0.5 FROM people WHERE mail NOT LIKE '%@%'
        UNION ALL SELECT id, 'date', 'since', 'error', 2.0 FROM people WHERE since <> '2020-02-02'
        UNION ALL SELECT id, 'unique', 'code', 'warning', 0.5 FROM u WHERE n > 1)"""


def validation_issues(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("id", F.array_join(F.array_sort(F.transform("issues", lambda x: F.concat(x.rule, F.lit(":"), x.severity))), ",").alias("found"))


def issues_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return q.issue_counts(_checked(spark, d), "rule", "field", "severity")


def batch_scores(spark: SparkSession, d: str) -> DataFrame:
    return q.batch_score(_checked(spark, d), "segment")


def anomaly_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's score against a baseline that is derived from it."""
    now = q.batch_score(_checked(spark, d), "segment")
    base = now.select("segment", (F.length("segment").cast("long") - 5).alias("runs"), (F.col("score") + F.length("segment")).alias("score"), (F.col("issues") / 2).alias("issues"))
    return q.anomalies(now, base, "segment")


def field_statistics(spark: SparkSession, d: str) -> DataFrame:
    return q.field_stats(_people(spark, d), ["name", "balance", "mail", "segment"])


def reference_misses(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers that the (odd half of the) register lacks."""
    register = table(spark, d, "customer").where("c_custkey % 2 = 1")
    return q.unreferenced(table(spark, d, "orders"), "o_custkey", register, "c_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _contract():
    return [
        c.not_null("name", 0.9, "critical"),
        c.unique("code", 0.5),
        c.in_range("balance", 0, 9000, mostly=0.5),
        c.match_regex("mail", "email", severity="warning"),
        c.in_set("segment", ["BUILDING", "MACHINERY", "HOUSEHOLD"], mostly=0.4),
        c.length_between("name", 5, 40, allow_null=False, mostly=0.99),
        c.of_type("since", "date_string", mostly=0.9),
        c.pair_equal("name", "mail", ignore="either_null", severity="info"),
        c.row_count_between(1, 1_000_000_000),
    ]


def contract_results(spark: SparkSession, d: str) -> DataFrame:
    return c.measure(_people(spark, d), _contract()).withColumnRenamed("column", "of")


_CONTRACT_SQL = f"""WITH {_PEOPLE},
    v AS (SELECT count(*) AS n, count(name) AS names, count(*) FILTER (name IS NULL) AS no_name, count(DISTINCT code) AS codes,
        count(*) FILTER (coalesce(TRY_CAST(balance AS DOUBLE), -1) < 0 OR TRY_CAST(balance AS DOUBLE) > 9000) AS balances, count(*) FILTER (mail NOT LIKE '%@%') AS mails,
        count(*) FILTER (segment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AS segments, count(*) FILTER (since = 'soon') AS dates FROM people),
    r(id, expectation, of, bad_severity, elements, unexpected, mostly) AS (
        SELECT 0, 'not_null', 'name', 'critical', n, no_name, 0.9 FROM v UNION ALL SELECT 1, 'unique', 'code', 'warning', n, n - codes, 0.5 FROM v UNION ALL SELECT 2, 'in_range', 'balance', 'error', n, balances, 0.5 FROM v
        UNION ALL SELECT 3, 'match_regex', 'mail', 'warning', n, mails, 1.0 FROM v UNION ALL SELECT 4, 'in_set', 'segment', 'error', n, segments, 0.4 FROM v UNION ALL SELECT 5, 'length_between', 'name', 'error', n, no_name, 0.99 FROM v
        UNION ALL SELECT 6, 'of_type', 'since', 'error', n, dates, 0.9 FROM v UNION ALL SELECT 7, 'pair_equal', 'name,mail', 'info', names, names, 1.0 FROM v UNION ALL SELECT 8, 'row_count_between', '', 'error', n, 0, 0.0 FROM v),
    s AS (SELECT *, 1 - unexpected / elements::DOUBLE AS ratio FROM r)
    SELECT id::INTEGER AS id, expectation, of, CASE WHEN ratio >= mostly THEN 'info' ELSE bad_severity END AS severity, elements::BIGINT AS elements, unexpected::BIGINT AS unexpected, round(ratio, 6) AS ratio, ratio >= mostly AS success FROM s"""


def contract_routes(spark: SparkSession, d: str) -> DataFrame:
    return c.route(_people(spark, d), _contract()).select("id", "_validation_issue", "_route")


def contract_route_counts(spark: SparkSession, d: str) -> DataFrame:
    return c.route(_people(spark, d), _contract()).groupBy("_route").agg(F.count("*").alias("n"))


# Which expectations failed is taken from their results; the worst of a row's failed ones counts.
_ROUTE_SQL = f"""WITH res AS ({_CONTRACT_SQL}), {_PEOPLE},
    t AS (SELECT id, 0 AS e, 3 AS s FROM people WHERE name IS NULL
        UNION ALL SELECT id, 1, 1 FROM people WHERE code IN (SELECT code FROM people GROUP BY code HAVING count(*) > 1)
        UNION ALL SELECT id, 2, 2 FROM people WHERE coalesce(TRY_CAST(balance AS DOUBLE), -1) < 0 OR TRY_CAST(balance AS DOUBLE) > 9000
        UNION ALL SELECT id, 3, 1 FROM people WHERE mail NOT LIKE '%@%'
        UNION ALL SELECT id, 4, 2 FROM people WHERE segment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
        UNION ALL SELECT id, 5, 2 FROM people WHERE name IS NULL UNION ALL SELECT id, 6, 2 FROM people WHERE since = 'soon' UNION ALL SELECT id, 7, 0 FROM people WHERE name IS NOT NULL),
    w AS (SELECT p.id, max(s) AS worst FROM people p LEFT JOIN (SELECT t.* FROM t JOIN res ON res.id = t.e AND NOT res.success) x ON p.id = x.id GROUP BY p.id),
    routed AS (SELECT id, CASE worst WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' WHEN 3 THEN 'critical' END AS _validation_issue,
        CASE WHEN worst IS NULL THEN 'valid' WHEN worst = 3 THEN 'quarantine' ELSE 'invalid' END AS _route FROM w)"""


def schema_profile(spark: SparkSession, d: str) -> DataFrame:
    return s.profile(_people(spark, d), ["name", "balance", "mail", "since", "code"]).select("field", "total", "nulls", "integer", "float", "date", "string", "shortest", "longest", "low", "high")


def _people_schema():
    return [
        s.Field("id", "integer", True), s.Field("name", "string", True, shortest=5), s.Field("balance", "float", high=9000.0), s.Field("mail", "string", pattern=q.FORMATS["email"]),
        s.Field("since", "date"), s.Field("segment", "string", values=("BUILDING", "MACHINERY", "HOUSEHOLD", "AUTOMOBILE")), s.Field("country", "string", True),
    ]


def schema_errors(spark: SparkSession, d: str) -> DataFrame:
    found = s.errors(_people(spark, d), _people_schema(), extra=False)
    return found.select(F.inline("errors")).groupBy("field", "error").agg(F.count("*").alias("n"))


def migrated_records(spark: SparkSession, d: str) -> DataFrame:
    steps = [("type", "balance", "string", "float"), ("type", "code", "integer", "boolean"), ("rename", "segment", "sector"), ("add", "country", "string", "KR"), ("merge", ["sector", "country"], "place", "/"), ("split", "mail", ["user", "host"], "@"), ("remove", "since")]
    done = s.migrate(_people(spark, d), steps)
    return done.select("id", "balance", "code", "place", "user", "host", F.size("_lost").alias("lost"))


def _people_next(spark, d):
    """The next delivery of customers: no mail, every one named, whole balances, codes with a letter, and a level."""
    rows = _people(spark, d)
    whole = F.when(F.col("balance") == "n/a", F.col("balance")).otherwise(F.substring_index("balance", ".", 1))
    return rows.select("id", F.coalesce("name", F.lit("nobody")).alias("name"), whole.alias("balance"), "since", "segment", F.concat(F.lit("c"), F.col("code").cast("string")).alias("code"), (F.col("id") % 4).alias("level"))


def _versions(spark, d):
    return [s.loosened(s.infer(rows)) for rows in (_people(spark, d), _people_next(spark, d))]


def schema_changes(spark: SparkSession, d: str) -> DataFrame:
    """What differs between the schemas that two deliveries show, what breaks, and the steps between them."""
    old, new = _versions(spark, d)
    rows = [(kind, name) for kind, names in s.compare(old, new).items() for name in names]
    rows += [("breaks", x) for x in s.compatible(old, new, "full")] + [("step", " ".join(map(str, x))) for x in s.plan(old, new)]
    return spark.createDataFrame(rows, "kind string, what string")


_NEXT = """next AS (SELECT id, coalesce(name, 'nobody') AS name, CASE WHEN balance = 'n/a' THEN balance ELSE split_part(balance, '.', 1) END AS balance, since, segment, 'c' || code AS code, id % 4 AS level FROM people)"""
_KIND = """CASE WHEN v IS NULL THEN NULL WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(v, '^[+-]?[0-9]+[.][0-9]*$') THEN 'float' ELSE 'string' END"""


def _shown(table: str, columns: str) -> str:
    """Kind, required and nullable of each column of a table, by its values."""
    cells = " UNION ALL ".join(f"SELECT '{c}' AS field, {c}::VARCHAR AS v FROM {table}" for c in columns.split())
    return f"""SELECT field, arg_max(kind, n) FILTER (kind IS NOT NULL) AS kind, sum(n) FILTER (kind IS NOT NULL) / sum(n) >= 0.95 AS required, bool_or(kind IS NULL) AS nullable
        FROM (SELECT field, {_KIND} AS kind, count(*) AS n FROM ({cells}) GROUP BY ALL) GROUP BY field"""


# Which kinds hold all values of another, and which changes lose some.
_SCHEMAS = f"""{_PEOPLE}, {_NEXT}, a AS ({_shown("people", "id name balance mail since segment code")}), z AS ({_shown("next", "id name balance since segment code level")}),
    wider(k, w) AS (VALUES ('integer', 'float'), ('integer', 'string'), ('float', 'string'), ('boolean', 'string'), ('boolean', 'integer'), ('date', 'datetime'), ('date', 'string'), ('datetime', 'string')),
    narrower(k, w) AS (VALUES ('string', 'integer'), ('string', 'float'), ('string', 'boolean'), ('string', 'date'), ('string', 'datetime'), ('float', 'integer'), ('datetime', 'date')),
    pairs AS (SELECT 'backward' AS way, a.field, a.kind AS k, z.kind AS w, a.required AS r, z.required AS q, a.nullable AS n, z.nullable AS m FROM a JOIN z USING (field) UNION ALL SELECT 'forward', a.field, z.kind, a.kind, z.required, a.required, z.nullable, a.nullable FROM a JOIN z USING (field)),
    breaks AS (SELECT field, way || ': ' || field || ' changes from ' || k || ' to ' || w || CASE WHEN (k, w) IN (SELECT (k, w) FROM narrower) THEN ', which loses values' ELSE '' END AS what FROM pairs WHERE k <> w AND (k, w) NOT IN (SELECT (k, w) FROM wider)
        UNION ALL SELECT field, way || ': ' || field || ' becomes required' FROM pairs WHERE q AND NOT r UNION ALL SELECT field, way || ': ' || field || ' is no longer nullable' FROM pairs WHERE n AND NOT m
        UNION ALL SELECT field, 'backward: ' || field || ' is required and has no default' FROM z ANTI JOIN a USING (field) WHERE required UNION ALL SELECT field, 'forward: ' || field || ' is required and has no default' FROM a ANTI JOIN z USING (field) WHERE required),
    differ AS (SELECT field, 'added' AS kind FROM z ANTI JOIN a USING (field) UNION ALL SELECT field, 'removed' FROM a ANTI JOIN z USING (field) UNION ALL SELECT field, 'changed' FROM pairs WHERE way = 'backward' AND (k <> w OR q <> r OR n <> m))"""


def contract_templates(spark: SparkSession, d: str) -> DataFrame:
    """Every contract of a kind of source, measured on documents, parts and orders as such sources."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    news = docs.select(F.when(k % 9 != 0, F.substring("text", 1, (k % 6).cast("int") + 3)).alias("title"), F.when(k % 10 == 0, "ftp://x").otherwise(F.concat(F.lit("https://x.org/"), (k - k % 2).cast("string"))).alias("url"))
    p = F.col("p_partkey")
    stocks = table(spark, d, "part").select(F.lpad((p % 1_000_000).cast("string"), 6, "0").alias("stock_code"), F.when(p % 8 == 0, "n/a").otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("price"), (p - 5).cast("string").alias("volume"), F.col("p_name").alias("name"))
    rates = table(spark, d, "nation").select(F.substring("n_name", 1, 4).alias("currency_code"), (F.col("n_nationkey") - 1).cast("string").alias("base_rate"))
    parts = [("news_articles", news, ()), ("stock_prices", stocks, ()), ("financial_data", stocks, ()), ("exchange_rates", rates, ()), ("generic_table", news, (["title", "url"],))]
    out = None
    for name, rows, args in parts:
        one = c.measure(rows, c.TEMPLATES[name](*args)).select(F.lit(name).alias("template"), "id", "expectation", F.col("column").alias("of"), "severity", "elements", "unexpected", "success")
        out = one if out is None else out.unionByName(one)
    return out


def staged_checks(spark: SparkSession, d: str) -> DataFrame:
    """Customers through three stages of rules, of which those behind a failing one do not run."""
    stages = [("shape", [q.required("name", "critical"), q.matches("mail", "email", "warning")]), ("values", [q.in_range("balance", high=9000, negative=False)]), ("dates", [q.dated("since", as_of())])]
    done = q.staged(_people(spark, d), stages, go_on=False)
    return done.select("id", "passed", F.array_join(F.transform("stages", lambda x: F.concat_ws(":", x.stage, x.passed.cast("string"), x.score.cast("int").cast("string"), x.issues.cast("string"))), ",").alias("stages"))


_STEPS = [("type", "balance", "string", "float"), ("type", "since", "string", "date"), ("remove", "name"), ("add", "country", "string", "KR"), ("default", "segment", "NONE"), ("rename", "code", "number"), ("merge", ["mail", "segment"], "tag", "/")]


def migration_modes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a migration that leaves failing ones out, and of one that empties what fails."""
    rows = _people(spark, d)
    skipped = s.migrate_all(rows, _STEPS, "skip").withColumn("_lost", F.array().cast("array<string>"))
    out = skipped.withColumn("mode", F.lit("skip")).unionByName(s.migrate_all(rows, _STEPS, "null").withColumn("mode", F.lit("null")))
    return out.select("mode", "id", "balance", F.col("since").cast("string").alias("since"), "country", "number", "tag", F.array_join("_lost", ",").alias("lost"))


def migration_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = _people(spark, d)
    return s.estimate(rows, _STEPS).crossJoin(s.migration_counts(rows, _STEPS))  # one row


QUERIES = {f.__name__: f for f in (validation_issues, issues_by_rule, batch_scores, anomaly_flags, field_statistics, reference_misses, contract_results, contract_routes, contract_route_counts, schema_profile, schema_errors, migrated_records, schema_changes, contract_templates, staged_checks, migration_modes, migration_estimate)}
_SCORES = f"""{_ISSUES}, b AS (SELECT segment, count(*) AS n, sum(k) AS issues, count(*) FILTER (k > 0) AS bad_rows, sum(w) AS w FROM (
    SELECT p.id, segment, count(i.id) AS k, coalesce(sum(i.w), 0) AS w FROM people p LEFT JOIN issues i ON p.id = i.id GROUP BY p.id, segment) GROUP BY segment),
    sc AS (SELECT segment, n, bad_rows, issues::BIGINT AS issues, round(greatest(0, 100 - w / (5 * n) * 100), 4)::DOUBLE AS score FROM b)"""
ORACLE = {
    "schema_changes": f"""WITH {_SCHEMAS} SELECT kind, field AS what FROM differ UNION ALL SELECT 'breaks', what FROM breaks UNION ALL SELECT 'step', 'remove ' || field FROM differ WHERE kind = 'removed'
        UNION ALL SELECT 'step', 'add ' || field || ' ' || z.kind || ' None' FROM differ JOIN z USING (field) WHERE differ.kind = 'added' UNION ALL SELECT 'step', 'type ' || field || ' ' || k || ' ' || w FROM pairs WHERE way = 'backward' AND k <> w""",
    "contract_templates": """WITH news AS (SELECT CASE WHEN doc_id % 9 <> 0 THEN text[1:doc_id % 6 + 3] END AS title, CASE WHEN doc_id % 10 = 0 THEN 'ftp://x' ELSE 'https://x.org/' || (doc_id - doc_id % 2) END AS url FROM documents),
        st AS (SELECT lpad((p_partkey % 1000000)::VARCHAR, 6, '0') AS stock_code, CASE WHEN p_partkey % 8 = 0 THEN 'n/a' ELSE 'x' END AS price, p_partkey - 5 AS volume FROM part), fx AS (SELECT n_name[1:4] AS code, n_nationkey - 1 AS rate FROM nation),
        r(template, id, expectation, of, bad, elements, unexpected, mostly) AS (
            SELECT 'news_articles', 0, 'not_null', 'title', 'error', count(*), count(*) - count(title), 1.0 FROM news UNION ALL SELECT 'news_articles', 1, 'not_null', 'url', 'error', count(*), 0, 1.0 FROM news UNION ALL SELECT 'news_articles', 2, 'unique', 'url', 'warning', count(*), count(*) - count(DISTINCT url), 0.99 FROM news
            UNION ALL SELECT 'news_articles', 3, 'length_between', 'title', 'warning', count(title), count(*) FILTER (length(title) < 5 OR length(title) > 300), 1.0 FROM news UNION ALL SELECT 'news_articles', 4, 'match_regex', 'url', 'error', count(url), count(*) FILTER (url LIKE 'ftp%'), 0.95 FROM news
            UNION ALL SELECT 'news_articles', 5, 'row_count_between', '', 'error', count(*), 0, 0 FROM news UNION ALL SELECT 'generic_table', 0, 'row_count_between', '', 'error', count(*), 0, 0 FROM news UNION ALL SELECT 'generic_table', 1, 'not_null', 'title', 'error', count(*), count(*) - count(title), 1.0 FROM news
            UNION ALL SELECT 'generic_table', 2, 'not_null', 'url', 'error', count(*), 0, 1.0 FROM news UNION ALL SELECT 'stock_prices', 0, 'not_null', 'stock_code', 'error', count(*), 0, 1.0 FROM st UNION ALL SELECT 'stock_prices', 1, 'not_null', 'price', 'error', count(*), 0, 1.0 FROM st
            UNION ALL SELECT 'stock_prices', 2, 'match_regex', 'stock_code', 'error', count(*), 0, 0.95 FROM st UNION ALL SELECT 'stock_prices', 3, 'in_range', 'price', 'error', count(*), count(*) FILTER (price = 'n/a'), 1.0 FROM st UNION ALL SELECT 'stock_prices', 4, 'in_range', 'volume', 'error', count(*), count(*) FILTER (volume < 0), 1.0 FROM st
            UNION ALL SELECT 'stock_prices', 5, 'row_count_between', '', 'error', count(*), 0, 0 FROM st UNION ALL SELECT 'financial_data', 0, 'not_null', 'name', 'error', count(*), 0, 1.0 FROM st UNION ALL SELECT 'financial_data', 1, 'not_null', 'price', 'error', count(*), 0, 1.0 FROM st
            UNION ALL SELECT 'financial_data', 2, 'in_range', 'price', 'error', count(*), count(*) FILTER (price = 'n/a'), 1.0 FROM st UNION ALL SELECT 'financial_data', 3, 'of_type', 'price', 'error', count(*), count(*) FILTER (price = 'n/a'), 1.0 FROM st UNION ALL SELECT 'financial_data', 4, 'row_count_between', '', 'error', count(*), 0, 0 FROM st
            UNION ALL SELECT 'exchange_rates', 0, 'not_null', 'currency_code', 'error', count(*), 0, 1.0 FROM fx UNION ALL SELECT 'exchange_rates', 1, 'not_null', 'base_rate', 'error', count(*), 0, 1.0 FROM fx UNION ALL SELECT 'exchange_rates', 2, 'length_between', 'currency_code', 'warning', count(*), count(*) FILTER (length(code) <> 3), 1.0 FROM fx
            UNION ALL SELECT 'exchange_rates', 3, 'in_range', 'base_rate', 'error', count(*), count(*) FILTER (rate < 0), 1.0 FROM fx UNION ALL SELECT 'exchange_rates', 4, 'row_count_between', '', 'error', count(*), 0, 0 FROM fx),
        s AS (SELECT *, 1 - unexpected / elements::DOUBLE >= mostly AS success FROM r)
        SELECT template, id::INTEGER AS id, expectation, of, CASE WHEN success THEN 'info' ELSE bad END AS severity, elements::BIGINT AS elements, unexpected::BIGINT AS unexpected, success FROM s""",
    "staged_checks": f"""WITH {_PEOPLE}, t AS (SELECT id, name IS NULL AS a, mail NOT LIKE '%@%' AS w, coalesce(TRY_CAST(balance AS DOUBLE), -1) < 0 OR TRY_CAST(balance AS DOUBLE) > 9000 AS b, since <> '2020-02-02' AS e FROM people)
        SELECT id, NOT (a OR b OR e) AS passed, concat_ws(',', 'shape:' || (NOT a) || ':' || (100 - CASE WHEN a THEN 10 ELSE 0 END - CASE WHEN w THEN 2 ELSE 0 END) || ':' || (a::INT + w::INT), CASE WHEN NOT a THEN 'values:' || (NOT b) || ':' || CASE WHEN b THEN 90 ELSE 100 END || ':' || b::INT END,
        CASE WHEN NOT a AND NOT b THEN 'dates:' || (NOT e) || ':' || CASE WHEN e THEN 90 ELSE 100 END || ':' || e::INT END) AS stages FROM t""",
    "migration_modes": f"""WITH {_PEOPLE}, m AS (SELECT id, TRY_CAST(balance AS DOUBLE) AS balance, CASE WHEN since <> 'soon' THEN since END AS since, 'KR' AS country, code AS number, mail || '/' || segment AS tag, concat_ws(',', CASE WHEN balance = 'n/a' THEN 'balance' END, CASE WHEN since = 'soon' THEN 'since' END) AS lost FROM people)
        SELECT 'null' AS mode, * FROM m UNION ALL SELECT 'skip', * FROM m WHERE lost = ''""",
    "migration_estimate": f"""WITH {_PEOPLE}, n AS (SELECT count(*) AS total, count(*) FILTER (balance <> 'n/a' AND since <> 'soon') AS migrated, count(*) FILTER (balance = 'n/a' OR since = 'soon') AS failed, count(*) FILTER (balance = 'n/a') AS b, count(*) FILTER (since = 'soon') AS s, count(name) AS names, count(*) FILTER (segment IS NULL) AS holes FROM people),
        e(step, action, field, affected, lost) AS (SELECT 0, 'type', 'balance', total, b FROM n UNION ALL SELECT 1, 'type', 'since', total, s FROM n UNION ALL SELECT 2, 'remove', 'name', names, names FROM n UNION ALL SELECT 3, 'add', 'country', total, 0 FROM n UNION ALL SELECT 4, 'default', 'segment', holes, 0 FROM n
            UNION ALL SELECT 5, 'rename', 'code', total, 0 FROM n UNION ALL SELECT 6, 'merge', 'mail,segment', total, 0 FROM n) SELECT step::INTEGER AS step, action, field, affected::BIGINT AS affected, lost::BIGINT AS lost, total, migrated, failed FROM e, n""",
    "validation_issues": f"WITH {_ISSUES} SELECT p.id, coalesce(array_to_string(list_sort(list(rule || ':' || severity) FILTER (rule IS NOT NULL)), ','), '') AS found FROM people p LEFT JOIN issues i ON p.id = i.id GROUP BY p.id",
    "issues_by_rule": f"WITH {_ISSUES} SELECT rule, field, severity, count(*) AS n FROM issues GROUP BY ALL",
    "batch_scores": f"WITH {_SCORES} SELECT * FROM sc",
    "anomaly_flags": f"""WITH {_SCORES}, a AS (SELECT segment, score, length(segment) - 5 >= 3 AS known, length(segment) AS fall FROM sc)
        SELECT segment, score, 'score_drop' AS anomaly, 'warning' AS severity FROM a WHERE known AND fall >= 10 UNION ALL SELECT segment, score, 'issue_jump', 'warning' FROM a WHERE known UNION ALL SELECT segment, score, 'low_score', 'error' FROM a WHERE score < 70""",
    "field_statistics": f"""WITH {_PEOPLE}, f AS (SELECT 'name' AS field, name AS v FROM people UNION ALL SELECT 'balance', balance FROM people UNION ALL SELECT 'mail', mail FROM people UNION ALL SELECT 'segment', segment FROM people)
        SELECT field, count(*) AS total, count(*) FILTER (v IS NULL) AS "null", count(*) FILTER (trim(v) = '') AS blank, count(DISTINCT v) AS "unique", round(count(*) FILTER (v IS NULL) / count(*)::DOUBLE, 4) AS null_rate,
        round(count(*) FILTER (trim(v) = '') / count(*)::DOUBLE, 4) AS blank_rate, round(count(DISTINCT v) / count(v)::DOUBLE, 4) AS unique_rate FROM f GROUP BY field""",
    "reference_misses": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1) GROUP BY 1",
    "contract_results": _CONTRACT_SQL,
    "contract_routes": f"{_ROUTE_SQL} SELECT * FROM routed",
    "contract_route_counts": f"{_ROUTE_SQL} SELECT _route, count(*) AS n FROM routed GROUP BY _route",
    "schema_profile": f"""WITH {_PEOPLE}, f AS (SELECT 'name' AS field, name AS v FROM people UNION ALL SELECT 'balance', balance FROM people UNION ALL SELECT 'mail', mail FROM people UNION ALL SELECT 'since', since FROM people UNION ALL SELECT 'code', code::VARCHAR FROM people),
        k AS (SELECT field, v, CASE WHEN v IS NULL THEN NULL WHEN regexp_matches(v, '^[0-9]{{4}}-') THEN 'date' WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(v, '^[+-]?[0-9]+[.][0-9]*$') THEN 'float' ELSE 'string' END AS kind FROM f)
        SELECT field, count(*) AS total, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (kind = 'integer') AS integer, count(*) FILTER (kind = 'float') AS float, count(*) FILTER (kind = 'date') AS date, count(*) FILTER (kind = 'string') AS string,
        min(length(v))::INTEGER AS shortest, max(length(v))::INTEGER AS longest, min(TRY_CAST(v AS DOUBLE)) FILTER (kind IN ('integer', 'float')) AS low, max(TRY_CAST(v AS DOUBLE)) FILTER (kind IN ('integer', 'float')) AS high FROM k GROUP BY field""",
    "schema_errors": f"""WITH {_PEOPLE}, e AS (SELECT 'name' AS field, 'missing_required' AS error FROM people WHERE name IS NULL UNION ALL SELECT 'balance', 'wrong_type' FROM people WHERE balance = 'n/a' UNION ALL SELECT 'balance', 'too_large' FROM people WHERE TRY_CAST(balance AS DOUBLE) > 9000
        UNION ALL SELECT 'mail', 'wrong_pattern' FROM people WHERE mail NOT LIKE '%@%' UNION ALL SELECT 'since', 'wrong_type' FROM people WHERE since = 'soon' UNION ALL SELECT 'segment', 'not_allowed' FROM people WHERE segment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'AUTOMOBILE')
        UNION ALL SELECT 'country', 'missing_required' FROM people UNION ALL SELECT 'code', 'unknown_field' FROM people) SELECT field, error, count(*) AS n FROM e GROUP BY ALL""",
    "migrated_records": f"""WITH {_PEOPLE} SELECT id, TRY_CAST(balance AS DOUBLE) AS balance, code <> 0 AS code, segment || '/KR' AS place, split_part(mail, '@', 1) AS "user", CASE WHEN mail LIKE '%@%' THEN split_part(mail, '@', 2) END AS host,
        CASE WHEN balance = 'n/a' THEN 1 ELSE 0 END AS lost FROM people""",
}
