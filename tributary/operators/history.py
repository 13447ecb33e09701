"""Histories, trends, run ledgers, health and reports: small aggregates over tables that others write.

Every function makes one conditional aggregate or one join; what is `latest` comes from a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.metrics import exact_mean, exact_sum


def freshness_trend(evaluations: DataFrame) -> DataFrame:
    """By day: fresh, stale and critical evaluations (evaluated_at, status, age_hours), mean age and the share of fresh ones."""
    s = F.col("status")
    counts = [F.count_if(s == k).alias(k) for k in ("fresh", "stale", "critical")]
    out = evaluations.groupBy(F.date_format("evaluated_at", "yyyy-MM-dd").alias("day")).agg(*counts, F.count("*").alias("n"), F.round(exact_mean(F.col("age_hours")), 2).alias("mean_age_hours"))
    return out.withColumn("health_rate", F.round(F.col("fresh") * 100.0 / F.col("n"), 2)).drop("n")


def change_totals(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """By source, over the last days of a change log (source_id, logged_at, total, new, modified, unchanged, skip_ratio, ms): sums, mean skip ratio and the percent that need not move."""
    recent = log.where((F.col("logged_at") >= F.timestamp_add("DAY", F.lit(-days), as_of)) & (F.col("logged_at") <= as_of))
    sums = [F.sum(c).alias(c) for c in ("total", "new", "modified", "unchanged")]
    out = recent.groupBy("source_id").agg(F.count("*").alias("runs"), *sums, F.round(exact_mean(F.col("skip_ratio")), 1).alias("mean_skip_ratio"), exact_sum(F.col("ms")).alias("ms"))
    return out.withColumn("saved", F.round(F.col("unchanged") * 100.0 / F.greatest(F.col("total"), F.lit(1)), 1))


def diff_trends(diffs: DataFrame) -> DataFrame:
    """One row over many diffs (added, deleted, modified, change_rate): sums, mean rate in percent, growth."""
    return diffs.agg(
        F.count("*").alias("diffs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("added", "deleted", "modified")], F.round(exact_mean(F.col("change_rate")) * 100, 2).alias("mean_rate")
    ).withColumn("growth", F.col("added") - F.col("deleted"))


def changed_most(diffs: DataFrame, top: int = 10) -> DataFrame:
    """The fields that change most over many diffs (fields: map of name to count)."""
    return diffs.select(F.explode("fields").alias("field", "n")).groupBy("field").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "field").limit(top)


def registered(schemas: DataFrame) -> DataFrame:
    """By name of a schema (name, version, created_at): versions, the newest, and when the first and last came."""
    return schemas.groupBy("name").agg(F.count("*").alias("versions"), F.max("version").alias("latest_version"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


# Weights of the parts of a catalog entry's score, and the points of a component's health.
WEIGHTS = {"completeness": 0.20, "accuracy": 0.25, "consistency": 0.15, "timeliness": 0.10, "uniqueness": 0.15, "validity": 0.15}
HEALTH = {"healthy": 100.0, "degraded": 70.0, "unhealthy": 30.0}


def catalog_scores(entries: DataFrame) -> DataFrame:
    """entries (mean_null_rate in percent, null without fields; records, errors, and the other parts of WEIGHTS) with completeness, validity and overall, 0 to 100."""
    completeness = F.round(100 - F.coalesce(F.col("mean_null_rate"), F.lit(0.0)), 2)
    validity = F.when(F.col("records") > 0, F.greatest(F.lit(0.0), 100 - F.col("errors") / F.col("records") * 100)).otherwise(100.0)
    out = entries.withColumn("completeness", completeness).withColumn("validity", F.round(validity, 2))
    whole = sum((F.col(c).cast("decimal(12,4)") * F.lit(w).cast("decimal(3,2)") for c, w in WEIGHTS.items()), F.lit(0).cast("decimal(12,4)"))
    return out.withColumn("overall", F.round(whole, 2).cast("double"))


def system_health(levels: DataFrame) -> DataFrame:
    """One row of a system's health: a state for each of four components, score and status.

    levels: success_rate and compliance_rate in percent, counts of stale and critical sources,
    and of critical and of all active alerts.
    """
    c = F.col
    low = lambda rate, bad, poor: F.when(rate < bad, "unhealthy").when(rate < poor, "degraded").otherwise("healthy")
    states = {
        "metrics": low(c("success_rate"), 80, 95),
        "freshness": F.when(c("critical_sources") > 0, "unhealthy").when(c("stale_sources") > 0, "degraded").otherwise("healthy"),
        "sla": low(c("compliance_rate"), 90, 95),
        "alerts": F.when(c("critical_alerts") > 0, "unhealthy").when(c("active_alerts") > 5, "degraded").otherwise("healthy"),
    }
    out = levels.select(*levels.columns, *[s.alias(n) for n, s in states.items()])
    points = [F.element_at(F.create_map(*[x for k, v in HEALTH.items() for x in (F.lit(k), F.lit(v))]), c(n)) for n in states]
    worst = F.array(*[c(n) for n in states])
    status = F.when(F.array_contains(worst, "unhealthy"), "unhealthy").when(F.array_contains(worst, "degraded"), "degraded").otherwise("healthy")
    return out.withColumn("score", F.round(sum(points, F.lit(0.0)) / len(points), 1)).withColumn("status", status)


def entries(history: DataFrame, equal: dict | None = None, actions: Sequence[str] = (), first=None, last=None, text: str | None = None, limit: int = 100, skip: int = 0, newest: bool = True) -> DataFrame:
    """A page of a history (timestamp, id, action, message, ...): by equalities, actions, an inclusive time range and a text in the message."""
    for name, value in (equal or {}).items():
        if value is not None:
            history = history.where(F.col(name) == value)
    if actions:
        history = history.where(F.col("action").isin(*actions))
    if first is not None:
        history = history.where(F.col("timestamp") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        history = history.where(F.col("timestamp") <= F.lit(last).cast("timestamp_ntz"))
    if text is not None:
        history = history.where(F.lower("message").contains(text.lower()))
    order = [F.desc("timestamp"), F.desc("id")] if newest else [F.asc("timestamp"), F.asc("id")]
    return history.orderBy(*order).offset(skip).limit(limit)


def versions_to_back_up(crawlers: DataFrame, history: DataFrame) -> DataFrame:
    """Crawlers (crawler_id, version) that are ahead of the newest version in history: (crawler_id, version, last_version, kind initial or update)."""
    last = history.groupBy("crawler_id").agg(F.max("version").alias("last_version"))
    both = crawlers.select("crawler_id", "version").join(last, "crawler_id", "left")
    kind = F.when(F.col("last_version").isNull(), "initial").when(F.col("last_version") < F.col("version"), "update")
    return both.select("crawler_id", "version", F.coalesce("last_version", F.lit(0)).alias("last_version"), kind.alias("kind")).where("kind is not null")


def numbered_versions(saves: DataFrame, order: Sequence[str] = ("created_at", "save_id")) -> DataFrame:
    """saves (source_id, branch, created_at, save_id, ...) with version_number, parent and status: every one but its branch's last is archived."""
    window = Window.partitionBy("source_id", "branch").orderBy(*order)
    n = F.row_number().over(window)
    status = F.when(F.lead(F.lit(1)).over(window).isNull(), "active").otherwise("archived")
    return saves.withColumn("version_number", n).withColumn("parent", F.when(F.col("version_number") > 1, F.col("version_number") - 1)).withColumn("status", status)


def restore_chains(snapshots: DataFrame) -> DataFrame:
    """Each snapshot (source_id, taken_at, snapshot_id, kind) with base_id and depth, the snapshots that are read to restore it.

    A full one stands alone; a differential one needs the last full one; an incremental one all since then.
    """
    window = Window.partitionBy("source_id").orderBy("taken_at", "snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    full = F.when(F.col("kind") == "full", F.struct("taken_at", "snapshot_id"))
    based = snapshots.withColumn("base", F.last(full, ignorenulls=True).over(window))
    since = Window.partitionBy("source_id", "base").orderBy("taken_at", "snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    steps = F.count_if(F.col("kind") == "incremental").over(since)
    depth = F.when(F.col("kind") == "full", 1).when(F.col("kind") == "differential", 2).otherwise(steps + 1)
    return based.withColumn("depth", F.when(F.col("base").isNotNull(), depth)).withColumn("base_id", F.col("base.snapshot_id")).drop("base")


def run_key(source: Column, operation: Column, params: Column, day: Column | None = None) -> Column:
    """A run's key: source:operation:hash of its parameters (a map of strings) in order of their names, with the day if runs repeat daily."""
    if day is not None:
        params = F.map_concat(params, F.create_map(F.lit("_date"), F.date_format(day, "yyyy-MM-dd")))
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(F.to_json(F.struct(e.key.alias("k"))), F.to_json(F.struct(e.value.alias("v")))))
    return F.concat_ws(":", source, operation, F.substring(F.sha2(F.concat_ws(",", pairs), 256), 1, 16))


def claimed(requests: DataFrame, ledger: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """requests (key, owner, asked_at) with outcome: acquired, or held or done by the ledger (key, status, owner, updated_at).

    Of several requests for one key the first gets it. A running entry older than so many minutes
    has lost its owner, and its key is free again.
    """
    first = F.row_number().over(Window.partitionBy("key").orderBy("asked_at", "owner"))
    last = ledger.groupBy("key").agg(F.max_by(F.struct("status", "owner", "updated_at"), F.struct("updated_at", "owner")).alias("r"))
    both = requests.withColumn("__n", first).join(last, "key", "left")
    live = (F.col("r.status") == "running") & (F.col("r.updated_at") > F.timestamp_add("MINUTE", F.lit(-minutes), as_of))
    outcome = F.when(F.col("r.status") == "completed", "done").when(F.coalesce(live, F.lit(False)) | (F.col("__n") > 1), "held").otherwise("acquired")
    return both.select(*requests.columns, outcome.alias("outcome"))


def resume_points(ledger: DataFrame, steps: Sequence[str]) -> DataFrame:
    """By key of a ledger of steps (key, step, status, updated_at): done steps, the step to go on from (null if none is left), and whether the last attempt failed."""
    last = ledger.groupBy("key", "step").agg(F.max_by("status", "updated_at").alias("status"))
    done = F.collect_set(F.when(F.col("status") == "completed", F.col("step")))
    out = last.groupBy("key").agg(done.alias("done"), F.bool_or(F.col("status") == "failed").alias("failed"))
    left = F.filter(F.array(*map(F.lit, steps)), lambda s: ~F.array_contains("done", s))
    return out.withColumn("next_step", F.try_element_at(left, F.lit(1))).select("key", F.size("done").alias("done"), "next_step", "failed")


def job_progress(items: DataFrame) -> DataFrame:
    """By job of a ledger of items (job_id, status, error): how many are through and failed, the percent, and the state."""
    s = F.col("status")
    out = items.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(s.isin("done", "failed")).alias("processed"), F.count_if(s == "failed").alias("failed"))
    state = F.when(F.col("processed") < F.col("total"), "running").when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    return out.withColumn("percent", F.round(F.col("processed") * 100.0 / F.col("total"), 2)).withColumn("state", state)


def contract_days(results: DataFrame) -> DataFrame:
    """By contract and day of validations (contract, validated_at, success, failed_expectations): runs, successes and their percent, with the change from the day before."""
    out = results.groupBy("contract", F.to_date("validated_at").alias("day")).agg(F.count("*").alias("runs"), F.count_if("success").alias("passed"), F.sum("failed_expectations").alias("failed_expectations"))
    rate = F.round(F.col("passed") * 100.0 / F.col("runs"), 2)
    before = F.lag("success_rate").over(Window.partitionBy("contract").orderBy("day"))
    return out.withColumn("success_rate", rate).withColumn("change", F.round(F.col("success_rate") - before, 2))


def contract_health(results: DataFrame, as_of: Column) -> DataFrame:
    """By contract: percent of successes in the last 30 and in the last 7 days, and whether it got better or worse by over 5 points."""
    at, ok = F.col("validated_at"), F.col("success")
    since = lambda n: (at >= F.timestamp_add("DAY", F.lit(-n), as_of)) & (at <= as_of)
    rate = lambda n: F.round(F.try_divide(F.count_if(ok & since(n)) * 100.0, F.count_if(since(n))), 2)
    out = results.groupBy("contract").agg(rate(30).alias("rate_30d"), rate(7).alias("rate_7d"))
    move = F.col("rate_7d") - F.col("rate_30d")
    return out.withColumn("trend", F.when(move.isNull(), "unknown").when(move > 5, "improving").when(move < -5, "declining").otherwise("stable"))


def contract_report(results: DataFrame) -> DataFrame:
    """Lines of a text report (contract, place, line) of expectation results (contract, expectation, column, success, failed_rows): a head, then what fails, the worst first."""
    head = results.groupBy("contract").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))
    state = F.when(F.col("ok") == F.col("n"), "PASSED").otherwise("FAILED")
    top = head.select("contract", F.lit(0).alias("place"), F.concat("contract", F.lit(": "), state, F.lit(" ("), F.col("ok").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" expectations)")).alias("line"))
    order = Window.partitionBy("contract").orderBy(F.desc("failed_rows"), "expectation", "column")
    bad = results.where("not success").withColumn("place", F.row_number().over(order))
    return top.unionByName(bad.select("contract", "place", F.concat(F.lit("- "), "expectation", F.lit(" on "), "column", F.lit(": "), F.col("failed_rows").cast("string"), F.lit(" rows")).alias("line")))


def error_codes(errors: DataFrame) -> DataFrame:
    """By code of errors (error_code, message, source_id, occurred_at, error_id, resolved): counts, unresolved ones, the first message, the last time and how many sources."""
    return errors.groupBy("error_code").agg(
        F.count("*").alias("n"), F.count_if(~F.col("resolved")).alias("unresolved"), F.min_by("message", F.struct("occurred_at", "error_id")).alias("first_message"),
        F.max("occurred_at").alias("last_at"), F.count_distinct("source_id").alias("sources"),
    )


def unresolved_sources(errors: DataFrame, top: int = 10) -> DataFrame:
    """The sources with the most unresolved errors."""
    return errors.where(~F.col("resolved")).groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").limit(top)


def source_report(affected: DataFrame) -> DataFrame:
    """What the loss of a source reaches, from lineage.impact's rows (id, type, distance, level): counts by type, the nearest, and how many are critical."""
    return affected.groupBy("type").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"), F.count_if(F.col("level") == "critical").alias("critical"))


#: Words in an error's message, in order of their weight: (cause, words).
# The words that the survey names.
CAUSES = (
    ("network_error", ("timeout", "timed out")),
    ("selector_broken", ("selector", "not found", "none")),
    ("auth_required", ("401", "403", "auth")),
    ("rate_limited", ("429", "rate", "blocked")),
    ("parse_error", ("parse", "json", "decode")),
)


def diagnosis(message: Column) -> Column:
    """The likely cause of an error, by words in its message."""
    low = F.lower(message)
    return F.coalesce(*[F.when(sum((low.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(cause)) for cause, words in CAUSES], F.lit("unknown"))


#: Words in a source's name or address: (kind, words).
# The words that the survey names.
KINDS = (
    ("news", ("news", "뉴스", "article", "기사")),
    ("financial", ("stock", "주식", "finance", "금융")),
    ("announcement", ("공시", "disclosure", "announcement")),
)


def collection_kind(name: Column, url: Column) -> Column:
    """Which kind of collection a source fills, by words in its name or address."""
    both = F.concat_ws("\n", F.lower(name), F.lower(url))
    return F.coalesce(*[F.when(sum((both.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(kind)) for kind, words in KINDS], F.lit("generic"))


#: Fields that speak for a category.
# The words that the survey names.
INDICATORS = {
    "news_article": ("title", "content", "published_at", "summary"),
    "stock_price": ("stock_code", "price", "volume", "high", "low"),
    "exchange_rate": ("currency_code", "base_rate", "buy_rate", "sell_rate"),
    "market_index": ("index_code", "value", "change_rate"),
    "announcement": ("announcement_type", "company_name", "stock_code"),
    "financial_data": ("price", "change", "volume", "change_rate"),
}


def field_category(fields: Column, least: float = 0.3) -> Column:
    """The category most of whose fields are among an array of names; generic if that is less than `least` of them."""
    shares = [F.struct((F.size(F.array_intersect(fields, F.array(*map(F.lit, own)))) / float(len(own))).alias("share"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, own) in enumerate(INDICATORS.items())]
    best = F.array_max(F.array(*shares))
    return F.when(best.share >= least, best["name"]).otherwise("generic")


TAGS = ("table", "tr", "td", "div", "a", "li", "article", "section")


def _marks(html: Column, name: str) -> Column:
    """The values of an attribute in a page's tags, each once, in order."""
    quoted = F.regexp_extract_all(html, F.lit(rf"""(?is)<[a-z][^<>]*?\s{name}\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.split(F.array_join(quoted, " "), r"\s+"), lambda x: x != "")))


def page_changes(pages: DataFrame, before: str, after: str) -> DataFrame:
    """pages with removed_ids, added_ids, removed_classes and tag_changes (tag, before, after) between two texts of a page, and whether its structure changed."""
    a, b = F.col(before), F.col(after)
    count = lambda c, tag: F.regexp_count(c, F.lit(rf"(?i)<{tag}[\s>/]"))
    tags = F.array_compact(F.array(*[F.when(count(a, t) != count(b, t), F.struct(F.lit(t).alias("tag"), count(a, t).alias("before"), count(b, t).alias("after"))) for t in TAGS]))
    out = pages.withColumns({"__ai": _marks(a, "id"), "__bi": _marks(b, "id"), "__ac": _marks(a, "class"), "__bc": _marks(b, "class"), "tag_changes": tags})
    out = out.withColumns({"removed_ids": F.array_except("__ai", "__bi"), "added_ids": F.array_except("__bi", "__ai"), "removed_classes": F.array_except("__ac", "__bc")})
    changed = (F.size("removed_ids") > 0) | (F.size("removed_classes") > 5) | (F.size("tag_changes") > 3)
    return out.withColumn("structure_changed", changed).drop("__ai", "__bi", "__ac", "__bc")


def serialized(events: DataFrame) -> DataFrame:
    """Events as (event_id, event_type, payload): every column but those two as JSON."""
    rest = [c for c in events.columns if c not in ("event_id", "event_type")]
    return events.select("event_id", "event_type", F.to_json(F.struct(*rest)).alias("payload"))


def deserialized(rows: DataFrame, shapes: dict[str, str]) -> dict[str, DataFrame]:
    """Rows of serialized() by the prefix of their type (before the first dot), each with its own schema; others go to `other` as they are."""
    prefix = F.substring_index("event_type", ".", 1)
    out = {name: rows.where(prefix == name).select("event_id", "event_type", F.from_json("payload", shape).alias("p")).select("event_id", "event_type", "p.*") for name, shape in shapes.items()}
    return out | {"other": rows.where(~prefix.isin(*shapes))}


def tables_to_register(spark, known: DataFrame, database: str | None = None) -> DataFrame:
    """(name, columns) of the session's tables that a catalog (name) does not have yet; columns as name:type in order."""
    found = [(t.name, ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in spark.table(t.name).schema.fields)) for t in spark.catalog.listTables(database)]
    made = spark.createDataFrame(found, "name string, columns string")
    return made.join(known.select("name"), "name", "left_anti")


def encoding_of(content: Column) -> Column:
    """A page's or file's encoding, from its first bytes: by its byte-order mark, what it declares in its head, or UTF-8."""
    head = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    mark = F.upper(F.hex(F.substring(content, 1, 3)))
    declared = F.regexp_extract(head, r"""(?:charset|encoding)\s*=\s*["']?([a-z0-9_-]+)""", 1)
    return F.when(mark.startswith("EFBBBF"), "utf-8").when(mark.startswith("FFFE"), "utf-16le").when(mark.startswith("FEFF"), "utf-16be").when(declared != "", declared).otherwise("utf-8")


def tables_of(documents: DataFrame, key: str, content: str, parse, fields: Sequence[str]) -> DataFrame:
    """Rows of the tables in documents, by a parser of bytes that gives tables as lists of rows of cells: (key, table, row, and the fields as strings).

    A table's first row that is not blank is its head; a head is matched to fields by its cleaned
    name, blank rows are left out, and so are columns that no field claims.
    """
    import pandas as pd

    from tributary.sources.files import clean_name, map_columns

    asked = [{"name": f} for f in fields]
    columns = [key, "table", "row", *fields]

    def rows(batches):
        for batch in batches:
            out = []
            for k, data in zip(batch[key], batch[content], strict=True):
                for t, table in enumerate(parse(bytes(data)) if data is not None else []):
                    kept = [r for r in table if any(c is not None and str(c).strip() for c in r)]
                    if not kept:
                        continue
                    head = [clean_name(c) for c in kept[0]]
                    claimed = map_columns(head, asked)
                    place = {f: head.index(c) for c, f in reversed(claimed.items())}
                    for i, r in enumerate(kept[1:]):
                        out.append((k, t, i, *[None if f not in place or place[f] >= len(r) or r[place[f]] is None else str(r[place[f]]).strip() for f in fields]))
            yield pd.DataFrame(out, columns=columns)

    kind = dict(documents.dtypes)[key]
    return documents.select(key, content).mapInPandas(rows, f"`{key}` {kind}, table int, row int, " + ", ".join(f"`{f}` string" for f in fields))
