"""Search over a catalog of data sets: filters, relevance, facets, similar ones and completions.

Data sets are rows of (id, name, display_name, description, domain, subdomain, dataset_type, status,
tags array, columns array of (name, description), score). All filters are optional and add up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a match is worth, and the bounds of the score facet.
WEIGHTS = {"name": 3.0, "display_name": 2.5, "description": 1.5, "column": 1.0, "tag": 0.8, "domain": 0.5, "term": 0.3}
SCORE_BOUNDS = (0, 50, 70, 85, 95, 101)


def _has(c: Column, text: str) -> Column:
    return F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))


def matching(sets: DataFrame, query: str) -> DataFrame:
    """Data sets with the query in any of their texts."""
    test = F.exists("tags", lambda x: _has(x, query)) | F.exists("columns", lambda x: _has(x["name"], query) | _has(x["description"], query))
    for c in ("name", "display_name", "description", "domain"):
        test = test | _has(F.col(c), query)
    return sets.where(test)


def filtered(sets: DataFrame, types: Sequence[str] = (), statuses: Sequence[str] = (), domain: str | None = None, tags: Sequence[str] = (), every_tag: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    tests = []
    if types:
        tests.append(F.col("dataset_type").isin(*types))
    if statuses:
        tests.append(F.col("status").isin(*statuses))
    if domain is not None:
        tests.append(F.col("domain") == domain)
    if tags:
        wanted = F.array(*map(F.lit, tags))
        tests.append(F.size(F.array_except(wanted, "tags")) == 0 if every_tag else F.arrays_overlap("tags", wanted))
    if low is not None:
        tests.append(F.col("score") >= low)
    if high is not None:
        tests.append(F.col("score") <= high)
    for test in tests:
        sets = sets.where(test)
    return sets


def relevance(query: str) -> Column:
    q = query.lower()
    worth = lambda test, w: F.when(test, F.lit(w)).otherwise(0.0)
    total = worth(_has(F.col("name"), q), WEIGHTS["name"]) + worth(F.lower("name") == q, WEIGHTS["name"])
    for c in ("display_name", "description", "domain"):
        total = total + worth(_has(F.col(c), q), WEIGHTS[c])
    total = total + F.size(F.filter("tags", lambda x: _has(x, q))) * WEIGHTS["tag"]
    total = total + F.size(F.filter("columns", lambda x: _has(x["name"], q))) * WEIGHTS["column"]
    total = total + F.size(F.filter("columns", lambda x: _has(x["description"], q))) * (WEIGHTS["column"] * 0.5)
    whole = F.lower(F.concat_ws(" ", "name", "display_name", "description"))
    for term in sorted(set(q.split())):
        total = total + worth(whole.contains(term), WEIGHTS["term"])
    return total


def search(sets: DataFrame, query: str, offset: int = 0, limit: int = 20, **filters) -> DataFrame:
    """A page of the best matches: scored before the page is cut."""
    found = filtered(matching(sets, query), **filters).withColumn("relevance", F.round(relevance(query), 4))
    return found.orderBy(F.desc("relevance"), "id").offset(offset).limit(limit)


def score_bucket(c: Column) -> Column:
    out = None
    for a, b in zip(SCORE_BOUNDS, SCORE_BOUNDS[1:], strict=False):
        test = (c >= a) & (c < b)
        out = F.when(test, str(a)) if out is None else out.when(test, str(a))
    return out.otherwise("unknown")


def facets(sets: DataFrame, top: dict[str, int] | None = None) -> DataFrame:
    """(facet, value, n) of type, status, domain, tag and score: one pass, each facet's most frequent values."""
    single = [("type", F.col("dataset_type")), ("status", F.col("status")), ("domain", F.col("domain")), ("score", score_bucket(F.col("score")))]
    pairs = F.concat(
        F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("value")) for n, c in single]),
        F.transform(F.array_distinct("tags"), lambda x: F.struct(F.lit("tag").alias("facet"), x.alias("value"))),
    )
    counted = sets.select(F.inline(pairs)).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
    limits = {"domain": 10, "tag": 15} | (top or {})
    most = F.coalesce(*[F.when(F.col("facet") == f, F.lit(k)) for f, k in limits.items()], F.lit(1 << 30))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counted.withColumn("p", place).where(F.col("p") <= most).drop("p")


def similar(sets: DataFrame, id_value, limit: int = 10) -> DataFrame:
    """The data sets most like one: same domain or a common tag, then points for what they share."""
    one = sets.where(F.col("id") == id_value).select(*[F.col(c).alias(f"t_{c}") for c in ("domain", "subdomain", "dataset_type", "tags")], F.transform("columns", lambda x: x["name"]).alias("t_columns"))
    both = sets.where(F.col("id") != id_value).join(F.broadcast(one))  # one row
    near = F.coalesce(F.col("domain") == F.col("t_domain"), F.lit(False)) | F.arrays_overlap("tags", "t_tags")
    points = lambda test, n: F.when(test, n).otherwise(0)
    shared = lambda a, b, each, most: F.least(F.size(F.array_intersect(a, b)) * each, F.lit(most))
    score = (
        points(F.col("domain") == F.col("t_domain"), 30)
        + points(F.col("subdomain") == F.col("t_subdomain"), 10)
        + points(F.col("dataset_type") == F.col("t_dataset_type"), 15)
        + shared(F.col("tags"), F.col("t_tags"), 5, 20)
        + shared(F.transform("columns", lambda x: x["name"]), F.col("t_columns"), 3, 25)
    )
    return both.where(near).select("id", "name", score.alias("points")).where("points > 0").orderBy(F.desc("points"), "id").limit(limit)


def column_search(sets: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Columns whose name or description holds the query, with their data set."""
    rows = sets.select("id", F.col("name").alias("dataset"), F.inline("columns"))
    score = F.when(F.lower("name") == query.lower(), 2.0).when(_has(F.col("name"), query), 1.0).otherwise(0.0) + F.when(_has(F.col("description"), query), 0.5).otherwise(0.0)
    return rows.withColumn("points", score).where("points > 0").orderBy(F.desc("points"), "id", "name").limit(limit)


def complete(sets: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Completions from names, tags, columns and domains: each text once, those that begin with the prefix first."""
    kinds = F.concat(
        F.array(F.struct(F.col("name").alias("text"), F.lit("dataset").alias("kind")), F.struct(F.col("domain").alias("text"), F.lit("domain").alias("kind"))),
        F.transform("tags", lambda x: F.struct(x.alias("text"), F.lit("tag").alias("kind"))),
        F.transform("columns", lambda x: F.struct(x["name"].alias("text"), F.lit("column").alias("kind"))),
    )
    texts = sets.select(F.inline(kinds)).where(_has(F.col("text"), prefix))
    once = texts.groupBy(F.lower("text").alias("low"), "kind").agg(F.min("text").alias("text"))
    return once.orderBy(~F.col("low").startswith(prefix.lower()), F.length("text"), "text", "kind").limit(limit).select("text", "kind")


def statistics(sets: DataFrame) -> DataFrame:
    documented = F.size(F.filter("columns", lambda x: F.length(F.coalesce(x["description"], F.lit(""))) > 0))
    return sets.groupBy("dataset_type").agg(
        F.count("*").alias("n"), F.sum(F.size("columns")).alias("columns"), F.sum(documented).alias("documented"), F.round(F.avg(F.when(F.col("score") > 0, F.col("score"))), 4).alias("mean_score")
    )


def popular(log: DataFrame, limit: int = 10, empty: bool = False) -> DataFrame:
    """The most frequent queries of a log (query, results), or of those without results."""
    rows = log.where("results = 0") if empty else log
    return rows.groupBy(F.lower("query").alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(limit)
