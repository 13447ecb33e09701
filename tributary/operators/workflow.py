"""Reviews, bulk decisions, cascades, version metadata, activity and the best known case for an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_reviews(results: DataFrame, known: DataFrame, items: str = "data") -> DataFrame:
    """A pending review for each item of a result (result_id, data array of structs) that has none yet."""
    rows = results.select("result_id", F.posexplode(items).alias("item_index", "item"))
    return rows.join(known.select("result_id", "item_index"), ["result_id", "item_index"], "left_anti").select("result_id", "item_index", "item.*", F.lit("pending").alias("status"))


def decide(reviews: DataFrame, ids: DataFrame, decision: str) -> tuple[DataFrame, DataFrame]:
    """reviews with the pending ones among ids (review_id) decided; and ids that were not there or not pending, with the reason."""
    asked = ids.select("review_id").distinct().withColumn("__asked", F.lit(True))
    hit = F.col("__asked").isNotNull() & (F.col("status") == "pending")
    done = reviews.join(asked, "review_id", "left").withColumn("status", F.when(hit, decision).otherwise(F.col("status"))).drop("__asked")
    state = asked.join(reviews.select("review_id", F.col("status").alias("now")), "review_id", "left")
    failed = state.where(F.col("now").isNull() | (F.col("now") != "pending")).select("review_id", F.when(F.col("now").isNull(), "missing").otherwise(F.col("now")).alias("reason"))
    return done, failed


def decide_where(reviews: DataFrame, test: Column, decision: str) -> DataFrame:
    return reviews.withColumn("status", F.when((F.col("status") == "pending") & F.coalesce(test, F.lit(False)), decision).otherwise(F.col("status")))


def revert(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    """Decided reviews among ids back to pending."""
    return reviews.join(ids.select("review_id").distinct().withColumn("__asked", F.lit(True)), "review_id", "left").withColumn("status", F.when(F.col("__asked"), "pending").otherwise(F.col("status"))).drop("__asked")


def without_sources(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table (rows, its source column) without the rows of the sources that go (source_id)."""
    ids = gone.select(F.col("source_id").alias("__gone")).distinct()
    return {name: rows.join(ids, F.col(key) == F.col("__gone"), "left_anti") for name, (rows, key) in tables.items()}


def resolve(errors: DataFrame, test: Column, stamp: Column) -> DataFrame:
    """Open errors that meet the test become resolved."""
    hit = ~F.col("resolved") & F.coalesce(test, F.lit(False))
    return errors.withColumn("resolved_at", F.when(hit, stamp).otherwise(F.col("resolved_at"))).withColumn("resolved", F.col("resolved") | hit)


def latest_states(evaluations: DataFrame) -> DataFrame:
    """(kind, status, n) over the newest evaluation of each level (sla_id, kind, status, evaluated_at)."""
    newest = evaluations.groupBy("sla_id").agg(F.max_by(F.struct("kind", "status"), "evaluated_at").alias("r"))
    return newest.groupBy("r.kind", "r.status").agg(F.count("*").alias("n"))


def activity(history: DataFrame, unit: str, shape: str) -> DataFrame:
    """By hour or day: entries, actors, and the set of actions, in order."""
    return history.groupBy(F.date_format(F.date_trunc(unit, "timestamp"), shape).alias("bucket")).agg(
        F.count("*").alias("entries"), F.count_distinct("actor").alias("actors"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions")
    )


def history_totals(history: DataFrame, top: int = 10) -> DataFrame:
    """(by, value, n, failed) of actions and of the most active actors."""
    rows = history.select("success", F.inline(F.array(F.struct(F.lit("action").alias("by"), F.col("action").alias("value")), F.struct(F.lit("actor").alias("by"), F.col("actor").alias("value")))))
    counted = rows.groupBy("by", "value").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failed"))
    place = F.row_number().over(Window.partitionBy("by").orderBy(F.desc("n"), "value"))
    return counted.withColumn("p", place).where((F.col("by") == "action") | (F.col("p") <= top)).drop("p")


def add_version(versions: DataFrame, source_id, records: int, digest: str, stamp: str, branch: str = "main") -> DataFrame:
    """versions with the next one of a source and branch; the one before is archived and its parent."""
    here = (F.col("source_id") == source_id) & (F.col("branch") == branch)
    old = versions.withColumn("status", F.when(here & (F.col("status") == "active"), "archived").otherwise(F.col("status")))
    top = versions.where(here).agg(F.coalesce(F.max("version_number"), F.lit(0)).alias("n"))
    new = top.select(
        F.lit(source_id).alias("source_id"), F.lit(branch).alias("branch"), (F.col("n") + 1).cast("int").alias("version_number"), F.when(F.col("n") > 0, F.col("n")).cast("int").alias("parent"), F.lit("active").alias("status"),
        F.lit(records).cast("long").alias("records"), F.lit(digest).alias("data_hash"), F.array().cast("array<string>").alias("tags"), F.lit(stamp).alias("created_at"),
    )
    return old.unionByName(new)


def tag_version(versions: DataFrame, test: Column, add: Sequence[str] = (), remove: Sequence[str] = ()) -> DataFrame:
    tags = F.array_sort(F.array_except(F.array_union("tags", F.array(*map(F.lit, add)) if add else F.array().cast("array<string>")), F.array(*map(F.lit, remove)) if remove else F.array().cast("array<string>")))
    return versions.withColumn("tags", F.when(test, tags).otherwise(F.col("tags")))


def find_version(versions: DataFrame, source_id, number: int | None = None, tag: str | None = None, branch: str = "main") -> DataFrame:
    """A source's version by number or tag; without either, its active one."""
    rows = versions.where((F.col("source_id") == source_id) & (F.col("branch") == branch))
    if number is not None:
        return rows.where(F.col("version_number") == number)
    return rows.where(F.array_contains("tags", tag)) if tag is not None else rows.where("status = 'active'")


def best_cases(errors: DataFrame, cases: DataFrame, least: float = 0.6) -> DataFrame:
    """Each error (error_id, pattern, category) with the known case (case_id, pattern, category, success_rate, success_count) of its pattern or else category.

    An OR between two keys is two equi-joins united, each with the best case of every key, so an error meets two cases at most.
    """
    good = cases.where(F.col("success_rate") >= least)
    best = F.max(F.struct("success_count", "case_id")).alias("best")
    found = [errors.join(good.groupBy(F.col(key).alias("__key")).agg(best), F.col(key) == F.col("__key")).select("error_id", "best") for key in ("pattern", "category")]
    return found[0].union(found[1]).groupBy("error_id").agg(F.max("best")["case_id"].alias("case_id"))


def conditional_totals(rows: DataFrame, by: Sequence[str], size: str, ok: Column, stamp: str) -> DataFrame:
    """Backups and the like: rows, good ones, bytes of good ones, mean, first and last."""
    good = F.when(ok, F.col(size))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("good"), F.coalesce(F.sum(good), F.lit(0)).alias("bytes"), F.round(F.avg(good), 2).alias("mean_bytes"), F.min(stamp).alias("first"), F.max(stamp).alias("last")
    )


def failing_columns(results: DataFrame, top: int = 10) -> DataFrame:
    """The expectations that fail most, as expectation:column, from contract results (day, expectation, column, success)."""
    name = F.concat_ws(":", "expectation", "column")
    return results.where("not success").groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def refresh(counters: DataFrame, rejected: DataFrame) -> DataFrame:
    """Source counters (source_id, recrawls, changed, same) after rejections (source_id, reason): what to do next with each source."""
    kinds = {"recrawls": "recrawl", "changed": "source_changed", "same": "not_updated"}
    new = rejected.groupBy("source_id").agg(*[F.count_if(F.col("reason") == r).alias(f"__{c}") for c, r in kinds.items()])
    both = counters.join(new, "source_id", "full_outer")
    return both.select("source_id", *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).cast("long").alias(c) for c in kinds])
