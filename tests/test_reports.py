"""The registry of schemas, previews and contracts that skip, on small tables."""

from pyspark.sql import functions as F

from tributary.operators import contracts, reports
from tributary.operators.schemas import Field


def test_registry(spark):
    none = spark.createDataFrame([], reports.REGISTRY)
    first = [Field("a", "integer", True), Field("b", values=("x", "y"))]
    one, problems = reports.register(none, "s", first, "t1")
    assert problems == [] and reports.newest_schema(one, "s")[2] == sorted(first, key=lambda f: f.name)
    assert reports.register(one, "s", first, "t2")[0].count() == 1
    worse = [Field("a", "boolean", True)]
    refused, problems = reports.register(one, "s", worse, "t3")
    assert refused.count() == 1 and any("a changes" in p for p in problems)
    wider = [Field("a", "float", True), Field("b", values=("x", "y", "z"))]
    two, problems = reports.register(one, "s", wider, "t4")
    assert problems == [] and reports.newest_schema(two, "s")[0] == 2
    gone = reports.deprecated(two, "s", 2, "late")
    assert reports.newest_schema(gone, "s") == (2, reports.newest_schema(one, "s")[1], reports.newest_schema(one, "s")[2])
    line = reports.exported(two.where("version = 2")).first()["document"]
    copied, _ = reports.imported(gone, "other", line, "t5")
    assert reports.newest_schema(copied, "other")[2] == reports.newest_schema(two, "s")[2]
    assert {r["source_id"]: (r["versions"], r["newest"], r["active"]) for r in reports.registered_sources(copied).collect()} == {"s": (2, 2, 1), "other": (1, 1, 1)}


def test_previews(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", " "), (1, "c", "x"), (2, None, "y")], "page int, name string, price string")
    got = {r["page"]: r for r in reports.preview(rows, "page", ["name", "price"], 2).collect()}
    assert (got[1]["total_found"], got[1]["shown"], got[1]["name_found"], got[1]["price_empty"], got[1]["warnings"]) == (3, 2, 3, 2, ["price: mostly empty"])
    assert got[2]["warnings"] == ["name: never found"]


def test_contracts_that_cannot_be_evaluated(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, v string")
    contract = [contracts.not_null("none"), contracts.not_null("v"), contracts.unique("gone")]
    assert {r["id"]: r["status"] for r in contracts.measure_all(rows, contract).collect()} == {0: "skipped", 1: "passed", 2: "skipped"}
    assert {r["status"] for r in contracts.measure_all(rows, contract[:1]).collect()} == {"skipped"}


def test_rates_round_their_halves_up(spark):
    rows = spark.createDataFrame([(1, "2024-01-06 10:00:00", 1, x, []) for x in (1.1, 40.0, 36.45)], "k int, at string, records int, score double, issues array<struct<severity:string,rule:string>>")
    day = reports.quality_timeline(rows.withColumn("created_at", F.col("at").cast("timestamp_ntz")), "day").first()  # 77.55 / 3 prints as 25.849999999999998
    assert (day["avg_score"], day["min_score"], day["max_score"]) == (25.9, 1.1, 40.0)
