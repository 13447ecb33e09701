"""Reach of schema changes, dependencies, stages and migration modes on small tables."""

import pytest

from tributary.operators import contracts, impact, quality, schemas
from tributary.operators.schemas import Field


def test_changes_name_what_breaks():
    old = [Field("a", "integer", True, False), Field("b", "float"), Field("c"), Field("d", "date")]
    new = [Field("a", "string", True, False), Field("b", "integer"), Field("d", "date"), Field("e", "string", True)]
    found = {name: (kind, breaking) for name, kind, breaking, _ in impact.schema_changes(old, new)}
    assert found == {"a": ("changed", True), "b": ("changed", True), "c": ("removed", False), "e": ("added", True)}
    assert impact.schema_changes(old, old) == []


def test_the_worst_of_several_changes_counts(spark):
    edges = spark.createDataFrame([(1, 10), (10, 11), (11, 12), (12, 13), (2, 12), (3, 10), (13, 1)], "source long, target long")
    columns = spark.createDataFrame([(i, i // 10, "report" if i == 13 else "table") for i in (1, 2, 3, 10, 11, 12, 13)], "id long, data_set long, kind string")
    changes = spark.createDataFrame([(1, "changed", True), (2, "removed", False), (3, "added", True)], "id long, change string, breaking boolean")
    got = {r["id"]: (r["distance"], r["level"], r["breaking"], r["changes"]) for r in impact.schema_impact(changes, edges, columns).collect()}
    assert got[10] == (1, "high", True, ["changed:1", "removed:2"])
    assert got[12] == (1, "critical", True, ["changed:1", "removed:2"])
    assert got[13] == (2, "critical", True, ["changed:1", "removed:2"])
    assert 3 not in got and got[1][0] == 3  # around the cycle, from 2
    assert impact.schema_impact(changes.limit(0), edges, columns).count() == 0


def test_dependencies(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 2)], "source long, target long")
    got = {r["id"]: tuple(r)[1:] for r in impact.dependencies(edges, spark.createDataFrame([(1,), (4,), (9,)], "id long")).collect()}
    assert got == {1: (0, 0, 0, 2, 4, 3, 2), 4: (2, 3, 2, 1, 1, 1, 1), 9: (0,) * 7}


def test_stages(spark):
    rows = spark.createDataFrame([(1, None, "5"), (2, "x", "99"), (3, "x", "5")], "id int, a string, b string")
    stages = [("one", [quality.required("a")]), ("two", [quality.in_range("b", high=9)])]
    stop = {r["id"]: ([(s["stage"], s["passed"]) for s in r["stages"]], r["passed"]) for r in quality.staged(rows, stages, go_on=False).collect()}
    assert stop == {1: ([("one", False)], False), 2: ([("one", True), ("two", False)], False), 3: ([("one", True), ("two", True)], True)}
    assert [len(r["stages"]) for r in quality.staged(rows, stages).collect()] == [2, 2, 2]


def test_migration_modes(spark):
    rows = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, a string")
    steps = [("type", "a", "string", "integer")]
    assert sorted(r["id"] for r in schemas.migrate_all(rows, steps, "skip").collect()) == [1, 3]
    assert {r["id"]: (r["a"], r["_lost"]) for r in schemas.migrate_all(rows, steps).collect()} == {1: (5, []), 2: (None, ["a"]), 3: (None, [])}
    with pytest.raises(Exception, match="cannot be migrated: a"):
        schemas.migrate_all(rows, steps, "fail").collect()
    assert schemas.migrate_all(rows.where("id <> 2"), steps, "fail").count() == 2
    assert [tuple(r) for r in schemas.estimate(rows, steps).collect()] == [(0, "type", "a", 2, 1)]
    with pytest.raises(ValueError):
        schemas.migrate_all(rows, steps, "other")


def test_templates_hold_for_good_rows(spark):
    news = spark.createDataFrame([(f"title {i}", f"https://x.org/{i}") for i in range(10)], "title string, url string")
    assert contracts.holds(contracts.measure(news, contracts.TEMPLATES["news_articles"]()).collect(), fail_on_warning=True)
    assert not contracts.holds(contracts.measure(news.limit(0), contracts.TEMPLATES["generic_table"](["title"])).collect())
    nulls = news.unionByName(news.selectExpr("cast(null as string) as title", "cast(null as string) as url"))
    assert contracts.route(nulls, contracts.TEMPLATES["news_articles"]()).where("_route = 'valid'").count() == 10


def test_walks_do_not_copy_edges(spark, monkeypatch):
    copied = []
    monkeypatch.setattr(impact, "cut", lambda df, cut=impact.cut: copied.append(df.columns) or cut(df))
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (None, 3), (3, None)], "source long, target long")
    starts = spark.createDataFrame([(1, 1), (3, 3)], "origin long, id long")
    assert {tuple(r) for r in impact.walked(edges, starts, 4).collect()} == {(1, 2, 1), (1, 3, 2), (3, 1, 1), (3, 2, 2)}
    assert ["source", "target"] not in copied
