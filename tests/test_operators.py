import datetime as dt

from pyspark.sql import functions as F

from tributary.operators import changes as c
from tributary.operators import contracts as k
from tributary.operators import dedup, lineage, metrics, quality
from tributary.operators import schemas as s


def test_contract_edges(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert all(r["success"] for r in k.measure(none, [k.not_null("a"), k.unique("a"), k.in_range("a", 0)]).collect())
    rows = spark.createDataFrame([(None, "1"), (None, "2")], "a string, b string")
    got = {r["id"]: r for r in k.measure(rows, [k.in_range("a", 0), k.in_range("a", 0, allow_null=False), k.not_null("a", mostly=0.0), k.unique("a", 0.1), k.row_count_between(3)]).collect()}
    assert [got[i]["success"] for i in range(5)] == [True, False, True, False, False]
    assert got[0]["elements"] == 0 and got[0]["ratio"] == 1.0
    exact = spark.createDataFrame([("1",), ("2",), ("3",), ("x",)], "a string")
    assert k.measure(exact, [k.in_range("a", 0, mostly=0.75)]).first()["success"]


def test_route_takes_the_worst_severity(spark):
    rows = spark.createDataFrame([(1, None, "9"), (2, "x", "99"), (3, "y", "1")], "id int, a string, b string")
    got = {r["id"]: (r["_validation_issue"], r["_route"]) for r in k.route(rows, [k.not_null("a", severity="critical"), k.in_range("b", 0, 5, severity="error")]).collect()}
    assert got == {1: ("critical", "quarantine"), 2: ("error", "invalid"), 3: (None, "valid")}
    assert {r["_route"] for r in k.route(rows, [k.not_null("a", mostly=0.5)]).collect()} == {"valid"}


def test_rules(spark):
    rows = spark.createDataFrame([(1, "�", "2024-01-01"), (2, "", "2024-02-02"), (3, "ok", "2024-01-31"), (4, "â€™", "x"), (5, None, None)], "id int, a string, d string")
    at = F.lit("2024-01-30 12:00:00").cast("timestamp")
    found = quality.issues(rows, [*quality.encoding("a"), quality.dated("d", at)])
    got = {r["id"]: [(x["rule"], x["severity"]) for x in r["issues"]] for r in found.collect()}
    assert got == {1: [("encoding", "error")], 2: [("encoding", "warning"), ("date", "error")], 3: [], 4: [("encoding", "error"), ("date", "error")], 5: []}


def test_compatibility():
    old = [s.Field("a", "integer"), s.Field("b", "string", True)]
    assert s.compatible(old, [s.Field("a", "float"), s.Field("b", "string", True)]) == []
    assert len(s.compatible(old, [s.Field("a", "boolean"), s.Field("b", "string", True), s.Field("c", "string", True)])) == 2
    assert s.compatible(old, old[:1], "backward") == [] and s.compatible(old, old[:1], "forward")
    assert s.compatible(old, [], "none") == []
    assert s.fingerprint(old) == s.fingerprint(old[::-1])
    assert s.compare(old, [s.Field("a", "float"), s.Field("d")]) == {"added": ["d"], "removed": ["b"], "changed": ["a"]}
    assert s.undo([("rename", "a", "b"), ("add", "c", "string", None)]) == [("remove", "c"), ("rename", "b", "a")]


def test_inference_and_drift(spark):
    rows = spark.createDataFrame([("1", "2024-01-01", "x", None), ("2", "2024-01-02", "y", "1.5")], "i string, d string, t string, f string")
    got = {f.name: (f.kind, f.required) for f in s.infer(rows)}
    assert got == {"i": ("integer", True), "d": ("date", True), "t": ("string", True), "f": ("float", False)}
    assert s.infer(rows.limit(0))[0].kind == "string"


def test_diff_edges(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (2, "B", "y")], "id int, v string, w string").withColumn("o", F.monotonically_increasing_id())
    new = spark.createDataFrame([(1, "A", None), (3, None, None)], "id int, v string, z string").withColumn("o", F.monotonically_increasing_id())
    got = {r["id"]: (r["change"], [tuple(f) for f in r["fields"]]) for r in c.diff(old, new, ["id"], order="o").collect()}
    assert got == {1: ("modified", [("v", "modified", "a", "A")]), 2: ("deleted", []), 3: ("added", [])}
    same = {r["id"]: r["change"] for r in c.diff(old, new, ["id"], order="o", case=False).collect()}
    assert same[1] == "unchanged"
    empty = old.limit(0)
    assert c.summary(c.diff(empty, empty, ["id"])).first()["change_rate"] == 0.0


def test_dedup_edges(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "A", None), (3, "a", "k"), (4, "a", "k")], "i int, t string, k string")
    flags = lambda df: [r["_duplicate"] for r in df.orderBy("i").collect()]
    assert flags(dedup.by_key(rows, ["k"], "i")) == [False, False, False, True]
    assert flags(dedup.by_key(rows, ["k"], "i", ignore_null=False)) == [False, True, False, True]
    assert flags(dedup.by_key(rows, ["k"], "i", "last")) == [False, False, True, False]
    assert flags(dedup.by_hash(rows, ["t"], "i", case=False)) == [False, True, True, True]
    assert flags(dedup.exact(rows, "i")) == [False, False, False, True]
    assert flags(dedup.fuzzy(rows.withColumn("t", F.concat("t", F.lit("bcdef"), F.col("i").cast("string"))), "i", "t", 0.6)) == [False, True, True, True]


def test_throttle_counts_what_was_sent(spark):
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=x) for x in (0, 1, 2, 10, 11, 12, 500)]
    rows = spark.createDataFrame([("a", x) for x in at], "k string, t timestamp_ntz")
    got = [r["sent"] for r in metrics.throttled(rows, "k", "t", 2, 10).orderBy("t").collect()]
    assert got == [True, True, False, True, True, False, True]


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def test_graphs(spark):
    diamond = _edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "x")])
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r["id"], r["distance"]) for r in lineage.reach(diamond, start).collect()} == {("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert sorted(tuple(r["path"]) for r in lineage.paths(diamond, "a", "d").collect()) == [("a", "b", "d"), ("a", "c", "d")]
    assert [tuple(r["path"]) for r in lineage.paths(diamond, "a", "e", shortest=True).collect()] == [("a", "b", "d", "e")]
    assert lineage.paths(diamond, "e", "a").count() == 0
    assert {(r["source"], r["target"]) for r in lineage.cyclic(diamond).collect()} == {("x", "x")}
    assert {r["id"]: r["level"] for r in lineage.levels(diamond).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "x": None}
    ids = spark.createDataFrame([("lone",), ("a",)], "id string")
    assert {r["id"]: r["component"] for r in lineage.components(diamond, ids).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "x": "x", "lone": "lone"}
    long = _edges(spark, [(f"{i:02}", f"{i + 1:02}") for i in range(14)])
    assert lineage.reach(long, spark.createDataFrame([("00",)], "id string")).count() == 10


def test_an_error_meets_two_cases_at_most(spark):
    from tributary.operators import workflow

    errors = spark.createDataFrame([(i, f"p{i % 50}", "c") for i in range(100)], "error_id long, pattern string, category string")
    cases = spark.createDataFrame([(i, f"p{i}", "c", 0.5 + i % 2 / 2, i) for i in range(60)], "case_id long, pattern string, category string, success_rate double, success_count long")
    best = workflow.best_cases(errors, cases)
    assert [(r["error_id"], r["case_id"]) for r in best.orderBy("error_id").collect()] == [(i, 59) for i in range(100)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 3 and plan.count("Join") == 2  # cases are reduced to one a key before each join


def test_throttled_goes_through_a_task_once(spark):
    rows = spark.createDataFrame([(k, t) for k in ("a", "b", None) for t in ("2024-01-01 00:00:00", "2024-01-01 00:00:05", "2024-01-01 00:00:10", "2024-01-02 00:00:00", None)], "k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = metrics.throttled(rows, "k", "t", 1, 10)
    got = [(r["k"], r["t"] and r["t"].day, r["t"] and r["t"].second, r["sent"]) for r in out.orderBy("k", F.asc_nulls_last("t")).collect()]
    assert got == [(k, d, s, sent) for k in (None, "a", "b") for d, s, sent in ((1, 0, True), (1, 5, False), (1, 10, True), (2, 0, True), (None, None, True))]
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # no call of Python for each stretch
