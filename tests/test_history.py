import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.operators import changes as c
from tributary.operators import contracts as k
from tributary.operators import history as h
from tributary.operators import lineage, metrics
from tributary.session import scratch
from tributary.sources import exports, files


def test_cooldown_counts_what_was_sent(spark):
    rng = random.Random(3)
    minutes = [(key, 4 * i) for key in ("a", None) for i in range(15)] + [("b", rng.randint(0, 3_000)) for _ in range(80)] + [("b", 10**6), ("b", 10**6 + 2)]
    rows = spark.createDataFrame(minutes, "key string, m long").withColumn("at", F.timestamp_add("MINUTE", "m", F.lit("2024-01-01 00:00:00").cast("timestamp")))
    for most, window in ((1, 5), (3, 60)):
        want, sent = defaultdict(int), defaultdict(list)
        for key, m in sorted(minutes, key=lambda x: x[1]):
            if len([x for x in sent[key] if m - x < window]) < most:
                sent[key].append(m)
                want[key] += 1
        got = metrics.throttled(rows, "key", "at", most, window * 60).where("sent")
        assert {r["key"]: r["count"] for r in got.groupBy("key").count().collect()} == want
    assert metrics.cooled(rows.where("key = 'a'"), ["key"], "at", 5).count() == 8  # every second one of 15


def test_delta_sees_nulls_that_move(spark):
    shape = "id long, a string, b string"
    old = spark.createDataFrame([(1, "x", None), (2, "y", "z"), (None, "n", None), (4, "same", None)], shape)
    new = spark.createDataFrame([(1, None, "x"), (None, "n", "m"), (4, "same", None)], shape)
    patch = c.delta(old, new, ["id"])
    assert sorted((str(r["id"]), r["_op"]) for r in patch.collect()) == [("1", "upsert"), ("2", "delete"), ("None", "upsert")]
    assert sorted(map(str, c.apply(old, patch, ["id"]).collect())) == sorted(map(str, new.collect()))


def test_cycles_are_strong_components(spark):
    rng = random.Random(9)
    for _ in range(1):  # every step is a checkpoint
        edges = {(rng.randrange(18), rng.randrange(18)) for _ in range(24)} | {(40, 41), (41, 40), (41, 50), (50, 51), (51, 50), (51, 51), (60, 60)}
        to = defaultdict(set)
        for a, b in edges:
            to[a].add(b)

        def reached(a):
            seen, left = set(), [a]
            while left:
                for b in to[left.pop()] - seen:
                    seen.add(b)
                    left.append(b)
            return seen

        want = {(a, b) for a, b in edges if a in reached(b) or a == b}
        got = lineage.cyclic(spark.createDataFrame(sorted(edges), "source long, target long"))
        assert {(r["source"], r["target"]) for r in got.collect()} == want


def test_lines_before_the_header(spark, tmp_path):
    for i, tail in enumerate(("a,1\nb,2\n", '"c,d",3\nbad,4,5\n')):
        (tmp_path / f"{i}.csv").write_text(f"made by hand\n\nName,How Many\n{tail}")
    rows = files.read_delimited(spark, str(tmp_path), skip=2)
    assert rows.columns == ["name", "how_many"]
    assert sorted(map(tuple, rows.collect())) == [("a", "1"), ("b", "2"), ("c,d", "3")]
    with pytest.raises(ValueError):
        files.read_delimited(spark, str(tmp_path), skip=1, encoding="cp949")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.csv").write_text("a,b\n1,2\n3,4,5\nx,6\n")
    assert files.count_malformed(spark, str(tmp_path / "x"), "a int, b int") == 2


def test_a_snapshot_without_a_pointer_is_not_seen(spark):
    path = scratch(spark)
    assert exports.current(spark, path) is None
    exports.publish(spark.range(3), path)
    spark.range(9).write.parquet(f"{path}/s-lost")  # a writer that died before it made its pointer
    assert exports.current(spark, path).count() == 3
    exports.publish(spark.range(5), path)
    assert exports.current(spark, path).count() == 5


def test_types_and_presets(spark):
    rows = spark.createDataFrame([("1", "[1, 2]", "{a -> 1}", "2024-01-01 10:20:30", "123456"), ("1.5", "x", "[1]", "2024-01-01", "12")], "a string, b string, c string, d string, e string")
    kinds = [("a", "number"), ("a", "integer"), ("b", "list"), ("c", "dict"), ("d", "datetime"), ("d", "date_string")]
    got = {r["id"]: r["unexpected"] for r in k.measure(rows, [*[k.of_type(c, t) for c, t in kinds], k.match_regex("e", "stock_code_kr"), k.match_regex("d", "date_iso")]).collect()}
    assert [got[i] for i in range(8)] == [0, 1, 1, 1, 1, 0, 1, 1]


def test_run_keys_ignore_the_order_of_parameters(spark):
    a, b = (F.create_map(*map(F.lit, p)) for p in (("x", "1", "y", "2"), ("y", "2", "x", "1")))
    row = spark.range(1).select(h.run_key(F.lit("s"), F.lit("load"), a).alias("a"), h.run_key(F.lit("s"), F.lit("load"), b).alias("b"), h.run_key(F.lit("s"), F.lit("load"), a, F.lit("2024-01-02").cast("date")).alias("c")).first()
    assert row["a"] == row["b"] != row["c"] and row["a"].startswith("s:load:") and len(row["a"]) == 23


def test_encodings(spark):
    texts = [b"\xef\xbb\xbfa", b"<meta charset='EUC-KR'>", b'<?xml version="1.0" encoding="utf-16"?>', b"plain", b"\xff\xfea"]
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, c binary")
    assert [r["e"] for r in rows.select("i", h.encoding_of(F.col("c")).alias("e")).orderBy("i").collect()] == ["utf-8", "euc-kr", "utf-16", "utf-8", "utf-16le"]


def test_tables_to_register(spark):
    spark.range(1).createOrReplaceTempView("fresh_table")
    spark.range(1).createOrReplaceTempView("known_table")
    names = {r["name"] for r in h.tables_to_register(spark, spark.createDataFrame([("known_table",)], "name string")).collect()}
    assert "fresh_table" in names and "known_table" not in names


def test_paths_stop_at_the_number_asked_for(spark):
    edges = spark.createDataFrame([(i, j) for i in range(8) for j in range(i + 1, 8)] + [(0, 99), (99, 100)], "source long, target long")
    assert [r["length"] for r in lineage.paths(edges, 0, 7, most=3).collect()] == [1, 2, 2]
    assert lineage.paths(edges, 0, 7, depth=2).count() == 7
