from pyspark.sql import functions as F

from tributary.session import scratch
from tributary.sources import exports, files, html
from tributary.streaming import events as ev

PAGE = "<html><body><div class='box'><h2>A</h2><p class='t'>1 &amp; 2</p></div><div class='box big'><h2>B</h2></div><ul><li>x<li>y</ul><table><tr><th>n</th><th>v</th></tr><tr><td>a</td><td>1</td><td>z</td></tr></table></body></html>"


def _pages(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "id int, html string")


def test_html(spark):
    pages = _pages(spark, PAGE, None, "")
    fields = [{"name": "h", "selector": "h2"}, {"name": "t", "selector": "p.t"}]
    assert [tuple(r) for r in html.extract(pages, "id", "html", fields, ".box").orderBy("place").collect()] == [(0, 0, "A", "1 & 2"), (0, 1, "B", None)]
    assert [tuple(r) for r in html.extract(pages, "id", "html", fields).collect()] == [(0, 0, "A", "1 & 2")]
    assert [tuple(r) for r in html.extract_lists(pages, "id", "html", fields).orderBy("place").collect()] == [(0, 0, "A", "1 & 2"), (0, 1, "B", None)]
    assert [r["cells"] for r in html.extract_tables(pages, "id", "html").collect()] == [{"n": "a", "v": "1", "column_2": "z"}]
    assert html.container(["div.box h2", "div.box p", "div.box"]) == "div.box"


def test_sitemap(spark):
    pages = _pages(spark, "<urlset><url><loc> http://a/1 </loc></url><url><loc>http://a/x</loc></url></urlset>")
    assert [r["url"] for r in html.sitemap(pages, "id", "html", r"\d$").collect()] == ["http://a/1"]


def test_text_rows_follow_the_running_middle(spark):
    boxes = spark.createDataFrame([(1, 50, 0, "b"), (1, 0, 10, "a"), (1, 0, 24, "c"), (1, 5, 60, "d"), (1, None, 3, "?")], "page int, x int, y int, text string")
    assert [r["cells"] for r in files.text_rows(boxes, "page").orderBy("row").collect()] == [["a", "c", "b"], ["d"]]


def test_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Stock Name,Price,When\nx,1.5,2024-01-02\ny,nan,soon\n,,\n")
    fields = [{"name": "name"}, {"name": "price", "data_type": "number"}, {"name": "date", "selector": "when", "data_type": "date"}]
    rows = files.typed(files.mapped(files.read_delimited(spark, str(path)), fields), fields).orderBy("name").collect()
    assert [(r["name"], r["price"], str(r["date"])[:10]) for r in rows] == [("x", 1.5, "2024-01-02"), ("y", None, "None")]
    a, b = spark.createDataFrame([(1, "a")], "i int, x string"), spark.createDataFrame([(1, "b"), (2, "c")], "i int, x string")
    assert sorted((r["i"], r["x"]) for r in files.pages([a, b], "i").collect()) == [(1, "a"), (2, "c")]


def test_snapshots(spark):
    path = scratch(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert exports.merge_into(first, path, ["id"], F.lit("t1")) == {"inserted": 2}
    assert exports.merge_into(first, path, ["id"], F.lit("t2")) == {"same": 2}
    assert exports.merge_into(spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string"), path, ["id"], F.lit("t3")) == {"kept": 1, "updated": 1, "inserted": 1}
    got = {r["id"]: (r["v"], r["_first_seen"]) for r in exports.current(spark, path).collect()}
    assert got == {1: ("a", "t1"), 2: ("B", "t1"), 3: ("c", "t3")}
    assert exports.current(spark, scratch(spark)) is None


def test_partitioned_load(spark):
    path = scratch(spark)
    rows = spark.createDataFrame([("s", "2024-01-05"), ("s", "2024-02-05"), ("t", "2024-02-07")], "_source_id string, _data_date string")
    exports.load(rows, path, "month")
    exports.load(rows, path, "month")
    assert {r["_part"]: r["count"] for r in spark.read.parquet(path).groupBy("_part").count().collect()} == {"2024-01": 2, "2024-02": 4}


def test_change_events(spark):
    rows = spark.createDataFrame([("update", "news", {"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"}), ("delete", "error_logs", {"a": "1"}, None), ("odd", "news", None, None)], "operation string, collection string, before map<string,string>, after map<string,string>")
    got = [(r["event_type"], r["priority"], r["change_fields"], r["topic"]) for r in ev.routed(ev.to_events(rows)).collect()]
    assert got == [("data.updated", "normal", ["b", "c"], "data"), ("data.deleted", "high", [], "data"), ("data.updated", "normal", [], "data")]


def test_a_handler_may_fail_twice(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "data", "high"), (2, "data", "normal")], "event_id int, topic string, priority string").write.parquet(source)
    tries = []

    def shaky(rows):
        tries.append([r["event_id"] for r in rows.collect()])
        if len(tries) < 3:
            raise ValueError("not yet")

    stream = ev.read_stream(spark, source, "event_id int, topic string, priority string")
    ev.handle(stream, {"data": shaky}, out, str(tmp_path / "state")).awaitTermination()
    assert tries == [[1, 2]] * 3 and not (tmp_path / "out").exists()
