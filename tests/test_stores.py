"""Workbooks, encodings, clustered tables, databases and summaries against plain versions."""

import io
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from tributary.operators import summaries
from tributary.session import scratch
from tributary.sources import clustered, databases, exports, files, workbooks


def test_workbooks_come_back():
    sheets = {"a & b": [["x", "y<z>"], [1, 2.5], [None, True], ["  kept ", "한글\n🎉"], []], "other": []}
    assert workbooks.from_xlsx(workbooks.to_xlsx(sheets)) == {"a & b": [["x", "y<z>"], ["1", "2.5"], [None, "TRUE"], ["  kept ", "한글\n🎉"], []], "other": []}
    assert [workbooks._column(i) for i in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"] and workbooks._place("AAA12") == 702


def test_a_workbook_of_another_program():
    """Shared strings in runs, formula results, gaps in rows and columns, absolute targets."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="9" r:id="q"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="q" Type="t" Target="/xl/worksheets/other.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>Name</t></si><si><r><t>Pr</t></r><r><t>ice</t></r></si></sst>",
        "xl/worksheets/other.xml": f'<worksheet {main}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2" t="s"><v>1</v></c></row><row r="4"><c r="B4" t="str"><f>A1</f><v>x</v></c><c r="C4"/><c r="D4"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    assert workbooks.from_xlsx(out.getvalue()) == {"S": [[], [None, "Name", None, "Price"], [], [None, "x", None, "2"]]}


@pytest.mark.parametrize(("text", "encoding", "found"), [
    ("plain", "ascii", "utf-8"), ("naïve café", "utf-8", "utf-8"), ("한국어 데이터 품질", "cp949", "cp949"), ("データの品質をひらがなで", "shift_jis", "shift_jis"), ("Größe, Höhe, über", "cp1252", "cp1252"),
    ("déjà vu", "utf-16", "utf-16"), ("wide text", "utf-16-le", "utf-16-le"), ("wide text", "utf-16-be", "utf-16-be"), ("mark", "utf-8-sig", "utf-8-sig"), ("", "ascii", "utf-8"),
])
def test_encodings(text, encoding, found):
    assert workbooks.encoding_of(text.encode(encoding)) == found
    assert text.encode(encoding).decode(found) == text


def test_sheets_that_are_too_long_go_on(spark):
    rows = spark.createDataFrame([("b", "s", i, None if i % 2 else f"v{i}") for i in range(25)], "book string, sheet string, n int, v string")
    made = workbooks.workbooks(rows, "book", "sheet", ["n", "v"], "n", most=10).collect()
    sheets = workbooks.from_xlsx(bytes(made[0]["content"]))
    assert [len(s) for s in sheets.values()] == [11, 11, 6] and list(sheets) == ["s", "s (2)", "s (3)"]
    back = workbooks.read_tables(spark.createDataFrame([(1, bytes(made[0]["content"])), (2, None)], "k int, content binary"), ["n", "v"], "k")
    assert sorted((int(r["n"]), r["v"]) for r in back.collect()) == [(i, None if i % 2 else f"v{i}") for i in range(25)]


def test_sheets_of_several_layouts(spark, tmp_path):
    one = {"a": [["Stock Name", "Price"], ["x", 1.5], [None, None]], "b": [["Stock Name", "Price"], ["y", None]]}
    (tmp_path / "one.xlsx").write_bytes(workbooks.to_xlsx(one))
    (tmp_path / "two.xlsx").write_bytes(workbooks.to_xlsx({"a": [["Price", "Price", None], [1, 2, 3]], "empty": []}))
    (tmp_path / "note.txt").write_text("no workbook")
    rows = files.read_sheets(spark, str(tmp_path))
    got = sorted((r["_sheet"], str(r["stock_name"]), str(r["price"]), str(r["price_1"])) for r in rows.collect())
    assert got == [("a", "None", "1", "2"), ("a", "x", "1.5", "None"), ("b", "y", "None", "None")]
    assert files.read_sheets(spark, str(tmp_path), sheets=["b"]).count() == 1
    assert files.read_sheets(spark, str(tmp_path / "two.xlsx"), sheets=["empty"]).count() == 0


def test_exported_workbooks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"=n{i}") for i in range(5)], "_id long, name string")
    exports.to_workbook(rows, f"{tmp_path}/out.xlsx", 3)
    back = files.read_sheets(spark, f"{tmp_path}/out.xlsx")
    assert back.count() == 3 and back.where("id = '1'").first()["name"] == "'=n1"


def _state(rng, n):
    return {(rng.choice((None, 1, 2)), rng.randrange(20)): f"v{rng.randrange(9)}" for _ in range(n)}


def test_clustered_upserts_move_the_batch_only(spark):
    rng, name, path, keys = random.Random(4), f"t_{uuid.uuid4().hex[:8]}", scratch(spark), ["a", "b"]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = lambda state: spark.createDataFrame([(*k, v) for k, v in state.items()], "a int, b int, v string")
        state = _state(rng, 30)
        clustered.create(table(state), name, path, keys, 4)
        for _ in range(2):
            more = _state(rng, 12)
            gone = [k for k in state if k not in more][:3]
            batch = table(more).withColumn("_op", F.lit("upsert")).unionByName(table({k: "" for k in gone}).withColumn("_op", F.lit("delete")))
            plan = clustered.merged(clustered.stored(spark, name), batch, keys)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
            clustered.upsert(spark, name, path, batch, keys, 4)
            state = {k: v for k, v in (state | more).items() if k not in gone}
            assert {(r["a"], r["b"]): r["v"] for r in clustered.current(spark, name).collect()} == state
        assert clustered.repeated(clustered.stored(spark, name), keys).count() == 0
        assert "Exchange hash" not in clustered.repeated(clustered.stored(spark, name), keys)._jdf.queryExecution().executedPlan().toString()
        clustered.create(table(state).unionByName(table(state).limit(1)), f"{name}x", f"{path}x", keys, 4)
        assert clustered.repeated(clustered.stored(spark, f"{name}x"), keys).count() == 1
        clustered.drop_before(spark, name, path, 1)
        assert [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}_v")] == [f"{name}_v3"]
        spark.sql(f"CREATE TABLE {name}_v9 USING parquet LOCATION '{path}/broken' AS SELECT 1 AS a")  # a run that broke off
        assert clustered.current(spark, name).count() == len(state)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_database_reads_in_parts_and_pushes_filters(spark):
    url = f"jdbc:derby:memory:x{uuid.uuid4().hex[:8]};create=true"
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    databases.write(rows, url, "t", "overwrite")
    read = databases.read(spark, url, "t", '"k"', 4)
    assert read.rdd.getNumPartitions() == 4 and read.count() == 100
    plan = read.where("v = 3").select("k")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(v), *EqualTo(v,3)]" in plan and "ReadSchema: struct<k:bigint>" in plan
    assert databases.read(spark, url, "t", '"k"', 4, where='"v" = 2').count() == rows.where("v = 2").count()
    assert databases.read(spark, url, "t", '"k"', 4, where='"v" = 99').count() == 0
    batch = rows.where("k < 5").withColumn("v", F.lit(50).cast("long")).union(spark.createDataFrame([(200, 1), (200, 2)], "k long, v long")).withColumn("n", F.monotonically_increasing_id())
    assert databases.upsert(batch, url, "t", ["k"], "n") == 6 and databases.upsert(batch, url, "t", ["k"], "n") == 6
    got = {r["k"]: r["v"] for r in databases.read(spark, url, "t").collect()}
    assert got == {k: 50 if k < 5 else k % 7 for k in range(100)} | {200: 2}
    with pytest.raises(Exception):
        databases.run(spark, url, 'DELETE FROM t WHERE "k" = 1', "DELETE FROM none")
    assert databases.read(spark, url, "t").count() == 101  # all or nothing


def test_samples_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(f"v{int(rng.paretovariate(0.5)) % 400}", rng.choice(("a", None)), i) for i in range(2_000)], "x string, y string, z long")
    hashed = rows.select("x", F.xxhash64("x").alias("h")).distinct().collect()
    want = [r["x"] for r in sorted(hashed, key=lambda r: (r["h"], r["x"]))[:6]]
    for parts in (1, 5):
        got = {r["field"]: r["samples"] for r in summaries.samples(rows.repartition(parts), k=6).collect()}
        assert got["x"] == want and got["y"] == ["a"] and len(got["z"]) == 6
    forms = {(r["field"], r["rank"]): (r["form"], r["n"]) for r in summaries.forms(rows).collect()}
    assert forms["x", 1] == ("a9", 2_000) and forms["y", 1][0] == "a" and forms["z", 1] == ("9", 2_000)
    lengths = {r["field"]: r for r in summaries.lengths(rows).collect()}
    assert lengths["z"]["number_median"] == 999.0 and lengths["y"]["longest"] == 1
    one = spark.createDataFrame([("Ab12-cDE é9",)], "v string")
    assert one.select(summaries.shape(F.col("v"))).first()[0] == "Aa9-aA a9"
