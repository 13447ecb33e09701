import brute
import corpus_pipeline
import oracle
from pyspark.sql import functions as F

from tributary.llm import mixing, quality
from tributary.llm.mixing import MIX_COLUMNS
from tributary.llm.store import materialize


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    kept, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, oracle.DATA).persist()
        assert kept.columns == docs.columns + (list(MIX_COLUMNS) if name == "mixing" else []), name
        sizes.append(kept.count())
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
            assert all(root == rows[i][0] for i, (_, root) in brute.near_components(rows).items())
        if name == "suffix_dedup":
            assert not any(brute.repeats([r["text"] for r in kept.select("text").distinct().collect()], 430))
    assert sizes[0] <= docs.count() and sizes[1] <= sizes[0] and sizes[2] == sizes[1]
    out = corpus_pipeline.STAGES[-1][1](spark, kept, oracle.DATA)
    assert out.count() == sizes[3] and out.where(~F.col("round_trip")).count() == 0


def test_toxic_and_bad_documents_go(spark):
    docs, labels = (spark.read.parquet(f"{oracle.DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.keep_good(spark, docs, oracle.DATA).select("doc_id")
    assert kept.join(labels.where("toxic = 1"), "doc_id").count() <= 0.1 * max(1, labels.where("toxic = 1").count())
    assert kept.join(labels.where("quality = 1 and toxic = 0"), "doc_id").count() >= 0.95 * labels.where("quality = 1 and toxic = 0").count()


def test_run_on_nulls_and_nothing(spark, docs, tmp_path):
    for i, rows in enumerate((docs.select("doc_id", "text", "lang", "source", "n_chars"), docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars"))):
        folder = str(tmp_path / str(i))
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.where("not round_trip").count() == 0 and (i == 0) == (out.count() > 0)


def test_the_order_of_the_mix_survives_files(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet").repartition(4, "doc_id")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = materialize(mixing.mixed(spark, docs, oracle.DATA))
        assert len(table.inputFiles()) > 2
        places = {(r["doc_id"], k): p for r in mixing.mix(docs).collect() for k, p in enumerate(r["positions"])}
        encoded = corpus_pipeline.STAGES[-1][1](spark, table, oracle.DATA)
        got = encoded.orderBy(*MIX_COLUMNS, "doc_id").select("doc_id", *MIX_COLUMNS).collect()
        assert [(r["doc_id"], r["mix_pass"]) for r in got] == sorted(places, key=lambda k: (places[k], k[1], k[0]))
        # and each file holds a range of positions
        ranges = sorted(tuple(r)[1:] for r in table.groupBy(F.input_file_name()).agg(F.min("mix_position"), F.max("mix_position")).collect())
        assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_the_mix_of_odd_columns_and_ties(spark, docs):
    odd = docs.withColumns({f"__{c}": F.lit(1) for c in ("id", "from", "key", "pass", "position")}).withColumns({c: F.lit("x") for c in (*MIX_COLUMNS, "position", "way", "doc", "pass")})
    out = mixing.mixed(spark, odd, "")
    assert set(out.columns) == set(odd.columns) and dict(out.dtypes)["mix_position"] == "double"
    ties = spark.createDataFrame([(1, f"a b {i}", "s") for i in range(20)] + [(None, f"c d {i}", "s") for i in range(20)], "doc_id long, text string, source string")
    order = lambda rows: [(r["text"], r["mix_pass"]) for r in mixing.mixed(spark, rows, "").collect()]
    assert order(ties) == order(ties.repartition(3, "text"))
