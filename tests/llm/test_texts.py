import hashlib
import math
import re
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest

import oracle
from tributary.llm import jpeg_media, license_scan, maxent_lm, quality, sentencepiece_lattice


def test_encoding_is_the_best_path_and_decodes(spark, docs, corpus):
    table = sentencepiece_lattice.pieces(sentencepiece_lattice.default_model())
    want = Counter()
    for (i, t), ids in zip(corpus, brute.best_pieces([t for _, t in corpus], sentencepiece_lattice.default_model()), strict=True):
        want[i, tuple(ids)] += 1
        assert (table.fold(f" {t}") if t else []) == ids
    got = sentencepiece_lattice.round_trip(docs).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got)
    texts = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, words=50))
    assert Counter((r["doc_id"], r["text"]) for r in texts.collect()) == Counter((i, t or "") for i, t in corpus)
    assert sentencepiece_lattice.round_trip(docs.limit(0)).count() == 0


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    table = sentencepiece_lattice.pieces(sentencepiece_lattice.default_model())
    words = sentencepiece_lattice.Dictionary(np.array([7], np.uint64), np.array([1]), np.array([table.id["a"]], np.int32))
    split = table.words
    monkeypatch.setattr(table, "words", lambda texts: (split(texts)[0], split(texts)[1], np.full(len(split(texts)[1]), 7, np.uint64), split(texts)[3]))
    (ids,) = sentencepiece_lattice._encoded(["some words here"], table, words, {})
    assert sentencepiece_lattice.decoded(ids, table) != b"some words here"  # what the comparison in the task catches


def test_odd_characters_come_back(spark):
    odd = ["▁ two ▁", " lead", "trail ", "\u0000\u0001", "👩‍👩‍👧 é", "a b", "ß" * 60]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert all(r["round_trip"] for r in sentencepiece_lattice.round_trip(docs).collect())


def test_media(spark, docs, corpus):
    names = [c.split()[0] for c in jpeg_media.COLUMNS.split(", ")]
    for text in [t for _, t in corpus][:12] + ["", None, "x" * 64, "\x00\xff" * 5_000]:
        data = (text or "").encode()
        r = dict(zip(names, jpeg_media._row(1, data), strict=True))
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    media = jpeg_media.text_media(docs)
    assert media.count() == len(corpus)
    shapes = jpeg_media.tensors(media).collect()
    assert all(len(r["rgb"]) == 3 * r["height"] * r["width"] for r in shapes)
    for bad in (b"", b"\xff\xd8\xff", b"GIF89a"):
        with pytest.raises((ValueError, IndexError)):
            jpeg_media.coefficients(bad)


def test_all_bytes_survive_in_both_readers(monkeypatch):
    payload = bytes(range(256)) * 3 + bytes(64)
    file = jpeg_media.store(payload)
    assert jpeg_media.restore(file) == payload
    monkeypatch.setattr(jpeg_media, "_read_fixed", lambda *a: False)
    assert jpeg_media.restore(file) == payload


def test_licenses(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0. All rights reserved.", "GNU General  Public\nLicense v3 license", "cc-by and CC BY 4.0; cc bye", None, "", "nothing here",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "all rights reserved all rights all rights reserved", "éall rights reserved",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert (got[0]["base_labels"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["n_words"]) == ("reserved", 1, 8, 8, 11)
    assert "apache-2.0" in got[0]["labels"].split(",")
    assert got[1]["base_labels"] == "gpl" and got[1]["first_word"] == 1
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (2, 0, 3, "cc-by")
    assert got[3]["n_words"] == got[4]["n_words"] == 0 and got[3]["first_word"] is None and got[3]["labels"] == ""
    assert got[5]["labels"] == "" and got[5]["score"] == 0
    assert "mit" in got[6]["labels"].split(",")
    assert (got[7]["n_base"], got[7]["first_word"], got[7]["last_word"]) == (2, 0, 5)
    assert got[8]["n_base"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_every_rule_passes_the_gate(spark, tmp_path):
    def plain(pattern):  # the shortest text of a pattern: optional parts go, of alternatives the first stays
        pattern = pattern.replace("[1-4]", "1").replace("(?:19|20)[0-9][0-9]", "2020").replace("[a-z]+", "x").replace("[d]?", "").replace("[sc]", "s")
        while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?|\+)?", lambda m: "" if m[2] == "?" else m[1], pattern)) != pattern:
            pattern = new
        return re.sub(" +", " ", re.sub(r".\?", "", pattern)).strip()

    rules = license_scan.rules()
    texts = [plain(r["pattern"]) for r in rules]
    texts += ["Released under MIT", "distributed under Apache 2.0", "published under GPL v3", "available under CC BY 4.0"]
    assert all(re.search(r["pattern"], f" {t.replace(' ', '  ')} ") for r, t in zip(rules, texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert all(r["n_detections"] > 0 for r in got.values())
    assert [got[len(rules) + i]["labels"] for i in range(3)] == ["mit", "apache-2.0", "gpl-3.0"]
    assert got[len(rules) + 3]["labels"].split(",") == ["cc-by", "cc-by-4.0"]
    # and the same rows as the SQL, which has no gate
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(license_scan.ORACLE["op9_license_scan"])
    found = license_scan.scan(docs)
    assert oracle.rows_of(found.columns, [tuple(r) for r in found.collect()]) == oracle.rows_of(rel.columns, rel.fetchall())


def test_license_query_gives_the_rows_of_its_sql(spark):
    for name, sql in license_scan.ORACLE.items():
        oracle.compare(spark, license_scan.QUERIES[name], sql)


def test_base_scores_count_all_tokens(spark, docs, corpus):
    end = object()
    tokens = [(i, [*brute.words(t), end]) for i, t in corpus]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((-1 if i is None else i), held(i), len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens)
    for words in (1 << 20, 40, 0):  # all words with the tasks, some, none
        got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in maxent_lm.scores(docs, words).collect())
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4] for g in got], [w[4] for w in want])
    assert {r["train_tokens"] for r in maxent_lm.scores(docs).collect()} == {n}
    assert maxent_lm.scores(docs.limit(0)).count() == 0


def test_the_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(1)
    size, mass = 1 << 12, rng.integers(1, 50, (maxent_lm.CLASSES, maxent_lm.WIDE)).astype(float)
    symbols, sizes = np.tile(np.array([3, 40, 700, maxent_lm.KNOWN + 9]), 3_000), np.full(300, 40)
    rows, wanted = maxent_lm.feature_rows(symbols, sizes, size)
    w = maxent_lm.start(mass, size)
    before = maxent_lm.log_probability(w, rows, wanted)
    cls, member = maxent_lm.members(symbols)
    assert np.allclose(before, np.log(mass[cls, member] / mass.sum()), atol=1e-4)  # it starts at the frequencies
    maxent_lm.follow(w, np.zeros(len(w), np.float32), np.zeros(len(w), np.int64), rows, wanted)
    assert maxent_lm.log_probability(w, rows, wanted).mean() > before.mean() + 2
    # all classes and members after one history sum to one
    every = np.concatenate([np.arange(maxent_lm.KNOWN), maxent_lm.KNOWN + np.arange(maxent_lm.CLASSES)])
    history = np.concatenate([np.array([3, 40, 700, x]) for x in every])
    rows, wanted = maxent_lm.feature_rows(history, np.full(len(every), 4), size)
    assert np.exp(maxent_lm.log_probability(w, rows, wanted)[3::4]).sum() == pytest.approx(1, abs=1e-4)


def test_words_of_one_class_are_told_apart_by_history():
    # 0 and 1 are members of one class: which of them comes is a matter of the word before
    symbols, sizes = np.tile(np.array([500, 0, 900, 1]), 4_000), np.full(400, 40)
    rows, wanted = maxent_lm.feature_rows(symbols, sizes, 1 << 12)
    w = maxent_lm.start(np.ones((maxent_lm.CLASSES, maxent_lm.WIDE)), 1 << 12)
    maxent_lm.follow(w, np.zeros(len(w), np.float32), np.zeros(len(w), np.int64), rows, wanted)
    ends = maxent_lm.feature_rows(np.array([500, 0, 500, 1]), np.array([2, 2]), 1 << 12)
    good, bad = maxent_lm.log_probability(w, *ends)[1::2]
    assert good > bad + 1


def test_updates_come_every_2048_tokens():
    rng = np.random.default_rng(3)
    symbols, sizes = rng.zipf(1.4, 4_096) % 500, np.full(64, 64)
    rows, wanted = maxent_lm.feature_rows(symbols, sizes, 1 << 12)
    made = lambda: (maxent_lm.start(np.ones((maxent_lm.CLASSES, maxent_lm.WIDE)), 1 << 12), np.zeros((1 << 12) + maxent_lm.CONSTANTS, np.float32), np.zeros((1 << 12) + maxent_lm.CONSTANTS, np.int64))
    once, twice = made(), made()
    maxent_lm.follow(*once, rows, wanted)
    for part in (slice(0, 2_048), slice(2_048, None)):
        maxent_lm.follow(*twice, rows[:, :, part], wanted[:, part])
    assert all(np.array_equal(a, b) for a, b in zip(once, twice, strict=True))


def test_gradients_are_summed_by_row():
    rng = np.random.default_rng(6)
    rows = np.minimum(rng.zipf(1.3, (3, 5, 700)), 900).astype(np.int32)
    vectors = rng.normal(size=(3, 700, maxent_lm.WIDE)).astype(np.float32)
    want, n = np.zeros((901, maxent_lm.WIDE)), np.bincount(rows.ravel(), minlength=901)
    for level, feature in np.ndindex(3, 5):
        np.add.at(want, rows[level, feature], vectors[level])
    used, sums, count = maxent_lm._summed(vectors, rows)
    assert used.tolist() == np.flatnonzero(n).tolist() and count.tolist() == n[used].tolist()
    assert np.abs(sums - want[used]).max() < 1e-3
    assert maxent_lm._summed(vectors[:, :1], rows[:, :, :1])[2].sum() == 15


def test_the_model_does_not_depend_on_partitions(spark, docs):
    found = [sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["score"]) for r in maxent_lm.scores(docs.repartition(n)).collect()) for n in (1, 5)]
    assert np.allclose([s for _, s in found[0]], [s for _, s in found[1]])


def test_held_out_texts_score_above_the_base(spark):
    rows = [r for r in maxent_lm.op5_maxent_lm(spark, oracle.DATA).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{oracle.DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.F.crc32(quality.F.col("doc_id").cast("string")) % 3 == 0
    got = quality.judge(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in got)
    assert len(got) > 50 and right / len(got) > 0.85


def test_fitting_takes_a_few_times_the_words_of_the_sample():
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(4)
    words = [np.unique(rng.integers(0, quality.BUCKETS, 20_000, dtype=np.int32)).tobytes() for _ in range(400)]
    sample = pd.DataFrame({"quality": np.arange(400) % 2, "toxic": 0, "measures": [rng.random(quality.MEASURES).tobytes() for _ in range(400)], "buckets": words})
    tracemalloc.start()
    quality._fit(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * sum(map(len, words))  # 7.8 times, when all of them were counted and looked up at once


def test_quality_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] and r["classifier_score"] == 0.5 for r in quality.judge(docs, none).collect())
    some = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 1), (2, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, some).count() == docs.count()
    assert quality.judge(docs.limit(0), some).count() == 0


def test_posteriors_shrink_sites_toward_their_priors(spark):
    import random
    from collections import defaultdict

    rng = random.Random(11)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "de", None]), rng.randrange(1_000_001)) for i in range(300)] + [(300, "lone", "xx", 1_000_000)]
    scored = spark.createDataFrame(rows, "doc_id long, source string, lang string, good long")
    got = {r["doc_id"]: r for r in quality.posteriors(scored).collect()}

    def strength(sites):  # (n, mean, prior): documents that a prior is worth, by the spread of sites around it
        sites = [s for s in sites if s[0] > 1]
        n = sum(s[0] for s in sites)
        noise = sum(m * (1 - m) for _, m, _ in sites) / n
        within = sum(k * p * (1 - p) for k, _, p in sites) / n
        between = max(sum(k * (m - p) ** 2 for k, m, p in sites) / n - noise, within / 10_000)
        return float(f"{min(max(within / between - 1, 1.0), 10_000.0):.4g}")

    hosts, paths = defaultdict(list), defaultdict(list)
    for _, source, lang, good in rows:
        hosts[source].append(good / 1e6)
        paths[source, lang].append(good / 1e6)
    overall = sum(sum(v) for v in hosts.values()) / len(rows)
    k = strength([(len(v), sum(v) / len(v), overall) for v in hosts.values()])
    host = {h: (sum(v) + k * overall) / (len(v) + k) for h, v in hosts.items()}
    k = strength([(len(v), sum(v) / len(v), host[h]) for (h, _), v in paths.items()])
    path = {(h, p): (sum(v) + k * host[h]) / (len(v) + k) for (h, p), v in paths.items()}
    for i, source, lang, _ in rows:
        assert got[i]["host_posterior"] == pytest.approx(host[source]) and got[i]["path_posterior"] == pytest.approx(path[source, lang])
    assert overall < path["lone", "xx"] < 1  # one document does not make a site


def test_quality_keeps_other_columns_and_nulls(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    wide = docs.withColumn("good", quality.F.lit("x")).withColumn("host", quality.F.lit(1)).withColumn("score", quality.F.lit(None).cast("double"))
    assert quality.judge(wide, labels).count() == docs.count()


def test_media_and_license_queries_keep_every_row(spark, docs, corpus, tmp_path):
    long = spark.createDataFrame([(None, "word " * 60_000), (1_000, "Licensed under the MIT License. " + "x " * 200_000)], "doc_id long, text string")
    docs.withColumn("media", license_scan.F.lit(1)).unionByName(long, allowMissingColumns=True).write.parquet(f"{tmp_path}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    media = jpeg_media.op8_jpeg_media(spark, f"{tmp_path}/some").collect()
    scans = license_scan.op9_license_scan(spark, f"{tmp_path}/some").collect()
    ids = Counter(i for i, _ in corpus) + Counter([None, 1_000])
    assert Counter(r["doc_id"] for r in media) == Counter(r["doc_id"] for r in scans) == ids
    assert {r["n_bytes"] for r in media} >= {300_000, 400_032} and [r["labels"] for r in scans if r["doc_id"] == 1_000] == ["mit"]
    by_text = {}
    for r in media:  # equal texts, equal values
        by_text.setdefault((r["payload_sha256"], r["n_bytes"]), set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by_text.values())
    assert jpeg_media.op8_jpeg_media(spark, f"{tmp_path}/none").count() == license_scan.op9_license_scan(spark, f"{tmp_path}/none").count() == 0
