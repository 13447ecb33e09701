import hashlib
from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

from tributary.llm import components, near_dedup, suffix_dedup


def test_near_duplicates_are_those_of_all_pairs(spark, docs, corpus):
    want = Counter((corpus[i][0], n, root, corpus[i][0] == root) for i, (n, root) in brute.near_components(corpus).items())
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    none = lambda c: {k for k in c if k[0] is None}
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert {k[:3] for k in none(got)} == {k[:3] for k in none(want)}


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.75, 0.9):
        both = rng.integers(0, 1 << 63, int(4_000 * share), dtype=np.uint64)
        sides = [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(4_000 * (1 - share) / 2), dtype=np.uint64)]) * np.uint64(2) + np.uint64(1)) for _ in range(2)]
        regs = [near_dedup.sketch(s)[None, :] for s in sides]
        found = near_dedup.estimate(*regs, *(np.array([len(s)]) for s in sides))[0]
        assert abs(found - share) < 0.13


def test_keep_one_drops_near_copies(spark, docs, corpus):
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup.keep_one(spark, docs, "").collect())
    want = {corpus[i] for i, (_, root) in brute.near_components(corpus).items() if corpus[i][0] == root}
    assert set(kept) == want and max(kept.values()) == 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_repeats_are_those_of_all_substrings(spark, docs, corpus):
    for length in (400, 60):
        want = Counter()
        for (doc_id, text), runs in zip(corpus, brute.repeats([t for _, t in corpus], length), strict=True):
            data = (text or "").encode()
            edges = [0, *(x for r in runs for x in r), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            want[doc_id, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()] += 1
        rows = suffix_dedup.without_repeats(docs.select("doc_id", "text"), suffix_dedup._digests, suffix_dedup.DIGESTS, length)
        assert Counter(tuple(r)[:5] for r in rows.collect()) == want


def test_passages_that_other_texts_hold_are_reported(spark):
    import random

    rng = random.Random(8)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n))
    passage = words(51)
    assert len(passage) < 400
    texts = [f"{words(30)}\n{passage}", f"{passage.replace(' ', '  ')} {words(200)}", words(120), f"{words(9)} {' '.join(passage.split()[:43])} {words(9)}", "short", None]
    texts += [texts[2].rsplit(" ", 80)[0] + " " + words(60), f"{passage.split()[0]} " * 60]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["shares_passage"]) for r in suffix_dedup.without_repeats(rows, suffix_dedup._digests, suffix_dedup.DIGESTS).collect()}
    assert {i for i, (_, shares) in got.items() if shares} == {0, 1}
    assert not any(n for i, (n, _) in got.items() if i < 7)


def test_passages_go_from_every_text_of_the_pipeline(spark, docs, corpus):
    import random

    rng = random.Random(8)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n))
    passage, lead = words(52), words(50)
    texts = [f"{words(30)}\n{passage} {words(7)}", f"é {passage.replace(' ', '  ')} {words(200)}", f"{lead} {words(70)}", f"{lead} {words(7)}", None, *[words(51)] * 2, *[words(50)] * 2, f"{passage} {words(3)} {passage}"]
    texts += [t for _, t in corpus[60:80]]
    want = []
    held = {t: {tuple(x[k : k + 51]) for x in [(t or "").split()] for k in range(len(x) - 50)} for t in texts}
    for t in texts:
        gone = [(0, len((t or "").encode()))] if texts.count(t) > 1 and held[t] else []
        data, at, spans = (t or "").encode(), 0, []
        for w in data.split():
            at = data.index(w, at)
            spans.append((at, at := at + len(w)))
        others = {r for u, runs in held.items() if u != t for r in runs}
        x = (t or "").split()
        gone += [(spans[k][0], spans[k + 50][1]) for k in range(len(x) - 50) if tuple(x[k : k + 51]) in others]
        want.append(gone)
    bytes_ = brute.repeats(texts, 400)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.cut_repeats(spark, rows, "").collect()}
    for i, t in enumerate(texts):
        cuts = suffix_dedup.merged([{"a": a, "b": b} for a, b in [*want[i], *bytes_[i]]], len((t or "").encode()))
        assert got[i] == (None if t is None else suffix_dedup._cut(t.encode(), cuts).decode()), i
    assert passage.split()[25] not in got[0] and lead in got[2] and got[5] == got[6] == "" and got[7]


def test_columns_keep_their_names_and_values(spark):
    rows = spark.createDataFrame([(1, "abc " * 300, 7, "k", "s"), (2, None, 8, None, "t")], "doc_id long, text string, n int, tk string, spans string")
    out = {r["doc_id"]: r for r in suffix_dedup.cut_repeats(spark, rows, "").collect()}
    assert (out[1]["n"], out[1]["tk"], out[1]["spans"], out[1]["text"]) == (7, "k", "s", "")
    assert (out[2]["n"], out[2]["tk"], out[2]["spans"], out[2]["text"]) == (8, None, "t", None)


def test_joins_do_not_grow_with_the_copies_of_a_passage(spark, monkeypatch):
    import random

    rng = random.Random(11)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n))
    passage = words(400)
    texts = [f"{words(5)} {passage} {words(5)}" for _ in range(150)]
    made, join = [], suffix_dedup.join_keys
    monkeypatch.setattr(suffix_dedup, "join_keys", lambda rows, keys, on: made.append((on, join(rows, keys, on).count())) or join(rows, keys, on))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = suffix_dedup.keyed(rows).select("__tk", "__n", "text")
    spans = [suffix_dedup.merged(r["spans"], r["n"]) for r in suffix_dedup.repeated(keyed).collect()]
    assert len(spans) == 150 and all(len(s) == 1 and s[0][1] - s[0][0] >= len(passage) for s in spans)
    anchors = 150 * len(passage) // 280  # one in every 281 bytes at least
    assert sum(n for on, n in made if on in ("gram", "around")) < anchors


def test_large_groups_are_cut_in_two(spark, docs, corpus):
    keyed = suffix_dedup.keyed(docs.select("doc_id", "text")).select("__tk", "__n", "text")
    spans = lambda most: {(r["tk"], r["n"]): suffix_dedup.merged(r["spans"] or [], r["n"]) for r in suffix_dedup.repeated(keyed, 60, most).collect()}
    assert spans(3) == spans(10_000)


def test_colliding_hashes_do_not_matter(monkeypatch, corpus):
    import pandas as pd

    rows = pd.DataFrame({"bytes": [b"abcdefghij", b"zbcdefghiy", b"qqqqqqqqqq"], "left": 0, "first": 0, "last": 0})
    assert suffix_dedup._repeats(np.zeros(3, int), rows.assign(left=5, last=5), 6)["most"].tolist() == [4, 4, -1]
    monkeypatch.setattr(suffix_dedup, "substring_hashes", lambda p, a, b: np.zeros(len(a), np.uint64))
    assert suffix_dedup._repeats(np.zeros(3, int), rows.assign(left=5, last=5), 6)["most"].tolist() == [4, 4, -1]


def _groups(seed: int, rows: int, size: int, left: int):
    """Rows of few letters around an anchor, in groups, with changes here and there, so that offsets of all kinds repeat."""
    import pandas as pd

    rng = np.random.default_rng(seed)
    base = rng.integers(97, 100, size, dtype=np.uint8)
    parts = []
    for _ in range(rows):
        part = base.copy()
        part[rng.integers(0, size, rng.integers(0, 4))] = 120 + rng.integers(0, 2)
        parts.append(part)
    cut = rng.integers(0, left, rows)
    return rng.integers(0, 3, rows), pd.DataFrame({"bytes": [p[c:].tobytes() for p, c in zip(parts, cut, strict=True)], "left": left - cut, "first": 0, "last": left})


def test_outermost_repeats_are_those_of_all_bytes():
    for seed in range(20):
        for length in (6, 60, 200):
            ids, rows = _groups(seed, 40, 2 * length, length * 7 // 10)
            got, want = suffix_dedup._repeats(ids, rows, length), suffix_dedup._by_bytes(ids, rows, length)
            assert got["least"].tolist() == want["least"].tolist() and got["most"].tolist() == want["most"].tolist()


def test_few_strings_of_a_repeat_are_hashed(monkeypatch):
    ids, rows = _groups(3, 300, 680, 280)
    made, hashes = [], suffix_dedup.substring_hashes
    monkeypatch.setattr(suffix_dedup, "substring_hashes", lambda p, a, b: made.append(len(a)) or hashes(p, a, b))
    suffix_dedup._repeats(ids, rows, 400)
    strings = np.minimum(rows["left"], 280) - np.maximum(400 - (rows["bytes"].map(len) - rows["left"]), 0) + 1
    assert sum(made) < strings.sum()  # before, all strings and then the sort's comparisons


def test_cut_repeats_keeps_columns_and_whole_characters(spark, docs):
    out = suffix_dedup.cut_repeats(spark, docs, "")
    assert out.schema == docs.schema and out.count() == docs.count()
    assert out.where("n_chars <> length(coalesce(text, ''))").count() == 0
    assert out.where("text is null").count() == docs.where("text is null").count()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert near_dedup.near_duplicates(none).count() == 0
    assert suffix_dedup.cut_repeats(spark, none, "").count() == 0
    assert near_dedup.keep_one(spark, none.withColumn("x", F.lit(1)), "").columns[-1] == "x"


def test_large_buckets_go_in_blocks(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    want = {corpus[i][0]: root for i, (_, root) in brute.near_components(corpus).items() if corpus[i][0] not in (None, 7)}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect() if r["doc_id"] not in (None, 7)}
    assert got == want


def test_chains_just_above_the_threshold(spark):
    import random

    rng, texts = random.Random(9), []
    for _ in range(3):
        words = [f"v{rng.randrange(10_000)}" for _ in range(120)]
        for _ in range(25):
            texts.append(" ".join(words))
            for k in rng.sample(range(120), 3):
                words[k] = f"v{rng.randrange(10_000)}"
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root for i, (_, root) in brute.near_components(rows).items()}


def test_bitmaps_reach_the_driver_as_bytes(spark):
    import tracemalloc

    from tributary.llm import store

    keys = spark.range(300_000).toDF("k")
    tracemalloc.start()
    table = store.bitmap(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert table.nbytes == 1 << 20 and peak < 8 * table.nbytes  # a row for each word took 96 times the table
    bits = lambda low, high: spark.range(low, high).toDF("k").select(store.maybe_in(table, "k").alias("bit")).toPandas()["bit"].to_numpy()
    assert store.has_bit(table, bits(0, 300_000)).all()
    assert store.has_bit(table, bits(1_000_000, 1_300_000)).mean() < 0.06
    assert not store.bitmap(keys.limit(0)).any()
