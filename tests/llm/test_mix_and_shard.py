import zlib
from collections import Counter, defaultdict

import brute
import pytest

import oracle
from tributary.llm import mixing, near_dedup, sharding, vector_search


def test_mix(spark, docs, corpus):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(brute.words(t))) for i, t in corpus)
    sources = {(r["source_size"], r["target"]) for r in rows}
    total = sum(len(brute.words(t)) for _, t in corpus)
    assert sum(t for _, t in sources) == pytest.approx(1.5 * total)
    assert all(0 <= t <= 2 * s + 1e-6 for s, t in sources)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] < 1
        taken[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(n - t) < 1 for (_, t), n in taken.items())


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "a b c d", s) for i in range(400) for s in ("p", "q")], "doc_id long, text string, source string")
    rows = mixing.mix(docs, weights=(1, 1), share=1.0, cap=1, schedule=((2, 0), (0, 2))).collect()
    early = Counter(r["position"] < 0.5 for r in rows)
    assert abs(early[True] - early[False]) < 20  # one source comes early, the other late


def test_second_passes_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "a b c d", s) for i in range(200) for s in ("p", "q")], "doc_id long, text string, source string")
    for r in mixing.mix(docs, weights=(1, 1), share=2.0, schedule=((1, 1), (2, 0))).where("source_size = 800").collect():
        assert len(r["positions"]) == r["passes"] == 2 and r["positions"][0] == r["position"] < r["positions"][1] < 1
    order = [(r["source"], r["doc_id"]) for r in mixing.mixed(spark, docs, "").collect()]
    seen, firsts, seconds = set(), [], []
    for at, key in enumerate(order):
        (seconds if key in seen else firsts).append((at, key[0]))
        seen.add(key)
    # the first source, which comes early, repeats before the other's first pass is over
    assert min(at for at, s in seconds if s == "p") < max(at for at, s in firsts if s == "q")
    assert len(order) == len(firsts) + len(seconds) == 600


def test_mixed_repeats_whole_documents(spark, docs):
    out = mixing.mixed(spark, docs, "")
    assert out.columns == [*docs.columns, *mixing.MIX_COLUMNS]
    n = Counter(tuple(r) for r in out.drop(*mixing.MIX_COLUMNS).collect())
    assert set(n) <= {tuple(r) for r in docs.collect()} and max(n.values()) <= 4


def test_empty_and_sourceless(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0 and sharding.shard(docs.limit(0)).count() == 0
    assert all(r["target"] == 0 for r in mixing.mix(docs.where("text is null or text = ''")).collect())


def greedy(sizes, capacity):
    shards, used = 1, 0
    for s in sizes:
        if used + s > capacity:
            shards, used = shards + 1, 0
        used += s
    return shards


def test_shards(spark, docs, corpus):
    rows = sharding.shard(docs, 7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus)
    slots, homes, used = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
        used[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()) and set(slots) <= set(range(7))


def test_capacity_is_the_smallest_feasible(spark):
    sizes = [5, 9, 1, 1, 30, 2, 8, 8, 8, 3, 1, 12]
    units = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "unit int, bytes long, n long")
    for shards in (1, 2, 3, 5, 12, 20):
        rows = sharding.minimax_shards(units, shards).collect()
        want = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= shards)
        assert {r["capacity"] for r in rows} == {want}
        used = Counter()
        for r in rows:
            used[r["shard"]] += r["bytes"]
        assert max(used.values()) <= want and max(used) < shards
        assert [r["shard"] for r in sorted(rows, key=lambda r: r["unit"])] == sorted(r["shard"] for r in rows)


def test_capacity_is_exact_over_more_groups_than_ranges(spark):
    import random

    rng = random.Random(4)
    for count, shards, sizes in ((3_000, 7, lambda: rng.randint(1, 9)), (900, 40, lambda: rng.choice([1, 2, 500])), (2_000, 5, lambda: int(rng.paretovariate(0.8)))):
        # few ranges of four digits, each with many groups
        groups = sorted((f"{rng.randrange(8):04x}{rng.getrandbits(112):028x}", sizes()) for _ in range(count))
        table = spark.createDataFrame(groups, "digest string, bytes long")
        capacity, cuts = sharding.exact_cuts(table, shards)
        plain = [s for _, s in groups]
        low, high = max(plain), sum(plain)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if greedy(plain, middle) <= shards else (middle + 1, high)
        assert capacity == low
        used = Counter()
        for digest, size in groups:
            used[sum(c <= digest for c in cuts)] += size
        assert max(used.values()) <= capacity and len(cuts) < shards


def test_search_finds_the_exact_neighbours(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) + (i % 5) for _ in range(24)]) for i in range(600)]
    rows += [(600, rows[20][1]), (601, rows[20][1]), (602, None), (603, [0.0] * 24), (604, [float("nan")] * 24), (605, [1.0, None]), (606, [1.0] * 3), (None, rows[1][1]), (20, rows[20][1])]
    vectors = vector_search.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in vector_search.search(vectors, vectors.where("vec_id % 20 = 0"), 20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 24 and any(v) and all(x == x for x in v)]
    hits = total = 0
    for q, v in {i: v for i, v in good if i % 20 == 0}.items():
        want = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q))[:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len(Counter(i for _, i in want) & Counter(i for _, i, _ in mine))
        total += 20
    assert hits / total >= 0.9
    assert vector_search.search(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("module", [near_dedup, mixing, vector_search])
def test_query_gives_the_rows_of_its_sql(spark, module):
    for name, sql in module.ORACLE.items():
        oracle.compare(spark, module.QUERIES[name], sql)
