"""Version graphs, merges, snapshots and longest ways against plain versions of them, on random data."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tributary.operators import branches, changes, lineage
from tributary.session import scratch
from tributary.sources import snapshots


def _random_history(rng, n):
    return {i: sorted(rng.sample(range(max(0, i - 5), i), min(i, rng.choice((0, 1, 1, 1, 2, 2, 3))))) for i in range(n)}


def _ancestors(history, v):
    seen, front = {v}, [v]
    while front:
        front = [p for x in front for p in history[x] if p not in seen and not seen.add(p)]
    return seen


def test_merge_bases_of_random_histories(spark):
    rng = random.Random(2)
    history = _random_history(rng, 40)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(7, 7), (3, 999)]
    want = set()
    for a, b in pairs:
        if b in history:
            common = _ancestors(history, a) & _ancestors(history, b)
            want |= {(a, b, c) for c in common if not any(c != o and c in _ancestors(history, o) for o in common)}
    versions = spark.createDataFrame(list(history.items()), "version_id long, parents array<long>")
    got = branches.merge_bases(versions, spark.createDataFrame(pairs, "ours long, theirs long"))
    assert {(r["ours"], r["theirs"], r["base"]) for r in got.collect()} == want
    crossed = spark.createDataFrame([(1, []), (2, [1]), (3, [1]), (4, [2, 3]), (5, [3, 2])], "version_id long, parents array<long>")
    assert {r["base"] for r in branches.merge_bases(crossed, spark.createDataFrame([(4, 5)], "ours long, theirs long")).collect()} == {2, 3}


def test_merge_bases_cost_the_way_to_them(spark):
    """A long history of which only the last versions are read, by a column that tells their order; parents that are no versions, and versions that descend from themselves."""
    chain = [(i, [i - 1] if i else [-7], i) for i in range(300)] + [(1_000, [298], 299), (1_001, [-7], 5)]
    versions = spark.createDataFrame(chain, "version_id long, parents array<long>, n long")
    got = branches.merge_bases(versions, spark.createDataFrame([(299, 1_000), (299, 297), (3, 1_001), (1_001, 1_001)], "ours long, theirs long"), "n")
    assert {(r["ours"], r["theirs"], r["base"]) for r in got.collect()} == {(299, 1_000, 298), (299, 297, 297), (3, 1_001, -7), (1_001, 1_001, 1_001)}
    ring = spark.createDataFrame([(1, [2]), (2, [1])], "version_id long, parents array<long>")
    with pytest.raises(ValueError):
        branches.merge_bases(ring, spark.createDataFrame([(1, 2)], "ours long, theirs long"))


def _plain_merge(b, o, t, prefer):
    """Of one key's three rows (tuples or None): (row or None, conflicting fields)."""
    if o is not None and t is not None:
        out, bad = [], []
        for i in range(len(o)):
            x, y, z = b[i] if b else None, o[i], t[i]
            if y == z or z == x:
                out.append(y)
            elif y == x:
                out.append(z)
            else:
                bad.append("pq"[i])
                out.append({"ours": y, "theirs": z}.get(prefer, x))
        return tuple(out), bad
    if b is None:
        return (o if o is not None else t), []
    if o is None and t is None:
        return None, []
    left = o if o is not None else t
    if left == b:
        return None, []
    gone = prefer == ("theirs" if t is None else "ours")
    return (None if gone else left), ["*"]


@pytest.mark.parametrize("prefer", [None, "ours", "theirs"])
def test_merges_of_all_cases(spark, prefer):
    values = [None, *product((None, 1, 2), ("a", None))]
    cases = {(k, None if k == 17 else k): c for k, c in enumerate(product(values, repeat=3))}
    table = lambda i: spark.createDataFrame([(key, *c[i]) for (_, key), c in cases.items() if c[i] is not None], "id int, p int, q string")
    got = {r["id"]: ((r["p"], r["q"]), [x["field"] for x in r["_conflicts"]]) for r in branches.merged(table(0), table(1), table(2), ["id"], prefer).collect()}
    want = {key: _plain_merge(*c, prefer) for (_, key), c in cases.items()}
    assert got == {k: v for k, v in want.items() if v[0] is not None}


def test_the_last_row_of_a_key_is_merged(spark):
    rows = lambda *v: spark.createDataFrame([(1, x, i) for i, x in enumerate(v)], "id int, v string, n int")
    assert [r["v"] for r in branches.merged(rows("a"), rows("b", "a"), rows("c", "d"), ["id"], order="n").collect()] == ["d"]


def test_branches_and_rollbacks(spark):
    columns = "source_id string, branch string, version_number int, parent int, status string, records long, data_hash string, tags array<string>, created_at string"
    versions = spark.createDataFrame([("s", "main", 1, None, "archived", 5, "h1", [], "t1"), ("s", "main", 2, 1, "active", 6, "h2", ["x"], "t2"), ("o", "main", 1, None, "active", 1, "o1", [], "t1")], columns)
    out = branches.branched(versions, "s", "main", 1, "try", "t3")
    new = out.where("branch = 'try'").first()
    assert (new["version_number"], new["data_hash"], new["tags"], new["status"]) == (1, "h1", ["from:main/1"], "active")
    assert branches.branched(out, "s", "main", 2, "try", "t4").count() == out.count() == 4
    back = {(r["source_id"], r["version_number"]): (r["status"], r["data_hash"], r["parent"]) for r in branches.restored(versions, "s", "main", 1, "t5").collect()}
    assert back == {("s", 1): ("archived", "h1", None), ("s", 2): ("archived", "h2", 1), ("s", 3): ("active", "h1", 2), ("o", 1): ("active", "o1", None)}
    assert branches.restored(versions, "s", "main", 9, "t5").where("status = 'active'").count() == 2


def test_snapshots_restore_every_state(spark):
    rng, path, keys = random.Random(7), scratch(spark), ["a", "b"]
    state, states, made = {}, [], []
    for i, kind in enumerate(("incremental", "incremental", "differential", "incremental", "full", "differential", "incremental", "differential")):
        for _ in range(30):
            key = (rng.choice((None, 1, 2, 3)), rng.randrange(8))
            if rng.random() < 0.3:
                state.pop(key, None)
            else:
                state[key] = rng.choice((None, "x", "y", f"v{i}"))
        rows = spark.createDataFrame([(*k, v) for k, v in state.items()], "a int, b int, v string")
        made.append(snapshots.take(rows, path, keys, kind, f"2024-01-0{i + 1}"))
        states.append(dict(state))
    entries = snapshots.manifest(spark, path)
    assert [e["kind"] for e in entries[:2]] == ["full", "incremental"] and [e["id"] for e in entries] == made

    def same(i):
        return {(r["a"], r["b"]): r["v"] for r in snapshots.restore(spark, path, keys, made[i]).collect()} == states[i]

    assert all(same(i) and snapshots.intact(spark, path, keys, made[i]) for i in range(8))
    assert {(r["a"], r["b"]): r["v"] for r in snapshots.as_of(spark, path, keys, "2024-01-03").collect()} == states[2]
    assert snapshots.as_of(spark, path, keys, "2023") is None
    # the fourth snapshot needs the third, that one the first; the second is needed by none
    refs = snapshots.expire(spark, path, "2024-01-04")
    assert [refs[m] for m in made] == [1, 0, 1, 1, 4, 2, 1, 1]
    assert all(same(i) for i in range(8) if i != 1) and made[1] not in [e["id"] for e in snapshots.manifest(spark, path)]
    refs = snapshots.expire(spark, path, "2025", keep=1)
    assert [m for m in made if refs.get(m)] == [made[4], made[7]] and same(7)
    with pytest.raises(ValueError):
        snapshots.chain(entries, "none")


def _plain_ways(edges, weight):
    best = {}
    for s, t, w in edges:
        best[s, t] = max(best.get((s, t), 0), w if weight else 1)
    nodes = {x for e in best for x in e}
    below = {n: [t for s, t in best if s == n] for n in nodes}
    roots = nodes - {t for _, t in best}
    out, stack = [], [([r], 0) for r in roots]
    while stack:
        way, length = stack.pop()
        if not below[way[-1]]:
            out.append((-length, way[::-1], way))
        stack += [([*way, t], length + best[way[-1], t]) for t in below[way[-1]]]
    return [(way, -length) for length, _, way in sorted(out)]


@pytest.mark.parametrize("weight", [None, "w"])
def test_longest_ways_of_random_graphs(spark, weight):
    rng = random.Random(5)
    for n, m in ((12, 25), (30, 45)):
        edges = [(a, b, rng.randrange(4)) for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(m))] + [(0, 1, 9), (0, 1, 2)]
        rows = spark.createDataFrame(edges, "source long, target long, w long")
        got = [(r["path"], r["length"]) for r in lineage.critical_paths(rows, 6, weight).collect()]
        assert sorted(got, key=lambda x: (-x[1], x[0][::-1])) == _plain_ways(edges, weight)[:6]


def test_longest_ways_leave_cycles_out(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (6, 7), (None, 1)], "source long, target long")
    assert [(r["path"], r["length"]) for r in lineage.critical_paths(edges).collect()] == [([1, 2, 3], 2)]
    assert lineage.critical_paths(edges.limit(0)).count() == 0


def test_longest_ways_keep_one_row_a_node(spark, monkeypatch):
    # 2^40 ways from end to end through pairs of nodes, and a tail that waits for its last edge
    edges = [(3 * k, 3 * k + i, 1) for k in range(40) for i in (1, 2)] + [(3 * k + i, 3 * k + 3, 1) for k in range(40) for i in (1, 2)] + [(0, 119, 1), (-1, 119, 50)]
    kept, widest = lineage._kept, []
    monkeypatch.setattr(lineage, "_kept", lambda df: (out := kept(df), widest.append(out.count()))[0])
    rows = spark.createDataFrame(edges[:48] + [(0, 36, 1)], "source long, target long, w long")
    got = [(r["path"], r["length"]) for r in lineage.critical_paths(rows, 7, "w").collect()]
    assert sorted(got, key=lambda x: (-x[1], x[0][::-1])) == _plain_ways(edges[:48] + [(0, 36, 1)], "w")[:7]
    assert max(widest) <= 49  # no table has more rows than there are edges


def test_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(None, "a", 1), (1, "b", 1), (1, "c", 2), (2, "d", 1)], "k int, v string, n int")
    assert {r["k"]: r["change"] for r in changes.diff(old, old, ["k"], order="n").collect()} == {None: "unchanged", 1: "unchanged", 2: "unchanged"}
    new = spark.createDataFrame([(None, "z", 1), (1, "c", 3), (1, "x", 2), (3, "e", 1)], "k int, v string, n int")
    patch = changes.delta(old, new, ["k"], "n").where("_op is not null")
    assert {(r["k"], r["_op"]) for r in patch.collect()} == {(None, "upsert"), (1, "upsert"), (3, "upsert"), (2, "delete")}
    done = changes.upsert(old.where("n = 1").drop("n").withColumn("_first_seen", F.lit("t1")), new.drop("n").where("v <> 'x'"), ["k"], F.lit("t2"))
    assert {(r["k"], r["v"], r["_outcome"], r["_first_seen"]) for r in done.collect()} == {(None, "z", "updated", "t1"), (1, "c", "updated", "t1"), (2, "d", "kept", "t1"), (3, "e", "inserted", "t2")}
    assert {r["k"] for r in changes.rollback(old, new.where("k is null"), "k").collect()} == {1, 2}


def test_ends_of_a_graph_need_no_join(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 2), (5, 5), (None, 4), (6, None)], "source long, target long")
    found = {side: getattr(lineage, side)(edges) for side in ("roots", "leaves")}
    assert sorted(found["roots"].collect(), key=str) == sorted([(1,), (6,), (None,)], key=lambda r: f"Row(id={r[0]})")
    assert sorted(r["id"] or 0 for r in found["leaves"].collect()) == [0, 3, 4]
    assert all("Join" not in f._jdf.queryExecution().executedPlan().toString() for f in found.values())
