"""Near-duplicate detection with HyperMinHash sketches.

Each document's set of word shingles is hashed into 256 buckets. A register keeps, of the
bucket's smallest value, the number of leading zeros and the next ten mantissa bits (16 bits in
all); an empty bucket takes the register of the first non-empty one in a fixed random order.
The first 128 registers are cut into 32 bands of 4; all 256 serve the Jaccard estimates, which
are corrected for chance matches.

1. Equal sets form a class at once, by a 128-bit digest; all later work is on classes.
2. In every band bucket each class meets the bucket's smallest class (a join on an aggregate: no
   bucket is gathered). Each class is confirmed against the one that it meets most often.
   Buckets of one class end before that, and all later steps see the others only.
3. Buckets that still hold classes of different components are searched: every class outside
   the bucket's largest component is confirmed against the class of another component with the
   highest estimate. Sketches join only the rows of such buckets.
4. Buckets that even then hold several components (few) are searched in full: every class
   outside the bucket's largest component against all classes of other components whose
   estimate is not far below the threshold, each pair in the first bucket that it shares. The
   classes concerned bring their full sets, and only links that join components come out, so
   nothing that is written grows with the square of a bucket, and no link that could change the
   result is left out. Large buckets are compared in pairs of blocks.

Links are confirmed on full shingle sets, 64-bit hashes each. The texts of the classes to be
compared are found by a bitmap of bounded size, so texts are never shuffled.

Defined results: a text without words has an empty set and no links; a null doc_id is linked by
its text like any other row and never names a component unless the whole component has none;
repeated rows keep a row each; component_id is the smallest doc_id reachable; an empty table
gives an empty one; other columns are ignored.

Two sets at exactly the threshold share no bucket with a probability of (1 - 0.75^4)^32, some
5e-6; such a link is lost unless others join its ends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.bytestext import blocks, encode, shingle_sets
from tributary.llm.components import components
from tributary.llm.store import bitmap, discard, documents, has_bit, keep_rows, materialize, maybe_in, small_batches, text_key, tidied

BUCKETS, BANDS, ROWS = 256, 32, 4
MANTISSA = 10
#: classes of a bucket, and bytes of their shingle sets, that are compared in one task (twice as many of two blocks)
BLOCK, BLOCK_BYTES = 4_096, 1 << 26
VALUE_BITS = 56
LIMITS = (np.arange(1, BUCKETS, dtype=np.uint64)) << np.uint64(VALUE_BITS)
_rng = np.random.default_rng(7)
PROBES = np.array([_rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def sketch(values: np.ndarray) -> np.ndarray:
    """256 registers of a sorted, non-empty array of distinct 64-bit values."""
    first = np.concatenate([[0], np.searchsorted(values, LIMITS), [len(values)]])
    full = first[:-1] < first[1:]
    low = values[np.minimum(first[:-1], len(values) - 1)] & np.uint64((1 << VALUE_BITS) - 1)
    fraction, exponent = np.frexp(low.astype(np.float64) + 0.5)
    register = ((VALUE_BITS - exponent) << MANTISSA) + ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    if not full.all():
        empty = np.flatnonzero(~full)
        register[empty] = register[PROBES[empty, full[PROBES[empty]].argmax(axis=1)]]
    return register.astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the chance matches of registers of different values."""
    same = (a == b).mean(axis=-1)
    ratio = np.maximum(n, m) / np.minimum(n, m)
    phi = 4 * ratio / (1 + ratio) ** 2
    chance = 0.169919487159739 * phi * 2.0**-MANTISSA
    return (same - chance) / (1 - chance)


def floor_of(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Four standard deviations below the threshold, by the number of registers that differ in origin."""
    effective = BUCKETS * (1 - np.exp(-np.minimum(n, m) / BUCKETS))
    return threshold - 4 * np.sqrt(threshold * (1 - threshold) / np.maximum(effective, 1))


def _sketched(batches, width):
    for batch in batches:
        parts = encode(batch["text"])
        for a, b in blocks(parts):
            sets = shingle_sets(parts[a:b], width)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].iloc[a:b].astype("Int64"),
                    "key": batch["key"].iloc[a:b],
                    "n_shingles": [len(s) for s in sets],
                    "cls": [_digest(s) for s in sets],
                    "sketch": [sketch(s).tobytes() if len(s) else None for s in sets],
                }
            )


def _digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, key (of the text), n_shingles, cls (digest of the set, null if empty) and sketch of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key")).mapInPandas(
        tidied(lambda batches: _sketched(batches, width)), "doc_id long, key long, n_shingles long, cls binary, sketch binary"
    )


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cls and shingles of the documents in wanted (doc_id), and perhaps of some others, known by a bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.coalesce("doc_id", F.lit(-1)).alias("id"))))

    def chosen(batches):
        for batch in batches:
            parts = encode(batch["text"][has_bit(shared.value, batch["bit"].to_numpy(np.int64))])
            for a, b in blocks(parts):
                sets = shingle_sets(parts[a:b], width)
                yield pd.DataFrame({"cls": [_digest(s) for s in sets], "shingles": [s.astype("<u8").tobytes() for s in sets]})

    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), "text").withColumn("bit", maybe_in(shared.value, "id"))
    return ids.select("bit", "text").mapInPandas(tidied(chosen), "cls binary, shingles binary").where("cls is not null")


def _confirmed(batches, percent):
    for p in batches:
        keep = []
        for x, y in zip(p["sa"], p["sb"], strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield p.loc[np.array(keep, bool), ["a", "b"]]


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are as near as asked."""
    pairs = materialize(pairs.select("a", "b").distinct())
    ids = lambda side: pairs.select(F.col(side).alias("cls")).distinct().join(classes.select("cls", "doc_id"), "cls").select("doc_id").distinct()
    sets = lambda side: _sets_of(docs, ids(side), width).select(F.col("cls").alias(side), F.col("shingles").alias(f"s{side}"))
    found = materialize(
        pairs.join(sets("b"), "b").join(sets("a"), "a").mapInPandas(tidied(lambda batches: _confirmed(batches, percent)), "a binary, b binary").distinct()
    )
    discard(pairs)
    return found


def _union(root: np.ndarray, a: int, b: int) -> None:
    root[root == root[a]] = root[b]


class _Cell:
    """The classes of one bucket, or of two blocks of a large one, and which of them may be linked."""

    def __init__(self, rows: pd.DataFrame, threshold: float):
        self.threshold = threshold
        self.root = np.unique(rows["root"].to_numpy(object), return_inverse=True)[1]
        self.n = rows["n_shingles"].to_numpy(float)
        self.regs = np.frombuffer(b"".join(rows["sketch"]), "<u2").reshape(-1, BUCKETS)
        self.bands = self.regs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        self.band, self.part = int(rows["band"].iat[0]), rows["part"].to_numpy()
        self.apart = rows["lo"].iat[0] != rows["hi"].iat[0]
        self.largest = np.bincount(self.root).argmax()

    def seekers(self) -> np.ndarray:
        """Classes outside the largest component."""
        return np.flatnonzero(self.root != self.largest)

    def near(self, i: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
        """Classes of other components that may be as near to class i as asked, with their estimates.

        once: every pair from one side only, and in the first bucket that both share.
        """
        other = self.root != self.root[i]
        if once:
            other &= (self.root == self.largest) | (self.root > self.root[i])
        if self.apart:
            other &= self.part != self.part[i]
        other = np.flatnonzero(other & (np.minimum(self.n, self.n[i]) >= self.threshold * np.maximum(self.n, self.n[i]) - 1e-9))
        estimates = estimate(self.regs[other], self.regs[i], self.n[other], self.n[i])
        some = estimates >= floor_of(self.n[other], self.n[i], self.threshold)
        other, estimates = other[some], estimates[some]
        if once and len(other):
            first = (self.bands[other] == self.bands[i]).all(axis=2).argmax(axis=1) == self.band
            other, estimates = other[first], estimates[first]
        return other, estimates


def _best(rows: pd.DataFrame, threshold: float, percent: int) -> pd.DataFrame:
    """For each class outside the largest component, the nearest of another one."""
    cell, names, found = _Cell(rows, threshold), rows["cls"].to_numpy(object), []
    for i in cell.seekers():
        other, estimates = cell.near(i, once=False)
        if len(other):
            found.append((names[i], names[other[estimates.argmax()]], estimates.max()))
    return pd.DataFrame(found, columns=["x", "y", "near"])


def _involved(rows: pd.DataFrame, threshold: float, percent: int) -> pd.DataFrame:
    """The classes with anything to compare in this bucket."""
    cell, busy = _Cell(rows, threshold), np.zeros(len(rows), bool)
    for i in cell.seekers():
        other, _ = cell.near(i, once=True)
        busy[other] = True
        busy[i] |= len(other) > 0
    return rows.loc[busy, ["cls", "bucket", "band"]]


def _linked(rows: pd.DataFrame, threshold: float, percent: int) -> pd.DataFrame:
    """Confirmed links that join components: one fewer than the components that they join."""
    cell, names, found = _Cell(rows, threshold), rows["cls"].to_numpy(object), []
    sets, now = [np.frombuffer(x, "<u8") for x in rows["shingles"]], cell.root.copy()
    for i in cell.seekers():
        for j in cell.near(i, once=True)[0]:
            if now[i] != now[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    _union(now, i, j)
                    found.append((names[i], names[j]))
    return pd.DataFrame(found, columns=["x", "y"])


def _cells(batches, work, threshold, percent):
    """work over the runs of rows with one cell, from a partition sorted by cell."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        cell = batch[["bucket", "lo", "hi"]].to_numpy()
        edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield work(batch.iloc[a:b], threshold, percent)
        rest = batch.iloc[edges[-1] :]
    if rest is not None:
        yield work(rest, threshold, percent)


def _by_cell(met: DataFrame, about: DataFrame, work, schema: str, threshold: float, percent: int) -> DataFrame:
    """work over every bucket of met (cls, bucket, band, root) with several components; a large bucket goes in pairs of blocks.

    about: cls, n_shingles, sketch (and shingles) of the classes; they join only the buckets that are left.
    """
    several = met.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    rows = met.join(several, "bucket", "left_semi").join(about, "cls")
    blocks = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"))
    blocks = blocks.select("bucket", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = rows.join(blocks, "bucket").withColumn("part", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other", "blocks")
    placed = placed.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return placed.mapInPandas(tidied(lambda batches: _cells(batches, work, threshold, percent)), schema)


def _named(classes: DataFrame, links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """cls and root of every class, by links (a, b) and the roots before them, which stand for all earlier links."""
    if before is not None:
        if links.isEmpty():
            return before
        links = before.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")).union(links)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "cls")
    return materialize(classes.select("cls").join(roots, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _nearest(bands: DataFrame, classes: DataFrame, named: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Pairs (a, b): each class with the nearest that it shares a bucket with, but no component."""
    found = _by_cell(bands.join(named, "cls"), classes.drop("doc_id"), _best, "x binary, y binary, near double", threshold, percent)
    return _ordered(found.groupBy("x").agg(F.max_by("y", F.struct("near", "y")).alias("y")))


def _remaining(bands: DataFrame, classes: DataFrame, named: DataFrame, docs: DataFrame, width: int, threshold: float, percent: int) -> DataFrame:
    """Links (a, b) that join components which still share a bucket."""
    met, about = bands.join(named, "cls"), classes.drop("doc_id")
    open_ = materialize(_by_cell(met, about, _involved, "cls binary, bucket long, band int", threshold, percent).distinct())
    some = materialize(classes.join(open_.select("cls").distinct(), "cls"))
    sets = _sets_of(docs, some.select("doc_id").distinct(), width).dropDuplicates(["cls"])
    whole = materialize(some.drop("doc_id").join(sets, "cls"))
    found = materialize(_ordered(_by_cell(open_.join(named, "cls"), whole, _linked, "x binary, y binary", threshold, percent)).distinct())
    discard(open_, some, whole)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, key (of the text), n_shingles, component_id, n_texts (different sets in the component) and kept of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    threshold = percent / 100
    rows = materialize(sketches(docs, width))
    classes = materialize(
        rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    )
    bands = classes.select(
        "cls", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> substring(sketch, 1 + i * {2 * ROWS}, {2 * ROWS}))")).alias("band", "part")
    ).select("cls", F.col("band").cast("int").alias("band"), F.xxhash64("band", "part").alias("bucket"))
    hubs = bands.groupBy("bucket").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    # the buckets of one class end here
    bands = materialize(bands.join(hubs, "bucket"))
    met = bands.where("cls <> hub").groupBy("hub", "cls").agg(F.count("*").alias("n")).where("n > 2")
    bands = bands.drop("hub")
    first = met.groupBy("cls").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")).select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    named = _named(classes, _confirm(first, classes, docs, width, percent))
    named = _named(classes, _confirm(_nearest(bands, classes, named, threshold, percent), classes, docs, width, percent), named)
    named = _named(classes, _remaining(bands, classes, named, docs, width, threshold, percent), named)
    named = named.join(classes.select("cls", "doc_id"), "cls")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_texts"))
    owner = named.join(smallest, "root").select("cls", "component_id", "n_texts")
    return (
        rows.drop("sketch")
        .join(owner, "cls", "left")
        .select(
            "doc_id",
            "key",
            "n_shingles",
            F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("n_texts", F.lit(1)).cast("long").alias("n_texts"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("key")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays."""
    kept = near_duplicates(docs).where("kept").groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    kept = materialize(kept)
    out = keep_rows(docs, kept)
    if kept.where("n > 1").isEmpty():
        return out
    return out.withColumn("__key", text_key()).dropDuplicates(["doc_id", "__key"]).drop("__key")


QUERIES = {"op1_near_dedup": op1_near_dedup}
ORACLE = {
    "op1_near_dedup": r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
          ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
    e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM g),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.s = y.s AND x.doc_id < y.doc_id
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
    l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
    k AS (SELECT component_id, count(DISTINCT sh) AS n_texts FROM (SELECT c.component_id, list_sort(sh) AS sh FROM g JOIN c USING (doc_id)) GROUP BY 1)
    SELECT g.doc_id, len(g.sh)::BIGINT AS n_shingles, c.component_id, k.n_texts::BIGINT AS n_texts, g.doc_id = c.component_id AS kept
    FROM g JOIN c USING (doc_id) JOIN k USING (component_id)"""
}
