"""How far the sources of a language lie from each other, and the terms that set each apart from its language.

Words are counted once over all texts: tasks count them by (lang, source) and hand on sums. Terms
in at least MIN_DOCS documents of a language are kept and dealt, by a hash, to slices of some
SLICE terms, so nothing ever holds a whole vocabulary. In a slice a source is a vector: the
places of the terms it has, and their shares of its words in billionths; all other terms have
one and the same share. Vectors are compressed (differences of places and shares, deflated).

Sources are dealt to blocks, and blocks meet as players of a round-robin tournament do. The
vectors lie in a table bucketed by language, slice and block, and stay there; in each round
every block's partner is another, one of the two sends its vectors over, and a meeting evaluates
every pair of their sources, for both directions. A round's sums are written before the next
begins, so no more than one copy of the vectors is under way. The last round has every block
meet itself.

The terms of a group that go beyond its language are ranked in heaps of `most` terms, one for
each group and task, and the heaps' terms by one window a group.

All arithmetic is on integers. Defined results: a null text, language or source is the empty
string; groups without terms take part with equal shares of all terms; a language without kept
terms has its pairs at 0 and no terms; repeated rows count again; an empty table gives no rows;
other columns take no part.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.store import discard, documents, join_keys, materialize, remove, shared_dir, tidied

MIN_DOCS = 10
#: terms of a slice, on average
SLICE = 8_192
#: distinct terms that a task holds before it hands on what it has counted
HELD = 800_000
#: bytes of a text that are taken apart at once
PIECE = 1 << 22
BILLION = 1_000_000_000
TERM = re.compile(rb"[a-z\x80-\xff]+")
COUNTED = "lang string, source string, term string, n long, docs long"


def _pieces(data: bytes):
    """data in pieces that end where a term does."""
    first = 0
    while first < len(data):
        last = first + PIECE
        if last < len(data):
            inside = TERM.match(data, last)
            last = inside.end() if inside else last
        yield data[first:last]
        first = last


def _count(batches):
    import numpy as np
    import pyarrow as pa

    names = [c.split()[0] for c in COUNTED.split(", ")]

    def handed_on():
        for (lang, source), (n, docs) in groups.items():
            # both hold the same terms in the same order; the empty term stands for the group
            terms = pa.array([b"", *n], pa.binary()).cast(pa.string())
            sums = [pa.array(np.fromiter((0, *c.values()), np.int64, len(terms))) for c in (n, docs)]
            table = pa.RecordBatch.from_arrays([pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), terms, *sums], names)
            for i in range(0, len(terms), 50_000):
                yield table.slice(i, 50_000)

    groups: dict = defaultdict(lambda: (Counter(), Counter()))
    held = 0
    for batch in batches:
        lang_of, source_of = (batch.column(c).to_pylist() for c in ("lang", "source"))
        for lang, source, text in zip(lang_of, source_of, batch.column("text").cast(pa.binary()), strict=True):
            n, docs = groups[lang, source]
            before, seen = len(n), {}
            for piece in _pieces(text.as_py().lower()):  # lowers A-Z only
                words = TERM.findall(piece)
                n.update(words)
                seen.update(dict.fromkeys(words))
            docs.update(iter(seen))
            held += len(n) - before
            if held > HELD:
                yield from handed_on()
                groups.clear()
                held = 0
    yield from handed_on()


def hits(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, of_lang, first): occurrences of the terms that a language keeps, by group and in all of it, and of the empty term for every group.

    Sums are dealt by language and term once: a group's sums, the language's, and which terms are
    kept all follow there, from at most a row for each source. first is true in one row a term.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(*text).mapInArrow(tidied(_count), COUNTED).repartition(parts, "lang", "term")
    sums = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = sums.select("lang", "source", "term", "n", F.sum("n").over(term).alias("of_lang"), F.sum("docs").over(term).alias("of_docs"), (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    return materialize(whole.where((F.col("of_docs") >= min_docs) | (F.col("term") == "")).drop("of_docs"))


def share(n: str, total: str = "total", terms: str = "terms") -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), whatever the size of n."""
    return F.expr(f"1 + ({BILLION} * (cast({n} as decimal(20,0)) + 2)) div ({total} + 2 * {terms})")


def apart(p: str = "p", q: str = "q") -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def packed(places, shares) -> bytes:
    import numpy as np

    places = np.asarray(places, np.uint32)
    order = np.argsort(places)
    steps = np.diff(places[order], prepend=np.uint32(0)).astype(np.uint32)
    return zlib.compress(steps.tobytes() + np.asarray(shares, np.uint32)[order].tobytes(), 1)  # a share is at most 10^9 + 1


def unpacked(data: bytes | None):
    import numpy as np

    both = np.frombuffer(zlib.decompress(data) if data is not None else b"", np.uint32)
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.int64), both[half:].astype(np.int64)


def distance(size: int, mine, peer) -> int:
    """The sum over a slice's `size` terms for two vectors (slots or places, shares, share of all other terms)."""
    slot, p, rest = mine
    places, q, other = peer
    f = lambda a, b: (a - b) * (a - b) // (a + b)
    at = slot[places]
    both = at[at >= 0]
    there = q * 0 + rest
    there[at >= 0] = p[both]
    neither = size - len(p) - len(q) + len(both)
    return int(f(there, q).sum() + f(p, other).sum() - f(p[both], other).sum()) + neither * int(f(rest, other))


def _meet(mine, visitors):
    """All pairs of a block's sources with the visitors' (once each, where a block meets itself), both ways."""
    import numpy as np
    import pandas as pd

    rows = []
    if len(mine) and len(visitors):
        size, lang, home = int(mine["size"].iat[0]), mine["lang"].iat[0], mine["block"].iat[0] == visitors["block"].iat[0]
        peers = [(s, *unpacked(v), int(rest)) for s, v, rest in zip(visitors["source"], visitors["vector"], visitors["rest"], strict=True)]
        for source, vector, rest in zip(mine["source"], mine["vector"], mine["rest"], strict=True):
            places, p = unpacked(vector)
            slot = np.full(size, -1, np.int64)
            slot[places] = np.arange(len(places))
            for peer, at, q, other in peers:
                if not home or source < peer:
                    value = distance(size, (slot, p, int(rest)), (at, q, other))
                    rows += [(lang, source, peer, value), (lang, peer, source, value)]
    return pd.DataFrame(rows, columns=["lang", "source", "item", "value"])


def _heaps(most: int):
    """(lang, source, item, value) to the `most` best of each group in a task: the highest values, then the first items."""

    def work(batches):
        import pyarrow as pa

        best: dict = {}
        worst: dict = {}
        for batch in batches:
            for lang, source, item, value in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "item", "value")), strict=True):
                key, one = (lang, source), (-value, item)
                if key not in worst or one < worst[key]:
                    held = best.setdefault(key, [])
                    held.append(one)
                    if len(held) >= 8 * most:
                        best[key] = heapq.nsmallest(most, held)
                        worst[key] = best[key][-1]
        rows = [(*key, item, -value) for key, held in best.items() for value, item in heapq.nsmallest(most, held)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "source", "item", "value"])

    return work


def partner(rounds: int) -> Column:
    """Whom a block meets in a round of its language: i + j is the round modulo the number of players less one; who would meet itself meets the last."""
    r, players = F.lit(rounds).cast("long"), F.col("blocks") + F.col("blocks") % 2
    other = F.pmod(r - F.col("block"), players - 1)
    last = F.pmod(r * players / 2, players - 1).cast("long")
    return F.when(F.col("block") == players - 1, last).when(other == F.col("block"), players - 1).otherwise(other)


def divergence(docs: DataFrame, most: int = 10, min_docs: int = MIN_DOCS, slice_terms: int = SLICE, block: int = 8) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank for every (lang, source) of docs (lang, source, text)."""
    spark = docs.sparkSession
    found = hits(docs, min_docs)
    words = found.where("term <> ''")
    langs = materialize(words.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"), F.count("*").alias("c")))
    slices = -(-(langs.agg(F.max("terms")).first()[0] or 1) // slice_terms)
    placed = words.withColumn("slice", F.expr(f"cast(pmod(xxhash64(term), {slices}) as int)")).withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1)

    totals = words.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("c"))
    every = found.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs.drop("c"), "lang", "left").na.fill(0, ["total", "c", "terms", "lang_total"])
    # at most 8 blocks until those have 512 sources each
    blocks = F.expr(f"greatest(count(*) over (partition by lang) div 512, least(8, (count(*) over (partition by lang) + {block - 1}) div {block}))")
    groups = every.withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(source), blocks)"))
    groups = materialize(groups.withColumn("rest", F.when(F.col("terms") > 0, share("0")).otherwise(1)))

    table = materialize(placed.drop("first"))
    of_group = groups.select("lang", "source", "total", "lang_total", "terms", "c")
    shares = join_keys(table, of_group, ["lang", "source"]).withColumn("p", share("n"))
    beyond = shares.withColumn("q", share("of_lang", "lang_total")).where("p > q").select("lang", "source", F.col("term").alias("item"), apart().alias("value"))
    heaps = beyond.mapInArrow(_heaps(most), "lang string, source string, item string, value long")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranks = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    best = materialize(ranks(heaps, "term").where(F.col("rank") <= most))

    pack = F.pandas_udf(lambda places, of: places.combine(of, packed), "binary")
    held = shares.groupBy("lang", "source", "slice").agg(F.collect_list(F.struct("place", "p")).alias("terms"))  # a slice's terms at most
    vectors = held.select("lang", "source", "slice", pack("terms.place", "terms.p").alias("vector"))
    sizes = shares.groupBy("lang", "slice").agg((F.max("place") + 1).alias("size"))
    all_slices = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("lang", "source", "slice", "block", "blocks", "rest")
    resident = all_slices.join(vectors, ["lang", "source", "slice"], "left").join(sizes, ["lang", "slice"], "left").na.fill(0, ["size"])

    keys, parts = ["lang", "slice", "block"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"residents_{uuid.uuid4().hex}", f"{shared_dir(spark)}/residents-{uuid.uuid4().hex}"
    resident.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", path).saveAsTable(name)
    players = groups.agg(F.max("blocks")).first()[0] or 1
    rounds = []
    for r in range(players + players % 2):
        at_home = r == players + players % 2 - 1
        home = spark.table(name)
        other = F.col("block") if at_home else partner(r)
        moving = home.withColumn("at", other).where("at = block" if at_home else f"at < block and {r} < blocks + blocks % 2 - 1")
        met = home.groupBy(*keys).cogroup(moving.groupBy("lang", "slice", "at")).applyInPandas(_meet, "lang string, source string, item string, value long")
        rounds.append(materialize(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))))
    spark.sql(f"DROP TABLE {name}")
    remove(spark, path)
    discard(found, langs, table, groups)
    pairs = rounds[0]
    for more in rounds[1:]:
        pairs = pairs.unionByName(more)
    return ranks(pairs, "pair").unionByName(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = {
    "op12_source_divergence": rf"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCS}),
    l AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
    s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 1 + ({BILLION}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0)::HUGEINT + 2 * l.terms) AS p, 1 + ({BILLION}::HUGEINT * (k.n + 2)) // (l.total::HUGEINT + 2 * l.terms) AS q
          FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
    v AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""
}
QUERIES = {"op12_source_divergence": op12_source_divergence}
