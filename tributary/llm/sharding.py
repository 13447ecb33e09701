"""Sharding by a minimax contiguous partition of ordered atomic groups.

Documents with equal texts form one group and stay together. Groups are ordered by the MD5 of
their text. The smallest feasible capacity is found by a binary search: a capacity is feasible
if filling shards greedily, group by group, needs no more shards than there are; shards are cut
there. The search is exact over all groups, though only a summary of them is looked at: ranges
of MD5s by their first four digits (65,536 at most), as sums of sizes. Treating a range once as
atomic and once as divisible anywhere bounds the capacity from both sides, and with it where
cuts can fall. Ranges that hold several groups there are split by one more digit (a count of
the groups under a few thousand prefixes, broadcast), until only single groups are left where
cuts can fall and both bounds agree. The summary is a few ranges a shard longer each time,
whatever the number of documents.

Where one huge group sets the capacity, a second greedy pass also closes a shard once it has its
even share of what is left, and those cuts are taken if no shard exceeds the capacity, so the
remaining shards do not stay empty.

Slots number the documents of a shard from 0 without gaps. They come from counts in two steps,
by range and by part of a range (large ranges are split by a hash of doc_id), so no window spans
a shard or a hot group.

Defined results: a null text has 0 bytes and the digest of the empty text; empty tables give
no rows; repeated rows each get a slot of their own; null ids are ids like any other; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.store import documents, materialize

OVERHEAD = 16
PART_ROWS = 512
#: hex digits of the first ranges
DIGITS = 4


class Ranges:
    """Ordered ranges of groups: (key, bytes, whether it is one group). No more than a summary of the groups."""

    def __init__(self, entries: list[tuple]):
        self.entries = sorted(entries)
        self.ends = [0, *accumulate(size for _, size, _ in self.entries)]

    def _reach(self, at: float, capacity: int, divisible: bool) -> float:
        """How far a shard that starts at byte `at` goes."""
        to = at + capacity
        if to >= self.ends[-1]:
            return self.ends[-1]
        i = bisect_right(self.ends, to) - 1
        return to if divisible and not self.entries[i][2] else self.ends[i]

    def fits(self, capacity: int, shards: int, divisible: bool) -> bool:
        at = 0
        for _ in range(shards):
            at = self._reach(at, capacity, divisible)
        return at >= self.ends[-1]

    def least(self, shards: int, low: int, divisible: bool) -> int:
        """The smallest capacity, `low` at least, that fits."""
        high = max(low, self.ends[-1])
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards, divisible) else (middle + 1, high)
        return low

    def open(self, shards: int, low: int, high: int) -> list[str]:
        """Keys of the ranges of several groups in which a cut can fall at a capacity from low to high."""
        found, first, last = set(), 0, 0
        for _ in range(shards - 1):
            first, last = max(first, self._reach(first, low, False)), self._reach(last, high, True)
            i, j = bisect_right(self.ends, first) - 1, bisect_right(self.ends, last) - 1
            found.update(k for k, _, single in self.entries[max(i - 1, 0) : j + 1] if not single)
        return sorted(found)

    def cuts(self, capacity: int, shards: int) -> list:
        """Keys of the first range of every shard but the first; shards close early at their even share if that fits."""
        plain, used = [], 0
        for key, size, _ in self.entries:
            if used and used + size > capacity:
                plain.append(key)
                used = 0
            used += size
        even, used, left, most = [], 0, self.ends[-1], 0
        for key, size, _ in self.entries:
            k = shards - len(even)
            if used and k > 1 and (used + size > capacity or used + size / 2 > (left + used) / k):
                even.append(key)
                used = 0
            used, left = used + size, left - size
            most = max(most, used)
        return even if most <= capacity else plain


def minimax_shards(units: DataFrame, shards: int) -> DataFrame:
    """units: (unit int, bytes long, n long), atomic groups, at most 65,536 rows. Adds shard and capacity."""
    ranges = Ranges([(r["unit"], r["bytes"], True) for r in units.select("unit", "bytes").collect()])
    capacity = ranges.least(shards, max((b for _, b, _ in ranges.entries), default=0), False)
    shard = _shard_of(F.col("unit"), ranges.cuts(capacity, shards))
    return units.select("unit", "n", "bytes", shard.alias("shard"), F.lit(capacity).cast("long").alias("capacity"))


def _shard_of(key, cuts: list):
    return sum(((key >= F.lit(c)).cast("int") for c in cuts), F.lit(0)).cast("int")


def exact_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity over all groups (digest, bytes), and the digests' prefixes at which shards begin."""

    def ranged(rows: DataFrame, digits: int) -> list[tuple]:
        by = rows.groupBy(F.substring("digest", 1, digits).alias("key")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        return [(r["key"], r["bytes"], r["n"] == 1) for r in by.collect()]

    largest = groups.agg(F.max("bytes")).first()[0] or 0
    ranges, digits = Ranges(ranged(groups, DIGITS)), DIGITS
    while True:
        low = ranges.least(shards, max(largest, -(-ranges.ends[-1] // shards)), True)
        high = ranges.least(shards, low, False)
        wide = ranges.open(shards, low, high) if low < high else []
        if not wide:
            return high, ranges.cuts(high, shards)
        spark = groups.sparkSession
        # a few ranges a shard, 65,536 at most
        few = F.broadcast(spark.createDataFrame([(k,) for k in wide], "prefix string"))
        digits += 1
        inside = None
        for length in sorted({len(k) for k in wide}):
            part = groups.join(few, F.substring("digest", 1, length) == F.col("prefix"), "left_semi")
            inside = part if inside is None else inside.union(part)
        split = set(wide)
        ranges = Ranges([e for e in ranges.entries if e[0] not in split] + ranged(inside, digits))


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialize(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest")))
    groups = materialize(base.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    _, cuts = exact_cuts(groups, shards)
    here = [_shard_of(F.col("digest"), cuts).alias("shard"), F.conv(F.substring("digest", 1, DIGITS), 16, 10).cast("int").alias("unit")]
    units = groups.select(*here, "n").groupBy("shard", "unit").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("unit_slot", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")).drop("n")
    # a row for each range and shard: 65,536 and a few, by construction
    rows = base.select("doc_id", "size", "text_crc32", *here).join(F.broadcast(units), ["shard", "unit"]).withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), parts) as int)"))
    earlier = Window.partitionBy("shard", "unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "unit", "part").agg(F.count("*").alias("rows")).withColumn("part_slot", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    within = Window.partitionBy("shard", "unit", "part").orderBy("doc_id", "text_crc32", "size")
    slot = F.col("unit_slot") + F.col("part_slot") + F.row_number().over(within) - 1
    return rows.join(offsets, ["shard", "unit", "part"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op6_sharding": op6_sharding}
ORACLE: dict[str, str] = {}  # CRC-32 and the greedy search have no SQL here; see the brute-force tests
