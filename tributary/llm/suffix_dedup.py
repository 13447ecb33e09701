"""Removal of long repeats by a hash-compared sort of suffixes.

A byte goes if it is covered by a string of `length` bytes that also starts elsewhere, in any
document. Every such string holds an anchor: the position of the least hash of a gram of
3/10 of the length among the grams in it (the rightmost of equal ones). Both copies of a string
have the same anchor, so only anchors and their surroundings need comparing.

1. Anchors with the gram's hash and a 128-bit BLAKE2b digest of their whole surroundings (all
   strings that could hold the anchor). Anchors whose gram occurs once end here, but for a few
   that a bitmap of the others lets through; they meet nothing later.
2. Anchors with equal surroundings become a few lists. Surroundings that occur twice are repeats
   from end to end.
3. The remaining anchors and one of each repeated surroundings meet by gram. In a group, the
   suffixes at one offset before the anchor are merge-sorted: two suffixes are compared by
   prefix polynomial hashes and a binary search for their common extension. Neighbours that
   agree on the full length, and whose bytes prove equal, are repeats. Strings whose hash
   nothing else at their offset has stay out of the sort, and each row enters with its
   outermost others and a twin of each. Where hashes collide, the group is compared by bytes.
   Groups too large for one task are cut in two by offset, with the digest of what all strings
   of that half share as the new key, as often as needed; those with one offset left are
   settled by an aggregate over the digests of their strings.

Passages: a run of 51 words or more that another text holds as well may have fewer bytes than
`length` (it has some 315 in the median). Such runs are found in the same scan by anchors over
words (grams of 11), whose windows of 44 words, 8 words apart, are compared by hash: one of them
lies inside every common run of 51 words around the anchor. op4 reports them and removes none.
The pipeline's stage removes them in every text: only runs that hold a window found twice are
compared, whole, by 128-bit digests of their words, so runs of 50 words stay. Texts of 51 words
or more that occur twice go whole.

Equal texts are repeats as a whole and take part once a task; texts are known by their MD5 and
length. Texts travel only if a bitmap of bounded size says that they have something to compare
or to remove. Keys with many rows are joined from a broadcast of the (few) hottest keys.

Defined results: a null text has no bytes; texts shorter than the length lose nothing; repeated
rows are copies of each other; null or repeated doc_ids do not matter, since texts are known by
their digest; an empty table gives an empty one. Columns of the input keep their names and
values; only names that begin with two underscores are reserved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.bytestext import BASE, SPACE, blocks, encode, gram_hashes, mix, powers, prefix_hashes, substring_hashes
from tributary.llm.store import bitmap, discard, documents, has_bit, join_keys, materialize, maybe_in, small_batches, tidied

LENGTH = 400
#: words of a passage, of the grams that anchor it, and of the windows that are compared, which lie STEP words apart
PASSAGE, WORD_GRAM, WINDOW, STEP = 51, 11, 44, 8
GROUP_ROWS = 16_384
#: bytes of texts whose anchors are looked for together: their arrays stay in a core's cache
BLOCK = 1 << 17
#: lists into which the anchors with equal surroundings are dealt at least, and anchors for which there is one list more
SALTS, SALT_ROWS = 16, 500_000
#: bits of the table by which strings without a twin are told apart, at most
TWIN_BITS = 19
#: offsets whose strings are first told apart by what they all share
SPAN = 16
BATCH_BYTES = 1 << 22
U = np.uint64
LOW = U(0xFFFFFFFF)


def _gram(length: int) -> int:
    return max(1, 3 * length // 10)


def _least(grams: np.ndarray, window: int, valid: np.ndarray) -> np.ndarray:
    """Positions that have the least hash (by its upper half, the rightmost of equal ones) in some valid window."""
    order = np.arange(len(grams), dtype=U)
    np.subtract(LOW, order, out=order)
    order |= grams & ~LOW
    width = 1
    while 2 * width <= window:  # from here on, order has the least of `width` places
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    if width < window:
        order = np.minimum(order[: width - window], order[window - width :])
    least = order[valid[: len(order)]]
    least = (LOW - (least & LOW)).astype(np.int64)
    return least[np.concatenate([[True], least[1:] != least[:-1]])] if len(least) else least


class _Block:
    """Some texts with a space between, with the hashes of all prefixes."""

    def __init__(self, parts: list[bytes]):
        self.text = b" ".join(parts)
        self.data = np.frombuffer(self.text, np.uint8)
        self.prefix = prefix_hashes(self.data)
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """The text of each anchor, its position there, the hash of its gram and the digest of its surroundings."""
        gram, n = _gram(length), len(self.data)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), []
        window = length - gram + 1
        grams = gram_hashes(self.prefix, gram)
        long = self.sizes >= length
        edge = np.zeros(n + 1, np.int8)
        edge[self.begins[long]] = 1
        edge[(self.begins + self.sizes)[long] - length + 1] = -1
        at = _least(grams, window, np.cumsum(edge[:n], dtype=np.int8).view(bool))
        whose = np.searchsorted(self.begins, at, side="right") - 1
        begin, end = self.begins[whose], (self.begins + self.sizes)[whose]
        low, high = np.maximum(at - window + 1, begin), np.minimum(at + length, end)
        around = [
            hashlib.blake2b(self.text[a:b], digest_size=16, salt=(i - a).to_bytes(8, "big")).digest() for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True)
        ]
        return whose, at - begin, grams[at], around

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, each text's first word and number of words, and the prefix hashes over words."""
        word = np.concatenate([[False], ~SPACE[self.data], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        firsts = np.searchsorted(starts, self.begins)
        run = np.concatenate([np.zeros(1, U), np.cumsum(substring_hashes(self.prefix, starts, ends) * powers(BASE, len(starts)))])
        return starts, ends, firsts, np.diff(np.append(firsts, len(starts))), run

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text of each word anchor, the hash of its gram, and of its windows (a row each; NONE where the text has no such window)."""
        starts, _, firsts, counts, run = self.words()
        n = len(starts)
        if n < PASSAGE:
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros((0, len(WINDOWS)), np.int64)
        last = np.repeat(firsts + counts, counts)
        grams = gram_hashes(run, WORD_GRAM)
        at = _least(grams, PASSAGE - WORD_GRAM + 1, last - np.arange(n) >= PASSAGE)
        whose = np.repeat(np.arange(len(firsts)), counts)[at]
        begin = at[:, None] - np.arange(0, PASSAGE - WORD_GRAM + 1, STEP)
        there = (begin >= firsts[whose][:, None]) & (begin + WINDOW <= last[at][:, None])
        inside = np.where(there, begin, 0)
        windows = substring_hashes(run, inside, inside + WINDOW).view(np.int64)
        return whose, grams[at], np.where(there, windows, NONE)

    def runs_with(self, windows: list[np.ndarray]) -> list[tuple[int, int, int, bytes]]:
        """(text, first and last byte, digest) of the runs of PASSAGE words that hold one of the text's listed windows."""
        starts, ends, firsts, counts, run = self.words()
        out = []
        for i, (first, count, begin) in enumerate(zip(firsts.tolist(), counts.tolist(), self.begins.tolist(), strict=True)):
            if count < PASSAGE:
                continue
            at = np.arange(first, first + count - WINDOW + 1)
            found = np.flatnonzero(np.isin(substring_hashes(run, at, at + WINDOW).view(np.int64), windows[i]))
            some = np.unique(found[:, None] - np.arange(PASSAGE - WINDOW + 1))
            words = self.text[begin : begin + int(self.sizes[i])].split()
            for k in some[(some >= 0) & (some + PASSAGE <= count)].tolist():
                digest = hashlib.blake2b(b" ".join(words[k : k + PASSAGE]), digest_size=16).digest()
                out.append((i, int(starts[first + k]) - begin, int(ends[first + k + PASSAGE - 1]) - begin, digest))
        return out


NONE = np.iinfo(np.int64).min
WINDOWS = [f"w{i}" for i in range(len(range(0, PASSAGE - WORD_GRAM + 1, STEP)))]
ANCHORS = "tk binary, n int, at binary, gram binary, around binary, word_gram binary, windows binary"


def _binary(data: bytes, edges: np.ndarray) -> pa.Array:
    """The bytes of data between neighbouring edges, as values."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def _unpacked(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _anchored(batches, length):
    """A row for each different text of a batch with anchors, which lie side by side in its columns (as of _Block)."""
    for batch in batches:
        texts = dict(zip(batch.column("__tk").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True))
        keys, parts = list(texts), list(texts.values())
        for a, b in blocks(parts, BLOCK):
            block = _Block(parts[a:b])
            whose, at, gram, around = block.anchors(length)
            who, word_gram, windows = block.passages()
            edges, word_edges = (np.searchsorted(w, np.arange(b - a + 1)) for w in (whose, who))
            columns = [
                pa.array(keys[a:b], pa.binary()),
                pa.array(block.sizes, pa.int32()),
                _binary(at.astype(np.int32).tobytes(), edges * 4),
                _binary(gram.tobytes(), edges * 8),
                _binary(b"".join(around), edges * 16),
                _binary(word_gram.tobytes(), word_edges * 8),
                _binary(windows.tobytes(), word_edges * 8 * len(WINDOWS)),
            ]
            some = (np.diff(edges) > 0) | (np.diff(word_edges) > 0)
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ANCHORS.split(", ")]).filter(pa.array(some))


def _repeated_grams(every: DataFrame, name: str) -> DataFrame:
    """(gram, c) of the grams in a packed column that occur c > 1 times."""

    def single(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(batch.column(0), np.int64))], ["gram"])

    return materialize(every.select(name).mapInArrow(single, "gram long").groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"))


def _meeting(every: DataFrame, grams: DataFrame, names: list[str], unpack, schema: str) -> DataFrame:
    """A row for each anchor whose gram (the first of the packed columns `names`) is in grams, and for a few others, by a bitmap of bounded size.

    unpack(packed columns, which anchors) gives the columns that follow (tk, n, gram).
    """
    table = every.sparkSession.sparkContext.broadcast(bitmap(grams.select("gram"), hashed=True))
    fields = [c.split()[0] for c in schema.split(", ")]

    def chosen(batches):
        for batch in batches:
            tk, n, packed, *rest = batch.columns
            gram = _unpacked(packed, np.int64)
            some = has_bit(table.value, gram & (len(table.value) * 32 - 1))
            whose = np.repeat(np.arange(len(tk)), [len(g) // 8 for g in packed.to_pylist()])[some]
            if len(whose):
                yield pa.RecordBatch.from_arrays([tk.take(pa.array(whose)), n.take(pa.array(whose)), pa.array(gram[some]), *unpack(rest, some)], fields)

    return every.select("tk", "n", *names).mapInArrow(tidied(chosen), schema)


def _places(columns: list[pa.Array], some: np.ndarray) -> list[pa.Array]:
    at, around = (_unpacked(c, kind)[some] for c, kind in zip(columns, (np.int32, "V16"), strict=True))
    return [pa.array(at), _binary(around.tobytes(), 16 * np.arange(len(at) + 1))]


def _windows(columns: list[pa.Array], some: np.ndarray) -> list[pa.Array]:
    windows = _unpacked(columns[0], np.int64).reshape(-1, len(WINDOWS))[some]
    return [pa.array(np.ascontiguousarray(w)) for w in windows.T]


def _surroundings(batches, length):
    """The bytes around each listed anchor of a text, with the anchor's place in them."""
    window = length - _gram(length) + 1
    for batch in batches:
        texts, sizes = encode(batch["text"]), batch["at"].map(len).to_numpy()
        at, n = np.concatenate(batch["at"].tolist()), np.repeat([len(t) for t in texts], sizes)
        low, high = np.maximum(at - window + 1, 0), np.minimum(at + length, n)
        whose = np.repeat(np.arange(len(texts)), sizes)
        yield pd.DataFrame(
            {
                "key": np.concatenate(batch["gram"].tolist()),
                "lone": np.concatenate(batch["lone"].tolist()),
                "tk": batch["tk"].to_numpy(object)[whose],
                "n": n,
                "at": at,
                "first": 0,
                "last": window - 1,
                "left": at - low,
                "bytes": [texts[i][a:b] for i, a, b in zip(whose.tolist(), low.tolist(), high.tolist(), strict=True)],
            }
        )


AROUND = "key long, lone boolean, tk binary, n int, at int, first int, last int, left int, bytes binary"


def _common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes (at most length) the suffixes at a and b share, by hashes and a binary search."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
    middle = high.copy()  # whole strings first, since most agree
    while len(open_ := np.flatnonzero(low < high)):
        m, x, y = middle[open_], a[open_], b[open_]
        same = substring_hashes(prefix, x, x + m) == substring_hashes(prefix, y, y + m)
        low[open_] = np.where(same, m, low[open_])
        high[open_] = np.where(same, high[open_], m - 1)
        middle = (low + high + 1) // 2
    return low


def _merge_sorted(data: np.ndarray, prefix: np.ndarray, run: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """An order of start that is sorted by run and, in a run, by the suffixes' first `length` bytes.

    A mergesort of all runs at once: an element of one half finds its place in the other half by
    a binary search, whose comparisons look for the two suffixes' common extension.
    """
    order = np.argsort(run, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], run[order][1:] != run[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(order)))
    head, size = np.repeat(head, size), np.repeat(size, size)
    place = np.arange(len(order)) - head
    width = 1
    while width < size.max(initial=0):
        half = place // width
        other = (half ^ 1) * width
        low, high = np.minimum(other, size), np.minimum(other + width, size)
        begin, left = low.copy(), half % 2 == 0
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            mine, its = start[order[open_]], start[order[head[open_] + middle]]
            shared = _common(prefix, mine, its, length)
            at = np.minimum(shared, length - 1)
            x, y = data[its + at], data[mine + at]
            before = np.where(shared < length, x < y, ~left[open_])  # equal strings of the left half come first
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        to = (half // 2) * 2 * width + (place - half * width) + (low - begin)
        moved = np.empty_like(order)
        moved[head + to] = order
        order = moved
        width *= 2
    return order


def _sorted_runs(data: np.ndarray, prefix: np.ndarray, run: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of start, and whether each suffix agrees with the next one in that order on `length` bytes, within the given runs."""
    order = _merge_sorted(data, prefix, run, start, length)
    same = run[order][1:] == run[order][:-1]
    pair = np.flatnonzero(same)
    same[pair] = _common(prefix, start[order[pair]], start[order[pair + 1]], length) == length
    return order, same


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, most: int = 4_096) -> bool:
    """Whether the strings of `length` bytes at a are those at b."""
    if not len(a):
        return True
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    return all(np.array_equal(strings[a[i : i + most]], strings[b[i : i + most]]) for i in range(0, len(a), most))


def _twins(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that occur more than once, and for each the place of another one."""
    bits = min(TWIN_BITS, (8 * len(keys)).bit_length())
    slot = (keys & U((1 << bits) - 1)).astype(np.int64)
    last, several = np.empty(1 << bits, np.int32), np.zeros(1 << bits, bool)
    every = np.arange(len(keys), dtype=np.int32)
    last[slot] = every
    several[slot[last[slot] != every]] = True
    some = np.flatnonzero(several[slot])
    some = some[np.argsort(keys[some], kind="stable")]
    value = keys[some]
    after = np.concatenate([value[1:] == value[:-1], [False]]) if len(some) else np.zeros(0, bool)
    before = np.concatenate([[False], after[:-1]])
    return some[after | before], np.where(after, np.roll(some, -1), np.roll(some, 1))[after | before]


def _outermost(group_ids: np.ndarray, prefix: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row (anchor at place, strings at low..high before it), the least and the greatest offset at which another
    row of its group has a string of the same hash (-1 without any), and a twin at each of the two.

    Offsets go by spans. Strings can be equal only if what all strings of the span share is equal, so
    rows form classes by that, and strings are looked at in those classes alone in which some row has
    not found its least offset (from below) or its greatest (from above): all rows of such a class.
    """
    golden = U(0x9E3779B97F4A7C15)
    least, most = np.full(len(place), -1), np.full(len(place), -1)
    twin = np.full((2, len(place)), -1)
    span = max(1, min(SPAN, length // 4))
    spans = np.arange(int(high.max(initial=-1)) // span + 1)
    row, k = np.nonzero((spans * span <= high[:, None]) & (spans * span + span > low[:, None]) & (low <= high)[:, None])
    start = place[row] - k * span
    value = substring_hashes(prefix, start, start + length - span + 1)
    value = mix(value + (group_ids[row] * (length + 1) + k).astype(U) * golden)
    some = _twins(value)[0]  # in the values' order
    row, k, value = row[some], k[some], value[some]
    which = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]])[: len(value)])
    seen = np.zeros(len(value) + 1, bool)

    def look(mine: np.ndarray, s: int) -> None:
        some = row[mine]
        offsets = s * span + np.arange(span)
        r, p = np.nonzero((offsets >= low[some][:, None]) & (offsets <= high[some][:, None]))
        r, p = some[r], offsets[p]
        start = place[r] - p
        value = substring_hashes(prefix, start, start + length)
        one, other = _twins(mix(value + (group_ids[r] * (length + 1) + p).astype(U) * golden))
        if not len(one):
            return
        one, other = r[one] * (length + 1) + p[one], r[other]
        order = np.argsort(one)
        other = other[order]
        r, p = np.divmod(one[order], length + 1)
        head = np.concatenate([[True], r[1:] != r[:-1]])
        tail = np.concatenate([head[1:], [True]])
        head &= (least[r] < 0) | (p < least[r])
        tail &= p > most[r]
        least[r[head]], twin[0, r[head]] = p[head], other[head]
        most[r[tail]], twin[1, r[tail]] = p[tail], other[tail]

    order = np.argsort(k, kind="stable")
    of = np.split(order, np.searchsorted(k[order], spans[1:]))
    for upward in (True, False):
        for s in spans if upward else spans[::-1]:
            mine = of[s]
            open_ = least[row[mine]] < 0 if upward else most[row[mine]] < s * span
            wanted = np.zeros(len(value) + 1, bool)
            wanted[which[mine[open_]]] = True
            mine = mine[wanted[which[mine]] & ~seen[which[mine]]]
            if len(mine):
                seen[which[mine]] = True
                look(mine, int(s))
    return least, most, twin


def _repeats(group_ids: np.ndarray, rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """For each row, the first and last offset before the anchor at which a repeated string starts; -1 if none.

    Only each row's outermost strings whose hash occurs again at their offset, with a twin each, enter the sort.
    """
    parts = rows["bytes"].tolist()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    data = np.frombuffer(b"".join([*parts, b"\0" * 8]), np.uint8)
    prefix = prefix_hashes(data)
    left, first, last = (rows[c].to_numpy(np.int64) for c in ("left", "first", "last"))
    low = np.maximum(first, length - (sizes - left))
    high = np.minimum(last, left)
    least, most, twin = _outermost(group_ids, prefix, begin + left, low, high, length)
    found = np.flatnonzero(most >= 0)
    both = [(found, least[found]), (twin[0, found], least[found]), (found, most[found]), (twin[1, found], most[found])]
    pairs = np.unique(np.concatenate([r * (length + 1) + p for r, p in both])) if len(found) else np.zeros(0, np.int64)
    row, place = np.divmod(pairs, length + 1)
    start = begin[row] + left[row] - place
    least[:], most[:] = -1, -1  # what follows decides: strings that the sort brings together and whose bytes agree
    order, same = _sorted_runs(data, prefix, group_ids[row] * (length + 1) + place, start, length)
    pair = np.flatnonzero(same)
    if not _equal(data, start[order[pair]], start[order[pair + 1]], length):
        return _by_bytes(group_ids, rows, length)
    both = order[np.unique(np.concatenate([pair, pair + 1]))]
    np.maximum.at(most, row[both], place[both])
    least[row[both]] = length
    np.minimum.at(least, row[both], place[both])
    return pd.DataFrame({"least": least, "most": most}, index=rows.index)


def _by_bytes(group_ids: np.ndarray, rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """The same by comparing bytes, for when hashes collide."""
    seen: dict = {}
    for i, (group, part, left, first, last) in enumerate(zip(group_ids, rows["bytes"], rows["left"], rows["first"], rows["last"], strict=True)):
        for p in range(max(first, length - (len(part) - left)), min(last, left) + 1):
            seen.setdefault((group, p, part[left - p : left - p + length]), []).append(i)
    out = np.full((len(rows), 2), -1)
    for (_, p, _), who in seen.items():
        if len(who) > 1:
            for i in who:
                out[i] = (p if out[i, 0] < 0 else min(p, out[i, 0]), max(p, out[i, 1]))
    return pd.DataFrame(out, columns=["least", "most"], index=rows.index)


def _compared(batches, length):
    """Whole groups of rows with one key, from a partition sorted by key; several small ones at a time."""

    def spans(rows):
        ids = np.unique(rows["key"].to_numpy(), return_inverse=True)[1]
        found = _repeats(ids, rows, length)
        out = rows[["tk", "n"]].assign(a=rows["at"] - found["most"], b=rows["at"] - found["least"] + length)
        return out[(found["most"] >= 0).to_numpy() & rows["lone"].to_numpy(bool)]

    held, size, before = [], 0, None
    for batch in batches:
        if not len(batch):
            continue
        key = batch["key"].to_numpy()
        ends = np.cumsum([0, *map(len, batch["bytes"])])
        heads = np.flatnonzero(np.concatenate([[bool(held) and key[0] != before], key[1:] != key[:-1]]))
        begin = 0
        while True:
            cut = heads[(heads >= begin) & (size + ends[heads] - ends[begin] > BATCH_BYTES)][:1]
            end = int(cut[0]) if len(cut) else len(batch)
            held.append(batch.iloc[begin:end])
            size += ends[end] - ends[begin]
            begin = end
            if not len(cut):
                break
            yield spans(pd.concat(held, ignore_index=True))
            held, size = [], 0
        before = key[-1]
    if held:
        yield spans(pd.concat(held, ignore_index=True))


def _halved(batches, length):
    """Each row twice: for the lower and the upper half of its offsets, by the hash of what all strings of that half share."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            low, high = max(r.first, length - (len(r.bytes) - r.left)), min(r.last, r.left)
            middle = (r.first + r.last) // 2
            for first, last in ((r.first, middle), (middle + 1, r.last)):
                if first <= last and max(first, low) <= min(last, high) and r.left >= first and len(r.bytes) - r.left >= length - last:
                    a, b = max(r.left - last, 0), min(r.left - first + length, len(r.bytes))
                    core = r.bytes[r.left - first : r.left - last + length]
                    key = int.from_bytes(hashlib.blake2b(core + first.to_bytes(4, "big") + last.to_bytes(4, "big"), digest_size=8).digest(), "big", signed=True)
                    out.append((key, r.lone, r.tk, r.n, r.at, first, last, r.left - a, r.bytes[a:b]))
        yield pd.DataFrame(out, columns=batch.columns)


def _settled(rows: DataFrame, length: int) -> DataFrame:
    """(tk, n, a, b) of the repeats among rows with one offset each, by an aggregate over the digests of their strings."""
    string = F.expr(f"substring(bytes, left - first + 1, {length})")
    rows = materialize(rows.where(f"left >= first and octet_length(bytes) - left >= {length} - first").select("tk", "n", "at", "first", "lone", F.md5(string).alias("string")))
    several = materialize(rows.groupBy("string").agg(F.count("*").alias("c")).where("c > 1"))
    a = F.col("at") - F.col("first")
    return join_keys(rows, several, "string").where("lone").select("tk", "n", a.alias("a"), (a + length).alias("b"))


def _grouped(rows: DataFrame, length: int, most: int) -> DataFrame:
    """(tk, n, a, b) of the repeats in groups of one key, however large the groups are."""
    found = None
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("last") - F.col("first")).alias("w"))
        large = materialize(counts.where(F.col("c") > most).select("key", "c", "w"))
        again = not large.isEmpty()
        here = rows.join(large, "key", "left_anti") if again else rows
        done = here.repartition("key").sortWithinPartitions("key").mapInPandas(tidied(lambda batches: _compared(batches, length)), "tk binary, n int, a int, b int")
        found = done if found is None else found.union(done)
        if not again:
            return found
        wide, narrow = large.where("w > 0").drop("w"), large.where("w = 0").drop("w")
        if not narrow.isEmpty():
            found = found.union(_settled(join_keys(rows, narrow, "key"), length))
        rows = materialize(join_keys(rows, wide, "key").select("key", *[c.split()[0] for c in AROUND.split(", ")[1:]]).mapInPandas(tidied(lambda batches: _halved(batches, length)), AROUND))


def _passages(every: DataFrame) -> DataFrame:
    """(tk, n, windows) of the texts that share a run of words, with the windows shared; every: rows of ANCHORS."""
    shared = _repeated_grams(every, "word_gram")
    window = F.explode(F.array(*WINDOWS)).alias("window")
    # a common run has its anchor's gram in both texts, so grams that the bitmap lets through by chance add nothing
    windows = _meeting(every, shared, ["word_gram", "windows"], _windows, "tk binary, n int, gram long, " + ", ".join(f"{w} long" for w in WINDOWS))
    windows = windows.select("tk", "n", "gram", window).where(F.col("window") != NONE).distinct()
    windows = materialize(windows.select("tk", "n", "window", F.xxhash64("gram", "window").alias("key")))
    again = materialize(windows.groupBy("key").agg(F.count("*").alias("c"), F.min("tk").alias("x"), F.max("tk").alias("y")).where("x <> y").select("key", "c"))
    found = materialize(join_keys(windows, again, "key").groupBy("tk", "n").agg(F.collect_set("window").alias("windows")))
    discard(shared, windows, again)
    return found


def _runs(batches):
    for batch in batches:
        parts = encode(batch["text"])
        for a, b in blocks(parts):
            found = _Block(parts[a:b]).runs_with([np.asarray(w) for w in batch["windows"].iloc[a:b]])
            whose = a + np.array([r[0] for r in found], np.int64)
            rest = pd.DataFrame([r[1:] for r in found], columns=["a", "b", "run"])
            yield pd.concat([batch[["tk", "n"]].iloc[whose].reset_index(drop=True), rest], axis=1)


def _shared_runs(docs: DataFrame, passage: DataFrame) -> DataFrame:
    """(tk, n, a, b) of every run of PASSAGE words that another text holds too; passage as of _passages."""
    some = _possible(docs, passage).select(F.col("__tk").alias("tk"), F.col("__n").alias("n"), "text").dropDuplicates(["tk", "n"])
    runs = materialize(some.join(passage, ["tk", "n"]).mapInPandas(tidied(_runs), "tk binary, n int, a int, b int, run binary"))
    again = materialize(runs.groupBy("run").agg(F.count("*").alias("c"), F.min("tk").alias("x"), F.max("tk").alias("y")).where("x <> y").select("run", "c"))
    return join_keys(runs, again, "run").select("tk", "n", "a", "b")


def repeated(docs: DataFrame, length: int = LENGTH, most: int = GROUP_ROWS, passages: bool = False) -> DataFrame:
    """(tk, n, spans, passage) of each different text with repeats; docs as of keyed. spans: array of (a, b), may overlap; null without any.

    With passages, runs of PASSAGE words that another text or a copy holds count as repeats, too.
    """
    every = materialize(docs.select("__tk", "text").mapInArrow(tidied(lambda batches: _anchored(batches, length)), ANCHORS))
    passage = _passages(every)
    copies = docs.select(F.col("__tk").alias("tk"), F.col("__n").alias("n")).groupBy("tk", "n").agg(F.count("*").alias("c")).where(F.col("c") > 1)
    entire = copies.where(F.col("n") >= length)
    if passages:
        worded = copies.where(F.col("n") < length).join(every.where("octet_length(word_gram) > 0").select("tk", "n"), ["tk", "n"], "left_semi")
        entire = materialize(entire.union(worded))
    grams = _repeated_grams(every, "gram")
    salts = max(SALTS, (grams.agg(F.sum("c")).first()[0] or 0) // SALT_ROWS)
    salt = F.pmod(F.xxhash64("tk", "at"), F.lit(salts)).alias("salt")
    # equal surroundings have one gram; a list holds a share of their anchors, so rows do not grow with the copies
    rows = _meeting(every, grams, ["gram", "at", "around"], _places, "tk binary, n int, gram long, at int, around binary")
    lists = rows.groupBy("gram", "around", salt).agg(F.collect_list(F.struct("tk", "n", "at")).alias("rows"))
    lists = materialize(lists)
    discard(every, grams)
    edges = materialize(lists.groupBy("gram", "around").agg(F.sum(F.size("rows")).alias("copies"), F.count("*").alias("c"), F.min(F.array_min("rows")).alias("r")))
    twice = materialize(edges.where("copies > 1").select("around", "c"))
    window = length - _gram(length) + 1
    whole = join_keys(lists, twice, "around").select(F.inline("rows"))
    whole = whole.select("tk", "n", F.greatest(F.lit(0), F.col("at") - window + 1).alias("a"), F.least("n", F.col("at") + length).alias("b"))
    mixed = materialize(edges.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"))
    edges = join_keys(edges.select("gram", (F.col("copies") == 1).alias("lone"), "r.tk", "r.n", "r.at"), mixed, "gram")
    listed = edges.groupBy("tk", "n").agg(F.collect_list(F.struct("at", "gram", "lone")).alias("rows"))
    listed = materialize(listed.select("tk", "n", *[F.expr(f"transform(rows, r -> r.{c})").alias(c) for c in ("at", "gram", "lone")]))
    some = _possible(docs, listed).select(F.col("__tk").alias("tk"), F.col("__n").alias("n"), "text").dropDuplicates(["tk", "n"])
    around = materialize(some.join(listed, ["tk", "n"]).mapInPandas(tidied(lambda batches: _surroundings(batches, length)), AROUND))
    spans = whole.union(_grouped(around, length, most)).union(entire.select("tk", "n", F.lit(0).alias("a"), F.col("n").alias("b")))
    if passages:
        spans = spans.union(_shared_runs(docs, passage))
    spans = spans.groupBy("tk", "n").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return spans.join(passage.select("tk", "n", F.lit(True).alias("passage")), ["tk", "n"], "full").withColumn("passage", F.coalesce("passage", F.lit(False)))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __tk (the text's MD5) and __n (its bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("text", text).withColumn("__tk", F.unhex(F.md5("text"))).withColumn("__n", F.octet_length("text").cast("int"))


def _possible(docs: DataFrame, listed: DataFrame, inside: bool = True, use=None, schema=None) -> DataFrame:
    """The rows of docs whose __tk may be in listed (or is not), by a bitmap of bounded size; through use, if given."""
    table = docs.sparkSession.sparkContext.broadcast(bitmap(listed.select("tk")))
    bit = maybe_in(table.value, "__tk")

    def chosen(batches):
        for batch in batches:
            some = batch[has_bit(table.value, batch["__bit"].to_numpy(np.int64)) == inside].drop(columns="__bit")
            if len(some):
                yield use(some) if use else some

    return docs.withColumn("__bit", bit).mapInPandas(tidied(chosen), schema or docs.schema)


def merged(spans, n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(s["a"], 0), min(s["b"], n)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def without_repeats(docs: DataFrame, use, schema, length: int = LENGTH, passages: bool = False) -> DataFrame:
    """use(batch of docs' rows, runs to remove of each row) for every row of docs (doc_id, text, ...), as a table of `schema`.

    The batches also have __passage: whether another text holds a run of PASSAGE words of this one. With passages, such runs are removed as well.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    spans = repeated(rows.select("__tk", "__n", "text"), length, passages=passages)
    spans = materialize(spans.toDF("__tk", "__n", "__spans", "__passage"))

    def spanned(batches):
        for batch in batches:
            batch["__passage"] = batch["__passage"].eq(True)
            yield use(batch, [merged(s, n) if s is not None else [] for s, n in zip(batch["__spans"], batch["__n"], strict=True)])

    found = spans.select(F.col("__tk").alias("tk"))
    left = _possible(rows, found, False, lambda batch: use(batch.assign(__passage=False), [[]] * len(batch)), schema)
    return left.union(_possible(rows, found).join(spans, ["__tk", "__n"], "left").mapInPandas(tidied(spanned), schema))


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean"


def _digests(batch: pd.DataFrame, runs: list) -> pd.DataFrame:
    parts = encode(batch["text"])
    return pd.DataFrame(
        {
            "doc_id": batch["doc_id"].astype("Int64"),
            "n_bytes": [len(p) for p in parts],
            "n_removed": [sum(b - a for a, b in r) for r in runs],
            "n_spans": [len(r) for r in runs],
            "kept_sha256": [hashlib.sha256(_cut(p, r)).hexdigest() for p, r in zip(parts, runs, strict=True)],
            "shares_passage": batch["__passage"],
        }
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return without_repeats(docs, _digests, DIGESTS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeats of LENGTH bytes and runs of PASSAGE words that another text holds go from every text; characters cut in two go whole. Null texts stay null."""
    names = docs.columns

    def shortened(batch: pd.DataFrame, runs: list) -> pd.DataFrame:
        out = batch[names].copy()
        out["text"] = batch["text"].where(~batch["__null"].to_numpy(bool), None)
        for i, r in enumerate(runs):
            if r:
                text = _cut(batch["text"].iat[i].encode("utf-8", "surrogatepass"), r).decode("utf-8", "ignore")
                out.iat[i, names.index("text")] = text
                if "n_chars" in names:
                    out.iat[i, names.index("n_chars")] = len(text)
        return out

    return without_repeats(docs.withColumn("__null", F.col("text").isNull()), shortened, docs.schema, passages=True)


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE: dict[str, str] = {}  # see the brute-force tests
