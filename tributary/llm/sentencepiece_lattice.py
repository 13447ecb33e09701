"""SentencePiece encoding and decoding over a relational lattice.

The piece table comes from a public model file. Its scores are merge ranks, so the lattice takes
log-probabilities of a Zipf law over the ranks; a character without a piece costs ten more than
the rarest piece and is written as its UTF-8 bytes' pieces. A text gets a leading space, spaces
are the pieces' word marks, and the encoding is the path with the highest sum.

Two neighbouring characters that stand together in no piece are a safe cut: no path crosses
them. Texts are cut there into short words, which are counted over the whole corpus. The words
of the lattice (those with the highest counts, WORDS at most, CHARS characters at most) are
taken apart in Spark: all substrings up to the longest piece are exploded, equi-joined to the
piece table, grouped by word and folded by a higher-order aggregate (Viterbi), which also walks
back. All of it runs in the partitioning that counting the words left, so edges never travel.
The segmented words, at most WORDS, are packed into arrays and sent to the tasks that encode
texts; words beyond them (rarer or longer) are folded there by the same recurrence. Words are
found by a 64-bit hash, so every text's ids are decoded and compared with its bytes where they
are made; a text that differs is folded as a whole. Decoding joins ids to pieces again. Neither
direction moves a text.

Defined results: a null or empty text has no pieces and decodes to the empty text; ties go to
the longer last piece; U+2581 in a text is written as bytes, so decoding always gives the text
back; repeated rows keep a row each.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.bytestext import INVERSE, BASE, mix, powers
from tributary.llm.mixing import MIX_COLUMNS
from tributary.llm.store import documents, materialize, small_batches, tidied

WORDS = 1 << 20
CHARS = 48
#: tasks that take the words apart; there are about 40 substrings a word
PARTS = 128
MARK = "▁"
TABLE = 1 << 11
BLOCK = 1 << 17
U = np.uint64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The piece table: text, id and log-probability, with the bytes' ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = np.full(256, -1, np.int64)
        self.score, self.id, raw = {}, {}, [b""] * n
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        for rank, i in enumerate(plain):
            text = model.id_to_piece(i).replace(MARK, " ")
            self.id[text], self.score[text] = i, float(np.float32(-math.log(rank + 2)))
            raw[i] = text.encode()
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte[value], raw[i] = i, bytes([value])
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, self.id))
        self.unknown = float(np.float32(min(self.score.values()) - 10))
        sizes = np.array([len(x) for x in raw])
        self.starts, self.sizes, self.bytes = np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(raw), np.uint8)
        self.joined = np.zeros((TABLE, TABLE), bool)
        far = set()
        for text in self.id:
            for a, b in zip(map(ord, text), map(ord, text[1:]), strict=False):
                if a < TABLE and b < TABLE:
                    self.joined[a, b] = True
                else:
                    far.add(a << 21 | b)
        self.far = np.array(sorted(far), np.int64)

    def fold(self, word: str) -> list[int]:
        """Ids of one word: the recurrence of the lattice, for words that are not in it."""
        best, back = [0.0], [(0, 0)]
        for end in range(1, len(word) + 1):
            top, step = -math.inf, None
            for start in range(max(0, end - self.longest), end):
                score = self.score.get(word[start:end])
                if score is None:
                    if start < end - 1:
                        continue
                    score = self.unknown
                if best[start] + score > top:
                    top, step = best[start] + score, (start, self.id.get(word[start:end], -ord(word[start]) - 1))
            best.append(top)
            back.append(step)
        out, end = [], len(word)
        while end:
            end, i = back[end]
            out.append(i)
        return self.spelled(out[::-1])

    def spelled(self, ids: list[int]) -> list[int]:
        """ids with unknown characters (-1 - code) as the pieces of their bytes."""
        if min(ids, default=0) >= 0:
            return ids
        return [j for i in ids for j in ([i] if i >= 0 else self.byte[list(chr(-1 - i).encode("utf-8", "surrogatepass"))].tolist())]

    def words(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All texts, each behind a space, with starts and hashes of their words and the number of words of each text."""
        whole = "".join(f" {t}" for t in texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.minimum(code, TABLE - 1)
        cut = ~self.joined[small[:-1], small[1:]]
        odd = np.flatnonzero((code[:-1] >= TABLE - 1) | (code[1:] >= TABLE - 1))
        if len(odd):
            pair = code[odd].astype(np.int64) << 21 | code[odd + 1]
            cut[odd] = ~np.isin(pair, self.far)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        cut[begins[1:] - 1] = True
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        ends = np.append(starts[1:], len(code))
        prefix = np.concatenate([np.zeros(1, U), np.cumsum(mix(code.astype(U) + U(1)) * powers(BASE, len(code)))])
        hashes = mix((prefix[ends] - prefix[starts]) * powers(INVERSE, len(code) + 1)[starts] + (ends - starts).astype(U))
        counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
        return whole, starts, hashes, counts


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _text_blocks(texts):
    """Runs of texts of about BLOCK characters."""
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(t if t is not None else "")
        size += len(held[-1])
        if size > BLOCK:
            yield i + 1 - len(held), held
            held, size = [], 0
    if held:
        yield len(texts) - len(held), held


def _counted(batches, table: Pieces):
    """Different words of a task's texts with counts; handed on whenever many are held."""
    held: dict[str, int] = {}
    for batch in batches:
        for _, texts in _text_blocks(batch["text"]):
            whole, starts, hashes, _ = table.words(texts)
            ends = np.append(starts[1:], len(whole))
            _, first, n = np.unique(hashes, return_index=True, return_counts=True)
            for a, b, c in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                if b - a <= CHARS:
                    held[whole[a:b]] = held.get(whole[a:b], 0) + c
        if len(held) > 400_000:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})
            held = {}
    if held:
        yield pd.DataFrame({"word": list(held), "n": list(held.values())})


def counted_words(docs: DataFrame, table: Pieces) -> DataFrame:
    """(word, n) of all words of at most CHARS characters."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return docs.select("text").mapInPandas(tidied(lambda batches: _counted(batches, shared.value)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


FOLD = """aggregate(edges, array(named_struct('score', 0D, 'start', 0, 'id', 0)),
    (best, e) -> if(size(best) <= e.end,
        array_append(best, named_struct('score', best[e.start].score + e.score, 'start', e.start, 'id', e.id)),
        if(best[e.start].score + e.score > best[e.end].score,
            concat(slice(best, 1, e.end), array(named_struct('score', best[e.start].score + e.score, 'start', e.start, 'id', e.id))), best)))"""
WALK = """aggregate(sequence(1, size(best)), named_struct('at', size(best) - 1, 'ids', cast(array() as array<int>)),
    (s, i) -> if(s.at = 0, s, named_struct('at', best[s.at].start, 'ids', array_prepend(s.ids, best[s.at].id))), s -> s.ids)"""


def segmented(words: DataFrame, table: Pieces) -> DataFrame:
    """(word, ids) by the lattice; words must be different. An unknown character has the id -1 - its code."""
    rows = [(text, i, table.score[text]) for text, i in table.id.items()]
    known = words.sparkSession.createDataFrame(rows, "piece string, id int, score double")
    ends = F.explode(F.expr(f"sequence(start + 1, least(start + {table.longest}, char_length(word)))"))
    spans = words.select("word", F.explode(F.expr("sequence(0, char_length(word) - 1)")).alias("start")).select("word", "start", ends.alias("end"))
    spans = spans.withColumn("piece", F.expr("substring(word, start + 1, end - start)"))
    # the vocabulary has a fixed number of pieces
    edges = spans.join(F.broadcast(known), "piece", "left").where("id is not null or end = start + 1")
    edge = F.struct("end", "start", F.coalesce("id", -1 - F.expr("ascii(piece)")).alias("id"), F.coalesce("score", F.lit(table.unknown)).alias("score"))
    return (
        edges.groupBy("word")
        .agg(F.array_sort(F.collect_list(edge)).alias("edges"))
        .select("word", F.expr(FOLD).alias("best"))
        .select("word", F.expr(WALK).alias("ids"))
    )


class Dictionary:
    """Segmented words as sorted hashes with their ids in one array."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.sizes = hashes[order], sizes[order].astype(np.int32)
        self.starts, self.ids = (np.cumsum(sizes) - sizes)[order], ids


def _packed(batches, table: Pieces):
    """A partition's words as one row of arrays."""
    hashes, sizes, ids = [], [], []
    for batch in batches:
        for word, own in zip(batch["word"], batch["ids"], strict=True):
            code = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            run = (mix(code.astype(U) + U(1)) * powers(BASE, len(code))).sum(dtype=U)
            hashes.append(run + U(len(code)))
            spelled = table.spelled(list(own))
            sizes.append(len(spelled))
            ids += spelled
    if hashes:
        yield pd.DataFrame({"hashes": [mix(np.array(hashes, U)).tobytes()], "sizes": [np.array(sizes, np.int32).tobytes()], "ids": [np.array(ids, np.int32).tobytes()]})


def dictionary(docs: DataFrame, table: Pieces, words: int = WORDS) -> Dictionary:
    """The lattice's words, `words` at most: all with a count at or above the least that leaves no more."""
    counts = materialize(counted_words(docs, table))
    # one row for each different count, of which there are few
    by_count = counts.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n"))
    least = by_count.withColumn("total", F.expr("sum(c) over (order by n desc)")).where(F.col("total") <= words).agg(F.min("n")).first()[0]
    chosen = counts.where(F.col("n") >= (least if least is not None else 1 << 62)).select("word")
    shared = docs.sparkSession.sparkContext.broadcast(table)
    packed = segmented(chosen.repartition(PARTS, "word"), table).mapInPandas(tidied(lambda batches: _packed(batches, shared.value)), "hashes binary, sizes binary, ids binary").toPandas()
    return Dictionary(*(np.frombuffer(b"".join(packed[c]), kind) for c, kind in (("hashes", U), ("sizes", np.int32), ("ids", np.int32))))


def _gather(starts: np.ndarray, sizes: np.ndarray, source: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """source[start : start + size] of every pair, one after another; starts beyond source are in more."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)
    if more is None or not len(more):
        return source[at]
    beyond = at >= len(source)
    out = np.empty(len(at), source.dtype)
    out[~beyond], out[beyond] = source[at[~beyond]], more[at[beyond] - len(source)]
    return out


def _encoded(texts: list[str], table: Pieces, words: Dictionary, memo: dict) -> list[np.ndarray]:
    whole, starts, hashes, counts = table.words(texts)
    place = np.minimum(np.searchsorted(words.hashes, hashes), max(len(words.hashes) - 1, 0))
    known = words.hashes[place] == hashes if len(words.hashes) else np.zeros(len(hashes), bool)
    begin, size = (words.starts[place], words.sizes[place].astype(np.int64)) if len(words.hashes) else (np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64))
    source, rest = [], np.flatnonzero(~known)
    ends, at = np.append(starts[1:], len(whole)), len(words.ids)
    for i in rest.tolist():
        word = whole[starts[i] : ends[i]]
        ids = memo.get(word)
        if ids is None:
            ids = table.fold(word)
            if len(word) <= CHARS:
                memo[word] = ids
        source.append(np.array(ids, np.int32))
        begin[i], size[i] = at, len(ids)
        at += len(ids)
    flat = _gather(begin, size, words.ids, np.concatenate(source) if source else np.zeros(0, np.int32))
    edges = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    # a text of nothing but its leading space has no pieces
    return [flat[a:b] if t else flat[:0] for t, a, b in zip(texts, edges[:-1], edges[1:], strict=True)]


def _with_ids(docs: DataFrame, table: Pieces, words: int, use, schema: str) -> DataFrame:
    """use(batch, ids of its texts, those decoded) for every batch of docs, in the task that encodes it."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    shared, known = context.broadcast(table), context.broadcast(dictionary(docs, table, words))

    def encoded(batches):
        memo: dict = {}
        for batch in batches:
            if len(memo) > 100_000:
                memo.clear()
            ids, back = [], []
            for _, texts in _text_blocks(batch["text"]):
                for text, own in zip(texts, _encoded(texts, shared.value, known.value, memo), strict=True):
                    raw = decoded(own, shared.value)
                    if raw != text.encode("utf-8", "surrogatepass"):  # two words with one hash
                        own = np.array(shared.value.fold(f" {text}"), np.int32)
                        raw = decoded(own, shared.value)
                    ids.append(own)
                    back.append(raw)
            yield use(batch, ids, back)

    return docs.mapInPandas(tidied(encoded), schema)


def encode(docs: DataFrame, path: str | None = None, words: int = WORDS) -> DataFrame:
    """All columns of docs but text, with ids (array of int)."""
    rest = [c for c in docs.columns if c not in ("text", "ids")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)
    use = lambda batch, ids, back: batch[rest].assign(ids=ids)
    return _with_ids(docs.select(*rest, "text"), pieces(path or default_model()), words, use, f"{kinds}{', ' if kinds else ''}ids array<int>")


def decoded(ids: np.ndarray, table: Pieces) -> bytes:
    """The text of ids as UTF-8, without its leading space."""
    ids = np.asarray(ids, np.int64)
    return _gather(table.starts[ids], table.sizes[ids], table.bytes).tobytes()[1:]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of encoded but ids, with text."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(path or default_model()))
    rest = [c for c in encoded.columns if c not in ("text", "ids")]

    def texts(batches):
        for batch in batches:
            yield batch[rest].assign(text=[decoded(x, shared.value).decode("utf-8", "surrogatepass") for x in batch["ids"]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in rest)
    return encoded.select(*rest, "ids").mapInPandas(texts, f"{kinds}{', ' if kinds else ''}text string")


RESULT = "doc_id long, n_pieces long, ids array<int>, decoded_bytes long, decoded_crc32 long, round_trip boolean"


def round_trip(docs: DataFrame, path: str | None = None, also: tuple = ()) -> DataFrame:
    """doc_id, the ids, whether they decode to the text, and the columns `also` of every row of docs (doc_id, text)."""
    table = pieces(path or default_model())
    text = F.coalesce(F.col("text"), F.lit(""))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(text).alias("crc"), F.octet_length(text).alias("n"), *also)
    kinds = "".join(f", `{c}` {t}" for c, t in docs.select(*also).dtypes)

    def checked(batch: pd.DataFrame, ids: list, back: list) -> pd.DataFrame:
        sums, sizes = np.array([zlib.crc32(x) for x in back], np.int64), np.array([len(x) for x in back], np.int64)
        made = pd.DataFrame(
            {
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_pieces": [len(x) for x in ids],
                "ids": ids,
                "decoded_bytes": sizes,
                "decoded_crc32": sums,
                "round_trip": (sums == batch["crc"].to_numpy(np.int64)) & (sizes == batch["n"].to_numpy(np.int64)),
            }
        )
        return made.assign(**{c: batch[c] for c in also})

    return _with_ids(both, table, WORDS, checked, RESULT + kinds)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every text, checked by decoding, with the row's place in the mix."""
    return round_trip(docs, also=tuple(c for c in MIX_COLUMNS if c in docs.columns))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE: dict[str, str] = {}  # see the comparison with the library's own lattice in the tests
