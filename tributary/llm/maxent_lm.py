"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are the lower-cased words of a text and one end. A token's probability is that of its
class given the history, times that of the token in its class given the history. There are 256
classes of 16 members. The KNOWN most frequent tokens are members by themselves, 15 to a class
in order of frequency; the sixteenth member of a class stands for all other words whose last two
bytes fall to it, so a word's class needs no table. Among those, a word's share goes by counts
plus one, with one more for unknown words. The class factor is itself two factors of 16 (the
class's half bytes), so every softmax is 16 wide and all three are trained.

Each factor is a maximum-entropy model over five features: a constant, the word before, the two
words before, and two skip features (the second and the third word back), all but the constant
hashed with what the earlier factors gave into a table of weights, 16 a row. Other words count
by their class there. The table has a row for about eight different words of the training texts
(2^14 rows at least, 2^18 at most, 16 MB). Weights start at the tokens' own frequencies. Every
task then follows its documents' gradients (Adagrad, an update every STEP tokens) from the same
start, and each row's weights are averaged over the tasks that saw it, by how often they did.

1. Count all tokens of all training documents; counts are a table.
2. Train on all training documents, dealt by a hash of their texts to tasks of about
   TASK_TOKENS tokens and taken in its order, so the model does not depend on how the input
   happens to be partitioned. Tasks hand on blocks of rows, so updates stay small beside texts.
3. Score all documents in sparse batches. The most frequent words (WORDS at most) go to the
   tasks with their counts; documents' other words are joined to the table of counts.

Defined results: a null or empty text is one end; a null doc_id takes part in training; ties in
frequency go by hash; without training documents every token is unknown; repeated rows count
and keep a row each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.bytestext import U, blocks, encode, mix, prefix_hashes, substring_hashes, word_spans
from tributary.llm.store import documents, materialize, small_batches, tidied

FOLDS, HELD = 7, 2
WORDS = 1 << 18
WIDE = 16
CLASSES = WIDE * WIDE
OTHER = WIDE - 1
#: tokens that are members of a class by themselves, and count by themselves in a history
KNOWN = CLASSES * OTHER
LEAST_FEATURES, MOST_FEATURES = 1 << 14, 1 << 18
#: rows of weights that a task hands on together
ROWS = 2_048
#: rows of the constant: of the first factor, of the second by the first, of the third by the class
CONSTANTS = 1 + WIDE + CLASSES
TASK_TOKENS = 2_000_000
STEP = 2_048
RATE, CALM = 0.15, 24.0
ONES = np.ones(WIDE, np.float32)
END = U(0x5851F42D4C957F2D)
PAD = KNOWN + CLASSES
SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], U)


def _tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix class of every token of all parts, an end behind each part; the number of tokens of each part."""
    data, starts, ends, firsts = word_spans(parts)
    words = substring_hashes(prefix_hashes(data), starts, ends)
    last, before = data[ends - 1].astype(U), np.where(ends - starts > 1, data[ends - 2], 0).astype(U)
    suffix = (mix(last << U(8) | before) % U(CLASSES)).astype(np.int16)
    at = firsts[1:]
    return np.insert(words, at, END), np.insert(suffix, at, 0), np.diff(firsts) + 1


def _merged(held: list) -> list:
    hashes, counts, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
    found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    return [(found, np.bincount(back, counts).astype(np.int64), suffix[first])]


def _counted(batches):
    held, size = [], 0
    for batch in batches:
        parts = encode(batch["text"])
        for a, b in blocks(parts):
            hashes, suffix, _ = _tokens(parts[a:b])
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            held.append((found, n, suffix[first]))
            size += len(found)
        if size > 2_000_000:
            held = _merged(held)
            size = len(held[0][0])
            if size > 1_000_000:
                yield pd.DataFrame({"word": held[0][0].view(np.int64), "n": held[0][1], "cls": held[0][2]})
                held, size = [], 0
    if held:
        ((hashes, n, suffix),) = _merged(held)
        yield pd.DataFrame({"word": hashes.view(np.int64), "n": n, "cls": suffix})


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, n, cls) of every token of docs (text): hash, count and suffix class."""
    counted = docs.select("text").mapInPandas(tidied(_counted), "word long, n long, cls smallint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.min("cls").alias("cls"))


class Lexicon:
    """Sorted hashes with an index by their leading bits."""

    def __init__(self, hashes: np.ndarray, *columns: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.columns = np.append(hashes[order], ~U(0)), [c[order] for c in columns]
        self.shift = U(64 - max(len(hashes).bit_length() + 1, 8))
        self.starts = np.searchsorted(hashes[order], np.arange(1 << (64 - int(self.shift)), dtype=U) << self.shift)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes; -1 where there is none."""
        at = self.starts[(hashes >> self.shift).astype(np.int64)]
        while (behind := np.flatnonzero(self.hashes[at] < hashes)).size:
            at[behind] += 1
        return np.where((self.hashes[at] == hashes) & (at < len(self.hashes) - 1), at, -1)


class Counts:
    """What all tasks know: the frequent words, the masses of the classes and the totals."""

    def __init__(self, counts: DataFrame, words: int):
        by_class = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
        self.tokens, self.types = int(by_class["n"].sum()), int(by_class["v"].sum())
        # one row for each different count, of which there are few
        by_count = counts.groupBy("n").agg(F.count("*").alias("c"))
        totals = by_count.withColumn("total", F.expr("sum(c) over (order by n desc)"))
        least = totals.where(F.col("total") <= words).agg(F.min("n")).first()[0]
        top = counts.where(F.col("n") >= (least if least is not None else 1 << 62)).toPandas()
        top = top.assign(word=top["word"].to_numpy(np.int64).view(U)).sort_values(["n", "word"], ascending=[False, True], kind="stable")
        near = top.head(KNOWN)
        rank = np.arange(len(near))
        # members of every class: their counts plus one; of the last one also one for unknown words
        mass = np.zeros((CLASSES, WIDE))
        for c, n, v in by_class.itertuples(index=False):
            mass[c, OTHER] += n + v
        np.subtract.at(mass[:, OTHER], near["cls"].to_numpy(np.int64), near["n"].to_numpy(float) + 1)
        mass[:, OTHER] += 1
        mass[rank // OTHER, rank % OTHER] = near["n"] + 1
        self.mass = mass
        self.features = min(max(1 << max(self.types.bit_length() - 3, 0), LEAST_FEATURES), MOST_FEATURES)
        self.lexicon = Lexicon(top["word"].to_numpy(U), top["n"].to_numpy(np.int64))
        self.near = Lexicon(near["word"].to_numpy(U), rank)

    def symbols(self, hashes: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """What each token counts as: its rank if known, KNOWN and its class if not."""
        if not len(self.near.columns[0]):
            return KNOWN + suffix.astype(np.int64)
        at = self.near.find(hashes)
        return np.where(at >= 0, self.near.columns[0][at], KNOWN + suffix)


def members(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and member of each token."""
    known = symbols < KNOWN
    return np.where(known, symbols // OTHER, symbols - KNOWN), np.where(known, symbols % OTHER, OTHER)


def feature_rows(symbols: np.ndarray, sizes: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights of every token's five features in each of the three factors, and what the factors are to give; histories end at their text's start."""
    n, ends = len(symbols), np.cumsum(sizes)
    place = np.arange(n) - np.repeat(ends - sizes, sizes)
    a, b, c = (np.where(place >= k, np.concatenate([np.full(min(k, n), PAD, np.int64), symbols[: max(n - k, 0)]]), PAD).astype(U) for k in (1, 2, 3))
    cls, member = members(symbols)
    first, second = np.divmod(cls, WIDE)
    rows = np.empty((3, 5, n), np.int32)
    keys = [mix(key + SALTS[i]) for i, key in enumerate((a, a << U(20) | b, b, c))]
    for level, given in enumerate((np.zeros(n, np.int64), 1 + first, 1 + WIDE + cls)):
        rows[level, 0] = features + given
        salt = given.astype(U) * SALTS[0]
        for i, key in enumerate(keys):
            x = (key ^ salt) * SALTS[1]
            rows[level, i + 1] = (x >> U(40)).astype(np.int32) & np.int32(features - 1)
    return rows, np.stack([first, second, member])


def start(mass: np.ndarray, features: int) -> np.ndarray:
    """Weights that give the tokens' own frequencies."""
    weights = np.zeros((features + CONSTANTS, WIDE), np.float32)
    classes = mass.sum(axis=1).reshape(WIDE, WIDE)
    given = np.concatenate([classes.sum(axis=1)[None], classes, mass])
    weights[features:] = np.log(np.maximum(given, 1e-3) / np.maximum(given.sum(axis=1, keepdims=True), 1e-3))
    return weights


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(factors, tokens, WIDE) sums of weights, small enough for exp."""
    z = weights.take(rows[:, 0], axis=0)
    for f in range(1, rows.shape[1]):
        z += weights.take(rows[:, f], axis=0)
    return np.minimum(z, 80, out=z)


def log_probability(weights: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each token's class and member."""
    out = np.empty(rows.shape[2])
    for i in range(0, len(out), STEP):
        z, want = _logits(weights, rows[:, :, i : i + STEP]), wanted[:, i : i + STEP]
        own = z.ravel().take(np.arange(want.size) * WIDE + want.ravel()).reshape(want.shape)
        out[i : i + STEP] = (own - np.log(np.exp(z, out=z) @ ONES)).sum(axis=0)
    return out


def _summed(vectors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of rows (factors, features, tokens), the sum of their vectors (one a factor and token), and how many there were.

    Vectors lie sorted by row; in each row the second is added to the first, the fourth to the
    third, then the third to the first, and so on, so sums depend on nothing but the order.
    """
    levels, features, n = rows.shape
    own = np.repeat(np.arange(levels * n).reshape(levels, 1, n), features, axis=1)
    key = np.sort((rows.astype(np.int64) << 32 | own).ravel())
    row = key >> 32
    sums = vectors.reshape(-1, WIDE).take(key & 0xFFFFFFFF, axis=0)
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    count = np.diff(np.append(head, len(row)))
    left = (np.repeat(head + count, count) - np.arange(len(row))).astype(np.int32)  # of the row, from each place on
    rank = np.repeat(count, count).astype(np.int32) - left
    at, step = np.arange(len(row)), 1
    while len(at := at[(rank.take(at) & (2 * step - 1) == 0) & (left.take(at) > step)]):
        _put(sums, at, sums.take(at, axis=0) + sums.take(at + step, axis=0))
        step *= 2
    return row.take(head), sums.take(head, axis=0), count


def _put(table: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """table[at] = values for whole rows, each moved as one item."""
    item = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(item).ravel()[at] = values.view(item).ravel()


def follow(weights: np.ndarray, heat: np.ndarray, seen: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> None:
    """One pass of gradient updates, in place. heat: of each row, the squared gradients so far."""
    for i in range(0, rows.shape[2], STEP):
        part = rows[:, :, i : i + STEP]
        p = _logits(weights, part)
        np.exp(p, out=p)
        p *= (1 / (p @ ONES))[:, :, None]
        want = wanted[:, i : i + STEP].ravel()
        p.ravel()[np.arange(len(want)) * WIDE + want] -= 1
        used, grad, count = _summed(p, part)
        hot = heat.take(used) + (grad * grad) @ ONES / WIDE
        heat[used] = hot
        grad *= (RATE / np.sqrt(hot + CALM / WIDE))[:, None]
        _put(weights, used, weights.take(used, axis=0) - grad)
        seen[used] += count


def _updated(batches, counts: Counts):
    size = counts.features + CONSTANTS
    weights, heat, seen = start(counts.mass, counts.features), np.zeros(size, np.float32), np.zeros(size, np.int64)
    heat[counts.features :] = STEP  # constants start where they should be
    for batch in batches:
        parts = encode(batch["text"])
        for a, b in blocks(parts):
            hashes, suffix, sizes = _tokens(parts[a:b])
            follow(weights, heat, seen, *feature_rows(counts.symbols(hashes, suffix), sizes, counts.features))
    if seen.any():
        at = range(0, size, ROWS)
        yield pd.DataFrame({"block": range(len(at)), "n": [seen[i : i + ROWS].astype(np.int32).tobytes() for i in at], "w": [weights[i : i + ROWS].astype(np.float16).tobytes() for i in at]})


def _averaged(batches):
    sums: dict[int, np.ndarray] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, n, w in zip(batch["block"], batch["n"], batch["w"], strict=True):
            n = np.frombuffer(n, np.int32).astype(float)
            w = np.frombuffer(w, np.float16).reshape(-1, WIDE) * n[:, None]
            sums[block], total[block] = (sums[block] + w, total[block] + n) if block in sums else (w, n)
    if sums:
        mean = {b: np.where(total[b][:, None] > 0, sums[b] / np.maximum(total[b], 1)[:, None], np.nan) for b in sums}
        yield pd.DataFrame({"block": list(mean), "w": [x.astype(np.float32).tobytes() for x in mean.values()]})


def train(docs: DataFrame, counts: Counts) -> np.ndarray:
    """The weights, from gradient updates of tasks of about TASK_TOKENS tokens over all of docs (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    tasks = max(1, -(-counts.tokens // TASK_TOKENS))
    # a task for so many tokens, even where a session deals keys to more partitions: each task hands on a table of weights
    dealt = docs.select("text", F.xxhash64("text").alias("h")).repartition(tasks, "h").coalesce(tasks).sortWithinPartitions("h", "text").select("text")
    updates = dealt.mapInPandas(tidied(lambda batches: _updated(batches, shared.value)), "block int, n binary, w binary")
    found = updates.repartition("block").mapInPandas(tidied(_averaged), "block int, w binary").toPandas()  # the table of weights, 16 MB at most
    weights = start(counts.mass, counts.features)
    for block, w in zip(found["block"], found["w"], strict=True):
        w = np.frombuffer(w, np.float32).reshape(-1, WIDE)
        here = weights[block * ROWS : (block + 1) * ROWS]
        here[:] = np.where(np.isnan(w), here, w)
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rest array<struct<word:long,k:long>>"


def _scored(batches, counts: Counts, weights: np.ndarray):
    per_token = np.log10(counts.tokens + counts.types + 1)
    others = np.log10(np.maximum(counts.mass[:, OTHER], 1))
    for batch in batches:
        parts = encode(batch["text"])
        for a, b in blocks(parts):
            hashes, suffix, sizes = _tokens(parts[a:b])
            symbols = counts.symbols(hashes, suffix)
            model = log_probability(weights, *feature_rows(symbols, sizes, counts.features)) / np.log(10)
            cls, member = members(symbols)
            at = counts.lexicon.find(hashes)
            own = counts.lexicon.columns[0][at] if len(counts.lexicon.columns[0]) else np.zeros(len(at), np.int64)
            known = at >= 0
            share = np.where(known, np.log10(np.where(known, own, 0) + 1), 0)
            model += np.where(member == OTHER, share - others[cls], 0)
            begins = np.cumsum(sizes) - sizes
            rest: list = [[] for _ in sizes]
            missing = np.flatnonzero(~known)
            if len(missing):
                text = np.searchsorted(begins, missing, side="right") - 1
                order = np.lexsort((hashes[missing], text))
                word, text = hashes[missing][order], text[order]
                first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])]))
                n = np.diff(np.append(first, len(word)))
                for t, w, k in zip(text[first].tolist(), word[first].view(np.int64).tolist(), n.tolist(), strict=True):
                    rest[t].append({"word": w, "k": k})
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].iloc[a:b].astype("Int64"),
                    "held_out": batch["held_out"].iloc[a:b],
                    "n_tokens": sizes,
                    "n_known": np.add.reduceat(known.astype(np.int64), begins),
                    "base": np.add.reduceat(share, begins) - sizes * per_token,
                    "model": np.add.reduceat(model, begins),
                    "rest": rest,
                }
            )


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD


def scores(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    training = rows.where(~F.col("held_out"))
    table = materialize(token_counts(training))
    counts = Counts(table, words)
    weights = train(training, counts)
    known, learned = context.broadcast(counts), context.broadcast(weights)
    scored = rows.mapInPandas(tidied(lambda batches: _scored(batches, known.value, learned.value)), SCORED)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    rest = scored.where(F.size("rest") > 0).select("row", F.inline("rest"))
    found = rest.join(table.select("word", "n"), "word")
    more = found.groupBy("row").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"))
    plus = F.coalesce("more", F.lit(0.0))
    return (
        scored.drop("rest")
        .join(more, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(counts.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + plus).alias("base_score"),
            (F.col("model") + plus).alias("score"),
        )
    )


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))


QUERIES = {"op5_maxent_lm": op5_maxent_lm}
ORACLE: dict[str, str] = {}  # a trained model has no SQL; see the brute-force tests
