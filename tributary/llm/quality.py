"""Quality by a document classifier and hierarchical empirical Bayes over sites.

Classifier: two logistic models (good quality; toxic) on ten measures of the text and on the
presence of words and of beginnings of words (4 and 5 bytes, since insults inflect), hashed to
2^20 buckets and chosen by their likelihood ratio. Errors on the rarer label weigh more, up to
WEIGHT times.
They are fitted on at most SAMPLE labelled documents, those with the smallest hash of doc_id.

Sites: source is the host, (source, lang) the path under it. The mean classifier probability of
a host is shrunk toward the global mean, that of a path toward its host; the strengths come
from the spread between hosts and between paths (method of moments), so sparse sites follow
their priors. A document's log-odds are the classifier's plus those of its path, less the global
ones. Sums are of whole millionths, so reruns agree. Every statistic covers all documents.

A document is rejected if its combined probability of good quality is under one half, or its
probability of being toxic is over one half.

Defined results: a null text is empty; null sources and languages are sites of their own; with
no usable labels every document has probability one half and is kept; repeated labels of an id
count as one (the worst); repeated rows and null ids keep a row each; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.bytestext import NOT_LETTER, blocks, encode, mix, prefix_hashes, substring_hashes, word_spans
from tributary.llm.store import documents, keep_rows, materialize, small_batches, text_key, tidied

SAMPLE = 20_000
BUCKETS = 1 << 20
MOST_WORDS = 1_000
#: words whose labels are counted together
SLICE = 1 << 20
#: twice the log-likelihood ratio of a word against the base rate
LEAST_GAIN = 8.0
WEIGHT = 4.0
#: bytes of the beginnings of words that count as words of their own
BEGINNINGS = (4, 5)
MEASURES = 10
MILLION = 1_000_000


def _measures(parts: list[bytes], words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Ten measures of each text."""
    out = np.zeros((len(parts), MEASURES))
    for i, part in enumerate(parts):
        data = np.frombuffer(part, np.uint8)
        n = max(len(data), 1)
        count = np.bincount(data, minlength=256)
        upper, lower, digits = count[65:91].sum(), count[97:123].sum() + count[128:].sum(), count[48:58].sum()
        space = count[9:14].sum() + count[32]
        own = words[firsts[i] : firsts[i + 1]]
        lines = part.split(b"\n")
        out[i] = (
            np.log1p(len(own)),
            (upper + lower) / max(len(own), 1),
            upper / max(upper + lower, 1),
            (len(data) - upper - lower - digits - space) / n,
            digits / n,
            len(np.unique(own)) / max(len(own), 1),
            count[124] / n,
            count[33] / n,
            1 - len(set(lines)) / len(lines),
            (own[1:] == own[:-1]).mean() if len(own) > 1 else 0.0,
        )
    return out


def _words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all parts, the same with the beginnings of longer words, and the first word of each part."""
    data, starts, ends, firsts = word_spans(parts, NOT_LETTER)
    prefix = prefix_hashes(data)
    words = substring_hashes(prefix, starts, ends)
    rows = [words, *(mix(substring_hashes(prefix, starts, np.minimum(starts + n, ends)) + np.uint64(n)) for n in BEGINNINGS)]
    return words, np.stack(rows), firsts


def _present(signs: np.ndarray, firsts: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every bucket present in a text, if chosen."""
    bucket = (signs & np.uint64(BUCKETS - 1)).astype(np.int64)
    text = np.broadcast_to(np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)), bucket.shape)
    if chosen is not None:
        some = chosen[bucket]
        bucket, text = bucket[some], text[some]
    return np.divmod(np.unique(text * BUCKETS + bucket), BUCKETS)


def _featured(batches):
    for batch in batches:
        parts = encode(batch["text"])
        for a, b in blocks(parts):
            words, signs, firsts = _words(parts[a:b])
            text, bucket = _present(signs, firsts)
            own = np.split(bucket, np.searchsorted(text, np.arange(1, b - a)))
            yield pd.DataFrame(
                {
                    "quality": batch["quality"].iloc[a:b],
                    "toxic": batch["toxic"].iloc[a:b],
                    "measures": [x.tobytes() for x in _measures(parts[a:b], words, firsts)],
                    "buckets": [x.astype("<i4").tobytes() for x in own],
                }
            )


def _logistic(x: np.ndarray, text: np.ndarray, column: np.ndarray, y: np.ndarray, columns: int) -> np.ndarray:
    """Coefficients of the measures, the chosen words and a constant, by Adam on the whole sample."""
    n, width = len(y), x.shape[1] + columns + 1
    w, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    rare = y == (rate < 0.5)
    weight = np.where(rare, min(WEIGHT, max(rate, 1 - rate) / min(rate, 1 - rate)), 1.0)
    weight /= weight.mean()
    rate = (weight * y).mean()
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(width, 2e-4)
    penalty[-1] = 0
    for step in range(1, 151):
        z = x @ w[: x.shape[1]] + np.bincount(text, w[x.shape[1] + column], n) + w[-1]
        residual = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.concatenate([x.T @ residual, np.bincount(column, residual[text], columns), [residual.sum()]]) / n + penalty * w
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= 0.1 * (1 - step / 180) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def _fit(sample: pd.DataFrame) -> dict:
    """Both models, from a bounded sample of labelled texts."""
    x = np.frombuffer(b"".join(sample["measures"]), np.float64).reshape(-1, MEASURES)
    middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    buckets = [np.frombuffer(b, "<i4") for b in sample["buckets"]]
    text = np.repeat(np.arange(len(buckets), dtype=np.int32), [len(b) for b in buckets])
    bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
    del buckets
    model = {"middle": middle, "scale": scale}
    for name in ("quality", "toxic"):
        y = sample[name].to_numpy(float)
        ones, zeros = y.sum(), (1 - y).sum()
        if not ones or not zeros:
            model[name] = (np.zeros(0, np.int64), np.concatenate([np.zeros(MEASURES), [4.0 * (1 if ones else -1)]]))
            continue
        there, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for i in range(0, len(bucket), SLICE):  # whole numbers, so slices change no sum
            mine = y[text[i : i + SLICE]]
            there += np.bincount(bucket[i : i + SLICE], mine, BUCKETS)
            other += np.bincount(bucket[i : i + SLICE], 1 - mine, BUCKETS)
        n, rate = np.maximum(there + other, 1), ones / (ones + zeros)
        gain = 2 * (there * np.log(np.maximum(there, 1e-9) / (n * rate)) + other * np.log(np.maximum(other, 1e-9) / (n * (1 - rate))))
        chosen = np.argsort(-gain, kind="stable")[:MOST_WORDS]
        chosen = np.sort(chosen[gain[chosen] > LEAST_GAIN])
        place = np.full(BUCKETS, -1, np.int16)
        place[chosen] = np.arange(len(chosen))
        some = np.flatnonzero(place[bucket] >= 0)
        w = _logistic((x - middle) / scale, text[some].astype(np.int64), place[bucket[some]].astype(np.int64), y, len(chosen))
        model[name] = (chosen, w)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Both models; None without labelled documents."""
    named = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    few = F.broadcast(named)  # at most `sample` rows of three numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id").select("text", "quality", "toxic")
    columns = "quality double, toxic double, measures binary, buckets binary"
    featured = texts.mapInPandas(tidied(_featured), columns).orderBy(F.xxhash64("buckets", "measures")).limit(sample)

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        model = _fit(rows)
        return pd.DataFrame(
            [("scale", model["middle"].tolist(), model["scale"].tolist())]
            + [(name, model[name][0].astype(float).tolist(), model[name][1].tolist()) for name in ("quality", "toxic")],
            columns=["name", "a", "b"],
        )

    # one group, of a bounded sample; the models are a few thousand numbers
    rows = featured.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda rows: fitted(rows), "name string, a array<double>, b array<double>").collect()
    found = {r["name"]: (np.array(r["a"]), np.array(r["b"])) for r in rows}
    if not found:
        return None
    return {"middle": found["scale"][0], "scale": found["scale"][1]} | {k: (found[k][0].astype(np.int64), found[k][1]) for k in ("quality", "toxic")}


def classify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, source, lang, key, good and toxic (probabilities in millionths) of every row of docs."""

    def scored(batches):
        table = {}
        if model:
            for name in ("quality", "toxic"):
                chosen, w = model[name]
                table[name] = np.zeros(BUCKETS)
                table[name][chosen] = w[MEASURES:-1]
            used = (table["quality"] != 0) | (table["toxic"] != 0)
        for batch in batches:
            parts = encode(batch["text"])
            for a, b in blocks(parts):
                out = batch.iloc[a:b][["doc_id", "source", "lang", "key"]].copy()
                out["doc_id"] = out["doc_id"].astype("Int64")
                if model:
                    words, signs, firsts = _words(parts[a:b])
                    x = (_measures(parts[a:b], words, firsts) - model["middle"]) / model["scale"]
                    text, bucket = _present(signs, firsts, used)
                for name, column in (("quality", "good"), ("toxic", "toxic")):
                    p = np.full(b - a, 0.5 if name == "quality" else 0.0)
                    if model:
                        w = model[name][1]
                        z = (x * w[:MEASURES]).sum(axis=1) + np.bincount(text, table[name][bucket], b - a) + w[-1]
                        p = 1 / (1 + np.exp(-np.clip(z, -12, 12)))
                    out[column] = np.rint(p * MILLION).astype(np.int64)
                yield out

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), text_key().alias("key"), "text")
    return wanted.mapInPandas(tidied(scored), "doc_id long, source string, lang string, key long, good long, toxic long")


def _strength(sites: DataFrame, prior) -> float:
    """How many documents a site's prior is worth: from the spread of site means around it."""
    n, mean, prior = F.col("n"), F.col("good") / F.col("n") / MILLION, prior.alias("prior")
    row = (
        sites.where("n > 1")
        .select(n.alias("n"), mean.alias("m"), prior)
        .agg(F.sum("n"), F.sum(F.col("n") * (F.col("m") - F.col("prior")) ** 2), F.sum(F.col("m") * (1 - F.col("m"))), F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))))
        .first()
    )
    if not row[0] or not row[3]:
        return 10.0
    noise, within = (row[2] or 0.0) / row[0], row[3] / row[0]
    between = max(row[1] / row[0] - noise, within / 10_000)
    return float(f"{min(max(within / between - 1, 1.0), 10_000.0):.4g}")


def posteriors(scored: DataFrame) -> DataFrame:
    """scored (as of classify) with host_posterior, path_posterior and the global mean."""
    named = scored.select("*", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("host"), F.struct(F.col("lang").isNull(), F.coalesce("lang", F.lit(""))).alias("under"))
    paths = named.groupBy("host", "under").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    paths = materialize(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = (total[1] or 0) / MILLION / max(total[0] or 0, 1)
    overall = float(min(max(overall, 1e-6), 1 - 1e-6))
    strength = _strength(hosts, F.lit(overall))
    hosts = hosts.select("host", ((F.col("good") / MILLION + strength * overall) / (F.col("n") + strength)).alias("host_posterior"))
    under = paths.join(hosts, "host")
    strength = _strength(under, F.col("host_posterior"))
    path = (F.col("good") / MILLION + strength * F.col("host_posterior")) / (F.col("n") + strength)
    under = under.select("host", "under", "host_posterior", path.alias("path_posterior"))
    return named.join(under, ["host", "under"]).drop("host", "under").withColumn("overall", F.lit(overall))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, key, classifier and combined scores and kept, of every row of docs (doc_id, text, source, lang)."""
    small_batches(docs.sparkSession)
    scored = materialize(classify(docs, fit(docs, labels, sample)))
    odds = lambda p: F.log(p / (1 - p))
    inside = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    good = inside(F.col("good") / MILLION)
    combined = odds(good) + odds(inside(F.col("path_posterior"))) - odds(F.col("overall"))
    return (
        posteriors(scored)
        .withColumn("score", F.round(1 / (1 + F.exp(-combined)), 6))
        .select(
            "doc_id",
            "key",
            (F.col("good") / MILLION).alias("classifier_score"),
            (F.col("toxic") / MILLION).alias("toxic_score"),
            F.round("host_posterior", 6).alias("host_posterior"),
            F.round("path_posterior", 6).alias("path_posterior"),
            "score",
            ((F.col("score") >= 0.5) & (F.col("toxic") <= MILLION // 2)).alias("kept"),
        )
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("key")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    judged = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_rows(docs, judged.where("kept"))


QUERIES = {"op10_quality": op10_quality}
ORACLE: dict[str, str] = {}  # a fitted model has no SQL; see the held-out accuracy tests
