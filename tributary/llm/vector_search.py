"""Nearest neighbours by largest inner product, over randomly rotated one-bit codes.

Index: a vector less the centroid is scaled to length 1 and rotated by a fixed random rotation;
the signs of its components are its code, packed eight to a byte. Two correction scalars are
kept: the length before scaling and the alignment of the code with the vector. The centroid is
fitted on at most SAMPLE vectors (those with the smallest hash of vec_id); every vector is
indexed.

Search: an inner product is estimated from the code as length * <code, q> / alignment + <c, q>,
with an error bound from the alignment. A vector is reranked if its upper bound reaches the
k-th largest lower bound of its block; reranking takes the original vectors in double
precision, components in order. Queries and vectors meet in blocks of bounded size, each block
passes on its best k for each query, and a window over those few rows ranks them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part; only vectors of the query's length are its candidates; a repeated vec_id is searched
once (its smallest vector) and each of its rows is a candidate of other ids; null ids take no
part; ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.store import materialize

SAMPLE = 10_000
VECTOR_BLOCK, QUERY_BLOCK = 8_192, 2_048
#: width of the error bound in standard deviations of the estimate
EPSILON = 3.0


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) and dim of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
        .withColumn("dim", F.size("v"))
    )


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def centroids(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the sample, by vector length."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    means = sample.select("dim", F.posexplode("v").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("x"))
    rows = means.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).collect()
    return {r["dim"]: np.array([x["x"] for x in r["c"]]) for r in rows}


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 1))


def index(vectors: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """vectors (as of usable) with code, length and alignment; and the centroids by vector length."""
    middle = centroids(vectors)

    def coded(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                rest = _matrix(part["v"]) - middle.get(dim, 0.0)
                length = np.sqrt((rest * rest).sum(axis=1))
                turned = rest @ rotation(dim) / np.maximum(length, 1e-300)[:, None]
                bits = turned >= 0
                align = np.abs(turned).sum(axis=1) / np.sqrt(dim)
                codes = [x.tobytes() for x in np.packbits(bits, axis=1)]
                yield part.assign(code=codes, length=length, align=np.where(align > 0, align, 1.0))[["vec_id", "v", "dim", "code", "length", "align"]]

    coded_rows = vectors.mapInPandas(coded, "vec_id long, v array<double>, dim int, code binary, length double, align double")
    return coded_rows, middle


def _best(dim: int, rows: pd.DataFrame, middle: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a block of vectors for each of a block of queries."""
    asked, have = rows[rows["asked"]], rows[~rows["asked"]].sort_values("vec_id", kind="stable")
    if not len(asked) or not len(have):
        return pd.DataFrame(columns=["query_id", "vec_id", "score"])
    ids = have["vec_id"].to_numpy()
    originals = np.ascontiguousarray(_matrix(have["v"]).T)
    bits = np.unpackbits(np.frombuffer(b"".join(have["code"]), np.uint8).reshape(len(have), -1), axis=1)[:, :dim]
    signs = (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    length, align = have["length"].to_numpy(), have["align"].to_numpy()
    spread = length * np.sqrt(np.maximum(1 - align * align, 0)) / align * EPSILON / np.sqrt(max(dim - 1, 1)) + 1e-5 * length
    turn, out = rotation(dim), []
    names, vectors = asked["vec_id"].to_numpy(), _matrix(asked["v"])
    for begin in range(0, len(asked), 256):
        q = vectors[begin : begin + 256]
        norms = np.sqrt((q * q).sum(axis=1))
        estimates = (signs @ (q @ turn).T.astype(np.float32)).T * (length / align) + (q @ middle)[:, None]
        errors = norms[:, None] * spread
        lower = estimates - errors
        kth = np.partition(lower, -min(k + 1, lower.shape[1]), axis=1)[:, -min(k + 1, lower.shape[1])]  # one more: the query itself
        for i, chosen in enumerate(estimates + errors >= kth[:, None]):
            near = np.flatnonzero(chosen & (ids != names[begin + i]))
            score = np.zeros(len(near))
            for row, x in zip(originals, q[i], strict=True):
                score += row[near] * x
            top = np.lexsort((ids[near], -score))[:k]
            out.append(pd.DataFrame({"query_id": names[begin + i], "vec_id": ids[near[top]], "score": score[top]}))
    return pd.concat(out)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest vectors; both as of usable."""
    coded, middle = index(vectors)
    coded = materialize(coded)
    queries = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    blocks = max(1, -(-coded.count() // VECTOR_BLOCK))
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    have = coded.select("*", F.lit(False).alias("asked"), spot(blocks).alias("block"), every(parts).alias("part"))
    want = queries.select("*", F.lit(True).alias("asked"), spot(parts).alias("part"), every(blocks).alias("block"))
    met = (
        have.unionByName(want, allowMissingColumns=True)
        .groupBy("dim", "block", "part")
        .applyInPandas(lambda key, rows: _best(int(key[0]), rows, middle.get(int(key[0]), np.zeros(int(key[0]))), k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


QUERIES = {"op7_vector_search": op7_vector_search}
ORACLE = {
    "op7_vector_search": """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
          FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
