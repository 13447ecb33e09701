"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the mix by its weight; a target stops at a cap (a multiple of the
source's size) and the excess is shared again by weight, which is the same as one common water
level. Within a source, documents follow the digest of their id, and the mix takes them in
that order, pass after pass, until the source's target is met (the last document in part).

Training time runs from 0 to 1. A source's weight moves linearly from a start to an end value,
so the tokens that it has supplied by time t are target * ((1 - g) t + g t^2) with
g = (end - start) / (end + start). Inverting that integral at a document's first token of each
pass gives that pass's position in training, and the result is range-sorted by position.

Prefix sums come in two steps (ranges of the digest, 4,096 or as many more as keep them at some
RANGE_ROWS rows, then within a range), so no window spans a source, however large; the windows
over ranges have a row for each of them (2^20 at most) and source, the only undivided ones a row
for each source.

Defined results: a null text has size 0; null is a source of its own, the last one; sources of
size 0 have target 0; untaken documents have a null position; repeated rows each count; rows
with one doc_id share a range and stand in the order of their texts' hashes, rows without one are
dealt by those hashes; an empty table gives an empty one; other columns are ignored. The pipeline
stage keeps other columns, but for MIX_COLUMNS, which it sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.store import documents, materialize, text_key

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: rows of a range of digests, while there are no more than 2^20 ranges
RANGE_ROWS = 50_000
#: start and end of each source's weight, as multiples of it, repeating like the weights
SCHEDULE = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
#: what the pipeline stage adds: where in training (0 to 1) a row stands, and which pass of its document it is
MIX_COLUMNS = ("mix_position", "mix_pass")


def _cycle(rank: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, schedule=SCHEDULE) -> DataFrame:
    """sizes: (no_source, src, source_size), a row per source. Adds target and ramp."""
    ramps = [(b - a) / (a + b) for a, b in schedule]
    by_name = Window.orderBy("no_source", "src")
    by_level = Window.orderBy("level", "no_source", "src")
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", _cycle(F.col("rank"), weights))
    levels = ranked.select(
        "*",
        (cap * F.col("source_size")).alias("cap"),
        (cap * F.col("source_size") / F.col("w")).alias("level"),
        (share * total).alias("wanted"),
    )
    filled = levels.select(
        "*",
        F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("weights"),
    ).withColumn("water", (F.col("wanted") - F.col("capped")) / F.col("weights"))
    # once the level is passed, the candidates only fall
    level = F.max(F.when(F.col("water") <= F.col("level"), F.col("water"))).over(Window.partitionBy())
    return filled.select(
        "no_source",
        "src",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(level, F.col("level")) * F.col("w")).alias("target"),
        _cycle(F.col("rank"), ramps).alias("ramp"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, schedule=SCHEDULE, also=()) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, position and positions of every row of docs (doc_id, text, source).

    passes is the number of times the document appears, the last perhaps in part. also: further
    columns, expressions over docs, that stay with their rows. positions: the position of each
    pass, of which position is the first.
    """
    base = materialize(
        docs.select(
            "doc_id",
            *also,
            F.col("source").isNull().alias("no_source"),
            F.coalesce("source", F.lit("")).alias("src"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            text_key().alias("tie"),
        )
    )
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.col("tie").cast("string"))))
    count, digits = base.count(), 3
    while digits < 5 and count > RANGE_ROWS * 16**digits:
        digits += 1
    rows = base.withColumn("span", F.substring(digest, 1, digits))
    spans = rows.groupBy("no_source", "src", "span").agg(F.sum("size").alias("span_size"))
    sources = spans.groupBy("no_source", "src").agg(F.sum("span_size").alias("source_size"))
    before = Window.partitionBy("no_source", "src").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        spans.withColumn("span_start", F.coalesce(F.sum("span_size").over(before), F.lit(0)))
        .drop("span_size")
        .join(source_targets(sources, weights, share, cap, schedule), ["no_source", "src"])
    )
    within = Window.partitionBy("no_source", "src", "span").orderBy(digest, "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    want = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0)
    g = F.col("ramp")
    passes = (F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")

    def position(k) -> Column:
        """Where pass k (from 0) begins; at a start weight of 0 the first token has position 0."""
        y = F.try_divide((F.col("start") + k * F.col("source_size")).cast("double"), F.col("target"))
        return F.coalesce(F.try_divide(2 * y, (1 - g) + F.sqrt(F.greatest(F.lit(0.0), (1 - g) * (1 - g) + 4 * g * y))), F.lit(0.0))

    kept = base.columns[1 : 1 + len(also)]
    return (
        rows.join(plan, ["no_source", "src", "span"])
        .withColumn("start", F.col("span_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("whole", whole)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), want - F.col("whole") * F.col("source_size") - F.col("start"))))
        .withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long"))
        .select(
            "doc_id",
            *kept,
            "size",
            "source_size",
            "target",
            "taken",
            passes.alias("passes"),
            F.when(F.col("taken") > 0, position(F.lit(0))).alias("position"),
            F.when(passes > 0, F.transform(F.sequence(F.lit(0), passes - 1), position)).otherwise(F.array().cast("array<double>")).alias("positions"),
        )
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("positions").orderBy("position", "doc_id")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, with each pass's position in training (MIX_COLUMNS), by which rows are range-sorted.

    Files do not keep an order when they are read again; the columns do. A document that the mix
    takes in part stands there whole; rows with one doc_id, source and text share their passes
    evenly.
    """
    docs = docs.drop(*MIX_COLUMNS)
    plan = mix(docs, also=[text_key().alias("key"), F.col("source").alias("from")])
    # passes of one source differ by one at most, so each row of a group has as many as the most
    plan = plan.select("doc_id", "from", "key", F.posexplode("positions").alias("pass", "position"))
    plan = plan.groupBy("doc_id", "from", "key", "pass").agg(F.min("position").alias("position"))
    row, way = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.struct("doc_id", "from", "key", "pass", "position").alias("way")
    same = F.col("doc.doc_id").eqNullSafe(F.col("way.doc_id")) & F.col("doc.source").eqNullSafe(F.col("way.from")) & (F.col("key") == F.col("way.key"))
    both = docs.select(row, text_key().alias("key")).join(plan.select(way), same)
    kept = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return both.orderBy("way.position", "way.pass", "way.doc_id").select(*kept, F.col("way.position").alias(MIX_COLUMNS[0]), F.col("way.pass").alias(MIX_COLUMNS[1]))


QUERIES = {"op3_mixing": op3_mixing}
ORACLE = {
    "op3_mixing": r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
    s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, [3, 1, 2][1 + (row_number() OVER o - 1) % 3] AS w,
                 [-0.5, 0.5, 0.0][1 + (row_number() OVER o - 1) % 3]::DOUBLE AS g,
                 1.5::DOUBLE * sum(source_size) OVER () AS wanted
          FROM s WINDOW o AS (ORDER BY source IS NULL, source)),
    l AS (SELECT *, (2 * source_size)::DOUBLE / w AS level FROM r),
    f AS (SELECT *, (wanted - coalesce(sum(2 * source_size) OVER (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                    / sum(w) OVER (ORDER BY level, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS water FROM l),
    t AS (SELECT source, source_size, g, least((2 * source_size)::DOUBLE, coalesce(max(CASE WHEN water <= level THEN water END) OVER (), level) * w) AS target FROM f),
    p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.g,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                 CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS whole
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    k AS (SELECT *, greatest(0, least(size, floor(target) - whole * source_size - start)) AS part FROM p)
    SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
           (whole * size + part)::BIGINT AS taken, (whole + CASE WHEN part > 0 THEN 1 ELSE 0 END)::INTEGER AS passes,
           CASE WHEN whole * size + part > 0 THEN 2 * (start / target) / ((1 - g) + sqrt((1 - g) * (1 - g) + 4 * g * (start / target))) END AS position
    FROM k"""
}
