"""A static side of a stream that is read again when it is older than a lifetime, and validation by rules that such a side holds.

The side is copied when it is read, and every micro-batch is booked to the copy that it used: a
batch that is run again, after a crash or on another machine, sees the same rules as before, even
if they have changed or their lifetime has passed since. Bookings are names of empty files, made
before the batch writes anything.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.scores import realtime_score
from tributary.session import file_system

LIFETIME = 300.0  # seconds
RULE = "struct<rule_id:string,field:string,kind:string,low:double,high:double,pattern:string,allowed:array<string>,severity:string>"


def bookings(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(batch, copy, milliseconds at which the copy was read) of all batches so far, in order."""
    place, fs = file_system(spark, f"{path}/_batches")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(tuple(map(int, n.split("-"))) for n in names)


def side_of_batch(spark: SparkSession, load: Callable[[float], DataFrame], path: str, batch: int, now: float, lifetime: float = LIFETIME) -> DataFrame:
    """The copy of load(now) that belongs to a batch: the one that it is booked to, else the last one if that is young enough, else a new one."""
    booked = bookings(spark, path)
    mine = next((b for b in booked if b[0] == batch), None)
    if mine is None:
        last = booked[-1] if booked else None
        if last is not None and now * 1000 - last[2] < lifetime * 1000:
            mine = (batch, last[1], last[2])
        else:
            mine = (batch, last[1] + 1 if last else 1, int(now * 1000))
            load(now).write.mode("overwrite").parquet(f"{path}/copy-{mine[1]}")  # a copy without a booking is of a batch that never began
        place, fs = file_system(spark, f"{path}/_batches/{mine[0]:012d}-{mine[1]:012d}-{mine[2]:015d}")
        fs.createNewFile(place)
    return spark.read.parquet(f"{path}/copy-{mine[1]}")


def forget(spark: SparkSession, path: str, before: int) -> None:
    """Remove bookings of batches before a number, which will not run again, and copies that no booking names."""
    booked = bookings(spark, path)
    kept = {c for b, c, _ in booked if b >= before} | {booked[-1][1]} if booked else set()
    for b, c, ms in booked[:-1]:
        if b < before:
            place, fs = file_system(spark, f"{path}/_batches/{b:012d}-{c:012d}-{ms:015d}")
            fs.delete(place, False)
    for c in {c for _, c, _ in booked} - kept:
        place, fs = file_system(spark, f"{path}/copy-{c}")
        fs.delete(place, True)


def checked(rows: DataFrame, rules: DataFrame, source: str) -> DataFrame:
    """rows with issues (rule_id, field, severity), score and valid, by the rules of their source.

    rules: (source, rule_id, field, kind, low, high, pattern, allowed, severity). Kinds: required,
    range, pattern, allowed; a null value breaks only required, a value that is no number breaks
    range. A source's rules travel as one array, so a row meets its rules once and is never
    multiplied; a source without rules has no issues.
    """
    names = RULE[len("struct<") : -1].split(",")
    fields = [n.split(":")[0] for n in names]
    of = rules.groupBy(F.col(source).alias("__source")).agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(f"array<{RULE}>").alias("__rules"))
    values = F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    both = rows.withColumn("__values", values).join(of, F.col(source).eqNullSafe(F.col("__source")), "left")

    def broken(r):
        v = F.try_element_at("__values", r.field)
        number = v.try_cast("double")
        out = F.coalesce(number < r.low, F.lit(False)) | F.coalesce(number > r.high, F.lit(False)) | number.isNull()
        test = F.when(r.kind == "required", v.isNull() | (F.trim(v) == "")).when(v.isNull(), False).when(r.kind == "range", out)
        return F.coalesce(test.when(r.kind == "pattern", ~F.rlike(v, r.pattern)).when(r.kind == "allowed", ~F.array_contains(r.allowed, v)), F.lit(False))

    issues = F.transform(F.filter(F.coalesce("__rules", F.array().cast(f"array<{RULE}>")), broken), lambda r: F.struct(r.rule_id.alias("rule_id"), r.field.alias("field"), r.severity.alias("severity")))
    bad = lambda *kinds: F.size(F.filter("issues", lambda x: x.severity.isin(*kinds)))
    out = both.withColumn("issues", issues).withColumn("score", realtime_score(bad("error", "critical"), bad("warning"))).withColumn("valid", bad("error", "critical") == 0)
    return out.select(*rows.columns, "issues", "score", "valid")


def validate(stream: DataFrame, load: Callable[[float], DataFrame], source: str, out: str, checkpoint: str, lifetime: float = LIFETIME, clock: Callable[[DataFrame], float] | None = None):
    """Start a query that checks every batch by its copy of the rules and writes it to out/data/batch=<n>, overwriting what a broken run left.

    clock(batch) tells the time in seconds, the machine's if it is not given.
    """

    def batch(rows: DataFrame, number: int) -> None:
        now = clock(rows) if clock else time.time()
        rules = side_of_batch(rows.sparkSession, load, f"{out}/rules", number, now, lifetime)
        checked(rows, rules, source).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
