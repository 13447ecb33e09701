"""Tables in the shared folder, which cut lineage and survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: where each materialized table that is still referred to lies
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of our own only on one machine (local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='tributary-')}"
    return _own[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialize() from which everything that follows has been written."""
    for table in tables:
        path = _paths.pop(table, None) if table is not None else None
        if path:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def join_keys(rows: DataFrame, keys: DataFrame, on: str, most: int = 1_024) -> DataFrame:
    """rows joined with keys (written, one row a key, with c rows of rows each): `most` hot keys at most are broadcast, so none meets in one task."""
    limit = max(10_000, rows.count() // most)
    hot, cold = keys.where(F.col("c") > limit).drop("c"), keys.where(F.col("c") <= limit).drop("c")
    if hot.isEmpty():
        return rows.join(cold, on)
    few = F.broadcast(hot)  # at most `most` rows, since each stands for more than one in `most` of all
    return rows.join(few, on).unionByName(rows.join(few.select(on), on, "left_anti").join(cold, on))


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Rows hold whole texts here, so fewer of them go to a Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def _lean() -> None:
    """Arrays of megabytes come from the system and go back at once, instead of piling up in a worker that lives on."""
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-8, 1)  # M_ARENA_MAX
    except (OSError, AttributeError):
        pass  # another C library


def tidied(work):
    """work (a function of batches for mapInPandas), giving memory back to the system when a task ends; workers stay."""

    def task(batches):
        import ctypes
        import gc

        import pyarrow as pa

        _lean()
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text="text"):
    """Tells rows with one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text_key are in kept (doc_id, key)."""
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__id")) & (text_key() == F.col("__key")), "left_semi")


#: words of a bitmap that travel as one row's bytes
CHUNK_WORDS = 1 << 11


def bitmap(keys: DataFrame, hashed: bool = False):
    """A numpy bitmap of the hashes in keys (one long column; hashed: whose values are hashes, known by their lowest bits), 16 bits a row and at most 16 MB.

    Built by partial aggregates and packed in tasks; what reaches the driver is the bitmap's bytes
    in at most 2,048 rows, whatever the input's size.
    """
    import numpy as np

    (name,) = keys.columns
    bits = 1 << min(max((16 * keys.count()).bit_length(), 10), 27)
    bit = F.pmod(F.col(name) if hashed else F.xxhash64(name), F.lit(bits))
    words = keys.select(bit.alias("bit")).groupBy((F.col("bit") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("set"))

    def packed(batches):
        import pyarrow as pa

        table, chunks = np.zeros(bits // 32, np.uint32), set()
        for batch in batches:
            word = batch.column("word").to_numpy()
            table[word] = batch.column("set").to_numpy().astype(np.uint32)
            chunks.update(np.unique(word // CHUNK_WORDS).tolist())
        for chunk in chunks:
            set_ = table[chunk * CHUNK_WORDS : (chunk + 1) * CHUNK_WORDS].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([set_], pa.binary())], ["chunk", "set"])

    out = np.zeros(bits // 32, np.uint32)
    for chunk, set_ in words.repartition(F.expr(f"word div {CHUNK_WORDS}")).mapInArrow(packed, "chunk int, set binary").collect():
        out[chunk * CHUNK_WORDS : (chunk + 1) * CHUNK_WORDS] = np.frombuffer(set_, np.uint32)
    return out


def maybe_in(table, key: str):
    """A column expression's bit in a bitmap made by bitmap(), to be tested by has_bit inside a batch."""
    return F.pmod(F.xxhash64(key), F.lit(len(table) * 32))


def has_bit(table, bit):
    """For an array of bit numbers, whether each is set."""
    return (table[bit // 32] >> (bit % 32).astype(table.dtype)) & 1 == 1
