"""Session helpers shared by the library, its tests and its benchmark."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tributary")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRIBUTARY_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on one machine (local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="tributary-")


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint: in the folder of spark.checkpoint.dir; only where that is unset, in one of our own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new folder's path beside the checkpoints, which all executors share."""
    return f"{spark.sparkContext.getCheckpointDir() or shared(spark)}/t-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """A path as Hadoop's object, and the file system that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    """A small file of the driver's, by any path that Spark can write."""
    place, system = file_system(spark, path)
    out = system.create(place, overwrite)
    out.write(bytearray(data))
    out.close()
