"""Tables written between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none, a temporary one if it is local, else an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if (found := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkstone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str = "settled") -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at, files = _at(spark, path)
    files.deleteOnExit(at)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    The lineage ends there, so neither a lost executor nor a second use makes Spark
    compute df again.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of text, replaced whole."""
    at, files = _at(spark, path)
    out = files.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of one small file, None where there is none."""
    at, files = _at(spark, path)
    if not files.exists(at):
        return None
    source = files.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder, with all it holds, if it is there."""
    at, files = _at(spark, path)
    files.delete(at, True)
