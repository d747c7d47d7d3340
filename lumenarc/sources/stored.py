"""Tables written on the way: they end lineage, so lost executors cost no recomputation, and give joins sides whose sizes Spark knows."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a new temporary one if all runs on this machine; a cluster needs the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str = "table", by: str | None = None) -> DataFrame:
    """df written as Parquet and read again; by: sorted by this column, in ranges, so that filters on it skip row groups."""
    path = new_path(df.sparkSession, tag)
    (df.repartitionByRange(by).sortWithinPartitions(by) if by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df written to a path and read again; by: in ranges of these columns and sorted by them. Ranges of several columns split a value of the first that many rows have."""
    (df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version(df: DataFrame) -> str:
    """What tells the files apart that df reads directly: number, sizes and times of change, added up by Spark; no column is read."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    found = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("*").cast("decimal(38,0)")).alias("h")).first()
    return f"{found['n']}:{found['h']}"


def kept(df: DataFrame, name: str, write: Callable[[], list[str]]) -> list[str]:
    """The paths that write() returns, from an earlier call in this shared folder if name and version of df are those of then. They are noted only when all is written; of writers at one time the last one's note stays, and the tables of all are good."""
    spark = df.sparkSession
    note = f"{shared_dir(spark)}/kept-{hashlib.sha256(f'{name}:{version(df)}'.encode()).hexdigest()[:32]}"
    try:
        return [r["path"] for r in spark.read.parquet(note).orderBy("i").collect()]
    except AnalysisException:
        paths = write()
        spark.createDataFrame(list(enumerate(paths)), "i int, path string").coalesce(1).write.mode("overwrite").parquet(note)
        return paths
