"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes of one Arrow batch: texts can be long, so the default of 10,000 rows doesn't bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a new temporary one if all runs on this machine; a cluster needs the setting, since its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here, and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of Python operators in this session, by rows and by bytes."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bucket(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def let(value: Column, body) -> Column:
    """Binds value once for body, a function of Column: the optimizer would else repeat it in every lambda call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(id_name: str, text_name: str) -> list[Column]:
    """Key of a document: its id and a hash of its text. Rows alike in both are one document that is stored repeatedly."""
    return [F.col(id_name).cast("long").alias("doc_id"), F.xxhash64(text_of(text_name)).alias("th")]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
