"""Sharding into contiguous shards of near equal bytes by a global prefix sum.

Rows are put in one global order by a range partitioning on (doc_id, text hash, row number of the scan): the last column
splits repeated rows, so no key can fill a partition. Each partition keeps a running sum; the totals of the partitions, one
small row each, give every partition its start; the start plus the running sum is a row's place in the corpus, and the
place of its middle, in units of total / n_shards, is its shard. Only (id, size, checksum) move, never texts.

Defined results: a null text has no bytes, a null id sorts first, equal rows stand side by side, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import small_batches, stash, table, text_of

ROW_BYTES, SHARDS = 16, 40


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bytes and rows before each row in its partition."""
    bytes_before = rows_before = 0
    for b in batches:
        size = b.column("size")
        ends = pc.add(pc.cumulative_sum(size), bytes_before)
        rows = pa.array(range(rows_before, rows_before + b.num_rows), pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, pc.subtract(ends, size), rows], names=[*b.schema.names, "bytes_before", "rows_before"])
        bytes_before, rows_before = bytes_before + (pc.sum(size).as_py() or 0), rows_before + b.num_rows


def with_places(sized: DataFrame, order: list[str]) -> DataFrame:
    """Adds to each row (with a long column size) place and row_no, the bytes and rows before it in the global order."""
    spark = sized.sparkSession
    salted = sized.withColumn("row_salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(*order, "row_salt").sortWithinPartitions(*order, "row_salt").drop("row_salt").withColumn("pid", F.spark_partition_id())
    small_batches(spark)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    held = stash(dealt.mapInArrow(_running, f"{kinds}, bytes_before long, rows_before long"), "places")
    # One row a partition: thousands on a large cluster.
    totals = held.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("pid", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"start_{c}") for c in ("bytes", "rows")))
    joined = held.join(F.broadcast(starts), "pid")
    return joined.select(*sized.columns, (F.col("start_bytes") + F.col("bytes_before")).alias("place"), (F.col("start_rows") + F.col("rows_before")).alias("row_no"))


def byte_shards(docs: DataFrame, n_shards: int = SHARDS, id_name: str = "doc_id", text_name: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the row's number in its shard)."""
    text = F.col(text_name).cast("string")
    sized = docs.select(F.col(id_name).alias("doc_id"), (F.octet_length(text_of(text_name)) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(text_of(text_name).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"))
    placed = with_places(sized, ["doc_id", "th"])
    total = placed.agg(F.sum("size").alias("total"))  # one row
    middle = F.col("place").cast("decimal(38,0)") * 2 + F.col("size")
    sharded = placed.join(F.broadcast(total)).withColumn("shard", F.least(F.floor(middle * n_shards / (F.col("total").cast("decimal(38,0)") * 2)).cast("int"), F.lit(n_shards - 1)))
    firsts = sharded.groupBy("shard").agg(F.min("row_no").alias("first_row"))  # n_shards rows
    return sharded.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("first_row")).alias("slot"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

