"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is the majority vote over the XXH64 of all shingles. To find fingerprints that differ in at most
2 bits it is cut into two 32-bit segments: two differences over two segments leave one segment with at most one. Every
segment is indexed 32 times, each time with another bit blanked (a one-wildcard variant): two segments that differ in at most
one bit agree on a variant, an equality join finds them, and the whole fingerprints verify.

Work is on distinct fingerprints, so copies cost one row. A bucket of many fingerprints (a variant that a large group shares)
is not joined as it is: the other segment, which differs in at most 2 bits, is cut into three pieces, of which one is
equal, and the bucket is joined by (variant, piece); buckets that are still large are cut once more, by the sorted list of
what they hold, since within an equal piece the rest has at most 2 differences and at most 22 bits: there the few
thousand one-bit and two-bit neighbours of each fingerprint are looked up instead. So no bucket gives all its pairs, and no link is lost.

Defined results: a null or empty text has fingerprint 0; documents with equal fingerprints are linked; null ids are linked like others
but never name a component; a document that is stored repeatedly gets one row for each copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import row_key, small_batches, stash, table, text_of
from .components import components

SEED, MAX_BITS, BUCKET = 42, 2, 64
LOW = (1 << 32) - 1


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def fingerprint(text: str, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint; words are runs of anything but the six ASCII spaces, A to Z in lower case."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, votes = len(words) - width + 1, np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 8192):
        hi = min(lo + 8192, n)
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), ends[lo + width - 1 : hi + width - 1].tolist(), strict=True)], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Per row: doc_id, th and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "th", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(*row_key(id_name, text_name), text_of(text_name).alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _pairs(side: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs a < b of one bucket that differ in at most MAX_BITS bits. Buckets hold BUCKET rows at most."""
    x, y = side.select(*keys, F.col("fp").alias("a")), side.select(*keys, F.col("fp").alias("b"))
    return x.join(y.hint("merge"), keys).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")


def _split(side: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets with 2 to most rows, and those of larger ones.

    The join is merged on purpose: Spark takes what explode gives for no larger than the table before it, so it would broadcast 64 rows for each fingerprint."""
    sizes = side.groupBy(*keys).agg(F.count("*").alias("bucket_n")).filter("bucket_n > 1")
    joined = side.join(sizes.hint("merge"), keys)
    return joined.filter(F.col("bucket_n") <= most).drop("bucket_n"), joined.filter(F.col("bucket_n") > most).drop("bucket_n")


def near_neighbours(fps: DataFrame) -> DataFrame:
    """All pairs of the table's fingerprints that differ in 1 or 2 bits, by looking up the 2,080 neighbours of each: the exact way for buckets that stay large."""
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    masks = fps.sparkSession.range(1).select(F.explode(F.flatten(F.transform(one, lambda x: F.transform(one, lambda y: x.bitwiseOR(y))))).alias("mask")).distinct()
    looked = fps.join(F.broadcast(masks)).select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("mask")).alias("b")).filter("a < b")
    return looked.join(fps.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most 2 bits. fps: distinct fp."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW))
    bits = F.sequence(F.lit(0), F.lit(31))

    def variants(segment: Column, number: int) -> Column:
        blank = lambda i: segment.bitwiseAND(F.bitwise_not(bit(i)))
        return F.transform(bits, lambda i: F.struct((F.lit(number * 32) + i).cast("byte").alias("kind"), blank(i).cast("long").alias("value")))

    index = fps.select("fp", F.explode(F.concat(variants(high, 0), variants(low, 1))).alias("v")).select("fp", "v.kind", "v.value")
    few, many = _split(index, ["kind", "value"], bucket)
    other = F.when(F.col("kind") < 32, low).otherwise(high)
    piece = lambda i, at, n: F.struct(F.lit(i).cast("byte").alias("piece"), F.shiftrightunsigned(other, at).bitwiseAND(F.lit((1 << n) - 1)).alias("part"))
    cut = many.select("fp", "kind", "value", F.explode(F.array(piece(0, 0, 11), piece(1, 11, 11), piece(2, 22, 10))).alias("p")).select("fp", "kind", "value", "p.piece", "p.part")
    keys = ["kind", "value", "piece", "part"]
    small, large = _split(stash(cut, "buckets"), keys, bucket)
    rest = near_neighbours(stash(large.select("fp").distinct(), "large"))
    return _pairs(few, ["kind", "value"]).unionByName(_pairs(small, keys)).unionByName(rest).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """fp, component_id and keeper: the smallest doc_id that the fingerprint reaches, and the smallest (doc_id, th). prints: doc_id, th, fp."""
    first = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")), "distinct-fps")
    roots = components(links(first.select("fp")))
    rooted = stash(first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    best = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("keeper")), "best")
    return rooted.join(best, "root").select("fp", "component_id", "keeper")


def clusters(docs: DataFrame, width: int = 3, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Per row: doc_id, th, fp, component_id and keeper, whether the row is its group's first."""
    prints = stash(fingerprints(docs, width, id_name, text_name), "fingerprints")
    joined = prints.join(groups(prints).withColumnRenamed("fp", "fp_of"), F.col("fp") == F.col("fp_of"))
    first = F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.th") == F.col("th"))
    return joined.select("doc_id", "th", "fp", "component_id", first.alias("keeper"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
