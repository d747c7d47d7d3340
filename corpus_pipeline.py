"""A training corpus in five stages: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and all rows that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenarc.llm import leaks, packing, simhash, substrings, toxicity
from lumenarc.llm.common import row_key, stash, table, text_of, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the model learns from the labelled documents among them. Null and empty texts score as a window without words; rows alike are judged alike; without labels of both classes the share of toxic labels decides for all."""
    return toxicity.keep_clean(docs, toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"))))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (smallest id, then text hash) of each SimHash group over five-word shingles; copies with equal id and text count as one, and any of them stays. Texts without words, all alike to SimHash, are one group."""
    keep_id, keep_th, keep_n = unused(docs, "keep_id", "keep_th", "keep_n")
    kept = simhash.clusters(docs, width=5).filter("keeper").groupBy(F.col("doc_id").alias(keep_id), F.col("th").alias(keep_th)).agg(F.count("*").alias(keep_n))
    keep = stash(kept, "keepers")
    own_id, _ = row_key("doc_id", "text")
    match = own_id.eqNullSafe(F.col(keep_id)) & (F.xxhash64(text_of()) == F.col(keep_th))
    first = docs.join(keep, match, "left_semi")
    # Only where a kept document is stored repeatedly does choosing one of its copies need another shuffle of texts.
    return first if keep.filter(F.col(keep_n) > 1).isEmpty() else first.dropDuplicates(["doc_id", "text"])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences of passages that an earlier document has; those left without a word go. Of places with equal id and text the first by position keeps the passage, in every copy; a text that loses nothing stays as it is, null and empty ones too; n_chars, where there, is that of the new text."""
    kept = substrings.without_repeats(docs).filter(F.col("dedup_removed").isNull() | text_of().rlike(r"[^\x20\x09-\x0D]"))
    lengths = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*lengths)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, rows alike are judged alike, an empty benchmark drops nothing."""
    return leaks.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens; null and empty texts are one piece of one token, rows with equal ids are packed one by one, other columns are left out."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", one_of_near_copies), ("substring_dedup", drop_repeats), ("decontamination", drop_leaks), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
