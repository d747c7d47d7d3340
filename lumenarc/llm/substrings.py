"""Substring dedup by sliding spans of sentences.

A text is cut at the ends of sentences and at newlines; a sentence of more than WINDOW words is cut further, after the word of least hash in every
WINDOW words (sentence ends count as least): cuts depend on the words around them alone and are at most WINDOW words apart, so two copies of a passage of 50 words or more share a
whole run whatever its words and however long its sentences. From every cut on, the shortest run with SPAN sentences and MIN_WORDS words at least is hashed (96 bits over
lower-case words), once with newlines as cuts and once without, so that a passage wrapped at other lines is found too. A span that occurs at several places of the corpus is kept at the first (smallest doc_id, text hash, position);
sentences that a later occurrence covers are removed.

Spans are computed once and written, one row a document. Counting comes first, with partial sums on the map side, so only repeated spans are joined; the joins have one row a hash on one side, which
lets Spark split a hot hash on the other. Documents stored repeatedly (equal id and text) count as one and get equal results.

Defined results: a null or empty text has no sentences and stays as it is; an empty table gives no rows; null ids come first;
columns of docs that are named like the two that are added are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, stash, table, text_of, unused

SPAN, MIN_WORDS = 2, 20
#: In a passage of 50 words the first and the last common cut are 51 - 2 * WINDOW words apart at least, and a run takes MIN_WORDS - 1 + WINDOW at most.
WINDOW = 10
#: A word with the white space behind it; the first also with that before it.
WORD = re.compile(r"\s*\S+\s*")
END = re.compile(r"[.!?][\"')\]]*\Z")
HASH = np.dtype([("h1", ">i8"), ("h2", ">i4"), ("rest", ">i4")])


class Ranks(dict):
    """Hash of each word, 0 if it ends a sentence; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 16:
            self.clear()
        self[word] = rank = 0 if END.search(word) else 1 + xxhash.xxh32_intdigest(word.encode("utf-8", "replace"))
        return rank


RANKS = Ranks()


def cuts(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words in lower case, the numbers of words before each cut (0 and all included), and those cuts that don't depend on newlines."""
    words = text.lower().split() if text.isascii() else [w.lower() for w in text.split()]
    n = len(words)
    rank = np.fromiter(map(RANKS.__getitem__, words), np.int64, n)
    chosen = np.zeros(n + 1, dtype=bool)
    chosen[1:][rank == 0] = True
    if n >= WINDOW:
        near = sliding_window_view(rank[::-1], WINDOW)
        chosen[n - (np.arange(len(near)) + near.argmin(1))] = True  # the last of the least
    if n:
        chosen[[0, n]] = True
    own = np.nonzero(chosen)[0]
    if "\n" in text:
        chosen[list(accumulate(len(line.split()) for line in text.split("\n")))] = True
    return words, np.nonzero(chosen)[0], own


def sentences(text: str) -> list[str]:
    """Parts that together are the text, each with the white space behind it."""
    parts, (_, at, _) = WORD.findall(text), cuts(text)
    return ["".join(parts[x:y]) for x, y in pairwise(at.tolist())] if parts else [text] if text else []


def spans(text: str, span: int = SPAN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h1, h2, number of the first sentence and number of sentences: the shortest run from each cut on that is long enough, with and without newlines as cuts."""
    words, at, own = cuts(text)
    runs = np.empty((0, 2), dtype=np.int64)
    for some in (at, own) if len(at) > len(own) else (at,):
        first = np.arange(len(some))
        last = np.maximum(np.searchsorted(some, some + min_words), first + span)
        fits = last < len(some)
        runs = np.concatenate([runs, np.stack([some[first[fits]], some[last[fits]]], 1)])
    if len(at) > len(own):
        runs = np.unique(runs, axis=0)
    if not len(runs):
        return (np.empty(0, np.int64), *(np.empty(0, np.int32),) * 3)
    whole, begins = " ".join(words), [0, *accumulate(len(w) + 1 for w in words)]
    if not whole.isascii():  # places of words in bytes, to hash slices of one encoded text
        begins = [0, *accumulate(len(w.encode("utf-8", "replace")) + 1 for w in words)]
    packed, digest = whole.encode("utf-8", "replace"), xxhash.xxh3_128_digest
    h = np.frombuffer(b"".join([digest(packed[begins[x] : begins[y] - 1]) for x, y in runs.tolist()]), HASH)
    first = np.searchsorted(at, runs[:, 0]).astype(np.int32)
    return h["h1"].astype(np.int64), h["h2"].astype(np.int32), first, (np.searchsorted(at, runs[:, 1]) - first).astype(np.int32)


def _span_lists(docs: DataFrame, span: int, min_words: int, id_name: str, text_name: str) -> DataFrame:
    """One row a document: doc_id, th and lists h1, h2, at, n of its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t, span, min_words) for t in b.column(2).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found]))) for k in range(4)] if found else [pa.array([], pa.list_(t)) for t in (pa.int64(), *(pa.int32(),) * 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["doc_id", "th", "h1", "h2", "at", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), F.hash(text_of(text_name)).alias("th"), text_of(text_name).alias("text"))
    return rows.mapInArrow(run, "doc_id long, th int, h1 array<long>, h2 array<int>, at array<int>, n array<int>")


def repeated(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """doc_id, th, removed (sorted numbers of sentences to remove) and first_doc_ids (documents that keep them); only documents that lose any."""
    lists = stash(_span_lists(docs, span, min_words, id_name, text_name), "spans")
    # Both sides of each join come from tables, not from an aggregation above the same shuffle: only then does Spark split a hot span's rows over tasks.
    again = stash(lists.select(F.explode("h1").alias("h1")).groupBy("h1").agg(F.count("*").alias("times")).filter("times > 1").select("h1"), "repeats")
    rows = lists.select("doc_id", "th", F.explode(F.arrays_zip("h1", "h2", "at", "n")).alias("s")).select("doc_id", "th", "s.*")
    held = stash(rows.join(again, "h1", "left_semi"), "held")
    first = stash(held.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "at")).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times"), "firsts")
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th")) & (F.col("first.at") == F.col("at"))
    later = held.join(first, ["h1", "h2"]).filter(~same).select("doc_id", "th", F.col("first.doc_id").alias("first_doc_id"), F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("sentence"))
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("sentence")).alias("removed"), F.sort_array(F.collect_set("first_doc_id")).alias("first_doc_ids"))


def without_repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """docs with cleaned texts and two more columns, dedup_removed (numbers of removed sentences, null if none) and dedup_firsts (the documents that keep them)."""

    @F.pandas_udf("string")
    def cleaned(texts, removed):  # noqa: ANN001, ANN202
        def one(text, gone):  # noqa: ANN001, ANN202
            if gone is None:
                return text
            out = set(int(x) for x in gone)
            return "".join(s for i, s in enumerate(sentences(text or "")) if i not in out).rstrip()

        return texts.combine(removed, one)

    cleaned = cleaned.asNondeterministic()  # else Spark runs it once more for a filter above
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("dedup_removed", "dedup_firsts")]
    own_id, own_th, out, firsts = unused(docs, "own_id", "own_th", "gone", "firsts")
    gone = repeated(docs, span, min_words, id_name, text_name).select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th), F.col("removed").alias(out), F.col("first_doc_ids").alias(firsts))
    small_batches(spark)
    match = F.col(id_name).cast("long").eqNullSafe(F.col(own_id)) & (F.hash(text_of(text_name)) == F.col(own_th))
    joined = docs.join(gone, match, "left")
    text = F.when(F.col(out).isNull(), F.col(text_name)).otherwise(cleaned(F.when(F.col(out).isNotNull(), F.col(text_name)), F.col(out)))
    return joined.select(*(text.alias(c) if c == text_name else F.col(f"`{c}`") for c in kept), F.col(out).alias("dedup_removed"), F.col(firsts).alias("dedup_firsts"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "text", F.coalesce(F.size("dedup_removed"), F.lit(0)).alias("n_removed"), F.coalesce("dedup_removed", F.array().cast("array<int>")).alias("removed_sentences"), F.coalesce("dedup_firsts", F.array().cast("array<long>")).alias("first_doc_ids"))
