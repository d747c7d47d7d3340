"""Benchmark decontamination: the CGK embedding, bit-sampling LSH and exact edit verification.

Documents and items are sequences of words (lower case, edge punctuation off); a leak is a window of a document whose edit distance to a
whole item, in words, is at most MAX_EDITS of the item's length. What is only punctuation is no word, in documents as in items. The CGK embedding walks over a window: each step emits the current word and moves
on or stays by a random bit of (step, word); windows at a small edit distance fall into step soon and differ in few of the
3m positions. Each of REPETITIONS walks samples SAMPLED positions; windows that agree with the item there in one
repetition are candidates, and a banded alignment decides.

Walks start only where a lossless count allows a leak: the rare words chosen from an item stand in it r times, repetitions included, and d edits
lose at most d of these, so r - d must stand within a window's reach. Where d is the item's length or more, every start is tried. Items go to the tasks in blocks of at most BLOCK_BYTES, each block
against all documents; of several blocks one at a time is on the driver, and what it found is written before the next. Documents aren't shuffled.

Defined results: null texts have no words; items without words match nothing; equal rows are judged one by one; of equally near windows the first counts; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, stash, table, text_of

MAX_EDITS, REPETITIONS, SAMPLED, BLOCK_BYTES, SPARE = 0.2, 32, 3, 4 << 20, 3
EDGE = ".,;:!?\"'()[]{}"


def words_of(text: str) -> tuple[list[str], list[int]]:
    """The words without what is only punctuation, and the place of each among all that white space separates."""
    words, places = [], []
    for place, w in enumerate(text.lower().split()):
        if w := w.strip(EDGE):
            words.append(w)
            places.append(place)
    return words, places


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: numbers that follow each other become unrelated."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Items:
    """A block of benchmark items, ready for matching."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float = MAX_EDITS, repetitions: int = REPETITIONS, sampled: int = SAMPLED, seed: int = 11) -> None:
        self.codes: dict[str, int] = {}
        self.items, self.signed = [], defaultdict(list)
        rng = np.random.default_rng(seed)
        self.repetitions = repetitions
        for item_id, text in items:
            words, _ = words_of(text or "")
            if not words:
                continue
            code = np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words], dtype=np.int64)
            d = int(max_edits * len(words))
            times, rare, r = Counter(words), {}, 0
            for w in sorted(times, key=lambda w: (-len(w), w)):
                if r >= d + SPARE:
                    break
                rare[self.codes[w]] = times[w]
                r += times[w]
            picks = np.sort(rng.integers(0, 3 * len(words), (repetitions, sampled)), axis=1)
            self.items.append([item_id, code, d, r - d, picks, None, rare])
            for c in rare if r > d else ():
                self.signed[c].append(len(self.items) - 1)
        # Whether a walk moves on is a bit of a hash of (repetition, step, word): no table grows with the longest item.
        self.of_repetition = rng.integers(0, 1 << 64, (repetitions, 1), dtype=np.uint64)
        self.marks = rng.integers(0, 1 << 64, len(self.codes) + 1, dtype=np.uint64)
        for x in self.items:
            x[5] = self.keys(x[1], np.zeros(1, dtype=np.int64), len(x[1]), x[4])[:, :, 0]
        self.is_signed = np.zeros(len(self.codes) + 1, dtype=bool)
        self.is_signed[list(self.signed)] = True
        self.anywhere = [i for i, x in enumerate(self.items) if x[3] < 1]

    def keys(self, codes: np.ndarray, starts: np.ndarray, m: int, picks: np.ndarray) -> np.ndarray:
        """[repetition, sample, start]: what each walk over the m words (and beyond) from each start emits at its sampled steps; -1 behind the end."""
        out = np.full((*picks.shape, len(starts)), -1, dtype=np.int64)
        due = defaultdict(list)
        for (r, k), j in np.ndenumerate(picks):
            due[int(j)].append((r, k))
        last = len(codes) - 1
        stop = np.minimum(starts + m, len(codes))
        at = np.repeat(starts[None, :], self.repetitions, axis=0)
        for j in range(int(picks.max()) + 1):
            factor, addend = mixed(self.of_repetition + np.uint64(2 * j)), mixed(self.of_repetition + np.uint64(2 * j + 1))
            inside = at < stop
            now = codes[np.minimum(at, last)]
            for r, k in due.get(j, ()):
                out[r, k] = np.where(inside[r], now[r], -1)
            at = at + (((self.marks[now] * factor + addend) >> np.uint64(63)).astype(bool) | ~inside)
        return out

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, first word, words, distance) of the best window of each item that the text holds."""
        get = self.codes.get
        words, places = words_of(text)
        codes = np.array([get(w, 0) for w in words], dtype=np.int64)
        spots: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in np.nonzero(self.is_signed[codes])[0].tolist() if len(codes) else ():
            for i in self.signed[int(codes[at])]:
                spots[i].append((at, int(codes[at])))
        found = []
        for i in [*spots, *(self.anywhere if len(codes) else ())]:
            item_id, item, d, need, picks, keys, _ = self.items[i]
            best = None
            for starts in self.starts(i, spots[i]) if need > 0 else [np.arange(len(codes))]:
                agree = (self.keys(codes, starts, len(item), picks) == keys[:, :, None]).all(1).sum(0)
                # The likeliest windows first: nothing beats a window at distance 0.
                likely = np.argsort(-agree, kind="stable")
                for c in likely[: np.count_nonzero(agree)].tolist() if need > 0 else likely.tolist():
                    s = int(starts[c])
                    distance, length = align(item, codes[s : s + len(item) + d], d)
                    if distance <= d and (best is None or (distance, s) < (best[3], best[1])):
                        best = (item_id, s, length, distance)
                    if distance == 0:
                        break
                if best and best[3] == 0:
                    break
            if best:
                _, s, length, distance = best
                found.append((item_id, places[s], places[s + length - 1] - places[s] + 1 if length else 0, distance))
        return found

    def starts(self, i: int, hits: list[tuple[int, int]]) -> Iterator[np.ndarray]:
        """The starts of windows that can hold item i by the count, each once. hits: (place, code) of its rare words in the document."""
        _, item, d, need, _, _, rare = self.items[i]
        reach, low, held, kept, tried = len(item) + d, 0, Counter(), 0, -1
        for high, (at, code) in enumerate(hits):
            held[code] += 1
            kept += held[code] <= rare[code]
            while at - hits[low][0] >= reach:
                gone = hits[low][1]
                kept -= held[gone] <= rare[gone]
                held[gone] -= 1
                low += 1
            if kept < need:
                continue
            # A window that ends with this hit holds `need` hits, so it begins at the need-th last one at the latest.
            some = np.arange(max(0, at - reach + 1, tried + 1), hits[high - need + 1][0] + 1)
            if len(some):
                tried = int(some[-1])
                yield some


def align(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int]:
    """Edit distance of the item to the nearest prefix of the window, and that prefix's length; stops once it is above most."""
    across = np.arange(len(window) + 1)
    row = across.copy()
    for i, x in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (window != x))
        row = np.minimum.accumulate(new - across) + across
        if row.min() > most:
            return most + 1, 0
    return int(row.min()), int(row.argmin())


def blocks(benchmark: DataFrame, id_name: str = "item_id", text_name: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in lists of at most `most` bytes, and whether a list is the only one."""
    some, held, cut = [], 0, False
    for r in benchmark.select(F.col(id_name).cast("long").alias("i"), text_of(text_name).alias("t")).orderBy("i", "t").toLocalIterator():
        size = len(r["t"].encode("utf-8", "replace"))
        if some and held + size > most:
            yield some, False
            some, held, cut = [], 0, True
        some.append((r["i"], r["t"]))
        held += size
    if some:
        yield some, not cut


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_name: str = "doc_id", text_name: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance: the best window of each item in each document that holds one."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, first_word int, n_words int, distance int"
    small_batches(spark)
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), text_of(text_name).alias("text"))

    def against(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(doc, *x) for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in items.leaks(text)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "distance"])

        return rows.mapInArrow(run, schema)

    found = [against(Items(b, max_edits)) if only else stash(against(Items(b, max_edits)), "leaks") for b, only in blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_name: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """docs without those that hold an item; all columns as they are, no shuffle."""
    small_batches(docs.sparkSession)
    for b, only in blocks(benchmark):
        items = Items(b, max_edits)

        @F.pandas_udf("boolean")
        def clean(texts, items=items):  # noqa: ANN001, ANN202
            return texts.map(lambda t: not items.leaks(t))

        docs = docs.filter(clean(text_of(text_name)))
        docs = docs if only else stash(docs, "clean")
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
