"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, hashed into buckets; a word's vector is the mean of its buckets' vectors, a window's
vector the mean of its words', and a linear softmax over it gives the window's log-odds. Vectors and softmax are trained jointly
in numpy, so a misspelling never seen shares most n-grams with words that were. A document is as toxic as its worst
window, else a single insult would vanish in a long text: training starts with every window bearing its document's label and goes
on with the worst windows of each document alone. A logistic curve fitted on documents kept out of training turns the worst window's
log-odds into a score.

The fit uses at most MAX_DOCS labelled documents of at most MAX_CHARS characters each: that bounds what reaches the driver. Scoring
covers every whole text, without a shuffle: the model (one number a bucket) goes to the tasks.

Defined results: a null or empty text scores as a window without words; labels repeated for an id count as toxic if one is;
without labels of both classes every score is the share of toxic labels.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bucket, small_batches, table, text_of

MAX_DOCS, MAX_CHARS, BUCKETS, DIM, WINDOW, PASSES, CUT = 4000, 20_000, 1 << 17, 8, 8, 6, 0.3
CACHE_WORDS = 100_000
EDGE = ".,;:!?\"'()[]{}*#%&$|"


def grams(word: str, buckets: int = BUCKETS) -> list[int]:
    w = f"<{word}>".encode("utf-8", "replace")
    return [zlib.crc32(w) % buckets, *(zlib.crc32(w[i : i + n]) % buckets for n in (3, 4, 5) for i in range(len(w) - n + 1))]


def words_of(text: str) -> list[str]:
    return [w.strip(EDGE) or w for w in text.lower().split()]


class Model:
    """Log-odds of a window: bias plus the mean of its words' means of bucket weights; score: logistic of slope * worst window + shift."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float, constant: float | None = None, window: int = WINDOW) -> None:
        self.weights, self.bias, self.slope, self.shift, self.constant, self.window = weights, bias, slope, shift, constant, window
        self.cache: dict[str, float] = {}

    def word(self, w: str) -> float:
        found = self.cache.get(w)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            g = grams(w, len(self.weights))
            found = self.cache[w] = float(self.weights[g].sum()) / len(g)
        return found

    def worst(self, text: str) -> float:
        words = words_of(text)
        if not words:
            return self.bias
        get = self.cache.get
        values = [get(w) for w in words]
        sums = np.cumsum([0.0, *(self.word(w) if v is None else v for w, v in zip(words, values, strict=True))])
        n = min(self.window, len(words))
        return self.bias + float((sums[n:] - sums[:-n]).max()) / n

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.worst(text) + self.shift, -60, 60))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a small ridge."""
    mean, scale = x.mean(), x.std() + 1e-9
    a = np.stack([(x - mean) / scale, np.ones(len(x))], 1)
    t = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        t = t + np.linalg.solve(h, a.T @ (y - p) - 1e-2 * t)
    return float(t[0] / scale), float(t[1] - t[0] * mean / scale)


def fit(rows: list[tuple[str, int]], buckets: int = BUCKETS, dim: int = DIM, window: int = WINDOW, passes: int = PASSES, seed: int = 7) -> Model:
    y_all = np.array([y for _, y in rows], dtype=np.float32)
    if not len(rows) or y_all.min() == y_all.max():
        return Model(np.zeros(1, np.float32), 0.0, 1.0, 0.0, float(y_all.mean()) if len(rows) else 0.0)
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    windows, owner = array("i"), array("i")
    for d, (text, _) in enumerate(rows):
        w = [ids.setdefault(x, len(ids)) for x in words_of(text)]
        for i in range(0, len(w), window):
            some = w[i : i + window]
            windows.extend(some + [-1] * (window - len(some)))
            owner.append(d)
    packed, sizes = array("i"), array("i")  # four bytes a bucket: lists would take a driver's memory
    for w in ids:
        g = grams(w, buckets)
        packed.extend(g)
        sizes.append(len(g))
    flat, sizes = np.frombuffer(packed, dtype=np.int32), np.frombuffer(sizes, dtype=np.int32).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows, owner = np.frombuffer(windows, dtype=np.int32).reshape(-1, window), np.frombuffer(owner, dtype=np.int32).astype(np.int64)
    held = rng.random(len(rows)) < 0.25  # for the logistic curve
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = rng.uniform(-1, 1, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    memory = [np.full(buckets, 1e-6, np.float32), np.full(out.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)]

    def word_values() -> np.ndarray:
        v = emb @ (out[1] - out[0])
        return np.add.reduceat(v[flat], starts) / sizes

    def window_values() -> np.ndarray:
        v = np.append(word_values(), 0.0)[windows]
        return v.sum(1) / np.maximum((windows >= 0).sum(1), 1) + float(bias[1] - bias[0])

    def train(picked: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        order = rng.permutation(len(picked))
        for lo in range(0, len(order), 512):
            at = order[lo : lo + 512]
            some = windows[picked[at]]
            there = some >= 0
            count = np.maximum(there.sum(1), 1).astype(np.float32)
            uniq, inv = np.unique(some[there], return_inverse=True)
            n = sizes[uniq]
            of_word = np.repeat(np.arange(len(uniq)), n)
            within = np.arange(len(of_word)) - np.repeat(np.cumsum(n) - n, n)
            g = flat[np.repeat(starts[uniq], n) + within]
            vec = np.add.reduceat(emb[g], np.cumsum(n) - n) / n[:, None]
            of_window = np.nonzero(there)[0]
            bag = np.zeros((len(at), dim), np.float32)
            np.add.at(bag, of_window, vec[inv])
            bag /= count[:, None]
            z = bag @ out.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), target[at]] -= 1
            p *= weight[at, None]
            d_bag, d_out, d_bias = (p @ out) / count[:, None], p.T @ bag, p.sum(0)
            d_vec = np.zeros_like(vec)
            np.add.at(d_vec, inv, d_bag[of_window])
            d_emb = (d_vec / n[:, None])[of_word]
            touched, where = np.unique(g, return_inverse=True)
            total = np.stack([np.bincount(where, d_emb[:, k], len(touched)) for k in range(dim)], 1).astype(np.float32)
            memory[0][touched] += (total**2).mean(1)
            emb[touched] -= rate * total / np.sqrt(memory[0][touched])[:, None]
            for k, (x, dx) in enumerate(((out, d_out), (bias, d_bias)), 1):
                memory[k] += dx**2
                x -= 0.2 * rate * dx / np.sqrt(memory[k])

    label = y_all.astype(np.int64)[owner]
    learn = np.nonzero(~held[owner])[0]
    train(learn, label[learn], np.where(label[learn] == 1, 0.3, 1.0).astype(np.float32), 0.1)
    for _ in range(passes):
        value = window_values()
        order = np.lexsort((-value, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        keep = ~held[owner[order]] & (place < np.where(label[order] == 1, 1, 6))
        picked = order[keep]
        train(picked, label[picked], np.where(label[picked] == 1, 4.0, 1.0).astype(np.float32), 0.1)
    model = Model((emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0, window=window)
    use = np.nonzero(held)[0] if len(set(y_all[held])) == 2 else np.arange(len(rows))
    model.slope, model.shift = logistic(np.array([model.worst(rows[i][0]) for i in use]), y_all[use])
    model.cache = {}
    return model


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """At most max_docs labelled texts, toxic ones up to half, chosen by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("label")).filter("label_id is not null and label is not null")
    known = known.filter(bucket("label_id", 4) != 2).groupBy("label_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    some = known.filter("label = 1").orderBy(*order).limit(max_docs // 2).unionByName(known.filter("label = 0").orderBy(*order).limit(max_docs - max_docs // 2))
    texts = docs.select(F.col("doc_id").alias("label_id"), text_of().alias("label_text")).filter(F.length("label_text") <= max_chars)
    found = texts.join(F.broadcast(some), "label_id").select("label_id", "label_text", "label")
    # Ids that repeat in documents could give more rows than labels: the order and the limit bound them as well.
    return [(r["label_text"], r["label"]) for r in found.orderBy(*order, F.xxhash64("label_text")).limit(max_docs).collect()]


def score_texts(docs: DataFrame, model: Model, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Per row of docs: doc_id, th (hash of the text) and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([model.score(t) for t in b.column(2).to_pylist()], pa.float64())], names=["doc_id", "th", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), F.xxhash64(text_of(text_name)).alias("th"), text_of(text_name).alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, score double")


def keep_clean(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """docs without the rows that score cut or more, all columns as they are; no shuffle."""

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        return texts.map(model.score)

    small_batches(docs.sparkSession)
    return docs.filter(score(text_of()) < cut)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return score_texts(docs, model).select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
