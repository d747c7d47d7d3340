"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

Counts cover every training text: Spark sums the counts of all tokens (the vocabulary is a table, never collected). Core words are those that occur
LEAST times, whatever the size of the corpus. All other words, seen or not, belong to one of GROUPS endings (their last three bytes). Texts are written
once as numbers of core words and endings. The HELD most frequent core words, hashes and counts, go to the tasks; the rest of them stay a table, which
meets the texts in joins: where that limit lies changes no result (tested).

Classes come from exchange clustering in two stages. The SEEDS most frequent core words, the endings and the end token are exchanged one by one over
their bigram counts, a matrix of fixed size, on the driver. Then REFITS rounds exchange all other core words at once, as distributed word clustering does:
Spark gathers for each word the classes before and behind every occurrence, and each word moves to the class where the class bigram
likelihood grows most, to first order; class bigrams are counted anew after each round. No such word has more than one in SEEDS of all tokens, so
none makes a task's share of the shuffle large. After a round the texts have the class itself in the places of core words that aren't held. The score is P(class | previous class) P(word | class), transitions smoothed towards the class
frequencies, emissions as (c + 0.5) / (N_class + 0.5 (V_class + 1)).

Words are told apart by 64-bit hashes (XXH64) among the core words held; all others meet the vocabulary in an equality join on the word itself, once a
text, so no key of it is hot.

Defined results: a null or empty text is its end token alone; rows with equal ids are scored one by one; without training texts the base score of a
token is log10(1), and every class is as likely.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bucket, small_batches, stash, table, text_of

LEAST, HELD, SEEDS, GROUPS, CLASSES, PASSES, REFITS, ALPHA = 3, 4_000_000, 767, 256, 64, 6, 2, 10.0
CACHE_WORDS, FLUSH = 200_000, 1 << 20
END = b""  # no word is empty


def tokens(text: str) -> list[bytes]:
    """Words, A to Z in lower case, split at the six ASCII spaces."""
    return text.encode("utf-8", "replace").lower().split()


def token_counts(texts: DataFrame, hold: int = 100_000) -> DataFrame:
    """token (binary) and c over all texts of a one-column table; END counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(tokens(t))
            held[END] += b.num_rows
            if len(held) > hold:
                yield out()
                held.clear()
        yield out()

    return texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Words:
    """Numbers of words: 0 is END, then the core words held by hash, then the endings."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_texts: int, groups: int = GROUPS) -> None:
        order = np.argsort(hashes)
        self.hashes, self.groups, self.n_core = hashes[order], groups, len(hashes) + 1
        self.counts = np.concatenate([[n_texts], counts[order]]).astype(np.int64)
        self.cache: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def of(self, words: list[bytes]) -> np.ndarray:
        """The number of each word. A full cache is emptied."""
        cache = self.cache
        found = [cache.get(w, -1) for w in words]
        new = list({w for w, n in zip(words, found, strict=True) if n < 0})
        if new:
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
            h = np.array([xxhash.xxh64_intdigest(w, 42) for w in new], dtype=np.uint64).view(np.int64)
            at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
            core = self.hashes[at] == h if len(self.hashes) else np.zeros(len(new), dtype=bool)
            numbers = {w: int(i) + 1 if c else self.n_core + zlib.crc32(w[-3:]) % self.groups for w, i, c in zip(new, at, core, strict=True)}
            if len(new) <= CACHE_WORDS:
                cache.update(numbers)
            found = [numbers[w] if n < 0 else n for w, n in zip(words, found, strict=True)]
        return np.array(found, dtype=np.int32)


def encoded(rows: DataFrame, words: Words) -> DataFrame:
    """rows (doc_id, held_out, text) with their numbers (END last), the logarithms of held counts summed, and the other words with their counts; tail_at: which of these stands in each place that has an ending's number. Written once."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    kinds = {"n_tokens": pa.int64(), "core_known": pa.int64(), "core_log": pa.float64(), "ids": pa.list_(pa.int32()), "tail": pa.list_(pa.binary()), "tail_n": pa.list_(pa.int32()), "tail_at": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        logs = np.append(np.log10(w.counts + 0.5), 0.0)
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            for text in b.column(2).to_pylist():
                said = tokens(text)
                ids = np.append(w.of(said), np.int32(0))
                core = np.minimum(ids, w.n_core)
                others = [said[i] for i in np.nonzero(core == w.n_core)[0].tolist()]
                tail = Counter(others)
                place = {x: i for i, x in enumerate(tail)}
                known = int(np.count_nonzero(core < w.n_core)) - (w.counts[0] == 0)
                for column, value in zip(out, (len(ids), known, float(logs[core].sum()), ids, list(tail), list(tail.values()), [place[x] for x in others]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(out, kinds.values(), strict=True))], names=["doc_id", "held_out", *kinds])

    found = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, core_known long, core_log double, ids array<int>, tail array<binary>, tail_n array<int>, tail_at array<int>")
    return stash(found.withColumn("rid", F.monotonically_increasing_id()), "encoded")


def bigrams(texts: DataFrame, unit_of: np.ndarray, size: int) -> np.ndarray:
    """size x size counts of adjacent units over all rows of a table with one column of numbers; a text begins behind an END."""
    shared = texts.sparkSession.sparkContext.broadcast(unit_of.astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, total = shared.value, np.zeros(size * size, dtype=np.int64)
        for b in batches:
            u = units[b.column(0).flatten().to_numpy()].astype(np.int64)
            if len(u):  # each text ends with END, so the texts of a batch are one sequence
                pairs = np.concatenate([[units[0]], u[:-1]]) * size + u
                total += np.bincount(pairs, minlength=size * size)
        at = np.nonzero(total)[0]
        for lo in range(0, len(at), 50_000):
            some = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    found = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most size * size rows
    counts = np.zeros(size * size)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(size, size)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each unit: units in falling frequency, each moved to the class that gains most, until a pass moves none."""
    size = len(bigrams)
    classes = min(classes, size)
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    order = np.argsort(-(bigrams.sum(1) + bigrams.sum(0)), kind="stable")
    of = np.zeros(size, dtype=np.int64)
    of[order] = np.arange(size) % classes
    one = np.eye(classes)[of]
    cc, right, left = one.T @ bigrams @ one, bigrams @ one, bigrams.T @ one  # right[u, k]: u before class k; left[u, k]: class k before u
    rows, cols = bigrams.sum(1), bigrams.sum(0)
    row, col = one.T @ rows, one.T @ cols
    for _ in range(passes):
        moved = 0
        for u in order:
            a, own = of[u], bigrams[u, u]
            r, s = right[u].copy(), left[u].copy()
            r[a] -= own
            s[a] -= own  # without u itself
            cc[a, :] -= r
            cc[:, a] -= s
            cc[a, a] -= own
            row[a] -= rows[u]
            col[a] -= cols[u]
            held = f(cc)
            gain = (f(cc + r[None, :]) - held).sum(1) + (f(cc + s[:, None]) - held).sum(0)
            d = np.diag(cc)
            gain += f(d + r + s + own) - f(d + r) - f(d + s) + f(d)
            gain -= f(row + rows[u]) - f(row) + f(col + cols[u]) - f(col)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            cc[b, :] += r
            cc[:, b] += s
            cc[b, b] += own
            row[b] += rows[u]
            col[b] += cols[u]
            if b != a:
                moved += 1
                of[u] = b
                right[:, a] -= bigrams[:, u]
                right[:, b] += bigrams[:, u]
                left[:, a] -= bigrams[u]
                left[:, b] += bigrams[u]
        if not moved:
            break
    return of


def best_classes(seen: np.ndarray, cc: np.ndarray) -> np.ndarray:
    """The class that each word fits best. seen: per word, how often each class is before it and behind it; cc: class bigrams."""
    k = len(cc)
    log = np.log(cc + 0.1)
    n = seen[:, :k].sum(1)
    fit = seen[:, :k] @ log + seen[:, k:] @ log.T - n[:, None] * (np.log(cc.sum(1) + 1) + np.log(cc.sum(0) + 1))[None, :]
    return fit.argmax(1)


def packed(words: np.ndarray, seen: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Distinct words in order, each with all its bytes of seen, some at a time."""
    order = np.argsort(words, kind="stable")
    w, s = words[order], seen[order]
    first = np.nonzero(np.concatenate([[True], w[1:] != w[:-1]]))[0] if len(w) else order
    stops = np.append(first, len(w)).astype(np.int32)
    for lo in range(0, len(first), 50_000):
        hi = min(lo + 50_000, len(first))
        yield w[first[lo:hi]], pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(stops[lo : hi + 1] - stops[lo]), pa.py_buffer(s[stops[lo] : stops[hi]].copy())])


def around(c: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """For places at of a sequence of classes, never its last, which is an END: the class before each, and after all these k + the class behind each."""
    return np.concatenate([np.where(at > 0, c[at - 1], c[-1]), c[np.minimum(at + 1, len(c) - 1)] + np.uint8(k)])


def chosen(seen: DataFrame, cc: np.ndarray, kind: str) -> DataFrame:
    """word (of this type) and the class that it fits best, from rows of a word and the bytes of classes around it."""
    k = len(cc)
    shared = seen.sparkSession.sparkContext.broadcast(cc)
    arrow = {"int": pa.int32(), "binary": pa.binary()}[kind]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word: sums of one batch at a time, the last word's carried on."""
        counts_of = shared.value
        carried = None

        def out(w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(w, arrow), pa.array(best_classes(n, counts_of), pa.int32())], names=["word", "class"])

        for b in batches:
            if not b.num_rows:
                continue
            w = b.column(0).to_numpy(zero_copy_only=False)
            changes = np.concatenate([[True], w[1:] != w[:-1]])
            first = np.nonzero(changes)[0]
            sizes = np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32, b.num_rows + 1, 4 * b.column(1).offset))
            run = np.repeat(np.cumsum(changes) - 1, sizes)
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8)
            n = np.bincount(run * (2 * k) + s, minlength=len(first) * 2 * k).reshape(len(first), 2 * k).astype(float)
            w = w[first]
            if carried is not None:
                if carried[0][0] == w[0]:
                    n[0] += carried[1][0]
                else:
                    yield out(*carried)
            carried = (w[-1:], n[-1:].copy())
            if len(w) > 1:
                yield out(w[:-1], n[:-1])
        if carried is not None:
            yield out(*carried)

    return seen.repartition("word").sortWithinPartitions("word").mapInArrow(choose, f"word {kind}, class int")


def refit(texts: DataFrame, class_of: np.ndarray, moves: np.ndarray, cc: np.ndarray, flush: int = FLUSH) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that moves allows and the class that each fits best, given the classes of all others."""
    k = len(cc)
    shared = texts.sparkSession.sparkContext.broadcast((class_of.astype(np.uint8), moves))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per word one byte for each class before an occurrence, and one, k higher, for each behind."""
        classes, movable = shared.value
        words, seen, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for w, s in packed(np.concatenate(words), np.concatenate(seen)):
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), s], names=["word", "seen"])

        for b in batches:
            ids = b.column(0).flatten().to_numpy()
            at = np.nonzero(movable[ids])[0]
            if len(at):
                words += [ids[at], ids[at]]
                seen.append(around(classes[ids], at, k))
                held += 2 * len(at)
            if held > flush:
                yield from out()
                words, seen, held = [], [], 0
        if held:
            yield from out()

    found = chosen(texts.mapInArrow(gather, "word int, seen binary"), cc, "int").select("word", F.col("class").cast("byte")).toArrow()  # at most HELD rows of two numbers
    return found.column("word").to_numpy(), found.column("class").to_numpy()


def refit_rest(texts: DataFrame, rest: DataFrame, class_of: np.ndarray, n_core: int, cc: np.ndarray) -> DataFrame:
    """word and class: refit() for the core words that are a table. texts: ids, tail, tail_at."""
    k = len(cc)
    shared = texts.sparkSession.sparkContext.broadcast(class_of.astype(np.uint8))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).flatten().to_numpy()
            at = np.nonzero(ids >= n_core)[0]
            if len(at):
                kinds = b.column(1).flatten().dictionary_encode()
                sizes = pc.list_value_length(b.column(1)).to_numpy()
                w = kinds.indices.to_numpy()[b.column(2).flatten().to_numpy() + np.repeat(np.cumsum(sizes) - sizes, pc.list_value_length(b.column(2)).to_numpy())]
                for some, s in packed(np.concatenate([w, w]), around(shared.value[ids], at, k)):
                    yield pa.RecordBatch.from_arrays([kinds.dictionary.take(pa.array(some)), s], names=["word", "seen"])

    seen = texts.mapInArrow(gather, "word binary, seen binary")
    # Words that aren't core are left out behind the shuffle: one row a word meets the table then, not one a place.
    return stash(chosen(seen, cc, "binary").join(rest.select(F.col("token").alias("word")), "word", "left_semi"), "classes")


def placed(found: DataFrame, classes: DataFrame, n_core: int, first: int) -> DataFrame:
    """found with first + its class in the ids' places of each word of classes."""
    names = [c for c in found.columns if c != "ids"]
    there = found.select("rid", F.posexplode("tail").alias("at", "word")).join(classes, "word").groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("at", "class")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ids, tail_at, at, to in zip(b.column("ids"), b.column("tail_at"), b.column("_at").to_pylist(), b.column("_to").to_pylist(), strict=True):
                ids = ids.values.to_numpy().copy()
                if at:
                    others = np.nonzero(ids >= n_core)[0]
                    now = np.full(int(tail_at.values.to_numpy().max()) + 1, -1, dtype=np.int32)
                    now[at] = np.array(to, dtype=np.int32) + first
                    now = now[tail_at.values.to_numpy()]
                    ids[others] = np.where(now >= 0, now, ids[others])
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.list_(pa.int32()))], names=[*names, "ids"])

    rows = found.join(there, F.col("rid") == F.col("_rid"), "left").select(*names, "ids", F.col("x.at").alias("_at"), F.col("x.class").alias("_to"))
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    return stash(rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*names, "ids"])), "placed")


class ClassModel:
    """step: log10 of the transition and of the next emission's denominator, flat by (previous class, class); class_of: by number."""

    def __init__(self, class_of: np.ndarray, cc: np.ndarray, types: np.ndarray) -> None:
        """cc: class bigrams; types: known words of each class."""
        self.k, self.class_of = len(cc), class_of.astype(np.uint8)
        n = cc.sum(0)
        prior = (n + 1) / (n.sum() + self.k)
        move = np.log10((cc + ALPHA * prior[None, :]) / (cc.sum(1, keepdims=True) + ALPHA))
        self.step = (move - np.log10(n + 0.5 * (types + 1))[None, :]).ravel()


def fit(found: DataFrame, words: Words, core_ending: np.ndarray, tail_types: np.ndarray, rest: DataFrame | None, seeds: int = SEEDS, classes: int = CLASSES, refits: int = REFITS) -> tuple[DataFrame, ClassModel]:
    """found: the encoded documents; returned with the classes of rest in place. core_ending: the ending of each core word held, by number from 1 on; tail_types: known words of each ending that aren't core; rest: the core words (token, g) that aren't held."""
    n_core, groups = words.n_core, words.groups
    training = found.filter("not held_out")
    top = 1 + np.argsort(-words.counts[1:], kind="stable")[:seeds]
    unit_of = np.concatenate([[0], len(top) + 1 + core_ending, len(top) + 1 + np.arange(groups)]).astype(np.int64)
    unit_of[top] = 1 + np.arange(len(top))
    counts = bigrams(training.select("ids"), unit_of, len(top) + 1 + groups)
    of = exchange(counts, classes)
    k, first = int(of.max()) + 1, n_core + groups
    class_of = np.concatenate([of[unit_of], np.arange(k)])  # from `first` on a number is a class
    moves = np.zeros(len(class_of), dtype=bool)
    moves[1:n_core] = True
    moves[top] = False
    cc = np.eye(k)[of].T @ counts @ np.eye(k)[of]
    rest_types = np.zeros(k)
    if rest is not None:
        for r in rest.groupBy("g").agg(F.count("*").alias("n")).collect():  # `groups` rows
            rest_types[class_of[n_core + r["g"]]] += r["n"]
    now = training
    for i in range(refits if moves.any() or rest is not None else 0):
        word, best = refit(now.select("ids"), class_of, moves, cc)
        if rest is not None:
            fitted = refit_rest(now.select("ids", "tail", "tail_at"), rest, class_of, n_core, cc)
            if i == refits - 1:
                found = placed(found, fitted, n_core, first)
                now = found.filter("not held_out")
            else:
                now = placed(training.select("rid", "tail", "tail_at", "ids"), fitted, n_core, first)
            rest_types[:] = 0
            for r in fitted.groupBy("class").agg(F.count("*").alias("n")).collect():  # `classes` rows
                rest_types[r["class"]] = r["n"]
        class_of[word] = best
        cc = bigrams(now.select("ids"), class_of, k)
    known = np.bincount(class_of[1:n_core], minlength=k) + np.bincount(class_of[n_core:first], tail_types, k) + rest_types
    known[class_of[0]] += bool(words.counts[0])
    return found, ClassModel(class_of, cc, known)


def ending(token: str, groups: int = GROUPS) -> Column:
    return (F.crc32(F.expr(f"substring({token}, greatest(octet_length({token}) - 2, 1), 3)")) % groups).cast("int")


def train(docs: DataFrame, training, id_name: str = "doc_id", text_name: str = "text", least: int = LEAST, held: int = HELD, seeds: int = SEEDS, groups: int = GROUPS, classes: int = CLASSES, refits: int = REFITS) -> tuple[DataFrame, DataFrame, Words, ClassModel]:  # noqa: ANN001
    """The encoded documents, the vocabulary, the words held and the model. training: a condition on docs; the rest is held out. held bounds memory alone."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), (~training).alias("held_out"), text_of(text_name).alias("text"))
    vocabulary = stash(token_counts(rows.filter("not held_out").select("text")), "vocabulary")
    no_word = F.octet_length("token") == 0
    texts = vocabulary.filter(no_word).agg(F.sum("c").alias("n")).first()["n"] or 0
    core = vocabulary.filter(~no_word & (F.col("c") >= least)).select("token", F.xxhash64("token").alias("h"), "c", ending("token", groups).alias("g"))
    frequent = core.orderBy(F.desc("c"), "h").limit(seeds).select("h", "c", F.col("g").cast("short")).toArrow()
    # Words of one count are held all or not at all; n tokens have fewer than sqrt(2 n) counts.
    sizes = core.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toArrow()
    within = np.cumsum(sizes.column("n").to_numpy()) <= held
    lowest = int(sizes.column("c").to_numpy()[within][-1]) if within.any() else 1 << 62
    more = frequent.filter(pc.less(frequent.column("c"), lowest))
    near = pa.concat_tables([core.filter(F.col("c") >= lowest).select("h", "c", F.col("g").cast("short")).toArrow(), more])  # at most `held` rows and the seeds
    rest = None if within.all() else core.filter((F.col("c") < lowest) & ~F.col("h").isin(more.column("h").to_pylist())).select("token", "g")
    h = near.column("h").to_numpy()
    words = Words(h, near.column("c").to_numpy(), texts, groups)
    tail_types = np.zeros(groups)
    for r in vocabulary.filter(~no_word & (F.col("c") < least)).groupBy(ending("token", groups).alias("g")).agg(F.count("*").alias("n")).collect():  # `groups` rows
        tail_types[r["g"]] = r["n"]
    found, model = fit(encoded(rows, words), words, near.column("g").to_numpy()[np.argsort(h)], tail_types, rest, seeds, classes, refits)
    return found, vocabulary, words, model


def score(docs: DataFrame, training, id_name: str = "doc_id", text_name: str = "text", **options: int) -> DataFrame:  # noqa: ANN001
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. options: those of train()."""
    found, vocabulary, _, model = train(docs, training, id_name, text_name, **options)
    stats = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train, v_train = stats["n"] or 0, stats["v"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ids = b.column(1)
            c = m.class_of[ids.flatten().to_numpy()].astype(np.int64)
            if b.num_rows:
                steps = m.step[np.concatenate([m.class_of[:1], c[:-1]]) * m.k + c]
                sizes = np.diff(np.frombuffer(ids.buffers()[1], np.int32, b.num_rows + 1, 4 * ids.offset))
                sums = np.add.reduceat(steps, np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums)], names=["class_rid", "class_log"])

    small_batches(docs.sparkSession)
    tail = found.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("rid", F.col("t.tail").alias("token"), F.col("t.tail_n").alias("n"))
    count = F.coalesce("c", F.lit(0))
    rest = tail.join(vocabulary, "token", "left").groupBy(F.col("rid").alias("tail_rid")).agg(F.sum(F.col("n") * F.log10(count + F.lit(0.5))).alias("tail_log"), F.sum(F.when(count > 0, F.col("n")).otherwise(0)).cast("long").alias("tail_known"))
    by_class = found.select("rid", "ids").mapInArrow(run, "class_rid long, class_log double")
    full = found.drop("tail", "tail_n", "tail_at", "ids").join(by_class, F.col("rid") == F.col("class_rid")).join(rest, F.col("rid") == F.col("tail_rid"), "left")
    logs = F.col("core_log") + F.coalesce("tail_log", F.lit(0.0))
    return full.select("doc_id", "held_out", "n_tokens", (F.col("core_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * F.lit(float(np.log10(n_train + 0.5 * (v_train + 1))))).alias("base_score"), (logs + F.col("class_log")).alias("score"))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), bucket("doc_id", 5) != 1)
