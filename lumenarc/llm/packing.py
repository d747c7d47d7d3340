"""Best-fit packing by a configuration linear program.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver. A configuration
is a multiset of lengths that fits one sequence; the covering program (as few configurations as hold all pieces) is
solved by multiplicative weights, each step pricing configurations with a knapsack dynamic program. The solution is rounded to whole
sequences so that sums over neighbouring configurations keep; what that leaves is solved and rounded again, ROUNDS times in all, and the last
pieces are packed best-fit in decreasing length. Then the loosest sequences and some with short pieces are packed anew with these, where that
saves any; best fit places at most a tenth of the sequences by that. The plan says for the r-th piece of a length in which sequence and
where it goes; Spark numbers the pieces of a length inside partitions and adds the counts of earlier partitions, so no length,
however common, meets in one task.

Defined results: a null text is empty and still holds its end token; rows with equal ids are separate documents whose pieces
share numbers; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import small_batches, stash, table, text_of
from .tokens import default_path, encoder

CAPACITY, END_ID = 1024, 2
#: Steps of the first round of the linear program (a fifth in later ones), rounds, rates of the weights, what may miss the best price, and the gap at which steps end.
STEPS, ROUNDS, EPSILON, FIRST_EPSILON, SLACK, GAP = 300, 24, 0.03, 0.3, 0.001, 0.002
#: Shares of the program's sequences that are packed anew with the rest.
MENDED = (0.01, 0.02, 0.04, 0.06, 0.08)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, id_name: str = "doc_id", text_name: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, pid and rank: the number of the piece among those of its length in its partition."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, seen = encoder(path), np.uint32(end_id).tobytes(), Counter()
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text, pid in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = enc.ids(text) + end
                n = len(ids) // 4
                head = n % capacity or capacity
                for i, start in enumerate([0, *range(head, n, capacity)]):
                    stop = head if not i else start + capacity
                    length = stop - start
                    for column, value in zip(out, (doc, i, start, length, zlib.crc32(ids[4 * start : 4 * stop]), pid, seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "pid", "rank"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), text_of(text_name).alias("text"), F.spark_partition_id().alias("pid"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long")


def price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming. For each room c: the most that lengths within c are worth, the first length of such a choice (0: none) and the room behind it.

    value: worth of each of lengths, which fall; of equal choices the longest first piece wins."""
    best, item, after = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64), np.zeros(capacity + 1, dtype=np.int64)
    first = np.searchsorted(-lengths, -np.arange(capacity + 1))  # where the lengths that fit begin
    for c in range(int(lengths[-1]), capacity + 1):
        best[c], item[c], after[c] = best[c - 1], item[c - 1], after[c - 1]
        fit = first[c]
        got = best[c - lengths[fit:]] + value[fit:]
        j = int(got.argmax())
        if got[j] > best[c] + 1e-12:
            best[c], item[c], after[c] = got[j], lengths[fit + j], c - lengths[fit + j]
    return best, item, after


def fractional(demand: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS, prices: np.ndarray | None = None, gap: float = GAP) -> tuple[dict[tuple, float], float, np.ndarray]:
    """How often each configuration (its lengths, falling) is used, a lower bound of the sequences needed, and the last prices.

    Multiplicative weights on the covering constraints, one for each length, begun at prices or at what the lengths take of the capacity. Each
    step solves one knapsack; its table also gives the best configuration around every single length, and those within SLACK of the best of all are
    the step's answer, each as often as its length is needed, as many in all as the bound. A length's weight falls with the coverage it got. The
    answers' mean is the solution. The bound is the best dual value met; the steps end when the mean covers all but `gap` of every length."""
    lengths = np.nonzero(demand)[0][::-1]
    need = demand[lengths].astype(float)
    at = np.zeros(capacity + 1, dtype=np.int64)
    at[lengths] = np.arange(len(lengths))
    weight = need * (lengths if prices is None else prices[lengths])
    weight = weight / weight.sum()
    lower, n, covered, answers = float((need * lengths).sum()) / capacity, 0, np.zeros(len(lengths)), []
    for step in range(1, steps + 1):
        value = weight / need
        best, item, after = price(value, lengths, capacity)
        lower = max(lower, float(weight.sum() / best[capacity]))
        around = value + best[capacity - lengths]
        chosen = np.nonzero(around >= (1 - SLACK) * best[capacity])[0]
        columns, room = [lengths[chosen]], capacity - lengths[chosen]
        while item[room].any():
            columns.append(item[room])
            room = after[room]
        configs = np.stack(columns, 1)
        share = need[chosen] / (configs == lengths[chosen, None]).sum(1)
        share *= lower / share.sum()
        there = configs > 0
        gain = np.bincount(at[configs[there]], np.repeat(share, there.sum(1)), len(lengths)) / need
        answers.append((configs, share))
        n, covered = n + 1, covered + gain
        weight = weight * np.exp(-max(EPSILON, FIRST_EPSILON / step**0.5) * np.minimum(gain, 4.0))
        weight = np.maximum(weight / weight.sum(), 1e-9 / len(lengths))
        if covered.min() >= n / (1 + gap):
            break
        if step & (step - 1) == 0 and step < steps // 2:  # early steps are far off: the mean begins anew at each power of two
            n, covered, answers = 0, np.zeros(len(lengths)), []
    used: dict[tuple, float] = defaultdict(float)
    for configs, share in answers:
        for c, x in zip(configs.tolist(), share.tolist(), strict=True):
            used[tuple(k for k in sorted(c, reverse=True) if k)] += x / n
    last = np.zeros(capacity + 1)
    last[lengths] = value
    return used, lower, last


def best_fit(left: np.ndarray, capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Configurations and how often each: longest first, each time the longest that still fits. Empties left."""
    while left.any():
        config, room = Counter(), capacity
        for length in map(int, np.nonzero(left)[0][::-1]):
            n = min(int(left[length]), room // length)
            if n:
                config[length] += n
                room -= n * length
        times = min(int(left[length]) // n for length, n in config.items())
        for length, n in config.items():
            left[length] -= n * times
        yield tuple(config.elements()), times


def rounded(left: np.ndarray, capacity: int, steps: int) -> tuple[Counter, float]:
    """Whole configurations of the program for left, which they empty but for what rounding leaves, and a lower bound for left. Sums over neighbouring configurations keep; what a round leaves is solved and rounded again."""
    out, prices, bound = Counter(), None, 0.0
    for number in range(ROUNDS):
        if not left.any():
            break
        used, lower, prices = fractional(left, capacity, steps if not number else steps // 5, prices)
        bound = bound if number else lower
        sum_of_parts = 0.5
        for config, x in sorted(used.items(), reverse=True):
            sum_of_parts += x
            counts = Counter(config)
            times = min(int(sum_of_parts), *(int(left[length]) // n for length, n in counts.items()))
            sum_of_parts -= int(sum_of_parts)
            if times:
                for length, n in counts.items():
                    left[length] -= n * times
                out[config] += times
    return out, bound


def taken(configs: Counter, key, most: int) -> Counter:  # noqa: ANN001
    """The first `most` of configurations in order of key."""
    out = Counter()
    for config in sorted(configs, key=key):
        n = min(configs[config], most)
        if n <= 0:
            break
        out[config] = n
        most -= n
    return out


def plan(demand: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> tuple[list[tuple[int, int, int, int, int, int]], dict[str, float]]:
    """Rows (length, first_rank, count, per_sequence, first_sequence, offset) and, for the record, sequences: full (one piece of the capacity), program (placed by the linear program), rest (best fit), total, and bound (what any packing needs).

    The pieces of a length with ranks from first_rank on, count of them, go per_sequence at a time into consecutive sequences from first_sequence on."""
    left = demand.astype(np.int64).copy()
    full, left[capacity] = int(left[capacity]), 0
    program, bound = rounded(left, capacity, steps)
    rest = Counter()
    for config, times in best_fit(left, capacity):
        rest[config] += times
    # The rest, the program's loosest sequences and as many of those with the shortest pieces, which fill gaps, are packed anew where that saves any.
    for share in MENDED:
        most = int(sum(program.values()) * share / 2)
        open_ = taken(program, lambda c: (sum(c), c), most)
        open_ += taken(program - open_, lambda c: (min(c), c), most)
        left = np.zeros(capacity + 1, dtype=np.int64)
        for config, times in (*open_.items(), *rest.items()):
            for length in config:
                left[length] += times
        anew = Counter()
        for config, times in best_fit(left, capacity):
            anew[config] += times
        fewer = sum(anew.values()) < sum(open_.values()) + sum(rest.values())
        if fewer and sum(anew.values()) <= sum((program - open_).values()) / 9:  # nine tenths stay the program's
            program, rest = program - open_, anew
    rows, given, sequences = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for config, times in ([((capacity,), full)] if full else []) + [*program.items(), *rest.items()]:
        offset = 0
        for length, count in Counter(config).items():
            rows.append((length, int(given[length]), count * times, count, sequences, offset))
            given[length] += count * times
            offset += length * count
        sequences += times
    return rows, {"full": full, "program": sum(program.values()), "rest": sum(rest.values()), "total": sequences, "bound": full + bound}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, id_name: str = "doc_id", text_name: str = "text", steps: int = STEPS) -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    held = stash(pieces(docs, capacity, tokenizer_path, id_name, text_name), "pieces")
    counts = held.groupBy("pid", "length").agg(F.count("*").alias("n"))
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        demand[r["length"]] = r["n"]
    rows, _ = plan(demand, capacity, steps)
    schema = "length long, first_rank long, count long, per_sequence long, first_sequence long, first_offset long"
    plans = spark.createDataFrame(rows, schema)  # bounded by the steps and by capacity, not by the corpus: 900 to 3,200 rows for 1,000 to a billion documents
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = held.join(before.select("pid", "length", F.coalesce("before", F.lit(0)).alias("before")), ["pid", "length"]).withColumn("r", F.col("before") + F.col("rank"))
    fits = (numbered["length"] == plans["length"]) & (F.col("r") >= F.col("first_rank")) & (F.col("r") < F.col("first_rank") + F.col("count"))
    at = F.col("r") - F.col("first_rank")
    return numbered.join(F.broadcast(plans), fits).select("doc_id", "piece", "start", numbered["length"], "ids_crc32", (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"), (F.col("first_offset") + (at % F.col("per_sequence")) * numbered["length"]).cast("long").alias("offset"))


def op7_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
