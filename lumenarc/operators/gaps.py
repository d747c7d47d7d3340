"""STM-1 and STM-2 in batch: of each key's rows those are accepted before which no accepted row lies less than a gap.

The rule refers to its own outcome: whether a row is accepted depends on all before it. Rows are dealt in ranges of (key, time), so a key of any size spreads over
tasks, and each range is folded alone, as if nothing came before. Only the first key of a range can be wrong then, where the range before ends with the same key. What it hands over
is one time. These times, one row a range, are settled from left to right: mostly the first row lies a gap behind, or the whole range lies within it; the rest is folded anew, in rounds, each
round all ranges whose handed time has changed at once. Two folds of one key soon meet in a row that both accept, and from there agree, so a round rarely needs another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenarc.sources.stored import stored


def dedup_gap(log: DataFrame, keys: list[str], ts: str, gap_seconds: float) -> DataFrame:
    """The keys and times of the rows accepted. Rows without a time are left out, null keys are keys of their own, of rows of one key and time the first is accepted."""
    gap = int(gap_seconds * 1e6)
    rows = log.select(*keys, F.unix_micros(F.col(ts)).alias("_micros")).filter("_micros is not null")
    dealt = rows.repartitionByRange(*keys, "_micros").sortWithinPartitions(*keys, "_micros").withColumn("_pid", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key = last = None
        begun = False
        for b in batches:
            ok, head = [], []
            for *k, t, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or k != key or t - last >= gap:
                    first, begun = (k if not begun else first), True
                    key, last = k, t
                    ok.append(True)
                else:
                    ok.append(False)
                head.append(k == first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_()), pa.array(head, pa.bool_())], names=[*b.schema.names, "_ok", "_head"])

    held = stored(dealt.mapInArrow(fold, f"{kinds}, _ok boolean, _head boolean"), "gaps")
    key, of_head = F.struct(*keys), lambda f: f(F.when(F.col("_head"), F.col("_micros")))
    ends = held.groupBy("_pid").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max(F.when(F.col("_ok"), F.struct(*keys, "_micros"))).alias("out"), of_head(F.min).alias("begin"), of_head(F.max).alias("end"))
    ranges = [(r._pid, tuple(r.first), tuple(r.last), r.out._micros, r.begin, r.end) for r in ends.orderBy("_pid").collect()]  # one row a range

    def again(carried: dict[int, int]) -> DataFrame:
        """The rows of the first keys of these ranges, folded with the times handed to them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pid = last = None
            for b in batches:
                ok = []
                for p, t in zip(b.column("_pid").to_pylist(), b.column("_micros").to_pylist(), strict=True):
                    pid, last = (p, carried[p]) if p != pid else (pid, last)
                    ok.append(t - last >= gap)
                    last = t if ok[-1] else last
                yield b.filter(pa.array(ok, pa.bool_()))

        own = held.filter(F.col("_head") & F.col("_pid").isin(list(carried))).drop("_ok", "_head")
        return own.repartition("_pid").sortWithinPartitions("_pid", "_micros").mapInArrow(run, kinds)

    folded: dict[int, tuple[int, int]] = {}
    while True:
        wrong, pending = settle(ranges, gap, folded)
        if not pending:
            break
        outs = {r._pid: r.out for r in again(pending).groupBy("_pid").agg(F.max("_micros").alias("out")).collect()}
        folded |= {p: (c, outs.get(p, c)) for p, c in pending.items()}
    found = held.filter(F.col("_ok") & ~(F.col("_head") & F.col("_pid").isin(list(wrong)))) if wrong else held.filter("_ok")
    found = found.select(*keys, "_micros")
    if wrong:
        found = found.unionByName(again(wrong).select(*keys, "_micros"))
    return found.select(*keys, F.timestamp_micros("_micros").alias(ts))


def settle(ranges: list[tuple], gap: int, folded: dict[int, tuple[int, int]]) -> tuple[dict[int, int], dict[int, int]]:
    """The time handed to each range whose own fold is wrong, and those of them whose fold with it isn't known yet. ranges: (pid, first key, last key, last accepted time of the last key, first and last time of the first key), in order; folded: pid -> (time handed, last accepted time)."""
    wrong, pending, before, out = {}, {}, None, None
    for pid, first, last, own, begin, end in ranges:
        handed = out if before == first and before is not None else None
        alone = first == last
        out, before = own, last
        if handed is None or begin - handed >= gap:
            continue
        wrong[pid] = handed
        if end - handed < gap:
            out = handed if alone else own
        elif pid in folded and folded[pid][0] == handed:
            out = folded[pid][1] if alone else own
        else:
            pending[pid] = handed
    return wrong, pending
