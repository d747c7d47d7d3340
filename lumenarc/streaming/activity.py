"""Streams over the activity log. Each equals its batch counterpart on the rows that came in time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenarc.sources.stored import stored


def dedup_gap_stream(log: DataFrame, keys: list[str], ts: str, gap_seconds: float) -> DataFrame:
    """STM-1, STM-2 as a stream: keys and times of the rows accepted, a row being accepted iff no accepted row of its key lies less than the gap before it. State: one time a key.

    Rows of one trigger are taken in order of time; a row older than the last accepted one of its key came late and is dropped."""
    gap = int(gap_seconds * 1e6)
    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "micros bigint"])

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        last = state.get[0] if state.exists else None
        times = np.sort(np.concatenate([f["micros"].to_numpy() for f in frames]))
        out = []
        for t in times.tolist():
            if last is None or t - last >= gap:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({**{k: [v] * len(out) for k, v in zip(keys, key, strict=True)}, "micros": out})

    rows = log.select(*keys, F.unix_micros(ts).alias("micros")).groupBy(*keys)
    found = rows.applyInPandasWithState(run, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)
    return found.select(*keys, F.timestamp_micros("micros").alias(ts))


def hourly_counts(log: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """STM-3. Counts of each key and hour; rows later than the watermark are dropped. trending_of() reads them."""
    w = log.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("window.start").alias("hour"), "n")


def trending_of(hours: DataFrame, key: str, as_of: Column, days: float, tau: float, min_count: int, k: int) -> DataFrame:
    """STM-3. Top k keys by decayed hourly counts; decay is applied on reading, an hour counting as if all of it were at its middle: at most exp(1800 / tau) off."""
    age = (F.unix_micros(as_of) - F.unix_micros("hour")) / F.lit(1e6) - 1800.0
    live = hours.filter((age >= -1800.0) & (age < days * 86400.0))
    s = live.groupBy(key).agg(F.round(F.sum(F.col("n") * F.exp(-age / F.lit(tau))), 6).alias("score"), F.sum("n").alias("n"))
    return s.filter(F.col("n") >= min_count).orderBy(F.desc("score"), key).limit(k)


def daily_counts(log: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """STM-5. Rows of each key and day."""
    w = log.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.to_date("window.start").alias("day"), "n")


def pairs_of(said: DataFrame, task_pairs: int = 1_000_000) -> DataFrame:
    """(name_1, name_2, documents): names of one document in pairs, each in order, and how many documents say both. said: document_id and name.

    The names of a document are gathered and paired in their row, one name at a time; a document names few persons. Pairs are counted in tasks of about task_pairs each, however many there are: nearly all may be distinct, and Spark's own number of tasks doesn't follow them."""
    one = stored(said.filter("document_id is not null and name is not null").groupBy("document_id").agg(F.sort_array(F.collect_set("name")).alias("names")).select("names"), "names")
    size = F.size("names").cast("long")
    n = one.agg(F.sum(size * (size - 1) / 2).alias("n")).first().n or 0
    first = one.select("names", F.posexplode("names").alias("i", "name_1")).filter(F.col("i") < F.size("names") - 1)
    pairs = first.select("name_1", F.explode(F.slice("names", F.col("i") + 2, F.size("names") - 1 - F.col("i"))).alias("name_2"))
    return pairs.repartition(int(n // task_pairs) + 8, "name_1", "name_2").groupBy("name_1", "name_2").agg(F.count("*").alias("documents"))


def ingest(known: DataFrame, path: str, kept: tuple[str, ...] = ("people", "pairs")) -> Callable[[DataFrame, int], None]:
    """STM-4. What foreachBatch runs on a stream of mentions (document_id, name, role, n): sums per name and co-mentioned pairs, appended under the batch's number, so a batch that is run again replaces itself. known: the documents whose mentions count. kept: which of the two are written."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.join(known, "document_id", "left_semi").withColumn("name", F.lower("name"))
        if "people" in kept:
            people = rows.groupBy("name", "role").agg(F.sum("n").alias("mentions"), F.count_distinct("document_id").alias("documents"))
            people.write.mode("overwrite").parquet(f"{path}/people/batch={number}")
        if "pairs" in kept:
            pairs_of(rows.select("document_id", "name")).write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")

    return batch


def ingested_people(spark: SparkSession, path: str) -> DataFrame:
    """STM-4. Persons (name, mentions, role with most mentions) over all batches. A document comes whole in one batch."""
    p = spark.read.parquet(f"{path}/people").filter("name is not null").groupBy("name", "role").agg(F.sum("mentions").alias("m"))
    return p.groupBy("name").agg(F.sum("m").alias("mentions"), F.max_by("role", F.struct("m", "role")).alias("role"))


def ingested_pairs(spark: SparkSession, path: str) -> DataFrame:
    """STM-4. Pairs of names and their documents over all batches."""
    rows = spark.read.parquet(f"{path}/pairs")
    return rows.repartition(rows.count() // 1_000_000 + 8, "name_1", "name_2").groupBy("name_1", "name_2").agg(F.sum("documents").alias("documents"))
