"""Analytics over append-only activity logs: views, votes, searches, jobs and costs.

Nothing here reads the clock: "now" is always the argument as_of. Ties are broken by the key, so results are total orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def since(ts: Column, as_of: Column, days: float) -> Column:
    """ts lies in the window of so many days that ends at as_of."""
    age = (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1e6)
    return (age >= 0) & (age < days * 86400.0)


def trending(log: DataFrame, key: str, ts: str, as_of: Column, days: float = 7, tau: float = 86400.0, min_count: int = 2, k: int = 10) -> DataFrame:
    """Top k keys by exponentially decayed activity: the sum of exp(-age / tau) over the last days, for keys seen min_count times.

    One partial and one final aggregation, then a top-k that sorts k rows a task."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.col(ts))) / F.lit(1e6)
    scored = log.filter(since(F.col(ts), as_of, days)).groupBy(key).agg(F.round(F.sum(F.exp(-age / F.lit(tau))), 6).alias("score"), F.count("*").alias("n"))
    return scored.filter(F.col("n") >= min_count).orderBy(F.desc("score"), key).limit(k)


def counts_for(log: DataFrame, key: str, ids: DataFrame | None = None) -> DataFrame:
    """AGG-6. Rows per key, for the given ids only if there are any."""
    kept = log if ids is None else log.join(ids.select(key).distinct(), key, "left_semi")
    return kept.groupBy(key).agg(F.count("*").alias("n"))


def most_voted(votes: DataFrame, dim: DataFrame, key: str, k: int) -> DataFrame:
    """AGG-7. The k keys with most votes, newest id first among equals, joined late with their wide rows: the top-k side has k rows."""
    top = counts_for(votes, key).orderBy(F.desc("n"), F.desc(key)).limit(k)
    return dim.join(F.broadcast(top), key)


def with_padding(primary: DataFrame, fallback: DataFrame, key: str, rank: list, k: int) -> DataFrame:
    """SET-2. primary in its order, then rows of fallback that it hasn't, up to k rows in all; the column segment tells them apart."""
    rest = fallback.join(primary.select(key), key, "left_anti").orderBy(*rank).limit(k)
    both = primary.withColumn("segment", F.lit(0)).unionByName(rest.withColumn("segment", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("segment", *rank).limit(k)


def zero_result_searches(log: DataFrame, as_of: Column, days: float, k: int) -> DataFrame:
    """AGG-9. log: query, n_results, ts. Queries without results in the last days: how often and when last."""
    empty = log.filter((F.col("n_results") == 0) & since(F.col("ts"), as_of, days))
    return empty.groupBy("query").agg(F.count("*").alias("n"), F.max("ts").alias("last")).orderBy(F.desc("n"), "query").limit(k)


def job_stats(jobs: DataFrame, by: str, statuses: list[str]) -> DataFrame:
    """AGG-10. Jobs by status, one column each."""
    return jobs.groupBy(by).pivot("status", statuses).agg(F.count(F.lit(1))).fillna(0, statuses)


def budget_summary(costs: DataFrame, as_of: Column) -> DataFrame:
    """AGG-11. Total, month-to-date and day-to-date cost for each model and over all (model null). costs: model, cost (decimal), ts."""
    month, day = F.date_trunc("month", as_of), F.date_trunc("day", as_of)
    spent = lambda cond: F.sum(F.when(cond, F.col("cost")).otherwise(0))
    return costs.rollup("model").agg(F.sum("cost").alias("total"), spent((F.col("ts") >= month) & (F.col("ts") <= as_of)).alias("month_to_date"), spent((F.col("ts") >= day) & (F.col("ts") <= as_of)).alias("day_to_date"))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """DML-6. old and those rows of new whose key is not there yet, the first of each key in order; null-safe keys."""
    safe = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_{k}") for k in keys]
    names = [f"_{k}" for k in keys]
    seen = old.select(*safe).distinct()
    best = new.select("*", *safe).groupBy(*names).agg(F.min_by(F.struct(*new.columns), order).alias("row"))
    fresh = best.join(seen, names, "left_anti").select("row.*")
    return old.unionByName(fresh, allowMissingColumns=True)


def popular_first(dim: DataFrame, views: DataFrame, key: str) -> DataFrame:
    """SRT-5. dim with its views; order by views desc nulls last, then key, for the popular order."""
    return dim.join(counts_for(views, key).withColumnRenamed("n", "views"), key, "left")


def within_budget(ranked: DataFrame, rank: str, cost: str, cap: float) -> DataFrame:
    """WIN-8. The prefix of ranked rows before which the running cost is below cap. Rows are written in ranges of the rank; each range adds the totals of those before it, so no task sorts all rows."""
    from pyspark.sql import Window

    from lumenarc.sources.stored import stored

    rows = stored(ranked.repartitionByRange(rank).withColumn("_range", F.spark_partition_id()), "ranked")
    totals = rows.groupBy("_range").agg(F.sum(cost).alias("_sum"))  # one row a range
    earlier = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    here = F.sum(cost).over(Window.partitionBy("_range").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1))
    # A range that begins beyond the cap (costs aren't negative) is left out before its rows are sorted.
    found = rows.join(earlier.filter(F.col("_earlier") < cap), "_range").withColumn("spent_before", F.col("_earlier") + F.coalesce(here, F.lit(0)))
    return found.filter(F.col("spent_before") < cap).drop("_range", "_earlier")
