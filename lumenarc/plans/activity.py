"""Queries over the activity logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenarc.operators import activity as A, graph as G
from lumenarc.operators.gaps import dedup_gap

from .bindings import as_of, documents, events, sql, table

QUERIES, ORACLE = {}, {}
AGE = "epoch(timestamp '2024-01-31 00:00:00') - epoch_us(ts) / 1e6"


def query(oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("event_type").isin("view", "click"))


@query(sql("ev", f"select entity_id, round(sum(exp(-({AGE}) / 86400.0)), 6) score, count(*) n from ev where event_type in ('view', 'click') and ({AGE}) >= 0 and ({AGE}) < 7 * 86400 group by 1 having count(*) >= 2 order by score desc, entity_id limit 10"))
def agg8_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trending(views(spark, sf_dir), "entity_id", "ts", as_of(), k=10)


@query(sql("ev", "select entity_id, count(*) n from ev where event_type in ('view', 'click') and entity_id in (select id from docs where document_type = 'note') group by 1", "docs as (select doc_id id, case when n_chars < 500 then 'note' else 'x' end document_type from documents)"))
def agg6_counts_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = documents(spark, sf_dir).filter("document_type = 'note'").select(F.col("id").alias("entity_id"))
    return A.counts_for(views(spark, sf_dir), "entity_id", ids)


@query(sql("ev docs", "select id, title, n from docs join (select entity_id, count(*) n from (select distinct user_id, entity_id from ev where event_type = 'purchase') group by 1 order by n desc, 1 desc limit 20) on id = entity_id"))
def agg7_most_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", F.col("entity_id").alias("id")).distinct()
    return A.most_voted(votes, documents(spark, sf_dir).select("id", "title"), "id", 20)


@query("""select query, count(*) n, max(ts) as last from (select event_type || '-' || cast(user_id % 50 as varchar) query, ts, case when event_type = 'error' then 0 else 1 end r from events) where r = 0 and ts > timestamp '2024-01-31' - interval 14 day group by 1 order by n desc, query limit 10""")
def agg9_zero_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("query"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("n_results"), "ts")
    return A.zero_result_searches(log, as_of(), 14, 10).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query("select user_id % 10 worker, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'click') click, count(*) filter (event_type = 'error') error from events group by 1")
def agg10_job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = events(spark, sf_dir).select((F.col("user_id") % 10).alias("worker"), F.col("event_type").alias("status"))
    return A.job_stats(jobs, "worker", ["view", "click", "error"])


@query("""with c as (select event_type model, cast(round(value, 4) as decimal(18, 4)) cost, ts from events) select model, cast(sum(cost) as double) total, cast(sum(case when ts >= timestamp '2024-01-01' then cost else 0 end) as double) month_to_date,
cast(sum(case when ts >= timestamp '2024-01-31' and ts <= timestamp '2024-01-31' then cost else 0 end) as double) day_to_date from c group by rollup (model)""")
def agg11_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = events(spark, sf_dir).select(F.col("event_type").alias("model"), F.round("value", 4).cast("decimal(18,4)").alias("cost"), "ts")
    found = A.budget_summary(costs, as_of())
    return found.select("model", *(F.col(c).cast("double").alias(c) for c in ("total", "month_to_date", "day_to_date")))


STEP = """chain as (select user_id, event_type, min(ts) ts from ev group by 1, 2 union all select c.user_id, c.event_type, (select min(e.ts) from ev e where e.user_id = c.user_id and e.event_type = c.event_type and e.ts >= c.ts + interval {h} hour) from chain c where c.ts is not null)"""


@query(sql("ev", "select user_id, event_type, ts from chain where ts is not null", "recursive " + STEP.format(h=24)))
def stm1_view_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_gap(events(spark, sf_dir), ["user_id", "event_type"], "ts", 86400).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(sql("ev", "select user_id, event_type, ts from chain where ts is not null", "recursive " + STEP.format(h=6)))
def stm2_search_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_gap(events(spark, sf_dir), ["user_id", "event_type"], "ts", 6 * 3600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select event_type, cast(date_trunc('day', ts) as date) as day, count(*) n from events group by 1, 2")
def stm5_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query(sql("ev", "select user_id, entity_id, coalesce(min(event_id) filter (value < 20), min(event_id)) event_id from ev where event_type = 'purchase' group by 1, 2"))
def dml6_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "entity_id", "event_id")
    old = events(spark, sf_dir).filter("event_type = 'purchase' and value < 20").groupBy("user_id", "entity_id").agg(F.min("event_id").alias("event_id"))
    return A.insert_if_absent(old, votes, ["user_id", "entity_id"], "event_id")


@query(sql("ev docs", "select id, views from (select id, views from docs left join (select entity_id, count(*) as views from ev where event_type in ('view', 'click') group by 1) on id = entity_id order by views desc nulls last, id limit 50 offset 25)"))
def srt5_popular_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = views(spark, sf_dir).select(F.col("entity_id").alias("id"))
    found = A.popular_first(documents(spark, sf_dir).select("id"), seen, "id")
    return found.orderBy(F.col("views").desc_nulls_last(), "id").offset(25).limit(50)


@query(sql("ev docs", "select entity_id, n from (select * from (select entity_id, count(*) n, 0 as s from ev where event_type = 'signup' group by 1 order by n desc, entity_id limit 20) union all select id, 0, 1 from docs where id not in (select entity_id from (select entity_id, count(*) n from ev where event_type = 'signup' group by 1 order by n desc, entity_id limit 20))) order by s, n desc, entity_id limit 60"))
def set2_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = A.counts_for(events(spark, sf_dir).filter("event_type = 'signup'"), "entity_id").orderBy(F.desc("n"), "entity_id").limit(20)
    rest = documents(spark, sf_dir).select(F.col("id").alias("entity_id"), F.lit(0).cast("long").alias("n"))
    return A.with_padding(first, rest, "entity_id", [F.desc("n"), "entity_id"], 60).drop("segment")


@query("with r as (select event_id, coalesce(sum(round(value, 4)) over (order by event_id rows between unbounded preceding and 1 preceding), 0) b from events) select event_id, round(b, 2) spent_before from r where b < 10000")
def win8_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = events(spark, sf_dir).select("event_id", F.round("value", 4).alias("v"))
    return A.within_budget(ranked, "event_id", "v", 10000).select("event_id", F.round("spent_before", 2).alias("spent_before"))


@query("select user_id, arg_max(event_type, struct_pack(n := n, e := event_type)) top_type, cast(sum(n) as bigint) mentions, count(*) types from (select user_id, event_type, count(*) n from events group by 1, 2) group by 1")
def agg15_top_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("top_type"), F.sum("n").alias("mentions"), F.count("*").alias("types"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id) rn from events) where rn <= 3")
def win4_latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_by(events(spark, sf_dir), ["user_id"], [F.desc("ts"), "event_id"], 3).select("user_id", "event_id", "event_type")


@query("select entity_id, count(*) n, count(*) filter (user_id % 3 = 0 and event_type = 'error') fails, case when count(*) filter (event_type = 'error') >= 3 then 'failed' else 'pending' end status from (select *, cast(json_extract_string(props, '$.k') as bigint) entity_id from events) group by 1")
def dml11_job_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    error = F.col("event_type") == "error"
    return log.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if((F.col("user_id") % 3 == 0) & error).alias("fails"), F.when(F.count_if(error) >= 3, "failed").otherwise("pending").alias("status"))
