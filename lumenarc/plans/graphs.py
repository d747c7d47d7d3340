"""Queries over the person graph and the timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenarc.operators import graph as G

from .bindings import edges, person_documents, persons, sql, table, timeline

QUERIES, ORACLE = {}, {}


def query(oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


SUPPLIERS = ["person_id_1", "person_id_2"]


@query(sql("edges persons", "select e.id, a.name name_1, b.name name_2, connection_type, cast(strength as int) strength from edges e join persons a on a.id = person_id_1 join persons b on b.id = person_id_2 where strength >= 2"))
def jn3_named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.named(edges(spark, sf_dir).filter("strength >= 2"), persons(spark, sf_dir)).select("id", "name_1", "name_2", "connection_type", "strength")


@query(sql("edges", "select person_id, count(*) n, cast(sum(strength) as bigint) total from (select person_id_1 person_id, strength from edges union all select person_id_2, strength from edges) group by 1"))
def jn4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(edges(spark, sf_dir)).groupBy("person_id").agg(F.count("*").alias("n"), F.sum("strength").alias("total"))


@query(sql("timeline persons", "select t.id, coalesce(string_agg(p.id || ':' || p.name, ',' order by i), '') people from timeline t left join (select id tid, unnest(person_ids) pid, generate_subscripts(person_ids, 1) i from timeline) on tid = t.id left join (select s_suppkey id, s_name as name from supplier where s_acctbal >= 0) p on p.id = pid group by 1"))
def jn5_event_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    found = G.resolve_ids(timeline(spark, sf_dir), "id", "person_ids", known, "id", "name")
    return found.select("id", F.array_join(F.transform("resolved", lambda x: F.concat_ws(":", x["id"].cast("string"), x["label"])), ",").alias("people"))


@query(sql("edges persons", "select e.id from edges e where person_id_1 in (select s_suppkey from supplier where s_acctbal >= 0) and person_id_2 in (select s_suppkey from supplier where s_acctbal >= 0)"))
def jn9_existing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.existing_endpoints(edges(spark, sf_dir), table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("id"))).select("id")


@query(sql("edges", "select id, array_to_string(document_ids, ',') document_ids from edges where strength >= 3"))
def jn11_shared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.shared_documents(edges(spark, sf_dir).filter("strength >= 3"), person_documents(spark, sf_dir))
    return found.select("id", F.array_join(F.col("document_ids").cast("array<string>"), ",").alias("document_ids"))


@query(sql("edges", "select min(id) id, a, b from (select id, least(person_id_1, person_id_2) // 2 a, greatest(person_id_1, person_id_2) // 2 b, description, strength, row_number() over (partition by least(person_id_1 // 2, person_id_2 // 2), greatest(person_id_1 // 2, person_id_2 // 2) order by length(description) desc, strength desc, id) rn from edges where person_id_1 // 2 <> person_id_2 // 2) where rn = 1 group by a, b"))
def win1_best_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    halved = edges(spark, sf_dir).withColumns({c: F.floor(F.col(c) / 2).cast("long") for c in SUPPLIERS})
    return G.best_edge_per_pair(halved).select("id", F.least(*SUPPLIERS).alias("a"), F.greatest(*SUPPLIERS).alias("b"))


@query(sql("edges persons", "select min(h.id) id, a.name name_1, b.name name_2, connection_type from (select id, person_id_1 // 2 p1, person_id_2 // 2 p2, connection_type from edges) h join persons a on a.id = p1 join persons b on b.id = p2 where p1 <> p2 group by a.name, b.name, connection_type"))
def gr1_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    halved = edges(spark, sf_dir).withColumns({c: F.floor(F.col(c) / 2).cast("long") for c in SUPPLIERS})
    return G.network(halved, persons(spark, sf_dir)).select("id", "name_1", "name_2", "connection_type")


CHAIN = """y as (select pid, min(cast(date[1:4] as int)) mn, max(cast(date[1:4] as int)) mx from (select unnest(person_ids) pid, date from timeline) group by 1),
k as (select id from persons where id in (select pid from y where mx >= 1993 and mn <= 1996) and category <> 'FRANCE'), f as (select * from edges where strength >= 2 and len(document_ids) >= 2 and connection_type in ('legal', 'social') and person_id_1 in (select id from k) and person_id_2 in (select id from k)),
g as (select p, count(*) n from (select person_id_1 p from f union all select person_id_2 from f) group by 1)"""


@query(sql("edges persons timeline", "select id, connection_type from f where person_id_1 in (select p from g where n >= 3) and person_id_2 in (select p from g where n >= 3)", CHAIN))
def gr2_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = persons(spark, sf_dir).filter("category <> 'FRANCE'").withColumn("document_count", F.lit(1))
    return G.filter_chain(people, edges(spark, sf_dir), G.active_years(timeline(spark, sf_dir)), 1993, 1996, types=["legal", "social"], min_degree=3).select("id", "connection_type")


@query(sql("edges", "select p person_id, count(*) degree from (select person_id_1 p from edges union all select person_id_2 from edges) group by 1"))
def gr3_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges(spark, sf_dir))


@query(sql("edges", "select id, cast(strength as int) strength from edges where person_id_1 in (select * from n) and person_id_2 in (select * from n)", "n as (select person_id_2 from edges where person_id_1 = 7 union select person_id_1 from edges where person_id_2 = 7 union select 7)"))
def gr4_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ego(edges(spark, sf_dir), F.lit(7).cast("long")).select("id", "strength")


@query(sql("timeline", "select cast(date[1:4] as int) as year, count(*) n, count(*) filter (significance >= 2) n_key from timeline group by 1"))
def gr8_timeline_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.timeline_years(timeline(spark, sf_dir), F.substring("date", 1, 4).cast("int"))


@query(sql("edges persons links", "select id, category, coalesce(d, 0) document_count, coalesce(c, 0) connection_count from persons left join (select person_id, count(*) d from links group by 1) on person_id = id left join (select p, count(*) c from (select person_id_1 p from edges union all select person_id_2 from edges) group by 1) on p = id"))
def agg16_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.recount(persons(spark, sf_dir), person_documents(spark, sf_dir), edges(spark, sf_dir)).select("id", "category", "document_count", "connection_count")


@query(sql("timeline", "select person_id, min(cast(d as int)) min_year, max(cast(d as int)) max_year from (select unnest(person_ids) person_id, date[1:4] d from timeline) group by 1"))
def agg17_active_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.active_years(timeline(spark, sf_dir))


@query(sql("timeline", "select id, date, significance from timeline where date >= '1994' and date < '1996' and significance >= 3 and category <> '5-LOW'"))
def flt6_timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).filter("date >= '1994' and date < '1996' and significance >= 3 and category <> '5-LOW'").select("id", "date", "significance")


@query(sql("timeline", "select id, date from timeline where list_contains(person_ids, 3)"))
def flt4_events_of_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).filter(F.array_contains("person_ids", F.lit(3).cast("long"))).select("id", "date")


@query(sql("edges", "select id, connection_type from edges where connection_type = 'legal' and (person_id_1 = 5 or person_id_2 = 5) and strength >= 2"))
def flt8_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter("connection_type = 'legal' and (person_id_1 = 5 or person_id_2 = 5) and strength >= 2").select("id", "connection_type")


@query(sql("edges", "select connection_type, count(*) n from edges group by 1"))
def agg2_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("connection_type").agg(F.count("*").alias("n"))


@query("select s_suppkey id, count(*) n, max(o_totalprice) top from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey where o_orderstatus = 'F' group by 1")
def jn1_person_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    people = table(spark, sf_dir, "supplier").select("s_suppkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("s_suppkey").alias("id")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
