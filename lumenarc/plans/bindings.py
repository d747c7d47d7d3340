"""Model tables made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF_TEXT = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with ts as an instant and props.k as entity_id."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("entity_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("n_chars") < 500, "note").when(F.col("n_chars") < 3000, "letter").otherwise("report")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("data_set"), kind.alias("document_type"), F.col("n_chars").alias("file_size_bytes"), F.array("lang", "source").alias("tags"), "text", "lang")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("category"))


def person_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs, dealt by document: what joins or groups by document afterwards, as edges and timeline do, meets one shuffle of the lines and no other."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("document_id")).repartition("document_id").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier pairs of the same order; an order has a few lines, so a key of this join is small. Documents are counted besides, so that lists of them are shuffled only for queries that read them."""
    links = person_documents(spark, sf_dir)
    a, b = links.withColumnRenamed("person_id", "person_id_1"), links.withColumnRenamed("person_id", "person_id_2")
    pairs = a.join(b, "document_id").filter("person_id_1 < person_id_2").groupBy("person_id_1", "person_id_2").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_set("document_id")).alias("document_ids"))
    n = F.col("n")
    return pairs.select((F.col("person_id_1") * 1000000 + F.col("person_id_2")).alias("id"), "person_id_1", "person_id_2", F.when(n % 3 == 0, "business").when(n % 3 == 1, "social").otherwise("legal").alias("connection_type"), F.concat(F.lit("shared "), n.cast("string")).alias("description"), F.least(F.lit(5), n).alias("strength"), "document_ids")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: text dates of mixed precision."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(F.col("o_orderkey") % 7 == 0, F.substring(day, 1, 4)).when(F.col("o_orderkey") % 5 == 0, F.substring(day, 1, 7)).otherwise(day)
    people = person_documents(spark, sf_dir).groupBy(F.col("document_id").alias("o_orderkey")).agg(F.sort_array(F.collect_set("person_id")).alias("person_ids"))
    return o.join(people, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), date.alias("date"), F.col("o_orderpriority").alias("category"), (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("significance"), F.coalesce("person_ids", F.array().cast("array<long>")).alias("person_ids"))


#: The same tables in SQL.
SQL = {
    "ev": "select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) entity_id from events",
    "docs": "select doc_id id, 'doc-' || doc_id title, source data_set, case when n_chars < 500 then 'note' when n_chars < 3000 then 'letter' else 'report' end document_type, n_chars file_size_bytes, [lang, source] tags, text, lang from documents",
    "persons": "select s_suppkey id, s_name as name, n_name category from supplier join nation on s_nationkey = n_nationkey",
    "links": "select distinct l_suppkey person_id, l_orderkey document_id from lineitem",
    "pairs": "select a.person_id p1, b.person_id p2, list_sort(list(distinct a.document_id)) document_ids from links a join links b on a.document_id = b.document_id and a.person_id < b.person_id group by 1, 2",
    "edges": "select p1 * 1000000 + p2 id, p1 person_id_1, p2 person_id_2, case len(document_ids) % 3 when 0 then 'business' when 1 then 'social' else 'legal' end connection_type, 'shared ' || len(document_ids) description, least(5, len(document_ids)) strength, document_ids from pairs",
    "people": "select l_orderkey k, list_sort(list(distinct l_suppkey)) person_ids from lineitem group by 1",
    "timeline": "select o_orderkey id, case when o_orderkey % 7 = 0 then strftime(o_orderdate, '%Y') when o_orderkey % 5 = 0 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end as date, o_orderpriority category, 6 - cast(o_orderpriority[1] as int) significance, coalesce(person_ids, []) person_ids from orders left join people on k = o_orderkey",
}
NEEDS = {"pairs": ["links"], "edges": ["links", "pairs"], "timeline": ["people"]}


def sql(names: str, body: str, more: str = "") -> str:
    """body with the named model tables as common table expressions."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    parts = [f"{n} as ({SQL[n]})" for n in order] + ([more] if more else [])
    return f"with {'recursive ' if 'recursive' in more else ''}{', '.join(parts).replace('recursive ', '')} {body}"
