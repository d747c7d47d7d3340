"""Table rewrites: upserts, id remaps and deletes as joins and aggregations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """DML-1. By lower-case key: a new value that isn't empty wins, else the old one stays."""
    o, n = old.withColumn("_k", F.lower(key)), new.withColumn("_k", F.lower(key))
    pick = [F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c) for c in columns]
    return o.alias("o").join(n.alias("n"), "_k", "full").select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), *pick)


def merge_events(events: DataFrame) -> DataFrame:
    """DML-3. Events alike in date and lower-case title: longest description, last category, highest significance, union of documents and, where given, of persons. events: seq, date, title, description, category, significance, document_ids, person_ids."""
    rows = events.withColumn("_t", F.lower("title"))
    lists = rows.groupBy("date", "_t").agg(F.min_by("title", "seq").alias("title"), F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"), F.max_by("category", "seq").alias("category"), F.max("significance").alias("significance"))
    out = lists
    for c in [c for c in ("document_ids", "person_ids") if c in events.columns]:
        ids = rows.select("date", "_t", F.explode(c).alias("d")).groupBy("date", "_t").agg(F.sort_array(F.collect_set("d")).alias(c))
        out = out.join(ids, ["date", "_t"], "left")
    return out.drop("_t")


def remap_edges(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """DML-4. Edges with both ends mapped (dup_id → canonical_id), without self loops, the strongest for each unordered pair and type, documents united."""
    m = lambda c, n: id_map.select(F.col("dup_id").alias(c), F.col("canonical_id").alias(n))
    mapped = edges.join(m("person_id_1", "_a"), "person_id_1", "left").join(m("person_id_2", "_b"), "person_id_2", "left")
    ends = mapped.withColumn("person_id_1", F.coalesce("_a", "person_id_1")).withColumn("person_id_2", F.coalesce("_b", "person_id_2")).drop("_a", "_b").filter("person_id_1 <> person_id_2")
    pair = [F.least("person_id_1", "person_id_2").alias("person_id_1"), F.greatest("person_id_1", "person_id_2").alias("person_id_2"), "connection_type"]
    keys = ["person_id_1", "person_id_2", "connection_type"]
    docs = ends.select(*pair, F.explode("document_ids").alias("_d")).groupBy(*keys).agg(F.sort_array(F.collect_set("_d")).alias("document_ids"))
    best = ends.groupBy(*pair).agg(F.min("id").alias("id"), F.max("strength").alias("strength"))
    return best.join(docs, keys, "left").withColumn("document_ids", F.coalesce("document_ids", F.array().cast(edges.schema["document_ids"].dataType)))


def delete_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """DML-5. Rows whose column isn't one of the ids; nulls stay."""
    return rows.join(ids.select(ids.columns[0]).distinct().toDF("_gone"), F.col(column) == F.col("_gone"), "left_anti")


def delete_members(rows: DataFrame, key: str, arrays: str, ids: DataFrame) -> DataFrame:
    """DML-5. Array members that are deleted ids are taken out, order kept."""
    at = rows.select(key, F.posexplode(arrays).alias("_p", "_v"))
    kept = delete_ids(at, ids, "_v").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"]).alias("_left"))
    return rows.join(kept, key, "left").withColumn(arrays, F.coalesce("_left", F.array().cast(rows.schema[arrays].dataType))).drop("_left")


def fill_unknown(persons: DataFrame, mentions: DataFrame) -> DataFrame:
    """DML-2. Role where it is unknown: that of most mentions. persons: name, role; mentions: name, role, n."""
    best = mentions.groupBy("name", "role").agg(F.sum("n").alias("n")).groupBy("name").agg(F.max_by("role", F.struct("n", "role")).alias("_best"))
    return persons.join(best, "name", "left").withColumn("role", F.when(F.coalesce("role", F.lit("unknown")) == "unknown", F.coalesce("_best", "role")).otherwise(F.col("role"))).drop("_best")


def missing_jobs(docs: DataFrame, jobs: DataFrame, priority) -> DataFrame:  # noqa: ANN001
    """DML-10. A job for each document without an open one. docs: id, data_set; jobs: document_id, status."""
    is_open = jobs.filter(F.col("status").isin("pending", "processing")).select(F.col("document_id").alias("id")).distinct()
    return docs.join(is_open, "id", "left_anti").select(F.col("id").alias("document_id"), F.lit("pending").alias("status"), priority.alias("priority"))


def tag_rows(docs: DataFrame, urls: DataFrame, column: str, tag: str) -> DataFrame:
    """DML-12, ARR-1. Adds a tag to the rows of a url list, once."""
    listed = urls.select(F.col(urls.columns[0]).alias(column)).distinct().withColumn("_hit", F.lit(True))
    return docs.join(listed, column, "left").withColumn("tags", F.when(F.col("_hit"), F.array_distinct(F.concat("tags", F.array(F.lit(tag))))).otherwise(F.col("tags"))).drop("_hit")
