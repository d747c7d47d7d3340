"""Queries of the file readers and writers: the given tables are written in the format in question and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenarc.sources import readers as R, writers as W
from lumenarc.sources.stored import new_path

from .bindings import edges, persons, sql, table

QUERIES, ORACLE = {}, {}


def query(oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


def text_files(df: DataFrame, tag: str, per: str | None = None) -> str:
    """Writes one-column rows as text; per: one folder for each value."""
    path = new_path(df.sparkSession, tag)
    (df.write.partitionBy(per) if per else df.write).text(path)
    return path


@query("select o_custkey, count(*) n from orders group by 1")
def src1_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.typed(spark, f"{sf_dir}/orders.parquet", "o_orderkey long, o_custkey long").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("select s_name data_set, 'p' || l_partkey || '-' || l_linenumber title, 'https://files.example.org/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || case when l_linenumber % 2 = 0 then '.pdf' else '.jpg' end source_url, case when l_linenumber = 1 then 'document' else l_returnflag end document_type, '2024-01-' || (10 + s_suppkey % 10) publication_date, s_name || case when l_linenumber % 2 = 0 then ',pdf' else '' end tags from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from lineitem) join supplier on l_suppkey = s_suppkey where l_orderkey % 5 > 0")
def src2_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    url = F.concat(F.lit("https://files.example.org/"), F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))), F.when(F.col("l_linenumber") % 2 == 0, ".pdf").otherwise(".jpg"))
    rows = li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "s_suppkey", "l_orderkey", F.struct(F.concat(F.lit("p"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("title"), url.alias("url"), F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_returnflag")).alias("type")).alias("f"))
    sets = rows.groupBy("s_suppkey", F.col("s_name").alias("name"), F.concat(F.lit("2024-01-"), (F.lit(10) + F.col("s_suppkey") % 10).cast("string")).alias("publicationDate")).agg(F.collect_list("f").alias("files"))
    lines = sets.select(F.to_json(F.struct(F.array(F.struct("name", "publicationDate", "files")).alias("dataSets"))).alias("value"), (F.col("s_suppkey") % 1000).alias("part"))
    path = text_files(lines.repartition("part"), "catalog", "part")  # one file a folder, however many tasks there are
    known = rows.filter("l_orderkey % 5 = 0").select(F.col("f.url").alias("source_url"))
    return R.catalog_files(spark, path, known, lines=True).withColumn("tags", F.array_join("tags", ","))


@query("select upper(c_name) as name, case when c_custkey % 3 = 0 then 'unknown' else c_mktsegment end category, case when c_custkey % 2 = 0 then 'unknown' else 'clerk' end occupation, '' description from customer where c_custkey % 10 > 0")
def src3_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    path = new_path(spark, "persons")
    c.select(F.when(k % 10 > 0, F.concat(F.lit(" "), F.upper("c_name"))).otherwise(F.lit(" ")).alias("name"), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("category"), F.when(k % 2 > 0, "clerk").alias("occupation")).write.json(path)
    return R.person_list(spark, path)


@query("select 'f' || doc_id || '.pdf' file_name, md5(coalesce(text, '')) text, doc_id % 3 n_pages, 3 + doc_id % 4 data_set from documents where doc_id % 7 > 0")
def src4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4. Every seventh document is a broken line."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    pages = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (k % 3).cast("int"))
    line = F.to_json(F.struct(F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")).alias("fileName"), F.coalesce("text", F.lit("")).alias("text"), pages.alias("pages")))
    path = text_files(d.select(F.when(k % 7 > 0, line).otherwise(F.concat(F.lit("{"), line)).alias("value"), F.concat(F.lit("DataSet "), (3 + k % 4).cast("string")).alias("part")), "texts", "part")
    return R.extracted_texts(spark, path, lines=True).withColumn("text", F.md5(F.encode("text", "utf-8")))


ANALYSED = "an as (select o_orderkey o, case when o_orderkey % 4 = 0 then 'unknown' else o_orderstatus end t from orders), pe as (select l_orderkey o, s_name as name, case when l_linenumber % 2 = 0 then 'unknown' else l_returnflag end role, case when l_linenumber % 3 = 0 then 1 else l_linenumber end mentions from lineitem join supplier on s_suppkey = l_suppkey)"


def _analyses(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    o, li, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    p = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("s_name").alias("name"), F.when(F.col("l_linenumber") % 2 > 0, F.col("l_returnflag")).alias("role"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber")).alias("mentions"))).alias("persons"))
    rows = o.join(p, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("fileName"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("documentType"), "persons", F.array(F.lit("x"), F.lit("y")).alias("locations"))
    return R.analyses(spark, text_files(rows.select(F.to_json(F.struct("*")).alias("value")), "analyses"), lines=True)


@query(f"with {ANALYSED} select 'o' || an.o file_name, t document_type, '' summary, coalesce(n, 0) n_persons, 2 n_locations from an left join (select o, count(*) n from pe group by 1) p on p.o = an.o")
def src5_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyses(spark, sf_dir)[0]


@query(f"with {ANALYSED} select 'o' || o file_name, name, role, mentions from pe")
def src5_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyses(spark, sf_dir)[1]


@query("select p_name || ', \"' || p_partkey || '\"' file, 'e' || (p_size % 3) extension from part where p_size % 2 = 0")
def src6_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6, SNK-1: a CSV with commas and quotes, written and read."""
    p, path = table(spark, sf_dir, "part"), new_path(spark, "resolved")
    rows = p.select(F.when(F.col("p_size") % 2 == 0, "resolved").otherwise("open").alias("status"), F.concat(F.lit("e"), (F.col("p_size") % 3).cast("string")).alias("extension"), F.concat(F.col("p_name"), F.lit(', "'), F.col("p_partkey").cast("string"), F.lit('"')).alias("file"))
    W.write_csv(rows, path)
    return R.resolved_extensions(spark, path)


@query("select source data_set_name, count(*) > 0 found, cast(max(substr(source, 4)) as int) data_set from documents where source is not null group by 1")
def src7_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7. Files of one folder for each source; the folder tells the data set."""
    d = table(spark, sf_dir, "documents").filter("source is not null")
    path = text_files(d.select(F.col("lang").alias("value"), F.concat(F.lit("DS-"), F.substring("source", 4, 9)).alias("part")), "files", "part")
    f = R.directory(spark, path, ["txt"])
    return f.groupBy("data_set").agg((F.sum("size") > 0).alias("found")).select(F.concat(F.lit("src"), F.col("data_set").cast("string")).alias("data_set_name"), "found", "data_set")


@query("with u as (select page_id, regexp_replace(url, '[?#].*$', '') || '/x/a%20b' || page_id || '?q=1' url from pages) select 'a b' || page_id as name, url from u union all select 'a%20b' || page_id, url from u")
def src8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    clean = F.regexp_replace("url", r"[?#].*$", "")
    path = text_files(p.select(F.concat(clean, F.lit("/x/a%20b"), F.col("page_id").cast("string"), F.lit("?q=1")).alias("value")), "urls")
    return R.url_list(spark, path)



@query("select page_id, count(*) n from (select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<li>([^<]*<a[^>]*>[^<]+</a>|[^<]+)', 0)) from pages) group by 1")
def src9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9. List items of the raw pages."""
    s = R.page_sections(table(spark, sf_dir, "pages").select("page_id", "html"))
    return s.filter("kind = 'item'").groupBy("page_id").agg(F.count("*").alias("n"))


@query(sql("edges persons", "select cast(e.id as varchar) id, a.name person1, b.name person2, connection_type, strength from edges e join persons a on a.id = person_id_1 join persons b on b.id = person_id_2"))
def snk3_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, SNK-1. Connections with names as CSV, read back."""
    path, p = new_path(spark, "connections"), persons(spark, sf_dir)
    e = edges(spark, sf_dir).join(p.select(F.col("id").alias("person_id_1"), F.col("name").alias("person1")), "person_id_1").join(p.select(F.col("id").alias("person_id_2"), F.col("name").alias("person2")), "person_id_2")
    W.write_csv(e, path, ["id", "person1", "person2", "connection_type", "strength"])
    return spark.read.csv(path, header=True).withColumn("strength", F.col("strength").cast("int"))


@query("select c_custkey, c_name, c_mktsegment from customer where c_custkey % 2 = 0")
def snk2_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    W.write_json(table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.schema("c_custkey long, c_name string, c_mktsegment string").json(path)


@query("select source, lang, count(*) n from documents group by 1, 2")
def snk12_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12. A generated table, written and read."""
    from lumenarc.sources.stored import stored

    return stored(table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")), "dictionary")
