"""Readers of files: catalogs, lists, directories and raw pages to typed rows. Malformed files are skipped, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

CATALOG = "dataSets array<struct<name:string,publicationDate:string,files:array<struct<title:string,url:string,type:string>>>>"
PERSONS = "name string, category string, occupation string, description string"
PAGES = "fileName string, text string, pages array<string>"
ANALYSIS = "fileName string, documentType string, summary string, persons array<struct<name:string,role:string,mentions:int>>, locations array<string>"


def typed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC-1. A table by its declared schema: no footer is read to infer one, and a missing column is null."""
    return spark.read.schema(schema).parquet(path)


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """One JSON document a file, or a line; what doesn't parse is left out."""
    df = spark.read.schema(f"{schema}, _corrupt string").json(path, multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return df.withColumn("_path", F.col("_metadata.file_path")).filter("_corrupt is null").drop("_corrupt")


def filled(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def catalog_files(spark: SparkSession, path: str, known: DataFrame, lines: bool = False) -> DataFrame:
    """SRC-2. (data_set, title, source_url, document_type, publication_date, tags) of every file of the nested catalogs, without urls that known has."""
    sets = _json(spark, path, CATALOG, lines).select(F.explode("dataSets").alias("s"))
    files = sets.select(F.col("s.name").alias("data_set"), F.col("s.publicationDate").alias("publication_date"), F.explode("s.files").alias("f"))
    rows = files.select("data_set", F.col("f.title").alias("title"), F.col("f.url").alias("source_url"), F.coalesce(F.nullif("f.type", F.lit("")), F.lit("document")).alias("document_type"), "publication_date", F.array_compact(F.array("data_set", F.when(F.endswith(F.lower("f.url"), F.lit(".pdf")), "pdf"))).alias("tags"))
    return rows.join(known.select("source_url").distinct(), "source_url", "left_anti")


def person_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3. Persons of JSON lines, empty fields filled with defaults, rows without a name left out."""
    p = spark.read.schema(PERSONS).json(path)
    return p.filter("trim(name) <> ''").select(F.trim("name").alias("name"), filled("category", "unknown").alias("category"), filled("occupation", "unknown").alias("occupation"), filled("description", "").alias("description"))


def data_set_of(path: Column) -> Column:
    """SRC-4, SRC-7. The number of the data set a path tells: data-set-N, DataSet N, DS-N, dsN."""
    clean = F.replace(path, F.lit("%20"), F.lit(" "))
    found = [F.nullif(F.regexp_extract(clean, p, 1), F.lit("")) for p in (r"(?i)data[- ]?set[- ]?(\d+)", r"(?i)(?:^|[/_ =-])ds-?(\d+)")]
    return F.coalesce(*found).cast("int")


def extracted_texts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC-4. file_name, text, n_pages and data_set (from the path) of a directory of extracted texts."""
    t = _json(spark, path, PAGES, lines)
    return t.select(F.col("fileName").alias("file_name"), "text", F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"), data_set_of(F.col("_path")).alias("data_set"))


def analyses(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC-5. Analyses (file_name, document_type, summary, n_persons, n_locations) and their persons (file_name, name, role, mentions)."""
    a = _json(spark, path, ANALYSIS, lines)
    head = a.select(F.col("fileName").alias("file_name"), filled("documentType", "unknown").alias("document_type"), filled("summary", "").alias("summary"), F.coalesce(F.size("persons"), F.lit(0)).alias("n_persons"), F.coalesce(F.size("locations"), F.lit(0)).alias("n_locations"))
    people = a.select(F.col("fileName").alias("file_name"), F.explode("persons").alias("p")).select("file_name", "p.name", F.coalesce("p.role", F.lit("unknown")).alias("role"), F.coalesce("p.mentions", F.lit(1)).alias("mentions"))
    return head, people


def resolved_extensions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6. file, extension of the rows of a CSV with a header whose status is "resolved", whatever the order of its columns."""
    return spark.read.csv(path, header=True, enforceSchema=False, quote='"', escape='"').filter("status = 'resolved'").select("file", "extension")


def directory(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """SRC-7. path, name, size, modified and data_set of files with one of the extensions; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.substring_index(F.replace("path", F.lit("%20"), F.lit(" ")), "/", -1)
    return f.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(extensions)).select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), data_set_of(F.col("path")).alias("data_set"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8. (name, url) by the file name as written and, where it differs, decoded."""
    u = spark.read.text(path).select(F.trim("value").alias("url")).filter("url like 'http%'")
    name = F.substring_index(F.regexp_replace("url", r"[?#].*$", ""), "/", -1)
    return u.select(F.explode(F.array_distinct(F.array(name, F.coalesce(F.try_url_decode(name), name)))).alias("name"), "url").filter("name <> ''")


def page_sections(pages: DataFrame) -> DataFrame:
    """SRC-9. Records of raw pages: page_id, number, heading (the last one before it), kind (item, row) and text of list items and table rows. Pages are split at tags, in one pass."""
    marked = F.regexp_extract_all(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", ""), F.lit(r"(?is)<(h[1-6]|li|tr)(?:\s[^>]*)?>(.*?)(?=<(?:h[1-6]|li|tr|/ul|/ol|/table)(?:\s[^>]*)?>|</(?:h[1-6]|li|tr)>)"), 0)
    rows = pages.select("page_id", F.posexplode(marked).alias("number", "part"))
    text = F.trim(F.regexp_replace(F.regexp_replace("part", r"(?s)<[^>]*>", " "), r"\s+", " "))
    rows = rows.select("page_id", "number", F.lower(F.regexp_extract("part", r"^<(\w+)", 1)).alias("tag"), text.alias("text"))
    from pyspark.sql import Window

    before = F.last(F.when(F.col("tag").startswith("h"), F.col("text")), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("number"))
    found = rows.withColumn("heading", before).filter("tag in ('li', 'tr') and text <> ''")
    return found.select("page_id", "number", F.coalesce("heading", F.lit("")).alias("heading"), F.when(F.col("tag") == "li", "item").otherwise("row").alias("kind"), "text")
