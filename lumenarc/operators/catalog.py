"""Operators on catalogs, files, bookmarks, analyses and their links: joins and aggregations over whole tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenarc.sources.stored import stored


def camel_names(df: DataFrame) -> DataFrame:
    """PRJ-2. snake_case columns to camelCase."""
    return df.withColumnsRenamed({c: re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), c) for c in df.columns})


def snake_names(df: DataFrame) -> DataFrame:
    """PRJ-2. camelCase columns to snake_case."""
    return df.withColumnsRenamed({c: re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), c) for c in df.columns})


def external_id(text: Column, pattern: str) -> Column:
    """PRJ-4. The external id in a title or url, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def by_external_id(files: DataFrame, file_name: str, docs: DataFrame, doc_text: str, pattern: str, doc_id: str = "id") -> DataFrame:
    """JN-10. files with document_id, the lowest document of the same external id, else of those whose text contains the file's name (without .json or .pdf, in any case) the lowest; null where there is none."""
    from .containment import contained

    ids = docs.groupBy(external_id(F.col(doc_text), pattern).alias("_x")).agg(F.min(doc_id).alias("_same")).filter("_x is not null")
    first = stored(files.join(ids, external_id(F.col(file_name), pattern) == F.col("_x"), "left").drop("_x").withColumn("_name", F.regexp_replace(F.lower(file_name), r"\.(json|pdf)$", "")), "files")
    needles = first.filter("_same is null").select(F.col("_name").alias("needle_id"), F.col("_name").alias("needle")).distinct()
    lowest = contained(needles, docs.select(F.col(doc_id).alias("text_id"), F.lower(doc_text).alias("text"))).groupBy(F.col("needle_id").alias("_name")).agg(F.min("text_id").alias("_within"))
    return first.join(lowest, "_name", "left").withColumn("document_id", F.coalesce("_same", "_within")).drop("_same", "_within", "_name")


def patch_catalog(catalog: DataFrame, found: DataFrame, known_sets: DataFrame, key: str = "url") -> DataFrame:
    """JN-15. catalog (url, data_set, file_type) with the rows of found: a matched url is patched, a new one of a known data set added, any other skipped."""
    both = catalog.alias("c").join(found.alias("f"), key, "full").join(known_sets.select(F.col("data_set").alias("_set"), F.lit(True).alias("_known")).distinct(), F.col("f.data_set") == F.col("_set"), "left")
    old, new = F.col("c.data_set").isNotNull(), F.col("f.data_set").isNotNull()
    status = F.when(old & new, "patched").when(old, "kept").when(F.col("_known"), "added").otherwise("skipped")
    return both.select(key, F.coalesce("c.data_set", "f.data_set").alias("data_set"), F.coalesce("f.file_type", "c.file_type").alias("file_type"), status.alias("status"))


def merge_catalog(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SET-5. old and the rows of new whose key it hasn't, one a key."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return old.unionByName(fresh, allowMissingColumns=True)


def resolve_bookmarks(bookmarks: DataFrame, persons: DataFrame, documents: DataFrame) -> DataFrame:
    """JN-14. bookmarks (entity_type, entity_id, search_query) with a label: the person's name, the document's title or the search; null if the target is gone."""
    targets = persons.select(F.lit("person").alias("entity_type"), F.col("id").alias("entity_id"), F.col("name").alias("_l")).unionByName(documents.select(F.lit("document").alias("entity_type"), F.col("id").alias("entity_id"), F.col("title").alias("_l")))
    return bookmarks.join(targets, ["entity_type", "entity_id"], "left").withColumn("label", F.when(F.col("entity_type") == "search", F.col("search_query")).otherwise(F.col("_l"))).drop("_l")


def with_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """AGG-22. usage (model, tokens) with cost in cents, rounded up to the next whole one; prices: (model, cents_per_million)."""
    return usage.join(prices, "model", "left").withColumn("cost_cents", F.ceil(F.col("tokens") * F.col("cents_per_million") / F.lit(1e6)).cast("long"))


def merge_chunks(rows: DataFrame, doc: str, key: str) -> DataFrame:
    """AGG-19. Results of a document's chunks as one: mentions summed, the longest context (the earliest chunk's among equals, then the greatest text), the highest confidence. rows: doc, key, chunk, mentions, context, confidence."""
    return rows.groupBy(doc, key).agg(F.sum("mentions").alias("mentions"), F.max_by("context", F.struct(F.length("context"), -F.col("chunk"), "context")).alias("context"), F.max("confidence").alias("confidence"))


def chunks(parts: Column, size: int, between: str = "\n") -> Column:
    """DOC-15. Parts packed greedily, in order, into chunks of at most size characters; a longer part is a chunk of its own. No shuffle: an array holds one document."""
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))
    start = state(F.array().cast("array<string>"), F.lit(None).cast("string"))

    def add(s: Column, p: Column) -> Column:
        fits = F.length(s["cur"]) + len(between) + F.length(p) <= size
        return F.when(s["cur"].isNull(), state(s["done"], p)).when(fits, state(s["done"], F.concat(s["cur"], F.lit(between), p))).otherwise(state(F.array_append(s["done"], s["cur"]), p))

    return F.aggregate(parts, start, add, lambda s: F.when(s["cur"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["cur"])))


def chunk_text(text: Column, size: int, heading: str = r"Page \d+\s") -> Column:
    """DOC-15. A text cut before its page headings, packed into chunks that together are the text; null stays null."""
    return chunks(F.split(text, f"(?={heading})"), size, "")


def poor_text(text: Column, pages: Column, each: int = 50, single: int = 20) -> Column:
    """DOC-16. Whether a text has too few characters for its pages; a document of one page or none has a limit of its own."""
    chars = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(F.coalesce(pages, F.lit(0)) <= 1, chars < single).otherwise(chars / pages < each)


def above_percentile(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """WIN-9. Rows above the value at index floor(n * share) of the sorted values, exactly."""
    from .containment import value_at

    cut = value_at(rows, value, share).withColumnRenamed(value, "_cut")
    return rows.join(F.broadcast(cut), F.col(value) > F.col("_cut")).select(key, value)  # one row


def mentions(texts: DataFrame, text_id: str, text: str, names: DataFrame, name_id: str, name: str, most_words: int = 3) -> DataFrame:
    """JN-12, DOC-5. (text_id, name_id, n): how often each text mentions each name as whole words. Texts are cut into runs of as many words as names have, combined per text, and joined by equality: no text meets all names."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    known = names.select(name_id, words(F.col(name)).alias("_w")).filter(F.size("_w").between(1, most_words)).select(name_id, F.array_join("_w", " ").alias("_gram")).distinct()
    w = F.col("_w")

    def runs(n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    grams = texts.select(text_id, words(F.col(text)).alias("_w")).select(text_id, F.explode(F.concat(*map(runs, range(1, most_words + 1)))).alias("_gram"))
    return grams.join(known, "_gram").groupBy(text_id, name_id).agg(F.count("*").alias("n"))


def edges_from_mentions(rows: DataFrame, persons: DataFrame) -> DataFrame:
    """GR-7. rows (document_id, name_a, name_b, connection_type): both names resolved, self links dropped, for each unordered pair the first row's type and all documents."""
    ids = persons.groupBy(F.lower("name").alias("_name")).agg(F.min("id").alias("_id"))
    a, b = ids.toDF("_na", "_a"), ids.toDF("_nb", "_b")
    found = rows.join(a, F.lower("name_a") == F.col("_na")).join(b, F.lower("name_b") == F.col("_nb")).filter("_a <> _b")
    return found.groupBy(F.least("_a", "_b").alias("person_id_1"), F.greatest("_a", "_b").alias("person_id_2")).agg(F.min_by("connection_type", F.struct("document_id", "connection_type")).alias("connection_type"), F.sort_array(F.collect_set("document_id")).alias("document_ids"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DML-7. The last row of each key; combined on the map side."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def replace_children(old: DataFrame, parents: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """DML-7. Child rows after their parents were written anew: all old rows of the parents go, those without new rows included. A key that is null is no key."""
    return old.join(parents.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_entities(rows: DataFrame) -> DataFrame:
    """DML-8. Entities alike in lower-case name and type: first name, longest description, all attribute names with their last values. rows: seq, name, entity_type, description, attributes (map)."""
    keyed = rows.withColumn("_k", F.lower("name"))
    base = keyed.groupBy("_k", "entity_type").agg(F.min_by("name", "seq").alias("name"), F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"))
    values = keyed.select("_k", "entity_type", "seq", F.explode("attributes").alias("_a", "_v")).groupBy("_k", "entity_type", "_a").agg(F.max_by("_v", "seq").alias("_v"))
    attributes = values.groupBy("_k", "entity_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_a", "_v")))).alias("attributes"))
    return base.join(attributes, ["_k", "entity_type"], "left").drop("_k")


def new_links(found: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """DML-9. Distinct links that aren't there yet."""
    return found.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")


def import_files(files: DataFrame, docs: DataFrame, key: str = "url") -> DataFrame:
    """DML-13. files (url, local_path) against docs (url, local_path): action new, fill (the path was missing) or none. key: the column of both that tells files apart, if several have one url."""
    d = docs.select(key, F.col("local_path").alias("_old"), F.lit(True).alias("_there"))
    action = F.when(F.col("_there").isNull(), "new").when(F.col("_old").isNull(), "fill").otherwise("none")
    return files.join(d, key, "left").select("url", F.coalesce("_old", "local_path").alias("local_path"), action.alias("action"))


def distinct_by_size(files: DataFrame) -> DataFrame:
    """DOC-18. One file for each (data_set, name, size), named apart by a number where sizes differ. files: data_set, name, size, path."""
    one = files.groupBy("data_set", "name", "size").agg(F.min("path").alias("path"))
    n = F.row_number().over(Window.partitionBy("data_set", "name").orderBy("size", "path"))
    return one.withColumn("_n", n).withColumn("stored_name", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def without_placeholders(files: DataFrame, sizes: Mapping[str, Sequence[int]]) -> DataFrame:
    """DOC-18. files without those whose exact size is a placeholder's in their data set. sizes: data set to the sizes of its placeholders; a null data set or size is no placeholder's."""
    held = [(F.col("data_set") == name) & F.col("size").isin(*of) for name, of in sorted(sizes.items()) if of]
    return files.filter(~F.coalesce(reduce(Column.__or__, held), F.lit(False))) if held else files


def page_kind(page_type: Column, document_type: Column, default: str = "unclassified") -> Column:
    """DOC-21. A page's type; where it is other or missing, its document's, else the default."""
    return F.coalesce(F.nullif(page_type, F.lit("other")), document_type, F.lit(default))
