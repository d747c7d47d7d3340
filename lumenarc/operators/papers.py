"""Classification, ranking and export of documents: rules as columns, lookups as small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumenarc.functions.rules import Rules, first_label, media_type
from lumenarc.functions.text import MONTHS, file_name
from lumenarc.operators.dictionary import mentions, with_contexts
from lumenarc.operators.profiles import top_of
from lumenarc.sources.stored import stored

# MIME types by file extension.
MIME = {"pdf": "application/pdf", "doc": "application/msword", "txt": "text/plain", "html": "text/html", "htm": "text/html", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "mp4": "video/mp4", "mov": "video/quicktime", "mp3": "audio/mpeg", "wav": "audio/wav", "csv": "text/csv", "json": "application/json", "xml": "application/xml"}


def canonical_type(given: Column, text: Column, valid: list[str], rules: Rules, default: str, empty: str) -> Column:
    """DOC-1, DOC-2. A type of the valid list stays as it is (in lower case); else the first rule that fits what was given, then the text; else default, or empty where nothing was given."""
    low = F.lower(F.trim(given))
    ruled = F.nullif(first_label(F.concat_ws(" ", low, text), rules, ""), F.lit(""))
    return F.when(low.isin(valid), low).otherwise(F.coalesce(ruled, F.when(F.coalesce(low, F.lit("")) == "", F.lit(empty)).otherwise(F.lit(default))))


def mime_type(name: Column) -> Column:
    """DOC-10. MIME type by extension, octet-stream if unknown."""
    pairs = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def best_media(name: Column, magic: Column) -> Column:
    """DOC-11. What the leading bytes say wins over the extension."""
    return F.coalesce(magic, media_type(name))


def priority(media: Column, size: Column, data_set: Column, by_set: dict[str, int]) -> Column:
    """DOC-13. 0 for images, videos and PDFs below 10 KB; else that of the data set; else 2."""
    sets = F.create_map(*(F.lit(x) for pair in sorted(by_set.items()) for x in pair))
    return F.when(media.isin("image", "video") | ((media == "document") & (size < 10240)), 0).otherwise(F.coalesce(F.try_element_at(sets, data_set), F.lit(2)))


def classify_media(docs: DataFrame, by_set: dict[str, int], by_type: dict[str, str]) -> DataFrame:
    """DOC-12. docs (name, document_type, file_size_bytes, data_set) with media, mime, priority and analysis_status; a name without a known extension falls back to its document type. No row is looked at twice."""
    types = F.create_map(*(F.lit(x) for pair in sorted(by_type.items()) for x in pair))
    media = F.when(media_type(F.col("name")) == "other", F.coalesce(F.try_element_at(types, F.col("document_type")), F.lit("other"))).otherwise(media_type(F.col("name")))
    m = docs.withColumn("media", media).withColumn("mime", mime_type(F.col("name")))
    m = m.withColumn("priority", priority(F.col("media"), F.col("file_size_bytes"), F.col("data_set"), by_set))
    return m.withColumn("analysis_status", F.when(F.col("priority") == 0, "skipped").otherwise("pending"))


def media_histogram(classified: DataFrame) -> DataFrame:
    """DOC-12. Documents by media and status."""
    return classified.groupBy("media", "analysis_status").agg(F.count("*").alias("n"))


def longer_text(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """DOC-17. The longer of two extractions of each document; of equals the left one."""
    both = left.select(key, text, F.lit(1).alias("side")).unionByName(right.select(key, text, F.lit(0).alias("side")))
    return both.groupBy(key).agg(F.max_by(text, F.struct(F.length(text), "side")).alias(text))


def analysis_tier(length: Column, spent_before: Column, cap: float, small: int, large: int) -> Column:
    """DOC-20. Rules alone for short texts or once the budget is spent, the small model up to a length, the large one beyond."""
    return F.when((length < small) | (spent_before >= cap), 0).when(length < large, 1).otherwise(2)


def backfill_types(docs: DataFrame, analyses: DataFrame, generic: list[str]) -> DataFrame:
    """DOC-22. docs (id, document_type) whose type is generic take that of their latest analysis (document_id, seq, document_type), if it is a special one."""
    best = analyses.filter(~F.lower("document_type").isin(generic)).groupBy("document_id").agg(F.max_by("document_type", "seq").alias("new_type"))
    vague = F.coalesce(F.lower("document_type"), F.lit("")).isin([*generic, ""])
    j = docs.join(best, docs["id"] == best["document_id"], "left")
    return j.select(*(F.when(vague, F.coalesce("new_type", "document_type")).otherwise(F.col("document_type")).alias(c) if c == "document_type" else docs[c] for c in docs.columns))


def first_date(text: Column) -> Column:
    """DT-4. The first date in a text: a month name with day and year, numbers with slashes, or an ISO date."""
    months = "|".join(m.capitalize() for m in MONTHS)
    return F.nullif(F.regexp_extract(text, rf"((?:{months}) \d{{1,2}},? \d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}})", 1), F.lit(""))


def snippet(text: Column, word: str, around: int = 80) -> Column:
    """STR-14. The first place of a word, in any case, with so many characters before and behind; null if absent."""
    at = F.instr(F.lower(text), word.lower())
    begin = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substr(text, begin, at - begin + len(word) + around))


def attributes(text: Column, occupations: Rules, statuses: Rules, nationalities: list[str]) -> Column:
    """DOC-9. Struct of category, occupation, status and nationality of a person told in prose. occupations: (pattern, "category/occupation")."""
    job = first_label(text, occupations, "other/unknown")
    nation = F.regexp_extract(text, "(^|[^A-Za-z])(" + "|".join(nationalities) + ")($|[^A-Za-z])", 2)
    return F.struct(F.substring_index(job, "/", 1).alias("category"), F.substring_index(job, "/", -1).alias("occupation"), first_label(text, statuses, "named").alias("status"), F.nullif(nation, F.lit("")).alias("nationality"))


def analyze_rules(docs: DataFrame, known: DataFrame, types: Rules, places: str) -> DataFrame:
    """DOC-5. Per document (id, text): type, first date, places, a summary (the first 200 characters) and the known names it mentions, most mentioned first, ties by name, each with the context of its first mention. known: name, of any number of words."""
    named = with_contexts(mentions(docs, known), docs)
    order = F.struct((-F.col("mentions")).alias("m"), F.lower("name").alias("name"), "context")
    found = named.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: F.struct(x["name"].alias("name"), (-x["m"]).alias("mentions"), x["context"].alias("context"))).alias("persons"))
    told = docs.select("id", first_label(F.col("text"), types, "other").alias("document_type"), first_date(F.col("text")).alias("date"), F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?i)({places})"), 1)).alias("places"), F.substring("text", 1, 200).alias("summary"))
    return told.join(found, "id", "left")


def high_value(docs: DataFrame, known: DataFrame, kinds: dict[str, float], sets: dict[str, float], analysed: DataFrame, k: int) -> DataFrame:
    """DOC-19, WIN-10. The k best documents that aren't analysed yet, ranked from 1: weighted score of length, distinct known names, type and data set. docs: id, text, document_type, data_set."""
    from lumenarc.functions.text import length_score, mention_score, weighted_score

    todo = docs.join(analysed.select("id"), "id", "left_anti")
    table = lambda values, c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair)), F.col(c)), F.lit(0.0))
    words = todo.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("name"))
    n = words.join(known.select(F.lower("name").alias("name")).distinct(), "name").groupBy("id").agg(F.count("*").alias("mentions"))
    s = todo.select("id", F.length("text").alias("length"), table(kinds, "document_type").alias("kind"), table(sets, "data_set").alias("set")).join(n, "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    score = F.round(weighted_score(length_score(F.col("length")), mention_score(F.col("mentions")), F.col("kind"), F.col("set")), 6)
    best = s.select("id", "mentions", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows


def retrieved_jobs(hits: DataFrame, analysed: DataFrame, jobs: DataFrame) -> DataFrame:
    """FTS-17. New job rows for documents that were retrieved, aren't analysed and have no open job."""
    want = hits.select("document_id").distinct().join(analysed.select("document_id"), "document_id", "left_anti")
    return want.join(jobs.filter("status in ('pending', 'running')").select("document_id"), "document_id", "left_anti").withColumn("status", F.lit("pending"))


def not_loaded(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """FLT-13. Rows of new whose key, without ".pdf" and in any case, no row of old has."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\.pdf$", "")
    return new.join(old.select(plain(key).alias("had")).distinct(), plain(new[key]) == F.col("had"), "left_anti")


def not_mentioned(new: DataFrame, old: DataFrame, key: str, within: list[str]) -> DataFrame:
    """FLT-13 by substring. Rows of new whose key, without ".pdf" and in any case, is in no text of old's columns within."""
    from .containment import contained

    plain = F.regexp_replace(F.lower(key), r"\.pdf$", "")
    texts = old.select(F.explode(F.array_compact(F.array(*(F.lower(c) for c in within)))).alias("text")).distinct().select(F.xxhash64("text").alias("text_id"), "text")
    had = contained(new.select(plain.alias("needle_id"), plain.alias("needle")).distinct(), texts).select(F.col("needle_id").alias("_had")).distinct()
    return new.join(had, plain == F.col("_had"), "left_anti")


def storage_key(url: Column, data_set: Column) -> Column:
    """PRJ-5. Key of a file in a store: its data set and the decoded last part of the url's path."""
    return F.concat_ws("/", F.concat(F.lit("data-set-"), F.regexp_extract(data_set, r"(?i)data-?set(?:%20|[ -])?(\d+)", 1)), F.replace(F.substring_index(F.regexp_replace(url, r"[?#].*$", ""), "/", -1), F.lit("%20"), F.lit(" ")))


def public_rows(docs: DataFrame, internal: list[str], key: str, base: str) -> DataFrame:
    """SNK-10. docs without internal columns, with public_url where there is a key."""
    return docs.withColumn("public_url", F.when(F.col(key).isNotNull(), F.concat(F.lit(base), F.col(key)))).drop(*internal)


def index_rows(pages: DataFrame, docs: DataFrame, content: int = 50_000, description: int = 10_000) -> DataFrame:
    """SNK-9. Rows for a search index: contents and descriptions cut, and whether the document can be shown. pages: document_id, page, content; docs: id, title, description, key."""
    d = docs.select(F.col("id").alias("document_id"), "title", F.substring("description", 1, description).alias("description"), F.col("key").isNotNull().alias("is_viewable"))
    return pages.withColumn("content", F.substring("content", 1, content)).join(d, "document_id")


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-5. Nodes and links of a graph as JSON lines: kind, id, line."""
    node = nodes.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct("id", "name")).alias("line"))
    link = edges.select(F.lit("link").alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(F.col("person_id_1").alias("source"), F.col("person_id_2").alias("target"), F.col("connection_type").alias("type"))).alias("line"))
    return node.unionByName(link)


def vault_notes(persons: DataFrame, events: DataFrame, edges: DataFrame, docs: DataFrame | None = None, links: DataFrame | None = None, most_documents: int = 50) -> DataFrame:
    """SNK-8. (path, content): a Markdown note for each person, event, connection and, where docs and links (person_id, document_id) are given, document, with front matter and links to related notes; a person's note then names its first most_documents documents and how many more there are. docs: id, title, document_type, data_set; persons: id, name, category; events: id, date, title, person_ids; edges: id, person_id_1, person_id_2, connection_type, description."""
    names = stored(persons.select(F.col("id").alias("pid"), file_name(F.col("name")).alias("note")), "names")  # five joins read it; by its size Spark sends it to the tasks where it can
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    front = lambda *pairs: F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{k}: "), v) for k, v in pairs), F.lit("---"))
    link = lambda c: F.concat(F.lit("[["), c, F.lit("]]"))
    bullets = lambda a: F.array_join(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), link(x))), "\n")
    # Written once, with the names of both ends: people and connections read it. Ends without a person stay apart from those whose name is null.
    end = lambda k, to: names.select(F.col("pid").alias(f"person_id_{k}"), F.col("note").alias(to), F.lit(True).alias(f"has_{to}"))
    ties = stored(edges.select("id", "person_id_1", "person_id_2", "connection_type", "description").join(end(1, "a"), "person_id_1", "left").join(end(2, "b"), "person_id_2", "left"), "ties")
    ends = ties.filter("has_b").select(F.col("person_id_1").alias("me"), F.col("b").alias("note")).unionByName(ties.filter("has_a").select(F.col("person_id_2").alias("me"), F.col("a").alias("note")))
    near = ends.groupBy("me").agg(F.sort_array(F.collect_set("note")).alias("near"))
    lines = bullets(F.col("near"))
    people_of = persons.join(near, F.col("id") == F.col("me"), "left")
    if docs is not None and links is not None:
        # Written once: links to other documents go no further.
        titles = stored(links.select("person_id", "document_id").distinct().join(docs.select(F.col("id").alias("document_id"), file_name(F.col("title")).alias("title")), "document_id"), "titles")
        n = titles.groupBy("person_id").agg(F.count("*").alias("n_papers"))
        first = top_of(titles, "person_id", [F.asc("document_id")], most_documents).groupBy("person_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("papers")).join(n, "person_id")
        people_of = people_of.join(first, F.col("id") == F.col("person_id"), "left")
        more = F.when(F.col("n_papers") > most_documents, F.concat(F.lit("- and "), (F.col("n_papers") - most_documents).cast("string"), F.lit(" more")))
        lines = F.concat_ws("\n", lines, F.when(F.col("papers").isNotNull(), F.concat_ws("\n", F.lit("## Related documents"), bullets(F.col("papers")), more)))
    person = people_of.select(F.concat(F.lit("People/"), file_name(F.col("name")), F.lit(".md")).alias("path"), F.concat_ws("\n", front(("type", F.lit("person")), ("name", quoted("name")), ("category", quoted("category"))), F.concat(F.lit("# "), F.col("name")), lines).alias("content"))
    people = events.select(F.col("id").alias("eid"), F.explode("person_ids").alias("pid")).join(names, "pid").groupBy("eid").agg(F.sort_array(F.collect_set("note")).alias("who"))
    event = events.join(people, F.col("id") == F.col("eid"), "left").select(F.concat(F.lit("Events/"), file_name(F.concat_ws(" ", "date", "title", F.col("id").cast("string"))), F.lit(".md")).alias("path"), F.concat_ws("\n", front(("type", F.lit("event")), ("date", quoted("date"))), F.concat(F.lit("# "), F.col("title")), bullets(F.col("who"))).alias("content"))
    e = ties.filter("has_a and has_b")
    tie = e.select(F.concat(F.lit("Connections/"), file_name(F.concat_ws(" - ", "a", "b")), F.lit(" "), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.concat_ws("\n", front(("type", F.lit("connection")), ("kind", quoted("connection_type"))), F.concat_ws(" and ", link(F.col("a")), link(F.col("b"))), F.col("description")).alias("content"))
    notes = [person, event, tie]
    if docs is not None and links is not None:
        named = titles.select(F.col("person_id").alias("pid"), F.col("document_id").alias("did")).join(names, "pid").groupBy("did").agg(F.sort_array(F.collect_set("note")).alias("who"))
        notes.append(docs.join(named, F.col("id") == F.col("did"), "left").select(F.concat(F.lit("Documents/"), file_name(F.col("title")), F.lit(".md")).alias("path"), F.concat_ws("\n", front(("type", F.lit("document")), ("title", quoted("title")), ("kind", quoted("document_type")), ("set", quoted("data_set"))), F.concat(F.lit("# "), F.col("title")), bullets(F.col("who"))).alias("content")))
    return reduce(DataFrame.unionByName, notes)


