"""What is known of each person, for all persons at once: one pass over the analysed mentions instead of one scan a person.

Model: analyses (analysis_id, document_id, document_type, facts array, locations array, events array), mentions (analysis_id, name, role, category,
context, mentions), persons (id, name, aliases).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lumenarc.functions.text import normalize_name
from lumenarc.sources.stored import stored


def rolled_names(mentions: DataFrame, k: int = 1500) -> DataFrame:
    """AGG-15, WIN-2, JN-7. The k names with most mentions: name, mentions, documents (distinct), and the role and category with most mentions ("Unknown" if none), ties to the greater text."""
    of = lambda c: mentions.filter(F.col(c).isNotNull() & (F.col(c) != "")).groupBy("name", c).agg(F.sum("mentions").alias("n")).groupBy("name").agg(F.max_by(c, F.struct("n", c)).alias(c))
    total = mentions.groupBy("name").agg(F.sum("mentions").alias("mentions"), F.count_distinct("document_id").alias("documents"))
    top = total.orderBy(F.desc("mentions"), "name").limit(k)
    return top.join(of("role"), "name", "left").join(of("category"), "name", "left").select("name", "mentions", "documents", F.coalesce("role", F.lit("Unknown")).alias("role"), F.coalesce("category", F.lit("Unknown")).alias("category"))


def spoken_names(persons: DataFrame) -> DataFrame:
    """(person_id, norm, name): the normalised name and aliases of each person."""
    every = persons.select(F.col("id").alias("person_id"), "name", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), normalize_name))).alias("norm"))
    return every.filter("norm <> ''")


def spellings(names: DataFrame, said: DataFrame) -> DataFrame:
    """(said, person_id, name): each distinct text of the column said with the persons whose normalised names it has. Texts are normalised once each, however often they are said; written once, so that joins know its size."""
    # Written before they are normalised: the optimizer would else test the normal form of every row below the distinct.
    norm = stored(said.select("said").distinct(), "said").withColumn("norm", normalize_name(F.col("said")))
    return stored(norm.join(names, "norm").select("said", "person_id", "name"), "spellings")


def name_hits(spelled: DataFrame, mentions: DataFrame) -> DataFrame:
    """(person_id, name, analysis_id, n, mentions): one row for each person that an analysis mentions under any of its names. Ids and counts only: lists of an analysis are joined where they are needed, line by line."""
    said = mentions.select("analysis_id", "mentions", F.col("name").alias("said")).join(spelled, "said")
    return said.groupBy("person_id", "analysis_id").agg(F.min("name").alias("name"), F.count("*").alias("n"), F.sum("mentions").alias("mentions"))


def analysis_lines(analyses: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(analysis_id, kind, line, low): the lists of each analysis, cut into lines once, before any person meets them. kinds: column to name of the kind; equal places of one analysis are one row. Null lines are dropped. No shuffle."""
    tagged = lambda c, k: F.transform(F.coalesce(F.array_distinct(c) if k == "place" else F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("line")))
    rows = analyses.select("analysis_id", F.explode(F.concat(*(tagged(c, k) for c, k in kinds.items()))).alias("x")).select("analysis_id", "x.*").filter("line is not null")
    return rows.withColumn("low", F.lower("line"))


def person_mentions(persons: DataFrame, mentions: DataFrame, analyses: DataFrame, most_documents: int = 200) -> DataFrame:
    """JN-8, AGG-12. Per person: mentions summed, distinct facts that hold the name, distinct locations of its documents, and the documents with most mentions (most_documents at the most, which is what a page shows)."""
    # Written once: two joins read each.
    analyses = stored(analyses.select("analysis_id", "document_id", "facts", "locations"), "analyses")
    hits = stored(name_hits(spellings(spoken_names(persons), mentions.select(F.col("name").alias("said"))), mentions), "hits")
    with_doc = hits.join(analyses.select("analysis_id", "document_id"), "analysis_id").groupBy("person_id", "document_id").agg(F.sum("mentions").alias("mentions"))
    per_doc = stored(with_doc, "per_document")
    total = per_doc.groupBy("person_id").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("n_documents"))
    lines = hits.select("person_id", "name", "analysis_id").join(analysis_lines(analyses, {"facts": "fact", "locations": "place"}), "analysis_id").filter((F.col("kind") == "place") | F.contains("low", F.lower("name"))).select("person_id", "kind", "line").distinct()
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("line"))))
    told = lines.groupBy("person_id").agg(*(F.when(F.size(of(k)) > 0, of(k)).alias(c) for c, k in (("facts", "fact"), ("locations", "place"))))
    docs = top_of(per_doc, "person_id", [F.desc("mentions"), F.asc("document_id")], most_documents).groupBy("person_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("mentions")).alias("m"), "document_id"))), lambda x: x["document_id"]).alias("documents"))
    return total.join(told, "person_id", "left").join(docs, "person_id", "left")


def top_of(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """WIN-10 within keys: the first k rows of each key. Spark cuts to k in each task before the shuffle."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def profiles(persons: DataFrame, mentions: DataFrame, analyses: DataFrame, legal: str, most: int = 10) -> DataFrame:
    """AGG-20, DOC-23. person_id and its sections in order, numbered from 1 without gaps: (number, title, lines). Sections without lines are left out, each holds `most` lines at the most.

    legal: the pattern of facts that have a section of their own, an input. Where analyses have connections (array of struct<person1, person2, description>), the descriptions of those that name the person at either end are a section."""
    names = spoken_names(persons)
    analyses = stored(analyses, "analyses")  # five joins read it
    spelled = spellings(names, mentions.select(F.col("name").alias("said")))
    hits = stored(name_hits(spelled, mentions), "hits")  # three joins read it
    said = mentions.join(analyses.select("analysis_id"), "analysis_id", "left_semi").groupBy(F.col("name").alias("said"), "role", "context").agg(F.sum("mentions").alias("mentions")).join(spelled, "said")
    said = stored(said.select("person_id", "role", "context", "mentions"), "said")
    kind = F.when(F.col("kind") != "fact", F.col("kind")).when(F.col("low").rlike(legal), "legal").otherwise("fact")
    lines = analysis_lines(analyses, {"facts": "fact", "locations": "place", "events": "event"}).withColumn("kind", kind)
    meets = hits.join(lines, "analysis_id").filter(~F.col("kind").isin("fact", "legal") | F.contains("low", F.lower("name")))
    # A place counts once an analysis, facts and events as often as they are told and the person is mentioned.
    weight = F.when(F.col("kind") == "place", F.lit(1)).otherwise(F.col("n"))
    counted = meets.groupBy("person_id", "kind", "line").agg(F.sum(weight).alias("weight"))
    titles = F.create_map(*(F.lit(x) for k, at, title in (("fact", 3, "Key facts"), ("legal", 4, "Legal"), ("place", 5, "Places"), ("event", 6, "Events")) for x in (k, f"{at}:{title}")))
    at = F.split(titles[F.col("kind")], ":", 2)
    line = lambda title, n, df: df.select("person_id", F.lit(n).alias("at"), F.lit(title).alias("title"), "line", "weight")
    documents = hits.join(analyses.select("analysis_id", "document_id", "document_type"), "analysis_id").select("person_id", "document_type", "document_id").distinct().groupBy("person_id", "document_type").agg(F.count("*").alias("weight"))
    rows = counted.select("person_id", at[0].cast("int").alias("at"), at[1].alias("title"), "line", "weight")
    parts = [
        line("Roles", 1, said.filter("role is not null").groupBy("person_id", F.col("role").alias("line")).agg(F.sum("mentions").alias("weight"))),
        line("Background", 2, said.filter("context is not null").select("person_id", F.col("context").alias("line")).distinct().withColumn("weight", F.length("line").cast("long"))),
        line("Documents", 7, documents.withColumn("line", F.concat_ws(": ", "document_type", F.col("weight").cast("string")))),
    ]
    if "connections" in analyses.columns:
        parts.append(line("Connections", 8, connection_lines(names, hits, analyses)))
    for df in parts:
        rows = rows.unionByName(df)
    ranked = top_of(rows.withColumn("key", F.concat_ws(":", "person_id", "at")), "key", [F.desc("weight"), F.asc("line")], most)
    sections = ranked.groupBy("person_id", "at", "title").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    whole = sections.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("at", "title", "lines"))).alias("s"))
    return whole.select("person_id", F.posexplode("s").alias("at", "s")).select("person_id", (F.col("at") + 1).alias("number"), "s.title", "s.lines")


def connection_lines(names: DataFrame, hits: DataFrame, analyses: DataFrame) -> DataFrame:
    """(person_id, line, weight): descriptions of the connections that name a person at either end, in analyses that mention the person, and how many connections say so. A connection of a person with itself counts once; empty descriptions are none."""
    told = analyses.select("analysis_id", F.posexplode("connections").alias("pos", "c")).filter("c.description <> ''")
    ends = told.select("analysis_id", "pos", F.col("c.description").alias("line"), F.explode(F.array("c.person1", "c.person2")).alias("said"))
    of = ends.join(spellings(names, ends), "said").select("person_id", "analysis_id", "pos", "line").distinct()
    return of.join(hits.select("person_id", "analysis_id"), ["person_id", "analysis_id"], "left_semi").groupBy("person_id", "line").agg(F.count("*").alias("weight"))


def dashboard(mentions: DataFrame, edges: DataFrame, analyses: DataFrame, k: int = 20) -> DataFrame:
    """AGG-13. Tall (section, key, n): the k persons with most mentions, connection types, document types (null counts as "unknown"), totals."""
    tall = lambda section, df, key: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col("n").cast("long").alias("n"))
    people = mentions.groupBy("name").agg(F.sum("mentions").alias("n")).orderBy(F.desc("n"), "name").limit(k)
    kinds = edges.groupBy("connection_type").agg(F.count("*").alias("n"))
    types = analyses.groupBy(F.coalesce("document_type", F.lit("unknown")).alias("document_type")).agg(F.count("*").alias("n"))
    totals = analyses.agg(F.count("*").alias("analyses")).crossJoin(mentions.agg(F.count("*").alias("mentions"))).unpivot([], ["analyses", "mentions"], "key", "n")  # one row each
    return tall("person", people, "name").unionByName(tall("connection", kinds, "connection_type")).unionByName(tall("document", types, "document_type")).unionByName(tall("total", totals, "key"))


def document_details(docs: DataFrame, links: DataFrame, persons: DataFrame) -> DataFrame:
    """JN-2. Each document with its persons, by name."""
    people = links.join(persons.select(F.col("id").alias("person_id"), "name"), "person_id").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("name", "person_id"))).alias("persons"))
    return docs.join(people, docs["id"] == people["document_id"], "left").drop("document_id")


def enrich(persons: DataFrame, mentions: DataFrame, upgrades: list[str]) -> DataFrame:
    """DML-2. persons with role and category filled where they were unknown (most mentions win), the longer description, and the status moved up where a mention's status stands later in upgrades."""
    level = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, upgrades)), c), F.lit(0))
    unknown = lambda c: F.coalesce(F.lower(F.col(c)), F.lit("")).isin("", "unknown")
    best = lambda c: F.max_by(c, F.when(~unknown(c), F.struct(F.col("mentions"), F.col(c)))).alias(f"new_{c}")
    found = mentions.groupBy(F.lower("name").alias("low")).agg(best("role"), best("category"), F.max_by("context", F.struct(F.length("context"), F.col("context"))).alias("new_description"), F.max_by("status", level(F.col("status"))).alias("new_status"))
    j = persons.join(found, F.lower(persons["name"]) == F.col("low"), "left")
    fill = lambda c: F.when(unknown(c), F.coalesce(f"new_{c}", c)).otherwise(F.col(c))
    changed = {"role": fill("role"), "category": fill("category"), "description": F.when(F.coalesce(F.length("new_description"), F.lit(0)) > F.coalesce(F.length("description"), F.lit(0)), F.col("new_description")).otherwise(F.col("description")), "status": F.when(level(F.col("new_status")) > level(F.col("status")), F.col("new_status")).otherwise(F.col("status"))}
    return j.select(*(changed.get(c, F.col(c)).alias(c) for c in persons.columns))


def merged_items(chunks: DataFrame) -> DataFrame:
    """AGG-19, WIN-4. Per document: entities of all chunks by (name in any case, type) with attributes united, later chunks winning; facts and locations once each in any case, events once each, at their first place; summaries joined in chunk order; where chunks have connections, the first of each unordered pair and type, in order.

    chunks: document_id, chunk, entities array<struct<name,type,attributes map>>, facts, locations, events (arrays), summary, connections array<struct<person1,person2,type,description>>."""
    e = chunks.select("document_id", "chunk", F.posexplode("entities").alias("pos", "e")).select("document_id", "chunk", "pos", F.lower("e.name").alias("key"), "e.name", "e.type", "e.attributes")
    one = e.groupBy("document_id", "key", "type").agg(F.min_by("name", F.struct("chunk", "pos")).alias("name"), F.min(F.struct("chunk", "pos")).alias("at"))
    values = e.select("document_id", "key", "type", "chunk", "pos", F.explode("attributes").alias("k", "v")).groupBy("document_id", "key", "type", "k").agg(F.max_by("v", F.struct("chunk", "pos")).alias("v"))
    maps = values.groupBy("document_id", "key", "type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    entities = one.join(maps, ["document_id", "key", "type"], "left").groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name", "type", F.map_entries("attributes").alias("a")))), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), F.map_from_entries(x["a"]).alias("attributes"))).alias("entities"))

    def firsts(c: str, key) -> DataFrame:  # noqa: ANN001
        at = F.struct("chunk", "pos")
        rows = chunks.select("document_id", "chunk", F.posexplode(c).alias("pos", "x")).withColumn("key", key(F.col("x"))).groupBy("document_id", "key").agg(F.min(at).alias("at"), F.min_by("x", at).alias("x"))
        return rows.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda y: y["x"]).alias(c))

    out = chunks.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "summary"))), lambda x: x["summary"]), " ").alias("summary"))
    # The ends in either order are one connection; an absent end or type is like an empty one.
    pair = lambda c: F.struct(F.sort_array(F.array(F.coalesce(c["person1"], F.lit("")), F.coalesce(c["person2"], F.lit("")))).alias("ends"), F.coalesce(c["type"], F.lit("")).alias("type"))
    keys = {"facts": F.lower, "locations": F.lower, "events": lambda x: x} | ({"connections": pair} if "connections" in chunks.columns else {})
    for df in (entities, *(firsts(c, k) for c, k in keys.items())):
        out = out.join(df, "document_id", "left")
    return out


def edges_from_text(persons: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], links: DataFrame, kinds) -> DataFrame:  # noqa: ANN001
    """GR-5, JN-12. (person_id_1, person_id_2, describer, connection_type, strength, description, document_ids) for pairs not yet linked, where one's description mentions the other: by full name, by a last name of more than three letters that only one person has, or by first and last name apart. Of several describers the lowest id counts.

    edges: the pairs linked already, or a function that gives those of a table of pairs (person_id_1 < person_id_2) which are, so that edges that follow from other tables are looked up for the pairs alone. kinds: a function from the sentence about the mention to a struct of connection_type and strength (DOC-7: rules.relation). Names are found through words, never by trying all pairs."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    names = persons.select(F.col("id").alias("other"), "name", words(F.col("name")).alias("parts")).filter("size(parts) > 1").select("other", "name", F.get("parts", F.lit(0)).alias("first"), F.element_at("parts", -1).alias("last"))
    only = names.groupBy("last").agg(F.count("*").alias("n")).filter("n = 1").select("last")
    said = persons.filter("description is not null").select(F.col("id").alias("describer"), F.explode(F.array_distinct(words(F.col("description")))).alias("word"))
    # A name whose first and last word are both said, full names among them: of a text's own words only those that are names are paired, and the pairs meet the names by equality.
    firsts, lasts = (said.join(names.select(F.col(c).alias("word")).distinct(), "word", "left_semi").withColumnRenamed("word", c) for c in ("first", "last"))
    by_both = firsts.join(lasts, "describer").join(names, ["first", "last"])
    by_last = said.withColumnRenamed("word", "last").filter(F.length("last") > 3).join(only, "last", "left_semi").join(names, "last")
    found = by_both.select("describer", "other", "last").unionByName(by_last.select("describer", "other", "last")).filter("describer <> other")
    ends = [F.least("a", "b").alias("person_id_1"), F.greatest("a", "b").alias("person_id_2")]
    # Written, so that its size is known: where it is small the edges meet it without a shuffle of their own.
    pair = stored(found.withColumnsRenamed({"describer": "a", "other": "b"}).select(*ends, F.col("a").alias("describer"), F.col("b").alias("other"), "last"), "mentions")
    ids = ["person_id_1", "person_id_2"]
    asked = pair.select(*ids).distinct()
    linked = edges(asked).select(*ids) if callable(edges) else edges.select(F.col("person_id_1").alias("a"), F.col("person_id_2").alias("b")).select(*ends).join(asked, ids, "left_semi")
    fresh = pair.join(linked, ids, "left_anti")
    chosen = fresh.groupBy("person_id_1", "person_id_2").agg(F.min_by(F.struct("describer", "last"), F.struct("describer", "other")).alias("x")).select("person_id_1", "person_id_2", "x.*")
    one = chosen.join(persons.select(F.col("id").alias("describer"), "description"), "describer")  # texts meet the chosen pairs alone
    sentence = F.get(F.filter(F.split("description", r"\. "), lambda s: F.contains(F.lower(s), F.col("last"))), F.lit(0))
    about = one.withColumn("description", F.coalesce(sentence, "description")).withColumn("kind", kinds(F.col("description")))
    shared = one.select("person_id_1", "person_id_2").join(links.select(F.col("person_id").alias("person_id_1"), "document_id"), "person_id_1").join(links.select(F.col("person_id").alias("person_id_2"), "document_id"), ["person_id_2", "document_id"]).groupBy("person_id_1", "person_id_2").agg(F.sort_array(F.collect_set("document_id")).alias("document_ids"))
    return about.join(shared, ["person_id_1", "person_id_2"], "left").select("person_id_1", "person_id_2", "describer", "kind.connection_type", "kind.strength", "description", F.coalesce("document_ids", F.array().cast("array<long>")).alias("document_ids"))


def entity_edges(connections: DataFrame, entities: DataFrame, persons: DataFrame) -> DataFrame:
    """GR-6. (entity_id, kind, target_id, connection_type), once each, from connections (analysis_id, source, source_kind, target, target_kind, connection_type): one end at least is an entity, persons and entities are found by name in any case, ends that nobody has are dropped."""
    e = entities.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("e"))
    p = persons.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("p"))
    # The entity goes first, so an entity-person connection told the other way round is the same edge.
    turn = (F.col("source_kind") == "person") & (F.col("target_kind") == "entity")
    c = connections.filter("not (source_kind = 'person' and target_kind = 'person')").select(F.lower(F.when(turn, F.col("target")).otherwise(F.col("source"))).alias("a"), F.lower(F.when(turn, F.col("source")).otherwise(F.col("target"))).alias("b"), F.when(turn, F.col("source_kind")).otherwise(F.col("target_kind")).alias("kind"), "connection_type")
    first = c.join(e, F.col("a") == F.col("low")).select(F.col("e").alias("entity_id"), "b", "kind", "connection_type")
    other = e.select("low", F.lit("entity").alias("kind"), F.col("e").alias("target_id")).unionByName(p.select("low", F.lit("person").alias("kind"), F.col("p").alias("target_id")))
    return first.join(other.withColumnRenamed("low", "b"), ["b", "kind"]).filter("kind = 'person' or entity_id <> target_id").select("entity_id", "kind", "target_id", "connection_type").distinct()


def append_connections(analyses: DataFrame, new: DataFrame) -> DataFrame:
    """DML-14. analyses with the new connections appended behind their own, recounted and marked as version 2; others stay. analyses: analysis_id, connections array, n_connections, schema_version; new: analysis_id, seq, connection."""
    more = new.groupBy("analysis_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "connection"))), lambda x: x["connection"]).alias("more"))
    j = analyses.join(more, "analysis_id", "left")
    whole = F.concat(F.coalesce("connections", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))
    changed = {"connections": whole, "n_connections": F.size(whole), "schema_version": F.when(F.col("more").isNotNull(), F.lit(2)).otherwise(F.col("schema_version"))}
    return j.select(*(changed.get(c, F.col(c)).alias(c) for c in analyses.columns))


def remap_everything(id_map: DataFrame, persons: DataFrame, links: DataFrame, events: DataFrame, most_aliases: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DML-4. persons without the duplicates, whose names became aliases (most_aliases new ones at the most, in order of name) and with links recounted; links and the events' person_ids with ids replaced, once each."""
    new = links.join(id_map, links["person_id"] == id_map["dup_id"], "left").select(F.coalesce("canonical_id", "person_id").alias("person_id"), "document_id").distinct()
    gained = persons.join(id_map, persons["id"] == id_map["dup_id"]).select("canonical_id", F.explode(F.concat(F.array("name"), "aliases")).alias("alias")).distinct()
    lists = top_of(gained.join(persons.select(F.col("id").alias("canonical_id"), F.col("name").alias("own"), F.col("aliases").alias("has")), "canonical_id").filter("alias <> own and not array_contains(has, alias)"), "canonical_id", [F.asc("alias")], most_aliases).groupBy("canonical_id").agg(F.sort_array(F.collect_list("alias")).alias("gained"))
    counts = new.groupBy(F.col("person_id").alias("n_id")).agg(F.count("*").alias("n_documents"))
    kept = persons.join(id_map, persons["id"] == id_map["dup_id"], "left_anti").join(lists, F.col("id") == F.col("canonical_id"), "left").join(counts, F.col("id") == F.col("n_id"), "left")
    people = kept.select("id", "name", F.concat("aliases", F.coalesce("gained", F.array().cast("array<string>"))).alias("aliases"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
    ids = events.select(F.col("id").alias("event_id"), F.explode("person_ids").alias("p")).join(id_map, F.col("p") == F.col("dup_id"), "left").groupBy("event_id").agg(F.sort_array(F.collect_set(F.coalesce("canonical_id", "p"))).alias("new_ids"))
    told = events.join(ids, events["id"] == ids["event_id"], "left").select(*(F.coalesce("new_ids", "person_ids").alias(c) if c == "person_ids" else F.col(c) for c in events.columns))
    return people, new, told


def job_retries(outcomes: DataFrame, max_attempts: int = 3) -> DataFrame:
    """DML-11. (job_id, attempts, status) after a log of outcomes (job_id, seq, ok): attempts are failures before the first success; failed at the maximum, done after a success, else pending."""
    first_ok = outcomes.groupBy("job_id").agg(F.min(F.when(F.col("ok"), F.col("seq"))).alias("ok_at"))
    n = outcomes.join(first_ok, "job_id").groupBy("job_id").agg(F.count_if(~F.col("ok") & (F.col("ok_at").isNull() | (F.col("seq") < F.col("ok_at")))).alias("fails"), F.min("ok_at").alias("ok_at"))
    attempts = F.least("fails", F.lit(max_attempts))
    return n.select("job_id", attempts.cast("long").alias("attempts"), F.when(F.col("fails") >= max_attempts, "failed").when(F.col("ok_at").isNotNull(), "done").otherwise("pending").alias("status"))
