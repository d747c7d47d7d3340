"""Relationship graphs: edges between persons, timelines, neighbourhoods. An edge is (id, person_id_1, person_id_2, connection_type, strength, document_ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

P1, P2 = "person_id_1", "person_id_2"


def pair() -> list[Column]:
    return [F.least(P1, P2).alias("a"), F.greatest(P1, P2).alias("b")]


def best_edge_per_pair(edges: DataFrame) -> DataFrame:
    """WIN-1. One edge for each unordered pair: longest description, then strongest, then lowest id; no self loops. An aggregation with map-side combine, where a window would ship every edge."""
    rank = F.struct((-F.length("description")).alias("l"), (-F.col("strength")).alias("s"), F.col("id").alias("i"))
    best = edges.filter(F.col(P1) != F.col(P2)).groupBy(*pair()).agg(F.min_by(F.struct(*edges.columns), rank).alias("e"))
    return best.select("e.*")


def existing_endpoints(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """JN-9. Edges whose ends are both persons."""
    ids = persons.select(F.col("id").alias("pid"))
    return edges.join(ids, F.col(P1) == F.col("pid"), "left_semi").join(ids, F.col(P2) == F.col("pid"), "left_semi")


def named(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """JN-3. Edges with both names. Spark broadcasts the persons if they are small, else it shuffles."""
    a, b = (persons.select(F.col("id").alias(p), F.col("name").alias(n)) for p, n in ((P1, "name_1"), (P2, "name_2")))
    return edges.join(a, P1).join(b, P2)


def network(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """GR-1. Edges between persons, no self loops, the lowest id for each unordered pair and type, with names."""
    kept = existing_endpoints(edges, persons).filter(F.col(P1) != F.col(P2))
    best = kept.groupBy(*pair(), "connection_type").agg(F.min_by(F.struct(*edges.columns), "id").alias("e")).select("e.*")
    return named(best, persons)


def neighbours(edges: DataFrame) -> DataFrame:
    """JN-4. Every edge seen from both of its ends: (person_id, other_id, …)."""
    rest = [c for c in edges.columns if c not in (P1, P2)]
    side = lambda x, y: edges.select(F.col(x).alias("person_id"), F.col(y).alias("other_id"), *rest)
    return side(P1, P2).unionByName(side(P2, P1).filter("person_id <> other_id"))


def degrees(edges: DataFrame) -> DataFrame:
    """GR-3, AGG-16. Edges at each person; a self loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array(P1, P2))).alias("person_id")).groupBy("person_id").agg(F.count("*").alias("degree"))


def recount(persons: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-16. Persons with true document and connection counts."""
    docs = links.groupBy("person_id").agg(F.count_distinct("document_id").alias("document_count"))
    joined = persons.join(docs, F.col("id") == docs["person_id"], "left").drop("person_id")
    joined = joined.join(degrees(edges), F.col("id") == F.col("person_id"), "left").drop("person_id")
    return joined.withColumnsRenamed({"degree": "connection_count"}).fillna(0, ["document_count", "connection_count"])


def ego(edges: DataFrame, center: Column) -> DataFrame:
    """GR-4. Edges inside the closed 1-hop neighbourhood of a person."""
    near = neighbours(edges).filter(F.col("person_id") == center).select("other_id").distinct()
    near = near.unionByName(edges.sparkSession.range(1).select(center.alias("other_id"))).distinct()
    return edges.join(near, F.col(P1) == F.col("other_id"), "left_semi").join(near, F.col(P2) == F.col("other_id"), "left_semi")


def filter_chain(persons: DataFrame, edges: DataFrame, years: DataFrame | None = None, year_from: int | None = None, year_to: int | None = None, categories: list[str] | None = None, types: list[str] | None = None, min_strength: int = 2, min_documents: int = 2, keyword: str | None = None, min_degree: int = 0) -> DataFrame:
    """GR-2. The edges that are left after the chain: persons with documents, active years, categories; edge types, strength, documents, keyword; degree."""
    kept = persons.filter("document_count > 0")
    if years is not None:
        active = years.filter((F.col("max_year") >= (year_from or 0)) & (F.col("min_year") <= (year_to or 9999)))
        kept = kept.join(active, F.col("id") == F.col("person_id"), "left_semi")
    if categories:
        kept = kept.filter(F.col("category").isin(categories))
    if keyword:
        kept = kept.filter(F.contains(F.lower("name"), F.lit(keyword.lower())))
    found = edges.filter((F.col("strength") >= min_strength) & (F.size("document_ids") >= min_documents))
    if types:
        found = found.filter(F.col("connection_type").isin(types))
    found = existing_endpoints(found, kept)
    if min_degree:
        enough = degrees(found).filter(F.col("degree") >= min_degree).select(F.col("person_id").alias("id"))
        found = existing_endpoints(found, enough)
    return found


def shared_documents(edges: DataFrame, links: DataFrame) -> DataFrame:
    """JN-11. Edges with the documents that both ends are linked to."""
    one, two = (links.select(F.col("person_id").alias(p), F.col("document_id").alias("document_id")).distinct() for p in (P1, P2))
    both = edges.select("id", P1, P2).join(one, P1).join(two, [P2, "document_id"])
    return both.groupBy("id").agg(F.sort_array(F.collect_set("document_id")).alias("document_ids"))


def resolve_ids(rows: DataFrame, key: str, ids: str, dim: DataFrame, dim_id: str, label: str) -> DataFrame:
    """JN-5. The array ids as an array of (id, label) structs in its order; unknown ids drop out, empty arrays stay empty."""
    at = rows.select(key, F.posexplode(ids).alias("pos", "ref"))
    known = at.join(dim.select(F.col(dim_id).alias("ref"), F.col(label).alias("label")), "ref")
    lists = known.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref", "label"))), lambda x: F.struct(x["ref"].alias("id"), x["label"].alias("label"))).alias("resolved"))
    return rows.join(lists, key, "left").withColumn("resolved", F.coalesce("resolved", F.array().cast(lists.schema["resolved"].dataType)))


def active_years(events: DataFrame) -> DataFrame:
    """AGG-17. First and last year of each person's events; dates are text."""
    year = F.try_to_number(F.substring("date", 1, 4), F.lit("9999")).cast("int")
    return events.select(F.explode("person_ids").alias("person_id"), year.alias("y")).groupBy("person_id").agg(F.min("y").alias("min_year"), F.max("y").alias("max_year"))


def timeline_years(events: DataFrame, year: Column) -> DataFrame:
    """GR-8. Events and key events (significance 2 or more) of each year."""
    return events.groupBy(year.alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("significance") >= 2).alias("n_key"))


def top_by(rows: DataFrame, key: list[str], order: list, n: int = 1) -> DataFrame:
    """WIN-2, WIN-3, WIN-7. The first n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
