"""STM-4: incremental ingest into keyed tables that a stream keeps up to date.

A table is a folder of versions, one a batch: the new state of the keys that the batch touched. The state of a key is its row of the latest version. A batch reads the versions before
its own, merges its rows into the states of their keys, and writes its version whole, so a batch that is run again gives what it gave. Every few batches the version is a base: the latest
row of every key, from which later reads start. Rows of two batches for one key meet by an equality join on the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenarc.sources.stored import stored

from .activity import pairs_of


class KeyedTable:
    """path: folder in the shared store; keys: columns; rules: for each other column how an old value and one of the batch (columns old, new) become one."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]], compact: int = 8) -> None:
        self.spark, self.path, self.keys, self.rules, self.compact = spark, path, keys, rules, compact

    def _versions(self, before: int | None) -> DataFrame | None:
        """All rows from the latest base on, of versions below before. The folders' names are the versions, so Spark reads those asked for only."""
        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException:
            return None
        rows = rows if before is None else rows.filter(F.col("version") < before)
        base = rows.filter("base").agg(F.max("version").alias("v")).first().v
        return rows if base is None else rows.filter(F.col("version") >= base)

    def state(self, before: int | None = None) -> DataFrame | None:
        rows = self._versions(before)
        if rows is None:
            return None
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.rules), "version").alias("x"))
        return best.select(*self.keys, "x.*")

    def merge(self, batch: DataFrame, version: int) -> None:
        """batch: one row for each key. Keys are compared null-safe."""
        old, new = self.state(version), batch.select(*self.keys, *self.rules)
        is_base = version % self.compact == self.compact - 1
        if old is not None:
            names = {c: f"_old_{c}" for c in [*self.keys, *self.rules]}
            o = old.select(*(F.col(c).alias(n) for c, n in names.items()), F.lit(True).alias("_there"))
            on = F.lit(True)
            for c in self.keys:
                on = on & F.col(c).eqNullSafe(F.col(names[c]))
            joined = new.withColumn("_here", F.lit(True)).join(o, on, "full" if is_base else "left")
            here, there = F.col("_here").isNotNull(), F.col("_there").isNotNull()
            value = lambda c: F.when(here & there, self.rules[c](F.col(names[c]), F.col(c))).when(there, F.col(names[c])).otherwise(F.col(c))
            new = joined.select(*(F.when(here, F.col(c)).otherwise(F.col(names[c])).alias(c) for c in self.keys), *(value(c).alias(c) for c in self.rules))
        new.withColumn("base", F.lit(is_base)).write.mode("overwrite").parquet(f"{self.path}/version={version}")


def longest(old: Column, new: Column) -> Column:
    return F.when(F.length(new) > F.length(old), new).otherwise(F.coalesce(old, new))


def united(old: Column, new: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(old, F.array().cast("array<bigint>")), F.coalesce(new, F.array().cast("array<bigint>"))))


def added(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def counted(old: Column, new: Column) -> Column:
    """Maps from a value to how often it was said."""
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(a, zero) + F.coalesce(b, zero))


PERSONS = {"mentions": added, "documents": added, "roles": counted}
EDGES = {"documents": added, "strength": lambda o, n: F.least(F.lit(5).cast("bigint"), F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0)))}
#: The rule by which events alike in date and lower-case title become one: the first title, the longest description, the last category, the highest significance, documents and persons united.
EVENTS = {"title": lambda o, n: F.coalesce(o, n), "description": longest, "category": lambda o, n: F.coalesce(n, o), "significance": lambda o, n: F.greatest(o, n), "document_ids": united, "person_names": lambda o, n: F.array_sort(F.array_union(o, n))}


class Ingest:
    """What foreachBatch runs on a stream of analyses: one row for each document with arrays of structs mentions (name, role, n) and events (seq, date, title, description, category, significance).

    known: the documents that count. A document comes in one batch; its rows are whole, so persons, edges and events of a batch are aggregated before they meet the tables.
    kept: the tables that are kept up to date; each depends on the batches alone, so a reader of one needs no other."""

    def __init__(self, spark: SparkSession, path: str, known: DataFrame, compact: int = 8, kept: tuple[str, ...] = ("persons", "edges", "events")) -> None:
        self.known, self.kept = known, kept
        self.persons = KeyedTable(spark, f"{path}/persons", ["name"], PERSONS, compact)
        self.edges = KeyedTable(spark, f"{path}/edges", ["name_1", "name_2"], EDGES, compact)
        self.events = KeyedTable(spark, f"{path}/events", ["date", "key"], EVENTS, compact)

    def __call__(self, batch: DataFrame, number: int) -> None:
        # Written once: every table reads the batch, some twice.
        rows = stored(batch.join(self.known.distinct(), "document_id", "left_semi"), "batch")
        said = rows.select("document_id", F.explode("mentions").alias("m")).select("document_id", F.lower(F.trim("m.name")).alias("name"), "m.role", "m.n").filter("name <> ''")
        for table in self.kept:
            {"persons": self._persons, "edges": self._edges, "events": self._events}[table](rows, said, number)

    def _persons(self, rows: DataFrame, said: DataFrame, number: int) -> None:
        roles = said.groupBy("name", "role").agg(F.sum("n").alias("n")).groupBy("name").agg(F.sum("n").alias("mentions"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("role", F.lit("")), "n"))).alias("roles"))
        # A document is one row, so its names are told apart within it.
        per = said.select("document_id", "name").distinct().groupBy(F.col("name").alias("_name")).agg(F.count("*").alias("documents"))
        self.persons.merge(roles.join(per, F.col("name") == F.col("_name")).drop("_name"), number)

    def _edges(self, rows: DataFrame, said: DataFrame, number: int) -> None:
        pairs = pairs_of(said.select("document_id", "name"))
        self.edges.merge(pairs.withColumn("strength", F.least(F.lit(5).cast("bigint"), F.col("documents"))), number)

    def _events(self, rows: DataFrame, said: DataFrame, number: int) -> None:
        told = rows.select("document_id", F.explode("events").alias("e")).select("document_id", "e.*").withColumn("key", F.lower("title"))
        per = told.groupBy("date", "key").agg(F.min_by("title", "seq").alias("title"), F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"), F.max_by("category", F.when(F.col("category").isNotNull(), F.col("seq"))).alias("category"), F.max("significance").alias("significance"), F.sort_array(F.collect_set("document_id")).alias("document_ids"))
        # Names are told apart before they are gathered: many documents of an event say the same ones.
        who = told.select("document_id", "date", "key").join(said.select("document_id", "name"), "document_id").select("date", "key", "name").distinct().groupBy("date", "key").agg(F.sort_array(F.collect_list("name")).alias("person_names"))
        none = F.array().cast("array<string>")
        on = F.col("date").eqNullSafe(F.col("_date")) & F.col("key").eqNullSafe(F.col("_key"))
        full = per.join(who.select(F.col("date").alias("_date"), F.col("key").alias("_key"), "person_names"), on, "left").drop("_date", "_key")
        self.events.merge(full.withColumn("person_names", F.coalesce("person_names", none)), number)

    def table(self, name: str) -> DataFrame:
        """persons (name, mentions, documents, role said most), edges or events as they are now."""
        if name != "persons":
            return {"edges": self.edges, "events": self.events}[name].state()
        best = F.array_max(F.transform(F.map_entries("roles"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("role"))))
        return self.persons.state().select("name", "mentions", "documents", best["role"].alias("role"))

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """persons, edges and events."""
        return self.table("persons"), self.table("edges"), self.table("events")
