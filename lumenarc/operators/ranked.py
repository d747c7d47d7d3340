"""Ranked search over an English index with blocks: FTS-1, FTS-4, FTS-5 and FTS-8 with all their parts.

The index is a few tables. Postings are (stem, block, page_id, share, at): a block is a range of page ids, share the BM25 score of the stem in the page
without its inverse frequency, which a query multiplies with, at its places. Stems are gathered page by page, so each posting is shuffled once. They are stored in ranges of (stem, block), so a frequent stem fills many files and a query reads those of its stems and blocks. For
each stem and block there is the greatest share: the sum over a query's stems bounds every page of the block, and blocks below the k-th best score
found so far hold none of the k best. The dictionary has each term with its stem, and by segments of
it, of which two edits leave one whole, so a misspelling is looked up by equality.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenarc.functions.english import STOP_WORDS, stem_of, with_stems
from lumenarc.functions.near import INDEX, PROBE, near_keys
from lumenarc.sources.stored import kept, new_path, stored, stored_by

from .search import B, K1, gathered, parse_query, some_repeat, terms_of

EDITS = 2


@dataclass
class EnglishIndex:
    """postings: stem, block, page_id, share, at; blocks: stem, block, most, n; dictionary: term, stem, pages; segments: key, term, pages; pages: how many there are."""

    spark: SparkSession
    postings: DataFrame
    blocks: DataFrame
    dictionary: DataFrame
    segments: DataFrame
    pages: float
    plans: dict = field(default_factory=dict)

    @classmethod
    def build(cls, pages: DataFrame, id_name: str, text_name: str, stops: list[str] | None = None, block_pages: int = 32, k: str | None = None) -> EnglishIndex:
        """FTS-1. Builds and stores the tables. k: a name under which they are found again while the files that pages reads stay as they are; stops is part of the name."""
        spark, stops = pages.sparkSession, STOP_WORDS if stops is None else stops

        def write() -> list[str]:
            ids = pages.select(F.col(id_name).cast("long").alias("page_id"), F.col(text_name).alias("text")).filter("page_id is not null")
            about = ids.agg(F.count("*").alias("n"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
            n, low, high = about["n"], about["low"] or 0, about["high"] or 0
            width = max(1, -(-(high - low + 1) * block_pages // max(n, 1)))
            raw = stored(gathered(ids, True, stem_of, stops), "gathered")
            mean = max(raw.agg(F.sum("tf").alias("m")).first()["m"] or 0, 1) / max(n, 1)
            if some_repeat(ids, "page_id"):
                sizes = raw.groupBy("page_id").agg(F.sum("tf").alias("n_words"))
                raw = raw.groupBy("page_id", "term").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("at"))).alias("at")).join(sizes, "page_id")
            paths = [new_path(spark, t) for t in ("postings", "blocks", "dictionary", "segments")]
            tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.lit(mean)))
            postings = stored_by(raw.select(F.col("term").alias("stem"), F.floor((F.col("page_id") - low) / width).alias("block"), "page_id", tf.alias("share"), "at"), paths[0], "stem", "block", "page_id")
            stored_by(postings.groupBy("stem", "block").agg(F.max("share").alias("most"), F.count("*").alias("n")), paths[1], "stem", "block")
            said = ids.select("page_id", F.explode(F.array_distinct(terms_of(F.coalesce("text", F.lit(""))))).alias("term")).filter(~F.col("term").isin(stops))
            said = said.distinct() if some_repeat(ids, "page_id") else said
            dictionary = stored_by(stored(with_stems(said.groupBy("term").agg(F.count("*").alias("pages"))), "terms"), paths[2], "stem", "term")
            keys = stored(dictionary.select("term", "pages", F.explode(near_keys("", F.lit(""), F.col("term"), EDITS, 1, INDEX)).alias("k")).select("k.key", "term", "pages"), "keys")
            stored_by(keys, paths[3], "key", "term")
            return [*paths, repr(float(n))]

        *paths, n = kept(pages, f"{k}:{','.join(stops)}:{block_pages}", write) if k else write()
        return cls(spark, *(spark.read.parquet(p) for p in paths), float(n))

    def weights(self, wanted: list[str]) -> Column:
        """What a stem's share of a page is multiplied by: the inverse frequency of each of a query's stems, a few numbers."""
        found = self.blocks.filter(F.col("stem").isin(wanted)).groupBy("stem").agg(F.sum("n").alias("df"))
        rows = found.select("stem", F.log(1 + (F.lit(self.pages) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("w")).collect()
        return F.element_at(F.create_map(*(F.lit(x) for r in rows for x in (r["stem"], r["w"]))), F.col("stem")) if rows else F.lit(0.0)

    def stems_of(self, words: list[str]) -> dict[str, str]:
        """Stems of a query's words; a word is never a stop word here, since those have no postings."""
        return {w: stem_of(w) for w in words}

    def surface(self, wanted: list[str]) -> dict[str, str]:
        """term -> stem for the terms of the dictionary with these stems: the endings of a query's words."""
        return {r.term: r.stem for r in self.dictionary.filter(F.col("stem").isin(wanted)).select("term", "stem").collect()} if wanted else {}

    def near_terms(self, word: str, d: int = EDITS) -> DataFrame:
        """FTS-8. (term, pages, distance) of the terms within d edits, d at most 2: each has a segment that stands in the word near its place. The filter on the segments' keys reaches the scan."""
        probes = self.spark.range(1).select(F.explode(near_keys("", F.lit(""), F.lit(word), EDITS, 1, PROBE, longer=EDITS)).alias("k")).collect()  # two dozen
        met = self.segments.filter(F.col("key").isin([r.k.key for r in probes])).select("term", "pages").distinct()
        return met.withColumn("distance", F.levenshtein("term", F.lit(word), d)).filter("distance >= 0")

    def plan(self, query: str) -> tuple[list[list[str]], list[list[str]], list[str]]:
        """Clauses, phrases and minus terms of a web-style query by stems, without stop words."""
        if query in self.plans:
            return self.plans[query]
        clauses, phrases, minus = parse_query(query)
        words = sorted({w for group in [*clauses, *phrases, minus] for w in group} - set(STOP_WORDS))
        to = self.stems_of(words)
        stemmed = lambda ws: list(dict.fromkeys(to[w] for w in ws if w in to))
        # A phrase keeps the places of its stop words: only what stands between must fit.
        spots = [[(i, to[w]) for i, w in enumerate(p) if w in to] for p in phrases]
        self.plans[query] = [c for c in map(stemmed, clauses) if c], [p for p in spots if len(p) > 1], stemmed(minus)
        return self.plans[query]

    def bounds(self, clauses: list[list[str]]) -> DataFrame:
        """(block, bound, n): blocks that hold all stems of a clause, what no page there can exceed, and the postings there."""
        wanted = sorted({t for c in clauses for t in c})
        rows = self.blocks.filter(F.col("stem").isin(wanted)).groupBy("block").agg(F.sum(F.col("most") * self.weights(wanted)).alias("bound"), F.sum("n").alias("n"), F.collect_set("stem").alias("has"))
        return rows.filter(_fits(clauses)).drop("has")

    def pages_in(self, blocks: DataFrame | list[int] | None, clauses: list[list[str]], phrases: list, minus: list[str]) -> DataFrame:
        """(page_id, score) of the pages that fit, in some blocks or in all."""

        def read(wanted: list[str]) -> DataFrame:
            own = self.postings.filter(F.col("stem").isin(wanted))
            if blocks is None:
                return own
            return own.filter(F.col("block").isin(blocks)) if isinstance(blocks, list) else own.join(blocks.select("block"), "block", "left_semi")

        wanted = sorted({t for c in clauses for t in c})
        hits = read(wanted)
        found = hits.groupBy("page_id").agg(F.round(F.sum(self.weights(wanted) * F.col("share")), 6).alias("score"), F.collect_set("stem").alias("has")).filter(_fits(clauses)).drop("has")
        for p in phrases:
            order = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in p)))
            begins = read(sorted({t for _, t in p})).select("page_id", "stem", "at", order.alias("o")).filter("o.t = stem").select("page_id", F.explode("at").alias("x"), "o.i")
            whole = begins.groupBy("page_id", (F.col("x") - F.col("i")).alias("begin")).agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(p)).select("page_id").distinct()
            found = found.join(whole, "page_id", "left_semi")
        return found.join(read(minus).select("page_id").distinct(), "page_id", "left_anti") if minus else found

    def best(self, query: str, k: int, first: int = 4) -> tuple[DataFrame, dict[str, int]]:
        """FTS-4. The k best pages, equal to ranking all that fit, and how many postings of how many were read.

        The blocks of the greatest bounds are scored first; of the others only those whose bound reaches the k-th score found there."""
        clauses, phrases, minus = self.plan(query)
        if not clauses:
            return self.postings.limit(0).select("page_id", F.col("share").alias("score")), {"read": 0, "all": 0}
        every = self.bounds(clauses)
        start = every.orderBy(F.desc("bound"), "block").limit(first).collect()  # a few rows
        order = [F.desc("score"), F.asc("page_id")]
        head = self.pages_in([r.block for r in start], clauses, phrases, minus).orderBy(*order).limit(k).collect()  # k rows
        least = head[-1].score if len(head) == k else float("-inf")
        # Scores are rounded to six digits, bounds are not.
        rest = every.filter((F.col("bound") >= least - 1e-6) & ~F.col("block").isin([r.block for r in start]))
        seen = rest.agg(F.sum("n").alias("n")).first().n or 0
        total = self.blocks.filter(F.col("stem").isin(sorted({t for c in clauses for t in c}))).agg(F.sum("n").alias("n")).first().n or 0
        schema = "page_id long, score double"
        found = self.spark.createDataFrame([(r.page_id, r.score) for r in head], schema)
        if seen:
            found = found.unionByName(self.pages_in(rest, clauses, phrases, minus))
        return found.orderBy(*order).limit(k), {"read": seen + sum(r.n for r in start), "all": total}

    def search(self, query: str, pages: DataFrame, k: int, keep: Column, least: int = 60) -> DataFrame:
        """FTS-4, the whole chain: the max(3 k, least) best pages, their metadata, those that may be shown, the k first of them, and for these alone the text with its best fragments. pages: page_id, text and what keep and the result need."""
        over, _ = self.best(query, max(3 * k, least))
        about = pages.drop("text").join(over, "page_id")
        shown = about.filter(keep).orderBy(F.desc("score"), "page_id").limit(k)
        clauses, _, _ = self.plan(query)
        words = self.surface(sorted({t for c in clauses for t in c}))
        return shown.join(pages.select("page_id", "text"), "page_id").withColumn("headline", fragments(F.col("text"), words)).drop("text")


def _fits(clauses: list[list[str]]) -> Column:
    out = F.lit(False)
    for c in clauses:
        out = out | F.forall(F.array(*map(F.lit, c)), lambda t: F.array_contains("has", t))
    return out


def fragments(text: Column, words: dict[str, str], most: int = 35, fewest: int = 15) -> Column:
    """FTS-5. The best two disjoint windows of 15 to 35 words, in order of the text, hits marked; without a hit the first 15 words. words: term -> stem.

    A window begins at a hit and ends at its last hit within reach, then grows to the least length, to the right first. The one with most
    different stems is best, then with most hits, then the first."""
    if not words:
        return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, fewest), " ")
    of = F.create_map(*(F.lit(x) for pair in sorted(words.items()) for x in pair))
    said = F.split(F.trim(text), r"\s+")
    marked = lambda w: F.regexp_replace(w, rf"(?i)(^|[^a-z0-9])({'|'.join(sorted(words))})($|[^a-z0-9])", "$1<mark>$2</mark>$3")
    found = F.filter(F.flatten(F.transform(said, lambda w, i: F.transform(terms_of(w), lambda t: F.struct(i.alias("i"), F.try_element_at(of, t).alias("stem"))))), lambda x: x["stem"].isNotNull())

    def windows(state: Column) -> Column:
        hits, n = state["hits"], F.size(state["said"])

        def window(h: Column) -> Column:
            inside = F.filter(hits, lambda x: (x["i"] >= h["i"]) & (x["i"] < h["i"] + most))
            kinds, last = F.size(F.array_distinct(F.transform(inside, lambda x: x["stem"]))), F.array_max(F.transform(inside, lambda x: x["i"]))
            end = F.least(F.greatest(last, h["i"] + fewest - 1), n - 1)
            return F.struct((-kinds).alias("kinds"), (-F.size(inside)).alias("hits"), h["i"].alias("at"), F.least(h["i"], F.greatest(end - fewest + 1, F.lit(0))).alias("low"), end.alias("high"))

        return F.struct(state["said"].alias("said"), F.transform(hits, window).alias("all"))

    def two(state: Column) -> Column:
        one = F.array_min(state["all"])
        other = F.array_min(F.filter(state["all"], lambda w: (w["low"] > one["high"]) | (w["high"] < one["low"])))
        picked = F.array_sort(F.filter(F.transform(F.array(one, other), lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))), lambda w: w["low"].isNotNull()))
        part = lambda w: F.array_join(F.transform(F.slice(state["said"], w["low"] + 1, w["high"] - w["low"] + 1), marked), " ")
        return F.when(F.size(state["all"]) > 0, F.array_join(F.transform(picked, part), " ... ")).otherwise(F.array_join(F.slice(state["said"], 1, fewest), " "))

    bound = F.transform(F.array(F.struct(said.alias("said"), found.alias("hits"))), windows)
    return F.get(F.transform(bound, two), F.lit(0))
