"""Names of any number of words found in texts: leftmost and longest, with their places (DOC-5, JN-12).

A name is a chain of hashes, one for each of its beginnings: the hash of a beginning is that of the one before and the next word. Texts send only those places on at
which the first word of some name stands, each with the chain of the words that follow, so what meets the table of names are a few hashes for each such place, by equality. Of the names found
the leftmost counts, of those at one place the longest, and what overlaps it doesn't: "new york" is not counted in "new york times".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenarc.sources.stored import stored

WORD = "[A-Za-z0-9]+"


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), F.lower)


def chain(words: Column) -> Column:
    """The hash of every beginning of a list of words."""
    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.array().cast("array<bigint>").alias("all"))

    def step(state: Column, word: Column) -> Column:
        h = F.xxhash64(state["h"], word)
        return F.struct(h.alias("h"), F.concat(state["all"], F.array(h)).alias("all"))

    return F.aggregate(words, start, step)["all"]  # as long as the longest name


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, at, words): each mention that counts, at its word from 0. docs: id, text; names: name, in any case. Names without a word are left out; those with equal words are one, the first by text."""
    told = names.select("name", words_of(F.col("name")).alias("w")).filter("size(w) > 0").groupBy("w").agg(F.min("name").alias("name"))
    table = stored(told.select("name", F.get("w", F.lit(0)).alias("word"), F.element_at(chain(F.col("w")), -1).alias("h"), F.size("w").alias("n")), "names")
    most = table.agg(F.max("n")).first()[0] or 0
    if not most:
        return docs.limit(0).selectExpr("id", "'' name", "0 at", "0 words")
    said = docs.select("id", words_of(F.col("text")).alias("w"))
    spots = F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("word"), F.slice("w", i + 1, most).alias("next")))
    # A stream of the text's places against the first words of names: the smaller table, which Spark broadcasts while it is small.
    starts = said.select("id", F.explode(spots).alias("s")).select("id", "s.*").join(table.select("word").distinct(), "word", "left_semi")
    links = starts.select("id", "at", F.posexplode(chain(F.col("next"))).alias("n0", "h")).withColumn("n", F.col("n0") + 1)
    met = links.join(table.select("h", "n", "name"), ["h", "n"]).groupBy("id", "at").agg(F.max(F.struct("n", "name")).alias("x"))
    lists = met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", F.col("x.n").alias("n"), F.col("x.name").alias("name")))).alias("m"))  # the names of one text
    kept = F.struct(F.lit(0).alias("stop"), F.array().cast("array<int>").alias("taken"))

    def take(state: Column, i: Column) -> Column:
        x = F.get("m", i)
        free = x["at"] >= state["stop"]
        return F.struct(F.when(free, x["at"] + x["n"]).otherwise(state["stop"]).alias("stop"), F.when(free, F.concat(state["taken"], F.array(i))).otherwise(state["taken"]).alias("taken"))

    order = F.sequence(F.lit(0), F.size("m") - 1)
    picked = lists.select("id", F.explode(F.transform(F.aggregate(order, kept, take)["taken"], lambda i: F.get("m", i))).alias("x"))
    return picked.select("id", "x.name", "x.at", F.col("x.n").alias("words"))


def with_contexts(found: DataFrame, docs: DataFrame, around: int = 80) -> DataFrame:
    """(id, name, mentions, context): how often each name is mentioned in a text, and its first mention with up to so many characters of the same line on either side. found: the output of mentions()."""
    first = found.groupBy("id", "name").agg(F.count("*").alias("mentions"), F.min(F.struct("at", "words")).alias("x"))
    pieces = F.regexp_extract_all("text", F.lit(f"[^A-Za-z0-9]*{WORD}"), F.lit(0))
    upto = lambda n: F.length(F.array_join(F.slice(pieces, 1, n), ""))
    placed = first.join(docs.select("id", "text"), "id").select("id", "name", "mentions", "text", upto(F.col("x.at")).alias("lead"), upto(F.col("x.at") + F.col("x.words")).alias("stop"))
    # The gap before the name's first word belongs to what is around it.
    begin = F.col("lead") + F.length(F.regexp_extract(F.substr(F.col("text"), F.col("lead") + 1, F.col("stop") - F.col("lead")), "^[^A-Za-z0-9]*", 0))
    p = placed.withColumn("begin", begin)
    before = F.regexp_extract(F.substr(F.col("text"), F.greatest(F.col("begin") - around, F.lit(0)) + 1, F.least(F.col("begin"), F.lit(around))), r"[^\n\r]*\z", 0)  # $ would also match before a last line break
    after = F.regexp_extract(F.substr(F.col("text"), F.col("stop") + 1, F.lit(around)), r"^[^\n\r]*", 0)
    name = F.substr(F.col("text"), F.col("begin") + 1, F.col("stop") - F.col("begin"))
    return p.select("id", "name", "mentions", F.trim(F.concat(before, name, after)).alias("context"))
