"""Entity resolution by the full rule set: names that mean one person, their groups, and the plan that merges and deletes.

No rule is tried on all pairs. Each has keys of its own that its matches share, and every key holds two traits of a name (a last name with the first name
or a beginning of it, a first name with a segment of a last name, ...) or one that is nearly the whole name, so that a common first or last name alone never
makes a block. Keys have roles: names meet only where a probe of one is an index entry of the other, which makes "begins with" and "within d edits" almost exact.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumenarc.functions.near import INDEX, NO_KEYS, PROBE, near_keys, prefix_keys, role_key
from lumenarc.functions.text import SUFFIXES, normalize_name, sorted_tokens, spaceless
from lumenarc.sources.stored import stored

Write = Callable[[DataFrame], DataFrame]


def collapse_fragments(name: Column) -> Column:
    """STR-2. Joins the pieces into which scanning breaks words: a single letter joins the word behind it, a piece of one or two letters the word before it."""
    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(False).alias("open"))

    def step(state: Column, part: Column) -> Column:
        words, n = state["words"], F.size(state["words"])
        last = F.coalesce(F.get(words, n - 1), F.lit(""))
        joins = state["open"] | ((F.length(part) == 2) & (F.length(last) > 1))
        return F.struct(F.when(joins, F.concat(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, part)))).otherwise(F.concat(words, F.array(part))).alias("words"), (~joins & (F.length(part) == 1)).alias("open"))

    parts = F.split(name, " ")
    # A last single letter has no word behind it: it joins the word before, unless it is the only one.
    inner = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), start, step)
    tail = F.element_at(parts, -1)

    def close(state: Column) -> Column:
        words, n = state["words"], F.size(state["words"])
        last = F.coalesce(F.get(words, n - 1), F.lit(""))
        joins = state["open"] | ((F.length(tail) <= 2) & (F.length(last) > 1))
        return F.array_join(F.when(joins, F.concat(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, tail)))).otherwise(F.concat(words, F.array(tail))), " ")

    return F.get(F.transform(F.array(inner), close), F.lit(0))


def canonical_first(first: Column, nicknames: dict[str, str]) -> Column:
    """STR-3. The full form of a nickname; nicknames is an input, small by nature."""
    if not nicknames:
        return first
    pairs = F.create_map(*(F.lit(x) for pair in sorted(nicknames.items()) for x in pair))
    return F.coalesce(F.try_element_at(pairs, first), first)


def traits(persons: DataFrame, nicknames: dict[str, str] | None = None, id_name: str = "id", name: str = "name", aliases: str | None = None, suffixes: bool = False) -> DataFrame:
    """id, norm and what the rules compare; names of fewer than two parts are left out: one word never identifies a person. suffixes: drop generational ones."""
    nick = nicknames or {}
    norm = normalize_name(F.col(name))
    bare = F.when(F.size(F.split(norm, " ")) > 2, F.regexp_replace(norm, "( (" + "|".join(SUFFIXES) + "))+$", "")).otherwise(norm) if suffixes else norm
    other = F.transform(F.coalesce(F.col(aliases), F.array().cast("array<string>")), normalize_name) if aliases else F.array().cast("array<string>")
    # Written: the traits below use the normalised name a dozen times, and Spark would inline it in each.
    n = stored(persons.select(F.col(id_name).alias("id"), bare.alias("norm"), F.array_sort(F.array_distinct(other)).alias("aliases")), "names").withColumn("parts", F.split("norm", " "))
    n = n.filter(F.size("parts") >= 2)
    first, real = F.get("parts", F.lit(0)), F.get(F.filter("parts", lambda p: F.length(p) >= 2), F.lit(0))
    n = n.select("*", first.alias("first"), F.element_at("parts", -1).alias("last"), F.coalesce(real, first).alias("real"), collapse_fragments(F.col("norm")).alias("collapsed"))
    return n.select("*", canonical_first(F.col("first"), nick).alias("canon"), canonical_first(F.col("real"), nick).alias("canon_real"), spaceless(F.col("norm")).alias("bare"), sorted_tokens(F.col("norm")).alias("ordered"))


def _near(x: Column, y: Column, d: int) -> Column:
    return F.levenshtein(x, y, d) >= 0


def _prefix(x: Column, y: Column) -> Column:
    return F.startswith(x, y) | F.startswith(y, x)


def _long(n: int, *words: Column) -> Column:
    return F.least(*(F.length(w) for w in words)) >= n if len(words) > 1 else F.length(words[0]) >= n


def _of(side: str) -> dict[str, Column]:
    return {c: F.col(f"{side}.{c}") for c in ("norm", "aliases", "parts", "first", "last", "real", "collapsed", "canon", "canon_real", "bare", "ordered")}


def _one_word(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """x is a single word broken by scanning, close to a word of y; an initial with a surname is no such word."""
    initial = (F.size(x["parts"]) == 2) & (F.length(x["first"]) == 1) & _long(4, x["last"])
    return ~F.contains(x["collapsed"], F.lit(" ")) & _long(5, x["collapsed"]) & ~initial & F.exists(y["parts"], lambda p: _long(5, p) & _near(x["collapsed"], p, 1))


def same_person_rules(left: str = "a", right: str = "b") -> list[tuple[str, Column]]:
    """ER-1. The rules in order; the first that holds names the match."""
    a, b = _of(left), _of(right)
    shown = (a["real"] != a["first"]) | (b["real"] != b["first"])
    one_last = (a["last"] == b["last"]) & _long(3, a["last"])
    shorter, longer = (F.when(F.length(a["norm"]) < F.length(b["norm"]), x).otherwise(y) for x, y in ((a["norm"], b["norm"]), (b["norm"], a["norm"])))
    return [
        ("same name", a["norm"] == b["norm"]),
        ("same without spaces", _long(6, a["norm"]) & (a["bare"] == b["bare"])),
        ("same after joining fragments", a["collapsed"] == b["collapsed"]),
        ("word in fragments", _one_word(a, b) | _one_word(b, a)),
        ("same words", a["ordered"] == b["ordered"]),
        ("last name and first name", one_last & (_prefix(a["first"], b["first"]) | (_long(4, a["first"], b["first"]) & _near(a["first"], b["first"], 2)) | _prefix(a["canon"], b["canon"]))),
        ("last name and name behind an initial", one_last & shown & _long(3, a["real"], b["real"]) & (_prefix(a["real"], b["real"]) | _prefix(a["canon_real"], b["canon_real"]))),
        ("last name but a letter", _long(5, a["last"], b["last"]) & _near(a["last"], b["last"], 1) & ((_long(3, a["first"], b["first"]) & _prefix(a["first"], b["first"])) | (a["canon"] == b["canon"]))),
        ("full first name, last name but two letters", _long(6, a["last"], b["last"]) & _near(a["last"], b["last"], 2) & (a["canon"] == b["canon"]) & _long(3, a["canon"])),
        ("first name, longer last name", (a["first"] == b["first"]) & _long(3, a["first"]) & _long(4, a["last"], b["last"]) & _prefix(a["last"], b["last"])),
        ("name with words added", _long(8, a["norm"], b["norm"]) & F.startswith(longer, shorter)),
        ("whole name but two letters", _long(10, a["norm"], b["norm"]) & _near(a["norm"], b["norm"], 2) & (((a["first"] == b["first"]) & _long(4, a["last"], b["last"])) | ((a["last"] == b["last"]) & _long(3, a["first"], b["first"])))),
        ("alias", F.array_contains(a["aliases"], b["norm"]) | F.array_contains(b["aliases"], a["norm"])),
    ]


def merge_rules(left: str = "a", right: str = "b") -> list[tuple[str, Column]]:
    """ER-2. The rules for known entities, on names without suffixes and of five parts at most: middle names don't count, last names may differ by two letters."""
    a, b = _of(left), _of(right)
    core = lambda x, c: F.concat_ws(" ", x[c], x["last"])
    letter = lambda x, y: F.substring(x, 1, 1) == F.substring(y, 1, 1)

    def first_alike(f: str, c: str) -> Column:
        x, y, cx, cy = a[f], b[f], a[c], b[c]
        initial = (F.least(F.length(x), F.length(y)) == 1) & letter(x, y)
        return (x == y) | initial | (_long(3, x, y) & _prefix(x, y)) | (cx == cy) | (_long(4, cx, cy) & _prefix(cx, cy)) | (_long(4, x, y) & _near(x, y, 2))

    alike = first_alike("first", "canon") | first_alike("real", "canon_real")
    fits = (F.size(a["parts"]) <= 5) & (F.size(b["parts"]) <= 5)
    return [
        ("same name", a["norm"] == b["norm"]),
        ("same first and last", fits & (core(a, "first") == core(b, "first")) & _long(6, core(a, "first"))),
        ("same name behind an initial", fits & (core(a, "real") == core(b, "real")) & _long(6, core(a, "real"))),
        ("same without spaces", fits & _long(6, a["bare"]) & (a["bare"] == b["bare"])),
        ("last name and like first", fits & (a["last"] == b["last"]) & _long(3, a["last"]) & alike),
        ("like last name and like first", fits & _long(5, a["last"], b["last"]) & _near(a["last"], b["last"], 2) & alike),
    ]


def _firsts() -> Column:
    return F.array_distinct(F.array("first", "canon", "real", "canon_real"))


def _whole_keys() -> Column:
    return F.array(role_key("n", PROBE | INDEX, F.col("norm")), role_key("s", PROBE | INDEX, F.col("bare")), role_key("t", PROBE | INDEX, F.col("ordered")))


def _first_keys(last: Column, role: int = PROBE | INDEX) -> Column:
    """An equal last name, and a first name that begins with the other's."""
    return F.flatten(F.transform(_firsts(), lambda w: prefix_keys("lp", last, w, role=role)))


def _rest_and_front(least_rest: int, least_front: int) -> Column:
    """All but one end of a name within two edits beside the equal end: what is behind the first name, what is before the last."""
    front = F.substr(F.col("norm"), F.lit(1), F.length("norm") - F.length("last") - 1)
    rest = F.substr(F.col("norm"), F.length("first") + 2)
    return F.concat(near_keys("fr", F.col("first"), rest, 2, least_rest), near_keys("lf", F.col("last"), front, 2, least_front), F.when(front != F.col("first"), near_keys("lf", F.col("last"), F.col("first"), 2, least_front)).otherwise(F.array().cast(NO_KEYS)))


def same_person_keys() -> Column:
    """Keys of ER-1. Every match of same_person_rules() is a probe of one name and an index entry of the other."""
    first, last, norm, none = F.col("first"), F.col("last"), F.col("norm"), F.array().cast(NO_KEYS)
    starts = F.array_distinct(F.array(F.substring(first, 1, 3), F.substring("canon", 1, 3)))
    canon_last = F.when((F.col("canon") != first) | (F.size("parts") > 2), near_keys("fr", F.col("canon"), last, 2, 6)).otherwise(none)
    broken = F.when(~F.contains("collapsed", F.lit(" ")), near_keys("w", F.lit(""), F.col("collapsed"), 1, 4, PROBE, longer=1)).otherwise(none)
    words = F.flatten(F.transform(F.filter("parts", lambda p: F.length(p) >= 5), lambda p: near_keys("w", F.lit(""), p, 1, 5, INDEX)))
    return F.array_distinct(F.concat(
        _whole_keys(),
        F.transform("aliases", lambda x: role_key("n", PROBE, x)),
        _first_keys(last),
        _rest_and_front(4, 3),
        canon_last,
        F.flatten(F.transform(starts, lambda t: near_keys("sl", t, last, 1, 5))),
        F.when(F.length(last) >= 4, F.array(role_key("fl", PROBE | INDEX, first, F.substring(last, 1, 4)))).otherwise(none),
        prefix_keys("p", F.lit(""), norm, F.greatest(F.lit(8), F.length(first) + 2)),
        broken,
        words,
    ))


def whole_name_keys() -> Column:
    """Keys of the rules on whole names."""
    return F.array_distinct(F.concat(_whole_keys(), _first_keys(F.col("last")), _rest_and_front(1, 1), near_keys("sl", F.col("first"), F.col("last"), 1, 5)))


def merge_keys(last: Column | None = None) -> Column:
    """Keys of ER-2: those of an equal last name. With a column, those that probe for it in place of the own last name."""
    role = PROBE | INDEX if last is None else PROBE
    of = F.col("last") if last is None else last
    near = F.flatten(F.transform(F.array_distinct(F.array("first", "real")), lambda w: near_keys("lf", of, w, 2, 4, role)))
    return F.array_distinct(F.concat(_first_keys(of, role), near, *([_whole_keys()] if last is None else [])))


def near_words(words: DataFrame, d: int, least: int) -> DataFrame:
    """(word, near): distinct words of at least so many letters that are 1 to d edits apart, both ways. words: word, distinct."""
    keyed = stored(words.filter(F.length("word") >= least).select("word", F.explode(near_keys("", F.lit(""), F.col("word"), d, least)).alias("k")).select("word", "k.key", "k.role"), "word-keys")
    probe, index = keyed.filter(F.col("role").bitwiseAND(PROBE) > 0).select("key", "word"), keyed.filter(F.col("role").bitwiseAND(INDEX) > 0).select("key", F.col("word").alias("near"))
    pairs = probe.join(index, "key").filter((F.col("word") != F.col("near")) & _near(F.col("word"), F.col("near"), d)).select("word", "near")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def candidate_keys(names: DataFrame, rules: Callable[[], list[tuple[str, Column]]]) -> DataFrame:
    """(id, key, role) of the names for a rule set. For ER-2 a name also probes with each known last name within two edits of its own."""
    from .resolve import whole_name_rules

    own = {same_person_rules: same_person_keys, whole_name_rules: whole_name_keys, merge_rules: merge_keys}[rules]
    keys = names.select("id", F.explode(own()).alias("k"))
    if rules is merge_rules:
        near = stored(near_words(names.select(F.col("last").alias("word")).distinct(), 2, 5), "near-lasts")
        keys = keys.unionByName(names.join(near, F.col("last") == F.col("word")).select("id", F.explode(merge_keys(F.col("near"))).alias("k")))
    return keys.select("id", "k.key", "k.role")


def candidates(keys: DataFrame) -> DataFrame:
    """(id1, id2), id1 < id2, where a probe of one meets an index entry of the other; both sides are tables, so Spark splits what many names share."""
    held = stored(keys, "keys")
    probe = held.filter(F.col("role").bitwiseAND(PROBE) > 0).select("key", F.col("id").alias("x"))
    index = held.filter(F.col("role").bitwiseAND(INDEX) > 0).select("key", F.col("id").alias("y"))
    return probe.join(index, "key").filter("x <> y").select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2")).distinct()


def match_pairs(persons: DataFrame, rules: Callable[[], list[tuple[str, Column]]] = same_person_rules) -> DataFrame:
    """(id1, id2, rule), id1 < id2, for the output of traits(). Work is on distinct names; persons of one name and equal aliases follow by their name."""
    persons = stored(persons, "traits")
    names = persons.groupBy("norm", "aliases").agg(F.min("id").alias("id"), F.min(F.struct(*(c for c in persons.columns if c not in ("id", "norm", "aliases")))).alias("t")).select("id", "norm", "aliases", "t.*")
    names = stored(names, "distinct-names")
    found = candidates(candidate_keys(names, rules))
    a, b = names.alias("a"), names.alias("b")
    rule = F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(label)) for label, cond in rules()))
    across = found.join(a, F.col("id1") == F.col("a.id")).join(b, F.col("id2") == F.col("b.id")).select("id1", "id2", rule.alias("rule")).filter("rule is not null")
    first = names.select("norm", "aliases", F.col("id").alias("id1"))
    within = persons.select("norm", "aliases", "id").join(first, ["norm", "aliases"]).filter("id <> id1").select("id1", F.col("id").alias("id2"), F.lit("same name").alias("rule"))
    return across.unionByName(within)


def canonical_members(members: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """WIN-7. (group, canonical_id) for members (group, id, name): protected names first, then no comma, not all capitals, more words, longer, lowest id."""
    m = members.withColumn("safe", F.lit(False)) if protected is None else members.join(protected.select(F.lower("name").alias("low")).distinct().withColumn("safe", F.lit(True)), F.lower(F.col("name")) == F.col("low"), "left")
    order = F.struct(~F.coalesce("safe", F.lit(False)), F.contains("name", F.lit(",")), (F.upper("name") == F.col("name")), -F.size(F.split("name", " ")), -F.length("name"), F.col("id"))
    return m.groupBy("group").agg(F.min_by("id", order).alias("canonical_id"))


def merge_aggregates(groups: DataFrame, facts: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """ER-4. Per canonical_id: mentions and documents summed, the first role that isn't "Unknown" by mentions, the category of least rank. groups: (id, canonical_id); facts: id, mentions, documents, role, category."""
    rank = F.create_map(*(F.lit(x) for pair in sorted(ranks.items()) for x in pair))
    f = facts.join(groups, "id")
    told = F.when(F.lower("role") != "unknown", F.struct(F.col("mentions"), -F.col("id")))
    return f.groupBy("canonical_id").agg(F.sum("mentions").alias("mentions"), F.sum("documents").alias("documents"), F.coalesce(F.max_by("role", told), F.lit("Unknown")).alias("role"), F.min_by("category", F.struct(F.coalesce(F.try_element_at(rank, F.col("category")), F.lit(99)), F.col("category"))).alias("category"))


def most_connected(groups: DataFrame, links: DataFrame) -> DataFrame:
    """ER-5. (dup_id, canonical_id): each group's member with most links, lowest id among equals. groups: (id, group); links: (id, n)."""
    g = groups.join(links, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = g.groupBy("group").agg(F.max_by("id", F.struct(F.col("n"), -F.col("id"))).alias("canonical_id"))
    return g.join(best, "group").filter("id <> canonical_id").select(F.col("id").alias("dup_id"), "canonical_id")


def single_words(persons: DataFrame, evidence: DataFrame, gender: DataFrame | None = None, protected: DataFrame | None = None, rare: int = 64, tried: int = 256) -> DataFrame:
    """ER-8. (dup_id, canonical_id) for persons of one word: the full name with that first or last word which shares most evidence, if that scores 4 and is the only one or twice the next. A document shared counts two, a connection one.

    Both sides are joined on word and piece of evidence, so only pairs that share some ever exist; and before that, words that can have no clear winner go (see undecided), which bounds those that common evidence makes. persons: id, name; evidence: (id, kind, key) with kind "document" or "connection"; gender: (title, first) pairs that exclude each other, an input; protected: names that stay."""
    n = persons.select("id", normalize_name(F.col("name")).alias("norm"), F.lower("name").alias("raw")).filter("norm <> ''").withColumn("parts", F.split("norm", " "))
    one = n.filter(F.size("parts") == 1).select(F.col("id").alias("dup_id"), F.col("norm").alias("word"), F.regexp_extract("raw", r"^(mr|mrs|ms|miss)[. ]", 1).alias("title"), "raw")
    if protected is not None:
        one = one.join(protected.select(F.lower("name").alias("raw")).distinct(), "raw", "left_anti")
    full = n.filter(F.size("parts") > 1).select("id", F.get("parts", F.lit(0)).alias("first"), F.explode(F.array_distinct(F.array(F.get("parts", F.lit(0)), F.element_at("parts", -1)))).alias("word"))
    # Names whose word the other side lacks go before the evidence is joined.
    e = stored(evidence.distinct(), "evidence")
    mine = stored(one.drop("raw").join(full.select("word").distinct(), "word", "left_semi").join(e.withColumnRenamed("id", "dup_id"), "dup_id"), "mine")
    theirs = stored(full.join(one.select("word").distinct(), "word", "left_semi").join(e, "id").withColumn("w", F.when(F.col("kind") == "document", 2).otherwise(1)), "theirs")

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        met = left.join(right, ["word", "kind", "key"])
        return met if gender is None else met.join(gender.distinct(), ["title", "first"], "left_anti")

    met = meet(mine.join(undecided(mine, theirs, meet, rare, tried), "dup_id", "left_semi"), theirs)
    shared = stored(met.groupBy("dup_id", "id").agg(F.sum("w").alias("score")), "shared")
    best = shared.groupBy("dup_id").agg(F.max(F.struct(F.col("score"), (-F.col("id")).alias("low"))).alias("b")).select("dup_id", (-F.col("b.low")).alias("canonical_id"), F.col("b.score").alias("score")).filter("score >= 4")
    rival = shared.join(best.select("dup_id", "canonical_id"), "dup_id").filter("id <> canonical_id").groupBy("dup_id").agg(F.max("score").alias("next"))
    return best.join(rival, "dup_id", "left").filter(F.coalesce("next", F.lit(0)) * 2 <= F.col("score")).select("dup_id", "canonical_id", "score")


def undecided(mine: DataFrame, theirs: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame], rare: int, tried: int) -> DataFrame:
    """(dup_id): the single words whose best full name may score twice the next, by bounds that take no pair of all with all.

    No score exceeds the weights of a word's common evidence and the best score by rare evidence, that of at most `rare` names, which is counted in full. The next score is at least the second best
    among the `tried` names of that word with most evidence. A word whose bound is below twice that has no winner."""
    from .profiles import top_of

    at = ["word", "kind", "key"]
    often = theirs.groupBy(*at, "id").agg(F.sum("w").alias("w")).groupBy(*at).agg(F.count("*").alias("n"), F.max("w").alias("most"))
    held = mine.join(often, at)
    common = held.filter(F.col("n") > rare).groupBy("dup_id").agg(F.sum("most").alias("common"))
    by_rare = meet(held.filter(F.col("n") <= rare), theirs).groupBy("dup_id", "id").agg(F.sum("w").alias("s")).groupBy("dup_id").agg(F.max("s").alias("rare"))
    rich = top_of(theirs.groupBy("word", "id").agg(F.sum("w").alias("all")), "word", [F.desc("all"), F.asc("id")], tried).select("word", "id")
    scores = meet(mine, theirs.join(rich, ["word", "id"], "left_semi")).groupBy("dup_id", "id").agg(F.sum("w").alias("s"))
    second = scores.groupBy("dup_id").agg(F.get(F.sort_array(F.collect_list("s"), False), F.lit(1)).alias("next"))  # `tried` numbers at most a word
    bounds = mine.select("dup_id").distinct().join(common, "dup_id", "left").join(by_rare, "dup_id", "left").join(second, "dup_id", "left")
    return stored(bounds.filter(F.coalesce("common", F.lit(0)) + F.coalesce("rare", F.lit(0)) >= 2 * F.coalesce("next", F.lit(0))).select("dup_id"), "undecided")


def bare_surnames(persons: DataFrame, protected: DataFrame) -> DataFrame:
    """ER-9. (id, action, canonical_id) for names of one word once titles are gone: "merge" into the only full name with that last word, else "delete"; protected names stay."""
    n = persons.join(protected.select(F.lower("name").alias("low")).distinct(), F.lower(persons["name"]) == F.col("low"), "left_anti").select("id", normalize_name(F.col("name")).alias("norm"))
    full = persons.select("id", normalize_name(F.col("name")).alias("norm")).withColumn("parts", F.split("norm", " ")).filter(F.size("parts") > 1)
    by_last = full.groupBy(F.element_at("parts", -1).alias("norm")).agg(F.min("id").alias("canonical_id"), F.count("*").alias("n"))
    found = n.filter("norm <> '' and not norm like '% %'").join(by_last, "norm", "left")
    sure = F.col("n") == 1
    return found.select("id", F.when(sure, "merge").otherwise("delete").alias("action"), F.when(sure, F.col("canonical_id")).alias("canonical_id"))


def curated_actions(persons: DataFrame, curated: DataFrame) -> DataFrame:
    """ER-10. (id, action, canonical_id) from a table (canonical, variant, action), by name in any case; the lowest id where names repeat."""
    by_name = persons.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("canonical_id"))
    rows = persons.join(curated.select(F.lower("variant").alias("low_variant"), F.lower("canonical").alias("low"), "action"), F.lower(persons["name"]) == F.col("low_variant")).join(by_name, "low", "left")
    return rows.filter((F.col("action") == "delete") | (F.col("canonical_id").isNotNull() & (F.col("canonical_id") != F.col("id")))).select("id", "action", F.when(F.col("action") == "merge", F.col("canonical_id")).alias("canonical_id"))


def middle_names(persons: DataFrame, weights: DataFrame) -> DataFrame:
    """ER-11. (dup_id, canonical_id): a name of two words and the only name of three with the same first and last; the one with more data stays (the longer if equal), and no row is a duplicate twice. weights: (id, n)."""
    n = persons.select("id", normalize_name(F.col("name")).alias("norm")).withColumn("parts", F.split("norm", " ")).join(weights, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ends = [F.get("parts", F.lit(0)).alias("first"), F.element_at("parts", -1).alias("last")]
    two, three = n.filter(F.size("parts") == 2).select(F.col("id").alias("id2"), F.col("n").alias("n2"), *ends), n.filter(F.size("parts") == 3)
    only = three.groupBy(*ends).agg(F.min("id").alias("id3"), F.min("n").alias("n3"), F.count("*").alias("times")).filter("times = 1")
    pairs = two.join(only, ["first", "last"]).select(F.when(F.col("n2") > F.col("n3"), F.col("id3")).otherwise(F.col("id2")).alias("dup_id"), F.when(F.col("n2") > F.col("n3"), F.col("id2")).otherwise(F.col("id3")).alias("canonical_id"), F.greatest("n2", "n3").alias("n"))
    return pairs.groupBy("dup_id").agg(F.max_by("canonical_id", F.struct(F.col("n"), -F.col("canonical_id"))).alias("canonical_id"))


def ordered_plan(passes: list[tuple[str, DataFrame]]) -> DataFrame:
    """ER-12, SNK-11. One action a person: (pass, id, action, canonical_id) of the first pass that names it. passes: in order, each (id, action, canonical_id)."""
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(i).alias("at"), F.lit(name).alias("pass"), F.col("id").cast("long").alias("id"), "action", F.col("canonical_id").cast("long").alias("canonical_id")) for i, (name, df) in enumerate(passes)))
    best = rows.groupBy("id").agg(F.min_by(F.struct("pass", "action", "canonical_id"), F.struct(F.col("at"), F.col("action"), F.col("canonical_id"))).alias("x"))
    return best.select("x.pass", "id", "x.action", "x.canonical_id")


def sequential_plan(persons: DataFrame, passes: list[tuple[str, Callable[[DataFrame], DataFrame]]], write: Write) -> DataFrame:
    """ER-12. (pass, id, action, canonical_id) by passes in order, each a function of the persons that no earlier pass handled. A target that a later pass handles is followed by resolved_map(). persons: id, name."""
    plan, left = None, persons
    for name, run in passes:
        found = run(left).groupBy("id").agg(F.min(F.struct("action", "canonical_id")).alias("x"))
        rows = write(found.select(F.lit(name).alias("pass"), F.col("id").cast("long").alias("id"), "x.action", F.col("x.canonical_id").cast("long").alias("canonical_id")))
        plan = rows if plan is None else plan.unionByName(rows)
        left = write(left.join(rows.select("id"), "id", "left_anti"))
    return plan


def dedup_passes(evidence: DataFrame, weights: DataFrame, figures: DataFrame, variants: DataFrame, protected: DataFrame, gender: DataFrame | None = None) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The seven passes in their order: 0 names that are none, 1 equal names, 2 single words by evidence, 4 curated figures, 5 middle names, 6 curated variants, 3 bare surnames. figures, variants: (canonical, variant, action)."""
    from .resolve import junk_reason

    kept = protected.select(F.lower("name").alias("low")).distinct()
    loose = lambda left: left.join(kept, F.lower(left["name"]) == F.col("low"), "left_anti")
    merges = lambda df: df.select(F.col("dup_id").alias("id"), F.lit("merge").alias("action"), "canonical_id")

    def junk(left: DataFrame) -> DataFrame:
        return loose(left).filter(junk_reason(F.col("name")).isNotNull()).select("id", F.lit("delete").alias("action"), F.lit(None).cast("long").alias("canonical_id"))

    def same_name(left: DataFrame) -> DataFrame:
        named = left.select(normalize_name(F.col("name")).alias("group"), "id", "name").filter("`group` <> ''")
        first = canonical_members(named, protected)
        return merges(named.join(first, "group").filter("id <> canonical_id").select(F.col("id").alias("dup_id"), "canonical_id"))

    def middle(left: DataFrame) -> DataFrame:
        found = middle_names(left, weights)
        return merges(found.join(loose(left).select(F.col("id").alias("dup_id")), "dup_id", "left_semi"))

    return [
        ("junk", junk),
        ("same name", same_name),
        ("single words", lambda left: merges(single_words(left, evidence, gender, protected))),
        ("figures", lambda left: curated_actions(left, figures)),
        ("middle names", middle),
        ("variants", lambda left: curated_actions(left, variants)),
        ("surnames", lambda left: bare_surnames(left, protected)),
    ]


def plan_summary(plan: DataFrame) -> DataFrame:
    """SNK-11. Actions of each pass."""
    return plan.groupBy("pass", "action").agg(F.count("*").alias("n"))


def resolved_map(plan: DataFrame, persons: DataFrame, write: Write) -> tuple[DataFrame, DataFrame]:
    """ER-13. The id map followed to its end, and the ids to delete. Actions whose person or target is gone are stale and skipped; a merge into a person that is itself deleted deletes; of a circle of merges the lowest id stays."""
    there = persons.select("id")
    live = plan.join(there, "id", "left_semi")
    merges = live.filter("action = 'merge' and canonical_id <> id").join(there.withColumnRenamed("id", "canonical_id"), "canonical_id", "left_semi")
    now = write(merges.select("id", F.col("canonical_id").alias("to"), F.least("id", "canonical_id").alias("low")))
    # Each step doubles the merges walked, and low is the least person on that walk. A walk longer than the plan has ended, or is in a circle that it has gone all around.
    for _ in range(now.count().bit_length()):
        on = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        new = write(now.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.least("low", F.coalesce("next_low", "low")).alias("low"), F.col("next").isNotNull().alias("open")))
        now = new.drop("open")
        if new.filter("open").isEmpty():
            break
    # Who still has a merge to follow stands in a circle or before one, and points into it: its least member ends it.
    rings = now.select(F.col("id").alias("to"), F.col("low").alias("ring"))
    now = write(now.join(rings, "to", "left").select("id", F.coalesce("ring", "to").alias("to")))
    gone = live.filter("action = 'delete'").select("id")
    into_gone = now.join(gone.withColumnRenamed("id", "to"), "to", "left_semi").select("id")
    return now.filter("id <> to").join(into_gone, "id", "left_anti").select(F.col("id").alias("dup_id"), F.col("to").alias("canonical_id")), gone.unionByName(into_gone).distinct()


def fuzzy_lookup(mentions: DataFrame, persons: DataFrame, top: DataFrame, mention: str, nicknames: dict[str, str] | None = None, key: str = "mid") -> DataFrame:
    """ER-14. mentions with person_id: exact, else by normalised name, else by the rules of ER-1 against the persons of top (the lowest id that fits)."""
    from .resolve import lookup

    found = lookup(mentions, persons, mention)
    known = traits(persons.join(top.select("id"), "id", "left_semi"), nicknames)
    asked = traits(found.filter("person_id is null").select(F.col(mention)).distinct().withColumn("id", F.xxhash64(mention)), nicknames, "id", mention)
    cond = reduce(lambda x, y: x | y, (F.coalesce(c, F.lit(False)) for _, c in same_person_rules()))
    sides = [stored(df.select("id", F.explode(same_person_keys()).alias("k")).select(F.col("id").alias(name), "k.key", "k.role"), name) for df, name in ((asked, "asked"), (known, "known"))]
    held = lambda df, role: df.filter(F.col("role").bitwiseAND(role) > 0).drop("role")
    met = held(sides[0], PROBE).join(held(sides[1], INDEX), "key").unionByName(held(sides[0], INDEX).join(held(sides[1], PROBE), "key")).select("asked", "known").distinct()
    pairs = met.join(asked.alias("a"), F.col("asked") == F.col("a.id")).join(known.alias("b"), F.col("known") == F.col("b.id")).filter(cond)
    best = pairs.groupBy(F.col("a.id").alias("asked")).agg(F.min("b.id").alias("fuzzy_id"))
    return found.join(best, F.xxhash64(mention) == F.col("asked"), "left").withColumn("person_id", F.coalesce("person_id", "fuzzy_id")).drop("asked", "fuzzy_id")
