"""Entity resolution: names that mean the same person, without comparing all pairs.

Pairs come from equality joins on blocking keys: every rule of the predicate has a key that all its matches share. Closure over the pairs is
a connected-components job that writes what each step leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenarc.functions.text import normalize_name, sorted_tokens, spaceless


def whole_name_rules(left: str = "a", right: str = "b") -> list[tuple[str, Column]]:
    """Some rules of ER-1, on whole names alone: equal, equal without spaces (6 letters), equal as sets of words, same last name with a first name that is a prefix or within 2 edits, last names within 1 edit (5 letters) with equal first names, whole names within 2 edits (10 letters) with an equal end."""
    col = lambda side, c: F.col(f"{side}.{c}")
    na, nb, fa, fb, la, lb = (col(s, c) for c in ("norm", "first", "last") for s in (left, right))
    near = lambda x, y, d: F.levenshtein(x, y, d) >= 0
    return [
        ("name", (na == nb) | ((F.length(spaceless(na)) >= 6) & (spaceless(na) == spaceless(nb))) | (sorted_tokens(na) == sorted_tokens(nb))),
        ("first name", (la == lb) & (F.startswith(fa, fb) | F.startswith(fb, fa) | ((F.least(F.length(fa), F.length(fb)) >= 4) & near(fa, fb, 2)))),
        ("last name", (fa == fb) & (F.least(F.length(la), F.length(lb)) >= 5) & near(la, lb, 1)),
        ("both", (F.least(F.length(na), F.length(nb)) >= 10) & ((fa == fb) | (la == lb)) & near(na, nb, 2)),
    ]


def match_pairs(persons: DataFrame, id_name: str = "id", name: str = "name") -> DataFrame:
    """(id1, id2), id1 < id2, by whole_name_rules()."""
    from . import identity

    return identity.match_pairs(identity.traits(persons, None, id_name, name), whole_name_rules).select("id1", "id2")


def same_name_groups(persons: DataFrame, id_name: str = "id", name: str = "name") -> DataFrame:
    """ER-7. Groups of two or more persons of one normalised name with their canonical member, the lowest id."""
    n = persons.select(F.col(id_name).alias("id"), normalize_name(F.col(name)).alias("norm")).filter("norm <> ''")
    return n.groupBy("norm").agg(F.min("id").alias("canonical_id"), F.count("*").alias("n")).filter("n > 1")


def duplicate_groups(pairs: DataFrame, write, max_steps: int = 40) -> DataFrame:  # noqa: ANN001
    """ER-3. (id, canonical_id) by transitive closure of (id1, id2): each node takes the least label about it until none changes. write(df) cuts the lineage (a table or checkpoint())."""
    both = pairs.select(F.col("id1").alias("u"), F.col("id2").alias("v")).unionByName(pairs.select(F.col("id2").alias("u"), F.col("id1").alias("v")))
    both = write(both.distinct())
    labels = write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    for _ in range(max_steps):
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        # Pointer jumping: the label's own label halves the path.
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("jump"))
        new = write(labels.join(near, "u").join(jump, "label", "left").select("u", F.least("label", "near", "jump").alias("label"), "label").toDF("u", "label", "old"))
        labels = new.select("u", "label")
        if new.filter("label <> old").isEmpty():
            return labels.toDF("id", "canonical_id")
    raise RuntimeError("duplicate groups did not settle")


# How names that are none begin, end or read.
ROLES = "unknown unnamed redacted anonymous witness victim detective officer agent sergeant lieutenant captain deputy sheriff judge attorney counsel clerk secretary assistant driver pilot nurse doctor professor employee owner manager director president minor juvenile male female subject suspect defendant plaintiff respondent petitioner individual person caller sender recipient".split()
ORGANISATIONS = "inc llc llp ltd corp corporation company foundation trust bank university college school hospital department bureau agency office court county city state group associates partners holdings airlines hotel".split()
PLACES = "street avenue road boulevard lane drive island beach airport building floor suite".split()
STARTS = "the a an of and or for with from to in on at by his her their my our your no not all any some".split()
PLURALS = "victims witnesses officers agents attorneys employees parents friends others people girls women men boys staff family brothers sisters".split()


def junk_reason(name: Column, words: list[str] | None = None) -> Column:
    """ER-6. Why a name is no person's name, or null; the first reason that holds. words: a domain list, an input."""
    n = F.trim(name)
    low = F.lower(n)
    any_of = lambda xs: "(" + "|".join(xs) + ")"
    parts = F.split(low, " +")
    letters = F.regexp_replace(low, "[^a-z]", "")
    checks = [
        ("empty", F.length(n) == 0), ("short", F.length(n) < 3), ("long", F.length(n) > 60), ("digits", n.rlike(r"\d")), ("symbols", n.rlike(r"[@#$%^*_=+<>{}|\\]")),
        ("url", low.rlike(r"^https?://|www\.")), ("domain", low.rlike(r"\.(com|org|net|gov|edu)$")), ("file", low.rlike(r"\.(pdf|jpe?g|png|docx?|txt)$")),
        ("role", low.rlike(f"^{any_of(ROLES)}( |$)")), ("group", low.rlike(f"(^| ){any_of(PLURALS)}$")), ("organisation", low.rlike(f"(^| ){any_of(ORGANISATIONS)}\\.?$")), ("place", low.rlike(f"(^| ){any_of(PLACES)}$")),
        ("article", low.rlike(f"^{any_of(STARTS)} ")), ("number", low.rlike(r"^(no|number|exhibit|document|page|item|case|file|doe)\.? ")), ("placeholder", low.rlike(r"^(n/a|none|null|undefined|tbd|test|name|first last|john doe|jane doe)$")),
        ("slash", low.rlike("[/&]")), ("brackets", n.rlike(r"[()\[\]]")), ("quotes", n.rlike(r'["\u201c\u201d]')), ("question", n.rlike(r"[?!;:]")), ("possessive", low.rlike(r"'s$")), ("hyphens", low.rlike(r"^-|-$|--")),
        ("no letters", letters == ""), ("no vowels", (F.length(letters) > 3) & ~letters.rlike("[aeiouy]")), ("one letter repeated", letters.rlike(r"^(.)\1+$")), ("three alike", low.rlike(r"([a-z])\1\1")),
        ("initials only", low.rlike(r"^([a-z][. ]+)*[a-z]\.?$")), ("words repeated", (F.size(parts) > 1) & (F.size(F.array_distinct(parts)) == 1)), ("lower case", (n == low) & (F.size(parts) == 1) & (F.length(n) < 4)),
        ("many words", F.size(F.split(n, " ")) > 5), ("long word", F.exists(parts, lambda w: F.length(w) > 25)),
    ]
    if words:
        checks.append(("word list", low.isin(words)))
    return F.coalesce(*(F.when(cond, F.lit(reason)) for reason, cond in checks))


def lookup(mentions: DataFrame, persons: DataFrame, mention: str, id_name: str = "id", name: str = "name") -> DataFrame:
    """ER-14. mentions with person_id: by lower-case name, else by normalised name; the lowest id of equal names."""
    exact = persons.groupBy(F.lower(name).alias("_low")).agg(F.min(id_name).alias("_exact"))
    norm = persons.groupBy(normalize_name(F.col(name)).alias("_norm")).agg(F.min(id_name).alias("_by_norm")).filter("_norm <> ''")
    return mentions.join(exact, F.lower(mention) == F.col("_low"), "left").join(norm, normalize_name(F.col(mention)) == F.col("_norm"), "left").withColumn("person_id", F.coalesce("_exact", "_by_norm")).drop("_low", "_norm", "_exact", "_by_norm")
