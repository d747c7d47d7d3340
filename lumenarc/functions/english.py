"""English analysis: stop words and the suffix rules of the Snowball English stemmer, as columns over a table of distinct words."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

# Common words that are no search terms, in natural order.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Fixed values of the stemmer: words that have a stem of their own, words that stay after their plural is gone, beginnings after which the first region starts.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STAY = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
BEGIN = "^(gener|commun|arsen)"

# Suffix, what takes its place, the region it must lie in, what must stand before it.
STEP_2 = [
    ("ational", "ate", 1, ""), ("fulness", "ful", 1, ""), ("iveness", "ive", 1, ""), ("ization", "ize", 1, ""), ("ousness", "ous", 1, ""), ("biliti", "ble", 1, ""), ("lessli", "less", 1, ""), ("tional", "tion", 1, ""),
    ("alism", "al", 1, ""), ("aliti", "al", 1, ""), ("ation", "ate", 1, ""), ("entli", "ent", 1, ""), ("fulli", "ful", 1, ""), ("iviti", "ive", 1, ""), ("ousli", "ous", 1, ""), ("abli", "able", 1, ""), ("alli", "al", 1, ""), ("anci", "ance", 1, ""),
    ("ator", "ate", 1, ""), ("enci", "ence", 1, ""), ("izer", "ize", 1, ""), ("bli", "ble", 1, ""), ("ogi", "og", 1, "l"), ("li", "", 1, "[cdeghkmnrt]"),
]
STEP_3 = [("ational", "ate", 1, ""), ("tional", "tion", 1, ""), ("alize", "al", 1, ""), ("ative", "", 2, ""), ("icate", "ic", 1, ""), ("iciti", "ic", 1, ""), ("ical", "ic", 1, ""), ("ness", "", 1, ""), ("ful", "", 1, "")]
STEP_4 = [(s, "", 2, "[st]" if s == "ion" else "") for s in "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()]

REGION = "^(.*?[aeiouy][^aeiouy])"
SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


def _cut(w: Column, n: int) -> Column:
    return F.substr(w, F.lit(1), F.length(w) - n)


def _ladder(rules: list[tuple[str, str, int, str]]) -> Column:
    """The longest suffix that the word ends in decides; where its region or the letter before it doesn't fit, the word stays."""
    w = out = F.col("w")
    for suffix, to, region, before in sorted(rules, key=lambda r: len(r[0])):
        fits = F.length(w) - len(suffix) >= F.col(f"p{region}")
        fits = fits & _cut(w, len(suffix)).rlike(before + "$") if before else fits
        out = F.when(F.endswith(w, F.lit(suffix)), F.when(fits, F.concat(_cut(w, len(suffix)), F.lit(to))).otherwise(w)).otherwise(out)
    return out


def stems(words: DataFrame, word: str = "term", stem: str = "stem") -> DataFrame:
    """The table with the stem of each word, which is in lower case. Meant for distinct words: each step is one projection."""
    w, keep = F.col("w"), [F.col(f"`{c}`") for c in words.columns]
    region = lambda x: F.when(x.rlike(REGION), F.length(F.regexp_extract(x, REGION, 1))).otherwise(F.length(x))
    own = F.create_map(*(F.lit(x) for pair in sorted(OWN.items()) for x in pair))
    d = words.select(*keep, F.coalesce(F.try_element_at(own, F.col(word)), F.when(F.length(word) < 3, F.col(word))).alias("fixed"), F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y").alias("w"))
    d = d.select("*", F.when(w.rlike(BEGIN), F.length(F.regexp_extract(w, BEGIN, 1))).otherwise(region(w)).alias("p1"))
    d = d.select("*", (F.col("p1") + region(F.substr(w, F.col("p1") + 1))).alias("p2"))

    def then(d: DataFrame, new: Column) -> DataFrame:
        return d.withColumn("w", new)

    ends = lambda *s: F.lit(False) if not s else w.rlike(f"({'|'.join(s)})$")
    # Plurals and third persons.
    d = then(d, F.when(ends("sses"), _cut(w, 2)).when(ends("ied", "ies"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))).when(ends("us", "ss"), w).when(ends("s") & _cut(w, 1).rlike("[aeiouy].+$"), _cut(w, 1)).otherwise(w))
    d = d.withColumn("fixed", F.coalesce("fixed", F.when(w.isin(STAY), w)))
    # Pasts and participles; what they leave gets its e back or loses its double letter.
    n = F.length(F.regexp_extract(w, "(ingly|edly|ing|ed)$", 1))
    left = F.substr(w, F.lit(1), F.length(w) - n)
    d = d.withColumn("gone", (n > 0) & ~ends("eed", "eedly") & left.rlike("[aeiouy]"))
    d = then(d, F.when(ends("eedly"), F.when(F.length(w) - 5 >= F.col("p1"), _cut(w, 3)).otherwise(w)).when(ends("eed"), F.when(F.length(w) - 3 >= F.col("p1"), _cut(w, 1)).otherwise(w)).when(F.col("gone"), left).otherwise(w))
    d = then(d, F.when(~F.col("gone"), w).when(ends("at", "bl", "iz"), F.concat(w, F.lit("e"))).when(w.rlike(DOUBLE), _cut(w, 1)).when((F.length(w) <= F.col("p1")) & w.rlike(SHORT), F.concat(w, F.lit("e"))).otherwise(w))
    d = then(d, F.when(w.rlike("^.+[^aeiouy][yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    for step in (STEP_2, STEP_3, STEP_4):
        d = then(d, _ladder(step))
    at = F.length(w) - 1
    last_e = (at >= F.col("p2")) | ((at >= F.col("p1")) & ~_cut(w, 1).rlike(SHORT))
    d = then(d, F.when((ends("e") & last_e) | (ends("ll") & (at >= F.col("p2"))), _cut(w, 1)).otherwise(w))
    return d.select(*keep, F.coalesce("fixed", F.lower(w)).alias(stem))


def _climb(w: str, rules: list[tuple[str, str, int, str]], p: tuple[int, int]) -> str:
    for suffix, to, region, before in rules:
        if w.endswith(suffix):
            left = w[: len(w) - len(suffix)]
            return left + to if len(left) >= p[region - 1] and (not before or re.search(before + "$", left)) else w
    return w


_LADDERS = [sorted(step, key=lambda r: -len(r[0])) for step in (STEP_2, STEP_3, STEP_4)]


def stem_of(word: str) -> str:
    """The stem that stems() gives, of one word of a-z and 0-9, for use inside tasks (tested to be equal)."""
    if word in OWN or len(word) < 3:
        return OWN.get(word, word)
    region = lambda x: len(m[1]) if (m := re.match(REGION, x)) else len(x)
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    p1 = len(m[1]) if (m := re.match(BEGIN, w)) else region(w)
    p2 = p1 + region(w[p1:])
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].+$", w[:-1]):
        w = w[:-1]
    if w in STAY:
        return w
    if w.endswith("eedly"):
        w = w[:-3] if len(w) - 5 >= p1 else w
    elif w.endswith("eed"):
        w = w[:-1] if len(w) - 3 >= p1 else w
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search("[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(DOUBLE, w):
            w = w[:-1]
        elif len(w) <= p1 and re.search(SHORT, w):
            w += "e"
    if re.search("^.+[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    for rules in _LADDERS:
        w = _climb(w, rules, (p1, p2))
    at = len(w) - 1
    if (w.endswith("e") and (at >= p2 or (at >= p1 and not re.search(SHORT, w[:-1])))) or (w.endswith("ll") and at >= p2):
        w = w[:-1]
    return w.lower()


def with_stems(words: DataFrame) -> DataFrame:
    """The table (term, pages) with the stem of each term, as stems() gives it, at a fraction of its time for a large dictionary."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([stem_of(w) for w in b.column(0).to_pylist()], pa.string())], names=["term", "pages", "stem"])

    return words.select("term", "pages").mapInArrow(run, "term string, pages long, stem string")
