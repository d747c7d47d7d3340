"""Keys by which words that are nearly alike meet in equality joins. A key has a role: a probe of one word meets an index entry of another."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PROBE, INDEX = 1, 2
NO_KEYS = "array<struct<key:bigint,role:int>>"


def role_key(tag: str, role: int, *parts: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(tag), *parts).alias("key"), F.lit(role).alias("role"))


def near_keys(tag: str, trait: Column, word: Column, d: int, least: int, role: int = PROBE | INDEX, longer: int = 0) -> Column:
    """Keys that two words of at least so many letters within d edits share beside an equal trait, by the pigeonhole principle: of d + 1 segments of
    the shorter word one is untouched, and stands in the longer word near its place. A word indexes its own segments and probes those that words
    of its length and up to d letters less could have, at the places that the edits before and behind a segment allow (longer: and of so many letters more)."""
    n, k, none = F.length(word), d + 1, F.array().cast(NO_KEYS)

    def of_length(delta: Column) -> Column:
        size = n - delta
        base, extra = F.floor(size / k).cast("int"), size % k

        def of_segment(i: Column) -> Column:
            part = base + F.when(i > k - extra, 1).otherwise(0)
            start = (i - 1) * base + F.greatest(i - 1 - k + extra, F.lit(0)) + 1
            low, high = F.greatest(start - i + 1, start + delta - k + i, F.lit(1)), F.least(start + i - 1, start + delta + k - i, n - part + 1)
            own = lambda p: (delta == 0) & (p == start)
            entry = lambda p: F.struct(F.xxhash64(F.lit(tag), trait, size, i, F.substr(word, p, part)).alias("key"), F.when(own(p), role).otherwise(role & PROBE).alias("role"))
            return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), entry)).otherwise(none)

        return F.when(size >= least, F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), of_segment))).otherwise(none)

    found = F.flatten(F.transform(F.sequence(F.lit(-longer), F.lit(d)), of_length))
    return F.when(n >= least, F.filter(found, lambda x: x["role"] > 0)).otherwise(none)


def prefix_keys(tag: str, trait: Column, word: Column, least: Column | int = 1, role: int = PROBE | INDEX) -> Column:
    """Keys for "one word begins with the other": a word indexes itself and probes all its beginnings of at least so many letters."""
    n, least = F.length(word), F.lit(least) if isinstance(least, int) else least
    entry = lambda i: F.struct(F.xxhash64(F.lit(tag), trait, F.substr(word, F.lit(1), i)).alias("key"), F.when(i == n, role).otherwise(role & PROBE).alias("role"))
    return F.when(n >= least, F.filter(F.transform(F.sequence(least, F.greatest(n, least)), entry), lambda x: x["role"] > 0)).otherwise(F.array().cast(NO_KEYS))
