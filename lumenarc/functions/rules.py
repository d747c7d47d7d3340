"""Rule tables as columns: ordered (pattern, label) rules, first match wins or all matches count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

Rules = Sequence[tuple[str, str]]


def first_label(text: Column, rules: Rules, default: str) -> Column:
    """DOC-1, DOC-2, DOC-3. The label of the first pattern found (case-insensitive)."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.rlike(p), F.lit(label)) for p, label in rules), F.lit(default))


def last_label(text: Column, rules: Rules, default: str) -> Column:
    """DOC-7. Later rules override."""
    return first_label(text, list(reversed(rules)), default)


def relation(text: Column, rules: Sequence[tuple[str, str, int]], default: str, strength: int = 1) -> Column:
    """DOC-7. Struct of connection_type and strength of the last rule (pattern, type, strength) that fits; default and `strength` where none does or the text is null."""
    low = F.lower(text)
    told = lambda kind, n: F.struct(F.lit(kind).alias("connection_type"), F.lit(n).alias("strength"))
    return F.coalesce(*(F.when(low.rlike(p), told(kind, n)) for p, kind, n in reversed(rules)), told(default, strength))


def rule_table(rules: DataFrame, most: int = 1000) -> list[tuple[str, str]]:
    """Rules from a table (priority, pattern, label), in order of priority, ties by pattern. A rule becomes part of the plan, so a table of more than `most` rules is refused; rows without pattern or label are no rules."""
    rows = rules.filter("pattern is not null and label is not null").orderBy("priority", "pattern").select("pattern", "label").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [(r["pattern"], r["label"]) for r in rows]


def status_of(category: Column) -> Column:
    """DOC-8. Only the category "victim" tells a status; all else is "named", null included."""
    return F.when(F.lower(category) == "victim", "victim").otherwise("named")


def status_of_role(category: Column, role: Column) -> Column:
    """DOC-8, the older rule: words anywhere in category and role, "victim" before "convicted" and "defendant"."""
    return first_label(F.concat_ws(" ", category, role), [("victim", "victim"), ("convicted|defendant", "convicted")], "named")


def all_labels(text: Column, rules: Rules) -> Column:
    """DOC-4, PRJ-6. Labels of all patterns found, in rule order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(label)) for p, label in rules)))


def rejected(checks: Sequence[tuple[str, Column]]) -> Column:
    """PRJ-9, ER-6. Names of the conditions that hold, as an array: empty means accepted."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in checks)))


def contains_any(columns: Sequence[Column], needle: str) -> Column:
    """FLT-5. Case-insensitive substring of any column; nothing to escape."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in columns))


def media_type(name: Column) -> Column:
    """DOC-10. Kind of media by file extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    # Fixed values.
    kinds = {"document": ["pdf", "doc", "docx", "txt", "html", "htm"], "image": ["jpg", "jpeg", "png", "gif", "webp", "tif", "tiff", "bmp"], "video": ["mp4", "mov", "avi", "mkv", "webm"], "audio": ["mp3", "wav", "m4a", "ogg"], "data": ["csv", "xls", "xlsx", "json", "xml"]}
    return F.coalesce(*(F.when(ext.isin(x), F.lit(k)) for k, x in kinds.items()), F.lit("other"))


def magic_type(content: Column) -> Column:
    """DOC-11. Kind of media by leading bytes; RIFF and ftyp containers by their brand."""
    head = F.hex(F.substring(content, 1, 16))
    brand = F.substring(head, 17, 8)
    starts = lambda *x: reduce(lambda a, b: a | b, (F.startswith(head, F.lit(h)) for h in x))
    riff = F.when(brand == "57454250", "image").when(brand == "57415645", "audio").when(brand == "41564920", "video")
    return F.when(starts("25504446"), "document").when(starts("FFD8FF", "89504E47", "47494638", "49492A00", "4D4D002A"), "image").when(starts("52494646"), riff).when(F.substring(head, 9, 8) == "66747970", F.when(F.startswith(brand, F.lit("4D3441")), "audio").otherwise("video")).when(starts("494433", "FFFB"), "audio")
