"""Scalar functions on text, dates, scores and JSON: Column in, Column out, no Python per row.

Word boundaries are written out as character classes: Java's \\b knows Unicode letters, SQL engines' and scripting languages' does not.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Titles and suffixes dropped from names, white space of category Zs, months and seasons, English stopwords for keywords.
TITLES = ["dr", "mr", "mrs", "ms", "miss", "ii", "iii", "iv"]
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "esq"]
SPACES = "".join(map(chr, [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SEASONS = ["spring", "summer", "fall", "autumn", "winter"]
STOPWORDS = "a an and are as at be been but by did do does for from had has have he her his how i in is it its me my no not of on or our she so that the their them then there they this to was we were what when where which who whom why will with would you your".split()


def trim_spaces(text: Column) -> Column:
    """A text without the spaces of any kind (Unicode Zs) at both ends, as SQL engines trim; F.trim alone knows the plain one. A lambda must call it: given F.trim itself, transform() passes an element's index as the characters to trim."""
    return F.trim(text, F.lit(SPACES))


def normalize_name(name: Column) -> Column:
    """STR-1. Lower case, "last, first" turned round, titles and Roman suffixes dropped, only a-z and single spaces left."""
    low = F.lower(name)
    parts = F.split(low, ",")
    turned = F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0))))).otherwise(low)
    title = r"(^|[^a-z0-9_])(" + "|".join(TITLES) + r")\.?($|[^a-z0-9_])"
    bare = F.regexp_replace(F.regexp_replace(turned, title, "$1$3"), title, "$1$3")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("."), F.lit("")), "[^a-z ]", ""), " +", " "))


def spaceless(name: Column) -> Column:
    """STR-4."""
    return F.replace(name, F.lit(" "), F.lit(""))


def sorted_tokens(name: Column) -> Column:
    """STR-4. Words in order, as one key."""
    return F.array_join(F.array_sort(F.split(name, " ")), " ")


def strip_suffix(name: Column) -> Column:
    """STR-6. Drops trailing generational suffixes from names of more than two parts."""
    cut = F.regexp_replace(F.lower(name), r"(,? (" + "|".join(SUFFIXES) + r")\.?)+$", "")
    return F.when(F.size(F.split(name, " ")) > 2, cut).otherwise(F.lower(name))


def escape_xml(text: Column) -> Column:
    """STR-8."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def file_name(text: Column) -> Column:
    """STR-8. A name that file systems accept."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|#\[\]^]', "-"), r"\s+", " ")), 1, 100)


def quote_csv(text: Column) -> Column:
    """STR-8. A field in quotes, its own doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def normalize_query(text: Column) -> Column:
    """STR-9. Lower case and trimmed; null below two characters."""
    q = F.lower(F.trim(text))
    return F.when(F.length(q) >= 2, q)


def keywords(text: Column) -> Column:
    """STR-10. Words of more than one letter that are no stopwords, in order."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def strip_html(text: Column) -> Column:
    """STR-11."""
    return F.regexp_replace(text, "<[^>]*>", "")


def truncate(text: Column, n: int, marker: str = "...") -> Column:
    """STR-12."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def sentences_about(text: Column, name: Column, default: Column, most: int = 2) -> Column:
    """STR-13. The first sentences that mention a name."""
    found = F.slice(F.filter(F.split(text, r"\. "), lambda s: F.contains(s, name)), 1, most)
    return F.when(F.size(found) > 0, F.array_join(found, ". ")).otherwise(default)


def host(url: Column) -> Column:
    """STR-15."""
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))


def host_allowed(url: Column, domains: list[str]) -> Column:
    """STR-15. The host is one of the domains or below one."""
    h = host(url)
    found = F.lit(False)
    for d in domains:
        found = found | (h == d) | F.endswith(h, F.lit("." + d))
    return found


def base_name(url: Column) -> Column:
    """PRJ-7, STR-15. Last path part without query and fragment."""
    return F.substring_index(F.regexp_replace(url, r"[?#].*$", ""), "/", -1)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normalize_event_date(text: Column) -> Column:
    """DT-1. Text dates of mixed precision to YYYY, YYYY-MM or YYYY-MM-DD; the first rule that fits counts."""
    t = F.lower(F.trim(text))
    month = F.create_map(*(x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))))
    names = "(" + "|".join(MONTHS) + ")"
    at = lambda pattern, g: _found(t, pattern, g)
    # What stands before or behind a date doesn't matter once a month is named.
    full, short = rf"{names} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})", rf"{names},? (\d{{4}})"
    year = _found(t, r"(?:^|[^0-9])((?:19|20)\d\d)(?:[^0-9]|$)", 1)
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}(-\d{2}){0,2}$"), t),
        at(r"^(\d{4}-\d{2})-\d{4}$", 1),
        at(r"^(\d{4}(?:-\d{2}){0,2}) to ", 1),
        at(r"^(\d{4}) ?[-\u2013] ?\d{4}$", 1),
        F.when(t.rlike(full), F.concat_ws("-", at(full, 3), F.try_element_at(month, at(full, 1)), F.lpad(at(full, 2), 2, "0"))),
        F.when(t.rlike(short), F.concat_ws("-", at(short, 2), F.try_element_at(month, at(short, 1)))),
        at("(?:" + "|".join(SEASONS) + r")(?: of)? (\d{4})", 1),
        at(r"(?:circa|c\.|approximately|approx\.|about|around) ?(\d{4})", 1),
        at(r"(\d{3}0)'?s", 1),
        F.when(year.cast("int").between(1900, 2030), year),
    )


def year_of(text: Column) -> Column:
    """DT-2. First 19xx or 20xx, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(19\d\d|20\d\d)", 1), F.lit("")).cast("int"), F.lit(0))


def display_date(date: Column) -> Column:
    """DT-3. "Mon d, yyyy", "Mon yyyy" or the text itself."""
    names = F.array(*(F.lit(m[:3].capitalize()) for m in MONTHS))
    mon = F.get(names, F.try_to_number(F.substring(date, 6, 2), F.lit("99")).cast("int") - 1)
    day = F.try_to_number(F.substring(date, 9, 2), F.lit("99")).cast("int").cast("string")
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(mon, F.lit(" "), day, F.lit(", "), F.substring(date, 1, 4))).when(date.rlike(r"^\d{4}-\d{2}$"), F.concat(mon, F.lit(" "), F.substring(date, 1, 4))).otherwise(date)


def length_score(n: Column) -> Column:
    """MTH-1."""
    return F.when(n < 200, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.log10(n / 200.0) * 37.0))


def mention_score(n: Column) -> Column:
    """MTH-2."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), 30.0 + (n - 1) * 15.0))


def weighted_score(length: Column, mention: Column, kind: Column, group: Column) -> Column:
    """MTH-3."""
    return 0.25 * length + 0.30 * mention + 0.25 * kind + 0.20 * group


def reply_json(text: Column, schema: str) -> Column:
    """JSN-1. JSON out of a model's reply: code fences stripped, else the outermost braces."""
    bare = F.trim(F.regexp_replace(text, r"```(json)?", ""))
    return F.coalesce(F.when(bare.startswith("{"), F.from_json(bare, schema)), F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")), schema))


def named(items: Column, least: int) -> Column:
    """JSN-1. The structs of an array whose field name has at least so many characters; a null array is empty."""
    return F.filter(F.coalesce(items, F.array()), lambda x: F.coalesce(F.length(x["name"]), F.lit(0)) >= least)


def merge_maps(left: Column, right: Column) -> Column:
    """JSN-3. Right side wins, whatever the session's policy for repeated keys."""
    return F.map_zip_with(left, right, lambda k, a, b: F.coalesce(b, a))


def listed(text: Column) -> Column:
    """ARR-4. The elements of a JSON array of texts, or of a list with commas."""
    plain = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>")).otherwise(plain)


def place_name(item: Column) -> Column:
    """JSN-2. A place that is told as text or as an object with a location or a name."""
    return F.when(F.startswith(F.ltrim(item), F.lit("{")), F.coalesce(F.get_json_object(item, "$.location"), F.get_json_object(item, "$.name"))).otherwise(item)
