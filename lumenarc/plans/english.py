"""Queries of the English index: analysis, ranked search with all its steps, fragments, misspellings. The SQL spells out the stemmer's steps from the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenarc.functions import english as E
from lumenarc.operators.ranked import EnglishIndex, fragments

from .bindings import table

QUERIES, ORACLE = {}, {}


def query(oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


def ladder_sql(rules: list[tuple[str, str, int, str]]) -> str:
    cases = []
    for suffix, to, region, before in sorted(rules, key=lambda r: -len(r[0])):
        cut = f"w[1:length(w) - {len(suffix)}]"
        fits = f"length(w) - {len(suffix)} >= p{region}" + (f" and regexp_matches({cut}, '{before}$')" if before else "")
        cases.append(f"when ends_with(w, '{suffix}') then case when {fits} then {cut} || '{to}' else w end")
    return f"case {' '.join(cases)} else w end"


def stems_sql(source: str) -> str:
    """Common table expressions s0 to stemmed (term, stem) for a table with distinct terms."""
    own = " ".join(f"when '{k}' then '{v}'" for k, v in E.OWN.items())
    region = lambda x: f"case when regexp_matches({x}, '{E.REGION}') then length(regexp_extract({x}, '{E.REGION}', 1)) else length({x}) end"
    has = lambda rx, x="w": f"regexp_matches({x}, '{rx}')"
    cut = lambda n: f"w[1:length(w) - {n}]"
    ending = "length(regexp_extract(w, '(ingly|edly|ing|ed)$', 1))"
    keep = "term, fixed, p1, p2"
    steps = [
        f"s0 as (select term, coalesce(case term {own} end, case when length(term) < 3 then term end) fixed, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') w from {source})",
        f"s1 as (select *, case when {has(E.BEGIN)} then length(regexp_extract(w, '{E.BEGIN}', 1)) else {region('w')} end p1 from s0)",
        f"s2 as (select *, p1 + {region('w[p1 + 1:]')} p2 from s1)",
        f"s3 as (select {keep}, case when ends_with(w, 'sses') then {cut(2)} when {has('(ied|ies)$')} then case when length(w) > 4 then {cut(2)} else {cut(1)} end when {has('(us|ss)$')} then w when ends_with(w, 's') and {has('[aeiouy].+$', cut(1))} then {cut(1)} else w end w from s2)",
        f"s4 as (select term, coalesce(fixed, case when w in ({', '.join(repr(x) for x in E.STAY)}) then w end) fixed, p1, p2, w, {ending} > 0 and not {has('(eed|eedly)$')} and {has('[aeiouy]', f'w[1:length(w) - {ending}]')} gone from s3)",
        f"s5 as (select {keep}, gone, case when ends_with(w, 'eedly') then case when length(w) - 5 >= p1 then {cut(3)} else w end when ends_with(w, 'eed') then case when length(w) - 3 >= p1 then {cut(1)} else w end when gone then w[1:length(w) - {ending}] else w end w from s4)",
        f"s6 as (select {keep}, case when not gone then w when {has('(at|bl|iz)$')} then w || 'e' when {has(E.DOUBLE)} then {cut(1)} when length(w) <= p1 and {has(E.SHORT)} then w || 'e' else w end w from s5)",
        f"s7 as (select {keep}, case when {has('^.+[^aeiouy][yY]$')} then {cut(1)} || 'i' else w end w from s6)",
        *(f"s{i} as (select {keep}, {ladder_sql(rules)} w from s{i - 1})" for i, rules in ((8, E.STEP_2), (9, E.STEP_3), (10, E.STEP_4))),
        f"stemmed as (select term, coalesce(fixed, lower(case when (ends_with(w, 'e') and (length(w) - 1 >= p2 or (length(w) - 1 >= p1 and not {has(E.SHORT, cut(1))}))) or (ends_with(w, 'll') and length(w) - 1 >= p2) then {cut(1)} else w end)) stem from s10)",
    ]
    return ", ".join(steps)


STOPS = ", ".join(f"'{w}'" for w in E.STOP_WORDS)
WORDS = f"""w as (select doc_id page_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') ws from documents),
tok as (select page_id, unnest(ws) term, unnest(range(len(ws))) spot from w), raw as (select * from tok where term not in ({STOPS})), terms as (select distinct term from raw), {stems_sql('terms')},
post as (select stem, page_id, count(*) tf, list(spot order by spot) ats from raw join stemmed using (term) group by 1, 2), sizes as (select page_id, count(*) n_words from raw group by 1), st as (select (select count(*) from w) n, (select sum(n_words) from sizes) / (select count(*) from w) m),
dfs as (select stem, count(*) df from post group by 1)"""
SCORES = """sc as (select page_id, stem, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / m)) s from post join dfs using (stem) join sizes using (page_id), st where stem in ({stems}))"""


def built(spark: SparkSession, sf_dir: str) -> EnglishIndex:
    """The index of the documents: the first query over a table builds it, later ones find it until the table's files change."""
    return EnglishIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text", k="documents")


def marks_sql(text: str, wanted: str) -> str:
    """FTS-5 in SQL for the rows of `{text}` (page_id, text, ...); wanted: stems. Adds the tables said to told (page_id, headline)."""
    return f"""wanted as (select term, stem from stemmed where stem in ({wanted})), rx as (select '(?i)(^|[^a-z0-9])(' || string_agg(term, '|' order by term) || ')($|[^a-z0-9])' pattern from wanted),
said as (select page_id, string_split_regex(trim(text), '\\s+') ws from {text}),
hits as (select page_id, i, stem from (select page_id, i, unnest(string_split_regex(lower(ws[i + 1]), '[^a-z0-9]+')) term from (select page_id, ws, unnest(range(len(ws))) i from said)) join wanted using (term)),
wins as (select h.page_id, h.i, count(distinct x.stem) kinds, count(*) n, max(x.i) last from (select distinct page_id, i from hits) h join hits x on x.page_id = h.page_id and x.i >= h.i and x.i < h.i + 35 group by 1, 2),
ext as (select page_id, i, kinds, wins.n, least(greatest(last, i + 14), len(ws) - 1) high, ws from wins join said using (page_id)),
ext2 as (select page_id, i, kinds, n, least(i, greatest(high - 14, 0)) low, high, ws from ext),
one as (select * from (select *, row_number() over (partition by page_id order by kinds desc, n desc, i) r from ext2) where r = 1),
two as (select * from (select e.*, row_number() over (partition by e.page_id order by e.kinds desc, e.n desc, e.i) r from ext2 e join one o on o.page_id = e.page_id and (e.low > o.high or e.high < o.low)) where r = 1),
told as (select page_id, string_agg(part, ' ... ' order by low) headline from (select page_id, low, array_to_string(list_transform(ws[low + 1:high + 1], lambda x: regexp_replace(x, rx.pattern, '\\1<mark>\\2</mark>\\3', 'g')), ' ') part from (select * from one union all select * from two), rx) group by 1)"""


@query(f"with {WORDS} select stem, count(*) df, cast(sum(tf) as bigint) cf from post group by 1")
def fts1_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-1 with stop words and stems."""
    return built(spark, sf_dir).postings.groupBy("stem").agg(F.count("*").alias("df"), F.sum(F.size("at")).alias("cf"))


@query(f"with {WORDS}, {SCORES.format(stems="'thing', 'rewh', 'attion'")}, fit as (select page_id, round(sum(s), 6) score from sc group by 1 having count(*) filter (stem in ('thing', 'rewh')) = 2 or count(*) filter (stem = 'attion') = 1), best as (select * from fit where page_id not in (select page_id from post where stem = 'ononst') order by score desc, page_id limit 60), shown as (select page_id, score, lang, source, text from best join documents on doc_id = page_id where n_chars < 6000 order by score desc, page_id limit 20), {marks_sql('shown', "'thing', 'rewh', 'attion'")} select page_id, score, lang, source, headline from shown left join told using (page_id)")
def fts4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-4, FTS-5: the best pages, their metadata, those that may be shown, highlighted."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text", "lang", "source", "n_chars")
    found = built(spark, sf_dir).search("things rewhs or attions -ononst", d, 20, F.col("n_chars") < 6000)
    return found.select("page_id", "score", "lang", "source", "headline")


@query(f"with {WORDS}, {SCORES.format(stems="'er', 'attion'")} select page_id, round(sum(s), 6) score from sc group by 1 order by score desc, page_id limit 10")
def fts4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-4: two stems of which one is rare; blocks below the tenth score are not read."""
    return built(spark, sf_dir).best("er or attion", 10)[0]


@query(f"with {WORDS}, pages as (select doc_id page_id, text from documents where lang = 'en'), {marks_sql('pages', "'thing', 'rewh', 'attion'")} select page_id, headline from told")
def fts5_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-5 on every English page with a hit: its best two fragments."""
    words = built(spark, sf_dir).surface(["thing", "rewh", "attion"])
    d = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("page_id"), fragments(F.col("text"), words).alias("headline"))
    return d.filter(F.contains("headline", F.lit("<mark>")))


@query(f"with {WORDS} select term, count(distinct page_id) pages, levenshtein(term, 'thinge') distance from raw where levenshtein(term, 'thinge') <= 2 group by 1")
def fts8_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-8: terms near a misspelled one, by the stored forms."""
    return built(spark, sf_dir).near_terms("thinge").select("term", "pages", F.col("distance").cast("long").alias("distance"))
