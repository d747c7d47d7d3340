"""Queries of the full rule set of entity resolution, over names made from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenarc.operators import identity as I
from lumenarc.operators.resolve import duplicate_groups
from lumenarc.sources.stored import stored

from .bindings import table

QUERIES, ORACLE = {}, {}
NICKNAMES = {"coldie": "cold", "bluey": "blue", "lar": "large"}


def add(oracle: str | None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return put


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, aliases: part names as persons, each in one of twelve ways of writing."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.substring_index("p_name", " ", 1).alias("f"), F.substring_index("p_name", " ", -1).alias("l"), "p_type")
    f, l, k = F.col("f"), F.col("l"), F.col("id") % 12  # noqa: E741
    put = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    nick = F.when(f == "cold", "coldie").when(f == "blue", "bluey").when(f == "large", "lar").otherwise(f)
    broken = put(F.substring(l, 1, 2), " ", F.substring(l, 3, 2), " ", F.substring(l, 5, 2))
    ways = [put(l, ", ", f), put("Dr. ", F.initcap(f), " ", F.initcap(l)), put(f, " ", l, "s"), put(F.substring(f, 1, 1), ". ", f, " ", l), put(nick, " ", l), put(f, " ", l, " qc"), put(F.substring(f, 1, 2), " ", F.substring(f, 3, 2), " ", l), put(f, " ", l), put(F.substring(f, 1, 1), " ", l), broken, put(f, "e ", F.lower(F.substring("p_type", 1, 3)), " ", l), put(nick, " ", l, "xy")]
    name = ways[-1]
    for i, way in enumerate(ways[:-1]):
        name = F.when(k == i, way).otherwise(name)
    return p.select("id", F.trim(name).alias("name"), F.when(F.col("id") % 36 == 2, F.array(F.lit("Big Boss"), put(f, " widget"))).otherwise(F.array().cast("array<string>")).alias("aliases"))


WAYS = ["f || ' ' || l", "f || ' ' || l", "f || ' ' || l || 's'", "f[1] || ' ' || f || ' ' || l", "nk || ' ' || l", "f || ' ' || l || ' qc'", "f[1:2] || ' ' || f[3:4] || ' ' || l", "f || ' ' || l", "f[1] || ' ' || l", "trim(l[1:2] || ' ' || l[3:4] || ' ' || l[5:6])", "f || 'e ' || lower(p_type[1:3]) || ' ' || l", "nk || ' ' || l || 'xy'"]
COLLAPSED = {3: "f[1] || f || ' ' || l", 5: "f || ' ' || l || 'qc'", 6: "f[1:4] || ' ' || l", 8: "f[1] || l", 9: "l[1:6]"}
PEOPLE = f"""pp as (select p_partkey id, split_part(p_name, ' ', 1) f, split_part(p_name, ' ', 2) l, p_type, case split_part(p_name, ' ', 1) when 'cold' then 'coldie' when 'blue' then 'bluey' when 'large' then 'lar' else split_part(p_name, ' ', 1) end nk from part),
nm as (select id, l, case id % 12 {' '.join(f'when {i} then {w}' for i, w in enumerate(WAYS))} end norm, case id % 12 {' '.join(f'when {i} then {w}' for i, w in COLLAPSED.items())} else null end coll, case when id % 36 = 2 then ['big boss', f || ' widget'] else [] end al from pp),
kk as (select id, norm, coalesce(coll, norm) coll, al, string_split(norm, ' ') ps, split_part(norm, ' ', 1) f, list_extract(string_split(norm, ' '), -1) l, coalesce(list_filter(string_split(norm, ' '), lambda x: length(x) >= 2)[1], split_part(norm, ' ', 1)) rf from nm where norm like '% %'),
k as (select *, {{canon}}(f) cf, {{canon}}(rf) crf from kk), u as (select norm, al, coll, ps, f, l, rf, cf, crf, min(id) id from k group by all)"""
CANON = "case {x} when 'coldie' then 'cold' when 'bluey' then 'blue' when 'lar' then 'large' else {x} end"
PEOPLE = PEOPLE.replace("{canon}(f)", CANON.format(x="f")).replace("{canon}(rf)", CANON.format(x="rf"))


def both(x: str, y: str, n: int) -> str:
    return f"least(length({x}), length({y})) >= {n}"


def pre(x: str, y: str) -> str:
    return f"(starts_with({x}, {y}) or starts_with({y}, {x}))"


def one_word(a: str, b: str) -> str:
    return f"({a}.coll not like '% %' and length({a}.coll) >= 5 and not (len({a}.ps) = 2 and length({a}.f) = 1 and length({a}.l) >= 4) and len(list_filter({b}.ps, lambda p: length(p) >= 5 and levenshtein({a}.coll, p) <= 1)) > 0)"


RULES = [
    ("same name", "a.norm = b.norm"),
    ("same without spaces", f"{both('a.norm', 'b.norm', 6)} and replace(a.norm, ' ', '') = replace(b.norm, ' ', '')"),
    ("same after joining fragments", "a.coll = b.coll"),
    ("word in fragments", f"({one_word('a', 'b')} or {one_word('b', 'a')})"),
    ("same words", "list_sort(a.ps) = list_sort(b.ps)"),
    ("last name and first name", f"a.l = b.l and length(a.l) >= 3 and ({pre('a.f', 'b.f')} or ({both('a.f', 'b.f', 4)} and levenshtein(a.f, b.f) <= 2) or {pre('a.cf', 'b.cf')})"),
    ("last name and name behind an initial", f"a.l = b.l and length(a.l) >= 3 and (a.rf <> a.f or b.rf <> b.f) and {both('a.rf', 'b.rf', 3)} and ({pre('a.rf', 'b.rf')} or {pre('a.crf', 'b.crf')})"),
    ("last name but a letter", f"{both('a.l', 'b.l', 5)} and levenshtein(a.l, b.l) <= 1 and (({both('a.f', 'b.f', 3)} and {pre('a.f', 'b.f')}) or a.cf = b.cf)"),
    ("full first name, last name but two letters", f"{both('a.l', 'b.l', 6)} and levenshtein(a.l, b.l) <= 2 and a.cf = b.cf and length(a.cf) >= 3"),
    ("first name, longer last name", f"a.f = b.f and length(a.f) >= 3 and {both('a.l', 'b.l', 4)} and {pre('a.l', 'b.l')}"),
    ("name with words added", f"{both('a.norm', 'b.norm', 8)} and {pre('a.norm', 'b.norm')}"),
    ("whole name but two letters", f"{both('a.norm', 'b.norm', 10)} and levenshtein(a.norm, b.norm) <= 2 and ((a.f = b.f and {both('a.l', 'b.l', 4)}) or (a.l = b.l and {both('a.f', 'b.f', 3)}))"),
    ("alias", "(list_contains(a.al, b.norm) or list_contains(b.al, a.norm))"),
]


def alike(f: str, c: str) -> str:
    x, y, cx, cy = f"a.{f}", f"b.{f}", f"a.{c}", f"b.{c}"
    return f"({x} = {y} or (least(length({x}), length({y})) = 1 and {x}[1] = {y}[1]) or ({both(x, y, 3)} and {pre(x, y)}) or {cx} = {cy} or ({both(cx, cy, 4)} and {pre(cx, cy)}) or ({both(x, y, 4)} and levenshtein({x}, {y}) <= 2))"


FIRSTS = f"({alike('f', 'cf')} or {alike('rf', 'crf')})"
MERGE = [
    ("same name", "a.norm = b.norm"),
    ("same first and last", "a.f || ' ' || a.l = b.f || ' ' || b.l and length(a.f || ' ' || a.l) >= 6"),
    ("same name behind an initial", "a.rf || ' ' || a.l = b.rf || ' ' || b.l and length(a.rf || ' ' || a.l) >= 6"),
    ("same without spaces", f"{both('a.norm', 'b.norm', 7)} and replace(a.norm, ' ', '') = replace(b.norm, ' ', '')"),
    ("last name and like first", f"a.l = b.l and length(a.l) >= 3 and {FIRSTS}"),
    ("like last name and like first", f"{both('a.l', 'b.l', 5)} and levenshtein(a.l, b.l) <= 2 and {FIRSTS}"),
]


def pairs_sql(rules: list[tuple[str, str]]) -> str:
    cases = " ".join(f"when {cond} then '{label}'" for label, cond in rules)
    return f"select id1, id2, rule from (select a.id id1, b.id id2, case {cases} end rule from u a join u b on a.id < b.id) where rule is not null union all select u.id, k.id, 'same name' from k join u on k.norm = u.norm and k.al = u.al where k.id <> u.id"


GROUPS = f"with recursive {PEOPLE}, pr as ({pairs_sql(RULES)}), e as (select id1 x, id2 y from pr union select id2, id1 from pr), reach as (select x id, x r from e union select reach.id, e.y from reach join e on e.x = reach.r), g as (select id, min(r) g from reach group by 1)"


@add(f"with {PEOPLE} {pairs_sql(RULES)}")
def er1_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-1, STR-2, STR-3."""
    return I.match_pairs(I.traits(people(spark, sf_dir), NICKNAMES, aliases="aliases"))


@add(f"with {PEOPLE.replace('case when id % 36 = 2 then [' + chr(39) + 'big boss' + chr(39) + ', f || ' + chr(39) + ' widget' + chr(39) + '] else [] end al', '[]::varchar[] al')} {pairs_sql(MERGE)}")
def er2_known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.match_pairs(I.traits(people(spark, sf_dir), NICKNAMES, suffixes=True), I.merge_rules)


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    who = people(spark, sf_dir)
    pairs = stored(I.match_pairs(I.traits(who, NICKNAMES, aliases="aliases")).select("id1", "id2"), "pairs")
    return who, stored(duplicate_groups(pairs, lambda df: stored(df, "labels")), "groups")


@add(f"{GROUPS} select id, g canonical_id from g")
def er3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[1]


FACTS = "ff as (select p_partkey id, p_size mentions, p_size % 7 documents, case when p_size % 3 = 0 then 'Unknown' else p_brand end role, split_part(p_type, ' ', 1) category from part)"


@add(f"{GROUPS}, {FACTS}, j as (select * from ff join g using (id)) select g canonical_id, cast(sum(mentions) as bigint) mentions, cast(sum(documents) as bigint) documents, coalesce(arg_max(role, mentions::bigint * 1000000000 - id) filter (role <> 'Unknown'), 'Unknown') role, arg_min(category, case category when 'ECONOMY' then 1 when 'PROMO' then 2 else 99 end * 1000 + ascii(category[1]) + ascii(category[2]) / 1000.0) category from j group by 1")
def er4_merge_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups = _groups(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    facts = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("mentions"), (F.col("p_size") % 7).alias("documents"), F.when(F.col("p_size") % 3 == 0, "Unknown").otherwise(F.col("p_brand")).alias("role"), F.substring_index("p_type", " ", 1).alias("category"))
    return I.merge_aggregates(groups, facts, {"ECONOMY": 1, "PROMO": 2})


@add(f"{GROUPS}, j as (select id, g, p_size n from g join part on p_partkey = id), b as (select g, arg_max(id, n::bigint * 1000000000 - id) c from j group by 1) select id dup_id, c canonical_id from j join b using (g) where id <> c")
def er5_most_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups = _groups(spark, sf_dir)
    links = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"))
    return I.most_connected(groups.withColumnRenamed("canonical_id", "group"), links)


SHOWN = PEOPLE + f", sh as (select id, case id % 12 when 0 then l || ', ' || f when 1 then 'Dr. ' || upper(f[1]) || f[2:] || ' ' || upper(l[1]) || l[2:] when 3 then f[1] || '. ' || f || ' ' || l {' '.join(f'when {i} then {w}' for i, w in enumerate(WAYS) if i not in (0, 1, 3))} end as name from pp)"


@add(GROUPS.replace(PEOPLE, SHOWN) + ", m as (select id, g, name, lower(name) in (select lower(name) from sh where id % 36 = 2) safe, len(string_split(name, ' ')) w from g join sh using (id)), r as (select *, row_number() over (partition by g order by not safe, name like '%,%', upper(name) = name, -w, -length(name), id) n from m) select g as \"group\", id canonical_id from r where n = 1")
def win7_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-7, ER-15."""
    who, groups = _groups(spark, sf_dir)
    members = groups.join(who, "id").select(F.col("canonical_id").alias("group"), "id", "name")
    return I.canonical_members(members, who.filter("id % 36 = 2"))


MIXED = "ws as (select p_partkey id, case when p_partkey % 9 = 0 then split_part(p_name, ' ', 2) when p_partkey % 9 = 1 then 'mr. ' || split_part(p_name, ' ', 1) when p_partkey % 9 = 2 then split_part(p_name, ' ', 1) || ' ' || lower(p_type[1:4]) || ' ' || split_part(p_name, ' ', 2) when p_partkey % 9 = 3 then split_part(p_name, ' ', 1) || ' ' || replace(lower(p_brand[1:5]), '#', '') || chr(97 + cast(p_partkey % 26 as int)) else p_name || chr(97 + cast(p_partkey % 26 as int)) || chr(97 + cast(p_partkey // 26 % 26 as int)) end as name from part), wn as (select id, replace(name, 'mr. ', '') norm, starts_with(name, 'mr. ') titled from ws)"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one, two and three words, some with a title."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    f, l = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)  # noqa: E741
    letter = lambda x: F.char(97 + x % 26)
    name = F.when(k % 9 == 0, l).when(k % 9 == 1, F.concat(F.lit("mr. "), f)).when(k % 9 == 2, F.concat(f, F.lit(" "), F.lower(F.substring("p_type", 1, 4)), F.lit(" "), l)).when(k % 9 == 3, F.concat(f, F.lit(" "), F.replace(F.lower(F.substring("p_brand", 1, 5)), F.lit("#"), F.lit("")), letter(k))).otherwise(F.concat("p_name", letter(k), letter(F.floor(k / 26))))
    return p.select(k.alias("id"), name.alias("name"))


EVIDENCE = "ev as (select distinct p_partkey id, 'document' kind, l_orderkey % 40 k from lineitem join part on p_partkey = l_partkey where l_linenumber = 1 union select distinct l_partkey, 'connection', l_suppkey from lineitem where l_linenumber = 2)"


@add(f"with {MIXED}, {EVIDENCE}, o as (select id d, norm w, titled from wn where norm not like '% %'), fu as (select id, split_part(norm, ' ', 1) f, unnest(list_distinct([split_part(norm, ' ', 1), list_extract(string_split(norm, ' '), -1)])) w from wn where norm like '% %'), pr as (select d, id from o join fu using (w) where not (titled and f = 'blue')), sc as (select d, pr.id, sum(case a.kind when 'document' then 2 else 1 end) s from pr join ev a on a.id = d join ev b on b.id = pr.id and a.kind = b.kind and a.k = b.k group by 1, 2), r as (select *, row_number() over (partition by d order by s desc, id) n, lead(s) over (partition by d order by s desc, id) nx from sc) select d dup_id, id canonical_id, cast(s as bigint) score from r where n = 1 and s >= 4 and coalesce(nx, 0) * 2 <= s")
def er8_single_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    docs = li.filter("l_linenumber = 1").select(F.col("l_partkey").alias("id"), F.lit("document").alias("kind"), (F.col("l_orderkey") % 40).alias("key"))
    links = li.filter("l_linenumber = 2").select(F.col("l_partkey").alias("id"), F.lit("connection").alias("kind"), F.col("l_suppkey").alias("key"))
    gender = spark.createDataFrame([("mr", "blue")], "title string, first string")
    return I.single_words(mixed(spark, sf_dir), docs.unionByName(links), gender)


@add(f"with {MIXED}, safe as (select unnest(['widget', 'mr. red', 'bolt']) as name), by_last as (select list_extract(string_split(norm, ' '), -1) norm, min(id) c, count(*) n from wn where norm like '% %' group by 1) select wn.id, case when n = 1 then 'merge' else 'delete' end as action, case when n = 1 then c end canonical_id from wn join ws using (id) left join by_last using (norm) where norm not like '% %' and lower(name) not in (select lower(name) from safe)")
def er9_bare_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = mixed(spark, sf_dir)
    return I.bare_surnames(who, who.filter("name in ('widget', 'mr. red', 'bolt')").select("name"))


CURATED = "cu as (select upper(name) variant, case when id % 4 = 0 then name end canonical, case when id % 4 = 0 then 'merge' else 'delete' end as action from ws where id % 4 in (0, 1) and id % 9 > 3)"


@add(f"with {MIXED}, {CURATED}, by_name as (select lower(name) low, min(id) c from ws group by 1) select ws.id, action, case when action = 'merge' then c end canonical_id from ws join cu on lower(variant) = lower(name) left join by_name on low = lower(canonical) where action = 'delete' or (c is not null and c <> ws.id)")
def er10_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = mixed(spark, sf_dir)
    rows = who.filter("id % 4 in (0, 1) and id % 9 > 3")
    merge = F.col("id") % 4 == 0
    return I.curated_actions(who, rows.select(F.when(merge, F.col("name")).alias("canonical"), F.upper("name").alias("variant"), F.when(merge, "merge").otherwise("delete").alias("action")))


THREE = "wn3 as (select p_partkey id, split_part(p_name, ' ', 1) || chr(97 + cast(p_partkey // 2 % 26 as int)) f, split_part(p_name, ' ', 2) l, p_partkey % 2 = 0 two, p_size n from part), tt as (select f, l, min(id) id3, min(n) n3 from wn3 where not two group by 1, 2 having count(*) = 1), pr as (select case when n > n3 then id3 else id end d, case when n > n3 then id else id3 end c, greatest(n, n3) n from wn3 join tt using (f, l) where two)"


@add(f"with {THREE} select d dup_id, arg_max(c, n::bigint * 1000000000 - c) canonical_id from pr group by 1")
def er11_middle_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    first, last = F.concat(F.substring_index("p_name", " ", 1), F.char(97 + F.floor(k / 2) % 26)), F.substring_index("p_name", " ", -1)
    who = p.select(k.alias("id"), F.when(k % 2 == 0, F.concat_ws(" ", first, last)).otherwise(F.concat_ws(" ", first, F.lit("quincy"), last)).alias("name"))
    return I.middle_names(who, p.select(k.alias("id"), F.col("p_size").alias("n")))


def everyone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of one to three words, and as many as there are suppliers that are no names."""
    s = table(spark, sf_dir, "supplier")
    return mixed(spark, sf_dir).unionByName(s.select((F.col("s_suppkey") + 10_000_000).alias("id"), F.concat(F.lit("Unknown Male "), F.col("s_suppkey").cast("string")).alias("name")))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    docs = li.filter("l_linenumber = 1").select(F.col("l_partkey").alias("id"), F.lit("document").alias("kind"), (F.col("l_orderkey") % 40).alias("key"))
    return docs.unionByName(li.filter("l_linenumber = 2").select(F.col("l_partkey").alias("id"), F.lit("connection").alias("kind"), F.col("l_suppkey").alias("key")))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven passes. Figures and variants are made of the names themselves: the variant in capitals, the canonical name as it is."""
    who = everyone(spark, sf_dir)
    rows, merge = who.filter("id < 10000000 and id % 9 > 3"), F.col("id") % 4 == 0
    table_of = lambda df: df.select(F.when(merge, F.lit("blue widget")).alias("canonical"), F.upper("name").alias("variant"), F.when(merge, "merge").otherwise("delete").alias("action"))
    weights = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"))
    gender = spark.createDataFrame([("mr", "blue")], "title string, first string")
    passes = I.dedup_passes(_evidence(spark, sf_dir), weights, table_of(rows.filter("id % 4 in (0, 1)")), table_of(rows.filter("id % 8 in (2, 4)")), who.filter("name in ('widget', 'mr. red', 'bolt')").select("name"), gender)
    return I.sequential_plan(who, passes, lambda df: stored(df, "pass"))


CURATED_ROWS = "select upper(name) variant, case when id % 4 = 0 then 'blue widget' end canonical, case when id % 4 = 0 then 'merge' else 'delete' end as action from ws where id % 9 > 3 and {which}"


def _curated(n: int, left: str, rows: str) -> str:
    """Pass n of SQL: (id, action, canonical_id) of the curated rows on the persons of a table."""
    return f"n{n} as (select lower(name) low, min(id) c from {left} group by 1), p{n} as (select id, min((action, canonical_id)) x from (select l.id, action, case when action = 'merge' then c end canonical_id from {left} l join {rows} on lower(variant) = lower(l.name) left join n{n} on low = lower(canonical) where action = 'delete' or (c is not null and c <> l.id)) group by 1)"


def _left(n: int, before: str, handled: str) -> str:
    return f"l{n} as (select * from {before} where id not in (select id from {handled}))"


PASSES = f"""with recursive {MIXED}, {EVIDENCE}, safe as (select unnest(['widget', 'mr. red', 'bolt']) as name),
base as (select id, name, norm, titled from ws join wn using (id) union all select s_suppkey + 10000000, 'Unknown Male ' || s_suppkey, 'unknown male ' || s_suppkey, false from supplier),
p0 as (select id from base where lower(name) not in (select name from safe) and (id >= 10000000 or (name not like '% %' and length(name) < 4) or regexp_matches(name, '{'|'.join(c * 3 for c in 'abcdefghijklmnopqrstuvwxyz')}'))), {_left(0, 'base', 'p0')},
g1 as (select *, row_number() over (partition by norm order by lower(name) not in (select name from safe), name like '%,%', upper(name) = name, -len(string_split(name, ' ')), -length(name), id) k from l0),
p1 as (select g.id, c.id canonical_id from g1 g join g1 c on c.norm = g.norm and c.k = 1 where g.k > 1), {_left(1, 'l0', 'p1')},
o as (select id d, norm w, titled from l1 where norm not like '% %' and lower(name) not in (select name from safe)), fu as (select id, split_part(norm, ' ', 1) f, unnest(list_distinct([split_part(norm, ' ', 1), list_extract(string_split(norm, ' '), -1)])) w from l1 where norm like '% %'),
sc as (select d, fu.id, sum(case a.kind when 'document' then 2 else 1 end) s from o join fu using (w) join ev a on a.id = d join ev b on b.id = fu.id and a.kind = b.kind and a.k = b.k where not (titled and f = 'blue') group by 1, 2),
r as (select *, row_number() over (partition by d order by s desc, id) n, lead(s) over (partition by d order by s desc, id) nx from sc),
p2 as (select d id, id canonical_id from r where n = 1 and s >= 4 and coalesce(nx, 0) * 2 <= s), {_left(2, 'l1', 'p2')},
fig as ({CURATED_ROWS.format(which='id % 4 in (0, 1)')}), {_curated(4, 'l2', 'fig')}, {_left(4, 'l2', 'p4')},
w5 as (select l.id, name, norm, string_split(norm, ' ') ps, coalesce(p_size, 0) n from l4 l left join part on p_partkey = l.id),
t5 as (select ps[1] f, ps[3] l, min(id) id3, min(n) n3 from w5 where len(ps) = 3 group by 1, 2 having count(*) = 1),
m5 as (select case when n > n3 then id3 else id end d, case when n > n3 then id else id3 end c, greatest(n, n3) n from w5 join t5 on ps[1] = f and ps[2] = l where len(ps) = 2),
p5 as (select d id, arg_max(c, n::bigint * 1000000000 - c) canonical_id from m5 where d not in (select id from base where lower(name) in (select name from safe)) group by 1), {_left(5, 'l4', 'p5')},
var as ({CURATED_ROWS.format(which='id % 8 in (2, 4)')}), {_curated(6, 'l5', 'var')}, {_left(6, 'l5', 'p6')},
bl as (select list_extract(string_split(norm, ' '), -1) norm, min(id) c, count(*) n from l6 where norm like '% %' group by 1),
p3 as (select l6.id, case when n = 1 then 'merge' else 'delete' end as action, case when n = 1 then c end canonical_id from l6 left join bl using (norm) where norm not like '% %' and lower(name) not in (select name from safe)),
plan as (select 'junk' pass, id, 'delete' as action, null::bigint canonical_id from p0 union all select 'same name', id, 'merge', canonical_id from p1 union all select 'single words', id, 'merge', canonical_id from p2 union all select 'figures', id, x[1], x[2] from p4 union all select 'middle names', id, 'merge', canonical_id from p5 union all select 'variants', id, x[1], x[2] from p6 union all select 'surnames', * from p3)"""


@add(f"{PASSES} select * from plan")
def er12_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@add(f"{PASSES} select pass, action, count(*) n from plan group by 1, 2")
def snk11_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.plan_summary(_plan(spark, sf_dir))


@add(PASSES + ", mg as (select id, canonical_id c from plan where action = 'merge' and canonical_id <> id), fo as (select id, c, 1 n from mg union all select fo.id, mg.c, n + 1 from fo join mg on mg.id = fo.c where n < 60), en as (select id, arg_max(c, n) c from fo group by 1), gone as (select id from plan where action = 'delete') select id, case when c in (select id from gone) then null else c end canonical_id from en union all select id, null from gone")
def er13_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is merged into whom in the end; null: deleted."""
    plan = stored(_plan(spark, sf_dir), "plan")
    merged, gone = I.resolved_map(plan, everyone(spark, sf_dir), lambda df: stored(df, "map"))
    return merged.select(F.col("dup_id").alias("id"), "canonical_id").unionByName(gone.select("id", F.lit(None).cast("long").alias("canonical_id")))


@add(f"with {PEOPLE}, asked as (select id, norm from nm where id % 12 in (2, 4, 6)), known as (select id, norm from nm where id % 12 in (1, 7)), top as (select id from known where id % 2 = 1), e0 as (select norm, min(id) raw from known where id % 12 = 7 group by 1), ex as (select norm, min(id) e from known group by 1), t as (select u.* from k u where id in (select id from top)), q as (select distinct k.norm, k.al, k.coll, k.ps, k.f, k.l, k.rf, k.cf, k.crf from k join asked using (id)), fz as (select a.norm, min(b.id) z from q a join t b on ({' or '.join(f'({c})' for label, c in RULES if label != 'alias')}) group by 1) select asked.id mid, coalesce(raw, e, z) person_id from asked left join e0 using (norm) left join ex using (norm) left join fz using (norm)")
def er14_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = people(spark, sf_dir)
    known = who.filter("id % 12 in (1, 7)").select("id", "name")
    asked = who.filter("id % 12 in (2, 4, 6)").select(F.col("id").alias("mid"), F.col("name").alias("mention"))
    return I.fuzzy_lookup(asked, known, known.filter("id % 2 = 1"), "mention", NICKNAMES).select("mid", "person_id")
