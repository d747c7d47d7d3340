"""Queries of person pages and of edges from text. Order lines stand for analysed mentions: an order is a document, a line a mention of its supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenarc.functions.rules import relation
from lumenarc.operators import profiles as P

from .bindings import edges, person_documents, sql, table

QUERIES, ORACLE = {}, {}


def query(oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    # Every second line writes the name in capitals.
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("w", F.concat(F.lit("merchant "), F.translate(F.substring("s_name", 10, 9), "0123456789", "abcdefghij")))
    return rows.select(F.col("l_orderkey").alias("analysis_id"), F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") % 2 == 0, F.upper("w")).otherwise(F.col("w")).alias("name"), F.when(F.col("l_returnflag") == "N", F.lit("Unknown")).otherwise(F.col("l_returnflag")).alias("role"), F.col("l_linestatus").alias("category"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("context"), F.col("l_quantity").cast("long").alias("mentions"), F.when(F.col("l_linenumber") == 1, "named").when(F.col("l_linenumber") == 2, "charged").otherwise("x").alias("status"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    w = F.concat(F.lit("merchant "), F.translate(F.substring("s_name", 10, 9), "0123456789", "abcdefghij"))
    first = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("analysis_id")).agg(F.min(w).alias("w"), F.max(w).alias("x"))
    fact = F.concat("w", F.when(F.col("o_orderkey") % 3 == 0, " was sued in ").otherwise(" delivered in "), F.substring("o_orderpriority", 3, 20))
    return o.join(first, F.col("o_orderkey") == F.col("analysis_id")).select("analysis_id", F.col("analysis_id").alias("document_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("document_type"), F.array(fact, F.lit("nothing of note")).alias("facts"), F.array(F.concat(F.lit("place "), (F.col("o_custkey") % 9).cast("string"))).alias("locations"), F.array(F.concat(F.lit("order of "), F.date_format("o_orderdate", "yyyy"))).alias("events"), F.array(F.struct(F.upper("x").alias("person1"), F.col("w").alias("person2"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("shipped with "), F.substring("o_orderpriority", 3, 20))).alias("description"))).alias("connections"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.concat(F.lit("merchant "), F.translate(F.substring("s_name", 10, 9), "0123456789", "abcdefghij"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), w.alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.upper(w))).alias("aliases"))


MODEL = """su as (select s_suppkey id, 'merchant ' || translate(s_name[10:18], '0123456789', 'abcdefghij') w from supplier),
me as (select l_orderkey d, w, case when l_linenumber % 2 = 0 then upper(w) else w end as name, case when l_returnflag = 'N' then 'Unknown' else l_returnflag end role, l_linestatus category, 'line ' || l_linenumber context, cast(l_quantity as bigint) mentions, l_suppkey id, case l_linenumber when 1 then 'named' when 2 then 'charged' else 'x' end status from lineitem join su on id = l_suppkey),
an as (select o_orderkey d, case when o_orderkey % 5 > 0 then o_orderstatus end document_type, mw || case when o_orderkey % 3 = 0 then ' was sued in ' else ' delivered in ' end || substr(o_orderpriority, 3, 20) fact, 'place ' || (o_custkey % 9) place, 'order of ' || strftime(o_orderdate, '%Y') ev, mw, xw, case when o_orderkey % 4 > 0 then 'shipped with ' || substr(o_orderpriority, 3, 20) end tie from orders join (select l_orderkey k, min(w) mw, max(w) xw from lineitem join su on id = l_suppkey group by 1) on k = o_orderkey)"""


@query(f"with {MODEL}, t as (select name, cast(sum(mentions) as bigint) mentions, count(distinct d) documents from me group by 1 order by 2 desc, 1 limit 1500), r as (select name, arg_max(role, (n, role)) role from (select name, role, sum(mentions) n from me group by 1, 2) group by 1), c as (select name, arg_max(category, (n, category)) category from (select name, category, sum(mentions) n from me group by 1, 2) group by 1) select name, mentions, documents, role, category from t join r using (name) join c using (name)")
def agg15_known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, WIN-2, JN-7, SNK-12 (the table of known names)."""
    return P.rolled_names(mentions(spark, sf_dir))


@query(f"with {MODEL}, h as (select id person_id, d, sum(mentions) m from me group by 1, 2), t as (select person_id, cast(sum(m) as bigint) mentions, count(*) n_documents from h group by 1), f as (select person_id, string_agg(distinct fact, ';' order by fact) facts from h join an using (d) join su on su.id = person_id where contains(fact, w) group by 1), l as (select person_id, string_agg(distinct place, ';' order by place) locations from h join an using (d) group by 1), dd as (select person_id, string_agg(d, ',' order by m desc, d) documents from (select *, row_number() over (partition by person_id order by m desc, d) n from h) where n <= 200 group by 1) select person_id, mentions, n_documents, facts, locations, documents from t left join f using (person_id) left join l using (person_id) left join dd using (person_id)")
def jn8_person_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-8, AGG-12."""
    found = P.person_mentions(persons(spark, sf_dir), mentions(spark, sf_dir), analyses(spark, sf_dir))
    return found.select("person_id", "mentions", "n_documents", F.array_join("facts", ";").alias("facts"), F.array_join("locations", ";").alias("locations"), F.array_join(F.col("documents").cast("array<string>"), ",").alias("documents"))


@query(f"""with {MODEL}, h as (select id person_id, d, role, context, mentions, w, document_type, fact, place, ev from me join an using (d)),
rows as (select person_id, 1 a, 'Roles' title, role line, sum(mentions) w from h group by 1, 4 union all select person_id, 2, 'Background', context, max(length(context)) from h group by 1, 4
union all select person_id, 3, 'Key facts', fact, count(*) from h where contains(fact, w) and fact not like '%sued%' group by 1, 4 union all select person_id, 4, 'Legal', fact, count(*) from h where contains(fact, w) and fact like '%sued%' group by 1, 4
union all select person_id, 5, 'Places', place, count(distinct d) from h group by 1, 4 union all select person_id, 6, 'Events', ev, count(*) from h group by 1, 4
union all select person_id, 7, 'Documents', concat_ws(': ', document_type, cast(count(distinct d) as varchar)), count(distinct d) from h group by 1, document_type
union all select person_id, 8, 'Connections', tie, count(*) from (select distinct id person_id, d, tie from me join an using (d) where tie is not null and w in (mw, xw)) group by 1, 4),
r as (select *, row_number() over (partition by person_id, a order by w desc, line) n from rows), s as (select person_id, a, title, string_agg(line, ';' order by n) lines from r where n <= 10 group by 1, 2, 3) select person_id, row_number() over (partition by person_id order by a) as number, title, lines from s""")
def agg20_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, DOC-23."""
    found = P.profiles(persons(spark, sf_dir), mentions(spark, sf_dir), analyses(spark, sf_dir), r"(^| )(sued|charged|settled) ")
    return found.select("person_id", "number", "title", F.array_join("lines", ";").alias("lines"))


@query(sql("edges", "select 'person' section, name as key, n from pn union all select 'connection', connection_type, count(*) from edges group by 2 union all select 'document', coalesce(document_type, 'unknown'), count(*) from an group by 2 union all select 'total', 'analyses', count(*) from an union all select 'total', 'mentions', count(*) from me", MODEL + ", pn as (select name, cast(sum(mentions) as bigint) n from me group by 1 order by 2 desc, 1 limit 20)"))
def agg13_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dashboard(mentions(spark, sf_dir), edges(spark, sf_dir), analyses(spark, sf_dir))


@query(sql("links persons", "select document_id id, string_agg(name, ',' order by name) people from links join persons on id = person_id group by 1"))
def jn2_document_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    links = person_documents(spark, sf_dir)
    found = P.document_details(links.select(F.col("document_id").alias("id")).distinct(), links, s)
    return found.select("id", F.array_join(F.transform("persons", lambda p: p["name"]), ",").alias("people"))


@query(f"with {MODEL}, p as (select id, w as name, case when id % 2 = 0 then 'unknown' else 'seller' end role, case when id % 3 = 0 then null else 'B' end category, case when id % 4 = 0 then 'a long description' else '' end description, case when id % 5 = 0 then 'charged' else 'named' end status from su), f as (select lower(name) low, arg_max(role, (mentions, role)) filter (role <> 'Unknown') r, arg_max(category, (mentions, category)) c, max(context) x, max(case status when 'named' then 1 when 'charged' then 2 else 0 end) s from me group by 1) select id, name, case when role = 'unknown' then coalesce(r, role) else role end role, case when category is null then c else category end category, case when length(x) > length(description) then x else description end description, case when s > case status when 'named' then 1 else 2 end then 'charged' else status end status from p left join f on low = name")
def dml2_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = persons(spark, sf_dir).select("id", "name", F.when(F.col("id") % 2 == 0, "unknown").otherwise("seller").alias("role"), F.when(F.col("id") % 3 != 0, "B").alias("category"), F.when(F.col("id") % 4 == 0, "a long description").otherwise("").alias("description"), F.when(F.col("id") % 5 == 0, "charged").otherwise("named").alias("status"))
    return P.enrich(p, mentions(spark, sf_dir), ["named", "charged"])


CHUNKS = """ch as (select l_orderkey document_id, l_linenumber chunk, l_partkey q, l_suppkey s, l_returnflag f, l_quantity v from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) n from lineitem) where n = 1),
en as (select document_id, chunk, unnest([0, 1]) pos, q, f, v from ch), ee as (select document_id, chunk, pos, case pos when 0 then case when chunk % 2 = 0 then 'PART ' else 'part ' end || (q % 3) else 'flag' end as name, case pos when 0 then 'part' else 'mark' end typ, case pos when 0 then 'qty' else f end k, cast(cast(v as int) as varchar) val from en)"""


@query(f"with {CHUNKS}, o as (select document_id, lower(name) key, typ, arg_min(name, (chunk, pos)) as name, min((chunk, pos)) place from ee group by 1, 2, 3), va as (select document_id, lower(name) key, typ, k, arg_max(val, (chunk, pos)) val from ee group by 1, 2, 3, 4), mp as (select document_id, key, typ, string_agg(k || '=' || val, '&' order by k) a from va group by 1, 2, 3), en2 as (select document_id, string_agg(name || '/' || typ || '/' || a, ';' order by place) entities from o join mp using (document_id, key, typ) group by 1), fa as (select document_id, string_agg(x, ';' order by c) facts from (select document_id, 'supplied by ' || (s % 4) x, min(chunk) c from ch group by 1, 2) group by 1), su as (select document_id, string_agg('c' || chunk, ' ' order by chunk) summary from ch group by 1), co as (select document_id, string_agg(d, ';' order by c) connections from (select document_id, least(s % 3, q % 3) a, greatest(s % 3, q % 3) b, f, min(chunk) c, arg_min('p' || (s % 3) || '-p' || (q % 3) || ' at ' || chunk, chunk) d from ch group by 1, 2, 3, 4) group by 1) select document_id, entities, facts, summary, connections from su join en2 using (document_id) join fa using (document_id) join co using (document_id)")
def agg19_merge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19, WIN-4."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")).alias("x"))
    v = F.col("x.l_quantity").cast("int").cast("string")
    part = F.struct(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "PART ").otherwise("part "), (F.col("x.l_partkey") % 3).cast("string")).alias("name"), F.lit("part").alias("type"), F.create_map(F.lit("qty"), v).alias("attributes"))
    flag = F.struct(F.lit("flag").alias("name"), F.lit("mark").alias("type"), F.create_map(F.col("x.l_returnflag"), v).alias("attributes"))
    none = F.array().cast("array<string>")
    one, two = (F.concat(F.lit("p"), (F.col(c) % 3).cast("string")) for c in ("x.l_suppkey", "x.l_partkey"))
    tie = F.struct(one.alias("person1"), two.alias("person2"), F.col("x.l_returnflag").alias("type"), F.concat(one, F.lit("-"), two, F.lit(" at "), F.col("l_linenumber").cast("string")).alias("description"))
    chunks = first.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk"), F.array(part, flag).alias("entities"), F.array(F.concat(F.lit("supplied by "), (F.col("x.l_suppkey") % 4).cast("string"))).alias("facts"), none.alias("locations"), none.alias("events"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("summary"), F.array(tie).alias("connections"))
    m = P.merged_items(chunks)
    entity = lambda e: F.concat_ws("/", e["name"], e["type"], F.array_join(F.transform(F.array_sort(F.map_entries(e["attributes"])), lambda x: F.concat_ws("=", x["key"], x["value"])), "&"))
    return m.select("document_id", F.array_join(F.transform("entities", entity), ";").alias("entities"), F.array_join("facts", ";").alias("facts"), "summary", F.array_join(F.transform("connections", lambda c: c["description"]), ";").alias("connections"))


KINDS = [("sued|court", "legal", 2), ("dined|met", "social", 1), ("paid|sold", "business", 3)]
#: Customers describe each other by number words; every eighth has a description.
SAID = "cp as (select c_custkey id, 'ann' || chr(97 + cast(c_custkey % 26 as int)) f, 'lee' || translate(cast(c_custkey // 2 as varchar), '0123456789', 'abcdefghij') l, c_nationkey k from customer), pe as (select id, upper(f[1]) || f[2:] || ' ' || upper(l[1]) || l[2:] as name, f, l, k from cp), de as (select a.id, a.name, a.f, a.l, case when a.id % 4 <> 0 then null when a.id % 8 = 0 then 'A quiet life. Once ' || case a.k % 4 when 0 then 'sued ' when 1 then 'dined with ' when 2 then 'paid ' else 'saw ' end || b.name || ' there. The end' else 'Knew ' || b.l || ' and wrote about it' end description from pe a left join pe b on b.id = (a.id * 7 + 3) % (select count(*) from pe))"


@query(f"with {SAID}, w as (select id, description, list_filter(string_split_regex(lower(description), '[^a-z0-9]+'), lambda x: x <> '') ws from de where description is not null), al as (select l, count(*) n from de group by 1), hit as (select w.id d, de.id o, de.l, w.description from w, de join al using (l) where w.id <> de.id and list_contains(ws, de.l) and ((n = 1 and length(de.l) > 3) or list_contains(ws, de.f) or contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || de.f || ' ' || de.l || ' '))), pr as (select least(d, o) a, greatest(d, o) b, d, o, l, description from hit), ok as (select * from pr where not exists (select 1 from orders where o_custkey = a and o_orderkey % 50 = b % 50)), one as (select *, row_number() over (partition by a, b order by d, o) n from ok), se as (select *, coalesce(list_filter(string_split(description, '. '), lambda s: contains(lower(s), l))[1], description) s from one where n = 1) select a person_id_1, b person_id_2, d describer, case when regexp_matches(lower(s), 'paid|sold') then 'business' when regexp_matches(lower(s), 'dined|met') then 'social' when regexp_matches(lower(s), 'sued|court') then 'legal' else 'associated' end connection_type, case when regexp_matches(lower(s), 'paid|sold') then 3 when regexp_matches(lower(s), 'dined|met') then 1 when regexp_matches(lower(s), 'sued|court') then 2 else 1 end strength, s description from se")
def gr5_edges_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-5, JN-12, DOC-7."""
    c = table(spark, sf_dir, "customer")
    first = F.concat(F.lit("ann"), F.char(97 + F.col("c_custkey") % 26))
    last = F.concat(F.lit("lee"), F.translate(F.floor(F.col("c_custkey") / 2).cast("string"), "0123456789", "abcdefghij"))
    pe = c.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", F.initcap(first), F.initcap(last)).alias("name"), last.alias("l"), F.col("c_nationkey").alias("k"))
    n = c.count()
    b = pe.select(F.col("id").alias("b_id"), F.col("name").alias("b_name"), F.col("l").alias("b_l"))
    k = F.col("k") % 4
    long = F.concat(F.lit("A quiet life. Once "), F.when(k == 0, "sued ").when(k == 1, "dined with ").when(k == 2, "paid ").otherwise("saw "), "b_name", F.lit(" there. The end"))
    who = pe.join(b, F.col("b_id") == (F.col("id") * 7 + 3) % n, "left").select("id", "name", F.when(F.col("id") % 8 == 0, long).when(F.col("id") % 4 == 0, F.concat(F.lit("Knew "), "b_l", F.lit(" and wrote about it"))).alias("description"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 50).alias("m")).distinct()
    # Orders link a customer to every fiftieth one: far too many pairs to write out, so they are looked up.
    linked = lambda pairs: pairs.join(o, (F.col("person_id_1") == F.col("a")) & (F.col("person_id_2") % 50 == F.col("m")), "left_semi")
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("document_id"))
    return P.edges_from_text(who, linked, links, lambda d: relation(d, KINDS, "associated")).drop("document_ids")


@query("with c as (select l_orderkey a, case when l_linenumber % 3 = 0 then upper(p_name) else p_name end s, l_linenumber % 2 = 0 sp, s_name t, l_linenumber % 4 = 1 te, l_returnflag ct, p2 from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join (select p_partkey k2, p_name p2 from part) on k2 = (l_partkey * 3 + 1) % (select count(*) from part)), e as (select lower(p_name) low, min(p_partkey) e from part group by 1) select distinct e.e entity_id, 'person' kind, s_suppkey target_id, ct connection_type from c join e on e.low = lower(s) join supplier on s_name = t where not te union select distinct x.e, 'entity', y.e, ct from c join e x on x.low = lower(s) join e y on y.low = p2 where te and x.e <> y.e")
def gr6_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, li = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    n = p.count()
    other = p.select(F.col("p_partkey").alias("k2"), F.col("p_name").alias("p2"))
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(other, F.col("k2") == (F.col("l_partkey") * 3 + 1) % n)
    name = F.when(F.col("l_linenumber") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    entity_pair, turned = F.col("l_linenumber") % 4 == 1, F.col("l_linenumber") % 2 == 0
    c = j.select(F.col("l_orderkey").alias("analysis_id"), F.when(turned, F.col("s_name")).otherwise(name).alias("source"), F.when(turned, "person").otherwise("entity").alias("source_kind"), F.when(turned, name).when(entity_pair, F.col("p2")).otherwise(F.col("s_name")).alias("target"), F.when(turned | entity_pair, "entity").otherwise("person").alias("target_kind"), F.col("l_returnflag").alias("connection_type"))
    return P.entity_edges(c, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("select o_orderkey analysis_id, [o_orderstatus] || coalesce(more, []) connections, 1 + coalesce(len(more), 0) n_connections, case when more is null then 1 else 2 end schema_version from orders left join (select l_orderkey, list(l_returnflag || l_suppkey order by l_linenumber, l_returnflag || l_suppkey) more from lineitem where l_suppkey % 3 = 0 group by 1) on l_orderkey = o_orderkey".replace("[o_orderstatus] || coalesce(more, []) connections", "array_to_string([o_orderstatus] || coalesce(more, []), ',') connections"))
def dml14_append_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.array("o_orderstatus").alias("connections"), F.lit(1).alias("n_connections"), F.lit(1).alias("schema_version"))
    new = table(spark, sf_dir, "lineitem").filter("l_suppkey % 3 = 0").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("seq"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("connection"))
    return P.append_connections(a, new).withColumn("connections", F.array_join("connections", ","))


MAP = "mp as (select s_suppkey d, s_suppkey - 1 c from supplier where s_suppkey % 5 = 3)"


def _remapped(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    from .bindings import timeline

    s = table(spark, sf_dir, "supplier")
    id_map = s.filter("s_suppkey % 5 = 3").select(F.col("s_suppkey").alias("dup_id"), (F.col("s_suppkey") - 1).alias("canonical_id"))
    who = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("old "), "s_name")).alias("aliases"))
    return P.remap_everything(id_map, who, person_documents(spark, sf_dir), timeline(spark, sf_dir))


@query(sql("links", "select s_suppkey id, s_name as name, array_to_string(['old ' || s_name] || coalesce(g, []), ',') aliases, coalesce(n, 0) n_documents from supplier left join (select c, list_sort(['old ' || s_name, s_name]) g from mp join supplier on s_suppkey = d) x on x.c = s_suppkey left join (select coalesce(c, person_id) p, count(distinct document_id) n from links left join mp on d = person_id group by 1) y on y.p = s_suppkey where s_suppkey not in (select d from mp)", MAP))
def dml4_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _remapped(spark, sf_dir)[0].withColumn("aliases", F.array_join("aliases", ","))


@query(sql("timeline", "select id, array_to_string(list_sort(list_distinct(list_transform(person_ids, lambda x: case when x % 5 = 3 then x - 1 else x end))), ',') people from timeline"))
def dml4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _remapped(spark, sf_dir)[2].select("id", F.array_join(F.col("person_ids").cast("array<string>"), ",").alias("people"))


@query("with l as (select user_id job_id, event_id seq, value > 150 ok from events), f as (select job_id, min(seq) filter (ok) a from l group by 1), n as (select l.job_id, count(*) filter (not ok and (a is null or seq < a)) fails, min(a) a from l join f using (job_id) group by 1) select job_id, least(fails, 3) attempts, case when fails >= 3 then 'failed' when a is not null then 'done' else 'pending' end status from n")
def dml11_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.job_retries(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), (F.col("value") > 150).alias("ok")))


@query(sql("edges", "select person_id, degree, (select max(degree) from dg) most from dg", "dg as (select p person_id, count(*) degree from (select person_id_1 p from edges union all select person_id_2 from edges) group by 1)"))
def gr3_degrees_and_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenarc.operators.graph import degrees

    d = degrees(edges(spark, sf_dir))
    return d.select("person_id", "degree").crossJoin(d.agg(F.max("degree").alias("most")))  # one row
