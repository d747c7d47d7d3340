"""Queries of entity resolution and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenarc.operators import maintenance as M, resolve as E

from .bindings import edges, sql, table

QUERIES, ORACLE = {}, {}


def query(oracle: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with variants: part names as persons, some turned round, some with a title, some with a letter doubled."""
    p = table(spark, sf_dir, "part")
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(last, F.lit(", "), first)).when(k == 1, F.concat(F.lit("Dr. "), F.initcap("p_name"))).when(k == 2, F.concat(first, F.lit(" "), last, F.lit("s"))).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"))


NAMES = """nm as (select p_partkey id, case p_partkey % 5 when 2 then p_name || 's' else p_name end norm from part), k as (select id, norm, split_part(norm, ' ', 1) f, split_part(norm, ' ', 2) l from nm)"""
SAME = """(a.norm = b.norm or (length(replace(a.norm, ' ', '')) >= 6 and replace(a.norm, ' ', '') = replace(b.norm, ' ', '')) or list_sort(string_split(a.norm, ' ')) = list_sort(string_split(b.norm, ' '))
or (a.l = b.l and (starts_with(a.f, b.f) or starts_with(b.f, a.f) or (least(length(a.f), length(b.f)) >= 4 and levenshtein(a.f, b.f) <= 2)))
or (a.f = b.f and least(length(a.l), length(b.l)) >= 5 and levenshtein(a.l, b.l) <= 1) or (least(length(a.norm), length(b.norm)) >= 10 and (a.f = b.f or a.l = b.l) and levenshtein(a.norm, b.norm) <= 2))"""


@query(f"with {NAMES}, u as (select norm, f, l, min(id) id from k group by 1, 2, 3) select a.id id1, b.id id2 from u a join u b on a.id < b.id and {SAME} union all select u.id, k.id from k join u using (norm) where k.id <> u.id")
def er1_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.match_pairs(names(spark, sf_dir))


@query(f"with {NAMES} select norm, min(id) canonical_id, count(*) n from nm group by 1 having count(*) > 1")
def er7_same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.same_name_groups(names(spark, sf_dir))


#: One name for each reason, made of a part's name, and the reason; none for the last two.
JUNK = [("{} 7", "digits"), ("{}@x", "symbols"), ("www.{}.x", "url"), ("{}.com", "domain"), ("{}.pdf", "file"), ("Unknown {}", "role"), ("the {} girls", "group"), ("{} Holdings", "organisation"), ("{} Street", "place"), ("His {}", "article"), ("Exhibit {}", "number"), ("John Doe", "placeholder"), ("{} / x", "slash"), ("({})", "brackets"), ("'{}\"", "quotes"), ("{}?", "question"), ("{}'s", "possessive"), ("--{}", "hyphens"), ("xkcd brt", "no vowels"), ("aaaa", "one letter repeated"), ("{} xeeeq", "three alike"), ("J. R.", "initials only"), ("bora bora", "words repeated"), ("abi", "lower case"), ("{} a b c d e", "many words"), ("{} abcdefghijklmnopqrstuvwxyz", "long word"), ("{}", None), ("Maria {}", None)]


@query("select p_partkey id, case p_partkey % 28 " + " ".join(f"when {i} then {'null' if r is None else repr(r)}" for i, (_, r) in enumerate(JUNK)) + " end reason from part")
def er6_junk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pattern = F.element_at(F.array(*(F.lit(t) for t, _ in JUNK)), (F.col("p_partkey") % len(JUNK) + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), E.junk_reason(F.replace(pattern, F.lit("{}"), F.col("p_name"))).alias("reason"))


@query("with p as (select min(s_suppkey) id, n_name from supplier join nation on s_nationkey = n_nationkey group by 2) select c_custkey id, p.id person_id from customer join nation on c_nationkey = n_nationkey left join p using (n_name)")
def er14_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    spell = F.translate("n_name", "0123456789_", "abcdefghij ")  # numbered names are spelled in letters
    people = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.initcap(spell).alias("name"))
    spoken = F.when(F.col("c_custkey") % 2 == 0, F.upper(spell)).otherwise(F.concat(F.lit("Mr. "), F.lower(spell)))
    mentions = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("mid"), spoken.alias("mention"))
    return E.lookup(mentions, people, "mention").select(F.col("mid").alias("id"), "person_id")


@query("select coalesce(o.c_name, n.s_name) as name, coalesce(nullif(n.seg, ''), o.c_mktsegment) segment from (select c_name, c_mktsegment from customer where c_acctbal < 5000) o full join (select upper(c_name) s_name, case when c_mktsegment = 'BUILDING' then '' else 'NEW' end seg from customer where c_acctbal >= 1000) n on lower(c_name) = lower(s_name)")
def dml1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_acctbal < 5000").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.filter("c_acctbal >= 1000").select(F.upper("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise("NEW").alias("segment"))
    return M.upsert(old, new, "name", ["segment"])


EVENTS = "e as (select o_orderkey seq, strftime(o_orderdate, '%Y-%m') as date, case when o_orderkey % 2 = 0 then upper(o_orderpriority) else lower(o_orderpriority) end title, repeat('x', cast(o_orderkey % 9 as int)) description, o_orderstatus category, cast(o_custkey % 5 as int) significance, [o_custkey, o_custkey + 1] document_ids, [o_custkey % 7, o_orderkey % 5] person_ids from orders)"


@query(f"with {EVENTS}, g as (select date, lower(title) t, arg_min(title, seq) title, arg_max(description, (length(description), -seq)) description, arg_max(category, seq) category, max(significance) significance from e group by 1, 2), d as (select date, lower(title) t, array_to_string(list_sort(list(distinct x)), ',') document_ids from (select date, title, unnest(document_ids) x from e) group by 1, 2), p as (select date, lower(title) t, array_to_string(list_sort(list(distinct x)), ',') person_ids from (select date, title, unnest(person_ids) x from e) group by 1, 2) select date, title, description, category, significance, document_ids, person_ids from g join d using (date, t) join p using (date, t)")
def dml3_merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    title = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    e = o.select(F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM").alias("date"), title.alias("title"), F.expr("repeat('x', cast(o_orderkey % 9 as int))").alias("description"), F.col("o_orderstatus").alias("category"), (F.col("o_custkey") % 5).cast("int").alias("significance"), F.array("o_custkey", F.col("o_custkey") + 1).alias("document_ids"), F.array(F.col("o_custkey") % 7, F.col("o_orderkey") % 5).alias("person_ids"))
    m = M.merge_events(e)
    return m.select("date", "title", "description", "category", "significance", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("document_ids", "person_ids")))


@query(sql("edges", "select min(id) id, least(a, b) person_id_1, greatest(a, b) person_id_2, connection_type, max(strength) strength, len(list_distinct(flatten(list(document_ids)))) n_documents from (select *, case when person_id_1 % 10 = 0 then person_id_1 - 1 else person_id_1 end a, case when person_id_2 % 10 = 0 then person_id_2 - 1 else person_id_2 end b from edges) where a <> b group by 2, 3, 4"))
def dml4_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_map = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("dup_id"), (F.col("s_suppkey") - 1).alias("canonical_id"))
    found = M.remap_edges(edges(spark, sf_dir), id_map)
    return found.select("id", "person_id_1", "person_id_2", "connection_type", "strength", F.size("document_ids").cast("long").alias("n_documents"))


@query(sql("timeline", "select id, array_to_string(list_filter(person_ids, lambda x: not list_contains(gone, x)), ',') people from timeline, (select coalesce(list(s_suppkey), []) gone from supplier where s_acctbal < 0)"))
def dml5_delete_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bindings import timeline

    gone = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select("s_suppkey")
    return M.delete_members(timeline(spark, sf_dir), "id", "person_ids", gone).select("id", F.array_join(F.col("person_ids").cast("array<string>"), ",").alias("people"))


@query("select s_name as name, case when s_suppkey % 2 = 0 then 'unknown' else 'seller' end was, case when s_suppkey % 2 = 0 then coalesce(best, 'unknown') else 'seller' end role from supplier left join (select l_suppkey, arg_max(l_returnflag, struct_pack(n := n, r := l_returnflag)) best from (select l_suppkey, l_returnflag, count(*) n from lineitem group by 1, 2) group by 1) on l_suppkey = s_suppkey")
def dml2_fill_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    people = s.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "unknown").otherwise("seller").alias("role")).withColumn("was", F.col("role"))
    mentions = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("role")).agg(F.count("*").alias("n")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("name"), "role", "n")
    return M.fill_unknown(people, mentions)


@query("select doc_id document_id, 'pending' status, case when source = 'src0' then 1 else 2 end priority from documents where doc_id not in (select doc_id from labels where quality = 1)")
def dml10_missing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    jobs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "pending").otherwise("done").alias("status"))
    return M.missing_jobs(docs, jobs, F.when(F.col("source") == "src0", 1).otherwise(2))


@query("select page_id, array_to_string(case when page_id % 6 = 0 then ['web', 'found'] else ['web'] end, ',') tags from pages")
def dml12_tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("tags", F.array(F.lit("web")))
    found = M.tag_rows(p.withColumn("key", F.col("page_id")), p.filter("page_id % 6 = 0").select("page_id"), "key", "found")
    return found.select("page_id", F.array_join("tags", ",").alias("tags"))
