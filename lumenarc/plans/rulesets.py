"""Queries of the default rule tables and of small rules with inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenarc.functions import rules as R, tables as B, text as T
from lumenarc.operators import catalog as C
from lumenarc.operators.papers import canonical_type
from lumenarc.sources import writers as W
from lumenarc.sources.stored import new_path, stored

from .bindings import sql, table, timeline

QUERIES, ORACLE = {}, {}


def query(oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


def case_of(text: str, rules, default: str) -> str:  # noqa: ANN001
    """The first rule that fits, in SQL."""
    return "case " + " ".join(f"when regexp_matches({text}, '{r[0]}') then '{r[1]}'" for r in rules) + f" else '{default}' end"


#: Kinds as people tell them, one for each rule and some for none; an order's key chooses.
TOLD_TYPES = ["Email", "Internal Memo", "Court Order 7", "Bureau notes", "Interview Transcript", "Grand Jury minutes", "Aircraft manifest", "Bank statement", "Seizure list", "Jail booking", "Real Estate deed", "Magazine piece", "Passport scan", "Birth certificate", "Painting", " VIDEO ", "Flight Log", ""]
TOLD_TIES = ["attorney-client", "co-conspirator", "opposing trial counsel", "judge", "works for", "joint venture", "peer", "trustee", "wire transfer", "uncle", "dating", "dinner guest", "flew there with", "accuser", "procurement", "diplomat", "phone call", "reporter", "unclear", "EMPLOYER", ""]
SAID = ["a Flight  Log of May", "Sworn  testimony", "the TRUE bill", "items seized", "special agent notes", "Subject: hello", "the docket", "wire transfer", "address book", "real estate", "an incident", "a quiet day"]
PROSE = ["they wrote often", "a dinner together", "was paid to travel", "flew in a private jet", "met with them at the house", "an investment", "nothing is known"]


def told(values: list[str], key):  # noqa: ANN001, ANN201
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def told_sql(values: list[str], key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{key} % {len(values)} + 1]"


VALID = ", ".join(f"'{t}'" for t in B.DOCUMENT_TYPES)


@query(f"with t as (select o_orderkey id, lower(trim({told_sql(TOLD_TYPES, 'o_orderkey')} || case when o_orderkey % 7 = 0 then ' ' || o_orderpriority else '' end)) low from orders) select id, case when low in ({VALID}) then low else {case_of('low', B.DOCUMENT_TYPE_RULES, 'government record')} end kind from t")
def doc1_default_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-1 with the default table: thirteen rules, seventeen valid kinds."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    given = F.concat(told(TOLD_TYPES, k), F.when(k % 7 == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise(""))
    return o.select(k.alias("id"), canonical_type(given, F.lit(None).cast("string"), B.DOCUMENT_TYPES, B.DOCUMENT_TYPE_RULES, "government record", "government record").alias("kind"))


@query(f"with t as (select o_orderkey id, lower(trim({told_sql(TOLD_TIES, 'o_orderkey')} || ' ' || case when o_orderkey % 5 = 0 then o_orderpriority else '' end)) low from orders) select id, {case_of('low', B.CONNECTION_RULES, 'associated')} kind from t")
def doc2_connection_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-2: eighteen rules, read from a stored table of rules."""
    rows = [(i, p, label) for i, (p, label) in enumerate(B.CONNECTION_RULES)]
    rules = R.rule_table(stored(spark.createDataFrame(rows, "priority int, pattern string, label string"), "rules"))
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    given = F.concat_ws(" ", told(TOLD_TIES, k), F.when(k % 5 == 0, F.col("o_orderpriority")))
    return o.select(k.alias("id"), R.first_label(F.trim(given), rules, "associated").alias("kind"))


@query(f"with t as (select doc_id id, lower(coalesce(text, '') || ' ' || {told_sql(SAID, 'doc_id')}) low from documents) select id, {case_of('low', B.TEXT_RULES, 'government record')} kind from t")
def doc3_text_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-3: eleven rules over whole texts."""
    d = table(spark, sf_dir, "documents")
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), told(SAID, F.col("doc_id")))
    return d.select(F.col("doc_id").alias("id"), R.first_label(text, B.TEXT_RULES, "government record").alias("kind"))


RELATION = list(reversed(B.RELATION_RULES))


@query(f"with t as (select conv_id, turn, coalesce(lower(text), '') || ' ' || {told_sql(PROSE, '(conv_id + turn)')} low from conversations) select conv_id, turn, {case_of('low', RELATION, 'associated')} connection_type, {case_of('low', [(p, n) for p, _, n in RELATION], '1')} strength from t")
def doc7_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-7: kind and strength by the last rule that fits, over all turns."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), told(PROSE, F.col("conv_id") + F.col("turn")))
    x = R.relation(text, B.RELATION_RULES, "associated")
    return c.select("conv_id", "turn", x["connection_type"].alias("connection_type"), x["strength"].cast("string").alias("strength"))


@query("select l_orderkey id, l_linenumber n, case when l_linestatus = 'F' then 'victim' else 'named' end status, case when l_linestatus = 'F' then 'victim' when l_returnflag in ('R', 'A') then 'convicted' else 'named' end older from lineitem")
def doc8_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-8: by category alone, and the older rule by category and role."""
    category = F.when(F.col("l_linestatus") == "F", "Victim")
    role = F.when(F.col("l_returnflag") == "R", "Convicted in court").when(F.col("l_returnflag") == "A", "the defendant")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), R.status_of(category).alias("status"), R.status_of_role(category, role).alias("older"))


@query("select data_set, name, size, path, case when n = 1 then name else name || '-' || n end stored_name from (select *, row_number() over (partition by data_set, name order by size, path) n from (select p_brand data_set, p_name as name, p_size size, min(cast(p_partkey as varchar)) path from part where not (p_brand = 'Brand#1' and p_size in (3, 17)) and not (p_brand = 'Brand#2' and p_size = 5) group by 1, 2, 3))")
def doc18_without_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-18: files of a placeholder's exact size are none, the others are named apart."""
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("data_set"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_partkey").cast("string").alias("path"))
    return C.distinct_by_size(C.without_placeholders(files, {"Brand#1": [3, 17], "Brand#2": [5]}))


@query(sql("timeline", "select id, date, category, significance from timeline where date >= '1995' and significance >= 3"))
def snk4_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4: the significant events, exported and read again."""
    path = new_path(spark, "timeline")
    W.write_csv(timeline(spark, sf_dir).filter((F.col("date") >= "1995") & (F.col("significance") >= 3)), path, ["id", "date", "category", "significance"])
    return spark.read.schema("id long, date string, category string, significance int").csv(path, header=True, quote='"', escape='"')


@query("select o_orderkey id, coalesce(array_to_string(list_filter(case when o_orderkey % 3 = 2 then [] else [o_orderpriority[3:3 + o_orderkey % 4], o_orderstatus] end, lambda x: length(x) >= 3), ';'), '') people from orders")
def jsn1_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-1: replies of a model with people, those of short names dropped; replies that can't be read have none."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = F.substr("o_orderpriority", F.lit(3), (k % 4 + 1).cast("int"))
    reply = F.when(k % 3 < 2, F.concat(F.lit('```json\n{"persons": [{"name": "'), first, F.lit('"}, {"name": "'), "o_orderstatus", F.lit('"}, {"name": null}]}\n```'))).otherwise("cut off {")
    found = T.named(T.reply_json(reply, "persons array<struct<name string>>")["persons"], 3)
    return o.select(k.alias("id"), F.array_join(F.transform(found, lambda p: p["name"]), ";").alias("people"))
