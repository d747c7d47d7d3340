"""Queries of document classification, small projections and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenarc.functions import rules as R, text as T
from lumenarc.operators import papers as D
from lumenarc.operators.containment import running_before
from lumenarc.operators.profiles import top_of

from .bindings import documents, edges, person_documents, persons, sql, table, timeline

QUERIES, ORACLE = {}, {}


def query(oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


TYPE_RULES = [("widget", "tool"), ("bolt|rod", "fitting"), ("red|blue", "paint")]


@query("select p_partkey id, case when lower(p_type) in ('economy', 'promo') then lower(p_type) when regexp_matches(lower(p_type || ' ' || p_name), 'widget') then 'tool' when regexp_matches(lower(p_type || ' ' || p_name), 'bolt|rod') then 'fitting' when regexp_matches(lower(p_type || ' ' || p_name), 'red|blue') then 'paint' else 'other' end kind, array_to_string(list_filter([case when p_name like '%widget%' then 'tool' end, case when p_name like '%bolt%' or p_name like '%rod%' then 'fitting' end, case when p_name like '%red%' or p_name like '%blue%' then 'paint' end, case when p_size > 25 then 'large' end], lambda x: x is not null), ',') tags from part")
def doc1_canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-1, DOC-2, DOC-4, PRJ-6."""
    p = table(spark, sf_dir, "part")
    tags = F.concat(R.all_labels(F.col("p_name"), TYPE_RULES), F.array_compact(F.array(F.when(F.col("p_size") > 25, "large"))))
    return p.select(F.col("p_partkey").alias("id"), D.canonical_type(F.col("p_type"), F.col("p_name"), ["economy", "promo"], TYPE_RULES, "other", "record").alias("kind"), F.array_join(tags, ",").alias("tags"))


FILES = "fi as (select doc_id id, case doc_id % 6 when 0 then 'a' || doc_id || '.PDF' when 1 then 'b.' || doc_id || '.jpg' when 2 then 'c' || doc_id || '.mp4' when 3 then 'd' || doc_id when 4 then 'e' || doc_id || '.csv' else 'f' || doc_id || '.xyz' end as name, source data_set, n_chars * 8 size, lang document_type from documents), me as (select *, case id % 6 when 0 then 'document' when 1 then 'image' when 2 then 'video' when 4 then 'data' else case document_type when 'en' then 'document' when 'de' then 'audio' else 'other' end end media from fi), pr as (select *, case when media in ('image', 'video') or (media = 'document' and size < 10240) then 0 when data_set = 'src1' then 5 when data_set = 'src2' then 4 else 2 end priority from me)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 6
    n = F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("a"), n, F.lit(".PDF"))).when(k == 1, F.concat(F.lit("b."), n, F.lit(".jpg"))).when(k == 2, F.concat(F.lit("c"), n, F.lit(".mp4"))).when(k == 3, F.concat(F.lit("d"), n)).when(k == 4, F.concat(F.lit("e"), n, F.lit(".csv"))).otherwise(F.concat(F.lit("f"), n, F.lit(".xyz")))
    return d.select(F.col("doc_id").alias("id"), name.alias("name"), F.col("source").alias("data_set"), (F.col("n_chars") * 8).alias("file_size_bytes"), F.col("lang").alias("document_type"))


@query(f"with {FILES} select id, media, case id % 6 when 0 then 'application/pdf' when 1 then 'image/jpeg' when 2 then 'video/mp4' when 4 then 'text/csv' else 'application/octet-stream' end mime, priority, case when priority = 0 then 'skipped' else 'pending' end analysis_status from pr")
def doc12_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-10, DOC-12, DOC-13."""
    return D.classify_media(files(spark, sf_dir), {"src1": 5, "src2": 4}, {"en": "document", "de": "audio"}).select("id", "media", "mime", "priority", "analysis_status")


@query(f"with {FILES} select media, case when priority = 0 then 'skipped' else 'pending' end analysis_status, count(*) n from pr group by 1, 2")
def doc12_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.media_histogram(D.classify_media(files(spark, sf_dir), {"src1": 5, "src2": 4}, {"en": "document", "de": "audio"}))


@query("select doc_id id, case doc_id % 8 when 0 then 'document' when 1 then 'image' when 2 then 'image' when 3 then 'audio' when 4 then 'video' when 5 then 'audio' when 6 then 'video' else 'data' end media from documents")
def doc11_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-11. Leading bytes before the text; a name that says otherwise."""
    heads = ["255044462D312E37", "FFD8FFE000104A46", "52494646000000005745425056503820", "524946460000000057415645666D7420", "0000001C6674797069736F6D00000200", "00000020667479704D34412000000000", "524946460000000041564920", "00"]
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 8
    head = F.element_at(F.array(*map(F.lit, heads)), (k + 1).cast("int"))
    content = F.unhex(F.concat(head, F.hex(F.encode("text", "utf-8"))))
    return d.select(F.col("doc_id").alias("id"), D.best_media(F.lit("table.csv"), R.magic_type(content)).alias("media"))


@query("select doc_id, md5(case when length(text) >= length(upper(lang) || coalesce(text, '')) - 3 then text else upper(lang) || text end) h from documents where text is not null".replace("case when length(text) >= length(upper(lang) || coalesce(text, '')) - 3 then text else upper(lang) || text end", "case when doc_id % 2 = 0 then upper(lang) || text else text end"))
def doc17_longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    other = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper("lang"), "text")).otherwise(F.substring("text", 3, 1_000_000)).alias("text"))
    return D.longer_text(d.select("doc_id", "text"), other, "doc_id", "text").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("h"))


@query("with r as (select doc_id, n_chars, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) b from documents) select doc_id, case when n_chars < 500 or b >= 20000 then 0 when n_chars < 3000 then 1 else 2 end tier from r")
def doc20_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = running_before(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", "b")
    return d.select("doc_id", D.analysis_tier(F.col("n_chars"), F.col("b"), 20000, 500, 3000).alias("tier"))


@query("select o_orderkey id, case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_orderpriority else coalesce(t, o_orderpriority) end document_type from orders left join (select l_orderkey k, arg_max(l_returnflag, l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey) t from lineitem where l_returnflag <> 'N' group by 1) on k = o_orderkey".replace("case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_orderpriority else coalesce(t, o_orderpriority) end", "case when lower(o_orderpriority) in ('3-medium', '5-low') then coalesce(t, o_orderpriority) else o_orderpriority end").replace("where l_returnflag <> 'N'", "where lower(l_returnflag) not in ('3-medium', '5-low')"))
def doc22_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("document_type"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("seq"), F.col("l_returnflag").alias("document_type"))
    return D.backfill_types(docs, found, ["3-medium", "5-low"])


STORY = "st as (select o_orderkey id, 'Ordered ' || case o_orderkey % 3 when 0 then strftime(o_orderdate, '%B %-d, %Y') when 1 then strftime(o_orderdate, '%-m/%-d/%Y') else strftime(o_orderdate, '%Y-%m-%d') end || ' by the ' || case o_orderkey % 4 when 0 then 'French lawyer' when 1 then 'Swiss banker' when 2 then 'pilot' else 'man' end || case o_orderkey % 5 when 0 then ', later convicted.' else '.' end t from orders)"


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    date = F.when(k % 3 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    who = F.when(k % 4 == 0, "French lawyer").when(k % 4 == 1, "Swiss banker").when(k % 4 == 2, "pilot").otherwise("man")
    return o.select(k.alias("id"), F.concat(F.lit("Ordered "), date, F.lit(" by the "), who, F.when(k % 5 == 0, ", later convicted.").otherwise(".")).alias("t"))


@query(f"with {STORY} select id, case id % 4 when 0 then 'law' when 1 then 'finance' when 2 then 'staff' else 'other' end category, case id % 4 when 0 then 'lawyer' when 1 then 'banker' when 2 then 'pilot' else 'unknown' end occupation, case when id % 5 = 0 then 'convicted' else 'named' end status, case id % 4 when 0 then 'French' when 1 then 'Swiss' end nationality, regexp_extract(t, 'Ordered (.*) by the', 1) date, substr(t, greatest(strpos(t, 'by the') - 10, 1), strpos(t, 'by the') - greatest(strpos(t, 'by the') - 10, 1) + 16) around from st")
def doc9_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-9, DOC-8, DT-4, STR-14."""
    a = D.attributes(F.col("t"), [("lawyer|attorney", "law/lawyer"), ("banker", "finance/banker"), ("pilot", "staff/pilot")], [("convicted", "convicted"), ("charged", "charged")], ["French", "Swiss"])
    return stories(spark, sf_dir).withColumn("a", a).select("id", "a.*", D.first_date(F.col("t")).alias("date"), D.snippet(F.col("t"), "by the", 10).alias("around"))


TOP = "w as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') ws from documents), kn as (select distinct ws[1] || ' ' || ws[2] as name from (select list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') ws from benchmark) where len(ws) > 1)"


def known_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word names: the first two words of each benchmark item stand for known entities."""
    w = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    return table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(w, 1, 2), " ").alias("name")).filter("name like '% %'")


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one to three words: the first words of each benchmark item, as many as its id says."""
    w = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    return table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(w, 1, (F.col("item_id") % 3 + 1).cast("int")), " ").alias("name")).filter("length(name) > 6")


#: Names found leftmost and longest by a fold over each text's matches in order; contexts by the places of words.
NAMED = """kn as (select distinct name, string_split(name, ' ') ps from (select array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')[1:item_id % 3 + 1], ' ') as name from benchmark) where length(name) > 6),
tx as (select doc_id, text, regexp_extract_all(text, '[^A-Za-z0-9]*[A-Za-z0-9]+') pieces, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) ws from documents where text is not null),
tk as (select doc_id, ws, unnest(range(len(ws))) pos from tx),
gr as (select doc_id, pos, n, array_to_string(ws[pos + 1:pos + n], ' ') as name from tk, (select unnest([1, 2, 3]) n) where pos + n <= len(ws)),
mt as (select doc_id, pos, max(n) n, arg_max(name, n) as name from gr join (select name from kn) using (name) group by 1, 2),
ml as (select doc_id, list({pos: pos, stop: pos + n, who: name, got: []::struct(pos bigint, who varchar)[]} order by pos) m from mt group by 1),
fo as (select doc_id, unnest(list_reduce(list_concat([{pos: 0::bigint, stop: 0::bigint, who: '', got: []::struct(pos bigint, who varchar)[]}], m), lambda s, x: case when x.pos >= s.stop then {pos: x.pos, stop: x.stop, who: x.who, got: list_append(s.got, {pos: x.pos, who: x.who})} else s end).got) g from ml),
fi as (select doc_id, g.who as name, count(*) n, min(g.pos) pos from fo group by 1, 2),
pl as (select fi.*, text, length(array_to_string(pieces[1:pos], '')) lead, length(array_to_string(pieces[1:pos + len(ps)], '')) stop from fi join kn using (name) join tx using (doc_id)),
pb as (select *, lead + length(regexp_extract(text[lead + 1:stop], '^[^A-Za-z0-9]*')) begin_ from pl),
pc as (select doc_id, name, n, trim(regexp_extract(text[greatest(begin_ - 80, 0) + 1:begin_], '[^\n\r]*$') || text[begin_ + 1:stop] || regexp_extract(text[stop + 1:stop + 80], '^[^\n\r]*'), ' ') context from pb)"""


@query(f"with {NAMED}, pe as (select doc_id, string_agg(name || '=' || n || '=' || md5(context), ';' order by n desc, name) persons from pc group by 1) select doc_id id, case when regexp_matches(lower(text), 'http|www') then 'web' when regexp_matches(lower(text), 'the .* the') then 'prose' else 'other' end document_type, md5(substr(text, 1, 200)) summary, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)(haus|river|casa)', 1))), ';') places, coalesce(persons, '') persons from documents left join pe using (doc_id) where text is not null")
def doc5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-3, DOC-5, DOC-6, JN-12."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text")
    found = D.analyze_rules(d, known_names(spark, sf_dir), [("http|www", "web"), ("the .* the", "prose")], "haus|river|casa")
    names = F.array_join(F.transform(F.coalesce("persons", F.array().cast("array<struct<name:string,mentions:bigint,context:string>>")), lambda p: F.concat_ws("=", p["name"], p["mentions"].cast("string"), F.md5(F.encode(p["context"], "utf-8")))), ";")
    return found.select("id", "document_type", F.md5(F.encode("summary", "utf-8")).alias("summary"), F.array_join(F.array_sort("places"), ";").alias("places"), names.alias("persons"))


@query("with w as (select doc_id id, length(text) n, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) x from documents where text is not null), k as (select distinct list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')[1] x from benchmark), m as (select id, count(*) m from w join k using (x) group by 1), s as (select doc_id id, coalesce(m, 0) mentions, round(0.25 * (case when length(text) < 200 then 0 else least(100, log10(length(text) / 200.0) * 37) end) + 0.30 * (case when coalesce(m, 0) <= 0 then 0 else least(100, 30 + (m - 1) * 15) end) + 0.25 * (case lang when 'en' then 80 when 'de' then 40 else 0 end) + 0.20 * (case source when 'src3' then 90 else 0 end), 6) score from documents left join m on m.id = doc_id where text is not null and doc_id not in (select doc_id from labels where quality = 1)) select *, row_number() over (order by score desc, id) rank from s order by score desc, id limit 50")
def doc19_high_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-19, WIN-10."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("document_type"), F.col("source").alias("data_set"))
    known = known_pairs(spark, sf_dir).select(F.substring_index("name", " ", 1).alias("name"))
    done = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return D.high_value(d, known, {"en": 80.0, "de": 40.0}, {"src3": 90.0}, done, 50)


@query("select o_orderkey document_id, 'pending' status from orders where o_orderstatus = 'O' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A') and o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'F' and l_suppkey % 2 = 0)")
def fts17_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    hits = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("document_id"))
    jobs = li.select(F.col("l_orderkey").alias("document_id"), F.when((F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 2 == 0), "pending").otherwise("done").alias("status"))
    return D.retrieved_jobs(hits, li.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("document_id")).distinct(), jobs)


@query("select p_partkey id from part where lower(p_name) || p_partkey % 300 not in (select lower(p_name) || p_partkey % 300 from part where p_size < 12)")
def flt13_not_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("n", F.concat("p_name", (F.col("p_partkey") % 300).cast("string")))
    new = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat("n", F.lit(".PDF"))).otherwise(F.col("n")).alias("name"))
    old = p.filter("p_size < 12").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("n"), F.lit(".pdf"))).otherwise(F.col("n")).alias("name"))
    return D.not_loaded(new, old, "name").select("id")


@query("with n as (select item_id id, substr(text, 3, 9) as name from benchmark), o as (select distinct lower(x) x from (select lang || source x from documents union all select substr(text, 1, 300) from documents)) select id, name from n where not exists (select 1 from o where contains(x, regexp_replace(lower(name), '[.]pdf$', ''))) or name = ''")
def flt13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13 by substring: names that no title or beginning of a text contains."""
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.substring("text", 3, 9).alias("name"))
    old = table(spark, sf_dir, "documents").select(F.concat("lang", "source").alias("title"), F.substring("text", 1, 300).alias("url"))
    return D.not_mentioned(new, old, "name", ["title", "url"])


@query("select page_id, 'data-set-' || (page_id % 12) || '/' || replace(list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1), '%20', ' ') as key from pages")
def prj5_storage_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", D.storage_key(F.col("url"), F.concat(F.lit("DataSet%20"), (F.col("page_id") % 12).cast("string"))).alias("key"))


@query("select page_id, case when page_id % 3 > 0 then 'https://files.example.org/k' || page_id end public_url from pages")
def snk10_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("k"), F.col("page_id").cast("string"))).alias("key"))
    return D.public_rows(p, ["html", "key"], "key", "https://files.example.org/")


@query("select doc_id document_id, 1 page, md5(substr(text, 1, 1000)) content, 'doc-' || doc_id title, substr(lang || source, 1, 4) description, doc_id % 2 = 0 is_viewable from documents where text is not null")
def snk9_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    pages = d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.col("text").alias("content"))
    docs = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.concat("lang", "source").alias("description"), F.when(F.col("doc_id") % 2 == 0, "k").alias("key"))
    return D.index_rows(pages, docs, 1000, 4).withColumn("content", F.md5(F.encode("content", "utf-8")))


@query(sql("edges", "select 'node' kind, cast(s_suppkey as varchar) id, '{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\"}' line from supplier union all select 'link', cast(id as varchar), '{\"source\":' || person_id_1 || ',\"target\":' || person_id_2 || ',\"type\":\"' || connection_type || '\"}' from edges"))
def snk5_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return D.graph_rows(nodes, edges(spark, sf_dir))


@query(sql("edges persons timeline docs", """select 'People/' || replace(name, '#', '-') || '.md' path, md5('---' || chr(10) || 'type: person' || chr(10) || 'name: "' || name || '"' || chr(10) || 'category: "' || category || '"' || chr(10) || '---' || chr(10) || '# ' || name || chr(10) || coalesce(near, '') || case when dl.me is null then '' else chr(10) || '## Related documents' || chr(10) || papers || case when n > 50 then chr(10) || '- and ' || (n - 50) || ' more' else '' end end) content from persons left join (select me, max(n) n, string_agg('- [[' || title || ']]', chr(10) order by id) papers from (select person_id me, docs.id, title, count(*) over (partition by person_id) n, row_number() over (partition by person_id order by docs.id) k from links join docs on docs.id = document_id) where k <= 50 group by 1) dl on dl.me = id left join (select me, string_agg('- [[' || note || ']]', chr(10) order by note) near from (select distinct me, note from ends join nt using (pid)) group by 1) pn on pn.me = id
union all select 'Events/' || case when date is null then '' else date || ' ' end || category || ' ' || id || '.md', md5('---' || chr(10) || 'type: event' || chr(10) || 'date: "' || coalesce(date, '') || '"' || chr(10) || '---' || chr(10) || '# ' || category || chr(10) || coalesce(who, '')) from timeline left join (select eid, string_agg('- [[' || note || ']]', chr(10) order by note) who from (select distinct eid, note from (select id eid, unnest(person_ids) pid from timeline) join nt using (pid)) group by 1) on eid = id
union all select 'Documents/' || title || '.md', md5('---' || chr(10) || 'type: document' || chr(10) || 'title: "' || title || '"' || chr(10) || 'kind: "' || document_type || '"' || chr(10) || 'set: "' || data_set || '"' || chr(10) || '---' || chr(10) || '# ' || title || chr(10) || coalesce(who, '')) from docs left join (select document_id, string_agg('- [[' || note || ']]', chr(10) order by note) who from (select distinct document_id, note from links join nt on pid = person_id) group by 1) on document_id = id
union all select 'Connections/' || a.note || ' - ' || b.note || ' ' || id || '.md', md5('---' || chr(10) || 'type: connection' || chr(10) || 'kind: "' || connection_type || '"' || chr(10) || '---' || chr(10) || '[[' || a.note || ']] and [[' || b.note || ']]' || chr(10) || description) from edges join nt a on a.pid = person_id_1 join nt b on b.pid = person_id_2""", "nt as (select id pid, replace(name, '#', '-') note from persons), ends as (select person_id_1 me, person_id_2 pid from edges union all select person_id_2, person_id_1 from edges)"))
def snk8_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).withColumnRenamed("category", "title")
    return D.vault_notes(persons(spark, sf_dir), t, edges(spark, sf_dir), documents(spark, sf_dir), person_documents(spark, sf_dir)).select("path", F.md5(F.encode("content", "utf-8")).alias("content"))


@query(sql("timeline", "select id, date from timeline where date >= '1995' and significance >= 3"))
def flt7_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7, SNK-4 (the rows of a timeline export)."""
    return timeline(spark, sf_dir).filter((F.col("date") >= "1995") & (F.col("significance") >= 3)).select("id", "date")


@query("select c_custkey id, c_name as name from customer where (lower(c_name) like '%#00000000%' or lower(c_mktsegment) like '%furn%') and c_mktsegment in ('FURNITURE', 'BUILDING') order by c_acctbal desc, c_custkey limit 40")
def flt14_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14, SRT-1, PRJ-1."""
    c = table(spark, sf_dir, "customer")
    found = c.filter((R.contains_any([F.col("c_name")], "#00000000") | R.contains_any([F.col("c_mktsegment")], "FURN")) & F.col("c_mktsegment").isin("FURNITURE", "BUILDING"))
    return found.orderBy(F.desc("c_acctbal"), "c_custkey").limit(40).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("select o_orderkey id, coalesce(nullif(case when o_orderkey % 3 = 0 then '' else o_orderstatus end, ''), 'unknown') document_type, coalesce(case when o_orderkey % 4 > 0 then 'sum ' || o_custkey end, '') summary, coalesce(n, 0) n_persons from orders left join (select l_orderkey k, count(distinct l_suppkey) n from lineitem group by 1) on k = o_orderkey")
def prj8_flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-8."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_distinct("l_suppkey").alias("n"))
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("t"), F.when(k % 4 > 0, F.concat(F.lit("sum "), F.col("o_custkey").cast("string"))).alias("s"))
    return rows.join(n, F.col("id") == F.col("k"), "left").select("id", F.coalesce(F.nullif("t", F.lit("")), F.lit("unknown")).alias("document_type"), F.coalesce("s", F.lit("")).alias("summary"), F.coalesce("n", F.lit(0)).alias("n_persons"))


@query("select l_suppkey person_id, l_orderkey document_id, min(l_partkey * 10 + l_linenumber) id from lineitem group by 1, 2")
def win5_lowest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-5. One link of each person and document, the lowest id."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("document_id")).agg(F.min(F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"))


@query("select doc, page, score from (select l_orderkey doc, l_linenumber page, max(l_quantity) score, row_number() over (partition by l_orderkey order by max(l_quantity) desc, l_linenumber) n from lineitem group by 1, 2) where n = 1")
def win3_best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-3."""
    hits = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.max("l_quantity").alias("score"))
    return hits.groupBy("doc").agg(F.max_by(F.struct("page", "score"), F.struct("score", -F.col("page"))).alias("x")).select("doc", "x.page", "x.score")


@query("with a as (select l_orderkey k, list_sort(list(distinct l_suppkey)) x from lineitem where l_linenumber <= 3 group by 1), b as (select l_orderkey k, list_sort(list(distinct l_suppkey)) y from lineitem where l_linenumber >= 3 group by 1) select k, array_to_string(list_sort(list_intersect(x, y)), ',') common, array_to_string(list_sort(list_distinct(x || y)), ',') every, array_to_string(list_filter(x, lambda z: not list_contains(y, z)), ',') only_left from a join b using (k)")
def set4_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-4, ARR-1."""
    li = table(spark, sf_dir, "lineitem")
    ids = lambda cond, c: li.filter(cond).groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_suppkey").alias(c))
    j = ids("l_linenumber <= 3", "x").join(ids("l_linenumber >= 3", "y"), "k")
    text = lambda a: F.array_join(F.array_sort(a).cast("array<string>"), ",")
    return j.select("k", text(F.array_intersect("x", "y")).alias("common"), text(F.array_union("x", "y")).alias("every"), text(F.array_except("x", "y")).alias("only_left"))


@query("select p_partkey id, upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) proper, case when p_partkey % 2 = 0 then p_name || ' x' else p_name || ' jr' end bare, 'a-b - ' || p_name file, '\"' || replace(p_type, 'O', '\"\"') || '\"' quoted from part")
def str7_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-6, STR-7, STR-8: proper case, suffixes, file names and quotes."""
    p = table(spark, sf_dir, "part")
    suffixed = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" x, Jr."))).otherwise(F.concat("p_name", F.lit(" jr")))
    return p.select(F.col("p_partkey").alias("id"), F.initcap("p_name").alias("proper"), F.when(F.col("p_partkey") % 2 == 0, T.strip_suffix(suffixed)).otherwise(suffixed).alias("bare"), T.file_name(F.concat(F.lit("a/b :  "), "p_name")).alias("file"), T.quote_csv(F.replace("p_type", F.lit("O"), F.lit('"'))).alias("quoted"))


@query("select o_orderkey id, case when o_orderkey % 2 = 0 then 'Saw ' || o_custkey || ' there. Then ' || o_custkey || ' left' else 'none' end about from orders")
def str13_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13."""
    o = table(spark, sf_dir, "orders")
    who = F.col("o_custkey").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("A start. Saw "), who, F.lit(" there. Nothing. Then "), who, F.lit(" left. And "), who)).otherwise(F.lit("Not told. At all"))
    return o.select(F.col("o_orderkey").alias("id"), T.sentences_about(text, who, F.lit("none")).alias("about"))


@query("select o_orderkey id, case o_orderkey % 3 when 0 then 'a' || o_custkey when 1 then 'b' || o_custkey else null end as name, o_custkey n, case when o_orderkey % 2 = 0 then 'x;y' else 'p;q' end items, case when o_orderkey % 2 = 0 then 'Here' else 'There' end place from orders")
def jsn1_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-1, JSN-2, ARR-4: replies in fences, in prose and broken; arrays or comma strings; places as text or objects."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    n = F.col("o_custkey").cast("string")
    reply = F.when(k % 3 == 0, F.concat(F.lit('```json\n{"name": "a'), n, F.lit('"}\n```'))).when(k % 3 == 1, F.concat(F.lit('Sure: {"name": "b'), n, F.lit('"} as asked'))).otherwise(F.lit("no braces"))
    listed = F.when(k % 2 == 0, '["x","y"]').otherwise("p, q")
    place = F.when(k % 2 == 0, '{"location": "Here", "note": 1}').otherwise("There")
    return o.select(k.alias("id"), T.reply_json(reply, "name string")["name"].alias("name"), F.col("o_custkey").alias("n"), F.array_join(T.listed(listed), ";").alias("items"), T.place_name(place).alias("place"))


@query("select o_orderkey id, 'b' || o_custkey || (case when o_orderkey % 2 = 0 then 'z' else 'a' end) merged from orders")
def jsn3_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-3. The right side's values win."""
    o = table(spark, sf_dir, "orders")
    left = F.create_map(F.lit("k"), F.lit("a"), F.lit("m"), F.when(F.col("o_orderkey") % 2 == 0, "z").otherwise("a"))
    m = T.merge_maps(left, F.create_map(F.lit("k"), F.concat(F.lit("b"), F.col("o_custkey").cast("string"))))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(m["k"], m["m"]).alias("merged"))


DATES = [("2019-03-04", "2019-03-04"), ("1999-05-1999", "1999-05"), ("2001-02 to 2001-04", "2001-02"), ("1998-2003", "1998"), ("March 15, 2020 (evening)", "2020-03-15"), ("early July 2004", "2004-07"), ("Summer 2005", "2005"), ("circa 1987", "1987"), ("the late 1990s", "1990"), ("on or about 12/4/2010", "2010"), ("never", None), ("approximately 1776", "1776"), ("15 March 2020", "2020-03")]


@query("select o_orderkey id, case o_orderkey % 13 " + " ".join(f"when {i} then {'null' if v is None else repr(v)}" for i, (_, v) in enumerate(DATES)) + " end as date from orders")
def dt1_date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-1, all forms."""
    o = table(spark, sf_dir, "orders")
    text = F.element_at(F.array(*(F.lit(t) for t, _ in DATES)), (F.col("o_orderkey") % len(DATES) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), T.normalize_event_date(text).alias("date"))


@query("select s_suppkey id, coalesce(d, 0) documents, coalesce(n, 0) degree from supplier left join (select l_suppkey k, count(distinct l_orderkey) d from lineitem group by 1) on k = s_suppkey left join (select l_suppkey q, count(distinct l_partkey) n from lineitem where l_linenumber = 1 group by 1) on q = s_suppkey where coalesce(d, 0) + coalesce(n, 0) > 2 order by documents + degree desc, id limit 50")
def srt8_people_by_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-8. Documents and connections together."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    d = person_documents(spark, sf_dir).groupBy("person_id").agg(F.count("*").alias("documents"))
    n = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("q")).agg(F.count_distinct("l_partkey").alias("degree"))
    j = s.join(d, F.col("id") == F.col("person_id"), "left").join(n, F.col("id") == F.col("q"), "left").select("id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return j.filter("documents + degree > 2").orderBy(F.desc(F.col("documents") + F.col("degree")), "id").limit(50)


@query(sql("docs", "select data_set, id, n from (select data_set, id, file_size_bytes n, row_number() over (partition by data_set order by file_size_bytes desc, id) r from docs) where r <= 3"))
def win2_largest_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2. The first rows of each key, cut in each task before the shuffle."""
    return top_of(documents(spark, sf_dir), "data_set", [F.desc("file_size_bytes"), F.asc("id")], 3).select("data_set", "id", F.col("file_size_bytes").alias("n"))
