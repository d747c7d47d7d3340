"""Queries over documents: filters, projections, classification, paging, facets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumenarc.functions import rules as R, text as T

from .bindings import documents, sql, table

QUERIES, ORACLE = {}, {}


def query(oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


@query(sql("docs", "select id, document_type from docs where file_size_bytes > 0 and document_type = 'letter' and data_set = 'src0' and list_contains(tags, 'en')"))
def flt2_documents_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1..3."""
    found = documents(spark, sf_dir).filter((F.col("file_size_bytes").isNull() | (F.col("file_size_bytes") > 0)) & (F.col("document_type") == "letter") & (F.col("data_set") == "src0"))
    return found.filter(F.array_contains("tags", F.lit("en"))).select("id", "document_type")


@query("select p_partkey id from part where contains(lower(p_name), 'ring') or contains(lower(p_type), 'brass')")
def flt5_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(R.contains_any([F.col("p_name"), F.col("p_type")], "RING") | R.contains_any([F.col("p_type")], "Brass")).select(F.col("p_partkey").alias("id"))


@query("select c_custkey id from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def flt10_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("select doc_id id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 0)")
def flt11_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").join(low, "doc_id", "left_semi").select(F.col("doc_id").alias("id"))


@query("select doc_id id, lang from documents where n_chars > 200 and doc_id not in (select doc_id from labels)")
def flt12_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, FLT-13."""
    return table(spark, sf_dir, "documents").filter("n_chars > 200").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "lang")


@query("select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) as base, (regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) = 'example.org' or regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) like '%.example.org') allowed from pages")
def str15_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-4, PRJ-7, STR-15."""
    return table(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"), T.base_name(F.col("url")).alias("base"), T.host_allowed(F.col("url"), ["example.org"]).alias("allowed"))


@query("select page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) n, md5(regexp_replace(html, '<[^>]*>', '', 'g')) digest from pages")
def str11_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5(F.encode("t", "utf-8")).alias("digest"))


@query("select s_suppkey id, trim(regexp_replace(regexp_replace(lower(trim(split_part(v, ',', 2)) || ' ' || trim(split_part(v, ',', 1))), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) norm, n_name || ' ' || s_name display from (select *, s_name || ', Mr. ' || n_name v from supplier join nation on s_nationkey = n_nationkey) where false union all select s_suppkey, trim(regexp_replace(regexp_replace(lower(n_name || ' ' || s_name), '[^a-z ]', '', 'g'), ' +', ' ', 'g')), n_name || ' ' || s_name from supplier join nation on s_nationkey = n_nationkey")
def str1_normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("id"), T.normalize_name(F.concat("s_name", F.lit(", Mr. "), "n_name")).alias("norm"), F.concat_ws(" ", "n_name", "s_name").alias("display"))


@query("select p_partkey id, levenshtein(p_name, 'small ring') d, array_to_string(list_sort(string_split(p_name, ' ')), ' ') tokens from part where levenshtein(p_name, 'small ring') <= 4")
def str5_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.levenshtein(F.col("p_name"), F.lit("small ring"), 4)
    return table(spark, sf_dir, "part").withColumn("d", d).filter("d >= 0").select(F.col("p_partkey").alias("id"), F.col("d").cast("long").alias("d"), T.sorted_tokens(F.col("p_name")).alias("tokens"))


@query("select conv_id, turn, case when length(text) > 40 then text[1:40] || '...' else text end short, array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1 and not list_contains(['{0}'], w)), ' ') words from conversations".format("', '".join(T.STOPWORDS)))
def str10_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10, STR-12, PRJ-3."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.truncate(F.col("text"), 40).alias("short"), F.array_join(T.keywords(F.col("text")), " ").alias("words"))


@query("select doc_id id, round(case when n_chars < 200 then 0 else least(100, log10(n_chars / 200.0) * 37) end, 6) ls, round(0.25 * case when n_chars < 200 then 0 else least(100, log10(n_chars / 200.0) * 37) end + 0.3 * case when doc_id % 9 = 0 then 0 else least(100, 30 + (doc_id % 9 - 1) * 15) end + 0.25 * 30 + 0.2 * 10, 6) score from documents")
def mth3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-1..3."""
    length, mentions = T.length_score(F.col("n_chars")), T.mention_score(F.col("doc_id") % 9)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.round(length, 6).alias("ls"), F.round(T.weighted_score(length, mentions, F.lit(30.0), F.lit(10.0)), 6).alias("score"))


RULES = [("licen[cs]e|copyright", "licence"), ("the .* of", "english prose"), ("der|und", "german prose"), ("que|los", "romance prose")]


@query("select doc_id id, case when regexp_matches(lower(text), 'licen[cs]e|copyright') then 'licence' when regexp_matches(lower(text), 'the .* of') then 'english prose' when regexp_matches(lower(text), 'der|und') then 'german prose' when regexp_matches(lower(text), 'que|los') then 'romance prose' else 'other' end kind, (case when regexp_matches(lower(text), 'licen[cs]e|copyright') then 1 else 0 end + case when regexp_matches(lower(text), 'the .* of') then 1 else 0 end + case when regexp_matches(lower(text), 'der|und') then 1 else 0 end + case when regexp_matches(lower(text), 'que|los') then 1 else 0 end) labels from documents")
def doc1_rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-1..4, with a neutral rule table."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), R.first_label(text, RULES, "other").alias("kind"), F.size(R.all_labels(text, RULES)).alias("labels"))


@query("select doc_id id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,8}'))), ',') places from documents")
def doc6_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-6 with a pattern parameter."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,8}"), F.lit(0)))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.array_sort(found), ",").alias("places"))


PAGES = "pg as (select doc_id, row_number() over (partition by doc_id order by i) page, trim(s) content from (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) i from documents) where length(trim(s)) >= 20)"


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-14. Pages of a text: parts of 20 characters or more at the delimiter, numbered anew."""
    parts = F.filter(F.transform(F.split("text", "\n"), lambda s: T.trim_spaces(s)), lambda s: F.length(s) >= 20)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("page", "content")).withColumn("page", (F.col("page") + 1).cast("long"))


@query(f"with {PAGES} select doc_id, page, length(content) n, md5(content) digest from pg")
def doc14_page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(spark, sf_dir).select("doc_id", "page", F.length("content").cast("long").alias("n"), F.md5(F.encode("content", "utf-8")).alias("digest"))


@query(f"with {PAGES} select doc_id, md5(string_agg(content, ' ' order by page)) whole, count(*) n_pages, sum(length(content)) * 1.0 / count(*) < 50 poor from pg group by 1")
def agg21_text_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21, DOC-16."""
    g = pages_of(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "content"))), lambda x: x["content"]), " ").alias("t"), F.count("*").alias("n_pages"), F.sum(F.length("content")).alias("chars"))
    return g.select("doc_id", F.md5(F.col("t").cast("binary")).alias("whole"), "n_pages", (F.col("chars") / F.col("n_pages") < 50).alias("poor"))


@query("select doc_id id, case when n_chars < 500 then 0 when source = 'src0' then 3 when lang = 'en' then 2 else 1 end priority from documents")
def doc13_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 500, 0).when(F.col("source") == "src0", 3).when(F.col("lang") == "en", 2).otherwise(1).alias("priority"))


@query("select * from (select 'documents' as name, count(*) n from documents union all select 'pages', count(*) from pages union all select 'labelled toxic', count(*) from labels where toxic = 1 union all select 'orders', count(*) from orders union all select 'suppliers', count(*) from supplier)")
def agg1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"documents": "true", "pages": "true", "labels": "toxic = 1", "orders": "true", "supplier": "true"}
    names = {"labels": "labelled toxic", "supplier": "suppliers"}
    out = None
    for t, cond in tables.items():
        one = table(spark, sf_dir, t).filter(cond).agg(F.count("*").alias("n")).select(F.lit(names.get(t, t)).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select data_set, document_type, n, en from (select source data_set, case when n_chars < 500 then 'note' when n_chars < 3000 then 'letter' else 'report' end document_type, count(*) n, count(*) filter (lang = 'en') en from documents group by rollup (source, document_type))")
def agg4_sidebar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3, AGG-4."""
    return documents(spark, sf_dir).rollup("data_set", "document_type").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"))


@query("select distinct 'lang' facet, lang as value from documents union select distinct 'source', source from documents")
def agg5_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    one = lambda c: d.select(F.lit(c).alias("facet"), F.col(c).alias("value")).filter("value is not null").distinct()
    return one("lang").unionByName(one("source"))


@query("select coalesce(lang, 'unknown') kind, count(*) n, round(avg(n_chars), 4) mean_chars, count(*) filter (n_chars > 1000) long from documents group by 1")
def agg23_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, AGG-23."""
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(F.col("n_chars") > 1000).alias("long"))


@query("select w as place, count(distinct doc_id) n from (select doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,6}')) w from documents) group by 1 order by n desc, 1 limit 20")
def agg14_top_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,6}"), F.lit(0)))).alias("place"))
    return rows.groupBy("place").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "place").limit(20)


@query("select doc_id, kind, n from (select *, count(*) over (partition by doc_id) kinds from (select doc_id, case when length(content) < 80 then 'short' else 'long' end kind, count(*) n from pg group by 1, 2)) where kinds > 1".join([f"with {PAGES} ", ""]))
def agg18_page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages_of(spark, sf_dir).groupBy("doc_id", F.when(F.length("content") < 80, "short").otherwise("long").alias("kind")).agg(F.count("*").alias("n"))
    return p.withColumn("kinds", F.count("*").over(Window.partitionBy("doc_id"))).filter("kinds > 1").drop("kinds")


@query("select doc_id id, lang, cast(t.total as bigint) total, cast(ceil(t.total / 25.0) as bigint) pages from (select doc_id, lang from documents where lang = 'en' order by n_chars desc, doc_id limit 25 offset 50), (select count(*) total from documents where lang = 'en') t")
def srt2_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("lang = 'en'")
    total = d.agg(F.count("*").alias("total"))
    page = d.orderBy(F.desc("n_chars"), "doc_id").offset(50).limit(25)
    return page.join(F.broadcast(total)).select(F.col("doc_id").alias("id"), "lang", "total", F.ceil(F.col("total") / 25).alias("pages"))


@query("select doc_id id from documents where doc_id > 120 order by doc_id limit 40")
def srt4_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id > 120").orderBy("doc_id").limit(40).select(F.col("doc_id").alias("id"))


@query("select doc_id id, lag(doc_id) over (order by doc_id) prev, lead(doc_id) over (order by doc_id) as next from documents where lang = 'fr'")
def win6_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-6. Neighbours in id order without a global window: ranges of ids are windows, and a range's edge takes the nearest end of the others (one row a range)."""
    ids = table(spark, sf_dir, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("id"))
    span = F.floor(F.col("id") / 10000).alias("span")  # ranges of ids of a fixed width
    w = Window.partitionBy("span").orderBy("id")
    near = ids.select("id", span).select("id", "span", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))
    ends = near.groupBy("span").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    order = Window.orderBy("span")
    stitched = ends.select(F.col("span").alias("s"), F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    return near.join(stitched, F.col("span") == F.col("s")).select("id", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))


@query("select 'document' as kind, doc_id id, 'doc-' || doc_id title from documents where n_chars < 300 union all select 'person', s_suppkey, s_name from supplier where s_acctbal < 0 union all select 'event', o_orderkey, o_orderpriority from orders where o_totalprice < 1500")
def set1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-1, SNK-7."""
    d = table(spark, sf_dir, "documents").filter("n_chars < 300").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.lit("person").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    o = table(spark, sf_dir, "orders").filter("o_totalprice < 1500").select(F.lit("event").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    return d.unionByName(s).unionByName(o)


@query("select p_name as name, 'curated' origin from part where p_size < 5 group by 1 union all select p_name, 'generated' from part where p_name not in (select p_name from part where p_size < 5) group by 1")
def set3_dictionary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_size")
    curated = p.filter("p_size < 5").select("name").distinct()
    return curated.withColumn("origin", F.lit("curated")).unionByName(p.select("name").distinct().join(curated, "name", "left_anti").withColumn("origin", F.lit("generated")))


@query("select o_orderkey id, date, regexp_extract(date, '(19[0-9][0-9]|20[0-9][0-9])', 1) as year from (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m') when 2 then strftime(o_orderdate, '%Y') else strftime(o_orderdate, '%Y-%m-%d') end as date from orders)")
def dt1_event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-1, DT-2: dates written in four ways come back as one text form."""
    o = table(spark, sf_dir, "orders")
    m = F.get(F.array(*map(F.lit, T.MONTHS)), F.month("o_orderdate") - 1)
    k, y, d = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy"), F.dayofmonth("o_orderdate").cast("string")
    raw = F.when(k == 0, F.concat(m, F.lit(" "), d, F.lit(", "), y)).when(k == 1, F.concat(F.initcap(m), F.lit(" "), y)).when(k == 2, F.concat(F.lit("circa "), y)).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" to "), y))
    date = T.normalize_event_date(raw)
    return o.select(F.col("o_orderkey").alias("id"), date.alias("date"), T.year_of(date).cast("string").alias("year"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k, event_type in ('view', 'click') ok from events")
def jsn4_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-1, JSN-4: a reply in code fences, read by schema."""
    reply = T.reply_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k bigint")
    return table(spark, sf_dir, "events").select("event_id", reply["k"].alias("k"), F.col("event_type").isin("view", "click").alias("ok"))


@query("select event_id, array_to_string(list_filter([case when value < 0 then 'negative' end, case when user_id % 7 = 0 then 'user' end, case when event_type = 'error' then 'type' end], lambda x: x is not null), ',') reasons from events where value < 0 or user_id % 7 = 0 or event_type = 'error'")
def prj9_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = R.rejected([("negative", F.col("value") < 0), ("user", F.col("user_id") % 7 == 0), ("type", F.col("event_type") == "error")])
    return table(spark, sf_dir, "events").withColumn("r", reasons).filter(F.size("r") > 0).select("event_id", F.array_join("r", ",").alias("reasons"))


@query("select a.doc_id id_1, b.doc_id id_2, a.lang = b.lang same_lang, a.source <> b.source source_differs from documents a join documents b on b.doc_id = a.doc_id + 1")
def prj10_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    a, b = d.alias("a"), d.withColumn("prev", F.col("doc_id") - 1).alias("b")
    return a.join(b, F.col("a.doc_id") == F.col("b.prev")).select(F.col("a.doc_id").alias("id_1"), F.col("b.doc_id").alias("id_2"), (F.col("a.lang") == F.col("b.lang")).alias("same_lang"), (F.col("a.source") != F.col("b.source")).alias("source_differs"))
