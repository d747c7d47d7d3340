"""Operators on nulls, empty tables, ties and cases whose answer is known."""

import json

import pytest
from pyspark.sql import functions as F

from lumenarc.functions import text as T
from lumenarc.operators import activity as A, catalog as C, identity as I, profiles as P, resolve as R, search as S
from lumenarc.operators.gaps import dedup_gap
from lumenarc.sources import readers, writers
from lumenarc.sources.stored import stored

NICKNAMES = {"sandy": "lysandra", "gus": "augustin", "tilly": "ottilie", "tills": "ottilie"}
# Two names each, invented for the rule that ties them.
SAME = [
    ("Sandy Quellmark", "Lysandra Quellmark"), ("Vellacott, Idris", "Dr. Idris Vellacott"), ("Orla Fenwright", "Orl afen wright"), ("P. Augustin Dovebridge", "Gus Dovebridge"), ("Tilly Harrowgate", "Tills Harrowgat"),
    ("Corin Tasker", "Corin Taskerville"), ("Edda Whinstone", "Edda Whinstone KC"), ("Wilmot Brackendale", "Wilmet Brackendale"), ("Zev Ba rrowmere", "Zev Barrowmere"), ("Juno Sol", "sol juno"),
]
OTHER = [("Hollis Pembrick", "Hollis Yarrowdene"), ("Ivo Sterling Calloway", "Sterling Calloway"), ("Una Ridley", "Una Rudgeon"), ("Mononym", "Mononym"), ("B. Thornquist", "Belisarius Oakhurst"), ("Ebba Larn", "Abbo Lorn")]


def pairs_of(spark, names, aliases=None):
    rows = [(i, n, (aliases or {}).get(n, [])) for i, n in enumerate(names)]
    d = spark.createDataFrame(rows, "id long, name string, aliases array<string>")
    return {(r.id1, r.id2) for r in I.match_pairs(I.traits(d, NICKNAMES, aliases="aliases")).collect()}


def test_same_person_cases(spark):
    names = [n for pair in SAME + OTHER for n in pair]
    got = pairs_of(spark, names)
    for i, pair in enumerate(SAME + OTHER):
        assert ((2 * i, 2 * i + 1) in got) == (pair in SAME), pair
    assert pairs_of(spark, ["The Heron", "Isolde Marchbank", None, "", " , "], {"The Heron": ["isolde marchbank"]}) == {(0, 1)}


def test_a_common_first_name_makes_no_block(spark):
    """600 persons of one first name: far fewer candidates than the 179,700 pairs, and keys that don't multiply with the letters."""
    import random

    rng = random.Random(5)
    names = sorted({"michael " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 10))) for _ in range(600)})
    t = stored(I.traits(spark.createDataFrame(list(enumerate(names)), "id long, name string"), NICKNAMES))
    for rules in (I.same_person_rules, I.merge_rules, R.whole_name_rules):
        keys = stored(I.candidate_keys(t, rules))
        assert keys.count() < 65 * len(names) and I.candidates(keys).count() < 5000


@pytest.mark.parametrize("d", [1, 2])
def test_near_words_are_all_found(spark, d):
    """Words of three letters over a small alphabet, so that edits of all kinds meet, against all pairs."""
    import random

    rng = random.Random(d)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(500)})
    w = spark.createDataFrame([(x,) for x in words], "word string")
    for least in (1, 5):
        got = {(r.word, r.near) for r in I.near_words(w, d, least).collect()}
        b = w.withColumnRenamed("word", "near")
        want = {(r.word, r.near) for r in w.join(b, (F.length("word") >= least) & (F.length("near") >= least) & (F.col("word") != F.col("near")) & (F.levenshtein("word", "near") <= d)).collect()}
        assert got == want and want


def test_every_match_of_the_rules_shares_a_key(spark):
    """All pairs by the predicate alone against those through keys."""
    first, last = ["sandy", "lysandra", "sand", "tilly", "till", "t", "otto", "ottoline", "dilli"], ["quarrel", "quarrell", "quarrels", "sol", "solway", "wu", "hendry", "hemdri"]
    names = [f"{a} {b}" for a in first for b in last] + [f"x {a} {b}" for a in first[:3] for b in last[:3]] + ["quar rel sandy", "hen dry x", "q ua rrel"]
    t = stored(I.traits(spark.createDataFrame(list(enumerate(names)), "id long, name string"), NICKNAMES))
    for rules in (I.same_person_rules, I.merge_rules, R.whole_name_rules):
        held = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules()))
        want = {(r[0], r[1]) for r in t.alias("a").join(t.alias("b"), F.col("a.id") < F.col("b.id")).filter(held.isNotNull()).select("a.id", "b.id").collect()}
        assert {(r.id1, r.id2) for r in I.match_pairs(t, rules).collect()} == want and len(want) > 50


def test_collapse_fragments(spark):
    cases = {"zev ba rrowmere": "zevba rrowmere", "o larsund": "olarsund", "fenwr ightor": "fenwr ightor", "wi dg et": "widget", "bo": "bo", "edda k": "eddak", "q t vorn": "qt vorn"}
    d = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r[0]: r[1] for r in d.select("n", I.collapse_fragments(F.col("n"))).collect()} == cases


def test_plans_with_stale_actions_and_circles(spark):
    plan = spark.createDataFrame([("a", 1, "merge", 2), ("a", 2, "merge", 3), ("a", 4, "merge", 5), ("a", 5, "merge", 4), ("a", 6, "delete", None), ("a", 7, "merge", 6), ("a", 8, "merge", 99), ("a", 98, "delete", None)], "pass string, id long, action string, canonical_id long")
    people = spark.createDataFrame([(i,) for i in range(1, 10)], "id long")
    merged, gone = I.resolved_map(plan, people, stored)
    assert {(r.dup_id, r.canonical_id) for r in merged.collect()} == {(1, 3), (2, 3), (5, 4)}
    assert {r.id for r in gone.collect()} == {6, 7}


def test_long_merge_chains_and_rings(spark):
    """A chain of 1,000 merges, a ring of 1,000 with a tail of 300 that leads into it, and a chain into a deleted person."""
    n = 1000
    chain = [(i, i + 1) for i in range(1, n)]
    ring = [(10_000 + i, 10_000 + (i + 1) % n) for i in range(n)]
    tail = [(20_000 + i, 20_000 + i - 1) for i in range(1, 300)] + [(20_000, 10_500)]
    doomed = [(30_000 + i, 30_000 + i - 1) for i in range(1, 40)]
    rows = [("a", i, "merge", j) for i, j in chain + ring + tail + doomed] + [("a", 30_000, "delete", None)]
    plan = spark.createDataFrame(rows, "pass string, id long, action string, canonical_id long")
    people = spark.createDataFrame([(i,) for i in {x for _, i, _, j in rows for x in (i, j) if x is not None}], "id long")
    merged, gone = I.resolved_map(plan, people, stored)
    got = {r.dup_id: r.canonical_id for r in merged.collect()}
    assert got == {**{i: n for i in range(1, n)}, **{10_000 + i: 10_000 for i in range(1, n)}, **{20_000 + i: 10_000 for i in range(300)}}
    assert {r.id for r in gone.collect()} == {30_000 + i for i in range(40)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, name string, aliases array<string>, category string")
    assert I.match_pairs(I.traits(none)).count() == 0 and R.same_name_groups(none).count() == 0
    index = S.Index.build(spark.createDataFrame([], "id long, text string"), "id", "text", positions=True)
    assert S.top(S.matches(index, 'the "of the" -and'), 5).count() == 0
    log = spark.createDataFrame([], "k string, ts timestamp")
    assert dedup_gap(log, ["k"], "ts", 60).count() == 0
    assert A.within_budget(spark.createDataFrame([], "r int, c double"), "r", "c", 5).count() == 0
    ids = spark.createDataFrame([], "dup_id long, canonical_id long")
    people, links, events = P.remap_everything(ids, none, spark.createDataFrame([], "person_id long, document_id long"), spark.createDataFrame([(1, None)], "id long, person_ids array<long>"))
    assert people.count() == links.count() == 0 and events.collect()[0].person_ids is None


def test_gap_dedup_of_nulls_and_ties(spark):
    rows = [(None, 0), (None, 0), (None, 59), ("a", 5), ("a", 64), ("a", 65), ("a", 126), ("b", 1)]
    log = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r.k or "", r.s) for r in dedup_gap(log, ["k"], "ts", 60).select("k", F.unix_seconds("ts").alias("s")).collect())
    assert got == [("", 0), ("a", 5), ("a", 65), ("a", 126 - 0)] + [("b", 1)]


@pytest.mark.parametrize("gap,spread", [(60, 400_000), (5, 3000), (3000, 400_000), (10**6, 5000)])
def test_one_hot_key_over_many_ranges(spark, gap, spread):
    """All rows but a few have one key: several ranges hold it, and the result is that of one pass, for gaps below and above what a range spans."""
    import random

    rng = random.Random(gap)
    rows = [("hot", rng.randrange(spread)) for _ in range(4000)] + [(k, rng.randrange(spread)) for k in ("a", "zz", None) for _ in range(20)] + [("late", None)]
    want, last = [], {}
    for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            want.append((k or "", t))
    log = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = dedup_gap(log, ["k"], "ts", gap)
        assert sorted((r.k or "", r.s) for r in found.select("k", F.unix_seconds("ts").alias("s")).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_index_keeps_null_texts_as_pages_without_words(spark):
    d = spark.createDataFrame([(1, "Of the sea, of the land"), (2, None), (3, "the of"), (4, "")], "id long, text string")
    index = S.Index.build(d, "id", "text", positions=True)
    assert index.pages == 4
    ids = lambda q: [r.page_id for r in S.top(S.matches(index, q), 9).collect()]
    assert sorted(ids("of the")) == [1, 3] and ids('"of the"') == [1] and ids("of -sea") == [3] and sorted(ids("land or of")) == [1, 3] and ids("nowhere") == []


def test_query_parsing():
    assert S.parse_query('der  und or "Of the" -x-y') == ([["der", "und"], ["of", "the"]], [["of", "the"]], ["x", "y"])
    assert S.parse_query("") == ([], [], [])


@pytest.mark.parametrize("text,want", [(None, None), ("", None), ("Dec 5", None), ("June 1st, 2001", "2001-06-01"), ("spring of 1999", "1999"), ("2005-2007", "2005"), ("5000 people", None), ("in 2031", None)])
def test_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.normalize_event_date(F.col("t"))).first()[0] == want


def test_junk_names_spare_people(spark):
    names = ["Ann Lee", "J. R. Tolk", "Maria del Mar", "O'Neil, Pat", None]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in d.select(R.junk_reason(F.col("n"))).collect()] == [None] * 5


def test_readers_skip_what_is_broken(spark, tmp_path):
    d = tmp_path / "DataSet 9"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"fileName": "a", "text": "one\ntwo", "pages": ["x", "y"]}, indent=1))
    (d / "b.json").write_text("{ broken")
    got = readers.extracted_texts(spark, str(d)).collect()
    assert [(r.file_name, r.text, r.n_pages, r.data_set) for r in got] == [("a", "one\ntwo", 2, 9)]
    out = str(tmp_path / "csv")
    writers.write_csv(spark.createDataFrame([('a,"b"\nc', None)], "x string, y string"), out)
    assert spark.read.csv(out, header=True, escape='"', multiLine=True).collect()[0].x == 'a,"b"\nc'


def test_chunks_quality_gate_and_children(spark):
    texts = [None, "", "Page 1 aa Page 2 bb Page 3 cc", "x" * 30]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in d.orderBy("i").select(C.chunk_text(F.col("t"), 20)).collect()]
    assert got == [None, [""], ["Page 1 aa Page 2 bb ", "Page 3 cc"], ["x" * 30]]
    poor = spark.createDataFrame([(" \n", 1), ("a" * 20, 1), ("a" * 20, None), ("a" * 99, 2), ("a" * 100, 2), (None, 2)], "t string, n int")
    assert [r[0] for r in poor.select(C.poor_text(F.col("t"), F.col("n"))).collect()] == [True, False, False, True, False, True]
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, v string")
    new = spark.createDataFrame([(1, "z")], "k int, v string")
    parents = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")
    assert sorted(r.v for r in C.replace_children(old, parents, new, ["k"]).collect()) == ["c", "e", "z"]
    assert C.replace_children(old, parents.limit(0), new.limit(0), ["k"]).count() == 5


@pytest.fixture(scope="module")
def edge_pages(spark, tmp_path_factory):
    """Documents whose lines end in the digit of their own place, or in spaces of other kinds."""
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, "0 the first line ends in a 0\n1 the second one in a 1\n   spaces around this one　 \nshort"), (2, None)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_pages_keep_the_digits_at_their_ends(spark, edge_pages):
    from lumenarc.plans.archive import pages_of

    got = [(r.page, r.content) for r in pages_of(spark, edge_pages).orderBy("doc_id", "page").collect()]
    assert got == [(1, "0 the first line ends in a 0"), (2, "1 the second one in a 1"), (3, "spaces around this one")]


def test_chunks_keep_the_digits_at_the_ends_of_pages(spark, edge_pages):
    from lumenarc.plans.library import doc15_chunks

    assert [(r.doc_id, r.chunk, r.n) for r in doc15_chunks(spark, edge_pages).collect()] == [(1, 1, 28 + 1 + 23 + 1 + 22)]


def test_pages_of_one_url_are_imported_one_by_one(spark, tmp_path):
    from lumenarc.plans.library import dml13_import_files

    spark.createDataFrame([(1, "http://a/"), (2, "http://a/"), (3, "http://a/"), (4, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "de", 2000), (2, "de", 5), (3, "en", 5), (4, "fr", 5)], "doc_id long, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.local_path, r.action) for r in dml13_import_files(spark, str(tmp_path)).collect())
    assert got == [("files/2", "fill"), ("files/3", "new"), ("files/4", "fill"), ("texts/1", "none")]


def test_linked_pairs_can_be_looked_up(spark):
    who = spark.createDataFrame([(1, "Ann Leea", "Paid Bob Leeb. Met Cat Leec."), (2, "Bob Leeb", None), (3, "Cat Leec", "Knew Leea")], "id long, name string, description string")
    edges = spark.createDataFrame([(2, 1)], "person_id_1 long, person_id_2 long")
    links = spark.createDataFrame([(1, 7), (3, 7)], "person_id long, document_id long")
    kinds = lambda d: F.struct(F.lit("x").alias("connection_type"), F.length(d).alias("strength"))
    asked = []
    found = P.edges_from_text(who, lambda pairs: asked.append(sorted(map(tuple, pairs.collect()))) or pairs.filter("person_id_1 = 1 and person_id_2 = 2"), links, kinds).collect()
    assert asked == [[(1, 2), (1, 3)]]
    assert found == P.edges_from_text(who, edges, links, kinds).collect() and [(r.person_id_1, r.person_id_2, r.describer, r.document_ids) for r in found] == [(1, 3, 1, [7])]


def test_catalog_has_one_file_a_folder(spark, tmp_path, monkeypatch):
    """SRC-2. Data sets of one folder come from many tasks; they are written as one file."""
    from lumenarc.plans import files

    monkeypatch.setattr(files, "new_path", lambda s, tag: str(tmp_path / tag))
    lines = [(i, 1, 7, 1000 * i + 3, "N") for i in range(1, 40)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "sf/lineitem.parquet"))
    spark.createDataFrame([(x[3], f"s{x[3]}") for x in lines], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "sf/supplier.parquet"))
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert files.src2_catalog(spark, str(tmp_path / "sf")).count() == sum(x[0] % 5 > 0 for x in lines)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert len(list((tmp_path / "catalog").glob("part=3/part-*"))) == 1


def test_names_are_normalised_once_each_spelling(spark):
    """a mention meets its persons by its text as it stands; normal forms are taken of distinct texts alone."""
    persons = spark.createDataFrame([(1, "Orla Fenwright", ["Fenwright, Orla"]), (2, "Idris Vellacott", None), (3, "ORLA FENWRIGHT", None)], "id long, name string, aliases array<string>")
    rows = [(7, "Dr. Orla Fenwright", 2), (7, "orla fenwright", 3), (8, "Nobody", 1), (8, None, 1), (9, "Vellacott, Idris", 4), (9, "Vellacott, Idris", 5)]
    mentions = spark.createDataFrame(rows, "analysis_id long, name string, mentions long")
    spelled = P.spellings(P.spoken_names(persons), mentions.select(F.col("name").alias("said")))
    hits = P.name_hits(spelled, mentions)
    assert sorted((r.person_id, r.analysis_id, r.n, r.mentions) for r in hits.collect()) == [(1, 7, 2, 5), (2, 9, 2, 9), (3, 7, 2, 5)]
    assert spelled.count() == 5
    assert "regexp_replace" not in hits._jdf.queryExecution().optimizedPlan().toString()
