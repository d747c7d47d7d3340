"""The English index against plain computations: stems, ranking by blocks, fragments, misspellings."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenarc.functions.english import STOP_WORDS, stems
from lumenarc.operators import ranked as R
from lumenarc.operators.search import parse_query

# Words whose stems are published with the stemmer or follow from one of its rules.
STEMS = (
    "running:run runs:run consigned:consign consigning:consign consignment:consign generate:generat generously:generous communism:communism happily:happili hopping:hop hoping:hope relational:relat caresses:caress "
    "ponies:poni ties:tie cats:cat gas:gas this:this gaps:gap kiwis:kiwi agreed:agre feed:feed plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size falling:fall hissing:hiss fizzed:fizz "
    "failing:fail filing:file happy:happi sky:sky cry:cri by:by say:say conditional:condit rational:ration digitizer:digit radically:radic differently:differ analogously:analog predication:predic operator:oper "
    "feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formality:formal sensitivity:sensit sensibility:sensibl triplicate:triplic formative:format formalize:formal electricity:electr electrical:electr "
    "hopeful:hope goodness:good revival:reviv allowance:allow inference:infer gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt "
    "activate:activ homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas control:control roll:roll dying:die skies:sky proceed:proceed herring:herring youth:youth boys:boy knots:knot"
).split()


def test_known_stems(spark):
    want = dict(x.split(":") for x in STEMS)
    assert {r.term: r.stem for r in stems(spark.createDataFrame([(w,) for w in want], "term string")).collect()} == want
    odd = spark.createDataFrame([("",), ("a",), ("2001",), ("x" * 5000 + "ing",), (None,)], "term string")
    assert sorted((r.stem or "")[:4] for r in stems(odd).collect()) == ["", "", "2001", "a", "xxxx"]


STEMS_SEEN = {}


@pytest.fixture(scope="module")
def library(spark):
    """900 pages of eight frequent and many rare words, ids with gaps, and what a plain program makes of them."""
    rng = random.Random(4)
    frequent, rare = ["harbour", "lantern", "miller", "orchard", "the", "of"], [f"quill{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    pages = {}
    for i in range(900):
        words = [rng.choice(frequent) + rng.choice(["", "s"]) for _ in range(rng.randrange(5, 40))] + rng.sample(rare, rng.randrange(2))
        rng.shuffle(words)
        pages[i * 3 + i % 2] = " ".join(words)
    pages[5001], pages[5002], pages[5003] = None, "", "of the of the"
    d = spark.createDataFrame(list(pages.items()), "id long, text string")
    return R.EnglishIndex.build(d, "id", "text", block_pages=16), pages


def plain(index, pages, query, k):
    words = {w for t in pages.values() for w in re.findall("[a-z0-9]+", (t or "").lower())} | set(re.findall("[a-z0-9]+", query.lower()))
    if not words <= set(STEMS_SEEN):
        STEMS_SEEN.update(index.stems_of(sorted(words)))
    to = STEMS_SEEN.get
    said = {i: {n: to(w) for n, w in enumerate(re.findall("[a-z0-9]+", (t or "").lower())) if w not in STOP_WORDS} for i, t in pages.items()}
    terms = {i: list(x.values()) for i, x in said.items()}
    mean = sum(map(len, terms.values())) / len(pages)
    clauses, phrases, minus = parse_query(query)
    clauses = [c for c in ([to(w) for w in c if w not in STOP_WORDS] for c in clauses) if c]
    df = {t: sum(t in x for x in terms.values()) for c in clauses for t in c}
    out = []
    for i, x in terms.items():
        if not any(all(t in x for t in c) for c in clauses) or any(to(m) in x for m in minus):
            continue
        if not all(any(all(said[i].get(b + j) == to(w) for j, w in enumerate(p) if w not in STOP_WORDS) for b in range(60)) for p in phrases):
            continue
        s = sum(math.log(1 + (len(pages) - n + 0.5) / (n + 0.5)) * (f := x.count(t)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t, n in df.items() if t in x)
        out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize("query,k", [("harbour", 5), ("harbours quillab or lanterns quillcd", 10), ("quillaa or harbours", 3), ("miller orchard -lantern", 8), ('"lantern of harbour" or millers', 6), ("the of", 3), ("nowhere", 3), ("quillab harbour nowhere", 3), ("orchards", 2000)])
def test_blocks_give_what_plain_ranking_gives(library, query, k):
    index, pages = library
    found, read = index.best(query, k)
    got = [(r.page_id, r.score) for r in found.collect()]
    want = plain(index, pages, query, k)
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert read["read"] <= read["all"]


def test_a_rare_word_spares_most_postings(library):
    """Pages with the rare word score above all others, so only their blocks and few others are read."""
    index, pages = library
    n = sum("quillaa" in (t or "") for t in pages.values())
    _, read = index.best("quillaa or harbours", n)
    assert 0 < read["read"] < read["all"] / 2


def test_near_terms_equal_all_distances(library, spark):
    index, _ = library
    for word, d in (("harbor", 2), ("lantrens", 2), ("quillaa", 1), ("milr", 2), ("o", 2)):
        got = {(r.term, r.distance) for r in index.near_terms(word, d).collect()}
        want = {(r.term, r.x) for r in index.dictionary.select("term", F.levenshtein("term", F.lit(word)).alias("x")).filter(F.col("x") <= d).collect()}
        assert got == want
    plan = index.near_terms("harbor")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\n]*key", plan) or re.search(r"DataFilters: \[[^\n]*key#\d+L? INSET", plan)


def test_search_filters_before_it_highlights(library, spark):
    index, pages = library
    d = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in pages.items()], "page_id long, text string, open boolean")
    got = index.search("harbours quillab", d, 3, F.col("open"), least=10).orderBy(F.desc("score"), "page_id").collect()
    want = [i for i, _ in plain(index, pages, "harbours quillab", 10) if i % 2 == 0][:3]
    assert [r.page_id for r in got] == want and all("<mark>" in r.headline and r.headline.count(" ... ") <= 1 for r in got)


def test_fragments(spark):
    words = [f"w{i}" for i in range(200)]
    words[20], words[25], words[26], words[120], words[199] = "Lantern", "harbour,", "(lanterns)", "lanterns", "harbour"
    cases = [(1, " ".join(words)), (2, "no hit at all " * 10), (3, ""), (4, None), (5, "lantern"), (6, "x lantern y")]
    d = spark.createDataFrame(cases, "i int, t string")
    got = {r.i: r.h for r in d.select("i", R.fragments(F.col("t"), {"lantern": "lantern", "lanterns": "lantern", "harbour": "harbour"}).alias("h")).collect()}
    one = " ".join(words[20:35]).replace("Lantern", "<mark>Lantern</mark>").replace("harbour", "<mark>harbour</mark>").replace("(lanterns)", "(<mark>lanterns</mark>)")
    two = " ".join(words[120:135]).replace("lanterns", "<mark>lanterns</mark>")
    assert got[1] == f"{one} ... {two}"
    assert got[2] == " ".join(("no hit at all " * 10).split()[:15]) and got[3] == "" and got[4] is None and got[5] == "<mark>lantern</mark>" and got[6] == "x <mark>lantern</mark> y"


def test_an_index_is_found_again_until_its_table_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "old lantern")], "id long, text string").write.parquet(path)
    a, b = (R.EnglishIndex.build(spark.read.parquet(path), "id", "text", k="t") for _ in range(2))
    assert a.postings.inputFiles() == b.postings.inputFiles()
    spark.createDataFrame([(2, "new lantern")], "id long, text string").write.mode("append").parquet(path)
    c = R.EnglishIndex.build(spark.read.parquet(path), "id", "text", k="t")
    assert c.postings.inputFiles() != a.postings.inputFiles() and c.best("lantern", 5)[0].count() == 2


def test_stems_inside_tasks_equal_the_columns(spark):
    from lumenarc.functions.english import stem_of, with_stems

    rng = random.Random(7)
    ends = "ational fulness ization biliti lessli ogi li alize ative ful ement ion ing ingly ed edly eed eedly sses ies ied us s y e ll er bl tt".split()
    words = {x.split(":")[0] for x in STEMS} | {"".join(rng.choices("abceilosty", k=rng.randrange(6))) + "".join(rng.choices(ends, k=rng.randrange(1, 3))) for _ in range(3000)} | {"a", "2001", "x" * 5000 + "ing"}
    d = spark.createDataFrame([(w, 1) for w in words], "term string, pages long")
    want = {r.term: r.stem for r in stems(d).collect()}
    assert {w: stem_of(w) for w in words} == want == {r.term: r.stem for r in with_stems(d).collect()}


def test_words_are_gathered_in_their_pages(spark):
    """No word of a text is shuffled by itself: an index is one range shuffle of postings; pages with equal ids are one page."""
    from lumenarc.operators.search import Index, gathered

    d = spark.createDataFrame([(1, "A b, a"), (2, None), (3, "-"), (4, "b B"), (4, "c b")], "page_id long, text string")
    rows = gathered(d, True)
    assert not re.search(r"Exchange|Generate|Explode", rows._jdf.queryExecution().executedPlan().toString())
    got = sorted((r.page_id, r.n_words, r.term, r.tf, r["at"]) for r in rows.collect())
    assert got == [(1, 3, "a", 2, [0, 2]), (1, 3, "b", 1, [1]), (4, 2, "b", 1, [1]), (4, 2, "b", 2, [0, 1]), (4, 2, "c", 1, [0])]
    plain_ = Index.build(d, "page_id", "text", True)
    assert (plain_.pages, plain_.mean_words) == (5.0, 7 / 5)
    assert sorted((r.page_id, r.term, r.tf, r["at"]) for r in plain_.postings.collect()) == [(1, "a", 2, [0, 2]), (1, "b", 1, [1]), (4, "b", 3, [0, 1, 1]), (4, "c", 1, [0])]
    english = R.EnglishIndex.build(d, "page_id", "text", stops=["a"])
    assert sorted((r.page_id, r.stem, r["at"]) for r in english.postings.collect()) == [(1, "b", [1]), (4, "b", [0, 1, 1]), (4, "c", [0])]
    assert sorted((r.term, r.pages) for r in english.dictionary.collect()) == [("b", 2), ("c", 1)]


def test_best_of_blocks_holds_the_best_pages(spark):
    """Few rows leave each block, however many pages share a word with a question, and the best of all are among them, ties by id."""
    from lumenarc.operators import search as S

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(3, 40)))) for i in range(700)]
    texts += [(i, texts[i % 5][1]) for i in range(700, 900)] + [(900, None), (5, "w1 w59 w59")]  # copies, and an id of two rows
    index = S.Index.build(spark.createDataFrame(texts, "page_id long, text string"), "page_id", "text")
    asked = {q: rng.sample(words, rng.randrange(1, 20)) + ["nowhere"] for q in range(40)}
    told = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "question_id long, term string")
    found = S.best_of_blocks(told, index, 4, fewest=100, widest=100)
    rows = found.collect()
    assert len(rows) <= 40 * 4 * 10
    plain_ = index.scores(dict.fromkeys(words, 1.0)).groupBy("page_id", "term").agg(F.sum("s").alias("s")).collect()
    by = {}
    for r in plain_:
        by.setdefault(r.term, []).append((r.page_id, r.s))
    for q, ts in asked.items():
        sums = {}
        for t in ts:
            for i, s in by.get(t, []):
                sums[i] = sums.get(i, 0.0) + s
        want = sorted((-round(s, 6), i) for i, s in sums.items())[:4]
        assert sorted((-round(r.score, 6), r.page_id) for r in rows if r.question_id == q)[:4] == want


def test_questions_go_to_blocks_as_one_string(spark):
    """A question passes by every block, so its row is a string of words and frequencies and no list of structs."""
    from lumenarc.operators import search as S

    index = S.Index.build(spark.createDataFrame([(1, "a b"), (2, "b c")], "page_id long, text string"), "page_id", "text")
    found = S.best_of_blocks(spark.createDataFrame([(7, "b"), (7, "c")], "question_id long, term string"), index, 4)
    assert "collect_list(struct" not in found._jdf.queryExecution().executedPlan().toString().replace("named_struct", "struct")
    assert [(r.question_id, r.page_id) for r in found.orderBy("score", ascending=False).collect()] == [(7, 2), (7, 1)]
