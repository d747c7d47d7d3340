"""Names in texts, substrings and selected values against plain programs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenarc.operators import containment as C, dictionary as D


def plain_mentions(text, names):
    words = [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]
    known = {tuple(w.lower() for w in re.findall("[A-Za-z0-9]+", n)): n for n in sorted(names, reverse=True)}
    at, out = 0, []
    while at < len(words):
        n = max((len(k) for k in known if k and tuple(words[at : at + len(k)]) == k), default=0)
        if n:
            out.append((known[tuple(words[at : at + n])], at, n))
        at += n or 1
    return out


def test_leftmost_longest_names(spark):
    names = ["New York", "New York Times", "york", "Times Square Garden", "times", "A", "a b", "b a b", "", "...", "new-york"]
    rng = random.Random(8)
    texts = ["In new york, the New York Times said: york!", None, "", "Times square; Garden times square", *(" ".join(rng.choice(["a", "b", "new", "york", "times", "square", "garden", "x"]) for _ in range(rng.randrange(60))) for _ in range(80))]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    k = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted((r.id, r.name, r.at, r.words) for r in D.mentions(d, k).collect())
    assert got == sorted((i, *m) for i, t in enumerate(texts) for m in plain_mentions(t, names))
    assert D.mentions(d, k.limit(0)).count() == 0 and D.mentions(d.limit(0), k).count() == 0
    counts = {r.name: r.mentions for r in D.with_contexts(D.mentions(d, k), d).filter("id = 0").collect()}
    assert counts == {"New York": 1, "New York Times": 1, "york": 1}


def test_contexts_stay_in_their_line(spark):
    text = "x" * 100 + " far away\n(see: " + "y" * 90 + " Orla  Fenwright, pilot)\nnext line orla fenwright"
    d = spark.createDataFrame([(1, text)], "id long, text string")
    k = spark.createDataFrame([("orla fenwright",), ("far",)], "name string")
    got = {r.name: (r.mentions, r.context) for r in D.with_contexts(D.mentions(d, k), d).collect()}
    assert got["orla fenwright"] == (2, "y" * 79 + " Orla  Fenwright, pilot)") and got["far"] == (1, "x" * 79 + " far away")


def test_substrings(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "zz"]
    needles = [t[2 : 2 + rng.randrange(1, 9)] for t in texts[:120] if t] + ["zz", "nowhere", "", None, "a"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "needle_id long, needle string")
    got = sorted((r.needle_id, r.text_id) for r in C.contained(n, t).collect())
    assert got == sorted((i, j) for i, x in enumerate(needles) if x for j, y in enumerate(texts) if y and x in y)
    plan = C.contained(n, t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("share", [0.0, 0.5, 0.7, 0.999])
def test_selected_value(spark, share):
    values = [random.Random(3).randrange(50) for _ in range(500)] + list(range(40, 700))
    d = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [r.v for r in C.value_at(d, "v", share).collect()] == [sorted(values)[int(len(values) * share)]]
        assert C.value_at(d.filter("v is null"), "v", share).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_name_at_the_start_of_a_line_has_no_context_before_it(spark):
    d = spark.createDataFrame([(1, "earlier line\nAnn Lee came\nlater"), (2, "x\r\n Ann Lee"), (3, "one\n\nAnn Lee")], "id long, text string")
    k = spark.createDataFrame([("ann lee",)], "name string")
    assert sorted((r.id, r.context) for r in D.with_contexts(D.mentions(d, k), d).collect()) == [(1, "Ann Lee came"), (2, "Ann Lee"), (3, "Ann Lee")]


def test_single_words_with_common_evidence(spark):
    """Against counting every pair, with bounds so small that most words are settled by them."""
    from lumenarc.operators import identity as I

    rng = random.Random(5)
    words = ["w" + c for c in "abcdefghijklmnopqrst"]
    names = {i: f"{rng.choice(words)} {rng.choice(words)}" if i % 3 else rng.choice(words) for i in range(300)}
    evidence = {i: {(kind, rng.randrange(12 if kind == "document" else 60)) for kind in ("document", "connection") for _ in range(rng.randrange(6))} for i in names}
    want = set()
    for d, w in names.items():
        if " " not in w:
            scores = sorted(((sum(2 if k == "document" else 1 for k, _ in evidence[d] & evidence[f]), -f) for f, n in names.items() if " " in n and w in (n.split()[0], n.split()[-1])), reverse=True)
            if scores[0][0] >= 4 and scores[1][0] * 2 <= scores[0][0]:
                want.add((d, -scores[0][1], scores[0][0]))
    p = spark.createDataFrame(list(names.items()), "id long, name string")
    e = spark.createDataFrame([(i, *x) for i, found in evidence.items() for x in found], "id long, kind string, key long")
    assert want
    for rare, tried in ((2, 8), (64, 256), (0, 1)):
        assert {tuple(r) for r in I.single_words(p, e, rare=rare, tried=tried).collect()} == want
