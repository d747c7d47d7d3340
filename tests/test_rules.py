"""Rule tables, notes, merged connections, profiles and running sums on known cases, nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from lumenarc.functions import rules as R, tables as B, text as T
from lumenarc.operators import catalog as C, papers as D, profiles as P, search as S
from lumenarc.operators.containment import running_before


def labels(spark, cases, column):
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    return [r[0] for r in rows.select("i", column(F.col("t")).alias("k")).orderBy("i").select("k").collect()]


def test_every_rule_of_the_default_tables_is_reached(spark):
    """A text for each rule that no earlier one takes."""
    types = ["a fax", "a docket", "bureau", "interview transcript", "grand jury", "manifest", "bank", "elsur", "jail", "real estate", "magazine", "passport", "registry", None, ""]
    assert labels(spark, types, lambda t: R.first_label(t, B.DOCUMENT_TYPE_RULES, "none")) == [k for _, k in B.DOCUMENT_TYPE_RULES] + ["none", "none"]
    ties = ["lawyer-client", "co-accused", "adversary", "judge", "butler", "joint venture", "peer", "trustee", "payment", "nephew", "lover", "dinner", "flew along with", "accuser", "grooming", "diplomat", "phone", "reporter", None]
    assert labels(spark, ties, lambda t: R.first_label(t, B.CONNECTION_RULES, "associated")) == [k for _, k in B.CONNECTION_RULES] + ["associated"]
    texts = ["Tail  Number 4", "under\noath", "True Bill", "raid", "Special Agent", "To: you", "plea", "account", "rolodex", "island", "complaint", "quiet"]
    assert labels(spark, texts, lambda t: R.first_label(t, B.TEXT_RULES, "government record")) == [k for _, k in B.TEXT_RULES] + ["government record"]


def test_relation_takes_the_last_rule(spark):
    cases = ["Wrote to them", "lunch", "paid for lunch", "paid the flight", "paid the flight to the house", "nothing", None]
    got = [tuple(r) for r in labels(spark, cases, lambda t: R.relation(t, B.RELATION_RULES, "associated"))]
    assert got == [("correspondence", 2), ("social", 2), ("financial", 3), ("travel", 3), ("social", 2), ("associated", 1), ("associated", 1)]


def test_rule_table_keeps_order_and_refuses_a_large_one(spark):
    rows = spark.createDataFrame([(2, "b", "second"), (1, "a", "first"), (3, None, "x"), (4, "c", None)], "priority int, pattern string, label string")
    assert R.rule_table(rows) == [("a", "first"), ("b", "second")]
    assert R.rule_table(rows.limit(0)) == []
    with pytest.raises(ValueError):
        R.rule_table(rows, most=1)


def test_status_rules(spark):
    rows = spark.createDataFrame([("Victim", "defendant"), ("victims", "x"), (None, "was Convicted"), ("staff", None), (None, None)], "c string, r string")
    assert [tuple(x) for x in rows.select(R.status_of(F.col("c")), R.status_of_role(F.col("c"), F.col("r"))).collect()] == [("victim", "victim"), ("named", "victim"), ("named", "convicted"), ("named", "named"), ("named", "named")]


def test_placeholders_and_short_names(spark):
    files = spark.createDataFrame([("s9", "a", 10), ("s9", "b", 11), ("s1", "a", 10), (None, "c", 10), ("s9", "d", None)], "data_set string, name string, size long")
    assert {(r.data_set, r.name) for r in C.without_placeholders(files, {"s9": [10, 12]}).collect()} == {("s9", "b"), ("s1", "a"), (None, "c"), ("s9", "d")}
    assert C.without_placeholders(files, {}).count() == 5 and C.without_placeholders(files, {"s9": []}).count() == 5
    d = spark.createDataFrame([([("ab",), ("abc",), (None,)],), (None,)], "p array<struct<name string>>")
    assert [[x.name for x in r[0]] for r in d.select(T.named(F.col("p"), 3)).collect()] == [["abc"], []]


def test_running_before_with_a_hot_key(spark):
    """One key with most rows, a null key, null values; against a plain loop. More than one range holds the hot key."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, 1, 5, -2])) for i in range(3000)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "k string, o long, v long")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.o: r.before for r in running_before(d, "k", "o", "v", "before").collect()}
        assert d.filter("k = 'hot'").repartitionByRange("k", "o").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    sums, want = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        want[o] = sums.get(k, 0)
        sums[k] = want[o] + (v or 0)
    assert got == want
    assert running_before(d.limit(0), "k", "o", "v", "before").count() == 0


def analysed(spark):
    schema = "analysis_id long, document_id long, document_type string, facts array<string>, locations array<string>, events array<string>, connections array<struct<person1 string, person2 string, description string>>"
    return spark.createDataFrame(
        [
            (1, 10, "letter", ["Ana Bell was sued", "ana bell sang", None], ["Here", "Here"], ["fair", "fair"], [("ANA BELL", "Cy Dorn", "old friends"), ("Ana Bell", "A. Bell", "herself"), ("Cy Dorn", "Eve Fox", "cousins"), ("Ana Bell", "Eve Fox", "")]),
            (2, 11, None, None, ["There"], None, [("Ana Bell", "Cy Dorn", "old friends")]),
            (3, 12, "letter", ["Ana Bell is not mentioned here"], None, None, [("Ana Bell", "Cy Dorn", "elsewhere")]),
        ],
        schema,
    )


def test_profiles_and_mentions(spark):
    persons = spark.createDataFrame([(1, "Ana Bell", ["A. Bell"]), (2, "Cy Dorn", None), (3, "Nobody Atall", [])], "id long, name string, aliases array<string>")
    said = spark.createDataFrame([(1, "ana bell", "singer", "sings", 3), (1, "A. Bell", "singer", None, 2), (2, "Ana Bell", None, "sings", 1), (2, "Cy Dorn", "baker", "bakes bread", 4), (9, "Cy Dorn", "lost", "no analysis", 7)], "analysis_id long, name string, role string, context string, mentions long")
    got = {(r.person_id, r.title): r.lines for r in P.profiles(persons, said, analysed(spark), "sued").collect()}
    assert got[1, "Roles"] == ["singer"] and got[1, "Background"] == ["sings"]
    assert got[1, "Key facts"] == ["ana bell sang"] and got[1, "Legal"] == ["Ana Bell was sued"]
    assert got[1, "Places"] == ["Here", "There"] and got[1, "Events"] == ["fair"]
    # Told in two analyses that mention the person, not in the third; a connection with oneself counts once, without a description not at all.
    assert got[1, "Connections"] == ["old friends", "herself"] and got[2, "Connections"] == ["old friends"]
    assert got[2, "Roles"] == ["baker"] and not [k for k in got if k[0] == 3]
    numbers = [r.number for r in P.profiles(persons, said, analysed(spark), "sued").filter("person_id = 2").orderBy("number").collect()]
    assert numbers == list(range(1, len(numbers) + 1))
    assert P.profiles(persons.limit(0), said, analysed(spark), "sued").count() == 0
    m = {r.person_id: r for r in P.person_mentions(persons, said, analysed(spark)).collect()}
    assert m[1].mentions == 6 and m[1].facts == ["Ana Bell was sued", "ana bell sang"] and m[1].locations == ["Here", "There"] and m[1].documents == [10, 11]
    assert m[2].mentions == 4 and m[2].facts is None and m[2].locations == ["There"] and 3 not in m


def test_merged_items_with_connections(spark):
    schema = "document_id long, chunk int, entities array<struct<name string, type string, attributes map<string, string>>>, facts array<string>, locations array<string>, events array<string>, summary string, connections array<struct<person1 string, person2 string, type string, description string>>"
    rows = [
        (1, 2, [], ["A fact"], ["rome"], ["x"], "two", [("b", "a", "kin", "later"), ("a", "b", "work", "other type")]),
        (1, 1, [("Acme", "firm", {"k": "1"})], ["a FACT", "b"], ["Rome", "Bonn"], ["X"], "one", [("a", "b", "kin", "first"), (None, "a", "kin", "half")]),
        (2, 1, None, None, None, None, "alone", None),
    ]
    got = {r.document_id: r for r in P.merged_items(spark.createDataFrame(rows, schema)).collect()}
    assert [c.description for c in got[1].connections] == ["first", "half", "other type"]
    assert got[1].facts == ["a FACT", "b"] and got[1].locations == ["Rome", "Bonn"] and got[1].events == ["X", "x"] and got[1].summary == "one two"
    assert got[2].connections is None and got[2].facts is None and got[2].summary == "alone"


def test_notes_of_documents(spark):
    persons = spark.createDataFrame([(1, "Ana Bell", "x"), (2, "Cy Dorn", None)], "id long, name string, category string")
    events = spark.createDataFrame([], "id long, date string, title string, person_ids array<long>")
    edges = spark.createDataFrame([], "id long, person_id_1 long, person_id_2 long, connection_type string, description string")
    docs = spark.createDataFrame([(i, f"paper {i:02d}", "letter", None) for i in range(5)] + [(9, "un:told", None, "s")], "id long, title string, document_type string, data_set string")
    links = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0), (2, 0)], "person_id long, document_id long")
    got = {r.path: r.content for r in D.vault_notes(persons, events, edges, docs, links, most_documents=3).collect()}
    assert sorted(got) == ["Documents/" + n + ".md" for n in ("paper 00", "paper 01", "paper 02", "paper 03", "paper 04", "un-told")] + ["People/Ana Bell.md", "People/Cy Dorn.md"]
    assert got["Documents/paper 00.md"].endswith("# paper 00\n- [[Ana Bell]]\n- [[Cy Dorn]]") and "- [[" not in got["Documents/un-told.md"]
    assert got["People/Ana Bell.md"].endswith("## Related documents\n- [[paper 00]]\n- [[paper 01]]\n- [[paper 02]]\n- and 2 more")
    assert got["People/Cy Dorn.md"].endswith("- [[paper 00]]")


def test_pairs_of_documents_shuffle_links_once_a_side_and_no_lists(spark):
    """The distinct links are dealt by document, so neither side of the pairs is shuffled again; lists of documents are gathered only where they are read."""
    from lumenarc.plans import bindings

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bindings.edges(spark, "/root/testdata/sf0.001").select("id", "description")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange ") == 3 and "collect_set" not in plan


def test_notes_of_ends_without_a_person(spark):
    """A connection needs both persons for its note; the one who is there still names nobody missing. A null name is a person."""
    persons = spark.createDataFrame([(1, "Ana"), (2, None), (3, "Cy")], "id long, name string").withColumn("category", F.lit("x"))
    events = spark.createDataFrame([], "id long, date string, title string, person_ids array<long>")
    edges = spark.createDataFrame([(10, 1, 3, "kin", "d"), (11, 1, 9, "kin", "d"), (12, 9, 3, "kin", "d"), (13, 2, 3, "kin", "d")], "id long, person_id_1 long, person_id_2 long, connection_type string, description string")
    got = [(r.path, r.content) for r in D.vault_notes(persons, events, edges).collect()]
    assert sorted(p for p, _ in got if p and p.startswith("Connections/")) == ["Connections/Ana - Cy 10.md", "Connections/Cy 13.md"]
    assert dict(got)["People/Ana.md"].endswith("# Ana\n- [[Cy]]") and dict(got)["People/Cy.md"].endswith("# Cy\n- [[Ana]]")


def test_analysis_sections(spark):
    words = spark.createDataFrame([(1, "harbor"), (1, "x"), (2, "ledger"), (3, "absent")], "question_id long, term string")
    schema = "analysis_id long, file_name string, document_type string, data_set string, summary string, facts array<string>, persons array<struct<name string, role string>>, events array<struct<date string, title string>>"
    rows = [
        (5, "f.json", "letter", "s1", "The Harbormaster", ["a", "b"], [("Ana", None), ("Cy", "baker")], [("1999", "fair"), (None, "ball")]),
        (4, "x.json", None, "s1", None, None, [("Eve", "clerk")], None),
        (6, "harbor.json", "ledger", None, "later", None, None, None),
        (3, "harbor-x.json", "note", "s1", "", [], None, None),
    ]
    d = spark.createDataFrame(rows, schema)
    got = [(r.question_id, r["rank"], r.line) for r in S.analysis_sections(words, d, 2).orderBy("question_id", "rank").collect()]
    assert got == [
        (1, 1, "Analysis x.json (document)\nPersons mentioned: Eve (clerk)"),
        (1, 2, "Analysis f.json (letter)\nSummary: The Harbormaster\nKey facts:\n- a\n- b\nPersons mentioned: Ana (mentioned), Cy (baker)\nEvents:\n- 1999: fair\n- ball"),
        (2, 1, "Analysis harbor.json (ledger)\nSummary: later"),
    ]
    assert S.analysis_sections(words, d.limit(0), 2).count() == 0
