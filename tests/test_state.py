"""Keyed state of the ingest stream: batches that run again change nothing, and the tables equal those of one batch."""

from pyspark.sql import functions as F

from lumenarc.streaming.state import Ingest

SCHEMA = "document_id long, mentions array<struct<name:string,role:string,n:long>>, events array<struct<seq:long,date:string,title:string,description:string,category:string,significance:long>>"
ROWS = [
    (1, [("Orla", "pilot", 2), ("ZEV ", "cook", 1)], [(1, "1999", "Landing", "short", "air", 2)]),
    (2, [("orla", "cook", 1), (None, "x", 9), ("", "x", 9)], [(2, "1999", "LANDING", "a longer one", None, 1), (2, None, None, None, None, None)]),
    (3, None, None),
    (4, [("Zev", None, 3), ("Una", "pilot", 1), ("Orla", "cook", 2)], [(4, None, None, "now told", "x", 5), (4, "2001", "Trial", "t", "law", 1)]),
    (5, [("Una", "pilot", 1)], [(5, "2001", "trial", "u", "court", 0)]),
    (9, [("Unknown Place", "pilot", 7)], [(9, "2001", "trial", "not counted at all", "x", 9)]),
]


def tables(ingest):
    def held(row):
        return tuple(sorted(v) if isinstance(v, list) else v for v in row)

    return [sorted((held(r) for r in t.select(*sorted(t.columns)).collect()), key=str) for t in ingest.tables()]


def test_replays_and_one_batch(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    known = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "document_id long")
    ingest = Ingest(spark, str(tmp_path / "a"), known, compact=2)
    parts = [rows.filter(F.col("document_id").isin(ids)) for ids in ([1], [2, 3], [4], [5, 9])]
    for i, part in enumerate(parts):
        ingest(part, i)
        if i:
            before = tables(ingest)
            ingest(part, i)  # the stream came back after a failure
            assert tables(ingest) == before
    whole = Ingest(spark, str(tmp_path / "b"), known)
    whole(rows, 0)
    got, want = tables(ingest), tables(whole)
    assert got == want
    people = {r.name: (r.mentions, r.documents, r.role) for r in ingest.tables()[0].collect()}
    assert people == {"orla": (5, 3, "cook"), "zev": (4, 2, ""), "una": (2, 2, "pilot")}
    told = {(r.date, r.key): (r.title, r.description, r.category, r.significance, r.document_ids, r.person_names) for r in ingest.tables()[2].collect()}
    assert told["1999", "landing"] == ("Landing", "a longer one", "air", 2, [1, 2], ["orla", "zev"])
    assert told["2001", "trial"] == ("Trial", "t", "court", 1, [4, 5], ["orla", "una", "zev"]) and told[None, None][1] == "now told"
    assert ingest.persons.spark.read.parquet(str(tmp_path / "a" / "persons")).filter("base").select("version").distinct().count() == 2


def test_one_table_kept_alone_and_pairs(spark, tmp_path):
    """F24 to F26, F29, F30: a table kept alone equals that of all three; pairs are counted in as many tasks as they need."""
    from lumenarc.streaming.activity import pairs_of

    rows = spark.createDataFrame(ROWS, SCHEMA)
    known = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "document_id long")
    whole = Ingest(spark, str(tmp_path / "all"), known)
    whole(rows, 0)
    for name, want in zip(("persons", "edges", "events"), whole.tables(), strict=True):
        ingest = Ingest(spark, str(tmp_path / name), known, kept=(name,))
        ingest(rows, 0)
        got = ingest.table(name)
        assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))
    said = spark.createDataFrame([(d, f"n{i:02}") for d in range(3) for i in range(20 - d)] * 2 + [(7, "n00"), (8, None), (None, "n01")], "document_id long, name string")
    pairs = pairs_of(said, task_pairs=10)
    assert {(r.name_1, r.name_2): r.documents for r in pairs.collect()} == {(f"n{i:02}", f"n{j:02}"): sum(j < 20 - d for d in range(3)) for j in range(20) for i in range(j)}
    assert pairs.rdd.getNumPartitions() == (190 + 171 + 153) // 10 + 8
