"""The prefix trie against brute force, over many partitions and on odd conversations."""

import glob
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenarc.llm import trie as T

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
        ends.setdefault(tuple(said), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    saved, leaves = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        saved[k] = own + sum(saved[x] for x in kids.get(k, []))
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], sha(k)) for k, m in members.items())


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def ordered(table):
    """{conv_id: turns} of rows (conv_id, turn, role, text) without ties of turns."""
    out = {}
    for c, t, r, x in sorted((r for r in table if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(head, [])[:h] + own[h:]
    return out


def test_query_equals_brute_force(spark, many_partitions):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(T.op12_prefix_trie(spark, SF)) == brute(rebuilt(ordered(table)))


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/conversations.parquet"):
        con.execute(f"create view conversations as select * from '{p}'")
    want = con.execute(T.op12_sql())
    at = [[d[0] for d in want.description].index(c) for c in COLUMNS]
    assert sorted(tuple(r[i] for i in at) for r in want.fetchall()) == rows(T.op12_prefix_trie(spark, SF))


@pytest.mark.parametrize("seed", range(6))
def test_random_conversations(spark, many_partitions, seed, monkeypatch):
    """Few different turns, so that prefixes, copies and sequences that end inside others abound and cross partitions; small blocks of ids."""
    monkeypatch.setattr(T, "BLOCK", 3)
    rng = random.Random(seed)
    hot = [("u", rng.choice("ab")) for _ in range(4)]
    convs = {}
    for c in rng.sample(range(-50, 2000), 400):
        kind = rng.random()
        said = hot if kind < 0.35 else hot[: rng.randrange(5)] + [("u", rng.choice(["a", "b", "né", ""])) for _ in range(rng.randrange(6))]
        convs[c] = said[:6] if seed else hot
    table = [(c, i, r, x) for c, said in convs.items() for i, (r, x) in enumerate(said)]
    rng.shuffle(table)
    held = {c: said for c, said in convs.items() if said}
    d = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert rows(T.prefix_trie(d)) == brute(held)
    assert rows(T.trie(T.rebuilt(d))) == brute(rebuilt(held))


def test_odd_conversations(spark, many_partitions):
    long = [(7, i, "user", f"turn {i}") for i in range(3000)]
    table = [(1, None, None, None), (1, 0, "user", "hi"), (None, 0, "user", "lost"), (2, 5, "user", None), (2, 9, None, "x"), (3, 1, "us", "er:x"), (4, 1, "user", ":x"), *long]
    d = spark.createDataFrame([(*r, "z", 1) for r in table], "conv_id long, turn long, role string, text string, digest string, depth int")
    assert rows(T.prefix_trie(d)) == brute(ordered(table))
    assert rows(T.trie(T.rebuilt(d))) == brute(rebuilt(ordered(table)))
    assert T.prefix_trie(d.limit(0)).count() == 0 and T.trie(T.rebuilt(d.limit(0))).count() == 0
    tied = spark.createDataFrame([(5, 1, "a", "x"), (5, 1, "a", "x"), (6, 1, "a", "x"), (6, 1, "b", "y"), (8, 1, "b", "y"), (8, 1, "a", "x")], "conv_id long, turn long, role string, text string")
    got = rows(T.prefix_trie(tied))
    assert sum(r[1] == 2 for r in got) == 2 and [r[3] for r in got if r[1] == 0] == [3]
    said = T.with_turns(T.prefix_trie(d), d).filter("depth = 2 and conv_id = 1").collect()
    assert [(r.role, r.text) for r in said] == [("user", "hi")]
    assert T.with_turns(T.prefix_trie(d), d).filter(F.col("depth") == 0).first().text is None
