"""Prefix trie of conversations by union-find over sorted neighbours.

A turn is a 16-byte digest of its role and text, a conversation the digests of its turns in a row. Spark sorts the conversations by
(digests, conv_id) over range partitions, so that those with a common prefix are neighbours; conversations that are equal everywhere
are told apart by their id and spread over partitions. Each partition joins its distinct sequences by the edges between neighbours,
weighted by the length of their common prefix, in descending order: every merge of two components makes a branching node (or hangs the deeper
under the shallower where that ends at this very depth), so what is held is a few numbers for each distinct sequence.

Nodes on the paths to the first and the last sequence of a partition are open: they may go on in the neighbour. A partition's
forest is contracted to these two paths; a single pass over the paths of all partitions, in order, merges those that are equal from the root on. Its
rows number twice the partitions times the depth of a conversation, however many conversations there are. The merged values go back to each
partition by a join, to the nodes whose parents are open.

The list of the conversations that end at a node is hashed in the partition as it passes; where it may go on in the next
partition its ids are written in blocks of 4,096, and the blocks of each such node are hashed in order as a stream.

Defined results: null conv_ids belong to no conversation; null roles and texts are empty; turns are ordered by number, null first, those with equal
numbers by digest; repeated rows are turns of their own; a conversation may have no turns and ends at the root; an empty table gives no
rows. The turns of one conversation (20 bytes each) are held together in a task, as it is one row of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import small_batches, stash, table, text_of

WIDTH, BLOCK, OUT = 16, 4096, 20_000
NONE = hashlib.sha256(b"").hexdigest()
NODE, SPINE, IDS = 0, 1, 2
VALUES = "conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FOREST = f"kind int, pid int, slot int, pslot int, parent_conv_id long, ordinal long, block int, chars long, digest binary, ids string, {VALUES}"
MERGED = f"pid int, slot int, pslot int, ordinal long, owner_pid int, owner_slot int, {VALUES}"


def arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def filled(schema: pa.Schema, n: int, **columns) -> Iterator[pa.RecordBatch]:
    """Batches of n rows; columns that aren't given are null."""
    arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema]
    held = pa.Table.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)
    yield from held.to_batches(max_chunksize=OUT)


def turns(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, the (digest, chars) of its turns in order. The length of the role keeps role and text apart in the digest."""
    said, by = text_of(f"`{text}`"), text_of(f"`{role}`")
    digest = F.substring(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary"), 256), 1, 2 * WIDTH)
    rows = convs.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.length(said).alias("chars")).alias("t")).filter("conv_id is not null")
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


class Forest:
    """The distinct sequences of one partition, in order, and the forest that their common prefixes make."""

    def __init__(self) -> None:
        self.pid, self.schema = 0, arrow(FOREST)
        self.key: bytes | None = None
        self.first_key, self.lcp, self.depth, self.n, self.least, self.sha = b"", [], [], [], [], []
        self.chars: list[np.ndarray] = []
        self.ids: list[str] = []
        self.hasher, self.block = hashlib.sha256(), 0

    def take(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.pid = b.column(0)[0].as_py() if b.num_rows else self.pid
        chars = b.column(3)
        flat, ends = chars.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(chars.offsets.to_numpy()))
        for i, (key, conv) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            if key != self.key:
                yield from self.ended(False)
                if self.key is None:
                    self.first_key = key
                self.lcp.append(common(self.key, key) if self.key is not None else 0)
                self.key = key
                self.depth.append(len(key) // WIDTH)
                self.chars.append(np.concatenate([[0], np.cumsum(flat[ends[i] - self.depth[-1] : ends[i]], dtype=np.int64)]))
                self.n.append(0)
                self.least.append(conv)
                self.hasher, self.block, self.ids = hashlib.sha256(), 0, []
            self.n[-1] += 1
            self.ids.append(str(conv))
            if len(self.ids) == BLOCK:
                yield from self.wrote(True)

    def wrote(self, send: bool) -> Iterator[pa.RecordBatch]:
        """Feeds the ids at hand to the hash of the last sequence; sends them on too if it may go on elsewhere."""
        text = ",".join(self.ids)
        self.hasher.update(("," * (self.block > 0) + text).encode())
        if send:
            yield from filled(self.schema, 1, kind=[IDS], pid=[self.pid], ordinal=[len(self.n) - 1], block=[self.block], ids=[text])
        self.block, self.ids = self.block + 1, []

    def ended(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.n:
            if self.ids:
                yield from self.wrote(last or len(self.n) == 1)
            self.sha.append(self.hasher.hexdigest())

    def merge(self) -> tuple[list[int], list[int]]:
        """depth and parent of each node. Node i below len(n) is where sequence i ends; the others are branching nodes."""
        m = len(self.n)
        depth, parent, link, top = list(self.depth), [-1] * m, list(range(m)), list(range(m))

        def find(i: int) -> int:
            while link[i] != i:
                link[i] = link[link[i]]
                i = link[i]
            return i

        # Of equal depths the left edge comes first, so the component on the right always lies deeper than the edge.
        for j in np.argsort(-np.array(self.lcp[1:], dtype=np.int64), kind="stable") + 1:
            a, b, d = find(j - 1), find(j), self.lcp[j]
            x, y = top[a], top[b]
            if depth[x] > d:
                depth.append(d)
                parent.append(-1)
                parent[x] = len(depth) - 1
                x = parent[x]
            parent[y] = x
            link[b], top[a] = a, x
        return depth, parent

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield from self.ended(True)
        m = len(self.n)
        if not m:
            return
        depths, parents = self.merge()
        size = len(depths)
        depth, parent = np.array(depths), np.array(parents)
        above = np.where(parent >= 0, depth[parent], -1)
        n, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
        n[:m], least[:m] = self.n, self.least
        lo, hi, rep = np.full(size, m), np.full(size, -1), np.full(size, -1)
        lo[:m] = hi[:m] = rep[:m] = np.arange(m)
        kids, leaves, below = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for v in np.argsort(-depth, kind="stable"):
            p = parent[v]
            closed = lo[v] > 0 and hi[v] < m - 1
            if closed and not kids[v]:
                leaves[v] = 1
            if p < 0:
                continue
            n[p] += n[v]
            least[p] = min(least[p], least[v])
            lo[p], hi[p], rep[p] = min(lo[p], lo[v]), max(hi[p], hi[v]), rep[v]
            if closed:
                c = self.chars[rep[v]]
                kids[p] += 1
                leaves[p] += leaves[v]
                below[p] += below[v] + (n[v] - 1) * (c[depth[v]] - c[max(above[v], 0)])
        is_open = (lo == 0) | (hi == m - 1)
        yield from self.closed(np.flatnonzero(~is_open), depth, above, parent, n, least, lo, rep, kids, leaves, below, is_open)
        yield from self.spine(np.flatnonzero(is_open), depth, above, n, least, lo, kids, leaves, below)

    def closed(self, nodes, depth, above, parent, n, least, lo, rep, kids, leaves, below, is_open) -> Iterator[pa.RecordBatch]:
        """Rows of the nodes that lie in this partition alone, each with those between it and the node above, which have its members."""
        m = len(self.n)
        for part in np.array_split(nodes, len(nodes) // OUT + 1):
            counts = depth[part] - above[part]
            v = np.repeat(part, counts)
            if not len(v):
                continue
            t = np.arange(len(v)) - np.repeat(np.cumsum(counts) - counts, counts) + above[v] + 1
            saved = np.concatenate([below[x] + (n[x] - 1) * ((c := self.chars[rep[x]])[depth[x]] - c[above[x] : depth[x]]) for x in part])
            own, p = t == depth[v], parent[v]
            first = (t == above[v] + 1) & is_open[p]
            shas = [self.sha[x] if o and x < m else NONE for x, o in zip(v.tolist(), own.tolist(), strict=True)]
            yield from filled(
                self.schema, len(v), kind=np.full(len(v), NODE), pid=np.full(len(v), self.pid), pslot=pa.array(np.where(lo[p] == 0, above[v], -above[v]), pa.int32(), mask=~first),
                parent_conv_id=pa.array(np.where(t - 1 > above[v], least[v], least[p]), pa.int64(), mask=first), conv_id=least[v], depth=t, n_convs=n[v], n_children=np.where(own, kids[v], 1), n_leaves=leaves[v], saved_tokens=saved, ends_sha256=shas,
            )

    def spine(self, nodes, depth, above, n, least, lo, kids, leaves, below) -> Iterator[pa.RecordBatch]:
        """Rows of the open nodes: slot is the depth on the path to the first sequence, its negative on the path to the last where they have parted. They count their closed children only."""
        m = len(self.n)
        shared = common(self.first_key, self.key) if m > 1 else self.depth[0]
        out = []
        for v in nodes.tolist():
            left = lo[v] == 0
            key, chars = (self.first_key, self.chars[0]) if left else (self.key, self.chars[-1])
            for t in range(int(above[v]) + 1, int(depth[v]) + 1):
                own = t == depth[v]
                up = None if t == 0 else t - 1 if left or t - 1 <= shared else 1 - t
                edge = own and v in (0, m - 1)
                counted = (int(kids[v]), int(leaves[v]), int(below[v])) if own else (0, 0, 0)
                out.append((t if left else -t, up, v if edge else None, int(chars[t] - chars[t - 1]) if t else 0, key[WIDTH * (t - 1) : WIDTH * t] if t else b"", int(least[v]), t, int(n[v]), *counted, self.sha[v] if own and v < m and not edge else None))
        names = ("slot", "pslot", "ordinal", "chars", "digest", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        yield from filled(self.schema, len(out), kind=[SPINE] * len(out), pid=[self.pid] * len(out), **{k: list(c) for k, c in zip(names, zip(*out, strict=True), strict=True)})


def common(a: bytes, b: bytes) -> int:
    """Digests that two rows of digests begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // WIDTH


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Forest()
    for b in batches:
        yield from held.take(b)
    yield from held.rows()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the open paths of partitions, which come in order, each the path to its first sequence and then what parts from it to the last. path holds the merged nodes from the root to where the last partition ended."""
    schema, path, out = arrow(MERGED), [], []

    def close(depth: int) -> None:
        """Ends the nodes below a depth: nothing that follows has their prefix."""
        while len(path) > depth:
            x = path.pop()
            x["n_leaves"] += not x["n_children"]
            x["saved_tokens"] += (x["n_convs"] - 1) * x["chars"]
            if path:
                up = path[-1]
                up["n_children"] += 1
                up["n_leaves"] += x["n_leaves"]
                up["saved_tokens"] += x["saved_tokens"]
            places = x.pop("at")
            out.extend({**x, "pid": pid, "slot": slot, "pslot": pslot, "ordinal": ordinal, "owner_pid": places[0][0], "owner_slot": places[0][1]} for pid, slot, pslot, ordinal in places)

    def sent() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in out], schema=schema)
        out.clear()
        return rows

    for _, group in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["pid"]):
        for r in group:
            at, d = (r["pid"], r["slot"], r["pslot"], r["ordinal"]), r["depth"]
            if len(path) > d and path[d]["digest"] != r["digest"]:
                close(d)
            if len(path) > d:
                x = path[d]
                for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    x[k] += r[k]
                x["conv_id"], x["ends_sha256"] = min(x["conv_id"], r["conv_id"]), x["ends_sha256"] or r["ends_sha256"]
                x["at"].append(at)
            else:
                path.append({**r, "at": [at]})
        if len(out) >= OUT:
            yield sent()
    close(0)
    yield sent()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the blocks of each node, which come in order, joined by commas."""
    now, hasher, out = None, None, []
    for b in batches:
        for r in b.to_pylist():
            at = (r["owner_pid"], r["owner_slot"])
            if at != now:
                if now is not None:
                    out.append((*now, hasher.hexdigest()))
                now, hasher = at, hashlib.sha256(r["ids"].encode())
            else:
                hasher.update(("," + r["ids"]).encode())
    if now is not None:
        out.append((*now, hasher.hexdigest()))
    columns = list(zip(*out, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["owner_pid", "owner_slot", "edge_sha"])


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations. sequences: conv_id, unique, and turns, an array of (digest, chars)."""
    small_batches(sequences.sparkSession)
    keyed = stash(sequences.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"].cast("int")).alias("chars")), "sequences")
    dealt = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select(F.spark_partition_id().alias("pid"), "key", "conv_id", "chars")
    forest = stash(dealt.mapInArrow(_forests, FOREST), "forest")
    own = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    spines = forest.filter(F.col("kind") == SPINE).select("pid", "slot", "pslot", "ordinal", "chars", "digest", *own)
    merged = stash(spines.repartition(1).sortWithinPartitions("pid", (F.col("slot") < 0), "depth").mapInArrow(_merged, MERGED), "merged")
    blocks = forest.filter(F.col("kind") == IDS).select("pid", "ordinal", "block", "ids").join(merged.filter("ordinal is not null").select("pid", "ordinal", "owner_pid", "owner_slot"), ["pid", "ordinal"])
    hashes = blocks.repartition("owner_pid", "owner_slot").sortWithinPartitions("owner_pid", "owner_slot", "pid", "block").select("owner_pid", "owner_slot", "ids").mapInArrow(_hashed, "owner_pid int, owner_slot int, edge_sha string")
    owners = merged.filter("pid = owner_pid and slot = owner_slot").join(hashes, ["owner_pid", "owner_slot"], "left").withColumn("ends_sha256", F.coalesce("edge_sha", "ends_sha256", F.lit(NONE)))
    nodes = forest.filter(F.col("kind") == NODE)
    hung = nodes.filter("pslot is not null").select("pid", "pslot", *own).unionByName(owners.select("pid", "pslot", *own))
    over = merged.select("pid", F.col("slot").alias("pslot"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.filter("pslot is null").select(*own, "parent_conv_id").unionByName(hung.join(over, ["pid", "pslot"], "left").select(*own, "parent_conv_id"))
    return found.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def with_turns(nodes: DataFrame, convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Adds role and text of each node's last turn, taken from its smallest member; null at the root. Only for conversations as they are in convs."""
    said = convs.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), text_of(f"`{role}`").alias("role"), text_of(f"`{text}`").alias("text"))
    tied = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    numbered = said.withColumn("depth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", tied)).cast("long")).drop("turn")
    return nodes.join(numbered, ["conv_id", "depth"], "left")


def prefix_trie(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations of a table as they are."""
    return trie(turns(convs, conv, turn, role, text))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations whose first h turns, h = crc32 of the id mod 6, are those of the conversation with the last full hundred as id. At most 100 conversations share one such beginning of five turns."""
    own = stash(turns(convs), "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    heads = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 5).alias("head"))
    joined = own.withColumn("h", h).withColumn("head_id", F.expr("conv_id - conv_id % 100")).join(heads, "head_id", "left")
    nothing = F.slice("turns", 1, 0)
    tail = F.filter("turns", lambda _, i: i >= F.col("h"))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")), tail).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


def op12_sql() -> str:
    """The same by prefixes as lists of turns; crc32 is computed bit by bit."""
    return """
with said as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i
  from conversations where conv_id is not null),
ids as (select distinct conv_id from said),
hashed as (
  select conv_id, conv_id - conv_id % 100 as head_id,
    xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::ubigint)), lambda t, z: xor(t >> 1, 3988292384::ubigint * (t & 1))))) % 6 as h
  from ids),
turns as (
  select h.conv_id, s.i, s.role, s.text from hashed h join said s on s.conv_id = h.head_id and s.i <= h.h
  union all
  select h.conv_id, s.i, s.role, s.text from hashed h join said s on s.conv_id = h.conv_id and s.i > h.h),
placed as (select conv_id, row_number() over (partition by conv_id order by i) as d, md5(length(role) || ':' || role || text) as turn, length(text) as chars from turns),
whole as (
  select conv_id, list(turn order by d) as keys, list(chars order by d) as chars from placed group by conv_id
  union all
  select conv_id, []::varchar[], []::bigint[] from ids where conv_id not in (select conv_id from placed)),
prefixes as (
  select conv_id, d, array_to_string(keys[1:d], '') as key, array_to_string(keys[1:d - 1], '') as up, case when d = 0 then 0 else chars[d] end as chars, d = len(keys) as ends
  from (select *, unnest(range(len(keys) + 1)) as d from whole)),
nodes as (
  select d, key, case when d > 0 then any_value(up) end as up, min(conv_id) as conv_id, count(*) as n, any_value(chars) as chars, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends
  from prefixes group by d, key),
kids as (select d - 1 as d, up as key, count(*) as n from nodes where d > 0 group by 1, 2),
full_nodes as (select n.*, coalesce(k.n, 0) as kids from nodes n left join kids k on k.d = n.d and k.key = n.key),
sums as (
  select v.top as d, left(v.key, 32 * v.top) as key, sum((v.n - 1) * v.chars) as saved, count(*) filter (where v.kids = 0) as leaves
  from (select *, unnest(range(d + 1)) as top from full_nodes) v group by 1, 2)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n as n_convs, n.kids as n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens, n.ends as ends_sha256
from full_nodes n join sums s on s.d = n.d and s.key = n.key left join nodes p on p.d = n.d - 1 and p.key = n.up
"""
