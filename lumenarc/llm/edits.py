"""Edit-aware token counts: a segment tree over pre-tokens for each document.

The parts of a text that a byte-level pre-tokenizer never joins are grouped into leaves of LEAF parts; two trees of sums
over the leaves (characters and tokens) are kept beside the text. An edit finds the leaves that it touches, with
CONTEXT characters on either side, by descending the tree; only their text is encoded anew and dealt over the same leaves, LEAF parts each,
and the sums above are updated. Where it has more parts than these leaves take, new leaves are made: the tree is laid out again from the sums of its leaves, without encoding
any other, so leaves stay small after large inserts. Whether a leaf's edge is a safe cut depends on the two characters on each
side, so edges outside the touched leaves stay safe, and the root equals the count of the whole new text.

The state is a table (doc_id, text, char_tree, token_tree) that Spark stores; edits are an array in each row, so applying
them needs no shuffle; with_edits() gathers an edit table for that.

Defined results: null texts are empty, with one empty leaf; positions and lengths of edits are cut to the text; rows with equal ids are separate
documents that get the same edits; a null or empty edit list changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import small_batches, table, text_of
from .tokens import Encoder, default_path, encoder

LEAF, CONTEXT = 32, 2
EDIT = "struct<at:int,remove:int,insert:string>"


class Tree:
    """chars and tokens: arrays of 2 * width sums; node i has the children 2i and 2i + 1, leaves begin at width."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]) -> None:
        self.text, self.chars, self.tokens, self.width, self.encoded = text, chars, tokens, len(chars) // 2, 0

    @classmethod
    def build(cls, enc: Encoder, text: str, leaf: int = LEAF) -> Tree:
        parts, ids = enc.parts(text)
        tree = cls(text, [0, 0], [0, 0])
        tree.lay([(sum(map(len, parts[i : i + leaf])), sum(map(len, ids[i : i + leaf])) // 4) for i in range(0, len(parts), leaf)])
        return tree

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node, before = 1, 0
        position = max(0, min(position, self.chars[1] - 1))
        while node < self.width:
            node *= 2
            if before + self.chars[node] <= position:
                before += self.chars[node]
                node += 1
        return node, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        dc, dt = chars - self.chars[leaf], tokens - self.tokens[leaf]
        while leaf and (dc or dt):
            self.chars[leaf] += dc
            self.tokens[leaf] += dt
            leaf //= 2

    def edit(self, enc: Encoder, at: int, remove: int, insert: str, leaf: int = LEAF) -> None:
        at = max(0, min(at, len(self.text)))
        remove = max(0, min(remove, len(self.text) - at))
        first, start = self.leaf_at(at - CONTEXT)
        last, before = self.leaf_at(at + remove + CONTEXT)
        stop = before + self.chars[last]
        region = self.text[start:at] + insert + self.text[at + remove : stop]
        self.text = self.text[:start] + region + self.text[stop:]
        self.encoded += len(region)
        parts, ids = enc.parts(region)
        new = [(sum(map(len, parts[i : i + leaf])), sum(map(len, ids[i : i + leaf])) // 4) for i in range(0, len(parts), leaf)]
        if len(new) <= last - first + 1:
            for i in range(first, last + 1):
                self.put(i, *(new[i - first] if i - first < len(new) else (0, 0)))
        else:
            leaves = list(zip(self.chars[self.width :], self.tokens[self.width :], strict=True))
            self.lay([x for x in (*leaves[: first - self.width], *new, *leaves[last - self.width + 1 :]) if x[0]])

    def lay(self, leaves: list[tuple[int, int]]) -> None:
        """Sums over these leaves."""
        width = 1 << max(len(leaves) - 1, 0).bit_length()
        chars, tokens = [0] * (2 * width), [0] * (2 * width)
        for i, (c, t) in enumerate(leaves):
            chars[width + i], tokens[width + i] = c, t
        for i in range(width - 1, 0, -1):
            chars[i], tokens[i] = chars[2 * i] + chars[2 * i + 1], tokens[2 * i] + tokens[2 * i + 1]
        self.chars, self.tokens, self.width = chars, tokens, width


def build_state(docs: DataFrame, tokenizer_path: str | None = None, id_name: str = "doc_id", text_name: str = "text", leaf: int = LEAF, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, char_tree, token_tree; token_tree[1] is the document's count. keep: columns of docs to carry along."""
    path = tokenizer_path or default_path()
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), text_of(text_name).alias("text"), *keep)
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            trees = [Tree.build(enc, t, leaf) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.chars for t in trees], ints), pa.array([t.tokens for t in trees], ints)], names=[*b.schema.names, "char_tree", "token_tree"])

    small_batches(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, char_tree array<int>, token_tree array<int>")


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """state with a column edits, from rows (doc_id, seq, at, remove, insert); a document's edits are one row and apply in the order of seq."""
    lists = edits.groupBy(F.col("doc_id").alias("edit_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "at", "remove", "insert"))), lambda x: F.struct(x["at"].cast("int").alias("at"), x["remove"].cast("int").alias("remove"), x["insert"].alias("insert"))).alias("edits"))
    return state.join(lists, F.col("doc_id") == F.col("edit_id"), "left").drop("edit_id")


def apply_edits(state: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The state after its edits, with tokens_before, n_tokens and encoded_chars (characters that were encoded anew)."""
    path = tokenizer_path or default_path()
    ints = pa.list_(pa.int32())
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "char_tree": ints, "token_tree": ints, "tokens_before": pa.int64(), "n_tokens": pa.int64(), "encoded_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, text, chars, tokens, edits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tree = Tree(text, chars, tokens)
                before = tokens[1]
                for e in edits or ():
                    tree.edit(enc, e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                for column, value in zip(out, (doc, tree.text, tree.chars, tree.tokens, before, tree.tokens[1], tree.encoded), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds.values(), strict=True)], names=list(kinds))

    small_batches(state.sparkSession)
    rows = state.select("doc_id", "text", "char_tree", "token_tree", F.col("edits").cast(f"array<{EDIT}>").alias("edits"))
    return rows.mapInArrow(run, "doc_id long, text string, char_tree array<int>, token_tree array<int>, tokens_before long, n_tokens long, encoded_chars long")


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Four edits for each document of the query, with places and sizes by hashes of its id: an insert of its own words, a cut, a replaced stretch, an appended repeat."""
    n = F.length(text)
    any_of = lambda k, most: F.pmod(F.xxhash64(doc_id, F.lit(k)), most.cast("long") + 1).cast("int")
    edit = lambda at, remove, insert: F.struct(at.cast("int").alias("at"), remove.cast("int").alias("remove"), insert.alias("insert"))
    few = F.lit(60)
    return F.array(
        edit(any_of(1, n), F.lit(0), F.substring(text, any_of(2, n), any_of(3, few))),
        edit(any_of(4, n), any_of(5, few), F.lit("")),
        edit(any_of(6, n), any_of(7, few), F.lit(" amended")),
        edit(n + 200, F.lit(0), F.concat(F.lit("\n"), F.substring(text, 1, 40))),
    )


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    state = build_state(docs).withColumn("edits", sample_edits(F.col("doc_id"), F.col("text")))
    return apply_edits(state).select("doc_id", "tokens_before", "n_tokens", "encoded_chars", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
