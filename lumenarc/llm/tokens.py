"""Token ids of texts, equal to those of the tokenizer file read by tokenizers.

Texts of common Latin characters are encoded by tiktoken, given the vocabulary and merges of the same file: both merge the
adjacent pair of the lowest rank first, and on these characters both split pre-tokens alike. Texts with any other
character, and files that aren't plain byte-level BPE with ranks in merge order, go to tokenizers.

parts() also cuts a text where pre-tokens must start: at a single space between two characters that are no white space, and at such
a newline. Each part is encoded once and then looked up. Other white space stays inside its part, so the ids of the parts are those of
the text in one piece.
"""

from __future__ import annotations

import json
import re
from array import array

CACHE_PARTS = 100_000
#: Fixed value: how byte-level BPE splits pre-tokens.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONE = re.compile(r"(?<!\S)[ \n]|[ \n](?!\S)")
OTHERS = re.compile(r"[^\t\n\r\x20-\x7e\u00a1-\u017f\u2010-\u2027\u20ac]")
CUTS = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def parts_of(text: str) -> list[str]:
    """Parts that a byte-level pre-tokenizer never joins; together they are the text."""
    if LONE.search(text):
        return CUTS.split(text)
    found: list[str] = []
    for i, line in enumerate(text.split("\n")):
        if i:
            found.append("\n")
        first, *rest = line.split(" ")
        found.append(first)
        found += [" " + x for x in rest]
    return [x for x in found if x] if "" in found else found


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranked(path: str):  # noqa: ANN201
    """A tiktoken encoding of a tokenizers file; None if the two could differ."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    plain = (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) == ("ByteLevel", True, False) and not told.get("normalizer")
    if model.get("type", "BPE") != "BPE" or not plain or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    letters = byte_letters()
    own = sorted(model["vocab"][c] for c in letters if c in model["vocab"])
    if len(own) != 256 or merged != sorted(set(merged)) or merged[:1] < own[-1:]:
        return None
    wanted = {*own, *merged}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i in wanted}
    return tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """ids(text) as little-endian unsigned 32-bit bytes. At most CACHE_PARTS parts are held; a full cache is emptied."""

    def __init__(self, path: str, most: int = CACHE_PARTS) -> None:
        self.path, self.plain, self.ranked = path, None, ranked(path)
        self.most, self.cache = most, {}

    @property
    def tokenizer(self):  # noqa: ANN201
        """Read when a text first needs it: it takes some 50 MB."""
        if self.plain is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
            self.plain.encode_special_tokens = True
        return self.plain

    def ids(self, text: str) -> bytes:
        if self.ranked and not OTHERS.search(text):
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def parts(self, text: str) -> tuple[list[str], list[bytes]]:
        if len(self.cache) > self.most:
            self.cache.clear()
        parts = parts_of(text)
        cache = self.cache
        new = list({p for p in parts if p not in cache})
        cache.update((p, self.ids(p)) for p in new)
        return parts, [cache[p] for p in parts]


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
