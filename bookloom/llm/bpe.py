"""Byte-pair encoding of whole texts, and decoding.

The vocabulary is a tokenizers JSON file with a byte-level model, read by every Python
worker from the same path.  tiktoken's compiled merge loop does the merging of one piece.

Long unsplit text is encoded by tree concatenation: halves are encoded apart, and at each
join a window of tokens is re-encoded, doubling until its first token is one the left half
has at that place and its last token one of the right half.  A token sequence is the
encoding of its bytes exactly if each neighbouring pair of tokens is the encoding of its
own bytes; every pair of the joined sequence lies in the left half, the window or the
right half, so agreement on one token on each side proves the whole.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bookloom.llm.common import arrow_map

# Fixed value: how byte-level models split text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_BYTES = 512
#: Texts beyond this many characters are encoded in parts by several tasks.
LONG_CHARS = 1 << 16


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def byte_of() -> dict[str, int]:
    """The visible character that byte-level vocabularies write for each byte: printable
    Latin-1 stands for itself, the others follow from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


def token_bytes(token: str) -> bytes:
    return bytes(map(byte_of().__getitem__, token))


class Coder:
    """encode(text) and decode(ids) for one vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF_BYTES) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.leaf = spec["model"], leaf
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        order = [*sorted((t for t in model["vocab"] if len(t) == 1), key=model["vocab"].get),
                 *(a + b for a, b in pairs)]
        self.ids = np.array([model["vocab"][t] for t in order], dtype=np.int32)
        self.rank = {model["vocab"][t]: r for r, t in enumerate(order)}
        words = [token_bytes(t) for t in order]
        self.bytes = {int(i): w for i, w in zip(self.ids, words)} | {i: s.encode() for s, i in special.items()}
        self.raw = words
        self.merge = tiktoken.Encoding("pieces", pat_str=PIECES, special_tokens={},
                                       mergeable_ranks={w: r for r, w in enumerate(words)})
        self.piece = self.merge._core_bpe.encode_single_piece
        self.special = special
        self.at_special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.splitter = Tokenizer.from_file(path).pre_tokenizer

    def pieces(self, text: str) -> list[str]:
        """The pieces that the vocabulary's own splitter finds, so that letters are the same
        ones whatever a text's length."""
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        """The ranks of left's and right's bytes together, from the ranks of each."""
        while True:
            a, b = max(0, len(left) - window), min(len(right), window)
            mid = self.piece(b"".join([self.raw[r] for r in left[a:] + right[:b]]))
            if (not a or mid[0] == left[a]) and (b == len(right) or mid[-1] == right[b - 1]):
                return left[:a] + mid + right[b:]
            window *= 2

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.piece(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def plain(self, text: str) -> list[int]:
        """Ranks of a text without special tokens.  A piece holds at most one run of
        non-blanks, so texts without a long run need no tree."""
        if max(map(len, text.split()), default=0) * 4 <= self.leaf or len(text) * 4 <= self.leaf:
            return self.merge.encode_ordinary(text)
        out: list[int] = []
        for p in self.pieces(text):
            out += self.tree(p.encode())
        return out

    def pieced(self, raw: bytes, sizes: Iterable[int]) -> list[int]:
        """Ranks of bytes whose pieces are known by their sizes."""
        out: list[int] = []
        at = 0
        for n in sizes:
            out += self.tree(raw[at:at + n])
            at += n
        return out

    def cut(self, text: str) -> Iterator[str | int]:
        """The text between special tokens, and their ids."""
        if not self.special:
            yield text
            return
        done = 0
        for m in self.at_special.finditer(text):
            yield text[done:m.start()]
            yield self.special[m[0]]
            done = m.end()
        yield text[done:]

    def encode(self, text: str) -> np.ndarray:
        parts = [np.array([p], np.int32) if isinstance(p, int) else self.ids[self.plain(p)] for p in self.cut(text) if p != ""]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def coder(path: str) -> Coder:
    """One per Python worker and file."""
    return Coder(path)


def _whole(path: str):
    def run(batches):
        c = coder(path)
        for b in batches:
            ids = [c.encode(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "ids": ids, "decoded": [c.decode(x.tolist()) for x in ids]}
    return run


def parts_of(c: Coder, text: str, size: int) -> Iterator[tuple[int, bool, list[int], bytes]]:
    """(special id or -1, whether it continues the piece before, the bytes of each piece,
    bytes).  Pieces are gathered up to `size` bytes and never split anew, since where a piece
    ends depends on what follows it; one piece beyond that size is halved into leaves that a
    tree joins."""
    for p in c.cut(text):
        if isinstance(p, int):
            yield p, False, [], b""
            continue
        held: list[bytes] = []
        n = 0
        for piece in c.pieces(p):
            if held and n + len(piece) * 4 > size:
                yield -1, False, list(map(len, held)), b"".join(held)
                held, n = [], 0
            raw = piece.encode()
            if len(raw) > size:
                for at in range(0, len(raw), size):
                    yield -1, at > 0, [len(raw[at:at + size])], raw[at:at + size]
            else:
                held.append(raw)
                n += len(piece) * 4
        if held:
            yield -1, False, list(map(len, held)), b"".join(held)


def _cut(path: str, size: int):
    def run(batches):
        c = coder(path)
        for b in batches:
            for row, doc, text in zip(b["_row"], b["doc_id"], b["text"]):
                rows = [(row, doc, n, *x) for n, x in enumerate(parts_of(c, text, size))]
                yield dict(zip(("_row", "doc_id", "part", "special", "glued", "sizes", "raw"), map(list, zip(*rows))))
    return run


def _encode_parts(path: str):
    def run(batches):
        c = coder(path)
        for b in batches:
            ranks = [c.pieced(raw, sizes) for raw, sizes in zip(b["raw"], b["sizes"])]
            yield {k: b[k] for k in ("_row", "doc_id", "part", "special", "glued")} | {"ranks": ranks}
    return run


def _join_parts(path: str):
    def tree(c: Coder, runs: list[list[int]]) -> list[int]:
        while len(runs) > 1:
            runs = [c.join(runs[i], runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return runs[0]

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        c, out = coder(path), []
        parts = parts.sort_values("part")
        groups: list[tuple[int, list[list[int]]]] = []
        for special, glued, ranks in zip(parts["special"], parts["glued"], parts["ranks"]):
            if glued:
                groups[-1][1].append(list(ranks))
            else:
                groups.append((special, [list(ranks)]))
        for special, runs in groups:
            out.append(np.array([special], np.int32) if special >= 0 else c.ids[tree(c, runs)])
        ids = np.concatenate(out).tolist()
        return pd.DataFrame({"doc_id": [parts["doc_id"].iloc[0]], "ids": [ids], "decoded": [c.decode(ids)]})
    return run


def encode(docs: DataFrame, path: str | None = None, long_chars: int = LONG_CHARS) -> DataFrame:
    """doc_id, ids array<int>, decoded for every row: the ids of the whole text and the text
    that they give back.  A special token's string in a text is that token.

    Null texts count as empty (no ids).  Repeated rows give repeated results.  Texts of over
    `long_chars` characters are cut into parts that any task may encode; each text's parts
    then meet in one task, as the text itself does.
    """
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > long_chars
    short = arrow_map(rows.filter(~long), "doc_id long, ids array<int>, decoded string", _whole(path))
    cut = arrow_map(rows.filter(long).withColumn("_row", F.monotonically_increasing_id()),
                    "_row long, doc_id long, part int, special int, glued boolean, sizes array<int>, raw binary", _cut(path, long_chars))
    coded = arrow_map(cut.repartition("_row", "part"),
                      "_row long, doc_id long, part int, special int, glued boolean, ranks array<int>",
                      _encode_parts(path))
    joined = coded.groupBy("_row").applyInPandas(_join_parts(path), "doc_id long, ids array<int>, decoded string")
    return short.unionByName(joined)
