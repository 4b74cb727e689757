"""Packing token sequences of fixed capacity by exact-complement hashing."""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bookloom.llm.bpe import token_bytes
from bookloom.llm.common import arrow_map
from bookloom.operators.common import settle

CAPACITY = 2048
#: Distinct words that a Python worker remembers the ids of.
CACHED_WORDS = 400_000
# How the word model splits lower-cased text, and its mark for a word's end.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Stands for the word end inside byte strings; UTF-8 never holds this byte.
_END = b"\xff"


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Run of non-blanks (UTF-8) -> its ids as little-endian unsigned 32-bit bytes.

    The model drops white space and lets no piece cross it, so each run between ASCII blanks
    has its own ids.  Runs with a special token, another blank, a control character or a
    character from U+0500 on (where Unicode versions part) go through the tokenizer itself;
    all others are normalised, split and merged here.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS) -> None:
        super().__init__()
        self.cached, self.whole = cached, Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        chars = [t for t in vocab if len(t.removesuffix(WORD_END) or t) == 1 or len(t) == 1]
        order = [*sorted(chars, key=vocab.get), *(a + b for a, b in pairs)]
        self.ids = np.array([vocab[t] for t in order], dtype="<u4")
        ranks = {self._raw(t): r for r, t in enumerate(order)}
        merge = tiktoken.Encoding("words", pat_str=PIECES, special_tokens={}, mergeable_ranks=ranks)
        self.piece, self.pieces = merge._core_bpe.encode_single_piece, regex.compile(PIECES)
        self.odd = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])
                                 + r"|[\x00-\x20\x7f-\xa0\s]|[^\x00-\u04ff]")

    @staticmethod
    def _raw(token: str) -> bytes:
        if len(token) > len(WORD_END) and token.endswith(WORD_END):
            return token_bytes(token[:-len(WORD_END)]) + _END
        return token_bytes(token)

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode()
        if self.odd.search(text) or len(text.split()) != 1:
            got = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        else:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            # One character at a time where the final-sigma rule would look around it.
            low = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            ranks: list[int] = []
            for p in [low] if low.isalpha() and "'" not in low else self.pieces.findall(low):
                ranks += self.piece(p.encode() + _END)
            got = self.ids[ranks]
        if len(self) >= self.cached:
            self.clear()
        out = self[run] = got.tobytes()
        return out


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per Python worker and file."""
    return WordIds(path)


def text_ids(words: WordIds, text: str) -> bytes:
    return b"".join(map(words.__getitem__, text.encode().split()))


def token_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Every document's ids and a final 0, cut every `capacity` ids: doc_id, piece, start,
    length, ids_crc32, and the piece's place (task, rank) among those of its length."""
    def run(batches):
        words, counts, task = word_ids(path), [0] * (capacity + 1), TaskContext.get().partitionId()
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = memoryview(text_ids(words, text or "") + b"\0\0\0\0")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(part), task, counts[n]))
                    counts[n] += 1
            if rows:
                yield dict(zip(names, map(list, zip(*rows))))
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                     "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long", run)


class Sums:
    """Which lengths add up to which gap: every single, pair and triple of the lengths there
    are, by its sum, larger members first.  Counts only ever fall, so what has run out is
    passed over for good, and a look-up starts at the first combination that may still hold."""

    def __init__(self, left: np.ndarray, capacity: int) -> None:
        self.left = left
        there = left > 0
        self.pairs: list[list[int]] = [[], []]
        for total in range(2, capacity + 1):
            large = np.arange(total - 1, (total - 1) // 2, -1)
            self.pairs.append(large[there[large] & there[total - large]].tolist())
        self.pair_head = [0] * (capacity + 1)
        lengths = np.flatnonzero(there)[::-1].tolist()
        # The first of a triple is its largest: a third of the sum or more.
        self.firsts = [[n for n in lengths if n < total - 1 and 3 * n >= total and self.pairs[total - n]]
                       for total in range(capacity + 1)]
        self.first_head = [0] * (capacity + 1)

    def _gone(self, total: int, large: int) -> bool:
        small = total - large
        return not self.left[large] or not self.left[small] or (large == small and self.left[large] < 2)

    def pair(self, total: int, used: Counter) -> tuple[int, int] | None:
        held, head = self.pairs[total], self.pair_head[total]
        while head < len(held) and self._gone(total, held[head]):
            head += 1
        self.pair_head[total] = head
        for large in held[head:]:
            small = total - large
            twice = large == small
            if self.left[large] - used[large] > twice and self.left[small] - used[small] > 0:
                return large, small
        return None

    def triple(self, total: int, used: Counter) -> tuple[int, int, int] | None:
        held, head = self.firsts[total], self.first_head[total]
        while head < len(held) and (not self.left[held[head]]
                                    or self.pair_head[total - held[head]] == len(self.pairs[total - held[head]])):
            head += 1
        self.first_head[total] = head
        for first in held[head:]:
            if self.left[first] - used[first] > 0:
                used[first] += 1
                two = self.pair(total - first, used)
                used[first] -= 1
                if two:
                    return first, *two
        return None

    def exact(self, total: int, used: Counter) -> tuple[int, ...] | None:
        """One, two or three free lengths of exactly this sum."""
        if self.left[total] - used[total] > 0:
            return (total,)
        return self.pair(total, used) or self.triple(total, used)


class Planner:
    """Sequences for counts of lengths.  A plan has at most one entry per pattern and
    distinct length in it, whatever the counts: patterns are repeated while they last."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.left, self.capacity = counts.astype(np.int64).copy(), capacity
        self.sums = Sums(self.left, capacity)

    def pattern(self) -> dict[int, int]:
        """The next sequence: the longest free length, then whatever fills its gap exactly
        with up to three more; failing that the best fitting one, and again."""
        used: Counter = Counter()
        gap, longest = self.capacity, self.longest
        while gap:
            fill = None if gap == self.capacity else self.sums.exact(gap, used)
            if not fill:
                at = min(gap, longest)
                while at and self.left[at] - used[at] <= 0:
                    at -= 1
                if not at:
                    break
                fill = (at,)
            for n in fill:
                used[n] += 1
                gap -= n
        return {n: used[n] for n in sorted(used, reverse=True) if used[n]}

    @property
    def longest(self) -> int:
        return int(np.flatnonzero(self.left)[-1])

    def plan(self) -> np.ndarray:
        """Rows (length, first rank, uses per sequence, first sequence, offset), by length
        and rank: the piece of rank r there goes to sequence first + (r - first rank) // uses."""
        rows, done, sequence = [], np.zeros_like(self.left), 0
        while self.left.any():
            uses = self.pattern()
            times = min(int(self.left[n]) // k for n, k in uses.items())
            offset = 0
            for n, k in uses.items():
                rows.append((n, int(done[n]), k, sequence, offset))
                done[n] += k * times
                self.left[n] -= k * times
                offset += n * k
            sequence += times
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(pieces: DataFrame, plan: np.ndarray) -> DataFrame:
    """Sequence and offset of each piece from its rank among those of its length."""
    span = np.int64(1) << 48
    starts = plan[:, 0] * span + plan[:, 1]

    def run(batches):
        for b in batches:
            n, rank = np.array(b["length"], np.int64), np.array(b["rank"], np.int64)
            at = np.searchsorted(starts, n * span + rank, "right") - 1
            _, first, uses, sequence, offset = plan[at].T
            yield b | {"sequence_id": sequence + (rank - first) // uses, "offset": offset + (rank - first) % uses * n}

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return arrow_map(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), schema, run)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and offset there.

    Lengths alone decide the plan, so only their counts (at most `capacity` rows) reach the
    driver, and the plan that goes back is bounded by the capacity too.  Null texts count as
    empty: one id.  A very long text is encoded whole by one task and cut into pieces, which go
    where they fit.  Repeated rows are packed each; an empty table gives no rows.  Which of
    several pieces of one length goes where follows from their place in the input files.
    """
    pieces = settle(token_pieces(docs, path or default_path(), capacity), "token-pieces")
    sizes = pieces.groupBy("task", "length").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("_c")).collect():
        counts[length] = n
    plan = Planner(counts, capacity).plan()
    ranked = pieces.join(firsts.drop("_c"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("_first"))
    return place(ranked, plan)
