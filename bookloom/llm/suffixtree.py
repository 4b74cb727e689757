"""Language-model scores by a probabilistic suffix tree over the bytes of a text's words.

A text is the bytes of its lower-cased words, each followed by a space, and one end mark.
The tree holds contexts of up to DEPTH preceding bytes.  A context stays if it is frequent
enough and its next-byte distribution diverges from that of the context one byte shorter by
more than its own parameters cost (n * KL >= d / 2 * ln N for d different next bytes of n
occurrences among N bytes); with it stay its suffixes.  A state's distribution gives each of
its successors its share of n + d and the remaining share to the next shorter state, so the
distributions are smoothed and sum to 1.  Each byte is predicted by the longest state
that its past ends in.

Counts of all contexts and all words come from the whole training part, counted per task
first and then added by Spark.  The tasks receive the successors of states that make up a
`share`-th of all bytes or more, at most `share` of them for each length whatever the corpus.
Words that make up a `word_share`-th of all tokens are handed out alike; the others are
looked up by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import arrow_map, text_groups
from bookloom.operators.common import settle

DEPTH = 6
#: A successor is held by every task if it makes up this part of all bytes or more,
SHARE = 1 << 22
#: and a word if it makes up this part of all tokens or more.
WORD_SHARE = 1 << 18
END = b"\n"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Different codes that a task gathers before it hands its counts on.
_KEPT = 1 << 22


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def marked(tokens: list[bytes]) -> bytes:
    """Words with a space after each, and the end."""
    return b" ".join([*tokens, END])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; a null id counts as the
    empty text, which leaves 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def codes(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """Per byte of the texts its depth predecessors in the text and itself as one integer,
    the latest byte lowest.  What precedes a text is end marks."""
    line = np.frombuffer(b"".join(END * depth + t for t in texts), np.uint8)
    out, have = line.astype(np.int64), 1
    while have <= depth:
        # Strings of `have` bytes ending here and `more` bytes earlier overlap or touch.
        more = min(have, depth + 1 - have)
        out[more:] |= out[:-more] << 8 * more
        have += more
    out &= _mask(depth + 1)
    own = np.ones(len(line), bool)
    starts = np.cumsum([0, *(len(t) + depth for t in texts)])[:-1]
    own[(starts[:, None] + np.arange(depth)).ravel()] = False
    return out[own]


def _mask(length: int) -> int:
    return (1 << 8 * length) - 1


#: The kind of a row of counts: a word, or a context's length.
WORD = -1


def count(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, code, n) over docs(text): words by their 64-bit hash (one end per text among
    them), and the codes of the longest contexts."""
    def run(batches):
        held: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for group in (g for b in batches for g in text_groups(b)):
            texts = [words(t) for t in group["text"]]
            for t in texts:
                held.update(t)
            held[END] += len(texts)
            parts.append(np.unique(codes([marked(t) for t in texts], depth), return_counts=True))
            if sum(len(code) for code, _ in parts) > _KEPT:
                parts = [_added(parts)]
                if len(parts[0][0]) > _KEPT // 2 or len(held) > _KEPT // 8:
                    yield from _rows(held, parts, depth)
                    held, parts = Counter(), []
        yield from _rows(held, parts, depth)

    rows = arrow_map(docs.select("text"), "kind int, code long, n long", run)
    return rows.groupBy("kind", "code").agg(F.sum("n").alias("n"))


def _rows(held: Counter, parts: list[tuple[np.ndarray, np.ndarray]], depth: int) -> Iterator[dict]:
    if not parts:
        return
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, held), np.uint64, len(held)).view(np.int64)
    yield {"kind": np.full(len(held), WORD), "code": hashes, "n": list(held.values())}
    code, n = _added(parts)
    for at in range(0, len(code), 1 << 18):
        part = code[at:at + (1 << 18)]
        yield {"kind": np.full(len(part), depth), "code": part, "n": n[at:at + (1 << 18)]}


def levels(counted: DataFrame, depth: int) -> DataFrame:
    """(kind, code, n) of every context length, each from the counts of the next longer."""
    level = counted.filter(F.col("kind") == depth)
    out = level
    for k in range(depth - 1, -1, -1):
        level = settle(level.groupBy(F.col("code").bitwiseAND(F.lit(_mask(k + 1))).alias("code")).agg(
            F.sum("n").alias("n")).select(F.lit(k).alias("kind"), "code", "n"), "contexts-shorter")
        out = out.unionByName(level)
    return out


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(x) for x in zip(*parts))
    if len(parts) == 1:
        return code, n
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first)


@dataclass(frozen=True)
class Tree:
    """Per context length: sorted contexts of the states with the share they leave to the
    next shorter one, and sorted successors with their own share.  The frequent words'
    sorted hashes with their base log10 probability."""
    train_tokens: int
    states: list[tuple[np.ndarray, np.ndarray]]
    successors: list[tuple[np.ndarray, np.ndarray]]
    words: np.ndarray
    base: np.ndarray
    distinct: int

    def log10(self, code: np.ndarray) -> np.ndarray:
        """Of each different code the log10 probability of its last byte after the others."""
        p = np.full(len(code), 1 / 256)
        state = np.ones(len(code), bool)
        for k, ((context, left), (pair, own)) in enumerate(zip(self.states, self.successors)):
            at, hit = _find(context, (code >> 8) & _mask(k))
            state &= hit
            of, found = _find(pair, code & _mask(k + 1))
            p = np.where(state, np.where(found, own[of], 0.0) + left[at] * p, p)
        return np.log10(p)


class Known:
    """Log10 probabilities already looked up, one code per slot of a hash table."""

    def __init__(self, tree: Tree, bits: int = 21) -> None:
        self.tree, self.bits = tree, bits
        self.code, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)

    def log10(self, code: np.ndarray) -> np.ndarray:
        slot = _slot(code, self.bits)
        out = self.value[slot]
        missed = np.flatnonzero(self.code[slot] != code)
        if len(missed):
            new, back = np.unique(code[missed], return_inverse=True)
            value = self.tree.log10(new)
            out[missed] = value[back]
            at = _slot(new, self.bits)
            self.code[at] = new
            # Of codes that share a slot one stays, with its own value.
            stays = self.code[at] == new
            self.value[at[stays]] = value[stays]
        return out


def _slot(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _table(keys, values) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values; a key that no code has stands in for none."""
    if not len(keys):
        return np.array([-1], np.int64), np.zeros(1)
    return np.array(keys, np.int64), np.array(values, float)


def fit(counted: DataFrame, depth: int = DEPTH, share: int = SHARE, word_share: int = WORD_SHARE) -> Tree:
    """The tree of written counts.  Of no training text at all every byte has 1 / 256."""
    word = F.col("kind") == WORD
    total = counted.agg(F.sum(F.when(word, F.col("n"))).alias("tokens"), F.count_if(word).alias("distinct"),
                        F.sum(F.when(~word, F.col("n"))).alias("bytes")).first()
    tokens, size = total["tokens"] or 0, total["bytes"] or 0
    if not tokens:
        states = [_table([0] if k == 0 else [], [1.0] if k == 0 else []) for k in range(depth + 1)]
        return Tree(0, states, [_table([], [])] * (depth + 1), np.zeros(0, np.int64), np.zeros(0), 0)
    often = counted.filter(word & (F.col("n") * word_share >= tokens)).select("code", "n").toArrow().sort_by("code")
    base = np.log10((often["n"].to_numpy() + 1) / (tokens + total["distinct"] + 1))

    pairs = levels(counted, depth).withColumn("context", F.shiftright("code", 8))
    sums = pairs.groupBy("kind", "context").agg(F.sum("n").alias("of"), F.count("*").alias("d"))
    inside = settle(pairs.join(sums.filter(F.col("of") * share >= size), ["kind", "context"]), "successors")
    # How far each context lies from the one a byte shorter, whose counts hold all of its own.
    short = F.element_at(F.array(*[F.lit(_mask(k)) for k in range(depth + 1)]), F.col("kind") + 1)
    here = inside.filter("kind > 0").select("kind", "context", "n", "of", "d", F.col("code").bitwiseAND(short).alias("shorter"))
    there = inside.select((F.col("kind") + 1).alias("kind"), F.col("code").alias("shorter"),
                          F.col("n").alias("n_short"), F.col("of").alias("of_short"))
    gain = F.sum(F.col("n") * F.log(F.col("n") * F.col("of_short") / (F.col("of") * F.col("n_short"))))
    apart = here.join(there, ["kind", "shorter"]).groupBy("kind", "context").agg(
        gain.alias("gain"), F.first("d").alias("d"))
    stay = apart.filter(F.col("gain") >= F.col("d") * (0.5 * float(np.log(size))))
    suffixes = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("context").bitwiseAND(F.lit(_mask(k))).alias("context"))
                         for k in range(depth + 1)])
    closed = stay.select(F.explode(F.slice(suffixes, 1, F.col("kind") + 1)).alias("s")).select("s.*").distinct()
    # A state without a frequent successor hands everything on, as do all that are longer.
    rows = inside.filter(F.col("n") * share >= size).join(closed, ["kind", "context"], "left_semi").unionByName(
        inside.filter("kind = 0")).select("kind", "code", "n", "of", "d").distinct().toArrow()
    return Tree(tokens, *_levels_of(rows, depth), often["code"].to_numpy(), base, total["distinct"])


def _levels_of(rows: pa.Table, depth: int) -> tuple[list[tuple], list[tuple]]:
    """States and successors per context length from rows (kind, code, n, of, d)."""
    kind, code, n, of, d = (rows[c].to_numpy() for c in ("kind", "code", "n", "of", "d"))
    states, successors = [], []
    for k in range(depth + 1):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(code[own])]
        context, first, where = np.unique(code[own] >> 8, return_index=True, return_inverse=True)
        whole = (of + d)[own][first]
        states.append(_table(context, (whole - np.bincount(where, n[own], len(context))) / whole))
        successors.append(_table(code[own], n[own] / (of + d)[own]))
    return states, successors


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        out = self[word] = h - (1 << 64) if h >> 63 else h
        return out


def _text_scores(known: Known, texts: list[list[bytes]], depth: int) -> np.ndarray:
    lines = [marked(t) for t in texts]
    return np.add.reduceat(known.log10(codes(lines, depth)), np.cumsum([0, *map(len, lines)])[:-1])


def _word_scores(tree: Tree, texts: list[list[bytes]], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per text the base score and the number of its tokens that all tasks know, and the
    other words with how often they stand there."""
    sizes = np.array([len(t) + 1 for t in texts])
    code = np.fromiter((hashes[w] for t in texts for w in (*t, END)), np.int64, int(sizes.sum()))
    at, known = _find(tree.words, code)
    starts = np.cumsum(sizes) - sizes
    base = np.add.reduceat(np.where(known, tree.base[at] if len(tree.base) else 0.0, 0.0), starts)
    row = np.repeat(np.arange(len(texts)), sizes)[~known]
    order = np.lexsort((code[~known], row))
    row, rare = row[order], code[~known][order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(rare, prepend=0) != 0))
    each = pa.StructArray.from_arrays([pa.array(rare[first]), pa.array(np.diff(np.append(first, len(rare))))], ["code", "times"])
    ends = np.append(0, np.cumsum(np.bincount(row[first], minlength=len(texts)))).astype(np.int32)
    return base, np.add.reduceat(known.astype(np.int64), starts), pa.ListArray.from_arrays(pa.array(ends), each)


def score(docs: DataFrame, depth: int = DEPTH, share: int = SHARE,
          word_share: int = WORD_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row,
    learning from the rows that are not held out.

    Null and empty texts are the end alone; very long texts are taken whole; repeated rows
    are scored and, in training, counted each; other columns are ignored; an empty table
    gives no rows; without training rows every word is unknown and every byte has 1 / 256.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    counted = settle(count(rows.filter(~F.col("held_out")), depth), "suffix-counts")
    tree = fit(counted, depth, share, word_share)

    def run(batches):
        hashes, seen = _Hashes(), Known(tree)
        for b in (g for batch in batches for g in text_groups(batch, 1 << 20)):
            texts = [words(t) for t in b["text"]]
            base, known, rare = _word_scores(tree, texts, hashes)
            yield {"row": b["row"], "doc_id": b["doc_id"], "held_out": b["held_out"], "n_tokens": [len(t) + 1 for t in texts],
                   "known": known, "base": base, "score": _text_scores(seen, texts, depth), "rare": rare}

    part = settle(arrow_map(rows.withColumn("row", F.monotonically_increasing_id()),
                            "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, "
                            "rare array<struct<code:long,times:long>>", run), "suffix-scores")
    seldom = counted.filter((F.col("kind") == WORD) & (F.col("n") * word_share < tree.train_tokens)).select("code", "n")
    asked = part.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    looked = asked.join(seldom, "code", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("also"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(tree.train_tokens + tree.distinct + 1))).alias("more"))
    return part.join(looked, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(tree.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")

