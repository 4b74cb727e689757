"""Ranked lexical search over hashed max-sketches.

Terms are hashed to a fixed number of coordinates.  A document's sketch holds per coordinate
the greatest impact of its terms there.  Within one document the impact grows with the
term's count alone, so the greatest count stands for the greatest impact whatever the
corpus-wide numbers turn out to be: sketches are made in one pass and serve any query.

A query's score in a document is at most the sum of its terms' weights times the impacts at
their coordinates.  The search looks these bounds up for blocks of documents and all items
at once.  First the k greatest bounds of each item are rescored: their k-th score is a proven
floor.  Then every task takes its documents of a bound not below the floor in descending
order and rescores them exactly, until the next bound is below its own k-th score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import arrow_map, text_groups
from bookloom.operators.common import settle, top_rows

K = 20
COORDINATES = 4096
#: Items that one pass over the index serves.
ITEMS = 1000
#: Documents whose bounds are looked up together.
_BLOCK = 1024
_TERM = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_TERM).split(b" ") if text else []


def counts(text: str | None) -> Counter:
    out = Counter(terms(text))
    out.pop(b"", None)
    return out


def coordinate(term: bytes, size: int) -> int:
    return zlib.crc32(term) % size


class _Places(dict):
    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, term: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[term] = coordinate(term, self.size)
        return out


def sketch(tf: Counter, places: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates in use, greatest count at each)."""
    at = np.fromiter(map(places.__getitem__, tf), np.int32, len(tf))
    n = np.fromiter(tf.values(), np.int64, len(tf))
    order = np.lexsort((-n, at))
    at, n = at[order], n[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], np.minimum(n[first], np.iinfo(np.int32).max).astype(np.int32)


def build(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """The index, one row per document with a term: row, doc_id, text, n (its terms), at and
    most (its sketch).  Written; null and empty texts have no term and are left out."""
    def run(batches):
        places = _Places(coordinates)
        for b in (g for batch in batches for g in text_groups(batch)):
            out = {"row": [], "doc_id": [], "text": [], "n": [], "at": [], "most": []}
            for row, doc, text in zip(b["row"], b["doc_id"], b["text"]):
                if tf := counts(text):
                    at, most = sketch(tf, places)
                    for name, value in zip(out, (row, doc, text, tf.total(), at, most)):
                        out[name].append(value)
            yield out

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settle(arrow_map(rows, "row long, doc_id long, text string, n long, at array<int>, most array<int>", run), "max-sketch")


@dataclass(frozen=True)
class Corpus:
    """N documents with a term and all their terms, L."""
    documents: int
    length: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def damping(self, n: int) -> int:
        """A document's m."""
        return 100 - 25 + (25 * n * self.documents) // self.length


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass(frozen=True)
class Items:
    """Queries of one pass: row and item id, and for each its terms with their repeats
    times weights, and its coordinates with the weights that meet there."""
    rows: list[int]
    ids: list[int | None]
    terms: list[dict[bytes, int]]
    at: list[np.ndarray]
    weights: list[np.ndarray]

    @classmethod
    def of(cls, asked: list[tuple], weight: dict[bytes, int], coordinates: int) -> Items:
        own = [{t: n * weight[t] for t, n in counts(text).items()} for _, _, text in asked]
        at, sums = [], []
        for q in own:
            place = np.array([coordinate(t, coordinates) for t in q], np.int64)
            used, back = np.unique(place, return_inverse=True)
            at.append(used)
            sums.append(np.bincount(back, np.array(list(q.values()), float), len(used)))
        return cls([r for r, _, _ in asked], [i for _, i, _ in asked], own, at, sums)

    def bounds(self, corpus: Corpus, coordinates: int, n: list[int], at: pa.ListArray, most: pa.ListArray) -> np.ndarray:
        """(documents, items) upper bounds of the scores."""
        m = np.array([corpus.damping(x) for x in n], float)
        dense = np.zeros((len(n), coordinates))
        lengths = np.diff(at.offsets.to_numpy())
        first, last = at.offsets[0].as_py(), at.offsets[-1].as_py()
        doc = np.repeat(np.arange(len(n)), lengths)
        tf = most.values.to_numpy()[first:last].astype(float)
        dense[doc, at.values.to_numpy()[first:last]] = 1e9 * tf / (1000 * tf + 12 * m[doc])
        # Room for what the float sums round off.
        return np.column_stack([dense[:, a] @ w for a, w in zip(self.at, self.weights)]) * (1 + 1e-9) + 1e-3

    def score(self, item: int, tf: Counter, m: int) -> int:
        q = self.terms[item]
        small, large = (q, tf) if len(q) < len(tf) else (tf, q)
        return sum(q[t] * impact(tf[t], m) for t in small if t in large)


def frequencies(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df) for wanted(term): documents that hold it, counted per task first."""
    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                seen.update(counts(text).keys())
                if len(seen) > 200_000:
                    yield {"term": list(seen), "df": list(seen.values())}
                    seen = Counter()
        yield {"term": list(seen), "df": list(seen.values())}

    held = arrow_map(index.select("text"), "term binary, df long", run).groupBy("term").agg(F.sum("df").alias("df"))
    return wanted.join(held, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            yield batch.slice(at, _BLOCK)


def _likeliest(index: DataFrame, items: Items, corpus: Corpus, coordinates: int, k: int) -> DataFrame:
    """(item, row): per item the k rows of the greatest bounds above 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(items.rows)
        for b in _blocks(batches):
            bound = items.bounds(corpus, coordinates, b.column("n").to_pylist(), b.column("at"), b.column("most"))
            rows = b.column("row").to_numpy()
            for i, (top, held) in enumerate(best):
                top, held = np.append(top, bound[:, i]), np.append(held, rows)
                order = np.argsort(-top, kind="stable")[:k]
                best[i] = top[order], held[order]
        for i, (top, held) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i, np.int32)), pa.array(held), pa.array(top)],
                                             names=["item", "row", "bound"])

    found = index.select("row", "n", "at", "most").mapInArrow(run, "item int, row long, bound double")
    return top_rows(found, ["item"], [F.desc("bound"), F.col("row")], k).select("item", "row")


def _first_scores(index: DataFrame, pairs: DataFrame, items: Items, corpus: Corpus) -> DataFrame:
    """(item, score) of given item-row pairs."""
    def run(batches):
        for b in batches:
            out = {"item": [], "score": []}
            for text, n, asked in zip(b["text"], b["n"], b["items"]):
                tf, m = counts(text), corpus.damping(n)
                for i in asked:
                    out["item"].append(i)
                    out["score"].append(items.score(i, tf, m))
            yield out

    few = pairs.groupBy("row").agg(F.collect_set("item").alias("items"))
    # At most k rows an item, so the texts need not move.
    return arrow_map(index.select("row", "text", "n").join(F.broadcast(few), "row").drop("row"), "item int, score long", run)


def _rescored(index: DataFrame, items: Items, corpus: Corpus, coordinates: int, k: int, floor: list[int]) -> DataFrame:
    """(item, row, doc_id, score): all pairs that may be among an item's k best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[int]] = [[] for _ in items.rows]
        for b in _blocks(batches):
            n = b.column("n").to_pylist()
            bound = items.bounds(corpus, coordinates, n, b.column("at"), b.column("most"))
            known: dict[int, tuple[Counter, int]] = {}
            item, place, score = [], [], []
            for i in range(len(items.rows)):
                kth = max(floor[i], best[i][-1] if len(best[i]) == k else 1)
                at = np.flatnonzero(bound[:, i] >= kth)
                for p in at[np.argsort(-bound[at, i], kind="stable")].tolist():
                    if bound[p, i] < kth:
                        break
                    if p not in known:
                        known[p] = counts(b.column("text")[p].as_py()), corpus.damping(n[p])
                    s = items.score(i, *known[p])
                    if s >= kth:
                        item.append(i)
                        place.append(p)
                        score.append(s)
                        best[i] = sorted([*best[i], s], reverse=True)[:k]
                        kth = max(kth, best[i][-1] if len(best[i]) == k else 1)
            take = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), b.column("row").take(take),
                                              b.column("doc_id").take(take), pa.array(score, pa.int64())],
                                             names=["item", "row", "doc_id", "score"])

    return index.select("row", "doc_id", "text", "n", "at", "most").mapInArrow(run, "item int, row long, doc_id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int = K, coordinates: int = COORDINATES, items: int = ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score for queries(item_id, text): each row's k best
    documents of a built index with a score above 0 (all, if fewer), equal scores by
    ascending doc_id, null ids last.

    Every row of queries and of the index counts for itself, repeated ones too; null and
    empty texts on either side give no rows, nor do empty tables; very long ones are taken
    whole; other columns are ignored.  Items are served `items` at a time, each time by two
    passes over the index; nothing but such a share of the items is sent to the tasks.
    """
    spark = index.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    n, length = index.agg(F.count("*"), F.sum("n")).first()
    asked = settle(queries.select(F.monotonically_increasing_id().alias("q"), F.col("item_id").cast("long").alias("item_id"), "text")
                   .filter("text is not null"), "items")
    m = asked.count()
    out = spark.createDataFrame([], schema)
    if not n or not m:
        return out

    def split(batches):
        for b in batches:
            yield {"term": [t for text in b["text"] for t in counts(text)]}

    corpus = Corpus(n, length)
    wanted = arrow_map(asked.select("text"), "term binary", split).distinct()
    df = settle(frequencies(index, wanted), "term-frequencies")
    parts = -(-m // items)
    numbered = asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)))
    for part in range(parts):
        own = numbered.filter(F.col("part") == part)
        rows = [(r["q"], r["item_id"], r["text"]) for r in own.collect()]
        mine = arrow_map(own.select("text"), "term binary", split).distinct()
        weight = {bytes(r["term"]): corpus.weight(r["df"]) for r in df.join(mine, "term", "left_semi").collect()}
        now = Items.of(rows, weight, coordinates)
        likely = _likeliest(index, now, corpus, coordinates, k)
        first = top_rows(_first_scores(index, likely, now, corpus), ["item"], [F.desc("score")], k)
        held = {r["item"]: (r["n"], r["least"]) for r in first.groupBy("item").agg(
            F.count("*").alias("n"), F.min("score").alias("least")).collect()}
        floor = [max(1, least) if full == k else 1 for full, least in (held.get(i, (0, 0)) for i in range(len(rows)))]
        found = top_rows(_rescored(index, now, corpus, coordinates, k, floor), ["item"],
                         [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row")], k)
        names = spark.createDataFrame(list(enumerate(now.ids)), "item int, item_id long")
        out = out.unionByName(settle(found.join(F.broadcast(names), "item").select(
            "item_id", F.col("_rn").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
    return out


def rank(docs: DataFrame, queries: DataFrame, k: int = K, coordinates: int = COORDINATES) -> DataFrame:
    """Build the index of docs(doc_id, text) and search it: see `search`."""
    return search(build(docs, coordinates), queries, k, coordinates)
