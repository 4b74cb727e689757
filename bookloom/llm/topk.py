"""Exact inner-product search with an impact-ordered index, a score at a time.

Candidates are dealt into blocks.  Within a block, a posting is one component of one
vector; its impact is the component's size, quantised to halvings of the block's largest.
The index keeps each block's postings in segments of equal impact, the greatest first, and
within a segment by dimension.  A search adds up segment after segment.  After each, a
candidate's score is known up to the length of what is left of its vector times the
query's, so a query is done as soon as the rest of the block is proven to be below its
k-th best; what may still belong is scored exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.operators.common import settle

K = 5
SCALE = 256
#: Up to this size of both sides 512 products add up in 64 bits; beyond it scores are
#: computed with Python's integers.
NARROW = 1 << 26
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
SEGMENTS = 6
#: Queries whose scores are summed up together.
TILE = 64
#: A query leaves the index early once so few candidates remain unproven.
FEW = 64
_LONG = 1 << 63
#: Larger components than doubles can scale are held at the largest such value.
_HUGE = 1e300


def scaled(vector: Column) -> Column:
    """floor(256 x) of each component.  As doubles, which hold every such value exactly."""
    edge = F.lit(_HUGE)
    held = F.transform(vector, lambda x: F.greatest(-edge, F.least(edge, x.cast("double"))) * SCALE)
    # Beyond 2^52 a double has no fraction; rounding down by way of a long would cut it.
    return F.transform(held, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                                         & (F.abs(x.cast("double")) < float("inf")))


def _matrix(rows, dims: int) -> np.ndarray:
    """Shorter vectors are filled up with zeros."""
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def postings(block: np.ndarray) -> dict[str, np.ndarray]:
    """The non-zero components of a block's rows, greatest impact first: per run of one
    segment and dimension its ends, and per posting its row and value."""
    row, dim = np.nonzero(block)
    value = block[row, dim]
    size = np.abs(value)
    impact = np.minimum(np.log2(size.max(initial=1.0)) - np.log2(size), SEGMENTS - 1).astype(np.int64)
    order = np.lexsort((row, dim, impact))
    row, dim, value, impact = row[order], dim[order], value[order], impact[order]
    first = np.flatnonzero((np.diff(impact, prepend=-1) != 0) | (np.diff(dim, prepend=-1) != 0))
    return {"segment": impact[first], "dim": dim[first], "ends": np.append(first[1:], len(row)), "row_at": row, "value": value}


def exact(query: np.ndarray, rows: np.ndarray) -> list[int]:
    """Integer inner products of a query with rows of whole numbers."""
    if max(np.abs(query).max(initial=0), np.abs(rows).max(initial=0)) <= NARROW:
        return (rows.astype(np.int64) @ query.astype(np.int64)).tolist()
    q = [int(x) for x in query]
    return [sum(a * int(b) for a, b in zip(q, r)) for r in rows]


def search(queries: np.ndarray, own: np.ndarray, index: dict[str, np.ndarray], rows: np.ndarray, ids: np.ndarray,
           k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(query, places in block, scores): each query's k best of the block by score, then id.
    own: the queries' row numbers; a query is no candidate for itself."""
    n, dims = len(rows), queries.shape[1]
    segment, dim, ends, at, value = (index[c] for c in ("segment", "dim", "ends", "row_at", "value"))
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    block = np.zeros((n, dims))
    block[at, np.repeat(dim, ends - starts)] = value
    length = np.sqrt((queries ** 2).sum(1))
    whole = np.sqrt((block ** 2).sum(1))
    # What is left of each vector after a segment, with room for the rounding of the sums.
    left, rest = (block ** 2).sum(1), np.zeros((SEGMENTS, n))
    for s in range(SEGMENTS - 1):
        for g in np.flatnonzero(segment == s):
            left[at[starts[g]:ends[g]]] -= value[starts[g]:ends[g]] ** 2
        rest[s] = np.sqrt(np.maximum(left, 0) + 1e-9 * whole ** 2)
    place = {int(r): p for p, r in enumerate(rows)}
    mine = np.array([place.get(int(r), -1) for r in own])
    for tile in range(0, len(queries), TILE):
        active = np.arange(tile, min(tile + TILE, len(queries)))
        acc = np.zeros((n, len(active)))
        for s in range(SEGMENTS):
            for g in np.flatnonzero(segment == s):
                acc[at[starts[g]:ends[g]]] += value[starts[g]:ends[g], None] * queries[active, dim[g]]
            slack = np.outer(length[active], rest[s] + 1e-9 * whole) + 1e-9
            low, high = acc.T - slack, acc.T + slack
            for j in np.flatnonzero(mine[active] >= 0):
                low[j, mine[active[j]]] = high[j, mine[active[j]]] = -np.inf
            kth = np.partition(low, max(0, n - k), axis=1)[:, max(0, n - k)]
            may = ~(high < kth[:, None])
            done = (may.sum(1) <= FEW) | (s + 1 == SEGMENTS)
            for j in np.flatnonzero(done):
                q = active[j]
                those = np.flatnonzero(may[j])
                those = those[those != mine[q]]
                score = exact(queries[q], block[those])
                best = sorted(range(len(those)), key=lambda i: (-score[i], ids[those[i]]))[:k]
                yield int(q), those[best], [score[i] for i in best]
            active, acc = active[~done], acc[:, ~done]
            if not len(active):
                break


def build(rows: DataFrame, blocks: int) -> DataFrame:
    """The index of rows(id, row, v), a block a row, written."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                dims = max(map(len, r.v))
                found = postings(_matrix(r.v, dims))
                yield pd.DataFrame([{"block": r.block, "id": r.id, "row": r.row, "dims": dims, **found}])

    held = rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("id", "row", "v")).alias("c")).select("block", "c.id", "c.row", "c.v")
    return settle(held.repartition(blocks, "block").mapInPandas(
        run, "block long, id array<long>, row array<long>, dims int, segment array<int>, dim array<int>, ends array<int>, "
             "row_at array<int>, value array<double>"), "impact-index")


def top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = K,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows by inner
    product of the scaled vectors, ties to the smaller id (all, if there are fewer).

    Unusable vectors take no part; rows equal in all columns are rows of their own; a vector
    without components scores 0; an empty table, or no query, gives no rows.  Every query
    block meets every candidate block, whole.  Scores are compared exactly; one that leaves
    64 bits is returned as the nearest number that they hold.
    """
    rows = settle(vectors.filter(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v"), is_query.alias("q"))
        .withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, m = rows.agg(F.count("*"), F.count_if("q")).first()
    if not m:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, parts = -(-n // block_rows), -(-m // query_rows)
    asked = rows.filter("q").groupBy(F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")).agg(
        F.collect_list(F.struct("id", "row", "v")).alias("a")).select(
            "part", *[F.col(f"a.{name}").alias(f"q_{name}") for name in ("id", "row", "v")])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    pairs = build(rows, blocks).withColumn("part", each).join(asked, "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                dims = max(r.dims, max(map(len, r.q_v)))
                ids = np.array([np.iinfo(np.int64).max if x is None or x != x else x for x in r.id], np.int64)
                index = {c: np.array(getattr(r, c)) for c in ("segment", "dim", "ends", "row_at", "value")}
                found = [(r.q_id[q], r.q_row[q], ids[p], *_ordered(score)) for q, at, scores in search(
                    _matrix(r.q_v, dims), np.array(r.q_row, np.int64), index, np.array(r.row, np.int64), ids, k)
                    for p, score in zip(at, scores)]
                yield pd.DataFrame(found, columns=["query_id", "q_row", "vec_id", "beyond", "digits", "score"])

    found = pairs.repartition(blocks * parts, F.monotonically_increasing_id()).mapInPandas(
        run, "query_id long, q_row long, vec_id long, beyond int, digits binary, score long")
    order = Window.partitionBy("q_row").orderBy(F.desc("beyond"), F.desc("digits"), F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ordered(score: int) -> tuple[int, bytes, int]:
    """Columns that order like the score: whether it leaves 64 bits and to which side, then
    its bytes if so, and the nearest long."""
    if -_LONG <= score < _LONG:
        return 0, b"", score
    wide = (score + (1 << 2200)).to_bytes(276, "big")
    return (1, wide, _LONG - 1) if score > 0 else (-1, wide, -_LONG)
