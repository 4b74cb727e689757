"""Embedding whitening from exact cross-products, counted bit by bit.

Every component c becomes the integer floor(64 c) plus an offset.  A task takes its rows in
blocks: within a block each dimension is shifted to start at 0 and its bits are laid out as
planes, one bit a row, packed into 64-bit words.  The sum of products of two dimensions is
then the sum over their pairs of planes of 2^(p + q) times the ones in the AND of both
planes.  Shifts are undone in integers, tasks' sums are added by Spark as decimals, and the
scatter n * sum(x y) - sum(x) sum(y) is centred exactly before anything becomes a float.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.topk import usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Scaled components are held within this size, where 64-bit integers end.
LIMIT = 1 << 61
_BLOCK = 8192
_WIDEST = (1 << 63) - 1


def _scaled(column: pa.Array, dims: int) -> np.ndarray:
    """floor(64 c) as (rows, dims) integers; shorter vectors are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    flat = flat[column.offsets[0].as_py():column.offsets[-1].as_py()]
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of non-negative columns, packed over the rows: (words, dimension, bit)."""
    rows, dims = y.shape
    words, dim, bit = [], [], []
    for d in range(dims):
        for b in range(int(y[:, d].max(initial=0)).bit_length()):
            packed = np.zeros(-(-rows // 64) * 8, np.uint8)
            ones = np.packbits((y[:, d] >> b & 1).astype(np.uint8))
            packed[:len(ones)] = ones
            words.append(packed.view(np.uint64))
            dim.append(d)
            bit.append(b)
    shape = (len(words), -(-rows // 64))
    return np.array(words, np.uint64).reshape(shape), np.array(dim, np.int64), np.array(bit, np.int64)


def products(z: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact column sums and the matrix of exact sums of products (Python integers)."""
    rows, dims = z.shape
    low = [int(v) for v in z.min(0)]
    y = (z - z.min(0)).astype(np.int64)
    words, dim, bit = planes(y)
    cross = np.zeros((dims, dims), object)
    sums = [0] * dims
    narrow = bit.max(initial=0) + rows.bit_length() < 60
    starts = np.flatnonzero(np.diff(dim, prepend=-1))
    for a in range(len(words)):
        d, b = int(dim[a]), int(bit[a])
        ones = np.bitwise_count(words[a:] & words[a]).sum(1, dtype=np.int64)
        weighted = ones << bit[a:] if narrow else ones.astype(object) << bit[a:].astype(object)
        sums[d] += int(ones[0]) << b
        later = np.concatenate([[0], starts[starts > a] - a])
        part = np.add.reduceat(weighted, later).astype(object)
        # Within one dimension each two different planes meet twice.
        part[0] = 2 * part[0] - weighted[0]
        cross[d, dim[a + later]] += part << b
    for i in range(dims):
        for j in range(i, dims):
            cross[i, j] += low[i] * sums[j] + low[j] * sums[i] + rows * low[i] * low[j]
            cross[j, i] = cross[i, j]
    return [s + rows * v for s, v in zip(sums, low)], cross


def _pairs(dims: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(dims) for j in range(i, dims)]


def scatter(rows: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the sums of products of the scaled components of rows(v): per task
    one number per pair of dimensions, added by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, [0] * dims, np.zeros((dims, dims), object)
        for batch in batches:
            z = _scaled(batch.column("v"), dims)
            for at in range(0, len(z), _BLOCK):
                s, c = products(z[at:at + _BLOCK])
                n, sums, cross = n + len(z[at:at + _BLOCK]), [a + b for a, b in zip(sums, s)], cross + c
        values = [n, *sums, *(int(cross[i, j]) for i, j in _pairs(dims))]
        # Two halves, so that no sum leaves a decimal of 38 places.
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(values)), pa.int32()),
                                          "high": pa.array([Decimal(v >> 62) for v in values], pa.decimal128(38)),
                                          "low": pa.array([v & (1 << 62) - 1 for v in values], pa.int64())})

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    got = rows.mapInArrow(run, "place int, high decimal(38,0), low long").groupBy("place").agg(*wide).collect()
    value = {r["place"]: (int(r["high"]) << 62) + int(r["low"]) for r in got}
    cross = np.zeros((dims, dims), object)
    for at, (i, j) in enumerate(_pairs(dims), 1 + dims):
        cross[i, j] = cross[j, i] = value[at]
    return value[0], [value[1 + d] for d in range(dims)], cross


def basis(n: int, sums: list[int], cross: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dims x k eigenvectors, their eigenvalues, shares of the trace), greatest first.
    The covariance is centred in integers and divided once."""
    dims = len(sums)
    exact = [[n * cross[i, j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    cov = np.array([[v / (n * n) for v in row] for row in exact], np.float64)
    trace = sum(exact[i][i] for i in range(dims)) / (n * n)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value, kind="stable")[:components]
    value = value[order]
    # What rounding leaves of a zero is no direction of spread.
    value = np.where(value > dims * np.finfo(float).eps * max(float(value[0]), 0.0), value, 0.0)
    return vector[:, order], value, value / trace if trace else np.zeros(len(value))


def _deviation(z: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the exact sum of (n z - S)^2; None where 64 bits don't hold it."""
    far = max((abs(n * int(v) - s) for col, s in zip(z.T, sums) for v in (col.min(), col.max())), default=0)
    if far * far * z.shape[1] <= _WIDEST and n * max(int(np.abs(z).max(initial=0)), 1) <= _WIDEST:
        off = n * z - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    out = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in z]
    return [v if v <= _WIDEST else None for v in out]


def whiten(vectors: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained, identity_error for each
    usable row and each of the first `components` principal directions (all, if the vectors
    have fewer dimensions).

    Rows whose vector is null or holds a null, NaN or infinite component are dropped.
    Repeated rows count and are returned as often as they stand there; a shorter vector is
    filled up with zeros; other columns are ignored; without usable rows, or with empty
    vectors only, the result is empty.  A direction without spread has whitened 0, and
    identity_error, measured over the whitened rows, is then 1.  A component whose scaled
    value leaves 62 bits is held there; a deviation beyond 64 bits is null.  What meets in one place is one
    number per pair of dimensions.
    """
    rows = vectors.filter(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, cross = scatter(rows, dims)
    vector, value, share = basis(n, sums, cross, components)
    k = len(value)
    mean = np.array([s / n for s in sums])
    to = vector * np.where(value > 0, 1 / np.sqrt(np.where(value > 0, value, 1)), 0)

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        z = _scaled(batch.column("v"), dims)
        return z, (z - mean) @ to

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = centred(batch)[1]
            total, second = total + w.sum(0), second + w.T @ w
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(k + k * k), pa.int32()),
                                          "value": pa.array(np.concatenate([total, second.ravel()]))})

    got = rows.mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(k + k * k)
    for r in got:
        flat[r["place"]] = r["value"] / n
    error = float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                z, w = centred(part)
                m = len(z)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(_deviation(z, n, sums), pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
