"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

WHITESPACE = " \t\n\x0b\x0c\r"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, wherever body uses it.  Being
    one expression, it is only evaluated in the CASE branch that needs it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def arrow_map(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """mapInArrow where `rows` gets an iterator of {column: list} batches and yields
    {column: list or array} batches of the schema."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows({n: b.column(n).to_pylist() for n in b.schema.names} for b in batches):
            columns = [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, kind)


def text_groups(batch: dict[str, list], chars: int = 1 << 22) -> Iterator[dict[str, list]]:
    """A batch's rows in order, texts of `chars` characters together or a longer one alone."""
    start, size = 0, 0
    for at, text in enumerate(batch["text"]):
        if at > start and size + len(text or "") > chars:
            yield {k: v[start:at] for k, v in batch.items()}
            start, size = at, 0
        size += len(text or "")
    if start < len(batch["text"]):
        yield {k: v[start:] for k, v in batch.items()}
