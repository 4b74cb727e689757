"""The catalogue as a table of versions that is changed bucket by bucket.

    root/data/3-<id>/bucket=7/...   rows of bucket 7 as version 3 wrote them
    root/versions/v=3/...           for every bucket the write that holds its rows

A sync reads and rewrites only the buckets that hold a changed or new key; a version's other
buckets are those of the version before.  A version exists once its list of buckets is
there.  That list is one file, which appears whole or not at all, and is written last, so a
write that is cut short leaves the version before as it was; its own files are named by no
list.  Of two writers of one version the second finds the list there and fails.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from bookloom.functions import text
from bookloom.operators import catalogue
from bookloom.operators.common import settle

LIST = "bucket int, written_in string, n long"


class Store:
    """Versions of a catalogue under a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, buckets: int = 64) -> None:
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _lists(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{LIST}, v long").parquet(f"{self.root}/versions")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], f"{LIST}, v long")

    def versions(self) -> list[int]:
        return sorted(r["v"] for r in self._lists().select("v").distinct().collect())

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def _buckets(self, version: int) -> dict[int, tuple[str, int]]:
        """bucket -> (write that holds it, rows): at most `buckets` entries."""
        rows = self._lists().filter(F.col("v") == version).collect()
        return {r["bucket"]: (r["written_in"], r["n"]) for r in rows}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version (the latest, if none is named), or of some of its buckets."""
        held = self._buckets(version or self.latest())
        if not held:
            raise LookupError(f"no version {version or 'at all'}")
        paths = [f"{self.root}/data/{wrote}/bucket={b}" for b, (wrote, n) in sorted(held.items())
                 if n and (only is None or b in only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _publish(self, rows: DataFrame, touched: set[int] | None, before: dict[int, tuple[str, int]], version: int) -> int:
        """Write the touched buckets (None: all) and then the new version's list."""
        name = f"{version}-{uuid.uuid4().hex}"
        rows = rows.select(*self.schema.names).withColumn("bucket", self.bucket(F.col("item_key")))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")
        whole = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        written = self.spark.read.schema(whole).parquet(f"{self.root}/data/{name}")
        new = {r["bucket"]: r["n"] for r in written.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        now = {b: (name, new.get(b, 0)) if touched is None or b in touched else before.get(b, (name, 0)) for b in range(self.buckets)}
        if before and sum(n for _, n in before.values()) and not sum(n for _, n in now.values()):
            raise ValueError("refused: an empty catalogue would replace a filled one")
        listed = self.spark.createDataFrame([(b, wrote, n) for b, (wrote, n) in now.items()], LIST)
        listed.coalesce(1).write.parquet(f"{self.root}/versions/v={version}")
        return version

    def replace(self, items: DataFrame) -> int:
        """All rows anew.  An empty table may only be the first version."""
        last = self.latest()
        return self._publish(settle(items.select(*self.schema.names), "new-catalogue"), None, self._buckets(last), last + 1)

    def sync(self, library: DataFrame, order: str) -> int:
        """The catalogue after a library CSV, see catalogue.sync; the number of the version
        that holds it, which is the latest one if the CSV changes nothing."""
        last = self.latest()
        keyed = library.withColumn("_b", self.bucket(text.item_key("title", "authors")))
        asked = {r["_b"] for r in keyed.select("_b").distinct().collect()}
        old = self.read(last, asked)
        after = settle(catalogue.sync(library, old, order), "synced")
        changes = after.filter(F.col("is_new") | (F.size("changed") > 0))
        touched = {r["b"] for r in changes.select(self.bucket(F.col("item_key")).alias("b")).distinct().collect()}
        if not touched:
            return last
        owned = [c for c in after.columns if c in self.schema.names and c != "item_key"]
        kept = old.select("item_key", *[c for c in self.schema.names if c not in owned and c != "item_key"])
        mine = after.filter(self.bucket(F.col("item_key")).isin(*touched)).select("item_key", *owned)
        return self._publish(mine.join(kept, "item_key", "left"), touched, self._buckets(last), last + 1)
