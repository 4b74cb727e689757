"""Small building blocks shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """Shared folder for written intermediates: the session's checkpoint folder.
    A temporary one is made only for a local session that names none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="bookloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/") + "/bookloom"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, path: str) -> None:
    """Write a frame in the shared folder, and let go of the rows shuffled for it: nothing
    reads them once the files are there, and else they fill the disk until the driver
    happens to collect its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that several branches read, and continue from the files: the
    lineage ends here, and a lost executor costs a re-read instead of a re-run."""
    path = fresh_path(df.sparkSession, label)
    keep(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key.  Spark cuts each map task to k rows per key before
    the shuffle, so a hot key never reaches one task whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)


def best(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """First row per key as an aggregate, so it is combined before the shuffle.
    The order must be total."""
    first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                           F.struct(*values).alias("_v")))
    return df.groupBy(*keys).agg(first.alias("_b")).select(
        *keys, *[F.col(f"_b._v.{v}").alias(v) for v in values])


def numbered(df: DataFrame, order: list[str], name: str = "n", flag: str | None = None) -> DataFrame:
    """0-based row numbers over the whole frame without one global sort task:
    range-sort, number inside each partition, add the partition's offset.  With a
    flag, `passed` counts the flagged rows up to and including each row."""
    local = settle(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()),
                   "numbered").withColumn("_p", F.shiftright("_m", 33))
    marked = F.count_if(flag) if flag else F.lit(0)
    sizes = local.groupBy("_p").agg(F.count("*").alias("_c"), marked.alias("_f"))
    # One row per partition: this window runs over a table of that size only.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"),
                          F.coalesce(F.sum("_f").over(before), F.lit(0)).alias("_t"))
    out = local.join(F.broadcast(starts), "_p").withColumn(
        name, F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    if flag:
        # Each range partition is an even share of the rows, whatever the keys.
        inside = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("passed", F.col("_t") + F.count_if(flag).over(inside))
    return out.drop("_p", "_s", "_t", "_m")


def positive_tags(tags: DataFrame) -> DataFrame:
    """(item_key, kind, tag): positive signals and themes, the matchable tags."""
    keep = (F.col("kind") == "theme") | ((F.col("kind") == "signal")
                                         & (F.col("polarity") == "positive"))
    return tags.filter(keep).select("item_key", "kind", "tag").distinct()


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
