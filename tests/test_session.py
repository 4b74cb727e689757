"""What a session needs beyond the defaults to hold at size."""

import collections
import os
import random
import time

from pyspark.sql import functions as F

from bookloom.operators import identity
from bookloom.operators.common import settle
from bookloom.plans import decide
from bookloom.shipping import steady
from testbed.views import Roles


def _shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_a_written_frame_leaves_no_shuffle_behind(spark):
    had = _shuffles(spark)
    out = settle(spark.range(5000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n")), "counts")
    until = time.time() + 20
    while _shuffles(spark) - had and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not _shuffles(spark) - had
    assert out.agg(F.sum("n")).first()[0] == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_packed_files_are_not_taken_for_small(spark, tmp_path):
    """The file is under the threshold, its rows are far over it: no broadcast."""
    path = f"{tmp_path}/names.parquet"
    spark.range(100_000).select("id", F.repeat(F.lit("long name "), 20).alias("name")).coalesce(1).write.parquet(path)
    size = sum(os.path.getsize(f"{path}/{n}") for n in os.listdir(path))
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", 3 * size)

    def plan():
        names = own.read.parquet(path)
        return names.join(names.withColumnRenamed("name", "other"), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan()
    steady(own)
    assert "BroadcastHashJoin" not in plan()
    assert own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == str(3 * size // 16)
    own.conf.set("spark.sql.sources.fileCompressionFactor", 2)
    steady(own)
    assert float(own.conf.get("spark.sql.sources.fileCompressionFactor")) == 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_joined_after_their_spellings_are_resolved(spark):
    """What finds the items is written and let go before the rows themselves are shuffled."""
    items = spark.createDataFrame([("k1", "Tin Harbour", "Wen Haoran", 5), ("k2", "Far Kilns", "Ivo Lund", 7)],
                                  "item_key string, title string, author string, reviews long")
    log = spark.createDataFrame([(1, "The Tin Harbour", "Haoran Wen"), (2, "Far Kilns", "Ivo Lund"), (3, None, "Ivo Lund"), (2, "Far Kilns", "Ivo Lund")],
                                "log_id long, title string, author string")
    out = identity.resolve(log, items)
    assert _plan(out).count("Join ") == 1 and "Aggregate" not in _plan(out)
    assert sorted((r.log_id, r.item_key or "") for r in out.collect()) == [(1, "k1"), (2, "k2"), (2, "k2"), (3, "")]


def test_link_pairs_are_stored_before_their_names_are_joined(spark, sf_dir):
    plan = _plan(Roles(spark, sf_dir).sql("SELECT * FROM raw_links", "raw_links"))
    assert "lead(" not in plan and "first_order" in plan


def test_older_picker_reads_its_inputs_once(spark, monkeypatch):
    """Favourites and rejections are worked out once, and a linked key is normalised once;
    links repeat, and null keys and empty titles match as they did."""
    items = spark.createDataFrame([(f"T{i} - A{i % 3}", f"T{i}", f"A{i % 3}", 4.0 + i / 100, None, None, None, 10) for i in range(12)],
                                  "item_key string, title string, author string, rating double, indie boolean, classic boolean, "
                                  "secondary_genre string, reviews long").withColumn("primary_genre", F.lit("g"))
    links = spark.createDataFrame([(f"T{i} - A{i % 3}", f"T{j} - A{j % 3}") for i in range(12) for j in (0, 0, 1, i)]
                                  + [("T1 - A1", None), ("T1 - A1", None)], "src_key string, dst_key string")
    pools = spark.createDataFrame([(1, "favourite_title", "t0", "a0"), (1, "favourite_author", "", "a1"), (2, "favourite_title", "t1", "a1"),
                                   (2, "favourite_title", "t1", "a1"), (3, "favourite_title", "", ""), (None, "favourite_title", "t0", "a0")],
                                  "reader_id long, pool string, title_norm string, author_norm string").filter("concat(pool, 'pools') <> 'x'")
    rejections = spark.createDataFrame([(1, "t3", "a0", 2, 1.5)], "reader_id long, title_norm string, author_norm string, n long, penalty double")
    barred = spark.createDataFrame([(1, "t2", "a2")], "reader_id long, title_norm string, author_norm string")
    plans, real = [], decide.settle
    monkeypatch.setattr(decide, "settle", lambda df, label: plans.append(_plan(df)) or real(df, label))
    readers = spark.createDataFrame([(1,), (2,), (3,)], "reader_id long")
    got = decide.older_candidates(readers, items, links, pools, rejections, barred, {}, need=12).collect()
    assert sum("concat(pool" in p for p in plans) == 1
    bonus = {(r.reader_id, r.item_key): round(r.link_bonus, 1) for r in got}
    assert all(bonus[1, f"T{i} - A{i % 3}"] == 0.6 for i in range(12) if i != 2)
    assert all(bonus[2, f"T{i} - A{i % 3}"] == 1.2 for i in range(12))
    assert {k for (r, k), b in bonus.items() if r == 3 and b} == {"T1 - A1"}
    assert (1, "T2 - A2") not in bonus


def test_batches_are_picked_without_a_group_per_reader_in_python(spark):
    """Against the same steps one by one; ties, repeated rows, null keys and short lists."""
    rnd = random.Random(4)
    items = [(f"k{i:02d}", rnd.random() < 0.2, rnd.random() < 0.3 or None) for i in range(30)] + [(None, True, False)]
    flags = {k: (a, bool(b)) for k, a, b in items}
    rows = [(r, k, rnd.randrange(4) / 2, rnd.random() < 0.15) for r in [*range(40), None]
            for k in rnd.sample([k for k, *_ in items if k], rnd.randrange(1, 20))]
    scored = spark.createDataFrame(rows + rows[::7], "reader_id long, item_key string, score double, deep_cut boolean")
    frame = spark.createDataFrame(items, "item_key string, indie boolean, classic boolean")
    out = decide.batch(scored, frame, {"indie": 2, "classic": 1}, size=4, seed=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r.reader_id].add(r.item_key)
    for reader_id in [*range(40), None]:
        mine = sorted({x[1:] for x in rows if x[0] == reader_id}, key=lambda x: (-x[1], x[0]))
        taken = []
        for at, least in ((0, 2), (1, 1)):
            taken += [x for x in mine if flags[x[0]][at] and x not in taken][:max(least - sum(flags[x[0]][at] for x in taken), 0)]
        taken += [x for x in mine if x[2] and x not in taken][:0 if any(x[2] for x in taken) else 1]
        taken += [x for x in mine if x not in taken][:max(4 - len(taken), 0)]
        assert got[reader_id] == {x[0] for x in taken}


def test_pieces_of_needles_are_not_broadcast(spark, monkeypatch):
    """Pieces are many times the needles that Spark judges their size by."""
    joined, real = [], identity.best
    monkeypatch.setattr(identity, "best", lambda df, *rest: joined.append(df) or real(df, *rest))
    needles = settle(spark.createDataFrame([("harbour",), ("ab",), ("z",), (None,)], "needle string"), "needles")
    texts = settle(spark.createDataFrame([("tin harbour",), ("cab",), ("none",), (None,)], "text string"), "texts")
    got = {(r.needle, r.text) for r in identity.containing(needles, texts).collect()}
    assert got == {("harbour", "tin harbour"), ("ab", "cab")}
    assert "SortMergeJoin [gram" in joined[0]._jdf.queryExecution().sparkPlan().toString()
