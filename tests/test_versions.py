"""The stored catalogue, and tables bucketed by item."""

import pytest
from pyspark.sql import functions as F

from bookloom.operators import reader
from bookloom.operators.common import fresh_path
from bookloom.sources import tables, versions

SCHEMA = ("item_key string, title string, author string, status string, pages long, reviews long, rating double, pub_year long, "
          "series string, series_position string, series_status string, mood string")


def rows(n):
    return [(f"T{i} - A", f"T{i}", "A", "complete", 100 + i, 5, 4.0, 2000, None, None, None, f"m{i}") for i in range(n)]


@pytest.fixture
def store(spark):
    frame = spark.createDataFrame(rows(200), SCHEMA)
    out = versions.Store(spark, fresh_path(spark, "store"), frame.schema, 16)
    assert out.versions() == [] and out.replace(frame) == 1
    return out


def content(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_replace_and_read_old_versions(spark, store):
    before = content(store.read())
    assert before == sorted(rows(200), key=repr)
    other = spark.createDataFrame(rows(50), SCHEMA)
    assert store.replace(other) == 2 and store.versions() == [1, 2]
    assert content(store.read(1)) == before and content(store.read()) == sorted(rows(50), key=repr)


def test_an_empty_table_replaces_nothing(spark, store):
    with pytest.raises(ValueError, match="empty"):
        store.replace(spark.createDataFrame([], SCHEMA))
    assert store.versions() == [1] and store.read().count() == 200
    fresh = versions.Store(spark, fresh_path(spark, "store"), store.schema)
    with pytest.raises(LookupError):
        fresh.read()
    assert fresh.replace(spark.createDataFrame([], SCHEMA)) == 1 and fresh.read().isEmpty()


def test_a_write_cut_short_leaves_the_old_version(spark, store, monkeypatch):
    before = content(store.read())
    monkeypatch.setattr(spark.__class__, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.replace(store.read().limit(5))
    monkeypatch.undo()
    assert store.versions() == [1] and content(store.read()) == before
    assert store.replace(spark.createDataFrame(rows(7), SCHEMA)) == 2 and store.read().count() == 7


def test_sync_rewrites_touched_buckets_only(spark, store, monkeypatch):
    from bookloom.operators import catalogue

    def synced(csv, items, order):
        keyed = csv.select(F.concat_ws(" - ", "title", "authors").alias("item_key"), F.col("pages").cast("long").alias("p"))
        both = items.join(keyed, "item_key", "full")
        new = F.col("status").isNull()
        return both.select("item_key", new.alias("is_new"), "title", "author", F.coalesce("status", F.lit("pending")).alias("status"),
                           F.coalesce("p", "pages").alias("pages"), *[c for c in catalogue.PINNED if c != "pages"],
                           F.when(F.col("p") != F.col("pages"), F.array(F.lit("pages"))).otherwise(F.array().cast("array<string>")).alias("changed"))
    monkeypatch.setattr(catalogue, "sync", synced)
    frame = spark.createDataFrame([("T3", "A", "999", 0), ("T7", "A", "107", 1), ("New", "A", "10", 2)],
                                  "title string, authors string, pages string, pk long")
    assert store.sync(frame, "pk") == 2
    got = {r["item_key"]: (r["pages"], r["status"], r["mood"]) for r in store.read().collect()}
    want = {r[0]: (r[4], r[3], r[11]) for r in rows(200)} | {"T3 - A": (999, "complete", "m3"), "New - A": (10, "pending", None)}
    assert got == want and store.read(1).count() == 200
    wrote = [name for name, _ in store._buckets(2).values() if name.startswith("2-")]
    assert 1 <= len(wrote) <= 2
    assert store.sync(frame, "pk") == 2 and store.versions() == [1, 2]


def test_bucketed_tags_are_joined_without_an_exchange(spark):
    tags = spark.createDataFrame([(f"k{i % 300}", "signal", "positive", f"t{i % 17}") for i in range(3000)],
                                 "item_key string, kind string, polarity string, tag string")
    stored = tables.bucketed(tags, "tags", buckets=8)
    pairs = spark.createDataFrame([(r, f"k{(r * 7) % 300}") for r in range(500)], "reader_id long, item_key string")
    members = spark.createDataFrame([(r, f"v{r % 3}", r % 3, "signal", f"t{r % 17}") for r in range(500)],
                                    "reader_id long, vector string, ord int, kind string, tag string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def plan(t):
            return reader.vector_overlap(pairs, t, members)._jdf.queryExecution().executedPlan().toString()
        # Without buckets the tags are exchanged for their distinct rows and for the join.
        assert plan(stored).count("Exchange hashpartitioning(item_key") == 1
        assert plan(tags).count("Exchange hashpartitioning(item_key") > 1
        assert content(reader.vector_overlap(pairs, stored, members)) == content(reader.vector_overlap(pairs, tags, members))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
