"""Similarity joins and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.operators import fuzzy
from bookloom.operators.common import fresh_path
from bookloom.streaming import runs
from testbed import duck
from testbed.registry import query

_EXPORT = """SELECT log_id AS row_id, title, author, date_text, rating_text AS stars, CASE WHEN length(log_id) % 7 = 0 THEN 'to-read' ELSE 'read' END AS read_status FROM log"""
_SHELF = """SELECT pk AS lib_id, title, author, primary_genre AS genre, series_status AS series_type, 'owned' AS tags, series_role AS more_tags FROM items"""


@query("d06_fuzzy_join")
def d06(v):
    """Python ratio: checked against brute force in the tests."""
    return fuzzy.export_match(v.sql(_EXPORT), v.sql(_SHELF), "lib_id")


@query("s16_log_from_export")
def s16(v):
    export, shelf = v.sql(_EXPORT), v.sql(_SHELF)
    return fuzzy.log_from_export(export, shelf, fuzzy.export_match(export, shelf, "lib_id"))


@query("d07_near_misses")
def d07(v):
    """Python ratio: checked against brute force in the tests."""
    return fuzzy.near_misses(v.log.select("log_id", "reader_id", "title", "author"), v.items)


def drained(v, frame, name, **conf):
    """Run a stream over everything there is, then read what it wrote."""
    out, state = fresh_path(v.spark, name), fresh_path(v.spark, name + "-state")
    before = {k: v.spark.conf.get(k, None) for k in conf}
    for k, x in conf.items():
        v.spark.conf.set(k, x)
    try:
        (frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, x in before.items():
            v.spark.conf.unset(k) if x is None else v.spark.conf.set(k, x)
    return v.spark.read.schema(frame.schema).parquet(out)


def _stream(v, rows, name):
    path = fresh_path(v.spark, name)
    rows.write.parquet(path)
    return v.spark.readStream.schema(rows.schema).parquet(path)


@query("x01_live_runs", """WITH e AS (SELECT reader_id, seq, type, coalesce(vector, genre) AS value FROM feedback WHERE type = 'accepted' OR (type = 'rejected' AND coalesce(vector, genre) IS NOT NULL)),
b AS (SELECT *, CASE WHEN type = 'accepted' OR value IS DISTINCT FROM lag(CASE WHEN type = 'rejected' THEN value END) OVER w THEN 1 ELSE 0 END AS brk FROM e WINDOW w AS (PARTITION BY reader_id ORDER BY seq)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY reader_id ORDER BY seq) AS island FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY reader_id, island ORDER BY seq) AS n FROM g WHERE type = 'rejected')
SELECT reader_id, seq, value AS run_value, n FROM n WHERE n >= 3""")
def x01(v):
    stream = _stream(v, v.feedback.select("reader_id", "seq", "type", "vector", "genre"), "events-in")
    return drained(v, runs.live_probes(stream), "probes", **{
        "spark.sql.streaming.stateStore.providerClass": runs.STATE_PROVIDER}).filter("not late").drop("late")


_LIVE = """SELECT reader_id, seq, ts, title, author, type AS status FROM feedback"""


@query("x02_live_ledger", f"""SELECT f.reader_id, f.seq, f.type AS status, p.item_key, i.primary_genre, i.pages FROM feedback f
LEFT JOIN old_pairs p ON p.title_norm = {duck.norm_old('f.title')} AND p.author_norm = {duck.norm_old('f.author')} LEFT JOIN items i ON i.item_key = p.item_key""")
def x02(v):
    marks = v.sql(_LIVE).withColumn("ts", F.col("ts").cast("timestamp"))
    # Each mark arrives twice; the stream must keep one.
    stream = _stream(v, marks.unionByName(marks), "marks-in")
    return drained(v, runs.live_ledger(stream, v.items), "ledger-out").select(
        "reader_id", "seq", "status", "item_key", "primary_genre", "pages")
