"""Registered queries against their oracle SQL on the smallest tables, and invariants of
the recommendation plan.  `python -m testbed.check` runs all of them at any scale."""

import collections

import pytest

import __spark_entry__ as entry
from bookloom.plans import recommend
from testbed import check, queries_recommend
from testbed.views import Roles, for_duckdb, with_roles
from testbed import duck

QUICK = ["d01_canonical_key", "d02_tolerant_join", "d03_list_membership", "d08_lookup", "s05_rebuild_entry",
         "s09_markdown_tables", "s14_response_values", "s15_request_batches", "g05_floors_at_risk", "w01_unfinished_series",
         "w09_effective_rating", "w10_review_anomaly", "m01_sync", "m03_flag_gates", "m05_link_sync", "a03_weak_links",
         "t06_slots", "x01_live_runs", "x02_live_ledger"]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, sf_dir, name):
    con = check.duck(sf_dir)
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert check.compare(df.collect(), df.columns, cur.fetchall(), cols) is None


def test_recommendations_match_the_whole_pool(spark, sf_dir):
    """The residual stratum, built without pairing readers and items, equals the one
    ranked from every pair."""
    v = Roles(spark, sf_dir)
    rec = queries_recommend.recommender(v, variance="broad")
    out = rec.run()
    chosen = out["chosen"].collect()
    per_reader = collections.Counter(r.reader_id for r in chosen)
    sizes = {r.reader_id: r.pool_size for r in out["pool_size"].collect()}
    assert all(per_reader[k] == min(15, n) for k, n in sizes.items())
    assert len({(r.reader_id, r.item_key) for r in chosen}) == len(chosen)
    con = check.duck(sf_dir)
    def rows(sql):
        return con.execute(for_duckdb(with_roles(sql, duck.TABLES, "AS MATERIALIZED"))).fetchall()
    pool = set(rows("""SELECT s.reader_id, i.item_key FROM reader_state s JOIN items i ON i.rating >= 3.8 JOIN gate g ON g.item_key = i.item_key
      AND (g.open_entry OR EXISTS (SELECT 1 FROM log_n l WHERE l.reader_id = s.reader_id AND l.an = g.an))
      WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.reader_id = s.reader_id AND e.item_key = i.item_key) AND EXISTS (SELECT 1 FROM active_members m WHERE m.reader_id = s.reader_id)"""))
    assert {(r.reader_id, r.item_key) for r in chosen} <= pool
    near = set(rows("SELECT * FROM rel_pairs"))
    base = {r.item_key: r.base for r in rec.quality.collect()}
    links = {(r.reader_id, r.item_key): r.links for r in out["liked_links"].collect()}
    forced = [(r, k, round(base[k] + 0.6 * min(links.get((r, k), 0), 3), 3)) for r, k in pool - near]
    placed = [(r.reader_id, r.item_key, r.score) for r in out["placed"].filter("stratum = 'residual'").collect()]
    merged = {(r, k): s for r, k, s in forced} | {(r, k): s for r, k, s in placed}
    want = collections.Counter(r for r, _ in merged)
    got = {r.reader_id: r["size"] for r in out["sizes"].filter("stratum = 'residual'").collect()}
    assert got == dict(want)
    from pyspark.sql import functions as F
    from bookloom.functions import values
    full = spark.createDataFrame([(r, "residual", k, s) for (r, k), s in merged.items()],
                                 "reader_id long, stratum string, item_key string, score double")
    chunks = recommend.tie_chunks(full, ["reader_id", "stratum"])
    draw = rec.draw()
    order = [F.col("chunk"), values.unit_hash(F.lit(str(rec.seed)), draw, F.col("stratum"), "item_key"), F.col("item_key")]
    from bookloom.operators.common import top_rows
    best = top_rows(full.join(chunks, ["reader_id", "stratum", "score"]), ["reader_id"], order, 15)
    ranked = collections.defaultdict(list)
    for r in best.orderBy("reader_id", "_rn").collect():
        ranked[r.reader_id].append(r.item_key)
    taken = collections.defaultdict(set)
    for r in chosen:
        taken[r.reader_id].add(r.item_key)
    slots = {r.reader_id: r.slots for r in out["slots"].filter("stratum = 'residual'").collect()}
    assert slots
    for reader_id, n in slots.items():
        # The residual slots are filled from the head of the brute-force ranking.
        head = [k for k in ranked[reader_id]]
        mine = [r.item_key for r in chosen if r.reader_id == reader_id and r.stratum == "residual"]
        assert set(mine) <= set(head) and len(mine) >= min(n, want[reader_id])
        assert set(head[:n]) <= taken[reader_id]


def test_many_items_outside_a_series(spark, tmp_path):
    """Over 46,340 of them: the square of their number leaves 32 bits."""
    n = 50_000
    spark.range(n).selectExpr(
        "id AS p_partkey", "'small ring' AS p_name", "'Brand#7' AS p_brand", "'LARGE' AS p_type",
        "CAST(5 AS INT) AS p_size", "1.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    got = Roles(spark, str(tmp_path)).sql("SELECT pk, reviews FROM items WHERE pk IN (3, 49000)").collect()
    assert {r.pk: r.reviews for r in got} == {3: 200000 // 16, 49000: 0}


def test_list_strata_are_worked_out_once(spark, sf_dir):
    """Both branches read the written hits: only the items outside them are still joined."""
    out = entry.queries()["t04_strata"](spark, sf_dir)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and "Join Inner" not in plan
