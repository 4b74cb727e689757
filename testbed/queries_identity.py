"""Identity joins over the whole log, lists and catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import text
from bookloom.operators import identity
from testbed import duck
from testbed.registry import query


@query("d01_canonical_key", f"""SELECT l.src_key, l.pos, l.dst_key AS raw_key, coalesce(e.item_key, n.item_key) AS canonical_key
FROM raw_links l LEFT JOIN items e ON e.item_key = l.dst_key
LEFT JOIN (SELECT {duck.light('item_key')} AS light, max(item_key) AS item_key FROM items GROUP BY 1) n
  ON n.light = {duck.light('l.dst_key')}""")
def d01(v):
    return identity.canonical_keys(v.raw_links.withColumnRenamed("dst_key", "raw_key"), v.items)


@query("d02_tolerant_join", "SELECT log_id, reader_id, tn AS title_norm, an AS author_norm, item_key FROM log_r")
def d02(v):
    return (identity.resolve(v.log.select("log_id", "reader_id", "title", "author"), v.items)
            .select("log_id", "reader_id", "title_norm", "author_norm", "item_key"))


@query("d03_list_membership", """SELECT DISTINCT p.reader_id, h.item_key FROM
  (SELECT DISTINCT reader_id, tn, an FROM picks_n) p JOIN ask_hits h ON h.tn = p.tn AND h.an = p.an""")
def d03(v):
    return identity.listed_items(v.picks, v.items)


@query("d04_resolve_picks", "SELECT reader_id, item_key FROM list_items")
def d04(v):
    return identity.resolve_picks(v.picks, v.items)


@query("d05_title_only", f"""SELECT title, item_key FROM (
  SELECT t.title, k.item_key, row_number() OVER (PARTITION BY t.title ORDER BY t.prio, k.rev0 DESC, k.item_key) AS r
  FROM (SELECT title, unnest([1, 2, 3]) AS prio, unnest([1, 1, 2]) AS pass, unnest([tn, ts, {duck.fold('tn')}]) AS k FROM (
    SELECT DISTINCT title, {duck.norm('title')} AS tn, {duck.short('title')} AS ts FROM (
      SELECT title FROM vector_examples UNION ALL SELECT title FROM log))) t
  JOIN item_keys_n k ON k.pass = t.pass AND k.k = t.k) WHERE r = 1""")
def d05(v):
    titles = v.vector_examples.select("title").unionByName(v.log.select("title"))
    return identity.resolve_titles(titles, v.items)


_QUERIES = """SELECT DISTINCT CASE WHEN pk % 4 = 0 THEN upper(item_key) WHEN pk % 4 = 1 THEN p_title
  WHEN pk % 4 = 2 THEN coalesce(series, 'zz') ELSE 'none ' || CAST(pk AS STRING) END AS query
FROM (SELECT item_key, pk, series, replace(title, ': A Novel', '') AS p_title FROM items)"""


@query("d08_lookup", f"""WITH q AS (SELECT query, lower(trim(query)) AS low, {duck.norm_old('trim(query)')} AS needle FROM ({_QUERIES})),
names AS (SELECT item_key, lower(item_key) AS low, {duck.norm_old('title')} AS a,
  {duck.norm_old("split_part(lower(title), ':', 1)")} AS b, {duck.norm_old("lower(coalesce(series, ''))")} AS c FROM items),
hits AS (SELECT q.query, n.item_key, CASE WHEN q.low = n.low THEN 1 WHEN q.needle <> '' AND (contains(n.a, q.needle) OR contains(n.b, q.needle)) THEN 2
  WHEN q.needle <> '' AND contains(n.c, q.needle) THEN 3 END AS pass FROM q, names n)
SELECT query, item_key, pass FROM (SELECT *, min(pass) OVER (PARTITION BY query) AS lead FROM hits WHERE pass IS NOT NULL) WHERE pass = lead""")
def d08(v):
    return identity.lookup(v.sql(_QUERIES), v.items)


duck.TABLES["old_pairs"] = f"""SELECT title_norm, author_norm, item_key FROM (
  SELECT *, row_number() OVER (PARTITION BY title_norm, author_norm ORDER BY prio, item_key) AS r FROM (
    SELECT 1 AS prio, {duck.norm_old('title')} AS title_norm, {duck.norm_old('author')} AS author_norm, item_key FROM items
    UNION ALL SELECT 1, {duck.norm_old("left(item_key, length(item_key) - length(list_extract(string_split(item_key, ' - '), -1)) - 3)")}, {duck.norm_old('author')}, item_key FROM items
    UNION ALL SELECT 2, {duck.norm_old("split_part(title, ':', 1)")}, {duck.norm_old('author')}, item_key FROM items WHERE contains(title, ':'))
  WHERE title_norm <> '') WHERE r = 1"""


@query("d09_pair_index", f"""SELECT l.log_id, p.item_key FROM log l JOIN old_pairs p
  ON p.title_norm = {duck.norm_old('l.title')} AND p.author_norm = {duck.norm_old('l.author')}""")
def d09(v):
    named = v.log.select("log_id", text.norm_keep_subtitle("title").alias("title_norm"),
                         text.norm_keep_subtitle("author").alias("author_norm"))
    return named.join(identity.pair_index(v.items), ["title_norm", "author_norm"]).select("log_id", "item_key")


_RECORDS = """SELECT pk, CASE WHEN pk % 3 = 0 THEN item_key WHEN pk % 3 = 1 THEN lower(item_key) ELSE 'Wrong Key ' || CAST(pk AS STRING) END AS raw_key,
  CASE WHEN pk % 5 = 0 THEN upper(title) WHEN pk % 5 = 1 THEN 'Nowhere To Be Found' WHEN pk % 5 = 2 THEN '' ELSE title END AS title FROM items"""


@query("d11_upsert_match", f"""WITH r AS ({_RECORDS}), n AS (SELECT item_key, {duck.light('item_key')} AS light FROM items)
SELECT r.pk, coalesce(max(e.item_key), max(n.item_key), min(s.item_key)) AS canonical_key
FROM r LEFT JOIN items e ON e.item_key = r.raw_key LEFT JOIN n ON n.light = {duck.light('r.raw_key')}
LEFT JOIN n s ON e.item_key IS NULL AND n.item_key IS NULL AND r.title <> '' AND contains(s.light, {duck.light('r.title')})
GROUP BY r.pk""")
def d11(v):
    return identity.upsert_keys(v.sql(_RECORDS), v.items).select("pk", "canonical_key")


@query("d12_duplicates", """SELECT tn AS title_norm, an AS author_norm, count(*) AS n_items, min(item_key) AS first_key,
  max(item_key) AS last_key FROM items_n GROUP BY 1, 2 HAVING count(*) > 1""")
def d12(v):
    return identity.duplicate_groups(v.items)


@query("g29_peers", """SELECT a.item_key, b.item_key AS peer_key, b.title AS peer_title, b.r AS rank FROM items a, LATERAL (
  SELECT p.item_key, p.title, row_number() OVER (ORDER BY p.item_key) AS r FROM items p
  WHERE p.author = a.author AND p.item_key <> a.item_key) b WHERE b.r <= 8""")
def g29(v):
    return identity.peers(v.items).select("item_key", "peer_key", "peer_title", F.col("rank").cast("bigint").alias("rank"))
