"""Audits over the whole catalogue, links and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.operators import audits, catalogue
from testbed import duck
from testbed.registry import query

# Catalogue-wide vectors: the tags of each genre's and each noun's items.
_VOCABULARY = """SELECT DISTINCT 'g-' || i.primary_genre AS vector, t.kind, t.tag FROM good_tags t JOIN items i ON i.item_key = t.item_key AND t.tag NOT LIKE 'shared%'
UNION SELECT DISTINCT 'y-' || CAST(i.pk % 5 AS STRING), t.kind, t.tag FROM good_tags t JOIN items i ON i.item_key = t.item_key WHERE t.tag LIKE 'shared%' OR t.tag LIKE 'hot%'"""
_VECTORS = """SELECT DISTINCT vector, kind, tag FROM vector_members"""
duck.TABLES["vocab_v"] = _VOCABULARY
duck.TABLES["item_vecs"] = """SELECT t.item_key, v.vector, count(*) AS overlap FROM good_tags t JOIN vocab_v v ON v.kind = t.kind AND v.tag = t.tag GROUP BY 1, 2
HAVING count(*) FILTER (t.kind = 'signal') >= 1 AND count(*) >= 2"""
duck.TABLES["unshared"] = """SELECT DISTINCT l.src_key, l.dst_key FROM raw_links l WHERE NOT EXISTS (SELECT 1 FROM item_vecs a JOIN item_vecs b ON b.vector = a.vector WHERE a.item_key = l.src_key AND b.item_key = l.dst_key)"""


def vectors(v):
    return audits.item_vectors(v.item_tags, v.sql(_VOCABULARY))


@query("g06_item_vectors", "SELECT * FROM item_vecs")
def g06(v):
    return vectors(v)


@query("g06_vocabulary_drift", f"""SELECT vector, kind, tag FROM ({_VECTORS}) m WHERE NOT EXISTS (SELECT 1 FROM good_tags t WHERE t.kind = m.kind AND t.tag = m.tag AND t.tag NOT LIKE 'new%')""")
def g06b(v):
    return audits.vocabulary_drift(v.sql(_VECTORS), v.good_tags.filter("tag not like 'new%'"))


@query("d10_unshared_links", "SELECT * FROM unshared")
def d10(v):
    return audits.unshared_links(v.raw_links, vectors(v))


@query("a03_weak_links", """SELECT u.src_key, u.dst_key, CASE WHEN a.primary_genre = b.primary_genre THEN 'review' ELSE 'drop' END AS action, round(coalesce(a.rating, 0) + coalesce(b.rating, 0), 4) AS rating_sum
FROM unshared u JOIN items a ON a.item_key = u.src_key JOIN items b ON b.item_key = u.dst_key
WHERE NOT EXISTS (SELECT 1 FROM good_tags x JOIN good_tags y ON y.kind = x.kind AND y.tag = x.tag WHERE x.item_key = u.src_key AND y.item_key = u.dst_key)""")
def a03(v):
    return audits.weak_links(v.raw_links, v.items, v.item_tags, vectors(v)).select(
        "src_key", "dst_key", "action", F.round("rating_sum", 4).alias("rating_sum"))


@query("a01_entry_misalignment", f"""SELECT item_key, reason FROM (SELECT item_key, concat_ws('; ', CASE WHEN series_role IN ('mid', 'late', 'loose-mid') THEN 'role:' || series_role
    WHEN series_role IN ('first', 'standalone') AND n > 1 THEN 'role:' || series_role || '/book:' || ns END,
  CASE WHEN contains(lower(series_position), 'prequel') THEN 'prequel' WHEN (n > 0 AND n < 1) OR (series_role IS NULL AND n > 1) THEN 'book:' || ns END) AS reason
  FROM (SELECT *, CASE WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS ns FROM (SELECT *, {duck.book_number('series_position')} AS n FROM items WHERE author_entry_point))) WHERE reason <> ''""")
def a01(v):
    return audits.misaligned_entries(v.items)


@query("a02_year_regression", """WITH s AS (SELECT * FROM items_n WHERE series_status IS NULL OR series_status = 'Standalone'),
f AS (SELECT an, min(pub_year) AS y, arg_min(title, (pub_year, item_key)) FILTER (pub_year IS NOT NULL) AS t FROM s GROUP BY 1 HAVING count(*) >= 2)
SELECT s.item_key, s.author, s.pub_year AS ep_year, f.y AS earliest_year, f.t AS earliest_title, s.pub_year - f.y AS gap_years FROM s JOIN f ON f.an = s.an WHERE s.author_entry_point AND s.pub_year > f.y""")
def a02(v):
    return audits.year_regressions(v.items)


@query("g26_zero_entry_authors", """SELECT an AS author_norm, count(*) AS n_books, coalesce(string_agg(DISTINCT series_role, ', ' ORDER BY series_role), '') AS roles, arg_min(author, item_key) AS author FROM items_n
GROUP BY 1 HAVING count(*) >= 3 AND NOT bool_or(coalesce(author_entry_point, false) OR coalesce(series_role IN ('standalone', 'first', 'loose-entry', 'entry-point'), false))""")
def g26(v):
    return audits.zero_entry_authors(v.items)


@query("g28_reconcile_picks", """SELECT p.reader_id, p.tn AS title_norm, p.an AS author_norm, CASE WHEN i.item_key IS NOT NULL THEN 'key_valid' WHEN p.direct IS NOT NULL THEN 'key_unknown'
  WHEN a.item_key IS NOT NULL THEN 'suggested' ELSE 'unmatched' END AS kind, coalesce(p.direct, a.item_key) AS item_key
FROM list_pairs p LEFT JOIN items i ON i.item_key = p.direct LEFT JOIN answers a ON a.tn = p.tn AND a.an = p.an""")
def g28(v):
    return audits.reconcile_picks(v.picks, v.items)


_FLAGS = """SELECT item_key, CASE WHEN pub_year IS NULL THEN 'high' WHEN pages IS NULL THEN 'medium' ELSE 'low' END AS severity FROM items WHERE pub_year IS NULL OR pages IS NULL OR pages > 900
UNION ALL SELECT item_key, 'high' FROM items WHERE rating IS NULL AND status <> 'pending'"""


@query("g27_review_report", f"""WITH f AS ({_FLAGS}) SELECT severity AS bucket, count(*) AS n_flags, count(DISTINCT item_key) AS n_items FROM f GROUP BY 1
UNION ALL SELECT 'clean', 0, count(*) FROM items WHERE status <> 'pending' AND item_key NOT IN (SELECT item_key FROM f) UNION ALL SELECT 'unaudited', 0, count(*) FROM items WHERE status = 'pending'""")
def g27(v):
    return catalogue.review_report(v.items, v.sql(_FLAGS), v.items.filter("status <> 'pending'").select("item_key"))
