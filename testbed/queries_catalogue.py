"""Catalogue maintenance over the whole catalogue, library and link tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import text
from bookloom.operators import audits, catalogue, identity
from bookloom.operators.common import fresh_path, positive_tags, settle
from bookloom.sources import records, versions
from testbed import duck
from testbed.queries_scalar import LIBRARY, _REWRITE
from testbed.registry import query

_OLD = """SELECT item_key, pk, title, author, CASE WHEN pk % 9 = 2 THEN 'x' ELSE series END AS series, series_position, series_status, pages, rating, reviews,
  CASE WHEN pk % 8 = 1 THEN 1900 ELSE pub_year END AS pub_year, status FROM items WHERE pk % 9 <> 0"""
duck.TABLES["old_items"] = _OLD
duck.TABLES["csv_last"] = """SELECT raw_key, arg_max(pages, pk) FILTER (pages IS NOT NULL) AS pages, arg_max(reviews, pk) FILTER (reviews IS NOT NULL) AS reviews,
  arg_max(rating, pk) FILTER (rating IS NOT NULL) AS rating, arg_max(pub_year, pk) FILTER (pub_year IS NOT NULL) AS pub_year,
  arg_max({'v': series}, pk).v AS series, arg_max({'v': series_position}, pk).v AS series_position, arg_max({'v': series_status}, pk).v AS series_status,
  arg_max(title, pk) AS title, arg_max(authors, pk) AS author FROM csv_values GROUP BY 1"""
duck.TABLES["synced"] = """SELECT coalesce(o.item_key, c.raw_key) AS item_key, o.item_key IS NULL AS is_new, coalesce(o.title, c.title) AS title, coalesce(o.author, c.author) AS author,
  coalesce(o.status, 'pending') AS status, coalesce(c.pages, o.pages) AS pages, coalesce(c.reviews, o.reviews) AS reviews, coalesce(c.rating, o.rating) AS rating, coalesce(c.pub_year, o.pub_year) AS pub_year,
  CASE WHEN c.raw_key IS NULL THEN o.series ELSE c.series END AS series, CASE WHEN c.raw_key IS NULL THEN o.series_position ELSE c.series_position END AS series_position,
  CASE WHEN c.raw_key IS NULL THEN o.series_status ELSE c.series_status END AS series_status,
  o.pages AS p0, o.reviews AS r0, o.rating AS g0, o.pub_year AS y0, o.series AS s0, o.series_position AS sp0, o.series_status AS ss0
FROM old_items o FULL JOIN csv_last c ON c.raw_key = o.item_key"""
duck.TABLES["sync_changed"] = """SELECT *, CASE WHEN is_new THEN '' ELSE concat_ws('|', CASE WHEN pages IS DISTINCT FROM p0 THEN 'pages' END, CASE WHEN reviews IS DISTINCT FROM r0 THEN 'reviews' END,
  CASE WHEN rating IS DISTINCT FROM g0 THEN 'rating' END, CASE WHEN pub_year IS DISTINCT FROM y0 THEN 'pub_year' END, CASE WHEN series IS DISTINCT FROM s0 THEN 'series' END,
  CASE WHEN series_position IS DISTINCT FROM sp0 THEN 'series_position' END, CASE WHEN series_status IS DISTINCT FROM ss0 THEN 'series_status' END) END AS changed FROM synced"""


def synced(v):
    return catalogue.sync(v.sql(LIBRARY), v.sql(_OLD), "pk")


@query("m01_sync", "SELECT item_key, is_new, status, pages, reviews, rating, pub_year, series, series_position, series_status, changed FROM sync_changed")
def m01(v):
    return synced(v).withColumn("changed", F.array_join("changed", "|")).drop("title", "author")


@query("m01_versions", """SELECT 1 AS version, item_key, status, pages, reviews, rating, pub_year, series, series_position, series_status FROM old_items
UNION ALL SELECT 3, item_key, status, pages, reviews, rating, pub_year, series, series_position, series_status FROM synced""")
def m01v(v):
    """A stored catalogue synced twice, with a part of the CSV and with all of it: its first
    version and its last."""
    old, csv = v.sql(_OLD), v.sql(LIBRARY)
    store = versions.Store(v.spark, fresh_path(v.spark, "catalogue"), old.schema)
    store.replace(old)
    store.sync(csv.filter("pk % 2 = 0"), "pk")
    last = store.sync(csv, "pk")
    columns = ["item_key", "status", "pages", "reviews", "rating", "pub_year", "series", "series_position", "series_status"]
    return store.read(1).select(F.lit(1).alias("version"), *columns).unionByName(
        store.read(last).select(F.lit(last).alias("version"), *columns))


# Replies about every second item: scalars of several types, some of the wrong one, and lists.
_PATCH = """SELECT item_key, pk, CASE WHEN pk % 6 < 2 THEN 'x' || primary_genre END AS g, pk % 6 AS m FROM items WHERE pk % 2 = 0"""
_ANSWERS = """SELECT pk AS doc_id, 'Here: {"' || CASE WHEN pk % 8 = 0 THEN upper(item_key) ELSE item_key END || '": {' || CASE pk % 6
  WHEN 0 THEN '"primary_genre": "x' || primary_genre || '", "pages": 1, "indie": "maybe"' WHEN 2 THEN '"primary_genre": null, "confidence": "Low", "classic": true'
  ELSE '"status": "pending", "indie": false, "classic": [1]' END || ', "themes": ["shared-1", "no such", "shared-' || CAST(pk % 11 AS STRING) || '"], "taste_signals": {"positive": ["red-1", "odd"], "negative": []}}} end' AS text
FROM items WHERE pk % 2 = 0 AND item_key NOT LIKE '%]'"""


@query("m02_apply_records", f"""SELECT i.item_key, CASE WHEN p.m IN (0, 2) THEN p.g ELSE i.primary_genre END AS primary_genre, i.pages,
  CASE WHEN p.m IS NULL THEN i.status WHEN p.m = 4 THEN 'pending' WHEN p.m = 2 THEN 'needs_review' ELSE 'complete' END AS status,
  CASE WHEN p.m = 2 THEN 'Low' ELSE i.confidence END AS confidence FROM items i LEFT JOIN ({_PATCH}) p ON p.item_key = i.item_key""")
def m02(v):
    p = v.sql(_PATCH)
    fields = (F.when(F.col("m") == 0, F.create_map(F.lit("primary_genre"), "g", F.lit("pages"), F.lit("1")))
              .when(F.col("m") == 2, F.create_map(F.lit("primary_genre"), "g", F.lit("confidence"), F.lit("Low")))
              .otherwise(F.create_map(F.lit("status"), F.lit("pending"))))
    return catalogue.apply_records(v.items, p.select("item_key", fields.alias("fields"))).select(
        "item_key", "primary_genre", "pages", "status", "confidence")


@query("m02_reply_to_items", f"""SELECT i.item_key, CASE p.pk % 6 WHEN 0 THEN 'x' || i.primary_genre WHEN 2 THEN NULL ELSE i.primary_genre END AS primary_genre, i.pages,
  CASE WHEN p.pk % 6 = 4 THEN false ELSE i.indie END AS indie, CASE WHEN p.pk % 6 = 2 THEN true ELSE i.classic END AS classic,
  CASE WHEN p.pk IS NULL THEN i.status WHEN p.pk % 6 = 4 THEN 'pending' WHEN p.pk % 6 = 2 THEN 'needs_review' ELSE 'complete' END AS status,
  CASE WHEN p.pk % 6 = 0 THEN 'indie' ELSE '' END AS rejected, CASE WHEN p.pk IS NULL THEN '' WHEN p.pk % 11 = 1 THEN 'positive:red-1|theme:shared-1' WHEN p.pk % 11 = 0 THEN 'positive:red-1|theme:shared-0|theme:shared-1'
    ELSE 'positive:red-1|theme:shared-1|theme:shared-' || CAST(p.pk % 11 AS VARCHAR) END AS tags FROM items i LEFT JOIN items p ON p.item_key = i.item_key AND p.pk % 2 = 0 AND p.item_key NOT LIKE '%]'""")
def m02r(v):
    """From reply text to patched items: parsing, keys, types and closed lists in one run."""
    replies = settle(records.response_values(v.sql(_ANSWERS)), "replies")
    patched = catalogue.apply_records(v.items, catalogue.reply_fields(replies, v.items))
    tags = catalogue.reply_tags(replies, v.items, v.good_tags).groupBy("item_key").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "child", "tag"))), "|").alias("tags"))
    return patched.join(tags, "item_key", "left").select(
        "item_key", "primary_genre", "pages", "indie", "classic", "status", F.array_join("rejected", "|").alias("rejected"),
        F.coalesce("tags", F.lit("")).alias("tags"))


@query("m03_flag_gates", """WITH a AS (SELECT *, CASE WHEN indie AND reviews > 15000 THEN false ELSE indie END AS i1 FROM items),
s AS (SELECT series, bool_or(coalesce(i1, false) AND coalesce(series_role IN ('first', 'loose-entry'), false)) AS ind,
  count(*) FILTER (series_role IS NOT NULL AND series_status IS DISTINCT FROM 'Standalone') AS r,
  count(*) FILTER (series_role IN ('loose-entry', 'loose-mid', 'standalone') AND series_status IS DISTINCT FROM 'Standalone') AS l FROM a WHERE series IS NOT NULL GROUP BY 1)
SELECT a.item_key, CASE WHEN s.ind THEN true ELSE a.i1 END AS indie, CASE WHEN classic AND (pub_year IS NULL OR 2010 - pub_year < 30) THEN false ELSE classic END AS classic,
  CASE WHEN s.r >= 3 AND s.l / s.r >= 0.8 THEN 'Standalone' ELSE series_status END AS series_status FROM a LEFT JOIN s ON s.series = a.series""")
def m03(v):
    return catalogue.flag_gates(v.items, 2010).select("item_key", "indie", "classic", "series_status")


duck.TABLES["canon"] = f"""SELECT l.src_key, l.pos, l.dst_key AS raw_key, coalesce(e.item_key, n.item_key, l.dst_key) AS dst_key, coalesce(e.item_key, n.item_key) IS NOT NULL AS matched,
  {duck.light('coalesce(e.item_key, n.item_key, l.dst_key)')} AS light FROM raw_links l LEFT JOIN items e ON e.item_key = l.dst_key
LEFT JOIN (SELECT {duck.light('item_key')} AS light, max(item_key) AS item_key FROM items GROUP BY 1) n ON n.light = {duck.light('l.dst_key')}"""
duck.TABLES["canon_kept"] = """SELECT *, row_number() OVER (PARTITION BY src_key, light ORDER BY pos) AS r FROM canon WHERE NOT (matched AND dst_key = src_key)"""
duck.TABLES["closed_links"] = """SELECT src_key, dst_key, pos, 0 AS added FROM canon_kept WHERE r = 1
UNION ALL SELECT dst_key, src_key, 0, 1 FROM canon_kept k WHERE r = 1 AND matched AND NOT EXISTS (SELECT 1 FROM canon_kept b WHERE b.r = 1 AND b.src_key = k.dst_key AND b.dst_key = k.src_key)"""


@query("m04_canonical_links", """SELECT src_key, pos, dst_key, 'kept' AS outcome FROM canon_kept WHERE r = 1
UNION ALL SELECT src_key, pos, raw_key, 'duplicate' FROM canon_kept WHERE r > 1 UNION ALL SELECT src_key, pos, raw_key, 'self' FROM canon WHERE matched AND dst_key = src_key""")
def m04(v):
    kept, dropped = catalogue.canonical_links(v.raw_links, v.items)
    return kept.select("src_key", "pos", "dst_key", F.lit("kept").alias("outcome")).unionByName(
        dropped.select("src_key", "pos", F.col("raw_key").alias("dst_key"), F.col("reason").alias("outcome")))


@query("u03_reciprocal_links", "SELECT src_key, dst_key, CAST(pos AS BIGINT) AS pos, CAST(added AS BIGINT) AS added FROM closed_links")
def u03(v):
    kept, _ = catalogue.canonical_links(v.raw_links, v.items)
    return catalogue.reciprocal_links(kept).withColumn("added", F.col("added").cast("bigint"))


# A supplied ranking: the six links with the smallest key, for two sources in three.
_RANKING = """SELECT src_key, dst_key AS pick, row_number() OVER (PARTITION BY src_key ORDER BY n DESC, dst_key) AS rank FROM (
  SELECT l.src_key, l.dst_key, count(*) AS n FROM item_links l JOIN items s ON s.item_key = l.src_key AND s.pk % 3 <> 0 GROUP BY l.src_key, l.dst_key)"""
duck.TABLES["ranking"] = _RANKING
duck.TABLES["link_n"] = "SELECT *, count(*) OVER (PARTITION BY src_key) AS length FROM closed_links"
duck.TABLES["link_scored"] = f"""SELECT l.*, CASE WHEN l.length > 25 THEN row_number() OVER (PARTITION BY l.src_key ORDER BY CASE WHEN s.primary_genre = d.primary_genre THEN 1 ELSE 0 END DESC,
  CASE WHEN d.item_key IS NULL THEN 0 ELSE (SELECT count(*) FROM good_tags a JOIN good_tags b ON b.tag = a.tag AND b.kind = 'theme' WHERE a.kind = 'theme' AND a.item_key = l.src_key AND b.item_key = l.dst_key) END DESC,
  CASE WHEN d.item_key IS NULL THEN l.dst_key ELSE {duck.light('l.dst_key')} END DESC, l.dst_key) ELSE row_number() OVER (PARTITION BY l.src_key ORDER BY added, pos, l.dst_key) END AS place
FROM link_n l LEFT JOIN items s ON s.item_key = l.src_key LEFT JOIN items d ON d.item_key = l.dst_key WHERE l.length > 6"""
duck.TABLES["link_valid"] = """SELECT c.src_key, c.dst_key, min(r.rank) AS rank, count(*) OVER (PARTITION BY c.src_key) AS n FROM link_scored c JOIN ranking r ON r.src_key = c.src_key AND r.pick = c.dst_key
WHERE c.place <= 25 AND r.rank <= 6 GROUP BY 1, 2"""
duck.TABLES["capped"] = """SELECT src_key, dst_key, 'kept' AS how, CAST(pos AS BIGINT) AS pos FROM link_n WHERE length <= 6
UNION ALL SELECT src_key, dst_key, 'ranked', rank FROM link_valid WHERE n = 6
UNION ALL SELECT src_key, dst_key, 'cut', place FROM link_scored WHERE place <= 6 AND src_key NOT IN (SELECT src_key FROM link_valid WHERE n = 6)"""


def link_parts(v):
    themes = positive_tags(v.item_tags).filter("kind = 'theme'")
    return v.raw_links, v.items, themes, v.sql(_RANKING)


@query("t10_link_cap", "SELECT * FROM capped")
def t10(v):
    links, items, themes, ranking = link_parts(v)
    kept, _ = catalogue.canonical_links(links, items)
    return catalogue.cap_links(catalogue.reciprocal_links(kept), items, themes, ranking).select(
        "src_key", "dst_key", "how", F.col("pos").cast("bigint").alias("pos"))


_LINK_STATS = """SELECT 'canonicalised' AS metric, count(*) AS n FROM canon_kept WHERE r = 1 AND matched AND raw_key <> dst_key
UNION ALL SELECT 'self_dropped', count(*) FROM canon WHERE matched AND dst_key = src_key UNION ALL SELECT 'duplicate_dropped', count(*) FROM canon_kept WHERE r > 1
UNION ALL SELECT 'reciprocals_added', count(*) FROM closed_links WHERE added = 1 UNION ALL SELECT 'over_cap', count(DISTINCT src_key) FROM link_n WHERE length > 6
UNION ALL SELECT 'ranked', count(DISTINCT src_key) FROM capped WHERE how = 'ranked' UNION ALL SELECT 'ranking_failures', count(DISTINCT src_key) FROM capped WHERE how = 'cut'
UNION ALL SELECT 'lists_changed', count(*) FROM (SELECT src_key, list(dst_key ORDER BY pos) AS b FROM raw_links GROUP BY 1) x FULL JOIN
  (SELECT c.src_key, list(c.dst_key ORDER BY coalesce(k.added, 0), c.pos, c.dst_key) AS a FROM capped c LEFT JOIN closed_links k ON c.how = 'kept' AND k.src_key = c.src_key AND k.dst_key = c.dst_key GROUP BY 1) y
  ON x.src_key = y.src_key WHERE a IS DISTINCT FROM b"""


@query("m05_link_sync", f"""SELECT metric, n, CAST(NULL AS VARCHAR) AS src_key, CAST(NULL AS VARCHAR) AS dst_key FROM ({_LINK_STATS})
UNION ALL SELECT 'link:' || how, pos, src_key, dst_key FROM capped""")
def m05(v):
    """The statistics and every link of the synced lists."""
    links, stats = catalogue.sync_links(*link_parts(v))
    none = F.lit(None).cast("string")
    return stats.select("metric", "n", none.alias("src_key"), none.alias("dst_key")).unionByName(links.select(
        F.concat(F.lit("link:"), "how").alias("metric"), F.col("pos").cast("bigint").alias("n"), "src_key", "dst_key"))


@query("m06_series_role", """SELECT item_key, role AS series_role, role IS NULL OR author_entry_point IS NULL AS needs_audit FROM (SELECT *, coalesce(series_role, CASE
  WHEN series_status = 'Standalone' AND series IS NULL THEN 'standalone' WHEN series_status = 'Short Stories' THEN 'standalone'
  WHEN series_status IN ('Short Series', 'Long Series') AND regexp_matches(coalesce(series_position, ''), '(?i)^\\s*book\\s*1([^\\d.]|$)') THEN 'first'
  WHEN series_status IN ('Short Series', 'Long Series') AND regexp_matches(coalesce(series_position, ''), '(?i)book\\s*\\d') THEN 'mid' END) AS role FROM items)""")
def m06(v):
    return catalogue.fill_roles(v.items).select("item_key", "series_role", "needs_audit")


_PHRASES = """SELECT item_key, CASE WHEN kind = 'signal' THEN polarity ELSE kind END AS child, pos, CASE WHEN tag LIKE '%-1' THEN 'free ' || tag ELSE tag END AS phrase, tag
FROM item_tags WHERE kind IN ('signal', 'theme')"""
_VOCAB = "SELECT DISTINCT tag FROM item_tags WHERE kind IN ('signal', 'theme') AND tag NOT LIKE 'old%'"
_MAPPING = f"SELECT DISTINCT phrase, CASE WHEN tag LIKE 'small%' THEN NULL ELSE tag END AS canonical_id FROM ({_PHRASES}) WHERE phrase <> tag"
_LEGACY = f"SELECT item_key, child, pos, tag AS canonical_id FROM ({_PHRASES}) WHERE tag LIKE 'red%' OR tag LIKE 'ring%'"


@query("m07_phrase_mapping", f"""WITH v AS ({_VOCAB}), m AS ({_MAPPING}), c AS (SELECT p.item_key, p.child, 0 AS late, p.pos, CASE WHEN p.phrase IN (SELECT tag FROM v) THEN p.phrase ELSE m.canonical_id END AS id
  FROM ({_PHRASES}) p LEFT JOIN m ON m.phrase = p.phrase UNION ALL SELECT item_key, child, 1, pos, canonical_id FROM ({_LEGACY}))
SELECT item_key, child, string_agg(id, '|' ORDER BY late, pos) AS ids FROM (SELECT item_key, child, id, min((late, pos)) AS k, k[1] AS late, k[2] AS pos FROM c WHERE id IN (SELECT tag FROM v) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def m07(v):
    rows = catalogue.map_phrases(v.sql(_PHRASES), v.sql(_LEGACY), v.sql(_MAPPING), v.sql(_VOCAB))
    return rows.groupBy("item_key", "child").agg(F.array_join(
        F.array_sort(F.collect_list(F.struct("place", "canonical_id")))["canonical_id"], "|").alias("ids"))


@query("g25_unmapped_phrases", f"""SELECT DISTINCT p.child, p.phrase FROM ({_PHRASES}) p WHERE p.phrase NOT IN ({_VOCAB})
  AND NOT EXISTS (SELECT 1 FROM ({_LEGACY}) l WHERE l.item_key = p.item_key AND l.child = p.child AND l.pos = p.pos AND l.canonical_id IN ({_VOCAB}))""")
def g25(v):
    return catalogue.unmapped_phrases(v.sql(_PHRASES), v.sql(_LEGACY), v.sql(_VOCAB))


_MERGES = "SELECT DISTINCT series AS old, 'Merged ' || primary_genre AS new FROM items WHERE series IS NOT NULL AND length(series) % 4 = 0"
_RENAMES = "SELECT DISTINCT 'Merged ' || primary_genre AS old, 'Renamed ' || primary_genre AS new FROM items WHERE primary_genre <> 'large'"
_OVERRIDES = "SELECT title, author, max(CASE WHEN pk % 2 = 0 THEN 'Own Series' END) AS series, max(CASE WHEN pk % 3 = 0 THEN 'Book 9' END) AS position FROM items WHERE pk % 10 = 4 GROUP BY title, author"


@query("m08_series_retag", f"""SELECT * FROM (SELECT i.item_key, i.series AS old_series, coalesce(o.series, r.new, m.new, i.series) AS new_series, i.series_position AS old_position, coalesce(o.position, i.series_position) AS new_position
  FROM items i LEFT JOIN ({_MERGES}) m ON m.old = i.series LEFT JOIN ({_RENAMES}) r ON r.old = coalesce(m.new, i.series) LEFT JOIN ({_OVERRIDES}) o ON o.title = i.title AND o.author = i.author)
WHERE old_series IS DISTINCT FROM new_series OR old_position IS DISTINCT FROM new_position""")
def m08(v):
    return catalogue.retag_series(v.items, v.sql(_MERGES), v.sql(_RENAMES), v.sql(_OVERRIDES))


@query("m09_position_rewrite", f"SELECT item_key, series_position AS old_position, new_position FROM ({_REWRITE}) WHERE new_position IS NOT NULL")
def m09(v):
    return catalogue.rewrite_positions(v.items)


# The library with a fifth of its titles unknown to the catalogue.
_STRAYED = f"SELECT pk, authors, tags, CASE WHEN pk % 5 = 3 THEN 'Lost ' || title ELSE title END AS title FROM ({LIBRARY})"


@query("m10_tag_sync", f"""WITH f AS (SELECT {duck.light('item_key')} AS light, arg_max(indie, item_key) AS indie, arg_max(classic, item_key) AS classic, true AS hit FROM items GROUP BY 1),
r AS (SELECT l.pk, coalesce(l.tags, '') AS tags, f.hit, array_to_string(list_concat(list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda t: trim(t)), lambda t: t NOT IN ('', 'Indie', 'Classics')),
  list_concat(CASE WHEN f.indie THEN ['Indie'] ELSE [] END, CASE WHEN f.classic THEN ['Classics'] ELSE [] END)), ', ') AS t2 FROM ({_STRAYED}) l LEFT JOIN f ON f.light = {duck.light("trim(l.title) || ' - ' || trim(l.authors)")})
SELECT pk, CASE WHEN hit THEN t2 ELSE tags END AS new_tags, CASE WHEN hit IS NULL THEN 'unmatched' WHEN t2 <> tags THEN 'changed' ELSE 'same' END AS outcome FROM r""")
def m10(v):
    flags = v.items.fillna(False, ["indie", "classic"])
    return catalogue.sync_tags(v.sql(_STRAYED), flags).select("pk", "new_tags", "outcome")


_STORED = """SELECT item_key, title, CASE WHEN pk % 6 = 0 AND pk % 13 <> 0 AND pk % 17 <> 0 THEN split_part(author, ' ', 2) || ', ' || split_part(author, ' ', 1) ELSE author END AS author,
  CASE WHEN pk % 4 = 0 THEN lower(title) ELSE replace(lower(title), ': a novel', '') END AS title_normalized, CASE WHEN pk % 4 = 1 THEN 'x' ELSE '' END AS title_short, lower(author) AS author_normalized FROM items"""


@query("m11_normalise", f"""SELECT item_key, author, new_author, new_title_norm, new_title_short, new_author_norm, stale, malformed FROM (
  SELECT *, title_normalized <> new_title_norm OR title_short <> new_title_short OR author_normalized <> new_author_norm OR author <> new_author AS stale, new_title_norm = '' OR new_author_norm = '' AS malformed FROM (
    SELECT *, {duck.swap('author')} AS new_author, {duck.norm('title')} AS new_title_norm, {duck.short('title')} AS new_title_short, {duck.norm(duck.swap('author'))} AS new_author_norm FROM ({_STORED}))) WHERE stale OR malformed""")
def m11(v):
    return catalogue.normalise(v.sql(_STORED))


_YEARS = "SELECT CASE WHEN pk % 3 = 0 THEN upper(item_key) ELSE item_key END AS raw_key, CASE WHEN pk % 7 = 0 THEN NULL ELSE 1950 + pk % 70 END AS value FROM items WHERE copy_ok"
_ONE = "(SELECT *, item_key NOT LIKE '%]' AS copy_ok FROM items)"
_PROMOTE = "SELECT item_key AS raw_key, pk % 2 = 0 AS value FROM items"


@query("m12_proposals", f"""SELECT i.item_key, 'pub_year' AS field, CAST(i.pub_year AS VARCHAR) AS current, CAST(p.value AS VARCHAR) AS proposed FROM ({_YEARS.replace('FROM items', 'FROM ' + _ONE)}) p JOIN items i ON upper(i.item_key) = upper(p.raw_key) WHERE i.pub_year IS DISTINCT FROM p.value
UNION ALL SELECT item_key, 'indie', CAST(indie AS VARCHAR), 'true' FROM items WHERE pk % 2 = 0 AND indie IS NOT TRUE
UNION ALL SELECT item_key, 'applied', NULL, CAST(CASE WHEN pk % 2 = 0 THEN true ELSE indie END AS VARCHAR) FROM items""")
def m12(v):
    years = catalogue.proposal_diff(v.items, v.sql(_YEARS.replace("FROM items", "FROM " + _ONE)), "pub_year")
    flags = catalogue.proposal_diff(v.items, v.sql(_PROMOTE), "indie", promote_only=True)
    applied = catalogue.apply_diff(v.items, flags, "indie").select(
        "item_key", F.lit("applied").alias("field"), F.lit(None).cast("string").alias("current"), F.col("indie").cast("string").alias("proposed"))

    def shown(df, name):
        return df.select("item_key", F.lit(name).alias("field"), F.col("current").cast("string").alias("current"),
                         F.col("proposed").cast("string").alias("proposed"))
    return shown(years, "pub_year").unionByName(shown(flags, "indie")).unionByName(applied)


@query("m13_sync_audit", """WITH b AS (SELECT status, count(*) AS n FROM old_items GROUP BY 1), a AS (SELECT status, count(*) AS n FROM synced GROUP BY 1)
SELECT 'status' AS section, coalesce(a.status, b.status) AS name, coalesce(a.n, 0) - coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.status = b.status
UNION ALL SELECT 'status', 'total', (SELECT count(*) FROM synced) - (SELECT count(*) FROM old_items)
UNION ALL SELECT 'field', f, count(*) FROM (SELECT unnest(string_split(changed, '|')) AS f FROM sync_changed WHERE changed <> '') GROUP BY 2
UNION ALL SELECT 'added', title || ' — ' || author, 1 FROM synced WHERE is_new""")
def m13(v):
    return catalogue.sync_audit(v.sql(_OLD), settle(synced(v), "synced"))


@query("g01_distribution", """SELECT genre, total, indie, classic, round_even(indie / nullif(sum(indie) OVER (), 0), 2) AS indie_share, coalesce(indie / nullif(sum(indie) OVER (), 0) > 0.6, false) AS indie_concentrated,
  round_even(classic / nullif(sum(classic) OVER (), 0), 2) AS classic_share, coalesce(classic / nullif(sum(classic) OVER (), 0) > 0.6, false) AS classic_concentrated FROM (
  SELECT primary_genre AS genre, count(*) AS total, count(*) FILTER (indie) AS indie, count(*) FILTER (classic) AS classic FROM items GROUP BY 1)""")
def g01(v):
    return catalogue.distribution(v.items)


@query("g02_status_counts", """WITH b AS (SELECT status, count(*) AS n FROM old_items GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM old_items), a AS (SELECT status, count(*) AS n FROM items GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM items)
SELECT status, b.n AS before, a.n AS after, a.n - b.n AS delta FROM a JOIN b USING (status)""")
def g02(v):
    return catalogue.status_delta(v.sql(_OLD), v.items)
