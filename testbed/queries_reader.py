"""Reader aggregates, gates and probes over every reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import text, values
from bookloom.operators import filters, identity, reader
from bookloom.sources import markdown, tables
from testbed import duck
from testbed.queries_sources import _MARKS, _PROFILE
from testbed.registry import TODAY, query


def log(v):
    return v.log.withColumns({"rating": values.parse_rating("rating_text"),
                              "read_on": values.parse_date("date_text")})


def resolve_log(v):
    return identity.resolve(log(v).select("log_id", "reader_id", "title", "author", "rating", "read_on",
                                          "logged_on", "my_tags"), v.items)


def resolved(v):
    """The log with its item keys, stored once."""
    return v.kept("resolved-log", lambda: resolve_log(v))


def listed(v):
    return v.kept("listed-items", lambda: identity.resolve_picks(v.picks, v.items))


duck.TABLES.update({
    "pick_overlap": """SELECT p.reader_id, p.item_key, m.vector, count(*) AS overlap FROM list_items p
JOIN good_tags t ON t.item_key = p.item_key JOIN active_members m ON m.reader_id = p.reader_id AND m.kind = t.kind AND m.tag = t.tag
GROUP BY ALL""",
    "coverage": """SELECT v.reader_id, v.vector, v.ord, v.weight, count(o.item_key) AS coverage FROM active_vectors v
LEFT JOIN pick_overlap o ON o.reader_id = v.reader_id AND o.vector = v.vector GROUP BY ALL""",
    "underused": """SELECT reader_id, vector, ord, coverage, share FROM (SELECT c.*, w / sum(w) OVER (PARTITION BY c.reader_id) * s.n_target AS share
FROM (SELECT *, coalesce(nullif(weight, 0), 1.0) AS w FROM coverage) c JOIN reader_state s ON s.reader_id = c.reader_id) WHERE coverage < share""",
    "risk": """SELECT f.reader_id, f.kind, f.name, f.target - (SELECT count(*) FROM list_books b WHERE b.reader_id = f.reader_id AND
    CASE WHEN f.name = 'indie' THEN b.indie WHEN f.name = 'classic' THEN b.classic ELSE lower(b.primary_genre) = lower(f.name) END) AS remaining,
  greatest(s.n_target - (SELECT count(*) FROM list_pairs p WHERE p.reader_id = f.reader_id), 0) AS books_left
FROM floors f JOIN reader_state s ON s.reader_id = f.reader_id""",
    "load": """SELECT reader_id, count(*) FILTER (n >= 3 AND s IS NOT NULL) AS long_series, CAST(sum(d) AS BIGINT) AS doorstops, CAST(sum(n) AS BIGINT) AS list_items
FROM (SELECT reader_id, series AS s, count(*) AS n, count(*) FILTER (pages >= 600) AS d FROM list_books GROUP BY 1, 2) GROUP BY 1""",
    "liked": "SELECT DISTINCT reader_id, item_key FROM log_r WHERE rating >= 4 AND item_key IS NOT NULL",
    "anchor_rows": f"""SELECT l.reader_id, l.log_id, l.item_key, {duck.bucket('l.read_on', TODAY)} AS bucket FROM log_r l
WHERE l.rating >= 4 AND l.item_key IS NOT NULL AND EXISTS (SELECT 1 FROM good_tags t JOIN active_members m ON m.kind = t.kind AND m.tag = t.tag
  WHERE t.item_key = l.item_key AND m.reader_id = l.reader_id)""",
    "anchor_w": """SELECT reader_id, bucket, n, round_even(1.0 / greatest(n, 1) / sum(1.0 / greatest(n, 1)) OVER (PARTITION BY reader_id) * 3.0, 4) AS weight
FROM (SELECT r.reader_id, b.bucket, count(a.log_id) AS n FROM (SELECT DISTINCT reader_id FROM anchor_rows) r
  CROSS JOIN (VALUES ('<=12mo'), ('12-36mo'), ('3+yrs'), ('undated')) b(bucket)
  LEFT JOIN anchor_rows a ON a.reader_id = r.reader_id AND a.bucket = b.bucket GROUP BY 1, 2)""",
    "anchor_items": """SELECT a.reader_id, a.item_key, sum(w.weight) AS weight FROM anchor_rows a JOIN anchor_w w ON w.reader_id = a.reader_id AND w.bucket = a.bucket GROUP BY 1, 2""",
    "anchor_tags": """SELECT DISTINCT a.reader_id, a.item_key, t.kind, t.tag, a.weight FROM anchor_items a JOIN good_tags t ON t.item_key = a.item_key
JOIN active_members m ON m.reader_id = a.reader_id AND m.kind = t.kind AND m.tag = t.tag""",
    "pick_strength": """SELECT reader_id, item_key, least(sum(weight), 1.5) AS strength FROM (
  SELECT DISTINCT p.reader_id, p.item_key, a.item_key AS anchor, a.weight FROM list_items p JOIN good_tags t ON t.item_key = p.item_key
  JOIN anchor_tags a ON a.reader_id = p.reader_id AND a.kind = t.kind AND a.tag = t.tag) GROUP BY 1, 2""",
    "rej": """SELECT reader_id, seq, item_key, coalesce(vector, genre) AS value, CASE WHEN vector IS NOT NULL THEN 'vector' ELSE 'genre' END AS kind
FROM feedback f WHERE type = 'rejected' AND coalesce(vector, genre) IS NOT NULL
  AND seq > coalesce((SELECT max(seq) FROM feedback a WHERE a.reader_id = f.reader_id AND a.type = 'accepted'), -1)""",
    "run_rows": """SELECT * FROM (SELECT *, first_value(value) OVER w AS run_value, first_value(kind) OVER w AS run_kind,
  sum(CASE WHEN value <> lastv THEN 1 ELSE 0 END) OVER w AS other FROM (
    SELECT *, first_value(value) OVER (PARTITION BY reader_id ORDER BY seq DESC) AS lastv FROM rej)
  WINDOW w AS (PARTITION BY reader_id ORDER BY seq DESC)) WHERE other = 0""",
    "runs": "SELECT reader_id, run_kind, run_value, count(*) AS n, count(item_key) AS n_keys FROM run_rows GROUP BY ALL HAVING count(*) >= 3",
    "run_keys": "SELECT DISTINCT r.reader_id, r.item_key FROM run_rows r JOIN runs u ON u.reader_id = r.reader_id WHERE r.item_key IS NOT NULL",
    "run_shared": """SELECT k.reader_id, count(DISTINCT k.item_key) AS n_keys, CAST(min(nullif(i.pages, 0)) AS VARCHAR) || '-' || CAST(max(nullif(i.pages, 0)) AS VARCHAR) AS page_range
FROM run_keys k JOIN items i ON i.item_key = k.item_key GROUP BY 1""",
    "run_tags": """SELECT k.reader_id, t.kind, t.tag FROM run_keys k JOIN good_tags t ON t.item_key = k.item_key JOIN run_shared s ON s.reader_id = k.reader_id
GROUP BY k.reader_id, t.kind, t.tag, s.n_keys HAVING count(DISTINCT k.item_key) = s.n_keys""",
    "run_lists": """SELECT s.reader_id, s.page_range, coalesce((SELECT string_agg(tag, '|' ORDER BY tag) FROM run_tags t WHERE t.reader_id = s.reader_id AND kind = 'signal'), '') AS signals,
  coalesce((SELECT string_agg(tag, '|' ORDER BY tag) FROM run_tags t WHERE t.reader_id = s.reader_id AND kind = 'theme'), '') AS themes FROM run_shared s""",
    "ledger": f"SELECT m.*, {duck.norm_old('title')} AS title_norm, {duck.norm_old('author')} AS author_norm FROM ({_MARKS}) m",
    "notes_r": """SELECT doc_id AS reader_id, n, kind, tag, page_limit, raw FROM prefs""",
})


@query("g31_item_vectors", """SELECT o.reader_id, o.item_key, string_agg(o.vector, '|' ORDER BY o.vector) AS vectors, CAST(sum(overlap) AS BIGINT) AS overlap
FROM pick_overlap o GROUP BY 1, 2""")
def g31(v):
    overlap = reader.vector_overlap(listed(v), v.item_tags, reader.active_members(v.vectors, v.vector_members))
    total = overlap.groupBy("reader_id", "item_key").agg(F.sum("overlap").alias("overlap"))
    return (reader.matched_vectors(overlap).withColumn("vectors", F.array_join("vectors", "|"))
            .join(total, ["reader_id", "item_key"]))


@query("s04_bucketed_tags", """SELECT o.reader_id, o.item_key, string_agg(o.vector, '|' ORDER BY o.vector) AS vectors FROM pick_overlap o GROUP BY 1, 2""")
def s04b(v):
    """Vectors of list items over tags stored in buckets of their item."""
    tags = tables.bucketed(v.item_tags, "item_tags")
    overlap = reader.vector_overlap(listed(v), tags, reader.active_members(v.vectors, v.vector_members))
    return reader.matched_vectors(overlap).withColumn("vectors", F.array_join("vectors", "|"))


def coverage(v):
    return reader.vector_coverage(listed(v), v.item_tags, v.vectors, v.vector_members)


@query("g03_vector_coverage", "SELECT reader_id, vector, coverage FROM coverage")
def g03(v):
    return coverage(v).select("reader_id", "vector", "coverage")


@query("g04_underused_vectors", "SELECT reader_id, vector, coverage, round(share, 6) AS share FROM underused")
def g04(v):
    return reader.underused_vectors(coverage(v), v.reader_state).select(
        "reader_id", "vector", "coverage", F.round("share", 6).alias("share"))


def risk(v):
    return reader.floors_at_risk(v.floors, listed(v), v.items, identity.list_pairs(v.picks), v.reader_state)


@query("g05_floors_at_risk", "SELECT * FROM risk WHERE remaining > 0")
def g05(v):
    return risk(v)


@query("g07_commitment_load", """SELECT l.*, CASE WHEN s.long_series_cap IS NULL THEN NULL WHEN l.long_series >= s.long_series_cap THEN 'at_cap'
  WHEN l.long_series >= s.long_series_cap - 1 THEN 'near_cap' END AS status FROM load l JOIN reader_state s ON s.reader_id = l.reader_id""")
def g07(v):
    load = reader.commitment_load(listed(v), v.items)
    warned = reader.commitment_warnings(load, v.reader_state).select("reader_id", "status")
    return load.join(warned, "reader_id", "left")


@query("g08_page_budget", """SELECT b.reader_id, s.page_target, round_even(avg(nullif(pages, 0)), 1) AS current_avg, count(nullif(pages, 0)) AS n_with_pages
FROM list_books b JOIN reader_state s ON s.reader_id = b.reader_id GROUP BY 1, 2 HAVING avg(nullif(pages, 0)) > s.page_target * 1.10""")
def g08(v):
    return reader.page_warnings(listed(v), v.items, v.reader_state)


def anchor_parts(v):
    live = reader.active_tags(v.vectors, v.vector_members)
    return reader.anchors(resolved(v), v.item_tags, live, TODAY)


@query("g09_log_anchors", "SELECT reader_id, bucket, n, weight FROM anchor_w")
def g09(v):
    return anchor_parts(v)[0]


@query("g10_anchor_strength", "SELECT reader_id, item_key, round(strength, 4) AS strength FROM pick_strength")
def g10(v):
    groups = reader.anchor_groups(anchor_parts(v)[1])
    tags = reader.positive_tags(v.item_tags)
    return reader.anchor_strength(listed(v), tags, groups).withColumn("strength", F.round("strength", 4))


@query("g10_matched_anchors", f"""WITH h AS (SELECT DISTINCT p.reader_id, p.item_key, a.item_key AS anchor, a.weight FROM list_items p JOIN good_tags t ON t.item_key = p.item_key
  JOIN anchor_tags a ON a.reader_id = p.reader_id AND a.kind = t.kind AND a.tag = t.tag), r AS (SELECT *, row_number() OVER (PARTITION BY reader_id, item_key ORDER BY round(weight, 9) DESC, anchor) AS place FROM h)
SELECT r.reader_id, r.item_key, r.place, r.anchor, i.title, round(r.weight, 4) AS weight FROM r JOIN items i ON i.item_key = r.anchor WHERE place <= 5""")
def g10a(v):
    """The liked reads behind a strength, heaviest first."""
    found = reader.matched_anchors(listed(v), reader.positive_tags(v.item_tags), anchor_parts(v)[1], v.items)
    return found.withColumns({"weight": F.round("weight", 4), "place": F.col("place").cast("bigint")})


@query("g11_link_overlap", """SELECT f.reader_id, l.src_key AS item_key, count(*) AS links, least(count(*), 3) * 0.6e0 AS bonus
FROM item_links l JOIN liked f ON f.item_key = l.dst_key GROUP BY 1, 2""")
def g11(v):
    hits = reader.link_overlap(v.item_links, reader.favourites(resolved(v)))
    return hits.withColumn("bonus", F.least("links", F.lit(reader.LINK_CAP)) * reader.LINK_WEIGHT)


@query("g12_favourite_pools", f"""WITH l AS (SELECT reader_id, {duck.rating('rating_text')} AS rating, {duck.norm_old('title')} AS t, {duck.norm_old('author')} AS a FROM log)
SELECT DISTINCT reader_id, 'five_star_author' AS pool, '' AS title_norm, a AS author_norm FROM l WHERE rating >= 5
UNION SELECT reader_id, 'favourite_author', '', a FROM l WHERE rating >= 4.5
UNION SELECT reader_id, 'favourite_title', t, a FROM l WHERE rating >= 4.5""")
def g12(v):
    return reader.favourite_pools(log(v))


@query("g13_author_history", f"""WITH q AS (SELECT author, {duck.norm('author')} AS n FROM (SELECT DISTINCT author FROM items)),
l AS (SELECT reader_id, log_id, logged_on, author, rating, list_distinct(list_prepend(an,
  list_transform(string_split_regex(author, '{duck.SPLIT}'), lambda p: {duck.norm('p')}))) AS parts FROM log_n),
x AS (SELECT * EXCLUDE parts, unnest(parts) AS part FROM l)
SELECT x.reader_id, q.author, arg_min(x.author, (logged_on, log_id)) AS matched_author, count(*) AS reads, count(*) FILTER (rating >= 4) AS liked
FROM x JOIN q ON q.n = x.part AND q.n <> '' GROUP BY 1, 2""")
def g13(v):
    return reader.author_history(log(v), v.items)


@query("g23_shared_attributes", "SELECT * FROM run_lists")
def g23(v):
    rows = reader.rejection_rows(v.feedback)
    live = rows.join(reader.rejection_runs(v.feedback).select("reader_id"), "reader_id", "left_semi")
    empty = F.array().cast("array<string>")
    return reader.shared_attributes(live, v.items, v.item_tags).select(
        "reader_id", "page_range", F.array_join(F.coalesce("signals", empty), "|").alias("signals"),
        F.array_join(F.coalesce("themes", empty), "|").alias("themes"))


@query("w06_rejection_run", "SELECT * FROM runs")
def w06(v):
    return reader.rejection_runs(v.feedback)


@query("t11_probe", """SELECT u.reader_id, u.run_kind, u.run_value, u.n, l.page_range, coalesce(l.signals, '') AS signals, coalesce(l.themes, '') AS themes,
  CASE WHEN coalesce(l.signals, '') <> '' OR coalesce(l.themes, '') <> '' OR l.page_range IS NOT NULL THEN 'shared' ELSE 'run' END AS ask
FROM runs u LEFT JOIN run_lists l ON l.reader_id = u.reader_id""")
def t11(v):
    return reader.probes(v.feedback, v.items, v.item_tags)


@query("g30_lock_ledger", """SELECT reader_id, item_key, count(*) FILTER (type = 'defended') AS defended, bool_or(type = 'session_lock') AS session_lock
FROM feedback WHERE item_key IS NOT NULL GROUP BY 1, 2 HAVING bool_or(type IN ('defended', 'session_lock'))""")
def g30(v):
    notes = v.feedback.filter("type = 'session_lock'").select("reader_id", "item_key", F.lit("session_lock").alias("kind"))
    return reader.lock_ledger(v.feedback.filter("type <> 'session_lock'"), notes)


def marks(v):
    old = text.norm_keep_subtitle
    return v.sql(_MARKS).withColumns({"title_norm": old("title"), "author_norm": old("author")})


@query("g32_rejections", """SELECT reader_id, title_norm, author_norm, n, CAST(list_extract([0, 0.5, 1.5, 3.5, 6], least(n, 4) + 1) AS DOUBLE) AS penalty FROM (
  SELECT reader_id, title_norm, author_norm, count(*) FILTER (status = 'rejected') AS n FROM ledger GROUP BY ALL)""")
def g32(v):
    return reader.rejection_counts(marks(v))


_LED = """SELECT f.reader_id, f.type, i.primary_genre, i.indie, i.classic, i.pages,
  CASE f.type WHEN 'rejected' THEN 'rejected' ELSE 'shown' END AS status FROM feedback f JOIN items i ON i.item_key = f.item_key"""


@query("w07_scoped_rejections", f"""SELECT reader_id, scope, n, n >= 3 AS probe FROM (SELECT reader_id, 'genre' AS scope, count(*) FILTER (status = 'rejected' AND primary_genre IN ('economy', 'large')) AS n FROM ({_LED}) GROUP BY 1
UNION ALL SELECT reader_id, 'indie', count(*) FILTER (status = 'rejected' AND indie) FROM ({_LED}) GROUP BY 1
UNION ALL SELECT reader_id, 'short classic', count(*) FILTER (status = 'rejected' AND classic AND (coalesce(pages, 0) = 0 OR pages <= 350)) FROM ({_LED}) GROUP BY 1)""")
def w07(v):
    led = v.sql(_LED)
    parts = {"genre": dict(genres=["Economy", "large"]), "indie": dict(indie=True),
             "short classic": dict(classic=True, pages="short")}
    frames = [reader.scoped_rejections(led, **kw).withColumn("scope", F.lit(n)) for n, kw in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


# ---- gates and filters

duck.TABLES["rel_pairs"] = """SELECT DISTINCT m.reader_id, i.item_key FROM active_members m JOIN good_tags t ON t.kind = m.kind AND t.tag = m.tag
JOIN items i ON i.item_key = t.item_key AND i.rating >= 3.8"""


@query("f01_relevance_gate", """SELECT r.reader_id, count(*) AS n, min(r.item_key) AS first_key, max(r.item_key) AS last_key, CAST(sum(i.pk) AS BIGINT) AS pk_sum
FROM rel_pairs r JOIN items i ON i.item_key = r.item_key GROUP BY 1""")
def f01(v):
    profiles, held = filters.tag_profiles(v.item_tags)
    # Per profile first, so that no reader meets an item.
    per = filters.quality_items(v.items).join(profiles, "item_key").groupBy("profile").agg(
        F.count("*").alias("n"), F.min("item_key").alias("a"), F.max("item_key").alias("z"), F.sum("pk").alias("s"))
    return filters.relevance(reader.active_tags(v.vectors, v.vector_members), held, per)


duck.TABLES["excl"] = """SELECT DISTINCT l.reader_id, i.item_key FROM log_n l JOIN items_n i ON i.tn = l.tn AND i.an = l.an
UNION SELECT p.reader_id, h.item_key FROM picks_n p JOIN ask_hits h ON h.tn = p.tn AND h.an = p.an
UNION SELECT reader_id, item_key FROM feedback WHERE type = 'rejected' AND item_key IS NOT NULL"""


@query("f02_exclusion_gate", "SELECT * FROM excl")
def f02(v):
    return filters.excluded_items(v.log, v.picks, v.feedback, v.items)


duck.TABLES["gate"] = """SELECT item_key, an, CASE WHEN series_role IS NOT NULL OR author_entry_point IS NOT NULL
    THEN coalesce(author_entry_point, true) AND (series_role IS NULL OR series_role IN ('standalone', 'first', 'loose-entry'))
  ELSE series_status IS NULL OR series_status = 'Standalone' OR coalesce(regexp_matches(series_position, '(?i)^\\s*book\\s*1([^\\d.]|$)'), false) END AS open_entry FROM items_n"""


@query("f03_entry_point_gate", """SELECT g.item_key, g.open_entry, (SELECT count(DISTINCT reader_id) FROM log_n l WHERE l.an = g.an) AS n_readers FROM gate g""")
def f03(v):
    # Readers per author first; t08_sample covers the gate reader by reader.
    known = filters.read_authors(v.log).groupBy("author_norm").agg(F.count("*").alias("n_readers"))
    return (identity.with_norms(v.items).select("item_key", "author_norm", filters.open_entry().alias("open_entry"))
            .join(known, "author_norm", "left").fillna(0, ["n_readers"]).drop("author_norm"))


@query("f04_genre_filter", "SELECT item_key FROM items WHERE lower(primary_genre) = 'economy' OR lower(secondary_genre) = 'economy'")
def f04(v):
    return v.items.filter(filters.in_genres(["Economy"], secondary=True)).select("item_key")


@query("f05_hard_filters", "SELECT item_key FROM items WHERE rating >= 3.8 AND indie AND series_status IN ('Standalone', 'Short Series')")
def f05(v):
    return filters.quality_items(v.items, indie=True, statuses=["standalone", "short", "other"]).select("item_key")


@query("f06_floors_and_caps", """SELECT item_key FROM items WHERE coalesce(rating, 0) >= 3.5 AND coalesce(reviews, 0) >= 1000 AND (coalesce(pages, 0) = 0 OR pages BETWEEN 200 AND 700) AND classic""")
def f06(v):
    return v.items.filter(filters.within_limits(3.5, 1000, 700, 200, ["classic"])).select("item_key")


def notes(v):
    return markdown.preference_notes(v.sql(_PROFILE)).withColumnRenamed("doc_id", "reader_id")


def negatives(v):
    """Cold tags of a reader: members of the demoted vectors."""
    return v.vectors.filter("status = 'demoted'").join(v.vector_members, ["reader_id", "vector"])


_COLD = """SELECT p.reader_id, p.item_key, string_agg(DISTINCT t.tag, '|' ORDER BY t.tag) AS flags FROM list_items p
JOIN good_tags t ON t.item_key = p.item_key JOIN vectors v ON v.reader_id = p.reader_id AND v.status = 'demoted'
JOIN vector_members m ON m.reader_id = v.reader_id AND m.vector = v.vector AND m.kind = t.kind AND m.tag = t.tag GROUP BY 1, 2"""


@query("f07_soft_warnings", f"""WITH w AS (SELECT b.reader_id, b.item_key, n.n, CASE WHEN n.kind = 'page_cap' AND b.pages > n.page_limit THEN 'pages:' || CAST(b.pages AS VARCHAR) || '>' || CAST(n.page_limit AS VARCHAR) || ' ' || n.raw
  WHEN n.kind = 'avoid' AND ((n.tag = 'indie' AND b.indie) OR (n.tag = 'classic' AND b.classic)) THEN 'avoids:' || n.tag || ' ' || n.raw END AS warning FROM list_books b JOIN notes_r n ON n.reader_id = b.reader_id),
a AS (SELECT reader_id, item_key, string_agg(warning, ' / ' ORDER BY n, warning) AS warnings FROM w WHERE warning IS NOT NULL GROUP BY 1, 2), c AS ({_COLD})
SELECT coalesce(a.reader_id, c.reader_id) AS reader_id, coalesce(a.item_key, c.item_key) AS item_key, warnings, flags FROM a FULL JOIN c ON c.reader_id = a.reader_id AND c.item_key = a.item_key""")
def f07(v):
    picked = listed(v)
    found = filters.warnings(picked, notes(v), v.items).groupBy("reader_id", "item_key").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("n", "warning")))["warning"], " / ").alias("warnings"))
    cold = filters.negative_flags(picked, v.item_tags, negatives(v)).withColumn("flags", F.array_join("flags", "|"))
    return found.join(cold, ["reader_id", "item_key"], "full")


@query("f07_negative_flags", _COLD)
def f07b(v):
    return filters.negative_flags(listed(v), v.item_tags, negatives(v)).withColumn("flags", F.array_join("flags", "|"))


@query("f08_audit_band", """SELECT item_key FROM items i WHERE indie IS NOT TRUE AND reviews > 100 AND reviews <= 15000
  AND coalesce((SELECT max(reviews) FROM items a WHERE a.author = i.author), 0) <= 50000""")
def f08(v):
    return filters.indie_audit_candidates(v.items, floor=100).select("item_key")


@query("f09_deep_cut", """SELECT item_key, coalesce((reviews > 0 AND reviews < 1500 AND rating >= 4.2) OR indie OR (classic AND reviews > 0 AND reviews < 50000)
  OR (secondary_genre <> primary_genre AND secondary_genre IN ('promo', 'large')), false) AS deep_cut FROM items""")
def f09(v):
    return v.items.select("item_key", filters.deep_cut(["Promo", "large"]).alias("deep_cut"))


_LISTS = """SELECT item_key, CASE WHEN kind = 'signal' THEN polarity ELSE kind END AS child, pos, tag FROM item_tags WHERE kind <> 'flag'
UNION ALL SELECT item_key, 'theme', pos + 10, tag FROM item_tags WHERE kind = 'theme'"""


@query("f10_closed_vocabulary", f"""SELECT item_key, child, tag, min(pos) AS pos FROM ({_LISTS}) l
WHERE tag IN (SELECT tag FROM vector_members) GROUP BY 1, 2, 3""")
def f10(v):
    return filters.closed_vocabulary(v.sql(_LISTS), v.vector_members)


@query("f11_membership_probes", f"""WITH p AS (SELECT DISTINCT reader_id, title, author, {duck.norm_old('title')} AS t, {duck.norm_old('author')} AS a FROM picks
  UNION SELECT DISTINCT reader_id, title, author, {duck.norm_old('title')}, {duck.norm_old('author')} FROM feedback),
l AS (SELECT DISTINCT reader_id, {duck.norm_old('title')} AS t, {duck.norm_old('author')} AS a FROM log),
k AS (SELECT DISTINCT reader_id, {duck.norm_old('title')} AS t, {duck.norm_old('author')} AS a FROM picks),
s AS (SELECT DISTINCT reader_id, title_norm AS t, author_norm AS a FROM ledger)
SELECT p.reader_id, p.title, p.author, l.t IS NOT NULL AS is_read, k.t IS NOT NULL AS is_listed, s.t IS NOT NULL AS is_shown FROM p
LEFT JOIN l USING (reader_id, t, a) LEFT JOIN k USING (reader_id, t, a) LEFT JOIN s USING (reader_id, t, a)""")
def f11(v):
    asked = v.picks.select("reader_id", "title", "author").union(v.feedback.select("reader_id", "title", "author")).distinct()
    return filters.memberships(asked, v.log, v.picks, v.sql(_MARKS)).drop("title_norm", "author_norm")


@query("u01_exclusion_union", f"""SELECT DISTINCT reader_id, {duck.norm_old('title')} AS title_norm, {duck.norm_old('author')} AS author_norm FROM
  (SELECT reader_id, title, author FROM log UNION ALL SELECT reader_id, title, author FROM picks UNION ALL SELECT reader_id, title, author FROM feedback)""")
def u01(v):
    return filters.exclusion_pairs(v.log, v.picks, v.sql(_MARKS))


@query("u02_tag_sets", """WITH a AS (SELECT item_key, list_sort(list(tag)) AS tags FROM good_tags GROUP BY 1)
SELECT l.src_key, l.dst_key, array_to_string(list_sort(list_intersect(s.tags, d.tags)), '|') AS shared,
  CAST(len(list_distinct(list_concat(s.tags, d.tags))) AS BIGINT) AS n_union, array_to_string(list_filter(s.tags, lambda t: NOT list_contains(d.tags, t)), '|') AS only_src
FROM item_links l JOIN a s ON s.item_key = l.src_key JOIN a d ON d.item_key = l.dst_key""")
def u02(v):
    lists = reader.positive_tags(v.item_tags).groupBy("item_key").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    pairs = (v.item_links.join(lists.select(F.col("item_key").alias("src_key"), F.col("tags").alias("a")), "src_key")
             .join(lists.select(F.col("item_key").alias("dst_key"), F.col("tags").alias("b")), "dst_key"))
    return pairs.select("src_key", "dst_key", F.array_join(F.array_sort(F.array_intersect("a", "b")), "|").alias("shared"),
                        F.size(F.array_union("a", "b")).cast("bigint").alias("n_union"),
                        F.array_join(F.array_except("a", "b"), "|").alias("only_src"))
