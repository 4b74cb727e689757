"""Scores, strata, slots and samples for every reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.operators import filters, reader
from bookloom.operators.common import settle
from bookloom.plans import recommend
from testbed import duck
from testbed.queries_reader import anchor_parts, listed, log, negatives, notes, resolved, risk, coverage
from testbed.registry import TODAY, query

duck.TABLES.update({
    "pick_scores": f"""SELECT p.reader_id, p.item_key, {duck.rounded_sum('greatest(-1.0, least(1.0, e.effective - 4.1))', 's.strength', '0.6 * least(coalesce(f.n, 0), 3)')} AS score FROM list_items p JOIN effective e ON e.item_key = p.item_key
LEFT JOIN pick_strength s ON s.reader_id = p.reader_id AND s.item_key = p.item_key
LEFT JOIN (SELECT f.reader_id, l.src_key, count(*) AS n FROM item_links l JOIN liked f ON f.item_key = l.dst_key GROUP BY 1, 2) f ON f.reader_id = p.reader_id AND f.src_key = p.item_key""",
    "v_size": "SELECT reader_id, vector, count(*) AS size, CAST(greatest(2, least(ceil(count(*) / 2), 3)) AS BIGINT) AS threshold FROM active_members GROUP BY 1, 2",
})


def pick_scores(v):
    strength = reader.anchor_strength(listed(v), reader.positive_tags(v.item_tags),
                                      reader.anchor_groups(anchor_parts(v)[1]))
    links = reader.link_overlap(v.item_links, reader.favourites(resolved(v)))
    return recommend.score_items(listed(v), v.items, strength, links)


@query("t02_score", "SELECT * FROM pick_scores")
def t02(v):
    return pick_scores(v)


@query("w08_tie_chunks", """SELECT reader_id, item_key, score, CAST(sum(o) OVER (PARTITION BY reader_id ORDER BY score DESC) AS BIGINT) AS chunk FROM (
  SELECT *, CASE WHEN CAST(round(lag(score) OVER (PARTITION BY reader_id ORDER BY score DESC) * 1000) AS BIGINT) - CAST(round(score * 1000) AS BIGINT) > 150 THEN 1 ELSE 0 END AS o FROM pick_scores)""")
def w08(v):
    scored = pick_scores(v)
    return scored.join(recommend.tie_chunks(scored, ["reader_id"]), ["reader_id", "score"]).select(
        "reader_id", "item_key", "score", "chunk")


@query("t04_strata", """WITH v AS (SELECT o.reader_id, o.item_key, 'vector:' || o.vector AS stratum FROM pick_overlap o JOIN underused u ON u.reader_id = o.reader_id AND u.vector = o.vector),
f AS (SELECT DISTINCT b.reader_id, b.item_key, 'floor:' || r.name AS stratum FROM list_books b JOIN risk r ON r.reader_id = b.reader_id AND r.remaining > 0
  AND CASE WHEN r.name = 'indie' THEN b.indie WHEN r.name = 'classic' THEN b.classic ELSE lower(b.primary_genre) = lower(r.name) OR lower(b.secondary_genre) = lower(r.name) END)
SELECT * FROM v UNION ALL SELECT * FROM f UNION ALL SELECT p.reader_id, p.item_key, 'residual' FROM list_items p
WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.reader_id = p.reader_id AND v.item_key = p.item_key) AND NOT EXISTS (SELECT 1 FROM f WHERE f.reader_id = p.reader_id AND f.item_key = p.item_key)""")
def t04(v):
    """Strata of the readers' list items; the pool uses the same functions."""
    picks = listed(v)
    overlap = reader.vector_overlap(picks, v.item_tags, reader.active_members(v.vectors, v.vector_members))
    under = reader.underused_vectors(coverage(v), v.reader_state)
    # Read by both branches; written, the overlaps and floors are worked out once.
    hits = settle(recommend.vector_strata(overlap, under, "item_key").unionByName(
        recommend.floor_strata(picks, v.items, risk(v))), "list-strata")
    rest = picks.join(hits, ["reader_id", "item_key"], "left_anti").withColumn("stratum", F.lit("residual"))
    return hits.unionByName(rest.select("reader_id", "item_key", "stratum"))


@query("t05_adjacency", """WITH c AS (SELECT o.*, row_number() OVER (PARTITION BY o.reader_id, o.item_key ORDER BY overlap DESC, o.vector) AS r FROM pick_overlap o JOIN v_size s ON s.reader_id = o.reader_id AND s.vector = o.vector AND o.overlap >= s.threshold),
b AS (SELECT reader_id, item_key, vector, overlap FROM c WHERE r = 1),
x AS (SELECT b.*, t.kind, t.tag FROM b JOIN good_tags t ON t.item_key = b.item_key WHERE NOT EXISTS (SELECT 1 FROM active_members m WHERE m.reader_id = b.reader_id AND m.vector = b.vector AND m.kind = t.kind AND m.tag = t.tag))
SELECT x.reader_id, x.item_key, x.vector, x.overlap, min(m.vector) AS bridges_to, CASE WHEN min(m.vector) IS NULL THEN 'new-direction' ELSE 'bridge' END AS divergence
FROM x LEFT JOIN active_members m ON m.reader_id = x.reader_id AND m.vector <> x.vector AND m.kind = x.kind AND m.tag = x.tag GROUP BY 1, 2, 3, 4""")
def t05(v):
    live = reader.active_members(v.vectors, v.vector_members)
    overlap = reader.vector_overlap(listed(v), v.item_tags, live)
    return recommend.adjacency(overlap, reader.positive_tags(v.item_tags), live, "item_key")


_STRATA = """SELECT reader_id, mode, stratum, row_number() OVER (PARTITION BY reader_id ORDER BY o, stratum) AS ord FROM (
  SELECT v.reader_id, CASE v.reader_id % 5 WHEN 0 THEN 'focused' WHEN 1 THEN 'similar' WHEN 2 THEN 'balanced' WHEN 3 THEN 'broad' ELSE 'adjacent' END AS mode,
    CASE WHEN v.reader_id % 5 = 4 THEN 'adjacent:' ELSE 'vector:' END || v.vector AS stratum, v.ord AS o FROM vectors v WHERE coalesce(v.status, 'x') <> 'demoted'
  UNION ALL SELECT f.reader_id, CASE f.reader_id % 5 WHEN 0 THEN 'focused' WHEN 1 THEN 'similar' WHEN 2 THEN 'balanced' ELSE 'broad' END, 'floor:' || f.name, 100 FROM floors f WHERE f.reader_id % 5 <> 4
  UNION ALL SELECT s.reader_id, CASE s.reader_id % 5 WHEN 0 THEN 'focused' WHEN 1 THEN 'similar' WHEN 2 THEN 'balanced' WHEN 3 THEN 'broad' ELSE 'adjacent' END, 'residual', 1000 FROM reader_state s)"""


def slots_sql(strata: str, seed: str, lean: str = "1.0e0") -> str:
    """Slots per reader and stratum for strata(reader_id, mode, stratum, ord)."""
    def draw(tag):
        return duck.hash01(f"'{seed}'", f"'{tag}'", "CAST(reader_id AS VARCHAR)", "stratum")
    return f"""WITH a AS (SELECT *, CASE WHEN mode = 'focused' AND starts_with(stratum, 'vector:') THEN {draw('focus')} END AS pick FROM ({strata})),
b AS (SELECT *, (CASE WHEN pick = min(pick) OVER p THEN 6.0 WHEN mode = 'adjacent' AND starts_with(stratum, 'adjacent:') THEN 1.5 WHEN mode = 'adjacent' THEN 0.5 ELSE 1.0 END)
  * {lean} * (({draw('jitter')} * 2 - 1) * CASE WHEN mode IN ('balanced', 'broad') THEN 0.2 ELSE 0.1 END + 1.0) AS w FROM a WINDOW p AS (PARTITION BY reader_id)),
c AS (SELECT *, w / sum(w) OVER (PARTITION BY reader_id) * 15 AS raw FROM b),
d AS (SELECT *, floor(raw) + CASE WHEN row_number() OVER (PARTITION BY reader_id ORDER BY raw - floor(raw) DESC, ord) <= 15 - sum(floor(raw)) OVER (PARTITION BY reader_id) THEN 1 ELSE 0 END AS one FROM c),
e AS (SELECT *, CASE mode WHEN 'balanced' THEN 3 WHEN 'broad' THEN 6 END AS target, max(CASE WHEN stratum = 'residual' THEN one END) OVER p AS now,
  count(*) FILTER (stratum <> 'residual') OVER p AS k, sum(one) FILTER (stratum <> 'residual') OVER p AS osum FROM d WINDOW p AS (PARTITION BY reader_id)),
f AS (SELECT *, CASE WHEN stratum = 'residual' THEN NULL WHEN osum > 0 THEN floor((15 - target) * one / osum) ELSE 0 END AS two FROM e),
g AS (SELECT *, 15 - target - sum(two) OVER (PARTITION BY reader_id) AS rest, row_number() OVER (PARTITION BY reader_id ORDER BY CASE WHEN stratum = 'residual' THEN 1 ELSE 0 END, one DESC, ord) AS rk FROM f)
SELECT reader_id, mode, stratum, ord, CAST(CASE WHEN target IS NULL OR k = 0 OR now IS NULL OR now = target THEN one WHEN stratum = 'residual' THEN target
  ELSE two + floor(rest / k) + CASE WHEN rk <= rest % k THEN 1 ELSE 0 END END AS BIGINT) AS slots FROM g"""


@query("t06_slots", slots_sql(_STRATA, "7", "CASE WHEN stratum = CASE WHEN mode = 'adjacent' THEN 'adjacent:v1' ELSE 'vector:v1' END THEN 2.0 ELSE 1.0 END"))
def t06(v):
    strata = v.sql(_STRATA).withColumn("ord", F.col("ord").cast("bigint"))
    return recommend.allocate(strata, 15, lean="vector:v1", seed=7)


def recommender(v, **options):
    columns = ["log_id", "reader_id", "title", "author", "rating", "read_on", "logged_on", "my_tags"]
    return recommend.Recommender(v.items, v.item_tags, v.item_links, log(v).select(*columns), v.picks, v.feedback,
                                 v.vectors, v.vector_members, v.reader_state, v.floors, today=TODAY, seed=11, **options)


# ---- the sample again in SQL, from every reader-item pair

_TERM = "greatest(-1.0, least(1.0, e.effective - 4.1))"
_TOSS = duck.hash01("'11'", f"CAST(CAST(floor({duck.hash01(chr(39) + '11' + chr(39), chr(39) + 'order of ties' + chr(39), 'CAST(reader_id AS VARCHAR)')} * 16) AS BIGINT) AS VARCHAR)", "stratum", "item_key")
duck.TABLES.update({
    "good_items": f"""SELECT i.*, coalesce({_TERM}, 0) AS term, g.an AS gate_an, g.open_entry FROM items i JOIN effective e ON e.item_key = i.item_key JOIN gate g ON g.item_key = i.item_key WHERE i.rating >= 3.8 AND i.title IS NOT NULL""",
    "read_authors": "SELECT DISTINCT reader_id, an FROM log_n WHERE title <> ''",
    "near_overlap": """SELECT m.reader_id, t.item_key, m.vector, v.ord, count(*) AS overlap FROM active_members m JOIN active_vectors v ON v.reader_id = m.reader_id AND v.vector = m.vector
JOIN good_tags t ON t.kind = m.kind AND t.tag = m.tag JOIN good_items i ON i.item_key = t.item_key GROUP BY ALL""",
    "offers": """SELECT s.reader_id, s.appetite, i.item_key, i.term, n.item_key IS NOT NULL AS near FROM reader_state s JOIN (SELECT DISTINCT reader_id FROM active_members) o ON o.reader_id = s.reader_id
CROSS JOIN good_items i LEFT JOIN (SELECT DISTINCT reader_id, item_key FROM near_overlap) n ON n.reader_id = s.reader_id AND n.item_key = i.item_key
WHERE (i.open_entry OR EXISTS (SELECT 1 FROM read_authors l WHERE l.reader_id = s.reader_id AND l.an = i.gate_an)) AND NOT EXISTS (SELECT 1 FROM excl x WHERE x.reader_id = s.reader_id AND x.item_key = i.item_key)""",
    "offer_strength": """SELECT reader_id, item_key, least(sum(weight), 1.5) AS strength FROM (SELECT DISTINCT n.reader_id, n.item_key, a.item_key AS anchor, a.weight
  FROM (SELECT DISTINCT reader_id, item_key FROM near_overlap) n JOIN good_tags t ON t.item_key = n.item_key JOIN anchor_tags a ON a.reader_id = n.reader_id AND a.kind = t.kind AND a.tag = t.tag) GROUP BY 1, 2""",
    "offer_links": "SELECT f.reader_id, l.src_key AS item_key, count(*) AS n FROM item_links l JOIN liked f ON f.item_key = l.dst_key GROUP BY 1, 2",
    "offer_scores": f"""SELECT o.*, {duck.rounded_sum('o.term', 's.strength', '0.6 * least(coalesce(f.n, 0), 3)')} AS score FROM offers o
LEFT JOIN offer_strength s ON s.reader_id = o.reader_id AND s.item_key = o.item_key LEFT JOIN offer_links f ON f.reader_id = o.reader_id AND f.item_key = o.item_key""",
    "offer_floors": """SELECT DISTINCT o.reader_id, o.item_key, 'floor:' || r.name AS stratum FROM offers o JOIN good_items b ON b.item_key = o.item_key JOIN risk r ON r.reader_id = o.reader_id AND r.remaining > 0
  AND CASE WHEN r.kind = 'tag' THEN CASE r.name WHEN 'indie' THEN b.indie WHEN 'classic' THEN b.classic END ELSE lower(b.primary_genre) = lower(r.name) OR lower(b.secondary_genre) = lower(r.name) END WHERE o.near""",
    "offer_vectors": "SELECT o.reader_id, o.item_key, 'vector:' || n.vector AS stratum FROM offers o JOIN near_overlap n ON n.reader_id = o.reader_id AND n.item_key = o.item_key JOIN underused u ON u.reader_id = n.reader_id AND u.vector = n.vector",
    "edge_items": """SELECT b.reader_id, b.item_key, 'adjacent:' || b.vector AS stratum FROM (SELECT n.*, row_number() OVER (PARTITION BY n.reader_id, n.item_key ORDER BY n.overlap DESC, n.ord, n.vector) AS r
  FROM near_overlap n JOIN v_size s ON s.reader_id = n.reader_id AND s.vector = n.vector AND n.overlap >= s.threshold) b JOIN offers o ON o.reader_id = b.reader_id AND o.item_key = b.item_key
WHERE b.r = 1 AND EXISTS (SELECT 1 FROM good_tags t WHERE t.item_key = b.item_key AND NOT EXISTS (SELECT 1 FROM active_members m WHERE m.reader_id = b.reader_id AND m.vector = b.vector AND m.kind = t.kind AND m.tag = t.tag))""",
})


def sample_sql(adjacent: bool) -> str:
    """(reader_id, place, item_key, stratum, score): ranks, slots and the greedy fill."""
    mode = "'adjacent'" if adjacent else "CASE s.appetite WHEN 'high' THEN 'broad' WHEN 'low' THEN 'similar' ELSE 'balanced' END"
    strata = "SELECT reader_id, item_key, stratum FROM edge_items" if adjacent else """SELECT * FROM offer_vectors UNION ALL SELECT * FROM offer_floors
  UNION ALL SELECT o.reader_id, o.item_key, 'residual' FROM offers o WHERE (o.near OR o.appetite <> 'low')
    AND NOT EXISTS (SELECT 1 FROM offer_vectors v WHERE v.reader_id = o.reader_id AND v.item_key = o.item_key) AND NOT EXISTS (SELECT 1 FROM offer_floors f WHERE f.reader_id = o.reader_id AND f.item_key = o.item_key)"""
    ords = """SELECT z.reader_id, z.mode, z.stratum, z.size, row_number() OVER (PARTITION BY z.reader_id ORDER BY CASE WHEN z.stratum = 'residual' THEN 1099511627776 WHEN z.stratum = 'floor:indie' THEN 1000 WHEN z.stratum = 'floor:classic' THEN 1001
  WHEN starts_with(z.stratum, 'floor:') THEN 1002 ELSE v.ord END, z.stratum) AS ord FROM sizes z LEFT JOIN vectors v ON v.reader_id = z.reader_id AND z.stratum IN ('vector:' || v.vector, 'adjacent:' || v.vector)"""
    return f"""WITH placed AS MATERIALIZED (SELECT x.reader_id, x.stratum, x.item_key, o.score FROM ({strata}) x JOIN offer_scores o ON o.reader_id = x.reader_id AND o.item_key = x.item_key),
chunks AS (SELECT reader_id, stratum, score, sum(CASE WHEN d > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY reader_id, stratum ORDER BY score DESC) AS chunk FROM (SELECT *,
  lag(CAST(round(score * 1000) AS BIGINT)) OVER (PARTITION BY reader_id, stratum ORDER BY score DESC) - CAST(round(score * 1000) AS BIGINT) AS d FROM (SELECT DISTINCT reader_id, stratum, score FROM placed))),
ranked AS MATERIALIZED (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.reader_id, p.stratum ORDER BY c.chunk, p.toss, p.item_key) AS rank FROM (SELECT *, {_TOSS} AS toss FROM placed) p
  JOIN chunks c ON c.reader_id = p.reader_id AND c.stratum = p.stratum AND c.score = p.score) WHERE rank <= 15),
sizes AS (SELECT p.reader_id, p.stratum, {mode} AS mode, count(*) AS size FROM placed p JOIN reader_state s ON s.reader_id = p.reader_id GROUP BY ALL),
ords AS MATERIALIZED ({ords}),
slots AS MATERIALIZED (SELECT * FROM ({slots_sql('SELECT reader_id, mode, stratum, ord FROM ords', '11')})),
steps AS MATERIALIZED (SELECT reader_id, stratum, item_key, slots, phase, row_number() OVER (PARTITION BY reader_id ORDER BY phase, k, ord, rank) AS i FROM (
  SELECT r.reader_id, r.stratum, r.item_key, l.slots, u.phase, CASE u.phase WHEN 1 THEN 0 ELSE -o.size END AS k, o.ord, r.rank FROM ranked r JOIN ords o ON o.reader_id = r.reader_id AND o.stratum = r.stratum
  JOIN slots l ON l.reader_id = r.reader_id AND l.stratum = r.stratum CROSS JOIN (VALUES (1), (2)) u(phase))),
walked AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE f AS (SELECT DISTINCT reader_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS keys, CAST([] AS VARCHAR[]) AS names FROM steps
  UNION ALL SELECT s.reader_id, s.i, CASE WHEN s.ok THEN list_append(keys, s.item_key) ELSE keys END, CASE WHEN s.ok THEN list_append(names, s.stratum) ELSE names END FROM (
    SELECT s.*, f.keys, f.names, NOT list_contains(f.keys, s.item_key) AND CASE s.phase WHEN 1 THEN len(list_filter(f.names, lambda x: x = s.stratum)) < s.slots ELSE len(f.keys) < 15 END AS ok
    FROM f JOIN steps s ON s.reader_id = f.reader_id AND s.i = f.i + 1) s)
  SELECT * FROM f) WHERE (reader_id, i) IN (SELECT reader_id, max(i) FROM steps GROUP BY 1)),
chosen AS (SELECT reader_id, unnest(keys) AS item_key, unnest(names) AS stratum FROM walked)
SELECT c.reader_id, row_number() OVER (PARTITION BY c.reader_id ORDER BY {duck.hash01("'11'", "'order'", "c.item_key")}, c.item_key) AS place, c.item_key, c.stratum, o.score
FROM chosen c JOIN offer_scores o ON o.reader_id = c.reader_id AND o.item_key = c.item_key"""


def _chunked(strata: str) -> str:
    """(reader_id, stratum, item_key, score, chunk) of the matching pool in these strata."""
    return f"""WITH p AS MATERIALIZED (SELECT x.reader_id, x.stratum, x.item_key, o.score FROM ({strata}) x JOIN offer_scores o ON o.reader_id = x.reader_id AND o.item_key = x.item_key WHERE o.near),
c AS (SELECT reader_id, stratum, score, CAST(sum(CASE WHEN d > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY reader_id, stratum ORDER BY score DESC) AS BIGINT) AS chunk FROM (SELECT *,
  lag(CAST(round(score * 1000) AS BIGINT)) OVER (PARTITION BY reader_id, stratum ORDER BY score DESC) - CAST(round(score * 1000) AS BIGINT) AS d FROM (SELECT DISTINCT reader_id, stratum, score FROM p)))
SELECT p.*, c.chunk FROM p JOIN c ON c.reader_id = p.reader_id AND c.stratum = p.stratum AND c.score = p.score"""


@query("t04_pool_strata", _chunked("""SELECT * FROM offer_vectors UNION ALL SELECT * FROM offer_floors UNION ALL SELECT o.reader_id, o.item_key, 'residual' FROM offers o
  WHERE NOT EXISTS (SELECT 1 FROM offer_vectors v WHERE v.reader_id = o.reader_id AND v.item_key = o.item_key) AND NOT EXISTS (SELECT 1 FROM offer_floors f WHERE f.reader_id = o.reader_id AND f.item_key = o.item_key)"""))
def t04p(v):
    """Score, stratum and tie chunk of every item of every reader's matching pool."""
    return recommender(v, variance="similar").strata()


@query("t05_pool_adjacency", _chunked("SELECT reader_id, item_key, stratum FROM edge_items"))
def t05p(v):
    """The pool's items that are central to a vector and pull outside it."""
    return recommender(v, variance="adjacent").strata()


@query("t07_stratified_sample", sample_sql(True))
def t07(v):
    """Sample in adjacent mode: readers' edge picks."""
    return recommender(v, variance="adjacent").run()["chosen"]


@query("t08_sample", sample_sql(False))
def t08s(v):
    """Sample in the mode of each reader's appetite."""
    return recommender(v).run()["chosen"]


@query("t08_recommend", f"""WITH s AS ({sample_sql(False)}), t AS (SELECT reader_id, stratum, count(*) AS n FROM s GROUP BY 1, 2),
m AS (SELECT s.reader_id, s.item_key, string_agg(n.vector, '|' ORDER BY n.ord, n.vector) AS vectors, string_agg(CASE WHEN u.vector IS NOT NULL THEN n.vector END, '|' ORDER BY n.ord, n.vector) AS fills
  FROM s JOIN near_overlap n ON n.reader_id = s.reader_id AND n.item_key = s.item_key LEFT JOIN underused u ON u.reader_id = n.reader_id AND u.vector = n.vector GROUP BY 1, 2),
a AS (SELECT reader_id, item_key, string_agg(title, '|' ORDER BY place) AS titles FROM (SELECT h.*, i.title, row_number() OVER (PARTITION BY h.reader_id, h.item_key ORDER BY round(h.weight, 9) DESC, h.anchor) AS place FROM (
  SELECT DISTINCT s.reader_id, s.item_key, x.item_key AS anchor, x.weight FROM s JOIN good_tags g ON g.item_key = s.item_key JOIN anchor_tags x ON x.reader_id = s.reader_id AND x.kind = g.kind AND x.tag = g.tag) h JOIN items i ON i.item_key = h.anchor) WHERE place <= 5 GROUP BY 1, 2)
SELECT s.reader_id, s.place, s.item_key, s.stratum, s.score, t.n AS stratum_count, CASE r.appetite WHEN 'high' THEN 'broad' WHEN 'low' THEN 'similar' ELSE 'balanced' END AS mode, i.title, i.pages, m.vectors AS matched_vectors, m.fills AS fills_vectors,
  coalesce(l.n, 0) AS links, a.titles AS resonance, m.vectors IS NULL AS is_residual, p.pool_size FROM s JOIN t ON t.reader_id = s.reader_id AND t.stratum = s.stratum JOIN reader_state r ON r.reader_id = s.reader_id JOIN items i ON i.item_key = s.item_key
LEFT JOIN m ON m.reader_id = s.reader_id AND m.item_key = s.item_key LEFT JOIN a ON a.reader_id = s.reader_id AND a.item_key = s.item_key LEFT JOIN offer_links l ON l.reader_id = s.reader_id AND l.item_key = s.item_key
JOIN (SELECT reader_id, CAST(count(*) AS BIGINT) AS pool_size FROM pool_pairs GROUP BY 1) p ON p.reader_id = s.reader_id""")
def t08(v):
    """Recommendations with their main reasons; the whole projection is t08_projection."""
    rec = recommender(v)
    rows = recommend.projection(rec, rec.run())
    return rows.select("reader_id", "place", "item_key", "stratum", "score", "stratum_count", "mode", "title", "pages",
                       *[F.array_join(c, "|").alias(c) for c in ("matched_vectors", "fills_vectors")],
                       F.coalesce("links", F.lit(0)).alias("links"), F.array_join("resonance", "|").alias("resonance"),
                       "is_residual", "pool_size")


@query("t08_projection")
def t08p(v):
    """Every column of the projection; its parts have oracles in g10, t05, f07 and t08_recommend."""
    rec = recommender(v)
    rows = recommend.projection(rec, rec.run(), notes(v), negatives(v))
    lists = ["matched_vectors", "fills_vectors", "fills_floors", "matched_themes", "warnings", "flags", "resonance"]
    return rows.withColumns({c: F.array_join(c, "|") for c in lists})


duck.TABLES["pool_pairs"] = """SELECT s.reader_id, i.item_key FROM reader_state s JOIN items i ON i.rating >= 3.8
JOIN gate g ON g.item_key = i.item_key AND (g.open_entry OR EXISTS (SELECT 1 FROM log_n l WHERE l.reader_id = s.reader_id AND l.an = g.an))
WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.reader_id = s.reader_id AND e.item_key = i.item_key)
  AND (s.appetite <> 'low' OR EXISTS (SELECT 1 FROM rel_pairs r WHERE r.reader_id = s.reader_id AND r.item_key = i.item_key))
  AND EXISTS (SELECT 1 FROM active_members m WHERE m.reader_id = s.reader_id)"""


@query("u04_pool_sizes", "SELECT reader_id, CAST(count(*) AS BIGINT) AS pool_size FROM pool_pairs GROUP BY 1")
def u04(v):
    """Matching pool plus the relaxed pool minus it, per reader."""
    return recommender(v).run()["pool_size"]
