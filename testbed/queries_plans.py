"""Calibration, swaps, status, scope and the older batch picker, for every reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.operators import filters, reader
from bookloom.operators.common import settle
from bookloom.plans import calibrate, decide
from bookloom.sources import markdown
from testbed import duck
from testbed.queries_reader import anchor_parts, listed, log, marks, resolved
from testbed.registry import query

duck.TABLES.update({
    "ex_items": f"""SELECT title, item_key FROM (SELECT t.title, k.item_key, row_number() OVER (PARTITION BY t.title ORDER BY t.prio, k.rev0 DESC, k.item_key) AS r
  FROM (SELECT title, unnest([1, 2, 3]) AS prio, unnest([1, 1, 2]) AS pass, unnest([tn, ts, {duck.fold('tn')}]) AS k FROM (
    SELECT DISTINCT title, {duck.norm('title')} AS tn, {duck.short('title')} AS ts FROM vector_examples)) t JOIN item_keys_n k ON k.pass = t.pass AND k.k = t.k) WHERE r = 1""",
    "derived": """SELECT reader_id, vector, kind, tag FROM (SELECT *, max(n) OVER (PARTITION BY reader_id, vector, kind) AS most FROM (
  SELECT e.reader_id, e.vector, t.kind, t.tag, count(*) AS n FROM vector_examples e JOIN ex_items x ON x.title = e.title JOIN good_tags t ON t.item_key = x.item_key GROUP BY 1, 2, 3, 4)) WHERE n >= 2 OR most < 2""",
    "cal_members": """SELECT reader_id, vector, kind, tag FROM active_members UNION ALL SELECT d.* FROM derived d JOIN active_vectors v ON v.reader_id = d.reader_id AND v.vector = d.vector
WHERE NOT EXISTS (SELECT 1 FROM active_members m WHERE m.reader_id = d.reader_id AND m.vector = d.vector)""",
    "cal_size": "SELECT reader_id, vector, count(*) AS size, CAST(greatest(2, least(ceil(count(*) / 2), 3)) AS BIGINT) AS threshold FROM cal_members GROUP BY 1, 2",
    "cal_reads": "SELECT reader_id, log_id, item_key, rating FROM log_r WHERE rating <> 0 AND item_key IS NOT NULL",
    "cal_central": """SELECT r.reader_id, r.item_key, m.vector FROM (SELECT DISTINCT reader_id, item_key FROM cal_reads) r JOIN good_tags t ON t.item_key = r.item_key
JOIN cal_members m ON m.reader_id = r.reader_id AND m.kind = t.kind AND m.tag = t.tag JOIN cal_size s ON s.reader_id = m.reader_id AND s.vector = m.vector
GROUP BY 1, 2, 3, s.threshold HAVING count(*) >= s.threshold""",
    "cal_scored": """SELECT r.*, coalesce(c.v, 0) * count(*) OVER (PARTITION BY r.reader_id, r.item_key) AS central FROM cal_reads r
LEFT JOIN (SELECT reader_id, item_key, count(*) AS v FROM cal_central GROUP BY 1, 2) c ON c.reader_id = r.reader_id AND c.item_key = r.item_key""",
    "cal_base": """SELECT reader_id, count(*) AS n_reads, avg(rating) AS mean, stddev_pop(rating) AS stdev, avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END) AS share_high FROM cal_reads GROUP BY 1 HAVING count(*) >= 5""",
    "cal_ref": """SELECT b.reader_id, b.n_reads, b.mean AS baseline, CASE WHEN count(*) FILTER (central = 0) >= 5 THEN avg(rating) FILTER (central = 0) ELSE b.mean END AS ref,
  coalesce(avg(rating) FILTER (central > 0), b.mean) AS matched FROM cal_scored s JOIN cal_base b ON b.reader_id = s.reader_id GROUP BY 1, 2, b.mean""",
    "cal_neg": """SELECT x.*, r.baseline, mean <= baseline - 0.5 AS low_rated, coalesce(expected >= 4 AND mean_expected <= matched - 0.5, false) AS drags,
  round_even(round(greatest(baseline - mean, coalesce(matched - mean_expected, 0)), 9), 4) AS severity FROM (
  SELECT s.reader_id, t.kind, t.tag, count(*) AS support, count(*) FILTER (central >= 1) AS expected, avg(rating) AS mean, avg(rating) FILTER (central >= 1) AS mean_expected
  FROM cal_scored s JOIN good_tags t ON t.item_key = s.item_key GROUP BY 1, 2, 3 HAVING count(*) >= 4) x JOIN cal_ref r ON r.reader_id = x.reader_id
WHERE mean <= baseline - 0.5 OR coalesce(expected >= 4 AND mean_expected <= matched - 0.5, false)""",
    "cal_sets": "SELECT reader_id, vector, count(*) AS n FROM cal_central GROUP BY 1, 2",
    "cal_pairs": """SELECT * FROM (SELECT p.reader_id, p.a, p.b, p.shared, CAST(p.shared AS DOUBLE) / (sa.n + sb.n - p.shared) AS jaccard FROM (
  SELECT x.reader_id, x.vector AS a, y.vector AS b, count(*) AS shared FROM cal_central x JOIN cal_central y ON y.reader_id = x.reader_id AND y.item_key = x.item_key AND y.vector > x.vector GROUP BY 1, 2, 3) p
  JOIN cal_sets sa ON sa.reader_id = p.reader_id AND sa.vector = p.a JOIN cal_sets sb ON sb.reader_id = p.reader_id AND sb.vector = p.b) WHERE jaccard >= 0.4""",
})


def calibration(v):
    return calibrate.Calibration(resolved(v), v.items, v.item_tags, v.vectors, v.vector_members, v.vector_examples)


def _r(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("g14_reader_baseline", "SELECT reader_id, n_reads, round(mean, 6) AS mean, round(stdev, 5) AS stdev, round(share_high, 6) AS share_high FROM cal_base")
def g14(v):
    return _r(calibration(v).baseline(), mean=6, stdev=5, share_high=6)


@query("g15_central_membership", "SELECT reader_id, CAST(least(central, 2) AS BIGINT) AS threads, count(*) AS n, round(avg(rating), 6) AS mean FROM cal_scored GROUP BY 1, 2")
def g15(v):
    return _r(calibration(v).separation(), mean=6)


@query("g16_central_threshold", "SELECT * FROM cal_size")
def g16(v):
    return calibration(v).sizes


@query("g17_negative_signals", """SELECT reader_id, kind, tag, support, expected, round(mean, 6) AS mean, round(severity, 4) AS severity, low_rated, drags FROM cal_neg""")
def g17(v):
    return _r(calibration(v).negatives(), mean=6).drop("mean_expected", "baseline")


@query("g17_top_negatives", """WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY severity DESC, kind, tag) AS r FROM cal_neg) WHERE r <= 5),
ex AS (SELECT t.reader_id, t.kind, t.tag, s.item_key, row_number() OVER (PARTITION BY t.reader_id, t.kind, t.tag ORDER BY s.rating, s.central DESC, s.item_key) AS k
  FROM top t JOIN cal_scored s ON s.reader_id = t.reader_id JOIN good_tags g ON g.item_key = s.item_key AND g.kind = t.kind AND g.tag = t.tag)
SELECT t.reader_id, t.kind, t.tag, t.severity, (SELECT string_agg(item_key, '|' ORDER BY k) FROM ex e WHERE e.reader_id = t.reader_id AND e.kind = t.kind AND e.tag = t.tag AND k <= 3) AS examples,
  coalesce((SELECT string_agg(vector, '|' ORDER BY vector) FROM cal_members m WHERE m.reader_id = t.reader_id AND m.kind = t.kind AND m.tag = t.tag), '') AS rests_in FROM top t""")
def g17t(v):
    return calibration(v).top_negatives().select("reader_id", "kind", "tag", "severity", "examples", "rests_in")


@query("g18_redundant_vectors", "SELECT reader_id, a, b, shared, round(jaccard, 6) AS jaccard FROM cal_pairs")
def g18(v):
    return _r(calibration(v).redundant(), jaccard=6)


@query("g19_vector_verdict", """WITH m AS (SELECT c.reader_id, c.vector, count(*) AS n, avg(r.rating) AS mean FROM cal_central c JOIN cal_reads r ON r.reader_id = c.reader_id AND r.item_key = c.item_key GROUP BY 1, 2),
x AS (SELECT v.reader_id, v.vector, coalesce(s.size, 0) AS size, coalesce(s.threshold, 2) AS threshold, coalesce(m.n, 0) AS n_central, m.mean, m.mean - r.ref AS lift, coalesce(m.n, 0) / r.n_reads AS breadth,
  EXISTS (SELECT 1 FROM cal_neg k JOIN cal_members c ON c.reader_id = k.reader_id AND c.kind = k.kind AND c.tag = k.tag WHERE c.reader_id = v.reader_id AND c.vector = v.vector) AS cold,
  EXISTS (SELECT 1 FROM cal_pairs p WHERE p.reader_id = v.reader_id AND v.vector IN (p.a, p.b)) AS twin
  FROM active_vectors v JOIN cal_ref r ON r.reader_id = v.reader_id LEFT JOIN cal_size s ON s.reader_id = v.reader_id AND s.vector = v.vector LEFT JOIN m ON m.reader_id = v.reader_id AND m.vector = v.vector),
y AS (SELECT *, CASE WHEN n_central < 5 THEN 'thin' WHEN lift > 0.05 THEN 'holds' ELSE 'weak' END AS verdict, concat_ws('; ', CASE WHEN lift <= 0 THEN 'actively negative' END, CASE WHEN cold THEN 'rests on a cold tag' END) AS bad FROM x),
z AS (SELECT *, concat_ws('; ', CASE WHEN verdict = 'weak' THEN 'slight lift' END, CASE WHEN breadth >= 0.33 THEN 'broad' END, CASE WHEN twin THEN 'merge candidate' END) AS soft FROM y)
SELECT reader_id, vector, size, threshold, n_central, round_even(breadth, 3) AS breadth, breadth >= 0.33 AS too_broad, CASE WHEN verdict <> 'thin' THEN round_even(mean, 3) END AS mean,
  CASE WHEN verdict <> 'thin' THEN round_even(lift, 3) END AS lift, verdict, CASE WHEN verdict = 'thin' THEN 'keep' WHEN bad <> '' THEN 'rebuild' WHEN soft <> '' THEN 'discuss' ELSE 'keep' END AS action,
  CASE WHEN verdict = 'thin' THEN 'too few central reads' WHEN bad <> '' THEN bad ELSE soft END AS reasons FROM z""")
def g19(v):
    return calibration(v).verdicts()


@query("g20_underperformers", """SELECT reader_id, r AS rank, item_key, rating, central FROM (SELECT s.*, row_number() OVER (PARTITION BY s.reader_id ORDER BY rating, central DESC, item_key) AS r
  FROM cal_scored s JOIN cal_ref f ON f.reader_id = s.reader_id WHERE central >= 1 AND rating <= matched - 0.5) WHERE r <= 6""")
def g20(v):
    return calibration(v).underperformers()


@query("g21_core_tags", "SELECT * FROM derived")
def g21(v):
    return calibrate.core_tags(v.vector_examples, v.items, v.item_tags)


@query("g22_vector_bootstrap", f"""WITH e AS (SELECT reader_id, vector, title, author, {duck.norm('title')} AS tn, {duck.norm('author')} AS an FROM vector_examples WHERE vector <> 'v2'),
h AS (SELECT e.*, k.item_key, row_number() OVER (PARTITION BY e.reader_id, e.vector, e.title, e.author ORDER BY k.pass, k.an <> e.an, k.rev0 DESC, k.item_key) AS r
  FROM e LEFT JOIN item_keys_n k ON ((k.pass = 1 AND k.k = e.tn) OR (k.pass = 2 AND k.k = {duck.fold('e.tn')})) AND {duck.authors_match('e.an', 'k.an')}),
f AS (SELECT * FROM h WHERE r = 1)
SELECT f.reader_id AS doc_id, f.vector, coalesce(string_agg(DISTINCT t.tag, '|' ORDER BY t.tag) FILTER (t.kind = 'signal'), '') AS signals, coalesce(string_agg(DISTINCT t.tag, '|' ORDER BY t.tag) FILTER (t.kind = 'theme'), '') AS themes,
  (SELECT count(*) FROM f g WHERE g.reader_id = f.reader_id AND g.vector = f.vector AND g.item_key IS NULL) AS unresolved FROM f JOIN good_tags t ON t.item_key = f.item_key GROUP BY 1, 2""")
def g22(v):
    """Profile texts are written from the example titles, parsed back, then resolved."""
    lines = v.vector_examples.select("reader_id", "vector", "pos", F.concat(
        F.lit("- *"), "title", F.lit("* by "), "author").alias("line"))
    heads = v.vectors.select("reader_id", "vector", F.lit(-1).cast("bigint").alias("pos"), F.concat(
        F.lit("- **"), "vector", F.lit("** (prose)"), F.when(F.col("vector") == "v2", F.lit("\n- Status: demoted")).otherwise(F.lit(""))).alias("line"))
    docs = heads.unionByName(lines).groupBy(F.col("reader_id").alias("doc_id")).agg(F.concat(
        F.lit("# Profile\n## Taste vectors\n"), F.array_join(F.array_sort(F.collect_list(F.struct("vector", "pos", "line")))["line"], "\n")).alias("text"))
    out = calibrate.bootstrap(markdown.taste_vectors(docs), v.items, v.item_tags)
    return out.select("doc_id", "vector", F.array_join("signals", "|").alias("signals"), F.array_join("themes", "|").alias("themes"), "unresolved")


_ADDS = """SELECT s.reader_id, i.item_key AS add_key FROM (SELECT r.reader_id, (r.reader_id * 17 + 3) % n.parts AS pk
  FROM reader_state r CROSS JOIN (SELECT count(*) AS parts FROM part) n) s JOIN items i ON i.pk = s.pk"""


@query("t09_swap_suggestions", f"""WITH lk AS (SELECT reader_id, item_key, count(*) FILTER (type = 'defended') AS defended, bool_or(type = 'session_lock') AS sl FROM feedback GROUP BY 1, 2),
p AS (SELECT l.reader_id, l.item_key, round_even(coalesce(s.strength, 0), 3) AS strength FROM list_items l LEFT JOIN pick_strength s ON s.reader_id = l.reader_id AND s.item_key = l.item_key),
md AS (SELECT reader_id, list_extract(list_sort(list(strength)), CAST(count(*) // 2 + 1 AS BIGINT)) AS middle FROM p GROUP BY 1),
ov AS (SELECT a.reader_id, a.add_key, p.item_key, count(DISTINCT x.tag) AS overlap FROM ({_ADDS}) a JOIN p ON p.reader_id = a.reader_id JOIN good_tags x ON x.item_key = a.add_key JOIN good_tags y ON y.item_key = p.item_key AND y.kind = x.kind AND y.tag = x.tag GROUP BY 1, 2, 3),
tg AS (SELECT item_key, count(DISTINCT tag) AS c FROM good_tags GROUP BY 1),
r AS (SELECT a.reader_id, a.add_key, p.item_key, p.strength, md.middle, coalesce(o.overlap, 0) AS overlap, coalesce(lk.defended, 0) AS defended,
  round_even(coalesce(o.overlap, 0) / (coalesce(ta.c, 0) + coalesce(tb.c, 0) - coalesce(o.overlap, 0)), 4) AS jaccard
  FROM ({_ADDS}) a JOIN p ON p.reader_id = a.reader_id JOIN md ON md.reader_id = a.reader_id LEFT JOIN ov o ON o.reader_id = a.reader_id AND o.add_key = a.add_key AND o.item_key = p.item_key
  LEFT JOIN tg ta ON ta.item_key = a.add_key LEFT JOIN tg tb ON tb.item_key = p.item_key LEFT JOIN lk ON lk.reader_id = p.reader_id AND lk.item_key = p.item_key
  WHERE p.item_key <> a.add_key AND NOT coalesce(lk.defended >= 2 OR lk.sl, false)),
hl AS (SELECT reader_id, add_key, coalesce(list(item_key ORDER BY overlap DESC, jaccard DESC, strength, item_key) FILTER (overlap > 0), []) AS h, coalesce(list(item_key ORDER BY strength, item_key) FILTER (strength < middle), []) AS l FROM r GROUP BY 1, 2),
s1 AS (SELECT *, h[1:2] AS p1 FROM hl), s2 AS (SELECT *, list_filter(l, lambda x: NOT list_contains(p1, x))[1:1] AS p2 FROM s1),
s3 AS (SELECT *, CASE WHEN len(p1) + len(p2) < 3 THEN list_filter(l, lambda x: NOT list_contains(list_concat(p1, p2), x))[1:(3 - len(p1) - len(p2))] ELSE [] END AS p3 FROM s2),
s4 AS (SELECT *, CASE WHEN len(p1) + len(p2) + len(p3) < 3 THEN list_filter(h, lambda x: NOT list_contains(list_concat(p1, list_concat(p2, p3)), x))[1:(3 - len(p1) - len(p2) - len(p3))] ELSE [] END AS p4 FROM s3),
c AS (SELECT reader_id, add_key, unnest(list_concat(p1, p4)) AS item_key, 'high_overlap' AS reason FROM s4 UNION ALL SELECT reader_id, add_key, unnest(list_concat(p2, p3)), 'low_confidence' FROM s4)
SELECT c.*, r.overlap, r.jaccard, r.strength, r.defended FROM c JOIN r ON r.reader_id = c.reader_id AND r.add_key = c.add_key AND r.item_key = c.item_key""")
def t09(v):
    picks = settle(listed(v), "picks")
    strength = reader.anchor_strength(picks, reader.positive_tags(v.item_tags), reader.anchor_groups(anchor_parts(v)[1]))
    return decide.swap_suggestions(v.sql(_ADDS), picks, v.item_tags, strength, reader.lock_ledger(v.feedback))


@query("t13_series_scope", """WITH a AS (SELECT DISTINCT reader_id, series FROM list_books WHERE series IS NOT NULL),
st AS (SELECT DISTINCT i.series, t.kind, t.tag FROM items i JOIN good_tags t ON t.item_key = i.item_key WHERE i.series IS NOT NULL),
m AS (SELECT a.reader_id, a.series, string_agg(DISTINCT v.vector, '|' ORDER BY v.vector) AS vectors, count(DISTINCT v.vector) AS n FROM a JOIN st ON st.series = a.series JOIN active_members v ON v.reader_id = a.reader_id AND v.kind = st.kind AND v.tag = st.tag GROUP BY 1, 2),
r AS (SELECT a.*, p.pages AS series_pages, coalesce(m.vectors, '') AS vectors, coalesce(m.n, 0) AS n, l.long_series, greatest(s.n_target - l.list_items, 1) * coalesce(nullif(s.page_target, 0), 400) AS room
  FROM a JOIN (SELECT series, CAST(sum(coalesce(pages, 0)) AS BIGINT) AS pages FROM items WHERE series IS NOT NULL GROUP BY 1) p ON p.series = a.series LEFT JOIN m ON m.reader_id = a.reader_id AND m.series = a.series
  JOIN reader_state s ON s.reader_id = a.reader_id JOIN load0 l ON l.reader_id = a.reader_id),
q AS (SELECT *, CASE WHEN n >= 3 THEN 'strong' WHEN n = 2 THEN 'moderate' WHEN n = 1 THEN 'weak' ELSE 'none' END AS strength, CASE WHEN series_pages > room * 0.4 THEN 'high' WHEN series_pages > room * 0.2 THEN 'moderate' ELSE 'low' END AS pressure FROM r)
SELECT reader_id, series, series_pages, vectors, strength, pressure, CASE WHEN strength = 'none' THEN 'skip' WHEN strength = 'weak' THEN CASE WHEN pressure = 'high' THEN 'skip' ELSE 'entry' END WHEN pressure = 'high' OR long_series >= 3 THEN 'entry' ELSE 'all' END AS scope,
  CASE WHEN strength = 'none' THEN 'high' WHEN strength = 'weak' OR pressure = 'high' OR long_series >= 3 THEN 'medium' WHEN strength = 'moderate' THEN 'low' ELSE 'high' END AS confidence FROM q""")
def t13(v):
    picks = settle(listed(v), "picks")
    asked = picks.join(v.items.filter("series is not null").select("item_key", "series"), "item_key")
    return decide.scope(asked, v.items, v.item_tags, v.vectors, v.vector_members, reader.commitment_load(picks, v.items), v.reader_state)


@query("t12_status_signals", """SELECT reader_id, 'vector_underused' AS signal, vector AS name, CAST(coverage AS DOUBLE) AS value FROM underused
UNION ALL SELECT reader_id, 'floor_at_risk', name, CAST(remaining AS DOUBLE) FROM risk WHERE remaining > 0
UNION ALL SELECT reader_id, 'vector_demoted', vector, NULL FROM vectors WHERE status = 'demoted' UNION ALL SELECT reader_id, 'rejection_run', run_value, CAST(n AS DOUBLE) FROM runs
UNION ALL SELECT l.reader_id, 'commitment_load', CASE WHEN l.long_series >= s.long_series_cap THEN 'at_cap' ELSE 'near_cap' END, CAST(l.long_series AS DOUBLE) FROM load0 l JOIN reader_state s ON s.reader_id = l.reader_id AND l.long_series >= s.long_series_cap - 1
UNION ALL SELECT b.reader_id, 'page_budget', 'mean_pages', round_even(avg(nullif(pages, 0)), 1) FROM list_books b JOIN reader_state s ON s.reader_id = b.reader_id GROUP BY b.reader_id, s.page_target HAVING avg(nullif(pages, 0)) > s.page_target * 1.10
UNION ALL SELECT reader_id, 'defended', item_key, CAST(count(*) AS DOUBLE) FROM feedback WHERE type = 'defended' GROUP BY 1, 3 UNION ALL SELECT DISTINCT reader_id, 'session_lock', item_key, CAST(NULL AS DOUBLE) FROM feedback WHERE type = 'session_lock'""")
def t12(v):
    return decide.status_signals(v.picks, v.items, v.item_tags, v.vectors, v.vector_members, v.reader_state, v.floors, v.feedback)


def older(v):
    """Scores of every item linked from a reader's favourites: the reader's candidates."""
    pairs = v.feedback.select("reader_id", "item_key").distinct()
    near = pairs.join(v.item_links.select(F.col("src_key").alias("item_key"), F.col("dst_key").alias("d")), "item_key").select(
        "reader_id", F.col("d").alias("item_key")).distinct()
    return decide.older_scores(near, v.items, v.item_links, reader.favourite_pools(log(v)), reader.rejection_counts(marks(v)),
                               {"indie": 0.4, "classic": 0.25}, ["large"])


duck.TABLES["pools"] = f"""SELECT DISTINCT reader_id, rating >= 5 AS five, {duck.norm_old('title')} AS t, {duck.norm_old('author')} AS a FROM log_n WHERE rating >= 4.5"""


_OLDER = f"""WITH near AS (SELECT DISTINCT f.reader_id, l.dst_key AS item_key FROM feedback f JOIN item_links l ON l.src_key = f.item_key),
i AS (SELECT *, {duck.norm_old('title')} AS t, {duck.norm_old('author')} AS a FROM items),
au AS (SELECT reader_id, a, max(CASE WHEN five THEN 1.5 ELSE 0.8 END) AS pocket FROM pools GROUP BY 1, 2), ti AS (SELECT DISTINCT reader_id, t, a FROM pools),
ks AS (SELECT item_key, {duck.norm_old("left(item_key, length(item_key) - length(list_extract(string_split(item_key, ' - '), -1)) - 3)")} AS t, {duck.norm_old("list_extract(string_split(item_key, ' - '), -1)")} AS a FROM items),
ov AS (SELECT l.src_key, ti.reader_id, count(*) AS n FROM item_links l JOIN ks ON ks.item_key = l.dst_key JOIN ti ON ti.t = ks.t AND ti.a = ks.a GROUP BY 1, 2),
rj AS (SELECT reader_id, title_norm, author_norm, CAST(list_extract([0, 0.5, 1.5, 3.5, 6], least(count(*) FILTER (status = 'rejected'), 4) + 1) AS DOUBLE) AS penalty FROM ledger GROUP BY 1, 2, 3)
SELECT n.reader_id, n.item_key, coalesce(i.rating, 0) AS base, CAST(coalesce(au.pocket, 0) AS DOUBLE) AS pocket, round(least(coalesce(ov.n, 0), 3) * 0.6e0, 4) AS link_bonus,
  CAST(CASE WHEN i.indie THEN 0.4 ELSE 0 END + CASE WHEN i.classic THEN 0.25 ELSE 0 END AS DOUBLE) AS boost, coalesce(rj.penalty, 0) AS penalty,
  coalesce((reviews > 0 AND reviews < 1500 AND rating >= 4.2) OR indie OR (classic AND reviews > 0 AND reviews < 50000) OR (secondary_genre <> primary_genre AND secondary_genre = 'large'), false) AS deep_cut,
  round(coalesce(i.rating, 0) + coalesce(au.pocket, 0) + least(coalesce(ov.n, 0), 3) * 0.6e0 + CASE WHEN i.indie THEN 0.4e0 ELSE 0 END + CASE WHEN i.classic THEN 0.25e0 ELSE 0 END - coalesce(rj.penalty, 0), 4) AS score
FROM near n JOIN i ON i.item_key = n.item_key LEFT JOIN au ON au.reader_id = n.reader_id AND au.a = i.a LEFT JOIN ov ON ov.reader_id = n.reader_id AND ov.src_key = n.item_key
LEFT JOIN rj ON rj.reader_id = n.reader_id AND rj.title_norm = i.t AND rj.author_norm = i.a"""


@query("t01_older_score", _OLDER)
def t01(v):
    return _r(older(v), score=4, link_bonus=4)


def whole(v):
    """Readers, passing items and everything that scores or excludes them."""
    asked = filters.within_limits(min_rating=4.0, min_reviews=500, page_cap=900)
    return (v.reader_state, v.items.filter(asked), v.item_links, reader.favourite_pools(log(v)), reader.rejection_counts(marks(v)),
            filters.exclusion_pairs(log(v), v.picks), {"indie": 0.4, "classic": 0.25})


# Every reader with every passing item that it has not read or listed.
_OLDER_ALL = "WITH near AS (SELECT r.reader_id, i.item_key FROM reader_state r CROSS JOIN passing i LEFT JOIN older_barred b ON b.reader_id = r.reader_id AND b.t = i.t AND b.a = i.a WHERE b.t IS NULL)," + _OLDER.split("),", 1)[1].replace("* 0.6e0 + CASE", "* 0.6e0 + CASE").replace(", 4) AS score", ", 9) AS score")
duck.TABLES.update({
    "passing": f"""SELECT item_key, {duck.norm_old('title')} AS t, {duck.norm_old('author')} AS a FROM items WHERE title IS NOT NULL AND coalesce(rating, 0) >= 4.0 AND coalesce(reviews, 0) >= 500 AND (coalesce(pages, 0) = 0 OR pages <= 900)""",
    "older_barred": f"""SELECT reader_id, {duck.norm_old('title')} AS t, {duck.norm_old('author')} AS a FROM log WHERE coalesce(title, '') <> '' UNION SELECT reader_id, {duck.norm_old('title')}, {duck.norm_old('author')} FROM picks WHERE coalesce(title, '') <> ''""",
})


@query("t01_older_ranking", f"SELECT * EXCLUDE (score), round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY score DESC, item_key) AS rank FROM ({_OLDER_ALL})) WHERE rank <= 20")
def t01r(v):
    """The first 20 of all passing items for every reader, with the parts of their scores."""
    found = decide.older_candidates(*whole(v), need=20, genres=["large"])
    return _r(found.drop("group"), score=4, link_bonus=4)


def _fold(phase: int, on: str) -> str:
    return f"SELECT *, {phase} AS phase, row_number() OVER (PARTITION BY reader_id ORDER BY score DESC, item_key) AS r FROM x WHERE {on}"


@query("t03_older_batch", f"""WITH x AS MATERIALIZED (SELECT n.reader_id, n.item_key, n.score, n.deep_cut, coalesce(i.indie, false) AS indie, coalesce(i.classic, false) AS classic FROM ({_OLDER_ALL}) n JOIN items i ON i.item_key = n.item_key),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY phase, r) AS i FROM ({_fold(1, 'indie')} UNION ALL {_fold(2, 'classic')} UNION ALL {_fold(3, 'deep_cut')} UNION ALL {_fold(4, 'true')}) WHERE r <= 9),
walked AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE f AS (SELECT DISTINCT reader_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS keys, 0 AS ni, 0 AS nc, 0 AS nd FROM steps
  UNION ALL SELECT reader_id, i, CASE WHEN ok THEN list_append(keys, item_key) ELSE keys END, ni + CASE WHEN ok AND indie THEN 1 ELSE 0 END, nc + CASE WHEN ok AND classic THEN 1 ELSE 0 END, nd + CASE WHEN ok AND deep_cut THEN 1 ELSE 0 END FROM (
    SELECT s.*, f.keys, f.ni, f.nc, f.nd, NOT list_contains(f.keys, s.item_key) AND CASE s.phase WHEN 1 THEN f.ni < 2 WHEN 2 THEN f.nc < 1 WHEN 3 THEN f.nd < 1 ELSE len(f.keys) < 4 END AS ok
    FROM f JOIN steps s ON s.reader_id = f.reader_id AND s.i = f.i + 1) z)
  SELECT * FROM f) WHERE (reader_id, i) IN (SELECT reader_id, max(i) FROM steps GROUP BY 1)),
c AS (SELECT x.*, row_number() OVER (PARTITION BY x.reader_id ORDER BY {duck.hash01("'5'", "CAST(x.reader_id AS VARCHAR)", "x.item_key")}, x.item_key) AS place FROM (SELECT reader_id, unnest(keys) AS item_key FROM walked) w JOIN x ON x.reader_id = w.reader_id AND x.item_key = w.item_key)
SELECT reader_id, place, item_key, score, deep_cut, min(CASE WHEN deep_cut THEN place END) OVER (PARTITION BY reader_id) AS deep_cut_place FROM (SELECT * REPLACE (round(score, 4) AS score) FROM c)""")
def t03(v):
    """Greedy fill: tag minima, one deep cut, then the best left."""
    readers, items, *rest = whole(v)
    return _r(decide.older_batch(readers, items, *rest, {"indie": 2, "classic": 1}, size=4, seed=5, genres=["large"]), score=4)
