"""Series order, next books, shapes and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import text
from bookloom.operators import filters, reader, series
from testbed import duck
from testbed.queries_reader import listed, log, resolved
from testbed.queries_scalar import LIBRARY
from testbed.registry import TODAY, query

ON, BN = duck.order_no("series_position"), duck.book_number("series_position")
duck.TABLES.update({
    "sbooks": f"""SELECT *, {ON} AS order_no, {BN} AS bn, {duck.norm_old('title')} AS otn, {duck.norm_old('author')} AS oan,
  row_number() OVER (PARTITION BY series ORDER BY {ON}, title, item_key) AS place FROM items_n WHERE series IS NOT NULL""",
    "slog": """SELECT l.reader_id, l.item_key, l.rating, l.logged_on, l.log_id, list_contains(list_transform(string_split(l.my_tags, ','), lambda t: trim(t)), '*completed') AS done,
  b.series, b.order_no, b.title, b.author, b.series_position, b.tn, b.an FROM log_r l JOIN sbooks b ON b.item_key = l.item_key AND b.series_status IS DISTINCT FROM 'Standalone'""",
    "tight": """SELECT series, number, mu, n FROM (SELECT *, row_number() OVER (PARTITION BY series, number ORDER BY n DESC, item_key) AS r FROM (
  SELECT series, TRY_CAST(nullif(regexp_extract(series_position, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS number, rating AS mu, reviews AS n, item_key FROM items
  WHERE series_status IN ('Short Series', 'Long Series') AND series IS NOT NULL AND series_role IN ('first', 'mid', 'late') AND rating IS NOT NULL AND reviews > 0)
  WHERE number = floor(number)) WHERE r = 1""",
    "tight_kept": """SELECT t.*, s.n1, s.mu1 FROM tight t JOIN (SELECT series, median(n) AS med, max(n) FILTER (number = 1) AS n1, max(mu) FILTER (number = 1) AS mu1 FROM tight GROUP BY 1) s
  ON s.series = t.series WHERE s.n1 IS NOT NULL AND (t.number = 1 OR t.n >= 0.05 * s.med)""",
    "lams": f"""SELECT *, CASE WHEN number = 1 THEN 0.0 ELSE {duck.pdf(duck.ppf('(1.0 - p)'))} / p END AS lam FROM (SELECT *, CAST(n AS DOUBLE) / n1 AS p FROM tight_kept)""",
    "baseline": """SELECT series, CASE WHEN count(*) < 3 OR var_pop(lam) < 1e-9 THEN max(mu1) ELSE least(regr_intercept(mu, lam), avg(mu)) END AS baseline
FROM lams GROUP BY 1 HAVING NOT bool_or(number <> 1 AND n >= n1)""",
    "effective": """SELECT i.item_key, CASE WHEN i.series_status IN ('Short Series', 'Long Series') AND i.series_role IN ('first', 'mid', 'late') AND b.baseline IS NOT NULL
  THEN coalesce(0.75 * b.baseline + 0.25 * i.rating, b.baseline) ELSE i.rating END AS effective FROM items i LEFT JOIN baseline b ON b.series = i.series""",
})


@query("w01_unfinished_series", """WITH agg AS (SELECT reader_id, series, max(rating) AS max_rating, avg(rating) AS mean, bool_or(done) AS done,
    arg_max(rating, (order_no, title, logged_on, log_id)) FILTER (rating IS NOT NULL) AS furthest FROM slog GROUP BY 1, 2),
keep AS (SELECT * FROM agg WHERE max_rating >= 4 AND mean >= 3.5 AND furthest >= 3 AND NOT done),
lastr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reader_id, series ORDER BY order_no DESC, title DESC, logged_on, log_id) AS r FROM slog) WHERE r = 1),
nxt AS (SELECT k.reader_id, k.series, arg_min(b.item_key, b.place) AS next_key FROM keep k JOIN sbooks b ON b.series = k.series AND b.series_status <> 'Standalone' AND (b.bn IS NULL OR b.bn >= 1)
  WHERE NOT EXISTS (SELECT 1 FROM slog s WHERE s.reader_id = k.reader_id AND s.series = k.series AND s.tn = b.tn AND s.an = b.an) GROUP BY 1, 2)
SELECT k.reader_id, k.series, k.max_rating, round_even(k.mean, 2) AS mean, l.author, l.title AS last_title, l.series_position AS last_position, l.rating AS last_rating,
  i.title AS next_title, i.series_position AS next_position, i.pages AS next_pages, n.next_key
FROM keep k JOIN lastr l ON l.reader_id = k.reader_id AND l.series = k.series LEFT JOIN nxt n ON n.reader_id = k.reader_id AND n.series = k.series LEFT JOIN items i ON i.item_key = n.next_key""")
def w01(v):
    return series.unfinished(resolved(v), v.items)


def _old_sub(e):
    p = f"trim(coalesce({e}, ''))"
    bare = f"regexp_replace(regexp_replace({p}, '^[Bb]ook\\s*\\d+(\\.\\d+)?\\s*', ''), '(?i)^of\\s+', '')"
    s = f"CASE WHEN regexp_matches({p}, '\\([^)]+\\)') THEN regexp_extract({p}, '\\(([^)]+)\\)', 1) ELSE {bare} END"
    for r in ("(?i)\\s+Book\\s*\\d+(\\.\\d+)?$", "\\s*#\\d+(\\.\\d+)?$", "(?i)\\s+\\(?(novella|coda|prequel)\\)?$"):
        s = f"regexp_replace({s}, '{r}', '')"
    return f"nullif(lower(trim({s})), '')"


duck.TABLES["old_excl"] = f"""SELECT DISTINCT reader_id, {duck.norm_old('title')} AS t, {duck.norm_old('author')} AS a FROM (SELECT reader_id, title, author FROM log UNION ALL SELECT reader_id, title, author FROM picks)"""
duck.TABLES["walks"] = f"""SELECT *, {_old_sub('series_position')} AS sub FROM sbooks"""


def _walk_sql(group):
    on = "b.series = s.series" + (" AND b.sub = s.sub" if group == "sub" else "")
    return f"""SELECT s.reader_id, s.item_key, arg_min(b.item_key, b.place) AS k FROM (
  SELECT a.reader_id, s.item_key, s.series, s.sub, min(b.place) AS start FROM asks a JOIN walks s ON s.item_key = a.item_key JOIN walks b ON {on}
    AND ((b.otn = s.otn AND b.oan = s.oan) OR b.series_position = s.series_position) GROUP BY ALL) s JOIN walks b ON {on} AND b.place > s.start AND (b.bn IS NULL OR b.bn >= 1)
  WHERE NOT EXISTS (SELECT 1 FROM old_excl x WHERE x.reader_id = s.reader_id AND x.t = b.otn AND x.a = b.oan) GROUP BY 1, 2"""


@query("w02_series_continuation", f"""WITH asks AS (SELECT l.reader_id, l.item_key FROM list_items l JOIN sbooks b ON b.item_key = l.item_key AND b.series_status IN ('Short Series', 'Long Series'))
SELECT a.reader_id, a.item_key, coalesce(x.k, y.k) AS next_key FROM asks a
LEFT JOIN ({_walk_sql('sub')}) x ON x.reader_id = a.reader_id AND x.item_key = a.item_key
LEFT JOIN ({_walk_sql('all')}) y ON y.reader_id = a.reader_id AND y.item_key = a.item_key""")
def w02(v):
    return series.next_after(listed(v), v.items, filters.exclusion_pairs(v.log, v.picks))


def _chain_sql(group, num):
    on = "b.series = s.series" + (" AND b.sub_name = s.sub_name" if group == "sub" else "")
    return f"""SELECT item_key, arg_min(title, place) AS t FROM (SELECT s.item_key, b.title, b.{num} AS place, min(CASE WHEN (b.tn = s.tn AND b.an = s.an) OR b.series_position = s.series_position THEN b.{num} END) OVER (PARTITION BY s.item_key) AS start
  FROM chain s JOIN chain b ON {on}) WHERE place > start GROUP BY 1"""


@query("w03_chain_validation", f"""WITH chain AS (SELECT b.*, s.sub_name, CASE WHEN s.sub_name IS NOT NULL THEN row_number() OVER (PARTITION BY b.series, s.sub_name ORDER BY s.sub_n, b.title, b.item_key) END AS sub_place
  FROM sbooks b JOIN subseries s ON s.item_key = b.item_key),
expected AS (SELECT item_key, lead(title) OVER (PARTITION BY series ORDER BY pk) AS expected FROM items WHERE series IS NOT NULL)
SELECT c.item_key, coalesce(x.t, y.t) AS next_title, coalesce(x.t, y.t) IS NOT DISTINCT FROM e.expected AS holds FROM chain c JOIN expected e ON e.item_key = c.item_key
LEFT JOIN ({_chain_sql('sub', 'sub_place')}) x ON x.item_key = c.item_key LEFT JOIN ({_chain_sql('all', 'place')}) y ON y.item_key = c.item_key""")
def w03(v):
    expected = v.sql("SELECT item_key, lead(title) OVER (PARTITION BY series ORDER BY pk) AS expected FROM items WHERE series IS NOT NULL")
    return (series.chain_next(expected, v.items).join(expected, "item_key")
            .select("item_key", "next_title", F.col("next_title").eqNullSafe(F.col("expected")).alias("holds")))


@query("w04_series_navigation", """WITH want AS (SELECT DISTINCT reader_id, series FROM list_books WHERE series IS NOT NULL),
lp AS (SELECT reader_id, tn, an, arg_max(rating, (logged_on, log_id)) FILTER (rating IS NOT NULL) AS my FROM log_n GROUP BY 1, 2, 3),
r AS (SELECT w.reader_id, b.*, l.tn IS NOT NULL AS rd, p.tn IS NOT NULL AS ol, l.my FROM want w JOIN sbooks b ON b.series = w.series
  LEFT JOIN lp l ON l.reader_id = w.reader_id AND l.tn = b.tn AND l.an = b.an LEFT JOIN list_pairs p ON p.reader_id = w.reader_id AND p.tn = b.tn AND p.an = b.an)
SELECT reader_id, series, count(*) AS n_books, count(*) FILTER (rd) AS n_read, count(*) FILTER (ol) AS n_listed,
  arg_min(item_key, place) FILTER (NOT rd AND (bn IS NULL OR bn >= 1)) AS next_key, sum(my) AS rating_sum, count(*) FILTER (NOT rd AND NOT ol) AS add_count,
  CAST(coalesce(sum(coalesce(pages, 0)) FILTER (NOT rd AND NOT ol), 0) AS BIGINT) AS add_pages FROM r GROUP BY 1, 2""")
def w04(v):
    want = listed(v).join(v.items.filter("series is not null").select("item_key", "series"), "item_key")
    return series.navigation_totals(series.navigation(want, v.items, log(v), v.picks))


@query("w05_series_shape", """WITH g AS (SELECT i.series, s.sub_name, string_agg(i.title, '|' ORDER BY s.sub_n, i.title, i.item_key) AS books FROM items i JOIN subseries s ON s.item_key = i.item_key
  WHERE i.series IS NOT NULL AND s.sub_name IS NOT NULL GROUP BY 1, 2)
SELECT sh.series, sh.shape, g.sub_name AS sub, g.books FROM (SELECT i.series, CASE WHEN bool_or(s.sub_name IS NOT NULL) THEN 'loose-subseries'
  WHEN bool_and(coalesce(i.series_status = 'Standalone', false)) OR bool_and(coalesce(i.series_role = 'standalone', false)) THEN 'dip-in' ELSE 'one-arc' END AS shape
  FROM items i JOIN subseries s ON s.item_key = i.item_key WHERE i.series IS NOT NULL GROUP BY 1) sh LEFT JOIN g ON g.series = sh.series""")
def w05(v):
    groups = series.subseries_groups(v.items).groupBy("series", "sub").agg(F.array_join(
        F.array_sort(F.collect_list(F.struct("place", "title")))["title"], "|").alias("books"))
    return series.shapes(v.items).join(groups, "series", "left")


@query("w09_corrected_rating", "SELECT series, round(baseline, 5) AS baseline FROM baseline")
def w09(v):
    return series.corrected_baseline(v.items).withColumn("baseline", F.round("baseline", 5))


@query("w09_effective_rating", "SELECT item_key, round(effective, 7) AS effective FROM effective")
def w09e(v):
    return series.effective_rating(v.items).select("item_key", F.round("effective", 7).alias("effective"))


_RELEASED = "SELECT *, CASE WHEN pub_year IS NOT NULL THEN CAST(make_date(CAST(pub_year AS INT), 6, 1) AS DATE) END AS released FROM items"


@query("w10_review_anomaly", f"""WITH i AS (SELECT * FROM ({_RELEASED}) WHERE series IS NOT NULL AND reviews IS NOT NULL),
g AS (SELECT author, series FROM i GROUP BY 1, 2 HAVING count(*) >= 3 AND median(reviews) >= 2000),
o AS (SELECT a.item_key, a.series, a.reviews, a.series_position, a.released, median(b.reviews) AS others FROM i a JOIN g ON g.author = a.author AND g.series = a.series
  JOIN i b ON b.author = a.author AND b.series = a.series AND b.item_key <> a.item_key GROUP BY ALL)
SELECT item_key, series, reviews, others, CASE WHEN regexp_matches(coalesce(series_position, ''), '\\d+\\.\\d*[1-9]') THEN 'C'
  WHEN released > DATE '2024-10-01' - INTERVAL 6 MONTH THEN 'B' ELSE 'A' END AS kind FROM o WHERE reviews < 0.05 * others""")
def w10(v):
    return series.review_anomalies(v.sql(_RELEASED), "2024-10-01")


@query("w11_series_type_audit", """WITH r AS (SELECT title, authors, trim(coalesce(series, '')) AS series, coalesce(CAST(trunc(TRY_CAST(pages AS DOUBLE)) AS BIGINT), 0) AS p, trim(coalesce(series_type, '')) AS old_type FROM library),
s AS (SELECT series, count(*) AS n_books, CAST(sum(p) AS BIGINT) AS total_pages FROM r WHERE series <> '' GROUP BY 1 HAVING count(*) >= 4)
SELECT r.title, r.authors, r.series, n_books, total_pages, old_type, CASE WHEN total_pages >= 2500 THEN 'Long Series' ELSE 'Short Series' END AS new_type
FROM r JOIN s ON s.series = r.series WHERE old_type <> CASE WHEN total_pages >= 2500 THEN 'Long Series' ELSE 'Short Series' END""")
def w11(v):
    return series.series_type_audit(v.sql(LIBRARY))


_SPREAD = """SELECT pk, title, series, CASE WHEN pk % 9 = 0 THEN NULL ELSE primary_genre || CAST(pk % 3 AS STRING) END AS genre,
  CASE WHEN pk % 10 = 0 THEN 'favourite, owned' WHEN pk % 10 = 1 THEN NULL WHEN pk % 10 = 2 THEN 'to-read,owned' ELSE 'owned' END AS tags FROM items"""


@query("g24_series_spread", f"""WITH r AS ({_SPREAD}), m AS (SELECT series, genre FROM (SELECT series, genre, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, genre) AS k
    FROM r WHERE series IS NOT NULL AND genre IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
t AS (SELECT series, bool_or(contains(tags, 'favourite')) AS fav, bool_or(contains(tags, 'to-read')) AS tbr FROM r WHERE series IS NOT NULL GROUP BY 1)
SELECT r.pk, coalesce(r.series, r.title) AS series, coalesce(m.genre, r.genre) AS genre, nullif(concat_ws(', ', r.tags,
  CASE WHEN t.tbr AND NOT contains(coalesce(r.tags, ''), 'to-read') THEN 'to-read' END, CASE WHEN t.fav AND NOT contains(coalesce(r.tags, ''), 'favourite') THEN 'favourite' END), '') AS tags
FROM r LEFT JOIN m ON m.series = r.series LEFT JOIN t ON t.series = r.series""")
def g24(v):
    return series.spread_series(v.sql(_SPREAD), ["to-read", "favourite"]).select("pk", "series", "genre", "tags")


duck.TABLES["load0"] = "SELECT s.reader_id, coalesce(l.long_series, 0) AS long_series, coalesce(l.doorstops, 0) AS doorstops, coalesce(l.list_items, 0) AS list_items FROM reader_state s LEFT JOIN load l ON l.reader_id = s.reader_id"
