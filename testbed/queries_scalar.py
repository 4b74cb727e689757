"""Column functions over the whole catalogue and log."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import series, text, values
from testbed import duck
from testbed.registry import TODAY, query

N, SEP = duck.norm, "chr(31)"


def _joined(c):
    return F.array_join(c, "|")


@query("p01_norm", f"""SELECT log_id, {N('title')} AS title_norm, {N('author')} AS author_norm FROM log""")
def p01(v):
    return v.log.select("log_id", text.norm("title").alias("title_norm"),
                        text.norm("author").alias("author_norm"))


@query("p02_name_order_swap", f"SELECT log_id, {duck.swap('author')} AS author FROM log")
def p02(v):
    return v.log.select("log_id", text.swap_last_first("author").alias("author"))


@query("p03_initials", f"""SELECT item_key, {duck.initials(duck.squeeze("replace(lower(author), '.', ' ')"))} AS author FROM items""")
def p03(v):
    plain = text.squeeze(F.translate(F.lower("author"), ".", " "))
    return v.items.select("item_key", text.join_initials(plain).alias("author"))


@query("p04_title_short", f"SELECT log_id, {duck.short('title')} AS title_short FROM log")
def p04(v):
    return v.log.select("log_id", text.title_short("title").alias("title_short"))


@query("p05_title_fold", f"""SELECT item_key, {duck.fold('tn')} AS title_fold FROM items_n
UNION ALL SELECT CAST(doc_id AS VARCHAR), {duck.fold("lower(text)")} FROM documents""")
def p05(v):
    items = v.items.select("item_key", text.title_fold(text.norm("title")).alias("title_fold"))
    docs = v.documents.select(F.col("doc_id").cast("string").alias("item_key"),
                              text.title_fold(F.lower("text")).alias("title_fold"))
    return items.unionByName(docs)


@query("p06_title_keys", f"""SELECT item_key, array_to_string(list_sort(list_distinct(list_filter(
  [tn, ts, {duck.fold('tn')}, {duck.fold('ts')}], lambda x: x <> ''))), '|') AS keys FROM items_n""")
def p06(v):
    return v.items.select("item_key", _joined(text.title_keys("title")).alias("keys"))


@query("p07_author_parts", f"""SELECT item_key, array_to_string(list_sort(list_distinct(list_filter(
  list_prepend({N('author')}, list_transform(string_split_regex(author, '{duck.SPLIT}'), lambda p: {N('p')})),
  lambda x: x <> ''))), '|') AS parts FROM items""")
def p07(v):
    return v.items.select("item_key", _joined(text.author_parts("author")).alias("parts"))


_PAIRS = """SELECT l.log_id, l.title AS ta, l.author AS aa, s.title AS tb, s.author AS ab
FROM log l JOIN sold s ON s.log_id = l.log_id"""


@query("p08_authors_match", f"""SELECT log_id, {duck.authors_match('a', 'b')} AS hit FROM
  (SELECT log_id, {N('aa')} AS a, {N('ab')} AS b FROM ({_PAIRS}))""")
def p08(v):
    return v.sql(_PAIRS).select("log_id", text.authors_match(
        text.norm("aa"), text.norm("ab")).alias("hit"))


_KEYS = "[{n}, {s}, {fn}, {fs}]"


@query("p09_same_book", f"""SELECT log_id, {duck.authors_match('a', 'b')} AND list_has_any(
  list_filter([ta, sa, {duck.fold('ta')}, {duck.fold('sa')}], lambda x: x <> ''),
  list_filter([tb, sb, {duck.fold('tb')}, {duck.fold('sb')}], lambda x: x <> '')) AS hit FROM
  (SELECT log_id, {N('aa')} AS a, {N('ab')} AS b, {N('ta')} AS ta, {N('tb')} AS tb,
          {duck.short('ta')} AS sa, {duck.short('tb')} AS sb FROM ({_PAIRS}))""")
def p09(v):
    return v.sql(_PAIRS).select("log_id", text.same_book("ta", "aa", "tb", "ab").alias("hit"))


@query("p10_light_key", f"SELECT src_key, pos, {duck.light('dst_key')} AS light FROM raw_links")
def p10(v):
    return v.raw_links.select("src_key", "pos", text.light_key("dst_key").alias("light"))


@query("p11_fuzzy_norm", """SELECT log_id, trim(regexp_replace(regexp_replace(split_part(array_to_string(
  list_sort(list_transform(string_split(replace(lower(author), ' & ', ', '), ','), lambda p: trim(p))), ', '), ':', 1),
  '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS author_fuzzy FROM log""")
def p11(v):
    return v.log.select("log_id", text.fuzzy_norm("author").alias("author_fuzzy"))


@query("p12_norm_old", f"SELECT log_id, {duck.norm_old('title')} AS title_norm, {duck.norm_old('author')} AS author_norm FROM log")
def p12(v):
    return v.log.select("log_id", text.norm_keep_subtitle("title").alias("title_norm"),
                        text.norm_keep_subtitle("author").alias("author_norm"))


@query("p13_composite_key", """SELECT item_key, trim(title) || ' - ' || trim(author) AS made_key,
  left(item_key, length(item_key) - length(list_extract(string_split(item_key, ' - '), -1)) - 3) AS key_title,
  list_extract(string_split(item_key, ' - '), -1) AS key_author FROM items""")
def p13(v):
    return v.items.select("item_key", text.item_key("title", "author").alias("made_key"),
                          text.key_title("item_key").alias("key_title"),
                          text.key_author("item_key").alias("key_author"))


@query("p14_series_position", f"""SELECT item_key, {duck.order_no('series_position')} AS order_no,
  TRY_CAST(nullif(regexp_extract(series_position, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS first_no,
  coalesce(regexp_matches(series_position, '(?i)^\\s*book\\s*1([^\\d.]|$)'), false) AS book_one,
  CASE WHEN x > 0 THEN 'Book ' || CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END END AS from_index
FROM (SELECT *, CAST(pk % 9 AS DOUBLE) / 2 - 1 AS x FROM items)""")
def p14(v):
    index = (F.col("pk") % 9).cast("double") / 2 - 1
    return v.items.select("item_key", series.order_number("series_position").alias("order_no"),
                          series.first_number("series_position").alias("first_no"),
                          series.is_book_one("series_position").alias("book_one"),
                          series.index_to_position(index.cast("string")).alias("from_index"))


@query("p15_subseries", "SELECT item_key, sub_name, sub_n FROM subseries")
def p15(v):
    return (v.items.select("item_key", series.subseries("series_position").alias("s"))
            .select("item_key", F.col("s.name").alias("sub_name"), F.col("s.n").alias("sub_n")))


_REWRITE = f"""SELECT item_key, series_position, CASE WHEN spelled <> inner_text
    THEN replace(series_position, '(' || inner_text || ')', '(' || spelled || ')') END AS new_position
  FROM (SELECT *, trim({duck.sub_part('inner_text', 'name')}) || ' Book ' || CASE WHEN sub_n = floor(sub_n)
     THEN CAST(CAST(sub_n AS BIGINT) AS VARCHAR) ELSE CAST(sub_n AS VARCHAR) END AS spelled FROM subs)"""


@query("p16_subseries_rewrite", f"SELECT item_key, new_position FROM ({_REWRITE})")
def p16(v):
    return v.items.select("item_key", series.rewrite_position("series_position").alias("new_position"))


@query("p17_rating", f"SELECT log_id, {duck.rating('rating_text')} AS rating FROM log")
def p17(v):
    return v.log.select("log_id", values.parse_rating("rating_text").alias("rating"))


@query("p18_date", f"""SELECT log_id, CAST({duck.date('date_text')} AS VARCHAR) AS read_on,
  trim(coalesce(nullif(date_text, 'sometime'), CAST(logged_on AS VARCHAR))) AS first_date FROM log""")
def p18(v):
    usable = F.nullif("date_text", F.lit("sometime"))
    return v.log.select("log_id", values.parse_date("date_text").cast("string").alias("read_on"),
                        values.first_filled(usable, F.col("logged_on").cast("string")).alias("first_date"))


@query("p19_recency_bucket", f"SELECT log_id, {duck.bucket(duck.date('date_text'), TODAY)} AS bucket FROM log")
def p19(v):
    day = values.parse_date("date_text")
    return v.log.select("log_id", values.recency_bucket(day, F.lit(TODAY).cast("date")).alias("bucket"))


# The catalogue as the library CSV would carry it: text cells, some blank or bad.
LIBRARY = """SELECT pk, title, author AS authors, item_key,
  CASE WHEN pk % 11 = 0 THEN NULL WHEN pk % 13 = 0 THEN 'n/a' ELSE CAST(p.pages + pk % 2 AS STRING) || '.0' END AS pages,
  CASE WHEN pk % 12 = 0 THEN NULL ELSE CAST(p.reviews AS STRING) END AS reviews,
  CASE WHEN pk % 14 = 0 THEN 'bad' ELSE CAST(p.rating AS STRING) END AS rating,
  CASE WHEN pk % 15 = 0 THEN ' ' ELSE p.series END AS series,
  CASE WHEN pk % 16 = 0 THEN '0' ELSE CAST(pk % 7 AS STRING) || '.5' END AS series_index,
  CASE WHEN pk % 17 = 0 THEN 'Long Series' ELSE p.series_status END AS series_type,
  CASE WHEN pk % 18 = 0 THEN '0101-01-01' ELSE CAST(1900 + pk % 120 AS STRING) || '-07-01T00:00:00' END AS pubdate,
  CASE WHEN pk % 19 = 0 THEN CAST(1900 + pk % 90 AS STRING) WHEN pk % 19 = 1 THEN '99' END AS pub_year,
  CASE WHEN pk % 5 = 0 THEN 'Indie, owned, Classics' WHEN pk % 5 = 1 THEN '' ELSE 'owned ,  read' END AS tags
FROM items p"""

_YEAR = """coalesce(CASE WHEN regexp_matches(trim(coalesce(pub_year, '')), '^\\d{4}$') AND CAST(trim(pub_year) AS BIGINT) BETWEEN 1000 AND 2100
    THEN CAST(trim(pub_year) AS BIGINT) END, CASE WHEN CAST(left(pubdate, 4) AS BIGINT) BETWEEN 1000 AND 2100 THEN CAST(left(pubdate, 4) AS BIGINT) END)"""
duck.TABLES["library"] = LIBRARY
duck.TABLES["csv_values"] = f"""SELECT pk, title, authors, trim(title) || ' - ' || trim(authors) AS raw_key,
  CAST(trunc(TRY_CAST(pages AS DOUBLE)) AS BIGINT) AS pages, CAST(trunc(TRY_CAST(reviews AS DOUBLE)) AS BIGINT) AS reviews,
  TRY_CAST(rating AS DOUBLE) AS rating, nullif(trim(series), '') AS series,
  CASE WHEN nullif(trim(series), '') IS NOT NULL AND TRY_CAST(series_index AS DOUBLE) > 0 THEN 'Book ' ||
    CASE WHEN CAST(series_index AS DOUBLE) = floor(CAST(series_index AS DOUBLE)) THEN CAST(CAST(series_index AS BIGINT) AS VARCHAR)
    ELSE CAST(CAST(series_index AS DOUBLE) AS VARCHAR) END END AS series_position,
  nullif(trim(series_type), '') AS series_status, {_YEAR} AS pub_year FROM library"""


@query("p20_csv_owned", """SELECT pk, pages, reviews, rating, series, series_position, series_status, pub_year FROM csv_values""")
def p20(v):
    return v.sql(LIBRARY).select("pk", *[c.alias(n) for n, c in values.csv_owned().items()])


# A book's share of the readers of its series' most read one.
_SHARE = "SELECT item_key, CAST(reviews AS DOUBLE) / (max(reviews) OVER (PARTITION BY series) + 1) AS p FROM items WHERE series IS NOT NULL"


@query("p21_normal_curve", f"""SELECT item_key, round({duck.ppf('p')}, 6) AS z, round({duck.pdf(duck.ppf('p'))}, 6) AS density FROM ({_SHARE})""")
def p21(v):
    return (v.sql(_SHARE).select("item_key", values.norm_ppf(F.col("p")).alias("z"))
            .select("item_key", F.round("z", 6).alias("z"), F.round(values.norm_pdf(F.col("z")), 6).alias("density")))


_KEPT = "list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda t: trim(t)), lambda t: t NOT IN ('', 'Indie', 'Classics'))"


@query("p22_tag_edit", f"""SELECT l.item_key, array_to_string(list_concat({_KEPT}, list_concat(
  CASE WHEN i.indie THEN ['Indie'] ELSE [] END, CASE WHEN i.classic THEN ['Classics'] ELSE [] END)), ', ') AS tags,
  list_contains(list_transform(string_split(coalesce(tags, ''), ','), lambda t: trim(t)), 'owned') AS owned
FROM library l JOIN items i ON i.item_key = l.item_key""")
def p22(v):
    lib = v.sql(LIBRARY).select("item_key", "tags").join(v.items.select("item_key", "indie", "classic"), "item_key")
    return lib.select("item_key", values.edit_tags("tags", {"Indie": F.col("indie"), "Classics": F.col("classic")}).alias("tags"),
                      values.has_tag("tags", "owned").alias("owned"))


@query("p23_rejection_penalty", """SELECT reader_id, n, CAST(CASE WHEN n <= 0 THEN 0 WHEN n = 1 THEN 0.5 WHEN n = 2 THEN 1.5
  WHEN n = 3 THEN 3.5 ELSE 6 END AS DOUBLE) AS penalty FROM
  (SELECT reader_id, item_key, count(*) FILTER (type = 'rejected') AS n FROM feedback GROUP BY ALL)""")
def p23(v):
    n = v.feedback.groupBy("reader_id", "item_key").agg(F.count_if(F.col("type") == "rejected").alias("n"))
    return n.select("reader_id", "n", values.rejection_penalty(F.col("n")).alias("penalty"))


@query("p24_page_bucket", """SELECT item_key, CASE WHEN coalesce(pages, 0) = 0 THEN NULL WHEN pages <= 350 THEN 'short'
  WHEN pages <= 600 THEN 'medium' ELSE 'long' END AS bucket,
  CASE WHEN rating - 4.1 >= 0.9 THEN 'strong' WHEN rating - 4.1 >= 0.4 THEN 'medium' ELSE 'weak' END AS verdict FROM items""")
def p24(v):
    return v.items.select("item_key", values.page_bucket(F.col("pages")).alias("bucket"),
                          values.fit_verdict(F.col("rating") - 4.1).alias("verdict"))
