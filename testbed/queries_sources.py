"""Scans and sinks.  File formats are written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import text
from bookloom.operators.common import fresh_path
from bookloom.sources import markdown, records, tables
from testbed import duck
from testbed.queries_scalar import LIBRARY
from testbed.registry import query

_HEADERS = {v: k for k, v in tables.LIBRARY_COLUMNS.items()}


def _library_files(v):
    path = fresh_path(v.spark, "library-csv")
    lib = v.sql(LIBRARY)
    cols = [c for c in lib.columns if c not in ("pk", "item_key")]
    tables.write_csv(lib.select(*[F.col(c).alias(_HEADERS[c]) for c in cols]), path)
    return path


@query("s01_library_csv", """SELECT trim(title) AS title, trim(authors) AS authors, nullif(trim(pages), '') AS pages, nullif(trim(reviews), '') AS reviews,
  nullif(trim(rating), '') AS rating, nullif(trim(series), '') AS series, series_index, nullif(trim(series_type), '') AS series_type,
  pubdate, pub_year, nullif(trim(tags), '') AS tags FROM library""")
def s01(v):
    return tables.library_csv(v.spark, _library_files(v)).drop("genre", "more_tags")


@query("s02_log_csv", f"""SELECT reader_id, trim(title) AS title, trim(author) AS author, {duck.rating('rating_text')} AS rating,
  CAST({duck.date('date_text')} AS VARCHAR) AS read_on, trim(my_tags) AS my_tags FROM log""")
def s02(v):
    path = fresh_path(v.spark, "log-csv")
    tables.write_csv(v.log.select("reader_id", "title", F.col("author").alias("authors"),
                                  F.col("rating_text").alias("My Rating"),
                                  F.col("date_text").alias("Last Date Read"), "my_tags"), path)
    return tables.log_csv(v.spark, path).select(
        F.col("reader_id").cast("bigint").alias("reader_id"), "title", "author", "rating",
        F.col("read_on").cast("string").alias("read_on"), "my_tags")


duck.TABLES["children"] = """
SELECT item_key, CASE kind WHEN 'signal' THEN polarity ELSE kind END AS child, pos, tag AS value FROM item_tags
UNION ALL SELECT src_key, 'link', pos, dst_key FROM item_links"""


def nested(v):
    """The catalogue in its nested form, made from the item, tag and link rows."""
    kids = v.item_tags.select("item_key", F.when(F.col("kind") == "signal", F.col("polarity"))
                              .otherwise(F.col("kind")).alias("child"), "pos", F.col("tag").alias("value"))
    links = v.item_links.select(F.col("src_key").alias("item_key"), F.lit("link").alias("child"),
                                "pos", F.col("dst_key").alias("value"))
    return tables.rebuild(v.items, kids.unionByName(links))


def _nested_files(v):
    path, entries = fresh_path(v.spark, "catalogue-json"), nested(v)
    # One JSON object holds about 500 entries, however many there are.
    shard = F.pmod(F.xxhash64("item_key"), F.lit(-(-max(entries.count(), 1) // 500)))
    (entries.groupBy(shard.alias("shard"))
     .agg(F.map_from_entries(F.collect_list(F.struct("item_key", "entry"))).alias("entries"))
     .select("entries").write.json(path))
    return path


@query("s03_catalogue_json", """SELECT item_key, title, author, series, series_position, primary_genre, pages, rating, indie, classic,
  (SELECT count(*) FROM children c WHERE c.item_key = i.item_key) AS n_children FROM items i""")
def s03(v):
    rows = tables.catalogue_json(v.spark, _nested_files(v))
    sizes = [F.size(f"entry.{c}") for c in ("taste_signals.positive", "taste_signals.negative", "themes",
                                            "content_flags", "comparable_books")]
    return rows.select("item_key", "entry.title", "entry.author", "entry.series", "entry.series_position",
                       "entry.primary_genre", "entry.pages", "entry.rating", "entry.indie", "entry.classic",
                       sum(sizes[1:], sizes[0]).cast("bigint").alias("n_children"))


@query("s04_star_tables", """SELECT item_key, child, row_number() OVER (PARTITION BY item_key, child ORDER BY pos) - 1 AS pos, value FROM children
UNION ALL SELECT item_key, 'names', 0, tn || '/' || ts || '/' || an FROM items_n""")
def s04(v):
    n = nested(v)
    names = tables.star_items(n).select("item_key", F.lit("names").alias("child"), F.lit(0).alias("pos"),
                                        F.concat_ws("/", "title_norm", "title_short", "author_norm").alias("value"))
    return tables.star_children(n).unionByName(names).withColumn("pos", F.col("pos").cast("bigint"))


@query("s05_rebuild_entry", """SELECT i.item_key, i.title, i.pages,
  coalesce(string_agg(value, '|' ORDER BY pos) FILTER (child = 'positive'), '') AS positive,
  coalesce(string_agg(value, '|' ORDER BY pos) FILTER (child = 'negative'), '') AS negative,
  coalesce(string_agg(value, '|' ORDER BY pos) FILTER (child = 'theme'), '') AS themes,
  coalesce(string_agg(value, '|' ORDER BY pos) FILTER (child = 'link'), '') AS links
FROM items i LEFT JOIN children c ON c.item_key = i.item_key GROUP BY i.item_key, i.title, i.pages""")
def s05(v):
    flat = nested(v)
    again = tables.rebuild(tables.star_items(flat), tables.star_children(flat)).select("item_key", "entry.*")
    return again.select("item_key", "title", "pages", F.array_join("taste_signals.positive", "|").alias("positive"),
                        F.array_join("taste_signals.negative", "|").alias("negative"),
                        F.array_join("themes", "|").alias("themes"),
                        F.array_join("comparable_books", "|").alias("links"))


@query("s06_slim_index", """SELECT item_key, title, author, series, series_status, series_role, author_entry_point, primary_genre,
  (SELECT string_agg(dst_key, '|' ORDER BY pos) FROM item_links l WHERE l.src_key = i.item_key) AS comparable_books FROM items i""")
def s06(v):
    return tables.slim_index(v.items, v.item_links).withColumn(
        "comparable_books", F.array_join("comparable_books", "|"))


@query("s07_csv_sink", """SELECT '"' || replace(title, '"', '""') || '","' || authors || '",' || CASE WHEN pages IS NULL THEN '' ELSE '"' || pages || '"' END AS line
FROM library""")
def s07(v):
    path = fresh_path(v.spark, "sink-csv")
    tables.write_csv(v.sql(LIBRARY).select("title", "authors", "pages"), path)
    lines = v.spark.read.text(path).filter(F.col("value") != "title,authors,pages")
    return lines.filter(~F.col("value").isin('"title","authors","pages"')).select(
        F.regexp_replace("value", ',""$', ",").alias("line"))


@query("s08_stacked_proposal", """SELECT pk, title, CASE WHEN pk % 2 = 0 AND pk % 5 <> 0 THEN 'proposed' ELSE series_type END AS series_type FROM library""")
def s08(v):
    base = v.sql(LIBRARY).select("pk", "title", "series_type")
    proposal = base.filter("pk % 2 = 0").select("pk", F.when(F.col("pk") % 5 != 0, F.lit("proposed")).alias("series_type"))
    return tables.stacked(base, proposal, "pk")


_MARKDOWN = """SELECT doc_id, text || chr(10) || chr(10) || '| Goal | Target | Notes |' || chr(10) || '|---|---|---|' || chr(10)
  || '| fantasy | 35 | title |' || chr(10) || chr(10) || '| Title | Author | Notes |' || chr(10) || '|:---|---|---|' || chr(10)
  || '| *' || split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || '* | **' || split_part(text, ' ', 3) || '** | n <!-- key: '
  || split_part(text, ' ', 4) || ' --> |' || chr(10) || '| ' || split_part(text, ' ', 5) || ' | _' || split_part(text, ' ', 6) || '_ |' || chr(10)
  || '| only |' || chr(10) || '| `' || source || '` | ' || lang || ' | x |' || chr(10) || 'prose' || chr(10) || '| after | prose | y |' AS text
FROM documents"""
duck.TABLES["md_lines"] = f"""
SELECT doc_id, n, trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS line FROM (
  SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) - 1 AS n FROM (
    SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\f\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS list FROM ({_MARKDOWN})))"""


def _emph(e: str) -> str:
    for _ in range(2):
        for m in (r"\*\*", "__", r"\*", "_", "`"):
            e = f"trim(regexp_replace({e}, '(?s)^{m}(.+){m}$', '\\1'))"
    return e


duck.TABLES["md_cells"] = """
SELECT *, len(cells) >= 2 AND len(list_filter(cells, lambda c: NOT regexp_matches(c, '^[-: ]+$'))) = 0 AS rule,
  sum(CASE WHEN starts_with(line, '|') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS block
FROM (SELECT *, list_transform(string_split(regexp_replace(line, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: trim(c)) AS cells FROM md_lines)"""
duck.TABLES["md_state"] = """
SELECT *, last_value(CASE WHEN rule AND prev_plain THEN [list_position(prev_low, 'title'), list_position(prev_low, 'author')] END IGNORE NULLS)
    OVER (PARTITION BY doc_id, block ORDER BY n) AS head
FROM (SELECT *, starts_with(line, '|') AND len(cells) >= 2 AND NOT rule AS plain,
  lag(starts_with(line, '|') AND len(cells) >= 2 AND NOT rule) OVER w AS prev_plain,
  lag(list_transform(cells, lambda c: lower(c))) OVER w AS prev_low FROM md_cells WINDOW w AS (PARTITION BY doc_id ORDER BY n))"""


@query("s09_markdown_tables", f"""SELECT doc_id, n, title, author, item_key FROM (
  SELECT doc_id, n, {_emph('trim(cells[head[1]])')} AS title, {_emph('trim(cells[head[2]])')} AS author,
    nullif(regexp_extract(line, '<!--\\s*key:\\s*(.+?)\\s*-->', 1), '') AS item_key
  FROM md_state WHERE plain AND head[1] > 0 AND head[2] > 0 AND greatest(head[1], head[2]) <= len(cells))
WHERE NOT regexp_matches(title, '^[-: ]*$')""")
def s09(v):
    return markdown.book_tables(v.sql(_MARKDOWN)).withColumn("n", F.col("n").cast("bigint"))


_PROFILE = """SELECT doc_id, '# Profile' || chr(10) || text || chr(10) || '## Reader Preferences' || chr(10) || '- ' || split_part(text, ' ', 1)
  || CASE doc_id % 9 WHEN 0 THEN ' < 450 pages' WHEN 1 THEN ' no more than 600+ pages please' WHEN 2 THEN ' avoid doorstops'
     WHEN 3 THEN ' more indie, fewer classics' WHEN 4 THEN ' less indie and more classic' WHEN 5 THEN ' doorstop lover, prefer indie'
     WHEN 6 THEN ' under 500 pages' WHEN 7 THEN ' under500 pages' ELSE ' nothing' END || chr(10) || '- ' || split_part(text, ' ', 2) || ' fewer classics'
  || chr(10) || '## Taste vectors' || chr(10) || '- **' || split_part(text, ' ', 3) || ' x** (prose)' || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '- Status: Demoted' || chr(10) ELSE '' END
  || '- *' || split_part(text, ' ', 4) || ' one* by ' || split_part(text, ' ', 5) || ' b' || chr(10) || '- *two* (Some Author)' || chr(10)
  || 'more indie' || chr(10) || '- **Empty**' || chr(10) || '## Other' || chr(10) || '- more indie' || chr(10) || '- *no* by one' AS text FROM documents"""
duck.TABLES["pf_lines"] = duck.TABLES["md_lines"].replace(_MARKDOWN, _PROFILE)


_PREFS = """WITH h AS (SELECT *, last_value(CASE WHEN starts_with(line, '## ') THEN lower(trim(substr(line, 4))) END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY n) AS heading FROM pf_lines),
b AS (SELECT doc_id, n, trim(substr(line, 3)) AS raw, lower(trim(substr(line, 3))) AS low FROM h
  WHERE starts_with(line, '- ') AND regexp_matches(heading, 'preference|avoid|constraint')),
c AS (SELECT *, CAST(coalesce(nullif(regexp_extract(low, '(?:under|below|<\\s*)(\\d{2,4})\\s*pages?', 1), ''),
    nullif(regexp_extract(low, '(?:over|above|>\\s*|no\\s+more\\s+than\\s+)(\\d{2,4})\\+?\\s*pages?', 1), ''),
    CASE WHEN regexp_matches(low, 'doorstop|long book') AND regexp_matches(low, 'no |avoid|less') THEN '500' END) AS BIGINT) AS cap FROM b)
SELECT doc_id, n, 'page_cap' AS kind, CAST(NULL AS VARCHAR) AS tag, cap AS page_limit, raw FROM c WHERE cap IS NOT NULL
UNION ALL SELECT doc_id, n, CASE WHEN regexp_matches(low, 'more|prefer') THEN 'prefer' ELSE 'avoid' END, t.tag, NULL, raw
FROM c, (VALUES ('indie'), ('classic')) t(tag) WHERE cap IS NULL AND contains(low, t.tag) AND regexp_matches(low, 'more|prefer|less|fewer')"""
duck.TABLES["prefs"] = _PREFS


@query("s10_preference_notes", _PREFS)
def s10(v):
    return markdown.preference_notes(v.sql(_PROFILE)).withColumn("n", F.col("n").cast("bigint"))


@query("s11_taste_vector_section", """WITH h AS (SELECT *, count(*) FILTER (starts_with(line, '## ')) OVER w AS section,
    last_value(CASE WHEN starts_with(line, '## ') THEN lower(trim(substr(line, 4))) END IGNORE NULLS) OVER w AS heading
  FROM pf_lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
s AS (SELECT *, nullif(regexp_extract(line, '^-\\s+\\*\\*(.+?)\\*\\*', 1), '') AS name FROM h WHERE heading = 'taste vectors' AND NOT starts_with(line, '## ')),
g AS (SELECT *, count(name) OVER (PARTITION BY doc_id ORDER BY n) AS vector_no FROM s),
k AS (SELECT *, lower(regexp_extract(line, '^-\\s+[Ss]tatus:\\s*(\\w+)', 1)) AS st FROM g WHERE vector_no > 0),
heads AS (SELECT doc_id, vector_no, max(trim(name)) AS vector, coalesce(max(nullif(st, '')), 'active') AS status FROM k GROUP BY 1, 2),
ex AS (SELECT doc_id, vector_no, n, trim(regexp_extract(line, '^-\\s+\\*(.+?)\\*\\s+(?:by\\s+|[\\(\\[]?)(.+)', 1)) AS title,
  trim(regexp_replace(regexp_extract(line, '^-\\s+\\*(.+?)\\*\\s+(?:by\\s+|[\\(\\[]?)(.+)', 2), '[) \\]]+$', '')) AS author
  FROM k WHERE name IS NULL AND st = '' AND regexp_matches(line, '^-\\s+\\*(.+?)\\*\\s+(?:by\\s+|[\\(\\[]?)(.+)'))
SELECT h.doc_id, h.vector_no, h.vector, h.status, e.n, e.title, e.author FROM heads h LEFT JOIN ex e ON e.doc_id = h.doc_id AND e.vector_no = h.vector_no""")
def s11(v):
    return markdown.taste_vectors(v.sql(_PROFILE)).withColumn("n", F.col("n").cast("bigint"))


_STATE = """SELECT c_custkey AS reader_id, CASE WHEN c_custkey % 10 = 0 THEN '{}' ELSE '{"n_target": ' || CAST(20 + c_custkey % 30 AS STRING)
  || CASE WHEN c_custkey % 3 = 0 THEN ', "page_budget": {"target_avg": 350.5}' WHEN c_custkey % 3 = 1 THEN ', "page_budget": {"cap": 420.0}' ELSE '' END
  || CASE WHEN c_custkey % 4 = 0 THEN ', "preferences": {"expansion_appetite": "' || CASE WHEN c_custkey % 8 = 0 THEN 'high' ELSE 'odd' END
     || '", "series_commitment": "test-first", "audio_preference": true}' ELSE '' END
  || ', "events": [{"type": "rejected", "key": "' || c_name || '"}, {"type": "defended"}]}' END AS state FROM customer"""


@query("s12_state_upgrade", f"""SELECT reader_id, CAST(2 AS BIGINT) AS version, coalesce(CAST(json_extract(state, '$.n_target') AS BIGINT), 100) AS n_target,
  coalesce(CAST(json_extract(state, '$.page_budget.target_avg') AS DOUBLE), CAST(json_extract(state, '$.page_budget.cap') AS DOUBLE)) AS page_target,
  CASE WHEN json_extract_string(state, '$.preferences.series_commitment') IN ('binary', 'test-first') THEN json_extract_string(state, '$.preferences.series_commitment') ELSE 'binary' END AS series_commitment,
  CASE WHEN json_extract_string(state, '$.preferences.expansion_appetite') IN ('high', 'moderate', 'low') THEN json_extract_string(state, '$.preferences.expansion_appetite') ELSE 'moderate' END AS expansion_appetite,
  coalesce(CAST(json_extract(state, '$.preferences.audio_preference') AS BOOLEAN), false) AS audio_flagged,
  coalesce(CAST(json_array_length(state, '$.events') AS BIGINT), 0) AS n_events, json_extract_string(state, '$.events[0].key') AS first_key
FROM ({_STATE})""")
def s12(v):
    s = records.reader_state(v.sql(_STATE))
    return s.select(F.col("reader_id").cast("bigint").alias("reader_id"), "version", "n_target", "page_target",
                    "series_commitment", "expansion_appetite", "audio_flagged",
                    F.size("events").cast("bigint").alias("n_events"), F.get("events.key", 0).alias("first_key"))


_MARKS = """SELECT reader_id, seq, title, author, CASE type WHEN 'accepted' THEN 'selected' WHEN 'rejected' THEN 'rejected' WHEN 'defended' THEN 'shown' END AS status,
  CAST(seq % 7 AS STRING) AS batch_id, CASE WHEN seq % 5 = 0 THEN 'given' END AS primary_genre FROM feedback"""


@query("s13_ledger", f"""SELECT m.reader_id, m.title, m.batch_id, coalesce(m.status, 'shown') AS status, {duck.norm_old('m.title')} AS title_norm,
  coalesce(m.primary_genre, i.primary_genre) AS primary_genre, i.indie, i.classic, i.pages
FROM ({_MARKS}) m LEFT JOIN old_pairs p ON p.title_norm = {duck.norm_old('m.title')} AND p.author_norm = {duck.norm_old('m.author')}
LEFT JOIN items i ON i.item_key = p.item_key WHERE m.seq % 10 <> 9""")
def s13(v):
    path = fresh_path(v.spark, "ledger")
    marks = v.sql(_MARKS)
    line = F.when(F.col("seq") % 10 == 9, F.lit('{"title": broken')).otherwise(F.to_json(F.struct(
        *[c for c in marks.columns if c != "seq"])))
    marks.select(line.alias("value")).write.text(path)
    scanned = records.ledger_scan(v.spark, path)
    return records.ledger_rows(scanned, v.items).select(
        "reader_id", "title", "batch_id", "status", "title_norm", "primary_genre", "indie", "classic", "pages")


@query("s13_ledger_append", f"""SELECT reader_id, title, author, batch_id, status, primary_genre, n FROM (SELECT reader_id, title, author, batch_id, coalesce(status, 'shown') AS status, primary_genre, 2 * count(*) AS n FROM ({_MARKS}) GROUP BY ALL)""")
def s13a(v):
    """Two appends to one ledger, read back."""
    path, marks = fresh_path(v.spark, "appended"), v.sql(_MARKS)
    shown = marks.withColumn("status", F.coalesce("status", F.lit("shown"))).drop("seq")
    for _ in range(2):
        records.append_ledger(shown, path)
    back = records.ledger_scan(v.spark, path)
    names = ["reader_id", "title", "author", "batch_id", "status", "primary_genre"]
    return back.groupBy(*names).agg(F.count("*").alias("n"))


_REPLIES = """SELECT doc_id, replace(replace(text, '{', '('), '}', ')') || CASE WHEN doc_id % 4 = 0 THEN ' no block {"k' || CAST(doc_id AS STRING) || '": 1999, "s": "1850", "t": 12, "b": true, "n": null} end'
  WHEN doc_id % 4 = 1 THEN chr(10) || '```json' || chr(10) || '{"k' || CAST(doc_id AS STRING) || '": "2001", "u": 2500, "w": "x", "f": false, "l": ["a", 3, "b"]}' || chr(10) || '``` and {"not": "this"}'
  WHEN doc_id % 4 = 2 THEN ' {"broken": ' ELSE '```' || '{"e": {"series_role": "' || CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'odd' END || '", "author_entry_point": true}}```' END AS text FROM documents"""


@query("s14_response_values", f"""WITH r AS (SELECT doc_id, regexp_extract(text, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1) AS a, regexp_extract(text, '(?s)(\\{{.*\\}})', 1) AS b FROM ({_REPLIES})),
o AS (SELECT doc_id, CASE WHEN a <> '' AND json_valid(a) THEN a WHEN b <> '' AND json_valid(b) THEN b END AS j FROM r),
e AS (SELECT doc_id, unnest(json_keys(j)) AS raw_key, j FROM o WHERE j IS NOT NULL),
t AS (SELECT doc_id, raw_key, json_type(j, '$."' || raw_key || '"') AS ty, json_extract_string(j, '$."' || raw_key || '"') AS s, j FROM e)
SELECT doc_id, raw_key, 'year' AS kind, CAST(TRY_CAST(s AS BIGINT) AS VARCHAR) AS value FROM t
  WHERE ty = 'NULL' OR (ty IN ('UBIGINT', 'BIGINT', 'VARCHAR') AND TRY_CAST(s AS BIGINT) BETWEEN 1000 AND 2100)
UNION ALL SELECT doc_id, raw_key, 'flag', s FROM t WHERE ty IN ('NULL', 'BOOLEAN')
UNION ALL SELECT doc_id, raw_key, 'entry', CASE WHEN json_extract_string(j, '$.e.series_role') = 'first' THEN 'first/true' ELSE '/true' END FROM t WHERE raw_key = 'e'
UNION ALL SELECT doc_id, raw_key, 'list', unnest(['0:a', '2:b']) FROM t WHERE raw_key = 'l'""")
def s14(v):
    rows = records.response_values(v.sql(_REPLIES))
    years = records.valid_years(rows).select("doc_id", "raw_key", F.lit("year").alias("kind"), F.col("year").cast("string").alias("value"))
    flags = records.valid_flags(rows).select("doc_id", "raw_key", F.lit("flag").alias("kind"), F.col("flag").cast("string").alias("value"))
    entries = records.valid_entry_points(rows.filter("raw_key = 'e'")).select("doc_id", "raw_key", F.lit("entry").alias("kind"), F.concat(
        F.coalesce("series_role", F.lit("")), F.lit("/"), F.col("entry_point").cast("string")).alias("value"))
    lists = records.valid_lists(rows.filter("raw_key = 'l'")).select("doc_id", "raw_key", F.lit("list").alias("kind"),
                                                                    F.concat_ws(":", "pos", "pick").alias("value"))
    return years.unionByName(flags).unionByName(entries).unionByName(lists)


_CHOSEN = """SELECT CAST(floor(pk / 20) AS BIGINT) AS doc_id, '{' || string_agg('"' || replace(tag, '-', ' ') || ' ' || CAST(pk AS STRING) || '": ' || CASE pk % 4 WHEN 0 THEN '"nope"' WHEN 1 THEN '7' ELSE '"' || tag || '"' END, ', ') || '}' AS text
FROM (SELECT i.pk, min(t.tag) AS tag FROM items i JOIN good_tags t ON t.item_key = i.item_key GROUP BY i.pk) GROUP BY 1"""


@query("s14_allowed_ids", """SELECT CAST(floor(pk / 20) AS BIGINT) AS doc_id, replace(tag, '-', ' ') || ' ' || CAST(pk AS VARCHAR) AS raw_key, CASE WHEN pk % 4 >= 2 THEN tag END AS canonical_id
FROM (SELECT i.pk, min(t.tag) AS tag FROM items i JOIN good_tags t ON t.item_key = i.item_key GROUP BY i.pk)""")
def s14i(v):
    """Phrases answered with closed-list IDs; anything else becomes null."""
    return records.valid_ids(records.response_values(v.sql(_CHOSEN)), v.good_tags)


@query("s15_request_batches", """WITH r AS (SELECT *, row_number() OVER (ORDER BY item_key) - 1 AS n FROM items WHERE status = 'pending'),
j AS (SELECT CAST(floor(n / 20) AS BIGINT) AS chunk, n % 20 + 1 AS line_no, title, author, list_filter([
   '"series":"' || series || '"', '"series_position":"' || series_position || '"', '"series_status":"' || series_status || '"',
   '"pages":' || CAST(pages AS VARCHAR), '"rating":' || CAST(rating AS VARCHAR), '"genre_hint":"' || primary_genre || '"'], lambda x: x IS NOT NULL) AS parts FROM r)
SELECT chunk, count(*) AS n_rows, string_agg(CAST(line_no AS VARCHAR) || '. ' || title || ' by ' || author || chr(10) || '   Context: {' || array_to_string(parts, ',') || '}', chr(10) || chr(10) ORDER BY line_no) AS prompt
FROM j GROUP BY chunk""")
def s15(v):
    return records.request_batches(v.items.filter("status = 'pending'"))
