"""Roles (items, log, picks, events, vectors ...) derived from the driver tables.

Each role is one SQL query that both Spark and DuckDB run, so an oracle can put
the same text in its WITH clause.  Two dialect differences: ``@grid(n)`` is a row
generator over 0..n-1, and Spark counts ``rn`` in 64 bits as DuckDB does by itself.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException

from bookloom.operators.common import fresh_path, keep

ADJECTIVES = ["small", "red", "blue", "hot", "large", "old", "new", "cold"]
NOUNS = ["ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod"]
TYPES = ["economy", "small", "promo", "standard", "medium", "large"]


def _pick(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {expr} {arms} END)"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _pad(expr: str) -> str:
    return f"lpad({_s(expr)}, 2, '0')"


_POSITION = f"""CASE WHEN series IS NULL THEN NULL
    WHEN pk % 29 = 0 THEN 'Prequel'
    WHEN pk % 31 = 0 THEN 'Book 0.5'
    WHEN pk % 23 = 0 THEN 'Book ' || {_s('rn')} || '.5'
    WHEN pk % 43 = 0 THEN 'Book ..'
    WHEN brand_no % 4 = 0 THEN 'Book ' || {_s('rn')} || ' (' || CASE pk % 5
        WHEN 0 THEN 'City Watch Book ' || {_s('rn')}
        WHEN 1 THEN 'Death #' || {_s('rn')}
        WHEN 2 THEN 'Book ' || {_s('rn')} || ' in Witches subseries'
        WHEN 3 THEN 'The Wizards, Book ' || {_s('rn')}
        ELSE 'novella' END || ')'
    ELSE 'Book ' || {_s('rn')} END"""

ROLES: dict[str, str] = {
    "part_rows": f"""
SELECT CAST(p_partkey AS BIGINT) AS pk, p_name, split_part(p_name, ' ', 1) AS adj,
       split_part(p_name, ' ', 2) AS noun, lower(p_type) AS genre, p_type,
       CAST(p_size AS BIGINT) AS p_size, CAST(substr(p_brand, 7) AS BIGINT) AS brand_no,
       replace(p_brand, '#', '') || 'x' || {_s('CAST(floor(p_partkey / 2000) AS BIGINT)')} AS surname,
       CAST(floor(p_partkey / 160) AS BIGINT) AS vol
FROM part""",
    "item_names": f"""
SELECT *,
       CASE WHEN pk % 7 = 0 THEN 'The ' ELSE '' END
         || CASE WHEN pk % 9 = 0 THEN 'Colour of ' ELSE '' END || p_name || ' ' || {_s('vol')}
         || CASE WHEN pk % 5 = 0 THEN ': A Novel' ELSE '' END AS title,
       CASE WHEN pk % 13 = 0 THEN 'K. J. ' || surname
            WHEN pk % 17 = 0 THEN p_type || ' ' || surname || ' & Pat Quill'
            ELSE p_type || ' ' || surname END AS author,
       CASE WHEN p_size % 5 <> 0 THEN surname || '/' || p_type END AS series
FROM part_rows""",
    "item_ranks": """
SELECT *, row_number() OVER (PARTITION BY series ORDER BY pk) AS rn,
       row_number() OVER (PARTITION BY title, author ORDER BY pk) AS copy_no
FROM item_names""",
    "items": f"""
SELECT title || ' - ' || author
         || CASE WHEN copy_no > 1 THEN ' [' || {_s('pk')} || ']' ELSE '' END AS item_key,
       pk, title, author, series,
       {_POSITION} AS series_position,
       CASE WHEN series IS NULL THEN CASE WHEN pk % 3 = 0 THEN 'Short Stories' ELSE 'Standalone' END
            WHEN pk % 47 = 0 THEN NULL
            WHEN (brand_no + length(p_type)) % 5 IN (0, 4) THEN 'Long Series'
            WHEN (brand_no + length(p_type)) % 5 = 3 THEN 'Standalone'
            ELSE 'Short Series' END AS series_status,
       CASE WHEN pk % 37 = 0 THEN NULL
            WHEN brand_no % 8 = 5 THEN CASE WHEN series IS NOT NULL THEN CASE WHEN rn <= 5 THEN 'mid' ELSE 'late' END END
            WHEN series IS NULL THEN 'standalone'
            WHEN (brand_no + length(p_type)) % 5 = 3
              THEN CASE WHEN rn = 1 THEN 'loose-entry' ELSE 'loose-mid' END
            WHEN rn = 1 THEN 'first' WHEN rn <= 5 THEN 'mid' ELSE 'late' END AS series_role,
       CASE WHEN brand_no % 8 = 5 THEN CASE WHEN pk % 2 = 0 THEN false END
            ELSE CASE pk % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END END AS author_entry_point,
       genre AS primary_genre,
       CASE WHEN pk % 3 = 0 THEN {_pick('pk % 6', TYPES)} END AS secondary_genre,
       CASE WHEN pk % 6 = 0 THEN true WHEN pk % 6 = 1 THEN NULL ELSE false END AS indie,
       CASE WHEN pk % 8 <= 1 THEN true WHEN pk % 8 = 2 THEN NULL ELSE false END AS classic,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 20 END AS pages,
       CASE WHEN pk % 97 = 0 THEN NULL
            ELSE CAST(300 + (pk * 37) % 200 AS DOUBLE) / 100 END AS rating,
       CASE WHEN pk % 101 = 0 THEN NULL
            WHEN pk % 41 = 0 THEN CAST(floor(200000 / (rn * rn) / 100) AS BIGINT)
            ELSE CAST(floor(200000 / (rn * rn)) AS BIGINT) END AS reviews,
       CASE WHEN pk % 53 = 0 THEN NULL ELSE 1950 + pk % 75 END AS pub_year,
       CASE WHEN pk % 10 = 0 THEN 'pending' WHEN pk % 10 = 1 THEN 'needs_review'
            ELSE 'complete' END AS status,
       CASE WHEN pk % 7 = 0 THEN 'Low' ELSE 'High' END AS confidence
FROM item_ranks""",
    "item_tags": f"""
SELECT i.item_key, g.kind, g.polarity, g.pos, g.tag
FROM items i JOIN (
  SELECT pk, 'signal' AS kind, 'positive' AS polarity, 0 AS pos, adj || '-' || {_s('pk % 2')} AS tag FROM part_rows
  UNION ALL SELECT pk, 'signal', 'positive', 1, genre || '-' || {_s('pk % 2')} FROM part_rows
  UNION ALL SELECT pk, 'signal', 'negative', 0, adj || '-' || {_s('(pk + 1) % 2')} FROM part_rows WHERE pk % 4 = 0
  UNION ALL SELECT pk, 'theme', CAST(NULL AS STRING), 0, noun || '-' || {_s('pk % 2')} FROM part_rows
  UNION ALL SELECT pk, 'theme', CAST(NULL AS STRING), 1, 'shared-' || {_s('pk % 11')} FROM part_rows WHERE pk % 3 = 0
  UNION ALL SELECT pk, 'flag', CAST(NULL AS STRING), 0, 'violence' FROM part_rows WHERE pk % 12 = 0
) g ON g.pk = i.pk""",
    "good_tags": """
SELECT DISTINCT item_key, kind, tag FROM item_tags
WHERE kind = 'theme' OR (kind = 'signal' AND polarity = 'positive')""",
    "basket": """
SELECT CAST(l_partkey AS BIGINT) AS pk, CAST(l_orderkey AS BIGINT) AS l_orderkey,
       CAST(l_linenumber AS BIGINT) AS l_linenumber,
       lead(CAST(l_partkey AS BIGINT)) OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS next_pk
FROM lineitem""",
    "link_pairs": """
SELECT pk, next_pk, min(l_orderkey) AS first_order, count(*) AS n
FROM basket WHERE next_pk IS NOT NULL GROUP BY pk, next_pk""",
    "raw_links": """
SELECT s.item_key AS src_key,
       row_number() OVER (PARTITION BY p.pk ORDER BY p.first_order, p.next_pk) AS pos,
       CASE WHEN p.next_pk % 7 = 0 THEN 'Lost Volume ' || CAST(p.next_pk % 21 AS STRING) || ' - Nobody'
            WHEN p.next_pk % 7 = 1 THEN upper(d.item_key)
            WHEN p.next_pk % 7 = 2 THEN replace(d.item_key, ' - ', '  — ')
            WHEN p.next_pk % 11 = 3 THEN s.item_key
            ELSE d.item_key END AS dst_key
FROM link_pairs p JOIN items s ON s.pk = p.pk JOIN items d ON d.pk = p.next_pk""",
    "item_links": """
SELECT l.src_key, d.item_key AS dst_key, min(l.pos) AS pos
FROM raw_links l JOIN items d ON d.item_key = l.dst_key
GROUP BY l.src_key, d.item_key""",
    "sold": f"""
SELECT CAST(o.o_custkey AS BIGINT) AS reader_id, CAST(l.l_orderkey AS BIGINT) AS l_orderkey,
       CAST(l.l_linenumber AS BIGINT) AS ln, CAST(l.l_suppkey AS BIGINT) AS l_suppkey,
       CAST(l.l_quantity AS BIGINT) AS q, l.l_returnflag, CAST(o.o_orderdate AS DATE) AS day,
       i.pk, i.title, i.author, i.item_key,
       {_s('l.l_orderkey')} || '.' || {_s('l.l_linenumber')} || '.' || {_s('l.l_partkey')}
         || '.' || {_s('l.l_suppkey')} AS log_id
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN items i ON i.pk = l.l_partkey""",
    "log": f"""
SELECT reader_id, log_id, day AS logged_on,
       CASE WHEN ln = 7 THEN replace(title, 'ring', 'rnig')
            WHEN ln % 5 = 1 THEN upper(title)
            WHEN ln % 5 = 2 THEN title || ' (Series)'
            WHEN ln % 5 = 3 THEN replace(title, 'Colour', 'Color')
            WHEN ln % 5 = 4 AND pk % 5 <> 0 THEN title || ': The Complete Edition'
            ELSE title END AS title,
       CASE WHEN l_suppkey % 6 = 1 AND pk % 13 <> 0 AND pk % 17 <> 0
              THEN split_part(author, ' ', 2) || ', ' || split_part(author, ' ', 1)
            WHEN l_suppkey % 6 = 2 THEN author || ' & Someone Else'
            WHEN l_suppkey % 6 = 3 THEN lower(author)
            WHEN l_suppkey % 6 = 4 AND pk % 9 = 0 THEN 'Unrelated Writer'
            ELSE author END AS author,
       CASE WHEN q % 11 = 0 THEN '' WHEN q % 13 = 0 THEN 'n/a'
            WHEN q % 7 = 0 THEN {_s('1 + q % 4')} || '.5'
            ELSE {_s('1 + q % 5')} END AS rating_text,
       CASE l_orderkey % 5
            WHEN 0 THEN {_s('month(day)')} || '/' || {_s('day(day)')} || '/' || {_s('year(day)')}
            WHEN 1 THEN {_s('year(day)')} || '-' || {_pad('month(day)')} || '-' || {_pad('day(day)')}
            WHEN 2 THEN {_s('month(day)')} || '/' || {_s('day(day)')} || '/' || {_pad('year(day) % 100')}
            WHEN 3 THEN {_s('year(day)')} || '/' || {_s('month(day)')} || '/' || {_s('day(day)')}
            ELSE 'sometime' END AS date_text,
       CASE WHEN pk % 50 = 0 THEN 'owned, *completed' WHEN pk % 3 = 0 THEN ' sci-fi ,Indie,, owned'
            ELSE 'owned' END AS my_tags
FROM sold""",
    "picks": """
SELECT DISTINCT reader_id,
       CASE WHEN ln % 4 = 1 THEN upper(title) ELSE title END AS title,
       CASE WHEN l_suppkey % 5 = 1 THEN author || ' & Someone Else' ELSE author END AS author,
       CASE WHEN ln % 3 = 0 AND l_suppkey % 10 = 0 THEN 'Missing - Nobody'
            WHEN ln % 3 = 0 THEN item_key END AS item_key
FROM sold WHERE l_returnflag = 'R'""",
    "event_rows": """
SELECT CAST(event_id AS BIGINT) AS seq, CAST(user_id AS BIGINT) AS reader_id, ts,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
       CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected'
            WHEN 'view' THEN 'rejected' WHEN 'click' THEN 'defended'
            ELSE 'session_lock' END AS type
FROM events""",
    "feedback": """
SELECT e.reader_id, e.seq, e.ts, e.type,
       CASE WHEN e.k % 5 <> 4 THEN 'v' || CAST(e.k % 2 AS STRING) END AS vector,
       CASE WHEN e.k % 5 = 4 AND e.k % 10 = 4 THEN i.primary_genre END AS genre,
       i.item_key, i.title, i.author
FROM event_rows e JOIN items i ON i.pk = e.k""",
    "vector_grid": """
SELECT c, CAST(g AS BIGINT) AS i
FROM (SELECT CAST(c_custkey AS BIGINT) AS c, @grid(4) AS g FROM customer)""",
    "vectors": """
SELECT c AS reader_id, 'v' || CAST(i AS STRING) AS vector, i AS ord,
       CASE (c + i) % 6 WHEN 0 THEN CAST(NULL AS DOUBLE) WHEN 1 THEN 0.0e0
            ELSE CAST(1 + (c + i) % 4 AS DOUBLE) / 2 END AS weight,
       CASE (c + i) % 7 WHEN 0 THEN 'demoted' WHEN 1 THEN NULL ELSE 'active' END AS status
FROM vector_grid""",
    "member_grid": """
SELECT c, i, CAST(g AS BIGINT) AS j
FROM (SELECT c, i, @grid(4) AS g FROM vector_grid WHERE (c + i) % 9 <> 0)""",
    "vector_members": f"""
SELECT DISTINCT c AS reader_id, 'v' || {_s('i')} AS vector,
       CASE WHEN j <= 2 THEN 'signal' ELSE 'theme' END AS kind,
       CASE WHEN j <= 1 THEN {_pick('(c * 3 + i * 5 + j * 7) % 8', ADJECTIVES)} || '-' || {_s('(c + i + j) % 2')}
            WHEN j = 2 THEN {_pick('(c + i) % 6', TYPES)} || '-' || {_s('(c + j) % 2')}
            WHEN c % 2 = 0 OR i = 3 THEN {_pick('(c + i + j) % 8', NOUNS)} || '-' || {_s('(c + i) % 2')}
            ELSE 'shared-' || {_s('(c + i) % 11')} END AS tag
FROM member_grid""",
    "example_grid": """
SELECT c, i, CAST(g AS BIGINT) AS e
FROM (SELECT c, i, @grid(4) AS g FROM vector_grid WHERE (c + i) % 9 = 0)""",
    "vector_examples": """
SELECT g.c AS reader_id, 'v' || CAST(g.i AS STRING) AS vector, g.e AS pos,
       CASE WHEN g.e = 3 THEN 'No Such Title ' || CAST(g.c AS STRING) ELSE p.title END AS title,
       p.author
FROM (SELECT x.*, (x.c * 13 + x.i * 7 + x.e * 31) % n.parts AS pk
      FROM example_grid x CROSS JOIN (SELECT count(*) AS parts FROM part) n) g
JOIN items p ON p.pk = g.pk""",
    "reader_state": """
SELECT CAST(c_custkey AS BIGINT) AS reader_id, 20 + CAST(c_custkey AS BIGINT) % 30 AS n_target,
       CASE c_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low'
            ELSE 'moderate' END AS appetite,
       CASE WHEN c_custkey % 3 <> 0 THEN CAST(300 + c_custkey % 200 AS BIGINT) END AS page_target,
       CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 3 AS BIGINT) END AS long_series_cap
FROM customer""",
    "floors": f"""
SELECT CAST(c_custkey AS BIGINT) AS reader_id, 'indie' AS name, 'tag' AS kind,
       2 + CAST(c_custkey AS BIGINT) % 4 AS target FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT CAST(c_custkey AS BIGINT), 'classic', 'tag', 3 + CAST(c_custkey AS BIGINT) % 3
FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT CAST(c_custkey AS BIGINT), {_pick('c_custkey % 6', TYPES)}, 'genre',
       1 + CAST(c_custkey AS BIGINT) % 5 FROM customer""",
}

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

#: Roles that cost joins or windows: written once per application and folder, then read.
STORED = ["items", "item_tags", "link_pairs", "raw_links", "item_links", "log", "picks", "feedback"]
_kept: dict[tuple, str] = {}

_LITERAL = re.compile(r"'[^']*'")
_SOURCE = re.compile(r"(?:\b(?:FROM|JOIN)\b|,)\s*\(?\s*([A-Za-z_][A-Za-z0-9_]*)")


def with_roles(sql: str, extra: dict[str, str] | None = None, kind: str = "AS") -> str:
    """Prefix a query with the role CTEs it uses, in dependency order."""
    known = {**ROLES, **(extra or {})}
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in _SOURCE.findall(_LITERAL.sub("", text)):
            if word in known and word not in seen:
                seen.add(word)
                visit(known[word])
                order.append(word)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{name} {kind} ({known[name].strip()})" for name in order)
    joiner = ",\n" if sql.lstrip().upper().startswith("WITH ") else "\n"
    body = sql.lstrip()[5:] if joiner == ",\n" else sql
    return f"WITH {ctes}{joiner}{body}"


def for_spark(sql: str) -> str:
    # DuckDB numbers rows in 64 bits, Spark in 32, where the square of `rn` overflows.
    sql = re.sub(r"(row_number\(\) OVER \([^()]*\)) AS rn\b", r"CAST(\1 AS BIGINT) AS rn", sql)
    return re.sub(r"@grid\((\d+)\)", lambda m: f"explode(sequence(0, {int(m[1]) - 1}))", sql)


def for_duckdb(sql: str) -> str:
    return re.sub(r"@grid\((\d+)\)", r"unnest(range(\1))", sql)


class Roles:
    """Role DataFrames over one folder of driver tables, built on first use."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def table(self, name: str):
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in BASE_TABLES:
            return self.table(name)
        if name not in self._made:
            self._made[name] = self.sql(f"SELECT * FROM {name}")
        return self._made[name]

    def kept(self, name: str, build):
        """What build() gives, written once per application and folder of tables."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key in _kept:
            try:
                return self.spark.read.parquet(_kept[key])
            except AnalysisException:  # the shared folder was cleared meanwhile
                pass
        path = fresh_path(self.spark, name)
        keep(build(), path)
        _kept[key] = path
        return self.spark.read.parquet(path)

    def sql(self, text: str, plain: str | None = None):
        """Rows of a query over roles; `plain` is a role to compute here and now."""
        stored = {}
        for name in STORED:
            if name != plain and re.search(rf"\b{name}\b", with_roles(text)):
                self.kept(name, lambda: self.sql(f"SELECT * FROM {name}", name))
                path = _kept[self.spark.sparkContext.applicationId, self.sf_dir, name]
                stored[name] = f"SELECT * FROM parquet.`{path}`"
        full = for_spark(with_roles(text, stored))
        for t in BASE_TABLES:
            full = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b",
                          rf"\1\2parquet.`{self.sf_dir}/{t}.parquet`", full)
        return self.spark.sql(full)
