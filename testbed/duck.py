"""DuckDB spellings of the text rules, written apart from the Spark functions."""

from __future__ import annotations

from bookloom.functions.series import NOT_A_SUBSERIES

# Typographic characters and their plain forms.
_FROM = "‘’‚‛“”„‟–—−​‌‍﻿"
_TO = "''''\"\"\"\"---"
_NAME = r"([^\s,(&;/]+(?:\s+[^\s,(&;/]+)?)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plain(e: str) -> str:
    return f"translate(coalesce({e}, ''), {q(_FROM)}, {q(_TO)})"


def swap(e: str) -> str:
    return (f"(CASE WHEN regexp_matches({e}, '(?i)\\b(and|with)\\b') THEN {e} ELSE "
            f"regexp_replace({e}, '^\\s*{_NAME}\\s*,\\s*{_NAME}\\s*$', '\\2 \\1') END)")


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def initials(e: str) -> str:
    """Fold over words; a trailing control character marks an open run of letters."""
    return (f"rtrim(ltrim(list_reduce(list_prepend('', string_split({e}, ' ')), "
            "lambda acc, t: CASE WHEN regexp_matches(t, '^\\p{L}$') "
            "THEN CASE WHEN acc LIKE '%' || chr(1) THEN rtrim(acc, chr(1)) || t || chr(1) "
            "ELSE acc || ' ' || t || chr(1) END "
            "ELSE rtrim(acc, chr(1)) || ' ' || t END)), chr(1))")


def edges(e: str) -> str:
    e = f"regexp_replace({e}, '\\s*\\([^)]*\\)\\s*$', '')"
    e = f"lower(regexp_replace({e}, '^[^\\p{{L}}\\p{{N}}_]+', ''))"
    return f"regexp_replace({e}, '^(the|a|an)\\s+', '')"


def norm(e: str) -> str:
    e = f"replace({swap(plain(e))}, '&', ' and ')"
    e = f"split_part({edges(e)}, ':', 1)"
    return initials(squeeze(f"replace({e}, '.', ' ')"))


def norm_old(e: str) -> str:
    return squeeze(f"replace({edges(plain(e))}, '.', ' ')")


def short(e: str) -> str:
    return f"(CASE WHEN contains({e}, ':') THEN {norm(f'split_part({e}, {q(chr(58))}, 1)')} ELSE '' END)"


def fold(e: str) -> str:
    """Word-wise suffix fold; the first rule that fits wins."""
    # British suffix, American suffix, shortest word.
    rules = [("isations", "izations", 9), ("isation", "ization", 8), ("ising", "izing", 7),
             ("ised", "ized", 6), ("ise", "ize", 6), ("ours", "ors", 6), ("our", "or", 5)]
    arms = " ".join(f"WHEN length(w) >= {n} AND suffix(w, '{a}') "
                    f"THEN left(w, length(w) - {len(a)}) || '{b}'" for a, b, n in rules)
    return f"array_to_string(list_transform(string_split({e}, ' '), lambda w: CASE {arms} ELSE w END), ' ')"


SPLIT = r"(?i)\s*(?:&|;|/|,|\band\b|\bwith\b)\s*"


def pieces(e: str) -> str:
    return f"list_filter(list_transform(string_split_regex({e}, '{SPLIT}'), lambda p: trim(p)), lambda p: p <> '')"


def surnames(e: str) -> str:
    return f"list_transform({pieces(e)}, lambda p: list_extract(string_split(p, ' '), -1))"


def authors_match(a: str, b: str) -> str:
    wa, wb = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    return (f"(CASE WHEN {a} = '' OR {b} = '' THEN {a} = {b} ELSE {a} = {b} OR {swap(a)} = {b} "
            f"OR {a} = {swap(b)} OR list_has_all({wb}, {wa}) OR list_has_all({wa}, {wb}) "
            f"OR (len({pieces(a)}) > 1 AND len({pieces(b)}) > 1 "
            f"AND list_has_any({surnames(a)}, {surnames(b)})) END)")


def light(e: str) -> str:
    return squeeze(f"lower({plain(e)})")


def book_number(e: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(lower(coalesce({e}, '')), 'book\\s*([\\d.]+)', 1), '') AS DOUBLE)"


def order_no(e: str) -> str:
    return f"coalesce({book_number(e)}, 999.0)"


def rating(e: str) -> str:
    return f"TRY_CAST(nullif(trim({e}), '') AS DOUBLE)"


def date(e: str) -> str:
    e = f"trim({e})"
    mdy, ymd = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$"
    mdy2 = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"

    def made(p, y, m, d, century=False):
        year = f"CAST(regexp_extract({e}, '{p}', {y}) AS INTEGER)"
        if century:
            year = f"(CASE WHEN {year} >= 69 THEN 1900 + {year} ELSE 2000 + {year} END)"
        return (f"WHEN regexp_matches({e}, '{p}') THEN make_date({year}, "
                f"CAST(regexp_extract({e}, '{p}', {m}) AS INTEGER), "
                f"CAST(regexp_extract({e}, '{p}', {d}) AS INTEGER))")
    return (f"(CASE {made(mdy, 3, 1, 2)} {made(ymd, 1, 2, 3)} {made(mdy2, 3, 1, 2, True)} END)")


def bucket(day: str, today: str) -> str:
    age = f"date_diff('day', {day}, DATE '{today}')"
    return (f"(CASE WHEN {day} IS NULL THEN 'undated' WHEN {age} <= 365 THEN '<=12mo' "
            f"WHEN {age} <= 1095 THEN '12-36mo' ELSE '3+yrs' END)")


def rounded_sum(*parts: str) -> str:
    """Sum to thousandths, halves to even, counted in whole billionths."""
    n = "(" + " + ".join(f"CAST(round(coalesce({p}, 0) * 1e9) AS BIGINT)" for p in parts) + ")"
    low = f"CAST(floor({n} / 1e6) AS BIGINT)"
    rest = f"({n} - {low} * 1000000)"
    up = f"CASE WHEN {rest} > 500000 OR ({rest} = 500000 AND {low} % 2 <> 0) THEN 1 ELSE 0 END"
    return f"(({low} + {up}) / 1000.0e0)"


def hash01(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0)"


# Oracle-side tables built on the roles: normalised names and resolved rows.
TABLES: dict[str, str] = {
    "items_n": f"""
SELECT i.*, {norm('title')} AS tn, {short('title')} AS ts, {norm('author')} AS an,
       coalesce(reviews, 0) AS rev0 FROM items i""",
    "item_keys_n": f"""
SELECT DISTINCT item_key, an, rev0, pass, k FROM (
  SELECT item_key, an, rev0, 1 AS pass, tn AS k FROM items_n
  UNION ALL SELECT item_key, an, rev0, 1, ts FROM items_n
  UNION ALL SELECT item_key, an, rev0, 2, {fold('tn')} FROM items_n
  UNION ALL SELECT item_key, an, rev0, 2, {fold('ts')} FROM items_n) WHERE k <> ''""",
    "log_n": f"""
SELECT l.*, {norm('title')} AS tn, {norm('author')} AS an, {rating('rating_text')} AS rating,
       {date('date_text')} AS read_on FROM log l""",
    "picks_n": f"""
SELECT p.*, {norm('title')} AS tn, {norm('author')} AS an FROM picks p""",
    "asked": """
SELECT DISTINCT tn, an FROM (SELECT tn, an FROM log_n UNION ALL SELECT tn, an FROM picks_n)""",
    "ask_hits": f"""
SELECT a.tn, a.an, k.item_key, k.pass, k.an <> a.an AS differs, k.rev0
FROM asked a JOIN item_keys_n k
  ON (k.pass = 1 AND k.k = a.tn) OR (k.pass = 2 AND k.k = {fold('a.tn')})
WHERE a.tn <> '' AND {authors_match('a.an', 'k.an')}""",
    "answers": """
SELECT tn, an, item_key FROM (
  SELECT *, row_number() OVER (PARTITION BY tn, an ORDER BY pass, differs, rev0 DESC, item_key) AS r
  FROM ask_hits) WHERE r = 1""",
    "log_r": """
SELECT l.*, a.item_key AS item_key FROM log_n l LEFT JOIN answers a ON a.tn = l.tn AND a.an = l.an""",
    "list_pairs": """
SELECT reader_id, tn, an, min(item_key) AS direct FROM picks_n GROUP BY reader_id, tn, an""",
    "list_items": """
SELECT DISTINCT p.reader_id, coalesce(i.item_key, CASE WHEN p.direct IS NULL THEN a.item_key END) AS item_key
FROM list_pairs p LEFT JOIN items i ON i.item_key = p.direct
LEFT JOIN answers a ON a.tn = p.tn AND a.an = p.an
WHERE coalesce(i.item_key, CASE WHEN p.direct IS NULL THEN a.item_key END) IS NOT NULL""",
    "list_books": """
SELECT p.reader_id, i.* FROM list_items p JOIN items_n i ON i.item_key = p.item_key""",
    "active_vectors": """
SELECT * FROM vectors WHERE status IS DISTINCT FROM 'demoted'""",
    "active_members": """
SELECT m.* FROM vector_members m JOIN active_vectors v
  ON v.reader_id = m.reader_id AND v.vector = m.vector""",
}


def _horner(cs, x):
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def ppf(p: str) -> str:
    # Coefficients of the inverse normal approximation.
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00, 1.0]
    lo, hi = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - ({p})))"
    r, m = f"((({p}) - 0.5) * (({p}) - 0.5))", f"(({p}) - 0.5)"
    return (f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL "
            f"WHEN {p} < 0.02425 THEN {_horner(c, lo)} / {_horner(d, lo)} "
            f"WHEN {p} > 0.97575 THEN -{_horner(c, hi)} / {_horner(d, hi)} "
            f"ELSE {_horner(a, r)} * {m} / {_horner(b, r)} END)")


def pdf(x: str) -> str:
    return f"(exp(-0.5 * ({x}) * ({x})) / sqrt(2.0 * pi()))"


def sub_inner(e: str) -> str:
    skip = "|".join(NOT_A_SUBSERIES).replace(".", "\\.")
    inner = f"trim(regexp_extract(coalesce({e}, ''), '\\(([^)]+)\\)', 1))"
    return f"(CASE WHEN {inner} <> '' AND NOT regexp_matches(lower({inner}), '{skip}') THEN {inner} END)"


# The accepted sub-series spellings, in the order they are tried.
SUB_FORMS = [
    (r"(?i)^Book\s+([\d.]+)\s+in\s+(.+?)(?:\s+subseries)?$", 2, 1),
    (r"(?i)^(.+?),\s+Book\s+([\d.]+)$", 1, 2),
    (r"(?i)^(.+?)\s+(?:subseries|series)\s+Book\s+([\d.]+)$", 1, 2),
    (r"(?i)^(.+?)\s+(?:subseries|series)\s+#([\d.]+)$", 1, 2),
    (r"(?i)^(.+?)\s+Book\s+([\d.]+)$", 1, 2),
    (r"(?i)^(.+?)\s+#([\d.]+)$", 1, 2),
]


def sub_part(inner: str, want: str) -> str:
    arms = []
    for p, name, num in SUB_FORMS:
        n = f"TRY_CAST(nullif(regexp_extract({inner}, '{p}', {num}), '') AS DOUBLE)"
        value = f"regexp_extract({inner}, '{p}', {name})" if want == "name" else n
        arms.append(f"WHEN {n} IS NOT NULL THEN {value}")
    return "(CASE " + " ".join(arms) + " END)"


TABLES["subs"] = f"""
SELECT item_key, series_position, inner_text, {norm(sub_part('inner_text', 'name'))} AS sub_raw,
       {sub_part('inner_text', 'n')} AS sub_n
FROM (SELECT item_key, series_position, {sub_inner('series_position')} AS inner_text FROM items)"""
TABLES["subseries"] = """
SELECT item_key, CASE WHEN sub_n IS NOT NULL THEN sub_raw END AS sub_name, sub_n FROM subs"""
