"""Title and author identity as Column expressions.

Each normaliser is one straight chain of built-in string functions, so it stays
inside whole-stage codegen and can run during the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and their plain forms.  The last four
# (zero-width characters and the byte-order mark) have no plain form: dropped.
TYPOGRAPHIC = "‘’‚‛“”„‟–—−​‌‍﻿"
PLAIN = "''''\"\"\"\"---"

# British suffix, American suffix, shortest word it applies to.
SPELLING_SUFFIXES = [
    ("isations", "izations", 9),
    ("isation", "ization", 8),
    ("ising", "izing", 7),
    ("ised", "ized", 6),
    ("ise", "ize", 6),
    ("ours", "ors", 6),
    ("our", "or", 5),
]

# Separators between co-authors in one author field.
CO_AUTHOR_SPLIT = r"(?iU)\s*(?:&|;|/|,|\band\b|\bwith\b)\s*"

_NAME = r"([^\s,(&;/]+(?:\s+[^\s,(&;/]+)?)"
# One comma is tested first: most names have none and fail there at once.
_LAST_FIRST = rf"(?isU)^(?=[^,]*,[^,]*$)(?!.*\b(?:and|with)\b)\s*{_NAME}\s*,\s*{_NAME}\s*$"
_ANY_SUFFIX = r"(?:" + "|".join(s for s, _, _ in SPELLING_SUFFIXES) + r")(?: |$)"


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def plain_quotes(c) -> Column:
    return F.translate(_text(c), TYPOGRAPHIC, PLAIN)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s\s+|[^\S ]", " "))


def swap_last_first(c) -> Column:
    """``Last, First`` -> ``First Last``; author lists are left alone."""
    return F.regexp_replace(_text(c), _LAST_FIRST, "$2 $1")


def join_initials(c: Column) -> Column:
    """``k j parker`` -> ``kj parker``: drop the space between two lone letters."""
    return F.regexp_replace(c, r" (?<=(?:^| )\p{L} )(?=\p{L}(?: |$))", "")


def _drop_edges(c: Column) -> Column:
    c = F.regexp_replace(c, r"\([^)]*\)(?U:\s*)$", "")
    c = F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}_]+", ""))
    return F.regexp_replace(c, r"(?U)^(?:the|a|an)\s+", "")


def norm(c) -> Column:
    """Canonical form of a title or an author; null becomes the empty string."""
    c = F.replace(swap_last_first(plain_quotes(c)), F.lit("&"), F.lit(" and "))
    c = F.substring_index(_drop_edges(c), ":", 1)
    return join_initials(squeeze(F.translate(c, ".", " ")))


def norm_keep_subtitle(c) -> Column:
    """Older form: no name swap, no subtitle cut, initials stay apart."""
    return squeeze(F.translate(_drop_edges(plain_quotes(c)), ".", " "))


def title_short(c) -> Column:
    """Normalised text before the first colon, empty when there is none."""
    t = _text(c)
    return F.when(F.instr(t, ":") > 0, norm(F.substring_index(t, ":", 1))).otherwise("")


def title_fold(c: Column) -> Column:
    """American spelling of an already normalised title, word by word."""
    folded = c
    for british, american, shortest in SPELLING_SUFFIXES:
        stem = shortest - len(british)
        folded = F.regexp_replace(folded, rf"([^ ]{{{stem},}}){british}(?= |$)", f"$1{american}")
    return F.when(c.rlike(_ANY_SUFFIX), folded).otherwise(c)


def title_keys(c) -> Column:
    """Sorted set of every key a title may be matched on."""
    full, short = norm(c), title_short(c)
    keys = F.array(full, short, title_fold(full), title_fold(short))
    return F.array_sort(F.array_distinct(F.array_remove(keys, "")))


def author_parts(c) -> Column:
    """Sorted set: the whole normalised field and each co-author in it."""
    pieces = F.transform(F.split(_text(c), CO_AUTHOR_SPLIT), norm)
    return F.array_sort(F.array_distinct(F.array_remove(F.concat(F.array(norm(c)), pieces), "")))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, " "), "")


def list_surnames(c: Column) -> Column:
    """Last word of each co-author; empty unless there are two or more."""
    pieces = F.filter(F.transform(F.split(c, CO_AUTHOR_SPLIT), squeeze), lambda p: p != "")
    last = F.transform(pieces, lambda p: F.substring_index(p, " ", -1))
    return F.when(F.size(pieces) > 1, F.array_distinct(last)).otherwise(
        F.array().cast("array<string>"))


def authors_match(a: Column, b: Column) -> Column:
    """Same author(s) under name order, a missing co-author, or a shared surname
    between two author lists.  Both sides are already normalised."""
    wa, wb = words(a), words(b)
    subset = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    return (F.when((a == "") | (b == ""), a == b)
            .otherwise((a == b) | subset | (swap_last_first(a) == b) | (a == swap_last_first(b))
                       | F.arrays_overlap(list_surnames(a), list_surnames(b))))


def same_book(title_a, author_a, title_b, author_b) -> Column:
    return (F.arrays_overlap(title_keys(title_a), title_keys(title_b))
            & authors_match(norm(author_a), norm(author_b)))


def author_tokens(a: Column) -> Column:
    """Words of a normalised author without list punctuation; [''] when blank.
    Two authors that match always share one of these."""
    toks = F.array_distinct(F.array_remove(F.split(a, r"[\s,;/&]+"), ""))
    return F.when(F.size(toks) == 0, F.array(F.lit(""))).otherwise(toks)


def light_key(c) -> Column:
    """Quotes, case and spaces only: the key used for exact catalogue lookups."""
    return squeeze(F.lower(plain_quotes(c)))


def fuzzy_norm(c) -> Column:
    """Form used by the fuzzy export match: comma parts sorted, cut at a colon."""
    c = F.replace(F.lower(_text(c)), F.lit(" & "), F.lit(", "))
    parts = F.array_sort(F.transform(F.split(c, ","), lambda p: F.regexp_replace(
        p, r"(?U)^\s+|\s+$", "")))
    c = F.substring_index(F.array_join(parts, ", "), ":", 1)
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "))


def number(c) -> Column:
    """A plain decimal number, with or without exponent; anything else is null (a cast
    alone would also take type suffixes, as in ``5d``)."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def item_key(title, author) -> Column:
    return F.concat(F.trim(_text(title)), F.lit(" - "), F.trim(_text(author)))


def key_title(key) -> Column:
    """Part of a composite key before the last `` - ``; null when there is none."""
    return F.nullif(F.regexp_extract(_text(key), r"(?s)^(.*) - (.*)$", 1), F.lit(""))


def key_author(key) -> Column:
    return F.when(F.instr(_text(key), " - ") > 0,
                  F.regexp_extract(_text(key), r"(?s)^(.*) - (.*)$", 2))
