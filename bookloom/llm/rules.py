"""Quality rules as one short-circuit cascade of column expressions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import DOCUMENTS, WHITESPACE, let
from bookloom.operators.common import settle

Features = Callable[[str], Column]
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000


def word_array(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.array_remove(F.split(F.translate(text, WHITESPACE[1:], " " * 5), " "), "")


def _shift(way: str, value: Column, bits: Column) -> Column:
    return F.call_function(way, value, bits)


def _low(value: Column, bits: Column) -> Column:
    return value.bitwiseAND(_shift("shiftleft", F.lit(1).cast("long"), bits) - 1)


def repeated_words(text: Column) -> Column:
    """Words lying in a 3-word window that the text holds twice or more.

    Windows are compared by 64-bit hashes.  Each hash gives its low bits to its position
    and the lot is sorted as plain longs, so equal windows become neighbours in
    O(n log n); neighbours with equal high bits are then compared in full.
    """
    def grams(h: Column) -> Column:
        n = F.greatest(F.size(h) - 2, F.lit(0))
        return F.transform(F.slice(h, 1, n), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def covered(g: Column) -> Column:
        bits = F.ceil(F.log2(F.size(g) + 1)).cast("int")

        def marked(s: Column, b: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return ((_shift("shiftright", x, b) == _shift("shiftright", y, b))
                        & (F.get(g, _low(x, b).cast("int")) == F.get(g, _low(y, b).cast("int"))))

            place = F.transform(s, lambda x, i: F.when(
                F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)),
                _low(x, b)).otherwise(F.lit(-1).cast("long")))
            return F.sort_array(F.filter(place, lambda p: p >= 0))

        def total(places: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(places, start, lambda acc, p: F.struct(
                (p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n")), lambda acc: acc["n"])

        def packed(b: Column) -> Column:
            return F.sort_array(F.transform(g, lambda x, i: _shift("shiftleft", _shift("shiftright", x, b), b)
                                            .bitwiseOR(i.cast("long"))))

        found = let(bits, lambda b: let(packed(b), lambda s: total(marked(s, b))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(found)

    return let(F.transform(word_array(text), lambda w: F.xxhash64(w)), lambda h: let(grams(h), covered))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(WHITESPACE))) > 0)


#: Feature name -> expression over the text.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(word_array(t)).cast("long"),
    "word_chars": lambda t: F.char_length(F.translate(t, WHITESPACE, "")).cast("long"),
    "n_symbols": lambda t: (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
    "n_lines": lambda t: F.size(_lines(t)).cast("long"),
    "n_dup_lines": lambda t: let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": repeated_words,
}


@dataclass(frozen=True)
class Rule:
    """rejects(feature) is true for a text to drop; feature(name) gives a column."""
    name: str
    rejects: Callable[[Features], Column]


RULES = [
    Rule("few_words", lambda f: f("n_words") < 50),
    Rule("word_length", lambda f: (f("word_chars") > 15 * f("n_words")) | (f("word_chars") < 2 * f("n_words"))),
    Rule("symbols", lambda f: 5 * f("n_symbols") > f("n_words")),
    Rule("repeated_lines", lambda f: 100 * f("n_dup_lines") > 50 * f("n_lines")),
    Rule("repeated_words", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
]


def from_text(text: Column) -> Features:
    """Features computed where a rule asks for them; a null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return lambda name: FEATURES[name](whole)


def ordered(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """The rules by falling rejection rate per second, both measured on about
    `sample_rows` random rows.  Any order keeps the same rows: only the work differs.
    An empty sample keeps the given order."""
    rows = docs.count()
    if not rows:
        return list(rules)
    share = min(1.0, sample_rows / rows)
    sample = settle(docs.select("text").sample(share, seed), "rule-sample")
    feature, gains = from_text(F.col("text")), []
    for rule in rules:
        began = time.perf_counter()
        n, hits = sample.agg(F.count("*"), F.count_if(rule.rejects(feature))).first()
        gains.append((hits / max(n, 1) / max(time.perf_counter() - began, 1e-6), rule))
    return [rule for _, rule in sorted(gains, key=lambda x: -x[0])]


def passes(rules: list[Rule], feature: Features) -> Column:
    """True if no rule rejects.  CASE stops at the first that does, so what a later
    rule needs is not computed for that row."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(feature), F.lit(False)).otherwise(verdict)
    return verdict


def keep_good(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The columns of documents for the rows that pass every rule.  Null texts count as
    empty and fail; very long ones are judged whole; repeated rows are judged alike; an empty
    table stays empty.  The number of words, which most rules ask for, is counted once."""
    order, feature = ordered(docs, rules), from_text(F.col("text"))
    verdict = let(feature("n_words"), lambda n: passes(order, lambda name: n if name == "n_words" else feature(name)))
    return docs.select(*DOCUMENTS).filter(verdict)


def measure(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per document: the base counts, whether the two base rules fail it, and the
    cascade's verdict.  Null texts count as empty (no words: failed); very long ones are
    measured whole, by one task each; repeated rows are judged alike."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    counts = docs.select("doc_id", *[make(whole).alias(name) for name, make in FEATURES.items()])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = passes(ordered(docs, rules), F.col)
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & verdict).alias("kept"))
