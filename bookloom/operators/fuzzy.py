"""Similarity joins: exports matched by author then title, and near misses.

Spark makes the candidate pairs with equi-joins on distinct names; the Python side
only scores Arrow batches of string pairs.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bookloom.functions import text, values
from bookloom.operators import identity
from bookloom.operators.common import best, settle

AUTHOR_SCORE, TITLE_SCORE, READ_SCORE = 80.0, 20.0, 80.0
NEAR_DISTANCE = 0.34


def _common_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine integer per row of the table."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        hit = open_ & where.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - bin(open_).count("1")


def token_set_score(a: str, b: str) -> float:
    """Best of comparing shared words with each side and both sides with each other;
    100 when one side's words contain the other's."""
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    shared, only_a, only_b = wa & wb, wa - wb, wb - wa
    if shared and (not only_a or not only_b):
        return 100.0
    base, ta, tb = (" ".join(sorted(w)) for w in (shared, only_a, only_b))
    gap = 1 if base else 0
    size = len(base)
    full_a, full_b = size + gap + len(ta), size + gap + len(tb)
    # Both sides begin with the shared words, so only the rests differ.
    distance = len(ta) + len(tb) - 2 * _common_length(ta, tb)
    score = 100.0 * (1 - distance / (full_a + full_b))
    if base:
        score = max(score, 100.0 * (1 - (gap + len(ta)) / (size + full_a)),
                    100.0 * (1 - (gap + len(tb)) / (size + full_b)))
    return score


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        return 0.0 if not x and not y else round(1.0 - difflib.SequenceMatcher(None, x, y).ratio(), 4)
    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def _plain(c: str) -> Column:
    """Distinct words in order: the text that the author score compares."""
    return F.array_join(F.array_sort(F.array_distinct(text.words(F.col(c)))), " ")


def _pairs(c: str) -> Column:
    """Two-character pieces of the plain text, each with how often it came before."""
    def numbered_pieces(p: Column) -> Column:
        return F.transform(p, lambda x, i: F.concat(x, F.size(F.filter(F.slice(p, 1, i), lambda y: y == x)).cast("string")))
    plain = _plain(c)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - 1, F.lit(1))),
                         lambda i: F.substring(plain, i, 2))
    return F.get(F.transform(F.array(pieces), numbered_pieces), 0)


def _contained(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that score 100: all words of one are words of the other.  The rarest word of
    the smaller side is in both, so only pairs that share such a word are looked at."""
    a, k = (df.select(name, F.array_distinct(text.words(F.col(name))).alias(ws)).filter(F.size(ws) > 0)
            for df, name, ws in ((asked, "asked", "aw"), (known, "known", "kw")))
    each_a, each_k = a.select("*", F.explode("aw").alias("w")), k.select("*", F.explode("kw").alias("w"))
    counts = settle(each_a.select("w").unionByName(each_k.select("w")).groupBy("w").agg(F.count("*").alias("c")), "word-counts")

    def rarest(each, name, ws):
        return best(each.join(counts, "w"), [name], [F.col("c"), F.col("w")], [ws, "w"])
    columns = ["asked", "known", "aw", "kw"]
    inside = rarest(each_a, "asked", "aw").join(each_k, "w").filter(F.size(F.array_except("aw", "kw")) == 0)
    around = rarest(each_k, "known", "kw").join(each_a, "w").filter(F.size(F.array_except("kw", "aw")) == 0)
    return inside.select(*columns).unionByName(around.select(*columns)).select("asked", "known").distinct()


def _by_words(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs sharing a word."""
    a = asked.select("asked", F.explode(F.array_distinct(text.words(F.col("asked")))).alias("w"))
    k = known.select("known", F.explode(F.array_distinct(text.words(F.col("known")))).alias("w"))
    return a.join(k, "w").select("asked", "known").distinct()


def _by_pieces(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that can reach the author score without sharing a word.

    Such texts, n and m characters long, differ by d <= (n + m) / 5 inserted or deleted
    characters; the (n + m - d) / 2 kept ones lie in d + 1 stretches at most, so at least
    (n + m - d) / 2 - d - 1 two-character pieces survive in both.  For every m in reach of
    n that is max(1, (n - 1) // 3), but for n, m = 2, 3, where it can be none.  So a pair
    meets on one of the rarest pieces of each side, all but that many of its pieces
    (prefix filter), and texts of two characters meet those of three by what is left of
    these without one character."""
    a = asked.select("asked", F.explode(_pairs("asked")).alias("p"))
    k = known.select("known", F.explode(_pairs("known")).alias("p"))
    counts = a.select("p").unionByName(k.select("p")).groupBy("p").agg(F.count("*").alias("c"))

    def rare(df, name):
        ranked = df.join(counts, "p").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("c", "p"))).alias("ps"))
        need = F.greatest(F.floor((F.length(_plain(name)) - 1) / 3), F.lit(1)).cast("int")
        head = F.greatest(F.size("ps") - need + 1, F.lit(1))
        return ranked.select(name, F.explode(F.slice("ps", 1, head)["p"]).alias("p"))
    close = F.length("asked").between(F.length("known") * 2 / 3 - 1, F.length("known") * 3 / 2 + 1)
    pieces = rare(a, "asked").join(rare(k, "known"), "p").filter(close).select("asked", "known")

    def short(df, name):
        t = _plain(name)
        less = F.array(*[F.concat(F.substring(t, 1, i - 1), F.substring(t, i + 1, 3 - i)) for i in (1, 2, 3)])
        forms = F.when(F.length(t) == 2, F.array(t)).when(F.length(t) == 3, F.array_distinct(less))
        return df.select(name, F.length(t).alias(f"n_{name}"), F.explode(forms).alias("p"))
    tiny = short(asked, "asked").join(short(known, "known"), "p").filter("n_asked <> n_known")
    return pieces.unionByName(tiny.select("asked", "known")).distinct()


def author_matches(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(asked, known, score): for each asked author its best-scoring known authors, at
    or above the author score.  Authors that reach 100 are found by their words alone; only
    the others are scored, against those that share a word and then in the wider search."""
    full = settle(_contained(asked, known).withColumn("score", F.lit(100.0)), "author-full")
    rest = settle(asked.join(full.select("asked").distinct(), "asked", "left_anti"), "author-rest")
    scored = settle(_by_words(rest, known).withColumn("score", token_set_ratio("asked", "known"))
                    .filter(F.col("score") >= AUTHOR_SCORE), "author-words")
    more = _by_pieces(rest, known).join(scored.select("asked", "known"), ["asked", "known"], "left_anti")
    more = more.withColumn("score", token_set_ratio("asked", "known")).filter(F.col("score") >= AUTHOR_SCORE)
    both = full.unionByName(scored).unionByName(more)
    top = both.groupBy("asked").agg(F.max("score").alias("top"))
    return both.join(top, "asked").filter(F.col("score") == F.col("top")).drop("top")


def export_match(export: DataFrame, library: DataFrame, order: str) -> DataFrame:
    """export(row_id, title, author) against library(lib_id, title, author): the best
    title among the books of the best-scoring authors; (row_id, lib_id, score).
    Of equal titles the first library row by `order` wins."""
    asked = settle(export.select("row_id", text.fuzzy_norm("title").alias("at"),
                                 text.fuzzy_norm("author").alias("asked")), "export-names")
    known = settle(library.select("lib_id", F.col(order).alias("_order"), text.fuzzy_norm("title").alias("kt"),
                                  text.fuzzy_norm("author").alias("known")), "library-names")
    names = author_matches(asked.select("asked").filter("asked <> ''").distinct(),
                           known.select("known").filter("known <> ''").distinct())
    # Copies score alike: compare distinct titles per author pair, first library row each.
    titles = best(known, ["known", "kt"], [F.col("_order"), F.col("lib_id")], ["lib_id", "_order"])
    wanted = asked.select("asked", "at").distinct().join(names.select("asked", "known"), "asked")
    pairs = wanted.join(titles, "known").withColumn("score", token_set_ratio("at", "kt"))
    winner = best(pairs.filter(F.col("score") >= TITLE_SCORE).withColumn("neg", -F.col("score")), ["asked", "at"],
                  [F.col("neg"), F.col("_order"), F.col("lib_id")], ["lib_id", "score"])
    return (asked.join(winner, ["asked", "at"], "left")
            .select("row_id", "lib_id", F.coalesce("score", F.lit(0.0)).alias("score")))


def log_from_export(export: DataFrame, library: DataFrame, matches: DataFrame) -> DataFrame:
    """Reading-log rows of the matched exports marked as read.  Sort by `read_order`
    (newest first, undated last, then by row) when writing them."""
    good = matches.filter((F.col("score") >= READ_SCORE) & F.col("lib_id").isNotNull())
    read = export.filter(F.col("read_status") == "read").select(
        "row_id", F.col("date_text").alias("Last Date Read"), F.col("stars").alias("My Rating"))
    facts = library.select("lib_id", "title", F.col("author").alias("authors"), "genre", "series_type",
                           F.col("tags").alias("my_tags"), F.col("more_tags").alias("goodreads_shelves"))
    return good.join(read, "row_id").join(facts, "lib_id").drop("lib_id", "score")


def read_order() -> list[Column]:
    return [values.parse_date(F.col("Last Date Read")).desc_nulls_last(), F.col("row_id")]


def near_misses(log: DataFrame, items: DataFrame) -> DataFrame:
    """Unresolved log rows as near miss or orphan: (log_id, kind, item_key, distance).

    Candidates have the same title (author drift) or the same author (title drift).
    Distinct unresolved pairs meet distinct catalogue pairs, one row per pair of names."""
    resolved = settle(identity.resolve(log, items), "audit-log")
    lost = resolved.filter(F.col("item_key").isNull() & (F.coalesce("title", F.lit("")) != ""))
    pairs = settle(lost.select("title_norm", "author_norm").distinct(), "lost-pairs")
    named = identity.with_norms(items)
    title = F.coalesce("title", F.lit(""))
    forms = F.array_distinct(F.array_compact(F.array(
        F.col("title_norm"), F.when(F.instr(title, ":") > 0, text.title_short("title")))))
    index = best(named.select("item_key", F.col("author_norm").alias("ka"), F.explode(forms).alias("kt")),
                 ["kt", "ka"], [F.col("item_key")], ["item_key"])
    same_title = pairs.join(index, F.col("title_norm") == F.col("kt")).select(
        "title_norm", "author_norm", "item_key", F.lit(1).alias("drift"),
        F.col("author_norm").alias("x"), F.col("ka").alias("y"))
    same_author = pairs.join(index, F.col("author_norm") == F.col("ka")).select(
        "title_norm", "author_norm", "item_key", F.lit(2).alias("drift"),
        F.col("title_norm").alias("x"), F.col("kt").alias("y"))
    # The ratio is at most 2 min / (sum) of the lengths, so far-off lengths cannot be near.
    lengths = 2 * F.least(F.length("x"), F.length("y")) / F.greatest(F.length("x") + F.length("y"), F.lit(1))
    cand = same_title.unionByName(same_author).filter((lengths >= 1 - NEAR_DISTANCE - 1e-4) | ((F.col("x") == "") & (F.col("y") == "")))
    scored = cand.withColumn("distance", sequence_distance("x", "y")).filter(F.col("distance") <= NEAR_DISTANCE)
    near = best(scored, ["title_norm", "author_norm"], [F.col("distance"), F.col("drift"), F.col("item_key")],
                ["item_key", "distance", "drift"])
    out = lost.select("log_id", "title_norm", "author_norm").join(near, ["title_norm", "author_norm"], "left")
    return out.select("log_id", F.when(F.col("item_key").isNotNull(), "near").otherwise("orphan").alias("kind"),
                      "item_key", "distance")
