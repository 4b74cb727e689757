"""Catalogue audits: vectors of items, weak links, entry points, list reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.functions import series
from bookloom.operators import identity
from bookloom.operators.common import positive_tags, settle

# Fixed values of the audits.
LATER_ROLES = ["mid", "late", "loose-mid"]
OPENING_ROLES = ["first", "standalone"]
ENTRY_ROLES = ["standalone", "first", "loose-entry", "entry-point"]
MIN_SIGNALS, MIN_OVERLAP = 1, 2
AUTHOR_BOOKS = 3


def item_vectors(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(item_key, vector, overlap) for catalogue-wide vectors(vector, kind, tag) an item
    exemplifies: one shared signal at least, two shared tags in all."""
    hits = (positive_tags(tags).join(vocabulary.select("vector", "kind", "tag").distinct(), ["kind", "tag"])
            .groupBy("item_key", "vector").agg(F.count_if(F.col("kind") == "signal").alias("signals"),
                                               F.count("*").alias("overlap")))
    return hits.filter((F.col("signals") >= MIN_SIGNALS) & (F.col("overlap") >= MIN_OVERLAP)).drop("signals")


def vocabulary_drift(vocabulary: DataFrame, allowed: DataFrame) -> DataFrame:
    """Vector members that the closed lists do not hold."""
    return vocabulary.select("vector", "kind", "tag").join(
        allowed.select("kind", "tag").distinct(), ["kind", "tag"], "left_anti")


def unshared_links(links: DataFrame, vectors: DataFrame) -> DataFrame:
    """(src_key, dst_key) whose ends share no vector."""
    # An item's vectors are one cell, so a link stays one row on its way to both ends; what
    # is left is far less than the links, so copies go last.
    held = vectors.groupBy("item_key").agg(F.collect_set("vector").alias("held"))

    def end(name, key):
        return held.select(F.col("item_key").alias(key), F.col("held").alias(name))
    return (links.select("src_key", "dst_key")
            .join(end("a", "src_key"), "src_key", "left").join(end("b", "dst_key"), "dst_key", "left")
            .filter(~F.coalesce(F.arrays_overlap("a", "b"), F.lit(False))).select("src_key", "dst_key").distinct())


def weak_links(links: DataFrame, items: DataFrame, tags: DataFrame, vectors: DataFrame) -> DataFrame:
    """Links between known items with no vector and no tag in common: drop when the
    genres differ, else review."""
    known = items.select("item_key", "title", "author", "primary_genre", "rating")
    held = (positive_tags(tags).filter("tag is not null").groupBy("item_key")
            .agg(F.collect_set(F.struct("kind", "tag")).alias("tags")))
    tagged = known.join(held, "item_key", "left")

    def end(prefix, key):
        return tagged.select(F.col("item_key").alias(key), *[F.col(c).alias(f"{prefix}_{c}")
                                                             for c in tagged.columns if c != "item_key"])
    pairs = (unshared_links(links, vectors).join(end("a", "src_key"), "src_key").join(end("b", "dst_key"), "dst_key")
             .filter(~F.coalesce(F.arrays_overlap("a_tags", "b_tags"), F.lit(False))).drop("a_tags", "b_tags"))
    same = (F.coalesce("a_primary_genre", F.lit("")) != "") & F.col("a_primary_genre").eqNullSafe(F.col("b_primary_genre"))
    total = F.coalesce("a_rating", F.lit(0.0)) + F.coalesce("b_rating", F.lit(0.0))
    return pairs.withColumns(
        {"action": F.when(same, "review").otherwise("drop"), "rating_sum": total})


def misaligned_entries(items: DataFrame) -> DataFrame:
    """(item_key, reason) of entry points whose role or position says otherwise.  Reasons:
    ``role:<role>`` (a later one), ``role:<role>/book:<n>`` (an opening one past book one),
    ``prequel``, ``book:<n>`` (below one, or past one where no role is set)."""
    role, prequel = F.col("series_role"), F.lower(F.coalesce("series_position", F.lit(""))).contains("prequel")

    def reasons(n):
        shown = series.plain_number(n)
        by_role = (F.when(role.isin(LATER_ROLES), F.concat(F.lit("role:"), role))
                   .when(role.isin(OPENING_ROLES) & (n > 1), F.concat(F.lit("role:"), role, F.lit("/book:"), shown)))
        by_position = (F.when(prequel, "prequel")
                       .when(((n > 0) & (n < 1)) | (role.isNull() & (n > 1)), F.concat(F.lit("book:"), shown)))
        return F.concat_ws("; ", by_role, by_position)
    number = F.array(series.book_number("series_position"))
    found = F.filter(F.transform(number, reasons), lambda r: r != "")
    return items.filter("author_entry_point").select("item_key", F.explode(found).alias("reason"))


def year_regressions(items: DataFrame) -> DataFrame:
    """Entry points published after an earlier standalone of the same author."""
    alone = identity.with_norms(items).filter(
        F.col("series_status").isNull() | (F.col("series_status") == "Standalone"))
    earliest = F.min(F.when(F.col("pub_year").isNotNull(), F.struct("pub_year", "item_key", "title")))
    facts = alone.groupBy("author_norm").agg(F.count("*").alias("n"), earliest.alias("e")).filter(F.col("n") >= 2)
    rows = alone.filter("author_entry_point").join(facts, "author_norm")
    return (rows.filter(F.col("pub_year") > F.col("e.pub_year"))
            .select("item_key", "author", F.col("pub_year").alias("ep_year"), F.col("e.pub_year").alias("earliest_year"),
                    F.col("e.title").alias("earliest_title"), (F.col("pub_year") - F.col("e.pub_year")).alias("gap_years")))


def zero_entry_authors(items: DataFrame) -> DataFrame:
    """Authors with three or more books and no way in."""
    flagged = F.coalesce("author_entry_point", F.lit(False)) | F.coalesce(F.col("series_role").isin(ENTRY_ROLES), F.lit(False))
    return (identity.with_norms(items).groupBy("author_norm")
            .agg(F.count("*").alias("n_books"), F.bool_or(flagged).alias("has_entry"),
                 F.array_join(F.array_sort(F.collect_set("series_role")), ", ").alias("roles"),
                 F.min(F.struct("item_key", "author"))["author"].alias("author"))
            .filter((F.col("n_books") >= AUTHOR_BOOKS) & ~F.col("has_entry")).drop("has_entry"))


def reconcile_picks(picks: DataFrame, items: DataFrame) -> DataFrame:
    """Every list row as key_valid, key_unknown, suggested or unmatched, with its key."""
    pairs = settle(identity.list_pairs(picks), "list-pairs")
    known = items.select(F.col("item_key").alias("direct_key"), F.lit(True).alias("_known"))
    found = identity.resolve_pairs(pairs.filter("direct_key is null"), items)
    rows = pairs.join(known, "direct_key", "left").join(found, ["title_norm", "author_norm"], "left")
    kind = (F.when(F.col("_known"), "key_valid").when(F.col("direct_key").isNotNull(), "key_unknown")
            .when(F.col("item_key").isNotNull(), "suggested").otherwise("unmatched"))
    return rows.select("reader_id", "title_norm", "author_norm", kind.alias("kind"), F.when(
        F.col("direct_key").isNotNull(), F.col("direct_key")).otherwise(F.col("item_key")).alias("item_key"))
