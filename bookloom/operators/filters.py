"""Gates, exclusions and soft warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions import series, text
from bookloom.operators import identity
from bookloom.operators.common import numbered, positive_tags, settle

QUALITY_FLOOR = 3.8
ENTRY_ROLES = ["standalone", "first", "loose-entry"]
# How callers name series statuses.
STATUS_ALIASES = {"standalone": "Standalone", "short": "Short Series", "long": "Long Series"}
AUTHOR_REVIEW_CEILING = 50_000
#: Tasks among which the readers of one tag are dealt.
TAG_SHARES = 8


def tag_profiles(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the same matchable tags share a profile.

    Returns (item_profiles, profile_tags).  Work that depends on tags only is done once
    per reader and profile instead of once per reader and item."""
    lists = positive_tags(tags).groupBy("item_key").agg(
        F.array_sort(F.collect_list(F.struct("kind", "tag"))).alias("tags"))
    name = F.md5(F.array_join(F.transform("tags", lambda t: F.concat_ws("=", t["kind"], t["tag"])), "|"))
    lists = lists.withColumn("profile", name)
    held = lists.select("profile", "tags").distinct().select("profile", F.explode("tags").alias("t"))
    return lists.select("item_key", "profile"), held.select("profile", "t.*")


def relevant_profiles(live_tags: DataFrame, profile_tags: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(reader_id, profile) sharing at least one tag with the reader's active vectors, with
    the columns of facts(profile, ...) for profiles that have them, if given.

    A pair is made at the first tag that both have, so pairs need no distinct: they are
    streamed to what reads them, neither shuffled nor written here.  The readers of a tag
    are dealt to several tasks, which each get its profiles."""
    named = F.col("kind").isNotNull() & F.col("tag").isNotNull()
    ids = settle(profile_tags.filter(named).select("kind", "tag").distinct()
                 .withColumn("tid", F.monotonically_increasing_id()), "tag-ids")

    def spread(df, name, tags):
        tids = df.select(name, "kind", "tag").join(ids, ["kind", "tag"])
        return (tids.groupBy(name).agg(F.collect_set("tid").alias(tags))
                .select(name, tags, F.explode(tags).alias("tid")))
    asking = spread(live_tags, "reader_id", "mine").withColumn("share", F.pmod(F.xxhash64("reader_id"), F.lit(TAG_SHARES)))
    asked = spread(profile_tags, "profile", "theirs")
    asked = asked if facts is None else asked.join(facts, "profile")
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TAG_SHARES - 1).cast("long"))))
    first = F.array_min(F.array_intersect("mine", "theirs")) == F.col("tid")
    return asking.join(asked, ["tid", "share"]).filter(first).drop("tid", "share", "mine", "theirs")


def relevance(live_tags: DataFrame, profile_tags: DataFrame, per: DataFrame) -> DataFrame:
    """(reader_id, n, first_key, last_key, pk_sum) over the relevant profiles of
    per(profile, n, a, z, s): counts, smallest and greatest keys, and sums.

    Readers with the same tags are answered once, as the smallest of them.  Keys are
    compared by their ranks, as sums of numbers are combined before the shuffle while
    smallest texts would be sorted row by row."""
    tastes = settle(live_tags.groupBy("reader_id").agg(F.array_sort(F.collect_set(F.struct("kind", "tag"))).alias("tags")), "reader-tags")
    shapes = settle(tastes.groupBy("tags").agg(F.min("reader_id").alias("lead")), "shared-tags")
    asked = shapes.select(F.col("lead").alias("reader_id"), F.explode("tags").alias("t")).select("reader_id", "t.*")
    first, last = (settle(numbered(per.select(c).distinct(), [c], f"n_{c}"), "key-ranks") for c in ("a", "z"))
    ranked = per.join(first, "a").join(last, "z").select("profile", "n", "n_a", "n_z", "s")
    found = (relevant_profiles(asked, profile_tags, ranked).groupBy("reader_id").agg(
        F.sum("n").alias("n"), F.min("n_a").alias("n_a"), F.max("n_z").alias("n_z"), F.sum("s").alias("pk_sum"))
        .join(first, "n_a").join(last, "n_z").withColumnRenamed("reader_id", "lead"))
    owners = tastes.join(shapes, "tags").select("reader_id", F.col("lead").alias("_lead"))
    return owners.join(found, F.col("_lead").eqNullSafe(F.col("lead"))).select(
        "reader_id", "n", F.col("a").alias("first_key"), F.col("z").alias("last_key"), "pk_sum")


def quality_items(items: DataFrame, genre: str | None = None, indie: bool = False,
                  statuses: list[str] = (), floor: float = QUALITY_FLOOR) -> DataFrame:
    """Rating floor plus the hard filters of a request."""
    out = items.filter(F.col("title").isNotNull() & (F.col("rating") >= floor))
    if genre:
        out = out.filter(in_genres([genre], secondary=True))
    if indie:
        out = out.filter(F.col("indie"))
    allowed = [STATUS_ALIASES[s] for s in statuses if s in STATUS_ALIASES]
    return out.filter(F.col("series_status").isin(allowed)) if allowed else out


def in_genres(genres: list[str], secondary: bool) -> Column:
    wanted = [g.lower() for g in genres]
    hit = F.lower(F.coalesce("primary_genre", F.lit(""))).isin(wanted)
    return hit | F.lower(F.coalesce("secondary_genre", F.lit(""))).isin(wanted) if secondary else hit


def open_entry() -> Column:
    """May a reader who has not read the author start here?"""
    role, flag = F.col("series_role"), F.col("author_entry_point")
    known = role.isNotNull() | flag.isNotNull()
    by_catalogue = F.coalesce(flag, F.lit(True)) & (role.isNull() | role.isin(ENTRY_ROLES))
    status = F.coalesce("series_status", F.lit(""))
    by_position = status.isin("", "Standalone") | series.is_book_one("series_position")
    return F.when(known, by_catalogue).otherwise(by_position)


def read_authors(log: DataFrame) -> DataFrame:
    return (identity.with_norms(log.filter(F.coalesce("title", F.lit("")) != ""))
            .select("reader_id", "author_norm").distinct())


def known_author_items(log: DataFrame, items: DataFrame) -> DataFrame:
    """(reader_id, item_key) of items whose author the reader has read."""
    named = identity.with_norms(items).select("item_key", "author_norm")
    return read_authors(log).join(named, "author_norm").select("reader_id", "item_key")


def excluded_items(log: DataFrame, picks: DataFrame, events: DataFrame, items: DataFrame,
                   index: DataFrame | None = None) -> DataFrame:
    """(reader_id, item_key) never to be offered: read (exact pair), already listed
    (tolerant), or rejected."""
    named = identity.with_norms(items).select("item_key", "title_norm", "author_norm")
    read = identity.read_pairs(log).join(named, ["title_norm", "author_norm"]).select("reader_id", "item_key")
    rejected = events.filter((F.col("type") == "rejected") & F.col("item_key").isNotNull()).select(
        "reader_id", "item_key")
    return read.unionByName(identity.listed_items(picks, items, index)).unionByName(rejected).distinct()


def exclusion_pairs(log: DataFrame, picks: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Distinct (reader_id, title_norm, author_norm) read, listed or shown, older rules."""
    old = text.norm_keep_subtitle

    def pairs(df):
        return df.filter(F.coalesce("title", F.lit("")) != "").select(
            "reader_id", old("title").alias("title_norm"), old("author").alias("author_norm"))
    out = pairs(log).unionByName(pairs(picks))
    if shown is not None:
        out = out.unionByName(pairs(shown))
    return out.distinct()


def memberships(probes: DataFrame, log: DataFrame, picks: DataFrame, shown: DataFrame) -> DataFrame:
    """Each probe with is_read, is_listed and is_shown."""
    old = text.norm_keep_subtitle
    out = probes.withColumns({"title_norm": old("title"), "author_norm": old("author")})
    keys = ["reader_id", "title_norm", "author_norm"]
    for name, source in (("is_read", log), ("is_listed", picks), ("is_shown", shown)):
        held = source.filter(F.coalesce("title", F.lit("")) != "").select(
            "reader_id", old("title").alias("title_norm"), old("author").alias("author_norm")).distinct()
        out = out.join(held.withColumn(name, F.lit(True)), keys, "left")
    return out.fillna(False, ["is_read", "is_listed", "is_shown"])


def within_limits(min_rating: float = 0.0, min_reviews: int = 0, page_cap: int | None = None,
                  page_floor: int | None = None, required: list[str] = ()) -> Column:
    """Floors and caps; a book with no page count passes both page limits."""
    pages = F.coalesce("pages", F.lit(0))
    ok = (F.coalesce("rating", F.lit(0.0)) >= min_rating) & (F.coalesce("reviews", F.lit(0)) >= min_reviews)
    if page_cap:
        ok = ok & ((pages == 0) | (pages <= page_cap))
    if page_floor:
        ok = ok & ((pages == 0) | (pages >= page_floor))
    for tag in required:
        ok = ok & F.coalesce(tag, F.lit(False))
    return ok


def deep_cut(genres: list[str] = ()) -> Column:
    """Little-known but well rated, independent, lesser classic, or side-genre match."""
    rating, reviews = F.coalesce("rating", F.lit(0.0)), F.coalesce("reviews", F.lit(0))
    side, main = F.trim(F.coalesce("secondary_genre", F.lit(""))), F.trim(F.coalesce("primary_genre", F.lit("")))
    hidden = (reviews > 0) & (reviews < 1500) & (rating >= 4.2)
    classic = F.coalesce("classic", F.lit(False)) & (reviews > 0) & (reviews < 50000)
    aside = (side != "") & (side != main) & F.lower(side).isin([g.lower() for g in genres])
    return hidden | F.coalesce("indie", F.lit(False)) | classic | aside


def indie_audit_candidates(items: DataFrame, floor: int = 0, ceiling: int = 15_000) -> DataFrame:
    """Unflagged books in the review band, leaving out authors with a very popular book."""
    author = F.trim(F.coalesce("author", F.lit("")))
    popular = (items.groupBy(author.alias("_author")).agg(F.max("reviews").alias("top"))
               .filter((F.col("_author") != "") & (F.col("top") > AUTHOR_REVIEW_CEILING)))
    band = F.col("reviews").isNull() | (F.col("reviews") <= ceiling)
    if floor > 0:
        band = F.col("reviews").isNotNull() & (F.col("reviews") > floor) & (F.col("reviews") <= ceiling)
    return (items.filter(~F.coalesce("indie", F.lit(False)) & band).withColumn("_author", author)
            .join(popular, "_author", "left_anti").drop("_author"))


def warnings(candidates: DataFrame, notes: DataFrame, items: DataFrame) -> DataFrame:
    """(reader_id, item_key, n, warning): page caps exceeded (``pages:700>500``) and avoided
    tags carried (``avoids:indie``), each with the note's own words after a blank.  Notes
    never remove a candidate."""
    facts = candidates.join(items.select("item_key", "pages", "indie", "classic"), "item_key")
    carried = ((F.col("tag") == "indie") & F.col("indie")) | ((F.col("tag") == "classic") & F.col("classic"))
    message = (F.when((F.col("kind") == "page_cap") & (F.col("pages") > F.col("page_limit")),
                      F.concat(F.lit("pages:"), F.col("pages").cast("string"), F.lit(">"),
                               F.col("page_limit").cast("string"), F.lit(" "), "raw"))
               .when((F.col("kind") == "avoid") & carried, F.concat(F.lit("avoids:"), "tag", F.lit(" "), "raw")))
    return (facts.join(notes, "reader_id").withColumn("warning", message)
            .filter(F.col("warning").isNotNull()).select("reader_id", "item_key", "n", "warning"))


def negative_flags(candidates: DataFrame, tags: DataFrame, negatives: DataFrame) -> DataFrame:
    """(reader_id, item_key, flags): sorted cold tags a candidate carries."""
    return (candidates.select("reader_id", "item_key").join(positive_tags(tags), "item_key")
            .join(negatives.select("reader_id", "kind", "tag").distinct(), ["reader_id", "kind", "tag"])
            .groupBy("reader_id", "item_key").agg(F.array_sort(F.collect_set("tag")).alias("flags")))


def closed_vocabulary(lists: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(item_key, child, pos, tag): off-list tags dropped, the first of each kept."""
    known = lists.join(vocabulary.select("tag").distinct(), "tag", "left_semi")
    return known.groupBy("item_key", "child", "tag").agg(F.min("pos").alias("pos"))
