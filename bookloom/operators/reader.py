"""Per-reader facts: vectors, coverage, floors, anchors, runs, locks.

All of it is keyed by reader and built from partial aggregates, so one reader with
a third of the rows is combined on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import text, values
from bookloom.operators.common import half_even, positive_tags, settle, top_rows

# Thresholds of the reader signals.
LIKED = 4.0
ANCHOR_CAP = 1.5
ANCHOR_TOTAL = 3.0
LONG_SERIES_PICKS = 3
DOORSTOP_PAGES = 600
PAGE_TOLERANCE = 1.10
RUN_LENGTH = 3
LINK_WEIGHT = 0.6
LINK_CAP = 3
BUCKETS = [values.RECENT, values.MIDDLE, values.OLD, values.UNDATED]


def is_active() -> Column:
    return F.coalesce("status", F.lit("active")) != "demoted"


def active_members(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(reader_id, vector, ord, kind, tag) of vectors that are not demoted."""
    live = vectors.filter(is_active()).select("reader_id", "vector", "ord")
    return members.select("reader_id", "vector", "kind", "tag").distinct().join(
        live, ["reader_id", "vector"])


def active_tags(vectors: DataFrame, members: DataFrame) -> DataFrame:
    return active_members(vectors, members).select("reader_id", "kind", "tag").distinct()


def vector_overlap(pairs: DataFrame, tags: DataFrame, members: DataFrame) -> DataFrame:
    """(reader_id, item_key, vector, ord, overlap) for vectors sharing a tag with the item."""
    return (pairs.select("reader_id", "item_key").join(positive_tags(tags), "item_key")
            .join(members, ["reader_id", "kind", "tag"])
            .groupBy("reader_id", "item_key", "vector", "ord").agg(F.count("*").alias("overlap")))


def matched_vectors(overlap: DataFrame) -> DataFrame:
    """(reader_id, item_key, vectors): names in vector order."""
    names = F.array_sort(F.collect_list(F.struct("ord", "vector")))["vector"]
    return overlap.groupBy("reader_id", "item_key").agg(names.alias("vectors"))


def vector_coverage(listed: DataFrame, tags: DataFrame, vectors: DataFrame,
                    members: DataFrame) -> DataFrame:
    """(reader_id, vector, ord, weight, coverage): list items per active vector, zeros kept."""
    hits = (vector_overlap(listed, tags, active_members(vectors, members))
            .groupBy("reader_id", "vector").agg(F.count("*").alias("coverage")))
    live = vectors.filter(is_active()).select("reader_id", "vector", "ord", "weight")
    return live.join(hits, ["reader_id", "vector"], "left").fillna(0, ["coverage"])


def underused_vectors(coverage: DataFrame, state: DataFrame) -> DataFrame:
    """Vectors covered less than their weight's share of the list target."""
    weight = F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0))
    shares = coverage.withColumn("w", weight).join(state.select("reader_id", "n_target"), "reader_id")
    total = F.sum("w").over(Window.partitionBy("reader_id"))
    return (shares.withColumn("share", F.col("w") / total * F.col("n_target"))
            .filter(F.col("coverage") < F.col("share")).drop("w", "n_target", "weight"))


def list_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("reader_id").agg(F.count("*").alias("list_size"))


def floor_counts(listed: DataFrame, items: DataFrame) -> DataFrame:
    """(reader_id, kind, name, have): list items per tag and per lower-cased genre."""
    books = listed.join(items.select("item_key", "indie", "classic", "primary_genre"), "item_key")
    genre = F.nullif(F.lower(F.trim(F.coalesce("primary_genre", F.lit("")))), F.lit(""))

    def fact(on, kind, name):
        return F.when(on, F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    facts = F.array_compact(F.array(fact(F.col("indie"), "tag", F.lit("indie")),
                                    fact(F.col("classic"), "tag", F.lit("classic")),
                                    fact(genre.isNotNull(), "genre", genre)))
    return (books.select("reader_id", F.explode(facts).alias("f"))
            .groupBy("reader_id", F.col("f.kind").alias("kind"), F.col("f.name").alias("name"))
            .agg(F.count("*").alias("have")))


def floors_at_risk(floors: DataFrame, listed: DataFrame, items: DataFrame, pairs: DataFrame,
                   state: DataFrame) -> DataFrame:
    """(reader_id, kind, name, remaining, books_left) of floors not met yet."""
    have = floor_counts(listed, items).withColumnRenamed("name", "low")
    sizes = state.select("reader_id", "n_target").join(list_sizes(pairs), "reader_id", "left")
    left = F.greatest(F.col("n_target") - F.coalesce("list_size", F.lit(0)), F.lit(0))
    return (floors.withColumn("low", F.lower("name")).join(have, ["reader_id", "kind", "low"], "left")
            .withColumn("remaining", F.col("target") - F.coalesce("have", F.lit(0)))
            .filter(F.col("remaining") > 0).join(sizes, "reader_id")
            .select("reader_id", "kind", "name", "remaining", left.alias("books_left")))


def commitment_load(listed: DataFrame, items: DataFrame) -> DataFrame:
    """(reader_id, long_series, doorstops, list_items)."""
    books = listed.join(items.select("item_key", "series", "pages"), "item_key")
    name = F.nullif(F.trim("series"), F.lit(""))
    per_series = (books.withColumn("s", F.when(F.lower(name) != "standalone", name))
                  .groupBy("reader_id", "s").agg(
                      F.count("*").alias("n"),
                      F.count_if(F.coalesce("pages", F.lit(0)) >= DOORSTOP_PAGES).alias("d")))
    return per_series.groupBy("reader_id").agg(
        F.count_if(F.col("s").isNotNull() & (F.col("n") >= LONG_SERIES_PICKS)).alias("long_series"),
        F.sum("d").alias("doorstops"), F.sum("n").alias("list_items"))


def commitment_warnings(load: DataFrame, state: DataFrame) -> DataFrame:
    """Readers at, or one short of, their long-series cap."""
    used = F.coalesce("long_series", F.lit(0))
    status = (F.when(used >= F.col("long_series_cap"), "at_cap")
              .when(used >= F.col("long_series_cap") - 1, "near_cap"))
    return (state.filter(F.col("long_series_cap").isNotNull())
            .select("reader_id", "long_series_cap").join(load, "reader_id", "left")
            .select("reader_id", used.alias("long_series"), "long_series_cap", status.alias("status"))
            .filter(F.col("status").isNotNull()))


def page_warnings(listed: DataFrame, items: DataFrame, state: DataFrame) -> DataFrame:
    """Readers whose mean pages exceed their target by more than the tolerance."""
    pages = F.nullif("pages", F.lit(0))
    means = (listed.join(items.select("item_key", "pages"), "item_key").groupBy("reader_id")
             .agg(F.avg(pages).alias("mean"), F.count(pages).alias("n_with_pages")))
    target = F.nullif("page_target", F.lit(0))
    return (means.join(state.select("reader_id", "page_target"), "reader_id")
            .filter(F.col("mean") > target * PAGE_TOLERANCE)
            .select("reader_id", "page_target", half_even(F.col("mean"), 1).alias("current_avg"),
                    "n_with_pages"))


def favourites(resolved_log: DataFrame) -> DataFrame:
    """Distinct (reader_id, item_key) the reader rated 4 or more."""
    return (resolved_log.filter((F.col("rating") >= LIKED) & F.col("item_key").isNotNull())
            .select("reader_id", "item_key").distinct())


def link_overlap(links: DataFrame, liked: DataFrame) -> DataFrame:
    """(reader_id, item_key, links): how many of an item's links the reader liked."""
    return (links.select(F.col("src_key").alias("src"), F.col("dst_key").alias("item_key")).distinct()
            .join(liked, "item_key").groupBy("reader_id", F.col("src").alias("item_key"))
            .agg(F.count("*").alias("links")))


def anchors(resolved_log: DataFrame, tags: DataFrame, live_tags: DataFrame,
            today: str) -> tuple[DataFrame, DataFrame]:
    """Liked reads that carry a tag of the reader's active vectors.

    Returns (weights, anchor_tags): weights has one row per reader and bucket;
    anchor_tags is (reader_id, item_key, kind, tag, weight), weight being the sum of
    bucket weights over all liked reads of that item."""
    liked = resolved_log.filter((F.col("rating") >= LIKED) & F.col("item_key").isNotNull())
    bucket = values.recency_bucket(F.col("read_on"), F.lit(today).cast("date"))
    reads = settle(liked.withColumn("bucket", bucket).groupBy("reader_id", "item_key", "bucket").agg(
        F.count("*").alias("n")), "liked-reads")
    kept = settle(reads.select("reader_id", "item_key").distinct().join(positive_tags(tags), "item_key")
                  .join(live_tags, ["reader_id", "kind", "tag"]), "anchor-tags")
    reads = reads.join(kept.select("reader_id", "item_key").distinct(), ["reader_id", "item_key"],
                       "left_semi")
    n = {b: F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)) for b in BUCKETS}
    per_reader = reads.groupBy("reader_id").agg(*[c.alias(f"n{i}") for i, c in enumerate(n.values())])
    inverse = [F.lit(1.0) / F.greatest(F.col(f"n{i}"), F.lit(1)) for i in range(len(BUCKETS))]
    total = sum(inverse[1:], inverse[0])
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"n{i}").alias("n"),
                              half_even(inverse[i] / total * ANCHOR_TOTAL, 4).alias("weight"))
                     for i, b in enumerate(BUCKETS)])
    weights = per_reader.select("reader_id", F.explode(rows).alias("w")).select("reader_id", "w.*")
    strength = (reads.join(weights.select("reader_id", "bucket", "weight"), ["reader_id", "bucket"])
                .groupBy("reader_id", "item_key").agg(F.sum(F.col("n") * F.col("weight")).alias("weight")))
    return weights, kept.join(strength, ["reader_id", "item_key"])


def anchor_groups(anchor_tags: DataFrame) -> DataFrame:
    """Anchors of one reader with the same tags, merged: (reader_id, shape, kind, tag, weight)."""
    per_item = anchor_tags.groupBy("reader_id", "item_key", "weight").agg(
        F.array_sort(F.collect_set(F.struct("kind", "tag"))).alias("tags"))
    merged = per_item.groupBy("reader_id", "tags").agg(F.sum("weight").alias("weight"))
    return merged.select("reader_id", F.xxhash64("tags").alias("shape"), "weight",
                         F.explode("tags").alias("t")).select("reader_id", "shape", "t.*", "weight")


def anchor_strength(wanted: DataFrame, wanted_tags: DataFrame, groups: DataFrame,
                    unit: str = "item_key") -> DataFrame:
    """(reader_id, unit, strength): sum of anchor weights sharing a tag, capped."""
    hits = (wanted.select("reader_id", unit).join(wanted_tags.select(unit, "kind", "tag"), unit)
            .join(groups, ["reader_id", "kind", "tag"])
            .groupBy("reader_id", unit, "shape").agg(F.max("weight").alias("weight")))
    return hits.groupBy("reader_id", unit).agg(
        F.least(F.sum("weight"), F.lit(ANCHOR_CAP)).alias("strength"))


def matched_anchors(wanted: DataFrame, wanted_tags: DataFrame, anchor_tags: DataFrame, items: DataFrame,
                    limit: int = 5) -> DataFrame:
    """(reader_id, item_key, place, anchor, title, weight): the heaviest anchors that share
    a tag with each wanted item."""
    hits = (wanted.select("reader_id", "item_key").join(wanted_tags, "item_key")
            .join(anchor_tags.withColumnRenamed("item_key", "anchor"), ["reader_id", "kind", "tag"])
            .groupBy("reader_id", "item_key", "anchor").agg(F.max("weight").alias("weight")))
    top = top_rows(hits, ["reader_id", "item_key"], [F.desc(F.round("weight", 9)), F.col("anchor")], limit)
    return top.join(items.select(F.col("item_key").alias("anchor"), "title"), "anchor").select(
        "reader_id", "item_key", F.col("_rn").alias("place"), "anchor", "title", "weight")


def favourite_pools(log: DataFrame) -> DataFrame:
    """(reader_id, pool, title_norm, author_norm): five-star authors, favourite authors
    and favourite titles, under the older normaliser."""
    old = text.norm_keep_subtitle
    rated = log.filter(F.col("rating") >= 4.5).select(
        "reader_id", "rating", old("title").alias("t"), old("author").alias("author_norm"))

    def pool(name, title):
        return F.struct(F.lit(name).alias("pool"), title.alias("title_norm"))
    pools = F.array_compact(F.array(
        F.when(F.col("rating") >= 5.0, pool("five_star_author", F.lit(""))),
        pool("favourite_author", F.lit("")), pool("favourite_title", F.col("t"))))
    return (rated.select("reader_id", "author_norm", F.explode(pools).alias("p"))
            .select("reader_id", "p.*", "author_norm").distinct())


def author_history(log: DataFrame, authors: DataFrame) -> DataFrame:
    """(reader_id, author, matched_author, reads, liked) counting co-authored reads."""
    asked = authors.select("author").distinct().withColumn("part", text.norm("author")).filter("part <> ''")
    parts = (log.filter(F.coalesce("title", F.lit("")) != "")
             .select("reader_id", "rating", "logged_on", "log_id", F.col("author").alias("raw"),
                     F.explode(text.author_parts("author")).alias("part")))
    return (parts.join(asked, "part").groupBy("reader_id", "author")
            .agg(F.min(F.struct("logged_on", "log_id", "raw"))["raw"].alias("matched_author"),
                 F.count("*").alias("reads"), F.count_if(F.col("rating") >= LIKED).alias("liked")))


def rejection_rows(events: DataFrame) -> DataFrame:
    """Rejections in each reader's tail run: those after the last accept, up to the
    first other value.  Three aggregates per reader instead of one sorted window."""
    value = F.coalesce(F.nullif("vector", F.lit("")), F.nullif("genre", F.lit("")))
    kind = F.when(F.nullif("vector", F.lit("")).isNotNull(), "vector").otherwise("genre")
    rows = events.withColumns({"value": value, "kind": kind})
    accepts = rows.groupBy("reader_id").agg(
        F.max(F.when(F.col("type") == "accepted", F.col("seq"))).alias("accept"))
    tail = (rows.filter((F.col("type") == "rejected") & value.isNotNull()).join(accepts, "reader_id")
            .filter(F.col("seq") > F.coalesce("accept", F.lit(-1))))
    last = tail.groupBy("reader_id").agg(F.max_by("value", "seq").alias("run_value"),
                                         F.max_by("kind", "seq").alias("run_kind"))
    tail = tail.join(last, "reader_id")
    breaks = tail.groupBy("reader_id").agg(
        F.max(F.when(F.col("value") != F.col("run_value"), F.col("seq"))).alias("broken"))
    return (tail.join(breaks, "reader_id").filter(F.col("seq") > F.coalesce("broken", F.lit(-1)))
            .select("reader_id", "run_kind", "run_value", "seq", "item_key"))


def rejection_runs(events: DataFrame, at_least: int = RUN_LENGTH) -> DataFrame:
    return (rejection_rows(events).groupBy("reader_id", "run_kind", "run_value")
            .agg(F.count("*").alias("n"), F.count("item_key").alias("n_keys"))
            .filter(F.col("n") >= at_least))


def shared_attributes(keys: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    """(reader_id, page_range, signals, themes) common to every key of a reader."""
    distinct = keys.filter(F.col("item_key").isNotNull()).select("reader_id", "item_key").distinct()
    pages = F.nullif("pages", F.lit(0))
    base = (distinct.join(items.select("item_key", "pages"), "item_key", "left").groupBy("reader_id")
            .agg(F.count("*").alias("n_keys"), F.concat(
                F.min(pages).cast("string"), F.lit("-"), F.max(pages).cast("string")).alias("page_range")))
    held = (distinct.join(positive_tags(tags), "item_key").groupBy("reader_id", "kind", "tag")
            .agg(F.count("*").alias("n")).join(base.select("reader_id", "n_keys"), "reader_id")
            .filter(F.col("n") == F.col("n_keys")))
    lists = held.groupBy("reader_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "signal", F.col("tag")))).alias("signals"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "theme", F.col("tag")))).alias("themes"))
    return base.join(lists, "reader_id", "left")


def probes(events: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    """What to ask each reader whose tail run of rejections is long enough: the run, what
    all its items share, and `ask`: ``shared`` if they share anything, else ``run``."""
    rows = rejection_rows(events)
    runs = rejection_runs(events)
    live = rows.join(runs.select("reader_id"), "reader_id", "left_semi")
    shared = shared_attributes(live, items, tags)
    empty = F.array().cast("array<string>")
    some = (F.size(F.coalesce("signals", empty)) > 0) | (F.size(F.coalesce("themes", empty)) > 0) | F.col("page_range").isNotNull()
    return (runs.join(shared, "reader_id", "left")
            .select("reader_id", "run_kind", "run_value", "n", "page_range",
                    F.array_join(F.coalesce("signals", empty), "|").alias("signals"),
                    F.array_join(F.coalesce("themes", empty), "|").alias("themes"),
                    F.when(some, "shared").otherwise("run").alias("ask")))


def lock_ledger(events: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(reader_id, item_key, defended, session_lock) from events and session notes."""
    rows = events.filter(F.col("item_key").isNotNull()).select("reader_id", "item_key", "type")
    if notes is not None:
        rows = rows.unionByName(notes.filter((F.col("kind") == "session_lock") & F.col("item_key").isNotNull())
                                .select("reader_id", "item_key", F.lit("session_lock").alias("type")))
    return (rows.groupBy("reader_id", "item_key")
            .agg(F.count_if(F.col("type") == "defended").alias("defended"),
                 F.bool_or(F.col("type") == "session_lock").alias("session_lock"))
            .filter((F.col("defended") > 0) | F.col("session_lock")))


def rejection_counts(ledger: DataFrame) -> DataFrame:
    """(reader_id, title_norm, author_norm, n, penalty)."""
    n = ledger.groupBy("reader_id", "title_norm", "author_norm").agg(
        F.count_if(F.col("status") == "rejected").alias("n"))
    return n.withColumn("penalty", values.rejection_penalty(F.col("n")))


def scoped_rejections(ledger: DataFrame, genres: list[str] = (), indie: bool = False,
                      classic: bool = False, pages: str | None = None, threshold: int = 3) -> DataFrame:
    """(reader_id, n, probe): rejections inside one request's scope.  A record that does
    not know its genre or pages counts as inside."""
    genre = F.nullif(F.lower("primary_genre"), F.lit(""))
    bucket = values.page_bucket(F.col("pages"))
    inside = F.col("status") == "rejected"
    if genres:
        inside = inside & (genre.isNull() | genre.isin([g.lower() for g in genres]))
    if indie:
        inside = inside & F.coalesce("indie", F.lit(False))
    if classic:
        inside = inside & F.coalesce("classic", F.lit(False))
    if pages:
        inside = inside & (bucket.isNull() | (bucket == pages))
    return (ledger.groupBy("reader_id").agg(F.count_if(inside).alias("n"))
            .withColumn("probe", F.col("n") >= threshold))
