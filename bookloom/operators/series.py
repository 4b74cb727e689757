"""Series order, next book, shape and the selection-corrected series rating.

Places inside a series come from one range sort over the whole catalogue, so a
series that holds a third of all items is still numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import series as pos
from bookloom.functions import text, values
from bookloom.operators.common import best, half_even, numbered, settle, top_rows

# Fixed values of the corrected rating.
TIGHT_STATUS = ["Short Series", "Long Series"]
TIGHT_ROLES = ["first", "mid", "late"]
OUTLIER_SHARE = 0.05
SERIES_SHARE, OWN_SHARE = 0.75, 0.25
FLAT_VARIANCE = 1e-9
# Fixed values of the review-count audit and the series-type audit.
ANOMALY_SHARE, ANOMALY_MEDIAN, ANOMALY_BOOKS = 0.05, 2000, 3
LONG_SERIES_BOOKS, LONG_SERIES_PAGES = 4, 2500


def _has_series():
    return F.coalesce("series", F.lit("")) != ""


def places(items: DataFrame, group: list[str], number: str = "order_no") -> DataFrame:
    """Add `place` (1..n in the group by number, title, key), `passed` (eligible books
    up to that place) and `e` (the same for an eligible book, else null)."""
    rows = numbered(items, [*group, number, "title", "item_key"], "_n", "eligible")
    starts = rows.groupBy(*group).agg(
        F.min("_n").alias("_first"), F.min(F.struct("_n", (F.col("passed") - F.col("eligible").cast("int"))
                                                    .alias("base")))["base"].alias("_base"))
    rows = rows.join(starts, group).withColumns({
        "place": F.col("_n") - F.col("_first") + 1, "passed": F.col("passed") - F.col("_base")})
    return rows.withColumn("e", F.when(F.col("eligible"), F.col("passed"))).drop("_n", "_first", "_base")


def ordered_books(items: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Series books with order number, prequel flag, normalised pair and place."""
    rows = items.filter(_has_series())
    if statuses:
        rows = rows.filter(F.col("series_status").isin(statuses))
    number = pos.book_number("series_position")
    rows = rows.select("item_key", "title", "author", "series", "series_position", "pages", "rating",
                       "reviews", "series_status", "series_role",
                       pos.order_number("series_position").alias("order_no"),
                       (~F.coalesce(number < 1, F.lit(False))).alias("eligible"),
                       text.norm("title").alias("title_norm"), text.norm("author").alias("author_norm"))
    return places(rows, ["series"])


def _open_after(starts: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """starts(keys, after) -> keys + next: the first number past `after` that is not
    taken.  Taken numbers form islands; the answer is the end of the island that
    begins right after the start, plus one.  Linear in both inputs."""
    owner = [k for k in keys if k in taken.columns]
    per = Window.partitionBy(*owner).orderBy("e")
    islands = taken.select(*owner, "e").distinct().withColumn("i", F.col("e") - F.row_number().over(per))
    ends = islands.join(islands.groupBy(*owner, "i").agg(F.max("e").alias("end")), [*owner, "i"])
    first = starts.withColumn("e", F.col("after") + 1)
    return (first.join(ends.select(*owner, "e", "end"), [*owner, "e"], "left")
            .withColumn("next", F.coalesce(F.col("end") + 1, F.col("e"))).drop("e", "end"))


def unfinished(resolved_log: DataFrame, items: DataFrame, min_rating: float = 4.0,
               min_avg: float = 3.5, min_last: float = 3.0) -> DataFrame:
    """Series a reader liked, has not marked completed, and the next book unread."""
    # The titles are the catalogue's, so they are normalised there and not once per log row.
    facts = items.filter(_has_series() & (F.coalesce("series_status", F.lit("")) != "Standalone")).select(
        "item_key", "series", "author", "title", "series_position",
        pos.order_number("series_position").alias("order_no"),
        text.norm("title").alias("title_norm"), text.norm("author").alias("author_norm"))
    rows = settle(resolved_log.filter(F.col("item_key").isNotNull()).select(
        "reader_id", "item_key", "rating", "logged_on", "log_id",
        values.has_tag("my_tags", "*completed").alias("completed")).join(facts, "item_key"), "series-log")
    keys = ["reader_id", "series"]
    summary = rows.groupBy(*keys).agg(
        F.max("rating").alias("max_rating"), F.avg("rating").alias("mean"),
        F.max_by("rating", F.when(F.col("rating").isNotNull(), F.struct(
            "order_no", "title", "logged_on", "log_id"))).alias("furthest"),
        F.bool_or("completed").alias("completed"))
    kept = summary.filter((F.col("max_rating") >= min_rating) & (F.col("mean") >= min_avg)
                          & (F.col("furthest") >= min_last) & ~F.col("completed"))
    last = top_rows(rows, keys, [F.desc("order_no"), F.desc("title"), F.col("logged_on"),
                                 F.col("log_id")], 1).select(
        *keys, "author", F.col("title").alias("last_title"),
        F.col("series_position").alias("last_position"), F.col("rating").alias("last_rating"))
    books = settle(ordered_books(items.filter(F.col("series_status") != "Standalone")).filter("eligible"),
                   "series-books")
    taken = rows.select(*keys, "title_norm", "author_norm").distinct().join(
        books.select("series", "title_norm", "author_norm", "e"), ["series", "title_norm", "author_norm"]).select(*keys, "e")
    nexts = _open_after(kept.select(*keys, F.lit(0).cast("bigint").alias("after")), taken, keys)
    found = nexts.join(books.select("series", F.col("e").alias("next"), F.col("title").alias("next_title"),
                                    F.col("series_position").alias("next_position"),
                                    F.col("pages").alias("next_pages"), F.col("item_key").alias("next_key")),
                       ["series", "next"], "left")
    return (kept.join(last, keys).join(found.drop("after", "next"), keys)
            .withColumn("mean", half_even(F.col("mean"), 2)).drop("completed", "furthest"))


def next_after(sources: DataFrame, items: DataFrame, excluded: DataFrame) -> DataFrame:
    """sources(reader_id, item_key) -> next_key in the source's sub-series, else in the
    whole series; prequels and excluded pairs are stepped over.

    `excluded` holds (reader_id, title_norm, author_norm) under the older rules."""
    old = text.norm_keep_subtitle
    books = settle(ordered_books(items).drop("place", "passed", "e").withColumns({
        "title_norm": old("title"), "author_norm": old("author"),
        "sub": pos.old_sub_thread("series_position")}), "series-books")
    excluded = settle(excluded, "excluded-pairs")
    asked = settle(sources.select("reader_id", "item_key").distinct()
             .join(books.filter(F.col("series_status").isin(TIGHT_STATUS)).select(
                 "item_key", "series", "sub", "series_position", "title_norm", "author_norm"), "item_key"),
                   "walk-sources")

    def walk(group, wanted, members):
        ranked = places(members, group)
        same_pair = wanted.join(ranked.select(*group, "title_norm", "author_norm", "place"),
                                [*group, "title_norm", "author_norm"])
        same_pos = wanted.filter(F.col("series_position").isNotNull()).join(
            ranked.select(*group, "series_position", "place"), [*group, "series_position"])
        cols = ["reader_id", "source", *group, "place"]
        start = (same_pair.select(*cols).unionByName(same_pos.select(*cols))
                 .groupBy("reader_id", "source", *group).agg(F.min("place").alias("place")))
        start = start.join(ranked.select(*group, "place", F.col("passed").alias("after")), [*group, "place"])
        taken = (excluded.join(ranked.filter("e is not null").select(*group, "title_norm", "author_norm", "e"),
                               ["title_norm", "author_norm"]).select("reader_id", *group, "e"))
        nexts = _open_after(start, taken, ["reader_id", "source", *group])
        return nexts.join(ranked.select(*group, F.col("e").alias("next"), F.col("item_key").alias("next_key")),
                          [*group, "next"]).select("reader_id", "source", "next_key")

    wanted = asked.withColumnRenamed("item_key", "source")
    inside = walk(["series", "sub"], wanted.filter("sub is not null"), books.filter("sub is not null"))
    whole = walk(["series"], wanted, books)
    return (wanted.select("reader_id", "source")
            .join(inside.withColumnRenamed("next_key", "k1"), ["reader_id", "source"], "left")
            .join(whole.withColumnRenamed("next_key", "k2"), ["reader_id", "source"], "left")
            .select("reader_id", F.col("source").alias("item_key"), F.coalesce("k1", "k2").alias("next_key")))


def chain_next(sources: DataFrame, items: DataFrame) -> DataFrame:
    """sources(item_key) -> next_title by plain series order, sub-series first."""
    sub = pos.subseries("series_position")
    books = settle(ordered_books(items).drop("place", "passed", "e").withColumns(
        {"sub": sub["name"], "sub_no": F.coalesce(sub["n"], F.col("order_no"))}), "chain-books")
    asked = sources.select("item_key").distinct().join(
        books.select("item_key", "series", "sub", "series_position", "title_norm", "author_norm"), "item_key")
    asked = asked.withColumnRenamed("item_key", "source")

    def walk(group, number, wanted, members):
        ranked = places(members, group, number)
        cols = ["source", *group, "place"]
        pair = wanted.join(ranked.select(*group, "title_norm", "author_norm", "place"),
                           [*group, "title_norm", "author_norm"]).select(*cols)
        same = wanted.filter(F.col("series_position").isNotNull()).join(
            ranked.select(*group, "series_position", "place"), [*group, "series_position"]).select(*cols)
        start = pair.unionByName(same).groupBy("source", *group).agg((F.min("place") + 1).alias("place"))
        return start.join(ranked.select(*group, "place", F.col("title").alias("t")),
                          [*group, "place"]).select("source", "t")

    inside = walk(["series", "sub"], "sub_no", asked.filter("sub is not null"), books.filter("sub is not null"))
    whole = walk(["series"], "order_no", asked, books)
    return (asked.select("source").join(inside.withColumnRenamed("t", "t1"), "source", "left")
            .join(whole.withColumnRenamed("t", "t2"), "source", "left")
            .select(F.col("source").alias("item_key"), F.coalesce("t1", "t2").alias("next_title")))


def navigation(wanted: DataFrame, items: DataFrame, log: DataFrame, picks: DataFrame) -> DataFrame:
    """Every book of each wanted (reader_id, series) with read, listed and next flags and
    the reader's latest rating.  Pairs are compared exactly."""
    books = ordered_books(items)
    log_pairs = log.filter(F.coalesce("title", F.lit("")) != "").groupBy(
        "reader_id", text.norm("title").alias("title_norm"), text.norm("author").alias("author_norm")).agg(
            F.max_by("rating", F.when(F.col("rating").isNotNull(), F.struct("logged_on", "log_id"))).alias("my_rating"))
    listed = picks.select("reader_id", text.norm("title").alias("title_norm"),
                          text.norm("author").alias("author_norm")).distinct()
    keys = ["reader_id", "title_norm", "author_norm"]
    rows = (wanted.select("reader_id", "series").distinct().join(books, "series")
            .join(log_pairs.withColumn("read", F.lit(True)), keys, "left")
            .join(listed.withColumn("on_list", F.lit(True)), keys, "left").fillna(False, ["read", "on_list"]))
    nexts = rows.filter("eligible and not read").groupBy("reader_id", "series").agg(
        F.min("place").alias("next_place"))
    return (rows.join(nexts, ["reader_id", "series"], "left")
            .withColumn("next_unread", F.coalesce(F.col("place") == F.col("next_place"), F.lit(False)))
            .drop("next_place", "eligible", "passed", "e"))


def navigation_totals(rows: DataFrame) -> DataFrame:
    to_add = ~F.col("read") & ~F.col("on_list")
    return rows.groupBy("reader_id", "series").agg(
        F.count("*").alias("n_books"), F.count_if("read").alias("n_read"), F.count_if("on_list").alias("n_listed"),
        F.max(F.when(F.col("next_unread"), F.col("item_key"))).alias("next_key"),
        F.sum("my_rating").alias("rating_sum"), F.count_if(to_add).alias("add_count"),
        F.sum(F.when(to_add, F.coalesce("pages", F.lit(0))).otherwise(0)).alias("add_pages"))


def shapes(items: DataFrame) -> DataFrame:
    """(series, shape): loose sub-series, dip-in, or one arc."""
    rows = items.filter(_has_series()).withColumn("sub", pos.subseries("series_position")["name"])
    every_alone = F.bool_and(F.coalesce(F.col("series_status") == "Standalone", F.lit(False)))
    role_alone = F.bool_and(F.coalesce(F.col("series_role") == "standalone", F.lit(False)))
    return rows.groupBy("series").agg(
        F.when(F.bool_or(F.col("sub").isNotNull()), "loose-subseries")
        .when(every_alone | role_alone, "dip-in").otherwise("one-arc").alias("shape"))


def subseries_groups(items: DataFrame) -> DataFrame:
    """(series, sub, place, item_key, title): members of each sub-series in order."""
    sub = pos.subseries("series_position")
    rows = items.filter(_has_series()).select(
        "item_key", "title", "series", F.lit(True).alias("eligible"), sub.alias("s")).filter("s is not null").select(
        "item_key", "title", "series", "eligible", F.col("s.name").alias("sub"), F.col("s.n").alias("sub_no"))
    return places(rows, ["series", "sub"], "sub_no")


def corrected_baseline(items: DataFrame) -> DataFrame:
    """(series, baseline): what the series would rate if later volumes had kept all of
    volume one's readers.  Missing where the assumptions do not hold."""
    number = pos.first_number("series_position")
    rows = items.filter(
        F.col("series_status").isin(TIGHT_STATUS) & _has_series() & F.col("series_role").isin(TIGHT_ROLES)
        & (number == F.floor(number)) & F.col("rating").isNotNull() & (F.col("reviews") > 0)).select(
        "series", number.alias("number"), F.col("rating").alias("mu"), F.col("reviews").alias("n"),
        "item_key", (-F.col("reviews")).alias("neg"))
    mains = best(rows, ["series", "number"], [F.col("neg"), F.col("item_key")], ["mu", "n"])
    one = F.col("number") == 1.0
    stats = mains.groupBy("series").agg(F.median("n").alias("median"), F.max(F.when(one, F.col("n"))).alias("n1"),
                                        F.max(F.when(one, F.col("mu"))).alias("mu1")).filter("n1 is not null")
    kept = mains.join(stats, "series").filter(one | (F.col("n") >= F.col("median") * OUTLIER_SHARE))
    share = F.col("n") / F.col("n1")
    mills = values.norm_pdf(values.norm_ppf(1.0 - share)) / share
    kept = kept.withColumns({"lam": F.when(one, 0.0).otherwise(mills),
                             "bad": ~one & (F.col("n") >= F.col("n1"))})
    fit = kept.groupBy("series").agg(
        F.count("*").alias("rows"), F.bool_or("bad").alias("bad"), F.max("mu1").alias("mu1"),
        F.regr_intercept("mu", "lam").alias("intercept"), F.var_pop("lam").alias("spread"),
        F.avg("mu").alias("mean"))
    answer = (F.when((F.col("rows") < 3) | (F.col("spread") < FLAT_VARIANCE), F.col("mu1"))
              .otherwise(F.least("intercept", "mean")))
    return fit.filter(~F.col("bad")).select("series", answer.alias("baseline"))


def effective_rating(items: DataFrame) -> DataFrame:
    """Items with `effective`: tight-series books blend the series baseline with their
    own rating, the rest keep their own."""
    tight = F.col("series_status").isin(TIGHT_STATUS) & F.col("series_role").isin(TIGHT_ROLES)
    blend = F.coalesce(F.col("baseline") * SERIES_SHARE + F.col("rating") * OWN_SHARE, F.col("baseline"))
    return (items.join(corrected_baseline(items), "series", "left")
            .withColumn("effective", F.when(F.coalesce(tight, F.lit(False)) & F.col("baseline").isNotNull(), blend)
                        .otherwise(F.col("rating"))).drop("baseline"))


def review_anomalies(items: DataFrame, today: str) -> DataFrame:
    """Books whose review count is far below the median of the others in their series.

    The others' median depends only on the book's own count, so it is read off the
    group's histogram: dropping one value shifts every place at or past it by one."""
    rows = items.filter(_has_series() & F.col("reviews").isNotNull())
    keys = ["author", "series"]
    hist = rows.groupBy(*keys, "reviews").agg(F.count("*").alias("c"))
    total = hist.groupBy(*keys).agg(F.sum("c").alias("n"), F.expr(
        "percentile(reviews, 0.5, c)").alias("median")).filter(
            (F.col("n") >= ANOMALY_BOOKS) & (F.col("median") >= ANOMALY_MEDIAN))
    upto = Window.partitionBy(*keys).orderBy("reviews").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = hist.join(total, keys).withColumn("cum", F.sum("c").over(upto))
    low, high = F.expr("n div 2"), F.expr("(n - 1) div 2 + 1")

    def at(place):
        return F.min(F.when(F.col("cum") >= place, F.col("reviews")))
    spots = cumulative.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("median").alias("median"), at(low).alias("a0"), at(low + 1).alias("a1"),
        at(high).alias("b0"), at(high + 1).alias("b1"))
    lower = F.when(F.col("a0") < F.col("reviews"), F.col("a0")).otherwise(F.col("a1"))
    upper = F.when(F.col("b0") < F.col("reviews"), F.col("b0")).otherwise(F.col("b1"))
    number = pos.first_number("series_position")
    months = F.months_between(F.lit(today).cast("date"), F.col("released"))
    kind = F.when(number != F.floor(number), "C").when(months < 6, "B").otherwise("A")
    others = (lower + upper) / 2
    return (rows.join(spots, keys).withColumn("others", others)
            .filter(F.col("reviews") < others * ANOMALY_SHARE)
            .select("item_key", "series", "reviews", "others", kind.alias("kind")))


def series_type_audit(library: DataFrame) -> DataFrame:
    """Rows whose series type should change: four or more books decide by total pages."""
    name = F.trim(F.coalesce("series", F.lit("")))
    rows = library.withColumns({"_s": name, "_p": F.coalesce(
        F.trim("pages").try_cast("double").cast("bigint"), F.lit(0))}).filter("_s <> ''")
    stats = rows.groupBy("_s").agg(F.count("*").alias("n_books"), F.sum("_p").alias("total_pages")).filter(
        F.col("n_books") >= LONG_SERIES_BOOKS)
    new = F.when(F.col("total_pages") >= LONG_SERIES_PAGES, "Long Series").otherwise("Short Series")
    return (rows.join(stats, "_s").withColumns({
        "old_type": F.trim(F.coalesce("series_type", F.lit(""))), "new_type": new})
        .filter(F.col("old_type") != F.col("new_type"))
        .select("title", "authors", F.col("_s").alias("series"), "n_books", "total_pages", "old_type", "new_type"))


def spread_series(library: DataFrame, spread: list[str]) -> DataFrame:
    """Modal genre to every member of a series, listed tags to members that lack them,
    and the title as series where there is none."""
    counts = library.filter("series is not null and series <> ''").filter("genre is not null").groupBy(
        "series", "genre").agg(F.count("*").alias("c"))
    mode = best(counts.withColumn("neg", -F.col("c")), ["series"], [F.col("neg"), F.col("genre")],
                ["genre"]).withColumnRenamed("genre", "_mode")
    held = (library.filter("series is not null and series <> ''")
            .select("series", F.explode(values.tag_array("tags")).alias("tag"))
            .filter(F.col("tag").isin(spread)).groupBy("series").agg(F.collect_set("tag").alias("_held")))
    empty = F.array().cast("array<string>")
    listed = F.array(*[F.lit(t) for t in spread])
    missing = F.array_except(F.array_intersect(listed, F.coalesce("_held", empty)), values.tag_array("tags"))
    tags = F.when(F.size(missing) == 0, F.col("tags")).otherwise(
        F.concat_ws(", ", F.col("tags"), F.array_join(missing, ", ")))
    return (library.join(mode, "series", "left").join(held, "series", "left")
            .withColumns({"genre": F.coalesce("_mode", "genre"), "tags": tags,
                          "series": F.coalesce("series", "title")}).drop("_mode", "_held"))
