"""Bulk catalogue maintenance: sync, rule gates, links, mappings, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import series, text, values
from bookloom.operators import filters, identity
from bookloom.operators.common import best, settle, top_rows

# Thresholds of the catalogue rules.
INDIE_REVIEW_LIMIT = 15_000
CLASSIC_AGE = 30
LOOSE_SHARE, LOOSE_BOOKS = 0.8, 3
LOOSE_ROLES = ["loose-entry", "loose-mid", "standalone"]
SERIES_ENTRY_ROLES = ["first", "loose-entry"]
LINK_CAP, RANKING_POOL = 6, 25
CONCENTRATION = 0.6
NUMBERS = ["pages", "reviews", "rating", "pub_year"]
TRIPLE = ["series", "series_position", "series_status"]
PINNED = NUMBERS + TRIPLE


def sync(library: DataFrame, items: DataFrame, order: str) -> DataFrame:
    """Catalogue after a library CSV: (item_key, is_new, the CSV-owned fields, changed).

    The series triple follows the CSV even to null, a number only when the CSV has one;
    of repeated keys the last row (by `order`) wins.  Items the CSV lacks stay."""
    owned = values.csv_owned()
    rows = library.select(text.item_key("title", "authors").alias("item_key"), order,
                          F.col("title").alias("_title"), F.col("authors").alias("_author"),
                          *[c.alias(n) for n, c in owned.items()])
    last = rows.groupBy("item_key").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(f"_{n}") for n in NUMBERS],
        *[F.max_by(n, order).alias(f"_{n}") for n in TRIPLE],
        F.max_by("_title", order).alias("_title"), F.max_by("_author", order).alias("_author"))
    both = items.select("item_key", "title", "author", "status", *PINNED, F.lit(True).alias("_old")).join(
        last.withColumn("_csv", F.lit(True)), "item_key", "full")
    new = {n: F.coalesce(f"_{n}", n) for n in NUMBERS}
    new |= {n: F.when(F.col("_csv"), F.col(f"_{n}")).otherwise(F.col(n)) for n in TRIPLE}
    is_new = F.col("_old").isNull()
    changed = F.array_compact(F.array(*[
        F.when(~is_new & ~new[n].eqNullSafe(F.col(n)), F.lit(n)) for n in PINNED]))
    return both.select("item_key", is_new.alias("is_new"), F.coalesce("title", "_title").alias("title"),
                       F.coalesce("author", "_author").alias("author"),
                       F.coalesce("status", F.lit("pending")).alias("status"),
                       *[new[n].alias(n) for n in PINNED], changed.alias("changed"))


def refreshed_by_field(synced: DataFrame) -> DataFrame:
    return synced.select(F.explode("changed").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def apply_records(items: DataFrame, records: DataFrame) -> DataFrame:
    """Overlay extracted records (item_key, fields map): a field present in the map wins,
    even when null; CSV-owned fields never change; the status follows the confidence
    when the record names none.  A value that is not of its column's type changes nothing
    and its field is named in `rejected`."""
    over = records.select("item_key", F.col("fields").alias("_f"))
    kinds = dict(items.dtypes)
    fixed = set(PINNED) | {"item_key", "pk", "status"}

    def bad(c):
        return F.col("_f")[c].isNotNull() & F.col("_f")[c].try_cast(kinds[c]).isNull()

    def patched(c):
        return F.when(F.map_contains_key("_f", F.lit(c)) & ~bad(c), F.col("_f")[c].try_cast(kinds[c])).otherwise(F.col(c))
    open_fields = [c for c in items.columns if c not in fixed]
    rejected = F.coalesce(F.array_compact(F.array(*[F.when(bad(c), F.lit(c)) for c in open_fields])), F.array().cast("array<string>"))
    status = (F.when(F.col("_f").isNull(), F.col("status"))
              .when(F.map_contains_key("_f", F.lit("status")), F.col("_f")["status"])
              .when(F.col("_f")["confidence"] == "Low", "needs_review").otherwise("complete"))
    return items.join(over, "item_key", "left").select(
        *[status.alias(c) if c == "status" else F.col(c) if c in fixed else patched(c).alias(c)
          for c in items.columns], rejected.alias("rejected"))


def reply_fields(values_: DataFrame, items: DataFrame) -> DataFrame:
    """(item_key, fields): the scalar members of each reply's objects (raw_key, value
    variant), under the catalogue key that the raw key or else its title leads to; of
    several replies for one item, the one of the greatest doc_id counts."""
    named = values_.withColumn("title", F.coalesce(text.key_title("raw_key"), F.col("raw_key")))
    known = identity.upsert_keys(named, items).filter("canonical_key is not null")
    members = F.try_variant_get("value", "$", "map<string, variant>")
    plain = F.map_filter(members, lambda k, v: ~F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
                         & ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    fields = F.transform_values(plain, lambda k, v: F.try_variant_get(v, "$", "string"))
    rows = known.withColumn("fields", fields).filter("fields is not null")
    return rows.groupBy(F.col("canonical_key").alias("item_key")).agg(
        F.max_by("fields", F.struct("doc_id", "raw_key")).alias("fields"))


def reply_tags(values_: DataFrame, items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(item_key, child, pos, tag): themes and signals of the replies' objects that the
    closed lists hold, keyed as in reply_fields."""
    named = values_.withColumn("title", F.coalesce(text.key_title("raw_key"), F.col("raw_key")))
    known = identity.upsert_keys(named, items).filter("canonical_key is not null")
    paths = {"theme": "$.themes", "positive": "$.taste_signals.positive", "negative": "$.taste_signals.negative"}
    lists = F.explode(F.array(*[F.struct(F.lit(c).alias("child"), F.try_variant_get("value", p, "array<string>").alias("tags"))
                                for c, p in paths.items()]))
    each = known.select(F.col("canonical_key").alias("item_key"), lists.alias("l")).select(
        "item_key", "l.child", F.posexplode("l.tags").alias("pos", "tag"))
    return filters.closed_vocabulary(each, vocabulary)


def flag_gates(items: DataFrame, current_year: int) -> DataFrame:
    """Four ordered rules over indie, classic and series status; running them again
    changes nothing.  One aggregate per series carries what the rules need."""
    indie = F.coalesce("indie", F.lit(False))
    broke_out = indie & (F.col("reviews") > INDIE_REVIEW_LIMIT)
    still = indie & ~F.coalesce(F.col("reviews") > INDIE_REVIEW_LIMIT, F.lit(False))
    role = F.col("series_role")
    roled = role.isNotNull() & (F.coalesce("series_status", F.lit("")) != "Standalone")
    per_series = items.filter(F.coalesce("series", F.lit("")) != "").groupBy("series").agg(
        F.bool_or(still & F.coalesce(role.isin(SERIES_ENTRY_ROLES), F.lit(False))).alias("_indie"),
        F.count_if(roled).alias("_roled"), F.count_if(roled & role.isin(LOOSE_ROLES)).alias("_loose"))
    loose = (F.col("_roled") >= LOOSE_BOOKS) & (F.col("_loose") / F.col("_roled") >= LOOSE_SHARE)
    age = F.lit(current_year) - F.col("pub_year")
    young = F.coalesce("classic", F.lit(False)) & F.coalesce(age < CLASSIC_AGE, F.lit(True))
    return items.join(per_series, "series", "left").withColumns({
        "indie": F.when(F.col("_indie"), True).when(broke_out, False).otherwise(F.col("indie")),
        "classic": F.when(young, False).otherwise(F.col("classic")),
        "series_status": F.when(F.coalesce(loose, F.lit(False)), "Standalone").otherwise(F.col("series_status")),
    }).drop("_indie", "_roled", "_loose").select(*items.columns)


def canonical_links(links: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links(src_key, pos, dst_key) -> (kept, dropped).  Keys become canonical, links to
    itself and later spellings of a kept link are dropped, unknown keys stay."""
    known = identity.canonical_keys(links.withColumnRenamed("dst_key", "raw_key"), items)
    known = known.withColumns({"dst_key": F.coalesce("canonical_key", "raw_key"),
                               "matched": F.col("canonical_key").isNotNull()})
    known = settle(known.withColumn("light", text.light_key("dst_key")), "canonical-links")
    own = F.col("matched") & (F.col("dst_key") == F.col("src_key"))
    first = known.filter(~own).groupBy("src_key", "light").agg(F.min("pos").alias("_first"))
    marked = known.join(first, ["src_key", "light"], "left")
    keep = ~own & (F.col("pos") == F.col("_first"))
    kept = marked.filter(keep).select("src_key", "pos", "dst_key", "raw_key", "matched")
    dropped = marked.filter(~keep).select("src_key", "pos", "raw_key",
                                          F.when(own, "self").otherwise("duplicate").alias("reason"))
    return kept, dropped


def reciprocal_links(kept: DataFrame) -> DataFrame:
    """Add B -> A for every matched A -> B that lacks it, after B's own links.  The order
    of a list is (added, pos, dst_key), so no list has to be numbered."""
    base = kept.select("src_key", "dst_key", F.col("pos").cast("bigint").alias("pos"), F.lit(0).alias("added"))
    back = (kept.filter("matched").select(F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"),
                                          F.lit(0).cast("bigint").alias("pos"), F.lit(1).alias("added")))
    return best(base.unionByName(back), ["src_key", "dst_key"], [F.col("added"), F.col("pos")], ["pos", "added"])


def cap_links(links: DataFrame, items: DataFrame, themes: DataFrame, ranking: DataFrame) -> DataFrame:
    """At most six links per source: (src_key, dst_key, place, how).

    Over-long lists are cut to 25 by genre, shared themes and key, then to the six the
    ranking names; when it does not name six of them, the first six stay."""
    lengths = links.groupBy("src_key").agg(F.count("*").alias("length"))
    sized = settle(links.join(lengths, "src_key"), "link-lengths")
    short = sized.filter(F.col("length") <= LINK_CAP).select(
        "src_key", "dst_key", "added", "pos", F.lit("kept").alias("how"))
    long = sized.filter(F.col("length") > LINK_CAP)
    genre = F.lower(F.coalesce("primary_genre", F.lit("")))
    facts = items.select(F.col("item_key").alias("_key"), genre.alias("_genre"))
    low = themes.select("item_key", F.lower("tag").alias("tag")).distinct()
    crowded = long.filter(F.col("length") > RANKING_POOL)
    shared = (crowded.select("src_key", "dst_key").join(low.withColumnRenamed("item_key", "src_key"), "src_key")
              .join(low.withColumnRenamed("item_key", "dst_key"), ["dst_key", "tag"])
              .groupBy("src_key", "dst_key").agg(F.count("*").alias("shared")))
    scored = (crowded.join(shared, ["src_key", "dst_key"], "left")
              .join(facts.select(F.col("_key").alias("src_key"), F.col("_genre").alias("_sg")), "src_key", "left")
              .join(facts.select(F.col("_key").alias("dst_key"), F.col("_genre").alias("_dg")), "dst_key", "left"))
    known = F.col("_dg").isNotNull()
    scored = scored.withColumns({
        "s1": F.coalesce(((F.col("_sg") == F.col("_dg")) & (F.col("_sg") != "")).cast("int"), F.lit(0)),
        "s2": F.when(known, F.coalesce("shared", F.lit(0))).otherwise(0),
        "s3": F.when(known, text.light_key("dst_key")).otherwise(F.col("dst_key"))})
    cut = top_rows(scored, ["src_key"], [F.desc("s1"), F.desc("s2"), F.desc("s3"), F.col("dst_key")], RANKING_POOL)
    rest = top_rows(long.filter(F.col("length") <= RANKING_POOL), ["src_key"],
                    [F.col("added"), F.col("pos"), F.col("dst_key")], RANKING_POOL)
    cands = settle(cut.select("src_key", "dst_key", F.col("_rn").alias("place")).unionByName(
        rest.select("src_key", "dst_key", F.col("_rn").alias("place"))), "link-candidates")
    picks = (ranking.filter(F.col("rank") <= LINK_CAP)
             .select(text.light_key("src_key").alias("_ls"), text.light_key("pick").alias("_lp"), "rank"))
    valid = (cands.withColumns({"_ls": text.light_key("src_key"), "_lp": text.light_key("dst_key")})
             .join(picks, ["_ls", "_lp"]).groupBy("src_key", "dst_key").agg(F.min("rank").alias("rank")))
    full = valid.groupBy("src_key").agg(F.count("*").alias("n")).filter(F.col("n") == LINK_CAP).select("src_key")
    ranked = valid.join(full, "src_key", "left_semi").select(
        "src_key", "dst_key", F.lit(0).alias("added"), F.col("rank").cast("bigint").alias("pos"),
        F.lit("ranked").alias("how"))
    fallback = (cands.filter(F.col("place") <= LINK_CAP).join(full, "src_key", "left_anti")
                .select("src_key", "dst_key", F.lit(0).alias("added"), F.col("place").cast("bigint").alias("pos"),
                        F.lit("cut").alias("how")))
    return short.unionByName(ranked).unionByName(fallback)


def sync_links(links: DataFrame, items: DataFrame, themes: DataFrame,
               ranking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical, reciprocal and capped links, and one row per statistic.  A dry run is
    simply not writing the first frame."""
    kept, dropped = canonical_links(links, items)
    closed = settle(reciprocal_links(kept), "reciprocal-links")
    capped = settle(cap_links(closed, items, themes, ranking), "capped-links")

    def stat(df, name):
        return df.select(F.lit(name).alias("metric"), F.col("n").cast("bigint").alias("n"))
    lengths = closed.groupBy("src_key").agg(F.count("*").alias("c"))

    def places(df, *order):
        place = F.row_number().over(Window.partitionBy("src_key").orderBy(*order))
        return df.select("src_key", place.alias("place"), "dst_key")
    # A list has changed if it differs at any place.
    before, after = places(links, "pos", "dst_key"), places(capped, "added", "pos", "dst_key")
    lists = (before.join(after.withColumnRenamed("dst_key", "new"), ["src_key", "place"], "full")
             .filter(~F.col("dst_key").eqNullSafe(F.col("new"))).select("src_key").distinct())
    stats = [
        stat(kept.agg(F.count_if(F.col("matched") & (F.col("raw_key") != F.col("dst_key"))).alias("n")), "canonicalised"),
        stat(dropped.agg(F.count_if(F.col("reason") == "self").alias("n")), "self_dropped"),
        stat(dropped.agg(F.count_if(F.col("reason") == "duplicate").alias("n")), "duplicate_dropped"),
        stat(closed.agg(F.count_if(F.col("added") == 1).alias("n")), "reciprocals_added"),
        stat(lengths.agg(F.count_if(F.col("c") > LINK_CAP).alias("n")), "over_cap"),
        stat(capped.filter("how = 'ranked'").agg(F.count_distinct("src_key").alias("n")), "ranked"),
        stat(capped.filter("how = 'cut'").agg(F.count_distinct("src_key").alias("n")), "ranking_failures"),
        stat(lists.agg(F.count("*").alias("n")), "lists_changed")]
    rows = stats[0]
    for s in stats[1:]:
        rows = rows.unionByName(s)
    return capped, rows


def provisional_role() -> Column:
    """Series role where position and status settle it, else null."""
    status, pos = F.col("series_status"), F.col("series_position")
    numbered = F.coalesce(pos, F.lit("")).rlike(r"(?i)book\s*\d")
    in_series = status.isin("Short Series", "Long Series")
    return (F.when((status == "Standalone") & (F.coalesce("series", F.lit("")) == ""), "standalone")
            .when(status == "Short Stories", "standalone")
            .when(in_series & series.is_book_one("series_position"), "first")
            .when(in_series & numbered, "mid"))


def fill_roles(items: DataFrame) -> DataFrame:
    """Items with missing roles filled where possible and `needs_audit` for the rest."""
    role = F.coalesce("series_role", provisional_role())
    return items.withColumn("series_role", role).withColumn(
        "needs_audit", F.col("series_role").isNull() | F.col("author_entry_point").isNull())


def map_phrases(phrases: DataFrame, legacy: DataFrame, mapping: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(item_key, child, canonical_id, place): phrases(item_key, child, pos, phrase) kept
    or mapped to closed-list IDs, legacy IDs appended, first position wins."""
    allowed = vocabulary.select(F.col("tag").alias("canonical_id")).distinct()
    ids = phrases.filter(F.coalesce("phrase", F.lit("")) != "").join(
        allowed.select(F.col("canonical_id").alias("phrase"), F.lit(True).alias("_is_id")), "phrase", "left")
    ids = ids.join(mapping.select("phrase", F.col("canonical_id").alias("_mapped")), "phrase", "left").select(
        "item_key", "child", F.struct(F.lit(0).alias("late"), F.col("pos").cast("bigint").alias("pos")).alias("place"),
        F.when(F.col("_is_id"), F.col("phrase")).otherwise(F.col("_mapped")).alias("canonical_id"))
    old = legacy.select("item_key", "child", F.struct(
        F.lit(1).alias("late"), F.col("pos").cast("bigint").alias("pos")).alias("place"), "canonical_id")
    return (ids.unionByName(old).join(allowed, "canonical_id", "left_semi")
            .groupBy("item_key", "child", "canonical_id").agg(F.min("place").alias("place")))


def unmapped_phrases(phrases: DataFrame, legacy: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct phrases that are no ID and have no valid legacy ID at their position."""
    allowed = vocabulary.select(F.col("tag").alias("phrase")).distinct()
    done = legacy.join(allowed.withColumnRenamed("phrase", "canonical_id"), "canonical_id", "left_semi")
    return (phrases.filter(F.coalesce("phrase", F.lit("")) != "").join(allowed, "phrase", "left_anti")
            .join(done.select("item_key", "child", "pos"), ["item_key", "child", "pos"], "left_anti")
            .select("child", "phrase").distinct())


def retag_series(items: DataFrame, merges: DataFrame, renames: DataFrame, overrides: DataFrame) -> DataFrame:
    """(item_key, old/new series and position) where merge, rename or override changes it."""
    merged = merges.select(F.col("old").alias("series"), F.col("new").alias("_m"))
    renamed = renames.select(F.col("old").alias("_step"), F.col("new").alias("_r"))
    over = overrides.select("title", "author", F.col("series").alias("_os"), F.col("position").alias("_op"))
    rows = (items.select("item_key", "title", "author", "series", "series_position")
            .join(merged, "series", "left").withColumn("_step", F.coalesce("_m", "series"))
            .join(renamed, "_step", "left").join(over, ["title", "author"], "left"))
    out = rows.select("item_key", F.col("series").alias("old_series"),
                      F.coalesce("_os", "_r", "_step").alias("new_series"),
                      F.col("series_position").alias("old_position"),
                      F.coalesce("_op", "series_position").alias("new_position"))
    return out.filter(~F.col("old_series").eqNullSafe(F.col("new_series"))
                      | ~F.col("old_position").eqNullSafe(F.col("new_position")))


def rewrite_positions(items: DataFrame) -> DataFrame:
    new = series.rewrite_position("series_position")
    return items.select("item_key", F.col("series_position").alias("old_position"), new.alias("new_position")).filter(
        F.col("new_position").isNotNull())


def sync_tags(library: DataFrame, items: DataFrame) -> DataFrame:
    """Library rows with their flag tags set from the catalogue: new_tags and outcome."""
    flags = items.groupBy(text.light_key("item_key").alias("_light")).agg(
        F.max_by("indie", "item_key").alias("_indie"), F.max_by("classic", "item_key").alias("_classic"),
        F.lit(True).alias("_hit"))
    rows = library.withColumn("_light", text.light_key(text.item_key("title", "authors"))).join(flags, "_light", "left")
    tags = values.edit_tags("tags", {"Indie": F.col("_indie"), "Classics": F.col("_classic")})
    new = F.when(F.col("_hit"), tags).otherwise(F.coalesce("tags", F.lit("")))
    outcome = (F.when(F.col("_hit").isNull(), "unmatched").when(tags != F.coalesce("tags", F.lit("")), "changed")
               .otherwise("same"))
    return rows.withColumns({"new_tags": new, "outcome": outcome}).drop("_light", "_hit", "_indie", "_classic")


def normalise(items: DataFrame) -> DataFrame:
    """Rows whose stored normalised columns or author differ from what they should be.
    Expects stored title_normalized, title_short, author_normalized."""
    author = text.swap_last_first("author")
    rows = items.select(
        "item_key", "author", author.alias("new_author"), text.norm("title").alias("new_title_norm"),
        text.title_short("title").alias("new_title_short"), text.norm(author).alias("new_author_norm"),
        F.coalesce("title_normalized", F.lit("")).alias("_t"), F.coalesce("title_short", F.lit("")).alias("_s"),
        F.coalesce("author_normalized", F.lit("")).alias("_a"))
    stale = ((F.col("_t") != F.col("new_title_norm")) | (F.col("_s") != F.col("new_title_short"))
             | (F.col("_a") != F.col("new_author_norm")) | (F.coalesce("author", F.lit("")) != F.col("new_author")))
    return rows.withColumns({"stale": stale, "malformed": (F.col("new_title_norm") == "") | (F.col("new_author_norm") == "")}
                            ).filter("stale or malformed").drop("_t", "_s", "_a")


def proposal_diff(items: DataFrame, proposals: DataFrame, field: str, promote_only: bool = False) -> DataFrame:
    """(item_key, current, proposed) where a proposal (raw_key, value) differs.  A flag
    proposal only ever promotes."""
    known = identity.canonical_keys(proposals, items.select("item_key")).filter("canonical_key is not null")
    rows = known.select(F.col("canonical_key").alias("item_key"), F.col("value").alias("proposed")).join(
        items.select("item_key", F.col(field).alias("current")), "item_key")
    if promote_only:
        return rows.filter(F.coalesce("proposed", F.lit(False)) & ~F.coalesce("current", F.lit(False)))
    return rows.filter(~F.col("proposed").eqNullSafe(F.col("current")))


def apply_diff(items: DataFrame, diff: DataFrame, field: str) -> DataFrame:
    new = diff.select("item_key", F.col("proposed").alias("_new"), F.lit(True).alias("_hit"))
    return items.join(new, "item_key", "left").withColumn(
        field, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(field))).drop("_new", "_hit")


def distribution(items: DataFrame) -> DataFrame:
    """Per genre: counts, and the share of all indie and classic books it holds."""
    by = items.groupBy(F.coalesce(F.nullif("primary_genre", F.lit("")), F.lit("Unknown")).alias("genre")).agg(
        F.count("*").alias("total"), F.count_if("indie").alias("indie"), F.count_if("classic").alias("classic"))
    # One row of totals beside every genre.
    out = by.crossJoin(F.broadcast(by.agg(F.sum("indie").alias("_i"), F.sum("classic").alias("_c"))))
    for tag, total in (("indie", "_i"), ("classic", "_c")):
        share = F.col(tag) / F.nullif(F.col(total), F.lit(0))
        out = out.withColumns({f"{tag}_share": F.bround(share, 2),
                               f"{tag}_concentrated": F.coalesce(share > CONCENTRATION, F.lit(False))})
    return out.drop("_i", "_c")


def status_counts(items: DataFrame) -> DataFrame:
    """One row per status plus the total."""
    by = items.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))
    total = by.filter(F.col("status").isin("complete", "needs_review", "pending")).agg(
        F.lit("total").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return by.unionByName(total)


def status_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = status_counts(after).withColumnRenamed("n", "after"), status_counts(before).withColumnRenamed("n", "before")
    rows = b.join(a, "status", "full").fillna(0, ["before", "after"])
    return rows.withColumn("delta", F.col("after") - F.col("before"))


def sync_audit(before: DataFrame, synced: DataFrame) -> DataFrame:
    """Rows of the sync report: (section, name, n)."""
    status = status_delta(before, synced).select(F.lit("status").alias("section"), F.col("status").alias("name"),
                                                 F.col("delta").alias("n"))
    fields = refreshed_by_field(synced).select(F.lit("field").alias("section"), F.col("field").alias("name"), "n")
    new = synced.filter("is_new").select(F.lit("added").alias("section"), F.concat_ws(" — ", "title", "author").alias("name"),
                                         F.lit(1).cast("bigint").alias("n"))
    return status.unionByName(fields).unionByName(new)


def review_report(items: DataFrame, flags: DataFrame, audited: DataFrame) -> DataFrame:
    """(bucket, n_flags, n_items): audit flags by severity, clean and unaudited items."""
    by = flags.groupBy(F.col("severity").alias("bucket")).agg(
        F.count("*").alias("n_flags"), F.count_distinct("item_key").alias("n_items"))
    clean = audited.join(flags.select("item_key").distinct(), "item_key", "left_anti")
    left = items.select("item_key").join(audited, "item_key", "left_anti")

    def count(df, name):
        return df.agg(F.lit(name).alias("bucket"), F.lit(0).cast("bigint").alias("n_flags"), F.count("*").alias("n_items"))
    return by.unionByName(count(clean, "clean")).unionByName(count(left, "unaudited"))
