"""Recommendations for every reader: pool, strata, slots, sample.

Nothing here writes or sorts readers x items.  Readers with the same vectors share a taste;
per taste, items are grouped into cells by the tags they match.  A reader's strength depends
on the cell alone, so scores of matching items are only counted, per reader, stratum and
value.  The items that match none of the tags ("forced" rows, which only fill the residual
stratum) stay implicit: their score does not depend on the reader, so they are counted per
taste and score.  From the counts follow the sizes, the tie chunks and how many rows of each
chunk the sample can reach; rows in a chunk are taken in tossed order, so only those below a
toss that all but surely suffices are named, and whoever falls short is asked again in full.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import values
from bookloom.operators import filters, identity, reader, series
from bookloom.operators.common import positive_tags, settle, top_rows

# Score and slot constants.
RATING_PIVOT = 4.1
RATING_CLAMP = 1.0
TIE_GAP = 150  # thousandths
QUOTA = {"balanced": 0.20, "broad": 0.375}
APPETITE_MODE = {"high": "broad", "moderate": "balanced", "low": "similar"}
FOCUS_WEIGHT, LEAN_FACTOR = 6.0, 2.0
ADJACENT_WEIGHT, ADJACENT_RESIDUAL = 1.5, 0.5
RESIDUAL = "residual"


def rating_term(effective: Column) -> Column:
    """Rating above the pivot, clamped; unrated items are neutral."""
    return F.coalesce(F.greatest(F.lit(-RATING_CLAMP), F.least(F.lit(RATING_CLAMP), effective - RATING_PIVOT)),
                      F.lit(0.0))


def link_bonus(links: Column) -> Column:
    return F.least(F.coalesce(links, F.lit(0)), F.lit(reader.LINK_CAP)) * reader.LINK_WEIGHT


def rounded_sum(*parts: Column) -> Column:
    """Sum to thousandths, halves to even.  The parts are added as decimals of nine places,
    so that binary noise decides no tie."""
    total = sum((F.coalesce(p, F.lit(0.0)).cast("decimal(18,9)") for p in parts), F.lit(0).cast("decimal(18,9)"))
    return F.bround(total, 3).cast("double")


def score(effective: Column, strength: Column, links: Column) -> Column:
    return rounded_sum(rating_term(effective), strength, link_bonus(links))


def thousandths(c: Column) -> Column:
    return F.round(c * 1000, 0).cast("bigint")


def score_items(pairs: DataFrame, items: DataFrame, strength: DataFrame, links: DataFrame) -> DataFrame:
    """(reader_id, item_key, score) for given reader-item pairs."""
    keys = ["reader_id", "item_key"]
    rated = series.effective_rating(items).select("item_key", "effective")
    return (pairs.select(*keys).join(rated, "item_key").join(strength, keys, "left").join(links, keys, "left")
            .select(*keys, score(F.col("effective"), F.col("strength"), F.col("links")).alias("score")))


def tie_chunks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add `chunk`: a new one starts where the score drops by more than the gap.

    Scores are rounded to thousandths inside a bounded range, so the window runs over
    a few thousand distinct scores per group, never over the rows themselves."""
    per = Window.partitionBy(*keys).orderBy(F.desc("score"))
    steps = rows.select(*keys, "score").distinct()
    drop = F.lag(thousandths(F.col("score"))).over(per) - thousandths(F.col("score")) > TIE_GAP
    steps = steps.withColumn("opens", F.coalesce(drop, F.lit(False)).cast("int"))
    return steps.withColumn("chunk", F.sum("opens").over(
        per.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def mode_of(state: DataFrame, variance: str | None = None) -> DataFrame:
    """(reader_id, mode): the caller's choice, else from the reader's appetite."""
    by_appetite = F.create_map(*[F.lit(x) for kv in APPETITE_MODE.items() for x in kv])
    mode = F.lit(variance) if variance else F.coalesce(by_appetite[F.col("appetite")], F.lit("balanced"))
    return state.select("reader_id", mode.alias("mode"))


def vector_strata(overlap: DataFrame, underused: DataFrame, unit: str) -> DataFrame:
    """(reader_id, unit, stratum) for units matching an underused vector."""
    return (overlap.join(underused.select("reader_id", "vector"), ["reader_id", "vector"])
            .select("reader_id", unit, F.concat(F.lit("vector:"), "vector").alias("stratum")))


def floor_facts() -> Column:
    """What an item can count towards, as kind/name."""
    genre = F.array_distinct(F.array_compact(F.array(F.lower("primary_genre"), F.lower("secondary_genre"))))
    return F.concat(
        F.array_compact(F.array(F.when(F.col("indie"), "tag/indie"), F.when(F.col("classic"), "tag/classic"))),
        F.transform(genre, lambda g: F.concat(F.lit("genre/"), g)))


def floor_fact() -> Column:
    return F.concat_ws("/", "kind", F.lower("name"))


def floor_strata(pool: DataFrame, items: DataFrame, at_risk: DataFrame) -> DataFrame:
    """(reader_id, item_key, stratum) for pool items that help an unmet floor."""
    helped = items.select("item_key", F.explode(floor_facts()).alias("fact"))
    floors = at_risk.select("reader_id", "name", floor_fact().alias("fact"))
    wanted = pool.join(floors.select("reader_id").distinct(), "reader_id", "left_semi")
    return (wanted.select("reader_id", "item_key").join(helped, "item_key").join(floors, ["reader_id", "fact"])
            .select("reader_id", "item_key", F.concat(F.lit("floor:"), "name").alias("stratum")).distinct())


def adjacency(overlap: DataFrame, unit_tags: DataFrame, members: DataFrame, unit: str) -> DataFrame:
    """(reader_id, unit, vector, overlap, divergence, bridges_to): units central to a
    vector that also carry a tag outside it."""
    sizes = central_thresholds(members)
    central = overlap.join(sizes, ["reader_id", "vector"]).filter(F.col("overlap") >= F.col("threshold"))
    lead = top_rows(central, ["reader_id", unit], [F.desc("overlap"), F.col("ord"), F.col("vector")], 1).select(
        "reader_id", unit, "vector", "overlap")
    held = members.select("reader_id", "vector", "kind", "tag")
    outside = (lead.join(unit_tags, unit).join(held, ["reader_id", "vector", "kind", "tag"], "left_anti")
               .select("reader_id", unit, "vector", "overlap", "kind", "tag"))
    others = members.select("reader_id", F.col("vector").alias("other"), "ord", "kind", "tag")
    hits = (outside.join(others, ["reader_id", "kind", "tag"]).filter(F.col("other") != F.col("vector"))
            .groupBy("reader_id", unit).agg(F.min(F.struct("ord", "other"))["other"].alias("bridges_to")))
    return (outside.select("reader_id", unit, "vector", "overlap").distinct()
            .join(hits, ["reader_id", unit], "left")
            .withColumn("divergence", F.when(F.col("bridges_to").isNotNull(), "bridge").otherwise("new-direction")))


def central_thresholds(members: DataFrame) -> DataFrame:
    """(reader_id, vector, size, threshold): overlap at which a unit is central."""
    sizes = members.groupBy("reader_id", "vector").agg(F.count("*").alias("size"))
    half = F.ceil(F.col("size") / 2)
    return sizes.withColumn("threshold", F.greatest(F.lit(2), F.least(half, F.lit(3))).cast("bigint"))


def allocate(strata: DataFrame, n: int, lean: str | None = None, seed: int = 0) -> DataFrame:
    """strata(reader_id, mode, stratum, ord) -> the same with `slots` summing to n per
    reader.  Jitter and the focused choice come from a hash of seed, reader, stratum."""
    per = Window.partitionBy("reader_id")

    def draw(tag):
        return values.unit_hash(F.lit(str(seed)), F.lit(tag), F.col("reader_id").cast("string"), "stratum")
    is_vector = F.startswith("stratum", F.lit("vector:"))
    rows = strata.withColumn("pick", F.when((F.col("mode") == "focused") & is_vector, draw("focus")))
    weight = (F.when(F.col("pick").isNotNull() & (F.col("pick") == F.min("pick").over(per)), FOCUS_WEIGHT)
              .when((F.col("mode") == "adjacent") & F.startswith("stratum", F.lit("adjacent:")), ADJACENT_WEIGHT)
              .when(F.col("mode") == "adjacent", ADJACENT_RESIDUAL).otherwise(1.0))
    if lean and ":" in lean:
        kind, name = lean.split(":", 1)
        target = F.when((F.col("mode") == "adjacent") & F.lit(kind == "vector"), F.lit(f"adjacent:{name}")).otherwise(
            F.lit(f"{kind}:{name}") if kind in ("vector", "floor") else F.lit(""))
        weight = weight * F.when(F.col("stratum") == target, LEAN_FACTOR).otherwise(1.0)
    width = F.when(F.col("mode").isin("balanced", "broad"), 0.20).otherwise(0.10)
    rows = rows.withColumn("w", weight * ((draw("jitter") * 2 - 1) * width + 1.0))
    raw = F.col("w") / F.sum("w").over(per) * n
    rows = rows.withColumn("raw", raw).withColumn("base", F.floor("raw").cast("bigint"))
    by_rest = per.orderBy(F.desc(F.col("raw") - F.col("base")), "ord")
    short = F.lit(n) - F.sum("base").over(per)
    rows = rows.withColumn("first", F.col("base") + (F.row_number().over(by_rest) <= short).cast("bigint"))
    # Second pass: pin the residual share and spread the rest in proportion.
    quota = F.create_map(*[F.lit(x) for kv in QUOTA.items() for x in kv])[F.col("mode")]
    residual = F.col("stratum") == RESIDUAL
    has_both = F.bool_or(residual).over(per) & F.bool_or(~residual).over(per)
    target = F.least(F.lit(n), F.greatest(F.lit(1), F.bround(quota * n, 0))).cast("bigint")
    rows = rows.withColumns({"target": F.when(has_both & quota.isNotNull(), target),
                             "other": F.when(~residual, F.col("first"))})
    now = F.max(F.when(residual, F.col("first"))).over(per)
    rows = rows.withColumn("repin", F.col("target").isNotNull() & (now != F.col("target")))
    pool = F.lit(n) - F.col("target")
    share = F.when(F.sum("other").over(per) > 0,
                   F.floor(pool * F.col("other") / F.sum("other").over(per))).otherwise(0)
    rows = rows.withColumn("second", F.when(residual, F.lit(None)).otherwise(share).cast("bigint"))
    left = pool - F.sum("second").over(per)
    count = F.count("second").over(per)
    rank = F.row_number().over(per.orderBy(F.col("other").desc_nulls_last(), "ord"))
    extra = F.floor(left / count) + (rank <= left % count).cast("bigint")
    slots = (F.when(~F.col("repin"), F.col("first")).when(residual, F.col("target"))
             .otherwise(F.col("second") + extra)).cast("bigint")
    return rows.select("reader_id", "mode", "stratum", "ord", slots.alias("slots"))


def fill_reader(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """Greedy fill for one reader: at most n ranked rows per stratum come in."""
    taken: dict[str, str] = {}
    groups = [(ord_, name, part.sort_values("rank")) for (ord_, name), part in rows.groupby(["ord", "stratum"])]
    for _, name, part in sorted(groups, key=lambda g: g[0]):
        room = int(part["slots"].iloc[0])
        for key in part["item_key"]:
            if room <= 0:
                break
            if key not in taken:
                taken[key] = name
                room -= 1
    for _, name, part in sorted(groups, key=lambda g: (-int(g[2]["size"].iloc[0]), g[0])):
        for key in part["item_key"]:
            if len(taken) >= n:
                break
            taken.setdefault(key, name)
    out = rows.drop_duplicates(["item_key", "stratum"])
    return out[[taken.get(k) == s for k, s in zip(out["item_key"], out["stratum"])]]


def fill(ranked: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """ranked(reader_id, stratum, ord, slots, size, rank, item_key, score) cut to the
    sample: (reader_id, place, item_key, stratum, score).

    Walking a stratum steps only over rows that are taken or already taken, and at most
    n are taken, so its first n rows suffice.  A reader brings n rows per stratum."""
    schema = ("reader_id bigint, stratum string, ord bigint, slots bigint, size bigint, rank bigint, "
              "item_key string, score double")
    cut = ranked.filter(F.col("rank") <= n).select(
        F.col("reader_id").cast("bigint"), "stratum", F.col("ord").cast("bigint"), "slots",
        F.col("size").cast("bigint"), F.col("rank").cast("bigint"), "item_key", F.col("score").cast("double"))
    chosen = cut.groupBy("reader_id").applyInPandas(
        lambda pdf: fill_reader(pdf, n).sort_values("item_key"), schema)
    order = values.unit_hash(F.lit(str(seed)), F.lit("order"), "item_key")
    place = F.row_number().over(Window.partitionBy("reader_id").orderBy(order, "item_key"))
    return chosen.select("reader_id", place.cast("bigint").alias("place"), "item_key", "stratum", "score")


#: Tosses fall into levels by halves: level i holds those from 2^-(i + 1) to 2^-i.
_LEVELS = 40


def _level(toss: Column) -> Column:
    """The level of a toss; a bound's level is that of the greatest tosses it lets in."""
    halves = F.floor(-F.log2(F.greatest(toss, F.lit(2.0 ** -_LEVELS)))).cast("int")
    return F.least(F.greatest(halves, F.lit(0)), F.lit(_LEVELS))


class Recommender:
    """Inputs of one run, with the tables several steps share written once.

    Near-tied items come in a tossed order.  `tie_orders` is how many such orders there are
    for the items that match none of a reader's tags: readers with the same order, chosen by
    a hash, are offered the same ones of these where all else is equal.  More orders spread
    such offers further and cost one list of the open items each."""

    def __init__(self, items, tags, links, log, picks, events, vectors, members, state, floors, *,
                 today: str, n: int = 15, variance: str | None = None, lean: str | None = None,
                 seed: int = 0, genre: str | None = None, indie: bool = False, statuses: list[str] = (),
                 tie_orders: int = 16):
        # Shared inputs are written once, with their normalised names beside them.
        items = settle(identity.with_norms(items), "items")
        tags = settle(tags, "tags")
        self.items, self.tags, self.links, self.n, self.lean, self.seed = items, tags, links, n, lean, seed
        self.state, self.floors, self.today, self.tie_orders = state, floors, today, tie_orders
        self.vectors, self.members, self.variance = vectors, members, variance
        self.live = settle(reader.active_members(vectors, members), "active-members")
        # A reader without an active vector has nothing to match against.
        owners = self.live.select("reader_id").distinct()
        self.modes = mode_of(state, variance).join(owners, "reader_id", "left_semi")
        index = settle(identity.title_index(items), "title-index")
        self.picks = settle(identity.with_norms(picks), "picks")
        self.resolved = settle(identity.resolve(log, items, index), "resolved-log")
        self.log = self.resolved
        self.listed = settle(identity.resolve_picks(self.picks, items, index), "resolved-picks")
        self.excluded = settle(filters.excluded_items(self.log, self.picks, events, items, index), "excluded")
        profiles, held = filters.tag_profiles(tags)
        self.profile_tags = settle(held, "profile-tags")
        # Series baselines need every volume, so they come before the request's filters.
        facts = filters.quality_items(series.effective_rating(items), genre, indie, statuses)
        term = rating_term(F.col("effective"))
        self.quality = settle(
            facts.join(profiles, "item_key", "left")
            .select(F.monotonically_increasing_id().alias("iid"), "item_key", "profile", floor_facts().alias("facts"),
                    term.alias("term"), rounded_sum(term).alias("base"),
                    filters.open_entry().alias("open_entry")), "quality-items")

    # -- reader facts
    def gaps(self):
        coverage = reader.vector_coverage(self.listed, self.tags, self.vectors, self.members)
        under = reader.underused_vectors(coverage, self.state)
        risk = reader.floors_at_risk(self.floors, self.listed, self.items, identity.list_pairs(self.picks),
                                     self.state)
        return under, risk

    # -- tastes and cells
    def _tastes(self) -> None:
        """readers(reader_id, shape, mode, under, floors), and per shape its members, the
        cell of every profile that shares a tag, and each cell's tags."""
        per = self.live.groupBy("reader_id").agg(
            F.array_sort(F.collect_set(F.struct("vector", "ord", "kind", "tag"))).alias("taste"))
        tastes = settle(per.select("taste").distinct().withColumn("shape", F.monotonically_increasing_id()), "tastes")
        under = self.under.groupBy("reader_id").agg(F.collect_set("vector").alias("under"))
        floors = self.risk.groupBy("reader_id").agg(F.collect_set(F.struct(
            floor_fact().alias("fact"), F.concat(F.lit("floor:"), "name").alias("stratum"))).alias("floors"))
        self.readers = settle(per.join(tastes, "taste").drop("taste").join(self.modes, "reader_id", "left")
                              .join(under, "reader_id", "left").join(floors, "reader_id", "left"), "readers")
        self.shape_members = tastes.select("shape", F.explode("taste").alias("t")).select("shape", "t.*")
        held = self.profile_tags.join(self.quality.select("profile").distinct(), "profile", "left_semi")
        matched = self.shape_members.select("shape", "kind", "tag").distinct().join(held, ["kind", "tag"]).groupBy(
            "shape", "profile").agg(F.array_sort(F.collect_list(F.struct("kind", "tag"))).alias("tags"))
        self.matched = settle(matched.withColumn("cell", F.xxhash64("shape", "tags")), "shape-profiles")
        cells = self.matched.select("shape", "cell", "tags").distinct()
        self.cell_tags = settle(cells.select("shape", "cell", F.explode("tags").alias("t")).select("shape", "cell", "t.*"), "cell-tags")
        self.overlap = settle(self.shape_members.join(self.cell_tags, ["shape", "kind", "tag"]).groupBy(
            "shape", "cell", "vector", "ord").agg(F.count("*").alias("overlap")), "cell-overlap")

    def _leads(self) -> DataFrame:
        """(shape, profile, lead): the central vector of profiles that also pull outside it."""
        by_profile = self.matched.select(F.col("shape").alias("reader_id"), "profile", "cell").join(
            self.overlap.withColumnRenamed("shape", "reader_id"), ["reader_id", "cell"])
        edges = adjacency(by_profile, self.profile_tags, self.shape_members.withColumnRenamed("shape", "reader_id"), "profile")
        return edges.select(F.col("reader_id").alias("shape"), "profile", F.col("vector").alias("lead"))

    def _cells(self, groups) -> DataFrame:
        """One row per reader and cell: strength, and the strata of its underused vectors."""
        vectors = self.overlap.groupBy("shape", "cell").agg(F.collect_set("vector").alias("vectors"))
        pairs = self.readers.join(vectors, "shape")
        strength = reader.anchor_strength(pairs.select("reader_id", "cell"), self.cell_tags.select("cell", "kind", "tag"), groups, "cell")
        strata = F.transform(F.array_intersect("vectors", F.coalesce("under", F.array())), lambda v: F.concat(F.lit("vector:"), v))
        return settle(pairs.join(strength, ["reader_id", "cell"], "left").select(
            "reader_id", "shape", "cell", "mode", "floors", "strength", strata.alias("strata")), "reader-cells")

    # -- pool
    def _pool(self) -> DataFrame:
        """(reader_id, item_key, iid, score, strata): items that match a reader's tags and may
        be offered.  A stream that is counted and filtered, never written or shuffled whole."""
        closed = (self.known.join(self.readers.select("reader_id", "shape"), "reader_id")
                  .join(self.quality.select("iid", "item_key", "profile", "term", "facts"), "iid")
                  .join(self.near_profiles, ["shape", "profile"])
                  .join(self.cells.drop("shape"), ["reader_id", "cell"]))
        columns = ["reader_id", "iid", "item_key", "term", "facts", "lead", "mode", "floors", "strength", "strata"]
        rows = self.cells.join(self.near_open.drop("base"), ["shape", "cell"]).select(*columns).unionByName(closed.select(*columns))
        rows = rows.join(self.barred, ["reader_id", "iid"], "left_anti").join(self.linked, ["reader_id", "iid"], "left")
        # Most items help no floor; only those that do are looked at one floor at a time.
        helps = F.arrays_overlap(F.coalesce(F.col("floors.fact"), F.array().cast("array<string>")), "facts")
        floors = F.transform(F.filter("floors", lambda f: F.array_contains("facts", f["fact"])), lambda f: f["stratum"])
        usual = F.when(helps, F.array_distinct(F.concat("strata", floors))).when(F.size("strata") > 0, F.col("strata")).otherwise(
            F.array(F.lit(RESIDUAL)))
        edge = F.when(F.col("lead").isNotNull(), F.array(F.concat(F.lit("adjacent:"), "lead"))).otherwise(F.array().cast("array<string>"))
        return rows.select("reader_id", "iid", "item_key",
                           rounded_sum(F.col("term"), F.col("strength"), link_bonus(F.col("links"))).alias("score"),
                           F.when(F.col("mode") == "adjacent", edge).otherwise(usual).alias("strata"))

    def _prepare(self) -> tuple[DataFrame, DataFrame]:
        """What the pool is made of, written; and the anchors and liked links."""
        under, risk = self.gaps()
        self.under, self.risk = settle(under, "underused"), settle(risk, "at-risk")
        self._tastes()
        _, anchor_tags = reader.anchors(self.resolved, self.tags, self.live.select(
            "reader_id", "kind", "tag").distinct(), self.today)
        anchor_tags = settle(anchor_tags, "anchors")
        self.cells = self._cells(settle(reader.anchor_groups(anchor_tags), "anchor-groups"))
        # Only items that may be offered matter, and a known author only where it opens one.
        names = self.quality.select("item_key", "iid", "open_entry")
        liked_links = settle(reader.link_overlap(self.links.join(names.withColumnRenamed("item_key", "src_key"), "src_key", "left_semi"),
                                                 reader.favourites(self.resolved)), "liked-links")
        closed = self.items.join(names.filter("not open_entry"), "item_key", "left_semi")
        self.linked = settle(liked_links.join(names, "item_key").select("reader_id", "iid", "links", "open_entry"), "links-of-items").drop("open_entry")
        self.barred = settle(self.excluded.join(names, "item_key").select("reader_id", "iid"), "barred")
        self.known = settle(filters.known_author_items(self.log, closed).join(names, "item_key").select("reader_id", "iid").distinct(),
                            "known-authors")
        leads = self._leads() if self.variance == "adjacent" else self.matched.select(
            "shape", "profile", F.lit(None).cast("string").alias("lead")).limit(0)
        self.near_profiles = self.matched.select("shape", "profile", "cell").join(leads, ["shape", "profile"], "left")
        self.near_open = settle(self.near_profiles.join(self.quality.filter("open_entry").drop("open_entry"), "profile").drop("profile"),
                                "shape-items")
        return anchor_tags, liked_links

    def strata(self) -> DataFrame:
        """(reader_id, item_key, stratum, score, chunk) of the whole matching pool: every item
        that a reader's tags match and that may be offered, in each of its strata."""
        self._prepare()
        rows = self._pool().select("reader_id", "item_key", "score", F.explode("strata").alias("stratum"))
        by = ["reader_id", "stratum"]
        return rows.join(tie_chunks(rows, by), [*by, "score"]).select(*by, "item_key", "score", "chunk")

    def run(self) -> dict[str, DataFrame]:
        n, keys = self.n, ["reader_id", "item_key"]
        anchor_tags, liked_links = self._prepare()
        pool = self._pool()
        at = F.posexplode_outer("strata").alias("at", "stratum")
        tally = settle(pool.select("reader_id", "score", at).groupBy("reader_id", "stratum", "score").agg(
            F.count("*").alias("c"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("items")), "score-counts")
        wide = self.readers.filter(F.col("mode").isin("balanced", "broad")).select("reader_id", "shape")
        explicit, implicit = self._forced(wide)
        residual = F.lit(RESIDUAL).alias("stratum")
        counts = (tally.filter("stratum is not null").select("reader_id", "stratum", "score", "c")
                  .unionByName(explicit.select("reader_id", residual, "score", F.lit(1).cast("bigint").alias("c")))
                  .unionByName(implicit.select("reader_id", residual, F.col("base").alias("score"), F.col("left").alias("c"))))
        chunks, sizes = self._chunks(counts)
        placed = pool.select("reader_id", "iid", "item_key", "score", F.explode("strata").alias("stratum")).unionByName(
            explicit.withColumn("stratum", F.lit(RESIDUAL)))
        ranked = self._rank(placed, chunks, wide, implicit)
        slots = self._slots(sizes, self.under, self.risk)
        chosen = fill(ranked.join(sizes, ["reader_id", "stratum"]).join(slots, ["reader_id", "stratum"]), n, self.seed)
        totals = tally.groupBy("reader_id").agg(F.sum("items").alias("c")).unionByName(
            explicit.groupBy("reader_id").agg(F.count("*").alias("c"))).unionByName(
                implicit.groupBy("reader_id").agg(F.sum("left").alias("c")))
        pool_size = totals.groupBy("reader_id").agg(F.sum("c").alias("pool_size"))
        return {"chosen": chosen, "pool_size": pool_size, "slots": slots, "placed": placed.select(*keys, "stratum", "score"),
                "sizes": sizes, "underused": self.under, "at_risk": self.risk,
                "liked_links": liked_links, "anchor_tags": anchor_tags}

    def _forced(self, wide) -> tuple[DataFrame, DataFrame]:
        """Quality items near none of a reader's tags.

        Returns the rows that need naming (liked links, or open only because the author
        is known) and, per score, how many of the others there are."""
        by = ["reader_id", "iid"]
        facts = self.quality.select("iid", "item_key", "profile", "term", "open_entry")
        offered = (self.linked.withColumn("link", F.lit(True)).join(self.known.withColumn("author", F.lit(True)), by, "full")
                   .join(wide, "reader_id").join(facts, "iid")
                   .join(self.matched.select("shape", "profile"), ["shape", "profile"], "left_anti")
                   .join(self.barred, by, "left_anti"))
        named = offered.filter(F.col("open_entry") | F.coalesce("author", F.lit(False)))
        explicit = settle(named.select("reader_id", "iid", "item_key", rounded_sum(F.col("term"), link_bonus(F.col("links"))).alias("score")),
                          "forced-named")
        # Per taste what is left of each score; at most 2,001 scores: the term is clamped to
        # +-1 and rounded to thousandths.
        held = self.quality.filter("open_entry").groupBy("base").agg(F.count("*").alias("held"))
        near = self.near_open.groupBy("shape", "base").agg(F.count("*").alias("near"))
        shapes = wide.select("shape").distinct()
        left = F.col("held") - F.coalesce("near", F.lit(0))
        scale = F.broadcast(held.agg(F.collect_list(F.struct("base", "held")).alias("scale")))
        far = (shapes.join(scale).select("shape", F.inline("scale")).join(near, ["shape", "base"], "left")
               .select("shape", "base", left.alias("far")).filter("far > 0"))
        # A reader's own open items among these: excluded ones and liked links.
        own = (self.barred.unionByName(self.linked.select(*by)).distinct().join(wide, "reader_id")
               .join(self.quality.filter("open_entry").select("iid", "profile", "base"), "iid"))
        self.own_far = settle(own.join(self.matched.select("shape", "profile"), ["shape", "profile"], "left_anti").select(
            *by, "base"), "own-far")
        gone = self.own_far.groupBy("reader_id", "base").agg(F.count("*").alias("gone"))
        implicit = (wide.join(far, "shape").join(gone, ["reader_id", "base"], "left")
                    .select("reader_id", "base", (F.col("far") - F.coalesce("gone", F.lit(0))).alias("left")).filter("left > 0"))
        return explicit, settle(implicit, "implicit-counts")

    def _chunks(self, counts) -> tuple[DataFrame, DataFrame]:
        """The chunks that the sample can reach: (reader_id, stratum, chunk, low, high, c, need,
        below), `below` being the toss under which enough of its rows lie, all but surely; and
        the sizes of all strata."""
        n, by = self.n, ["reader_id", "stratum"]
        # One shuffle by reader and stratum serves the sums, the gaps and the chunks.
        scores = counts.repartition(*by).groupBy(*by, "score").agg(F.sum("c").alias("c"))
        down = Window.partitionBy(*by).orderBy(F.desc("score"))
        drop = F.lag(thousandths(F.col("score"))).over(down) - thousandths(F.col("score")) > TIE_GAP
        steps = scores.withColumn("opens", F.coalesce(drop, F.lit(False)).cast("int")).withColumn(
            "chunk", F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        per = settle(steps.groupBy(*by, "chunk").agg(
            F.sum("c").alias("c"), F.min("score").alias("low"), F.max("score").alias("high")), "all-chunks")
        sizes = settle(per.groupBy(*by).agg(F.sum("c").alias("size")), "sizes")
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("chunk").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        need = F.least(F.lit(n) - F.col("before"), F.col("c"))
        below = F.least(F.lit(1.0), (4 * F.col("need") + 40) / F.col("c"))
        reached = per.withColumn("before", before).filter(F.col("before") < n).withColumn("need", need)
        return settle(reached.withColumn("below", below).drop("before"), "chunks"), sizes

    def _rank(self, placed, chunks, wide, implicit) -> DataFrame:
        """(reader_id, stratum, item_key, score, rank): the first n rows of each stratum."""
        by = ["reader_id", "stratum"]
        lists = settle(self._lists(), "toss-lists")
        found = settle(self._candidates(placed, chunks, wide, implicit, lists), "candidates")
        got = found.groupBy(*by, "chunk").agg(F.count("*").alias("got"))
        short = settle(chunks.join(got, [*by, "chunk"], "left").filter(F.coalesce("got", F.lit(0)) < F.col("need")).drop("got")
                       .withColumn("below", F.lit(1.0)), "short")
        if not short.isEmpty():
            again = self._candidates(placed, short, wide, implicit, lists)
            found = settle(found.join(short, [*by, "chunk"], "left_anti").unionByName(again), "candidates-again")
        top = top_rows(found, by, [F.col("chunk"), F.col("toss"), F.col("item_key")], self.n)
        return top.select(*by, "item_key", "score", F.col("_rn").alias("rank"))

    def _candidates(self, placed, chunks, wide, implicit, lists) -> DataFrame:
        """Rows of the given chunks whose toss lies below the chunk's bound."""
        by, out = ["reader_id", "stratum"], ["reader_id", "stratum", "item_key", "score", "chunk", "toss"]
        spans = chunks.select(*by, "chunk", "low", "high", "below")
        named = (placed.join(spans, by).filter(F.col("score").between(F.col("low"), F.col("high")))
                 .withColumn("toss", self._toss(self.draw(), F.col("stratum")))
                 .filter(F.col("toss") <= F.col("below")).select(*out))
        residual = (chunks.filter(F.col("stratum") == RESIDUAL).join(wide, "reader_id").withColumn("draw", self.draw())
                    .select("reader_id", "shape", "draw", "chunk", "low", "high", "below"))
        # Few rows of a chunk are asked for: by the level of their toss.  All: by their scores.
        some = residual.filter("below < 1").withColumn("level", F.explode(F.sequence(_level(F.col("below")), F.lit(_LEVELS))))
        some = some.join(lists, ["draw", "level"]).filter(F.col("base").between(F.col("low"), F.col("high")) & (F.col("toss") <= F.col("below")))
        every = (residual.filter("below >= 1").join(implicit, "reader_id").filter(F.col("base").between(F.col("low"), F.col("high")))
                 .join(lists, ["draw", "base"]))
        columns = ["reader_id", "shape", "iid", "item_key", "profile", "base", "chunk", "toss"]
        forced = (some.select(*columns).unionByName(every.select(*columns))
                  .join(self.matched.select("shape", "profile"), ["shape", "profile"], "left_anti")
                  .join(self.own_far.select("reader_id", "iid"), ["reader_id", "iid"], "left_anti")
                  .select("reader_id", F.lit(RESIDUAL).alias("stratum"), "item_key", F.col("base").alias("score"), "chunk", "toss"))
        return named.unionByName(forced)

    def _toss(self, draw: Column, stratum: Column) -> Column:
        return values.unit_hash(F.lit(str(self.seed)), draw, stratum, "item_key")

    def _lists(self) -> DataFrame:
        """(draw, level, iid, item_key, profile, base, toss): open items in each tie order."""
        rows = (self.quality.filter("open_entry").select("iid", "item_key", "profile", "base")
                .withColumn("draw", F.explode(F.array(*[F.lit(str(d)) for d in range(self.tie_orders)])))
                .withColumn("toss", self._toss(F.col("draw"), F.lit(RESIDUAL))))
        return rows.withColumn("level", _level(F.col("toss")))

    def draw(self) -> Column:
        """Which of the tie orders a reader has."""
        u = values.unit_hash(F.lit(str(self.seed)), F.lit("order of ties"), F.col("reader_id").cast("string"))
        return F.floor(u * self.tie_orders).cast("string")

    def _slots(self, sizes, under, risk) -> DataFrame:
        """Slots of the non-empty strata, in the order vectors, floors, residual."""
        vectors = under.select("reader_id", F.concat(F.lit("vector:"), "vector").alias("stratum"),
                               F.col("ord").alias("o"))
        edges = self.live.select("reader_id", F.concat(F.lit("adjacent:"), "vector").alias("stratum"),
                                 F.col("ord").alias("o")).distinct()
        floors = risk.select("reader_id", F.concat(F.lit("floor:"), "name").alias("stratum"),
                             F.when(F.col("name") == "indie", 1000).when(F.col("name") == "classic", 1001)
                             .otherwise(1002).cast("bigint").alias("o")).distinct()
        known = vectors.unionByName(edges).unionByName(floors)
        named = (sizes.join(self.modes, "reader_id").join(known, ["reader_id", "stratum"], "left")
                 .withColumn("o", F.when(F.col("stratum") == RESIDUAL, 1 << 40).otherwise(F.col("o"))))
        order = F.row_number().over(Window.partitionBy("reader_id").orderBy("o", "stratum"))
        return allocate(named.select("reader_id", "mode", "stratum", order.cast("bigint").alias("ord")),
                        self.n, self.lean, self.seed)


def projection(rec: Recommender, out: dict[str, DataFrame], notes: DataFrame | None = None,
               negatives: DataFrame | None = None) -> DataFrame:
    """The chosen items with the reasons for each: matched vectors and themes, gaps filled,
    links liked, the heaviest liked reads they share a tag with (`resonance`), how they
    reach beyond their vector (`divergence`, `bridges_to`), warnings and cold tags; and for
    the reader the mode, the size of each stratum's share and the pool."""
    keys = ["reader_id", "item_key"]
    chosen = settle(out["chosen"], "chosen")
    overlap = reader.vector_overlap(chosen, rec.tags, rec.live)
    matched = reader.matched_vectors(overlap).withColumnRenamed("vectors", "matched_vectors")
    under = out["underused"].select("reader_id", "vector")
    fills = (overlap.join(under, ["reader_id", "vector"]).groupBy(*keys)
             .agg(F.array_sort(F.collect_list(F.struct("ord", "vector")))["vector"].alias("fills_vectors")))
    floors = (floor_strata(chosen, rec.items, out["at_risk"]).groupBy(*keys)
              .agg(F.array_sort(F.collect_list(F.substring("stratum", 7, 1 << 30))).alias("fills_floors")))
    themes = (chosen.join(positive_tags(rec.tags).filter("kind = 'theme'"), "item_key").groupBy(*keys)
              .agg(F.array_sort(F.collect_list("tag")).alias("matched_themes")))
    facts = rec.items.select("item_key", "title", "author", "pages", "primary_genre", "indie", "classic",
                             "series", "series_position")
    resonance = reader.matched_anchors(chosen, positive_tags(rec.tags), out["anchor_tags"], rec.items).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("place", "title")))["title"].alias("resonance"))
    beyond = adjacency(overlap, positive_tags(rec.tags), rec.live, "item_key").select(*keys, "divergence", "bridges_to")
    share = chosen.groupBy("reader_id", "stratum").agg(F.count("*").alias("stratum_count"))
    chosen = (chosen.join(share, ["reader_id", "stratum"]).join(rec.modes, "reader_id")
              .join(out["pool_size"], "reader_id"))
    rows = (chosen.join(facts, "item_key").join(matched, keys, "left").join(fills, keys, "left")
            .join(resonance, keys, "left").join(beyond, keys, "left")
            .join(floors, keys, "left").join(themes, keys, "left").join(out["liked_links"], keys, "left")
            .withColumn("is_residual", F.col("matched_vectors").isNull()))
    if notes is not None:
        found = filters.warnings(chosen, notes, rec.items).groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("n", "warning")))["warning"].alias("warnings"))
        rows = rows.join(found, keys, "left")
    if negatives is not None:
        rows = rows.join(filters.negative_flags(chosen, rec.tags, negatives), keys, "left")
    return rows
