"""Do a reader's taste vectors predict the reader's ratings?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.operators import identity, reader
from bookloom.operators.common import half_even, positive_tags, settle, top_rows
from bookloom.plans.recommend import central_thresholds


@dataclass(frozen=True)
class Limits:
    min_members: int = 5
    weak_margin: float = 0.05
    neg_support: int = 4
    neg_margin: float = 0.5
    max_neg: int = 5
    broad_share: float = 0.33
    overlap: float = 0.40
    rebuild_floor: float = 0.0
    underperf_margin: float = 0.5


def core_tags(examples: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    """(reader_id, vector, kind, tag) from example titles: tags of two or more examples,
    or every tag when none repeats.  Signals and themes are judged apart."""
    found = examples.join(identity.resolve_titles(examples, items), "title")
    counts = (found.select("reader_id", "vector", "pos", "item_key").join(positive_tags(tags), "item_key")
              .groupBy("reader_id", "vector", "kind", "tag").agg(F.count("*").alias("n")))
    most = counts.groupBy("reader_id", "vector", "kind").agg(F.max("n").alias("most"))
    return (counts.join(most, ["reader_id", "vector", "kind"])
            .filter((F.col("n") >= 2) | (F.col("most") < 2)).select("reader_id", "vector", "kind", "tag"))


def bootstrap(examples: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    """examples(doc_id, vector_no, vector, status, title, author) -> per vector its tags,
    the union over resolved examples; demoted vectors and those without tags are left out."""
    live = examples.filter((F.col("status") != "demoted") & F.col("title").isNotNull())
    found = settle(identity.resolve(live, items), "bootstrap-examples")
    held = (found.filter("item_key is not null").join(positive_tags(tags), "item_key")
            .groupBy("doc_id", "vector_no", "vector")
            .agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "signal", F.col("tag")))).alias("signals"),
                 F.array_sort(F.collect_set(F.when(F.col("kind") == "theme", F.col("tag")))).alias("themes")))
    missed = found.groupBy("doc_id", "vector_no").agg(F.count_if(F.col("item_key").isNull()).alias("unresolved"))
    return held.join(missed, ["doc_id", "vector_no"])


class Calibration:
    """Shared tables of one calibration run; each method is one report."""

    def __init__(self, resolved_log: DataFrame, items: DataFrame, tags: DataFrame, vectors: DataFrame,
                 members: DataFrame, examples: DataFrame | None = None, limits: Limits = Limits()):
        self.limits = limits
        reads = resolved_log.filter((F.col("rating") != 0) & F.col("item_key").isNotNull())
        self.reads = settle(reads.groupBy("reader_id", "item_key", "rating").agg(F.count("*").alias("n")), "reads")
        live = reader.active_members(vectors, members)
        if examples is not None:
            names = vectors.filter(reader.is_active()).select("reader_id", "vector", "ord")
            empty = names.join(live.select("reader_id", "vector").distinct(), ["reader_id", "vector"], "left_anti")
            derived = core_tags(examples.join(empty, ["reader_id", "vector"], "left_semi"), items, tags)
            live = live.unionByName(derived.join(names, ["reader_id", "vector"]))
        self.live = settle(live, "calibrated-members")
        self.names = vectors.filter(reader.is_active()).select("reader_id", "vector", "ord")
        self.sizes = settle(central_thresholds(self.live), "thresholds")
        self.tags, self.items = tags, items
        pairs = self.reads.select("reader_id", "item_key").distinct()
        overlap = reader.vector_overlap(pairs, tags, self.live).join(self.sizes, ["reader_id", "vector"])
        self.central = settle(overlap.filter(F.col("overlap") >= F.col("threshold"))
                              .select("reader_id", "item_key", "vector", "ord"), "central")
        # An item read k times adds k per vector: counts are kept by item, rows by read.
        rows = self.reads.groupBy("reader_id", "item_key").agg(F.sum("n").alias("rows"))
        per_item = self.central.groupBy("reader_id", "item_key").agg(F.count("*").alias("v"))
        counts = rows.join(per_item, ["reader_id", "item_key"], "left")
        self.scored = settle(self.reads.join(counts.select(
            "reader_id", "item_key", (F.coalesce("v", F.lit(0)) * F.col("rows")).alias("central")),
            ["reader_id", "item_key"]), "scored-reads")

    def baseline(self) -> DataFrame:
        """(reader_id, n, mean, stdev, share_high) over rated reads, population deviation."""
        n, r = F.col("n"), F.col("rating")
        sums = self.reads.groupBy("reader_id").agg(
            F.sum("n").alias("n_reads"), (F.sum(n * r) / F.sum(n)).alias("mean"),
            (F.sum(n * r * r) / F.sum(n)).alias("sq"),
            (F.sum(F.when(r >= 4.0, n).otherwise(0)) / F.sum(n)).alias("share_high"))
        spread = F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
        return sums.filter(F.col("n_reads") >= self.limits.min_members).withColumn("stdev", spread).drop("sq")

    def separation(self) -> DataFrame:
        """(reader_id, threads, n, mean): mean rating of reads on 0, 1 and 2+ vectors."""
        by = self.scored.groupBy("reader_id", F.least("central", F.lit(2)).cast("bigint").alias("threads"))
        return by.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("rating")) / F.sum("n")).alias("mean"))

    def references(self) -> DataFrame:
        """(reader_id, baseline, ref, matched): what vectors and books are judged against."""
        def part(on):
            n = F.sum(F.when(on, F.col("n")).otherwise(0))
            return n, F.sum(F.when(on, F.col("n") * F.col("rating")).otherwise(0)) / F.nullif(n, F.lit(0))
        alone, alone_mean = part(F.col("central") == 0)
        _, matched_mean = part(F.col("central") > 0)
        rows = self.scored.groupBy("reader_id").agg(alone.alias("n0"), alone_mean.alias("m0"), matched_mean.alias("m1"))
        return rows.join(self.baseline(), "reader_id").select(
            "reader_id", "n_reads", F.col("mean").alias("baseline"),
            F.when(F.col("n0") >= self.limits.min_members, F.col("m0")).otherwise(F.col("mean")).alias("ref"),
            F.coalesce("m1", "mean").alias("matched"))

    def negatives(self) -> DataFrame:
        """Tags that run cold for a reader, all that qualify, with severity and reasons."""
        lim = self.limits
        held = self.scored.join(positive_tags(self.tags), "item_key")
        hit = F.col("central") >= 1
        n_hit = F.sum(F.when(hit, F.col("n")).otherwise(0))
        by = held.groupBy("reader_id", "kind", "tag").agg(
            F.sum("n").alias("support"), (F.sum(F.col("n") * F.col("rating")) / F.sum("n")).alias("mean"),
            n_hit.alias("expected"),
            (F.sum(F.when(hit, F.col("n") * F.col("rating")).otherwise(0)) / F.nullif(n_hit, F.lit(0))).alias("mean_expected"))
        rows = by.filter(F.col("support") >= lim.neg_support).join(self.references(), "reader_id")
        low = F.col("mean") <= F.col("baseline") - lim.neg_margin
        drags = (F.coalesce(F.col("mean_expected") <= F.col("matched") - lim.neg_margin, F.lit(False))
                 & (F.col("expected") >= lim.neg_support))
        drop = F.greatest(F.col("baseline") - F.col("mean"),
                          F.coalesce(F.col("matched") - F.col("mean_expected"), F.lit(0.0)))
        return rows.filter(low | drags).select(
            "reader_id", "kind", "tag", "support", "expected", "mean", "mean_expected", "baseline",
            low.alias("low_rated"), drags.alias("drags"), half_even(F.round(drop, 9), 4).alias("severity"))

    def top_negatives(self) -> DataFrame:
        """The worst few per reader, each with its three lowest reads."""
        cold = settle(self.negatives(), "negatives")
        top = top_rows(cold, ["reader_id"], [F.desc("severity"), F.col("kind"), F.col("tag")],
                       self.limits.max_neg).drop("_rn")
        carriers = (top.select("reader_id", "kind", "tag").join(self.scored, "reader_id")
                    .join(positive_tags(self.tags), ["item_key", "kind", "tag"]))
        # Copies of one read are equal examples: repeat at most three of them.
        copies = carriers.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(3)))))
        worst = top_rows(copies, ["reader_id", "kind", "tag"],
                         [F.col("rating"), F.desc("central"), F.col("item_key"), F.col("copy")], 3)
        shown = worst.groupBy("reader_id", "kind", "tag").agg(F.array_join(
            F.array_sort(F.collect_list(F.struct("_rn", "item_key")))["item_key"], "|").alias("examples"))
        rests = (top.select("reader_id", "kind", "tag").join(self.live, ["reader_id", "kind", "tag"])
                 .groupBy("reader_id", "kind", "tag").agg(F.array_join(
                     F.array_sort(F.collect_list(F.struct("ord", "vector")))["vector"], "|").alias("rests_in")))
        keys = ["reader_id", "kind", "tag"]
        return top.join(shown, keys).join(rests, keys, "left").fillna("", ["rests_in"])

    def redundant(self) -> DataFrame:
        """(reader_id, a, b, shared, jaccard) of vectors whose central reads coincide.

        Pairs are formed inside one read only, so by the few vectors it is central to."""
        sets = self.central.groupBy("reader_id", "vector", "ord").agg(F.count("*").alias("size"))
        per_read = self.central.groupBy("reader_id", "item_key").agg(
            F.array_sort(F.collect_list(F.struct("ord", "vector"))).alias("vs")).filter(F.size("vs") > 1)
        first = per_read.select("reader_id", "vs", F.posexplode("vs").alias("i", "x"))
        pairs = first.select("reader_id", F.col("x.vector").alias("a"), F.explode(
            F.slice("vs", F.col("i") + 2, F.size("vs"))).alias("y")).select("reader_id", "a", F.col("y.vector").alias("b"))
        shared = pairs.groupBy("reader_id", "a", "b").agg(F.count("*").alias("shared"))
        size = sets.select("reader_id", "vector", "size")
        both = (shared.join(size.select("reader_id", F.col("vector").alias("a"), F.col("size").alias("sa")), ["reader_id", "a"])
                .join(size.select("reader_id", F.col("vector").alias("b"), F.col("size").alias("sb")), ["reader_id", "b"]))
        j = F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))
        return both.withColumn("jaccard", j).filter(F.col("jaccard") >= self.limits.overlap).select(
            "reader_id", "a", "b", "shared", "jaccard")

    def underperformers(self, limit: int = 6) -> DataFrame:
        """Reads the vectors expected to land that rated well below the matched mean."""
        low = (self.scored.filter(F.col("central") >= 1).join(self.references(), "reader_id")
               .filter(F.col("rating") <= F.col("matched") - self.limits.underperf_margin))
        rows = low.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(limit)))))
        return top_rows(rows, ["reader_id"], [F.col("rating"), F.desc("central"), F.col("item_key"), F.col("copy")],
                        limit).select("reader_id", F.col("_rn").cast("bigint").alias("rank"), "item_key", "rating", "central")

    def verdicts(self) -> DataFrame:
        """One row per vector: its numbers, verdict, action and reasons."""
        lim = self.limits
        members = (self.central.join(self.reads, ["reader_id", "item_key"]).groupBy("reader_id", "vector")
                   .agg(F.sum("n").alias("n_central"), (F.sum(F.col("n") * F.col("rating")) / F.sum("n")).alias("mean")))
        cold = (self.negatives().select("reader_id", "kind", "tag").join(self.live, ["reader_id", "kind", "tag"])
                .select("reader_id", "vector").distinct().withColumn("cold", F.lit(True)))
        pairs = self.redundant()
        twin = (pairs.select("reader_id", F.explode(F.array("a", "b")).alias("vector")).distinct()
                .withColumn("twin", F.lit(True)))
        keys = ["reader_id", "vector"]
        rows = (self.names.join(self.references(), "reader_id").join(self.sizes, keys, "left")
                .join(members, keys, "left").join(cold, keys, "left").join(twin, keys, "left")
                .fillna(0, ["n_central", "size"]).fillna(2, ["threshold"]).fillna(False, ["cold", "twin"]))
        lift, breadth = F.col("mean") - F.col("ref"), F.col("n_central") / F.col("n_reads")
        thin = F.col("n_central") < lim.min_members
        verdict = F.when(thin, "thin").when(lift > lim.weak_margin, "holds").otherwise("weak")
        bad = F.array_compact(F.array(F.when(lift <= lim.rebuild_floor, "actively negative"),
                                      F.when(F.col("cold"), "rests on a cold tag")))
        soft = F.array_compact(F.array(F.when(verdict == "weak", "slight lift"),
                                       F.when(breadth >= lim.broad_share, "broad"),
                                       F.when(F.col("twin"), "merge candidate")))
        reasons = F.when(thin, F.array(F.lit("too few central reads"))).when(F.size(bad) > 0, bad).otherwise(soft)
        action = (F.when(thin, "keep").when(F.size(bad) > 0, "rebuild").when(F.size(soft) > 0, "discuss").otherwise("keep"))
        return rows.select("reader_id", "vector", "size", "threshold", "n_central", half_even(breadth, 3).alias("breadth"),
                           (breadth >= lim.broad_share).alias("too_broad"),
                           F.when(~thin, half_even(F.col("mean"), 3)).alias("mean"),
                           F.when(~thin, half_even(lift, 3)).alias("lift"), verdict.alias("verdict"),
                           action.alias("action"), F.array_join(reasons, "; ").alias("reasons"))
