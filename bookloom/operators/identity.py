"""Which catalogue item is this title and author?

Every join blocks on a title key plus one author word.  Matching authors always
share a word, or are equal, so blocking loses nothing; and because one side of
each block emits only its longest word, a common first name does not multiply
rows.  Copies of a title by one author collapse to the best copy before any
candidate row is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions import text
from bookloom.operators.common import best, settle, top_rows


def title_index(items: DataFrame) -> DataFrame:
    """(pass, key, author_norm, item_key, reviews): pass 1 holds full and pre-colon
    titles, pass 2 their American spelling."""
    base = with_norms(items).select(
        "item_key", F.coalesce("reviews", F.lit(0)).cast("bigint").alias("reviews"), "author_norm",
        F.col("title_norm").alias("f"), text.title_short("title").alias("s"))
    keys = F.array_distinct(F.array(
        F.struct(F.lit(1).alias("pass"), F.col("f").alias("key")),
        F.struct(F.lit(1).alias("pass"), F.col("s").alias("key")),
        F.struct(F.lit(2).alias("pass"), text.title_fold(F.col("f")).alias("key")),
        F.struct(F.lit(2).alias("pass"), text.title_fold(F.col("s")).alias("key"))))
    return (base.select("item_key", "reviews", "author_norm", F.explode(keys).alias("k"))
            .select(F.col("k.pass").alias("pass"), F.col("k.key").alias("key"),
                    "author_norm", "item_key", "reviews")
            .filter(F.col("key") != ""))


def _champions(index: DataFrame) -> DataFrame:
    """Most-reviewed item per title key and author: no other copy can win."""
    return best(index.withColumn("neg", -F.col("reviews")), ["pass", "key", "author_norm"],
                [F.col("neg"), F.col("item_key")], ["item_key", "reviews"])


def _blocks(author: Column, asking: bool) -> Column:
    """Author words to join on: (a) asked words inside an item's author, (b) the
    reverse, (c) a surname shared by two author lists."""
    words = text.author_tokens(author)
    longest = F.slice(F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(
        F.length(w).alias("n"), w.alias("w"))))), 1, 1)["w"]
    one, many = ("a", "b") if asking else ("b", "a")
    return F.concat(F.transform(longest, lambda w: F.concat(F.lit(one), w)),
                    F.transform(words, lambda w: F.concat(F.lit(many), w)),
                    F.transform(text.list_surnames(author), lambda w: F.concat(F.lit("c"), w)))


def _candidates(asked: DataFrame, champions: DataFrame, folded_only: bool = False) -> DataFrame:
    """Author-checked pairs of asked (title_norm, author_norm) and title-key entries."""
    plain = F.struct(F.lit(1).alias("pass"), F.col("title_norm").alias("key"))
    folded = F.struct(F.lit(2).alias("pass"), text.title_fold(F.col("title_norm")).alias("key"))
    both = F.array(folded) if folded_only else F.array(plain, folded)
    left = (asked.select("title_norm", F.col("author_norm").alias("asked_author"),
                         F.explode(both).alias("k"))
            .select("title_norm", "asked_author", "k.*",
                    F.explode(F.array_distinct(_blocks(F.col("asked_author"), True))).alias("block")))
    right = champions.withColumn(
        "block", F.explode(F.array_distinct(_blocks(F.col("author_norm"), False))))
    return (left.join(right, ["pass", "key", "block"])
            .filter(text.authors_match(F.col("asked_author"), F.col("author_norm"))))


def resolve_pairs(pairs: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(title_norm, author_norm, item_key) for each distinct pair that resolves.
    Exact title beats folded title, exact author beats tolerant, then reviews.

    `index` is title_index(items), for callers that resolve several inputs."""
    champions = settle(_champions(index if index is not None else title_index(items)), "title-champions")
    asked = pairs.select("title_norm", "author_norm").filter(F.col("title_norm") != "").distinct()
    # The distinct pairs are few next to the rows they come from; writing them keeps the
    # log from being scanned again for the tolerant pass.
    tried = settle(asked.join(champions.filter(F.col("pass") == 1)
                              .select(F.col("key").alias("title_norm"), "author_norm", "item_key"),
                              ["title_norm", "author_norm"], "left"), "asked-pairs")
    exact = tried.filter(F.col("item_key").isNotNull())
    rest = tried.filter(F.col("item_key").isNull()).drop("item_key")
    cand = _candidates(rest, champions).withColumn(
        "differs", F.col("asked_author") != F.col("author_norm"))
    tolerant = best(cand.withColumn("neg", -F.col("reviews")), ["title_norm", "asked_author"],
                    [F.col("pass"), F.col("differs"), F.col("neg"), F.col("item_key")], ["item_key"])
    return exact.unionByName(tolerant.withColumnRenamed("asked_author", "author_norm"))


def with_norms(df: DataFrame) -> DataFrame:
    """Add title_norm and author_norm, unless the rows carry them already."""
    if {"title_norm", "author_norm"} <= set(df.columns):
        return df
    return df.withColumns({"title_norm": text.norm("title"), "author_norm": text.norm("author")})


def resolve(df: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Add title_norm, author_norm and item_key (null if unknown) to rows with a
    title and author.  Each distinct pair is resolved once and joined back."""
    named, norms = df.drop("item_key"), ["title_norm", "author_norm"]
    if set(norms) <= set(named.columns):
        return named.join(resolve_pairs(named, items, index), norms, "left")
    # Each spelling is normalised once, not each row and again to join it back.
    spelled = settle(with_norms(named.select("title", "author").distinct()), "spellings")
    # Written, so that what is shuffled to find the items is gone before the rows are.
    found = settle(spelled.join(resolve_pairs(spelled, items, index), norms, "left").select(
        *norms, F.col("title").alias("_t"), F.col("author").alias("_a"), "item_key"), "resolved-spellings")
    same = F.col("title").eqNullSafe(F.col("_t")) & F.col("author").eqNullSafe(F.col("_a"))
    kept = [c for c in named.columns if c not in norms]
    return named.drop(*norms).join(found, same, "left").select(*norms, *kept, "item_key")


def matching_items(pairs: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Every item that tolerantly matches each distinct pair (no best pick)."""
    index = index if index is not None else settle(title_index(items), "title-index")
    asked = pairs.select("title_norm", "author_norm").filter(F.col("title_norm") != "").distinct()
    # Equal titles have equal folded ones, so the second pass finds all that the first would.
    index = index.filter(F.col("pass") == 2)
    entries = (_candidates(asked, _champions(index), folded_only=True)
               .select("title_norm", "asked_author", "pass", "key", "author_norm").distinct())
    members = index.select("pass", "key", "author_norm", "item_key")
    return (entries.join(members, ["pass", "key", "author_norm"])
            .select("title_norm", F.col("asked_author").alias("author_norm"), "item_key").distinct())


def listed_items(picks: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(reader_id, item_key) of items already on a reader's list, tolerantly."""
    norms = ["title_norm", "author_norm"]
    if set(norms) <= set(picks.columns):
        named = picks.select("reader_id", *norms).distinct()
        return named.join(matching_items(named, items, index), norms).select("reader_id", "item_key").distinct()
    # Each spelling is normalised once, not each row and again to join it back.
    spelled = settle(with_norms(picks.select("title", "author").distinct()), "spellings")
    hits = spelled.join(matching_items(spelled, items, index), norms).select(
        F.col("title").alias("_t"), F.col("author").alias("_a"), "item_key")
    same = F.col("title").eqNullSafe(F.col("_t")) & F.col("author").eqNullSafe(F.col("_a"))
    return picks.select("reader_id", "title", "author").join(hits, same).select("reader_id", "item_key").distinct()


def list_pairs(picks: DataFrame) -> DataFrame:
    """Distinct normalised list rows per reader, with the stored key if there is one."""
    return (with_norms(picks).groupBy("reader_id", "title_norm", "author_norm")
            .agg(F.min("item_key").alias("direct_key")))


def resolve_picks(picks: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(reader_id, item_key): a stored key is used as is, other rows are resolved;
    rows that end on one item count once."""
    # Three branches read the pairs; written, their names are normalised once.
    pairs = settle(list_pairs(picks), "list-pairs")
    keyed = (pairs.filter(F.col("direct_key").isNotNull())
             .select("reader_id", F.col("direct_key").alias("item_key"))
             .join(items.select("item_key"), "item_key", "left_semi"))
    named = pairs.filter(F.col("direct_key").isNull())
    found = (named.join(resolve_pairs(named, items, index), ["title_norm", "author_norm"])
             .select("reader_id", "item_key"))
    return keyed.select("reader_id", "item_key").unionByName(found).distinct()


def resolve_titles(titles: DataFrame, items: DataFrame) -> DataFrame:
    """(title, item_key) by title alone: full, then pre-colon, then folded title;
    the most-reviewed item wins."""
    entries = best(title_index(items).withColumn("neg", -F.col("reviews")), ["pass", "key"],
                   [F.col("neg"), F.col("item_key")], ["item_key"])
    asked = titles.select("title").distinct().withColumns(
        {"f": text.norm("title"), "s": text.title_short("title")})
    tries = F.array(F.struct(F.lit(1).alias("prio"), F.lit(1).alias("pass"), F.col("f").alias("key")),
                    F.struct(F.lit(2).alias("prio"), F.lit(1).alias("pass"), F.col("s").alias("key")),
                    F.struct(F.lit(3).alias("prio"), F.lit(2).alias("pass"),
                             text.title_fold(F.col("f")).alias("key")))
    hits = asked.select("title", F.explode(tries).alias("t")).select("title", "t.*").join(
        entries, ["pass", "key"])
    return best(hits, ["title"], [F.col("prio"), F.col("item_key")], ["item_key"])


def pair_index(items: DataFrame) -> DataFrame:
    """(title_norm, author_norm, item_key) under the older rules: full titles and
    key titles first, the pre-colon title only where that pair is free."""
    old = text.norm_keep_subtitle
    title = F.coalesce("title", F.lit(""))
    forms = F.array(
        F.struct(F.lit(1).alias("prio"), old("title").alias("title_norm")),
        F.when(text.key_title("item_key").isNotNull(), F.struct(
            F.lit(1).alias("prio"), old(text.key_title("item_key")).alias("title_norm"))),
        F.when(F.instr(title, ":") > 0, F.struct(
            F.lit(2).alias("prio"), old(F.substring_index(title, ":", 1)).alias("title_norm"))))
    rows = (items.select("item_key", old("author").alias("author_norm"),
                         F.explode(F.array_compact(forms)).alias("x"))
            .select("item_key", "author_norm", "x.*").filter(F.col("title_norm") != ""))
    return best(rows, ["title_norm", "author_norm"], [F.col("prio"), F.col("item_key")], ["item_key"])


def canonical_keys(keys: DataFrame, items: DataFrame, key: str = "raw_key") -> DataFrame:
    """Add canonical_key: the exact item key, else the one with the same light key."""
    light = items.groupBy(text.light_key("item_key").alias("_light")).agg(
        F.max("item_key").alias("_by_light"))
    exact = items.select(F.col("item_key").alias("_exact"))
    return (keys.withColumn("_light", text.light_key(key))
            .join(exact, F.col(key) == F.col("_exact"), "left").join(light, "_light", "left")
            .withColumn("canonical_key", F.coalesce("_exact", "_by_light"))
            .drop("_exact", "_light", "_by_light"))


def _grams(c: Column, size: int = 3) -> Column:
    """Distinct pieces of `size` characters; the whole text when it is shorter."""
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1))),
        lambda i: F.substring(c, i, size)))).otherwise(F.array(c))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) for each distinct text that contains a needle: an equi-join on
    the needle's rarest three-character piece, then the real test.  Needles of one
    or two characters join on pieces of their own length."""
    n = needles.select("needle").filter(F.col("needle") != "").distinct()
    t = texts.select("text").distinct()
    spread = F.concat(_grams(F.col("text"), 3), _grams(F.col("text"), 2), _grams(F.col("text"), 1))
    size = F.least(F.length("needle"), F.lit(3))
    wanted = n.select("needle", F.explode(
        F.when(size == 3, _grams(F.col("needle"), 3)).otherwise(F.array("needle"))).alias("gram"))
    # Only pieces that some needle has are counted or moved.
    held = t.select("text", F.explode(F.array_distinct(spread)).alias("gram")).join(
        wanted.select("gram").distinct(), "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count("*").alias("held"))
    # Merged: Spark takes the pieces for as small as the needles they are cut from, and would
    # broadcast them.
    rarest = best(wanted.hint("merge").join(counts, "gram"), ["needle"], [F.col("held"), F.col("gram")], ["gram"])
    return (rarest.join(held, "gram").filter(F.contains("text", "needle"))
            .select("needle", "text").distinct())


def lookup(queries: DataFrame, items: DataFrame, all_passes: bool = False) -> DataFrame:
    """(query, item_key, pass): key equal, else title contains, else series contains;
    the first pass with a hit answers unless all passes are asked for."""
    old = text.norm_keep_subtitle
    q = queries.select("query").distinct().withColumns(
        {"low": F.lower(F.trim("query")), "needle": old(F.trim("query"))})
    p1 = q.join(items.select("item_key", F.lower("item_key").alias("low")), "low").select(
        "query", "item_key", F.lit(1).alias("pass"))
    lowered = F.lower(F.coalesce("title", F.lit("")))
    titles = items.select("item_key", F.explode(F.array_distinct(F.array(
        old("title"), old(F.substring_index(lowered, ":", 1))))).alias("text"))
    names = items.select("item_key", old(F.lower(F.coalesce("series", F.lit("")))).alias("text"))

    def contains_pass(texts, number):
        return (q.join(containing(q, texts), "needle").join(texts, "text")
                .select("query", "item_key", F.lit(number).alias("pass")))

    hits = p1.unionByName(contains_pass(titles, 2)).unionByName(contains_pass(names, 3))
    first = hits.groupBy("query", "item_key").agg(F.min("pass").alias("pass"))
    if all_passes:
        return first
    lead = hits.groupBy("query").agg(F.min("pass").alias("lead"))
    return (first.join(lead, "query").filter(F.col("pass") == F.col("lead")).drop("lead"))


def upsert_keys(records: DataFrame, items: DataFrame) -> DataFrame:
    """Add canonical_key to (raw_key, title): D-01, else the smallest item key whose
    light form contains the record's light title."""
    known = canonical_keys(records, items)
    left = known.filter(F.col("canonical_key").isNull()).withColumn("needle", text.light_key("title"))
    texts = items.select("item_key", text.light_key("item_key").alias("text"))
    found = (containing(left, texts).join(texts, "text").groupBy("needle")
             .agg(F.min("item_key").alias("_found")))
    return (known.withColumn("needle", F.when(F.col("canonical_key").isNull(), text.light_key("title")))
            .join(found, "needle", "left")
            .withColumn("canonical_key", F.coalesce("canonical_key", "_found"))
            .drop("needle", "_found"))


def duplicate_groups(items: DataFrame) -> DataFrame:
    """Normalised pairs held by more than one item, with the count and both ends."""
    return (with_norms(items).groupBy("title_norm", "author_norm")
            .agg(F.count("*").alias("n_items"), F.min("item_key").alias("first_key"),
                 F.max("item_key").alias("last_key"))
            .filter(F.col("n_items") > 1))


def read_pairs(log: DataFrame) -> DataFrame:
    """Distinct (reader_id, title_norm, author_norm) already read."""
    return (with_norms(log.filter(F.coalesce("title", F.lit("")) != ""))
            .select("reader_id", "title_norm", "author_norm").distinct())


def peers(items: DataFrame, limit: int = 8) -> DataFrame:
    """(item_key, peer_key, rank): up to `limit` other items by the same author.
    Each author's first limit+1 items are enough, so no author is paired up whole."""
    named = items.filter(F.coalesce("author", F.lit("")) != "").select("item_key", "author", "title")
    heads = (top_rows(named, ["author"], [F.col("item_key")], limit + 1)
             .select("author", F.col("item_key").alias("peer_key"), F.col("title").alias("peer_title"),
                     F.col("_rn")))
    pairs = named.select("item_key", "author").join(heads, "author").filter(
        F.col("item_key") != F.col("peer_key"))
    # Dropping itself moves every later peer up one place.
    rank = F.col("_rn") - F.when(F.col("item_key") < F.col("peer_key"), 1).otherwise(0)
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("_rn")
