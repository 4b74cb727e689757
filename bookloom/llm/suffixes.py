"""Repeated passages by sparse suffix arrays over words.

Only suffixes that start at a minimiser are kept: of the 8-word grams in each stretch of
`window` starts, the one of least hash.  The text alone selects them, so two copies of a
passage of `least` words keep a suffix at the same place, among its first `window` words,
and agree on the `seed` words from there: window + seed = least + 1.

A passage of `least` words has one minimiser, at the same place in all its copies; a kept
suffix stands for the passages that it is the minimiser of, and its context are the words
that these cover.  The kept suffixes are sorted over all machines by their first `seed`
words and their context (as hashes).  Suffixes equal in both hold the same passages, so all
but the first by (doc_id, text, place) are copies.  Of those equal in the first `seed` words
only, the first of each context gives its passages one by one, as hashes of all `least`
words, and these are sorted and compared in the same way.  So each passage is compared with
each earlier place of all its words, never with one place chosen for a part of them.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.llm.common import DOCUMENTS, WHITESPACE, arrow_map
from bookloom.operators.common import settle

LEAST_WORDS = 50
SEED_WORDS = 30
GRAM = 8
#: Rows of the sorted suffix list per task, about.
ROWS_PER_TASK = 500_000
CACHED_WORDS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _windows(sums: np.ndarray, back: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each start: the difference of two running sums of
    word * base**place, brought back to place 0."""
    return _mixed((sums[width:] - sums[:-width]) * back[:len(sums) - width])


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of word * base**place, and the powers that bring them back."""
    n = len(h)
    powers = np.empty(n, np.uint64)
    powers[0], powers[1:] = 1, _BASE
    np.multiply.accumulate(powers, out=powers)
    back = np.empty(n, np.uint64)
    back[0], back[1:] = 1, _INVERSE
    np.multiply.accumulate(back, out=back)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)]), back


def kept_suffixes(words: list[bytes], hashes: _Hashes, least: int, seed: int) -> tuple[np.ndarray, ...]:
    """(starts, hashes of the first `seed` words, hashes of the context, first passage's
    start, number of further passages) of the suffixes at minimisers."""
    n = len(words)
    if n < least:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums, back = _sums(np.fromiter(map(hashes.__getitem__, words), np.uint64, n))
    grams = _windows(sums, back, GRAM)
    width = least - seed + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, width)[:n - least + 1]
    each = np.concatenate([view[at:at + 65536].argmin(1) + np.arange(at, min(at + 65536, len(view)))
                           for at in range(0, len(view), 65536)])
    # The least gram of a stretch never lies before that of the stretch before.
    starts, low, count = np.unique(each, return_index=True, return_counts=True)
    end = low + count - 1 + least
    shape = (starts - low).astype(np.uint64) * np.uint64(least) + count.astype(np.uint64)
    context = _mixed(_mixed((sums[end] - sums[low]) * back[low]) + shape * _BASE)
    return starts, _windows(sums, back, seed)[starts].view(np.int64), context.view(np.int64), low, count - 1


_NO_ID = (1 << 63) - 1


def _documents(docs: DataFrame) -> DataFrame:
    """doc (the id, null last), key (names a row by id and text), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
                       F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text")


def suffix_list(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """(seed, context, doc, key, place, more) of every kept suffix: its passages start at the
    word `place`, counted from 0, and the `more` words after it."""
    def run(batches):
        hashes = _Hashes()
        for b in batches:
            for doc, key, text in zip(b["doc"], b["key"], b["text"]):
                starts, seeds, context, low, more = kept_suffixes((text or "").encode().split(), hashes, least, seed)
                if len(starts):
                    yield {"seed": seeds, "context": context, "doc": np.full(len(starts), doc), "key": np.full(len(starts), key),
                           "place": low, "more": more}
    return arrow_map(docs.filter("text is not null"), "seed long, context long, doc long, key long, place int, more int", run)


def copies(rows: DataFrame, carried: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (seed, context, doc, key, place, carried ints): those that are not the first
    of their seed and context, with that one's doc as o_doc; and the first ones of each
    context among several of one seed.

    The list is sorted by ranges of its whole key, so a run of any size is spread over as
    many tasks as it has rows for, and each task compares neighbours in one range of about
    ROWS_PER_TASK rows.  A run may go on from one range to the next: the first rows of each
    range's first and last run, two per task, tell where it began.  The seeds at the two
    ends of a range always count as having several contexts.
    """
    order = ["seed", "context", "doc", "key", "place"]
    names = [*order, *carried]
    session = rows.sparkSession
    tasks = max(-(-rows.count() // ROWS_PER_TASK), int(session.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        got = [[np.array(b[c], np.int64) for c in names] for b in batches]
        if not got:
            return
        col = dict(zip(names, (np.concatenate(c) for c in zip(*got))))
        n = len(col["seed"])
        new_seed = np.concatenate([[True], np.diff(col["seed"]) != 0])
        new = new_seed | np.concatenate([[True], np.diff(col["context"]) != 0])
        bounds = np.append(np.flatnonzero(new), n)
        first = np.repeat(bounds[:-1], np.diff(bounds))
        place_of = np.arange(n)
        bound = (place_of == 0) | (place_of == bounds[-2])
        of_seed = np.cumsum(new_seed) - 1
        several = (np.bincount(of_seed, new) > 1)[of_seed] | (of_seed == 0) | (of_seed == of_seed[-1])
        among = several & new
        at = np.flatnonzero(bound | among | (first != place_of))
        for i in range(0, len(at), 1 << 16):
            here = at[i:i + (1 << 16)]
            of = first[here]
            yield {c: v[here] for c, v in col.items()} | {
                "o_doc": col["doc"][of], "o_key": col["key"][of], "o_place": col["place"][of],
                "bound": bound[here], "among": among[here]}

    ranged = rows.select(*names).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ints = "".join(f", {c} int" for c in carried)
    told = settle(arrow_map(ranged, f"seed long, context long, doc long, key long, place int{ints}, o_doc long, o_key long, "
                                    "o_place int, bound boolean, among boolean", run), label)
    here = F.struct("o_doc", "o_key", "o_place")
    begun = told.filter("bound").groupBy("seed", "context").agg(F.min(here).alias("b"))
    out = told.join(F.broadcast(begun), ["seed", "context"], "left").withColumn("o", F.least(here, F.coalesce("b", here)))
    later = out.filter((F.col("key") != F.col("o.o_key")) | (F.col("place") != F.col("o.o_place")))
    return later.select("doc", "key", "place", *carried, F.col("o.o_doc").alias("o_doc")), told.filter("among").select(*names)


def word_places(text: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words between ASCII blanks, and the code points where each starts and ends."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    change = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return raw.split(), points[change[::2]].astype(np.int32), points[change[1::2]].astype(np.int32)


def _passages(docs: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """For each key's asked (place, more, o_doc, whole): whole ones joined where they touch,
    with the doc of the first one's original; of the others each passage of `least` words
    with its hash.  (hash, key, doc, a, e, start, end, o_doc): words and code points."""
    lists = asked.groupBy("key").agg(F.collect_set(F.struct("place", "more", "whole", "o_doc")).alias("asked"))
    schema = "hash long, key long, doc long, a int, e int, start int, end int, o_doc long, whole boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            for key, doc, text, asked in zip(b["key"], b["doc"], b["text"], b["asked"]):
                words, starts, ends = word_places(text)
                joined: list[list[int]] = []
                for x in sorted((x["place"], x["o_doc"], x["more"]) for x in asked if x["whole"]):
                    a, e = x[0], x[0] + x[2] + least
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], e)
                    else:
                        joined.append([a, e, x[1]])
                single = sorted({p for x in asked if not x["whole"] for p in range(x["place"], x["place"] + x["more"] + 1)})
                a = np.array([*(x[0] for x in joined), *single], np.int64)
                e = np.array([*(x[1] for x in joined), *(p + least for p in single)], np.int64)
                whole = np.arange(len(a)) < len(joined)
                hashed = np.zeros(len(a), np.int64)
                if single:
                    sums, back = _sums(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                    hashed[~whole] = _windows(sums, back, least)[single].view(np.int64)
                full = [np.full(len(a), v, np.int64) for v in (key, doc)]
                o_doc = np.array([*(x[2] for x in joined), *[0] * len(single)], np.int64)
                yield dict(zip(names, (hashed, *full, a, e, starts[a], ends[e - 1], o_doc, whole)))

    # Rows equal in id and text have one key: a second one tells the same.
    return arrow_map(docs.join(lists, "key").select("key", "doc", "text", "asked"), schema, run)


def repeats(docs: DataFrame, least: int = LEAST_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """Passages that an earlier place holds too: doc_id, key, start, end (code points, end
    exclusive), n_words, kept_doc_id (where the original of its first words is).

    Every passage of `least` words or more that two places hold is found in all but its
    first place, and nothing else.  Words are compared as they are, blanks between them do
    not matter; passages that touch are one.  Texts that are null or have fewer words give
    no rows; rows equal in id and text count as one document; an empty table gives none.
    """
    rows = _documents(docs).filter("text is not null")
    whole, among = copies(settle(suffix_list(rows, least, seed), "suffixes"), ["more"], "neighbours")
    asked = whole.select("key", "place", "more", "o_doc", F.lit(True).alias("whole")).union(
        among.select("key", "place", "more", F.lit(0).cast("long"), F.lit(False)))
    found = settle(_passages(rows, asked, least), "passages")
    single = found.filter(~F.col("whole")).select(F.col("hash").alias("seed"), F.lit(0).cast("long").alias("context"), "doc", "key",
                                                  F.col("a").alias("place"), "e", "start", "end")
    parts, _ = copies(single, ["e", "start", "end"], "passage-neighbours")
    spans = found.filter("whole").select("key", "doc", "a", "e", "start", "end", "o_doc").union(
        parts.select("key", "doc", "place", "e", "start", "end", "o_doc"))
    order = Window.partitionBy("key").orderBy("a", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    named = spans.withColumn("new", F.coalesce(F.col("a") > before, F.lit(True)).cast("int")).withColumn(
        "n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = named.groupBy("key", "n").agg(F.min("doc").alias("doc"), F.min("start").alias("start"), F.max("end").alias("end"),
                                           (F.max("e") - F.min("a")).alias("n_words"), F.min(F.struct("a", "o_doc")).alias("k"))
    return joined.select(F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), "key", "start", "end", "n_words",
                         F.nullif("k.o_doc", F.lit(_NO_ID)).alias("kept_doc_id"))


def cut_repeats(docs: DataFrame, least: int = LEAST_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """The columns of documents without the later copies of repeated passages: those are cut
    out of the texts and n_chars is counted anew.  A text with nothing but blanks left goes; texts without a
    copy, null ones included, stay as they are."""
    spans = repeats(docs, least, seed).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    keyed = docs.select(*DOCUMENTS, F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key")).join(spans, "key", "left")
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), F.col("cuts.end")),
                      F.concat(F.col("cuts.start"), F.array(F.char_length("text"))),
                      lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    left = F.array_join(gaps, "")
    out = keyed.withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(left))
    kept = out.filter(F.col("cuts").isNull() | (F.length(F.trim("text", F.lit(WHITESPACE))) > 0))
    return kept.withColumn("n_chars", F.when(F.col("cuts").isNull(), F.col("n_chars")).otherwise(
        F.char_length("text").cast("long"))).select(*DOCUMENTS)
