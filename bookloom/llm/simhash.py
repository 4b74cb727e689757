"""Near-duplicates by 64-bit SimHash fingerprints, linked through Golay-code keys.

The (23, 12, 7) Golay code is perfect: each 23-bit word lies within 3 bits of exactly one
code word.  Two words that differ in at most one bit have a code word that is the nearest
one of the first and within 4 bits of the second; a word has one or six code words that
near.  A fingerprint is cut into three segments of 22, 21 and 21 bits, shorter than the code
and padded with zeros.  Of at most four errors the two best segments hold (0 or 1, 0 or 1),
or 0 and 2 with 2 in the third.  So each fingerprint has these keys:

* for each pair of segments, the nearest code word of one with each near one of the other,
  both ways round, and one third of the remaining segment, whose two errors at most leave
  one of its three thirds whole (31 bits, about 29 keys a pair);
* for each two segments, the bits of one with the near code words of the other (33 bits, five
  keys), for pairs whose third segment has more errors;
* for each segment, its bits with each third of the next one (28 bits, three keys): two
  errors there leave one third whole.

Without `thirds` the first kind goes without that third: a third of the keys, but only 24
bits, so that lists of unrelated fingerprints grow long beyond some millions of them.
"""

from __future__ import annotations

import functools
from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import DOCUMENTS, arrow_map
from bookloom.llm.components import components
from bookloom.operators.common import settle

SHINGLE = 4
DISTANCE = 4
SEED = 42
# Fixed value: a generator polynomial of the Golay code.
GENERATOR = 0xAE3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_LANES = 256 * np.arange(8, dtype=np.int64)
#: (start, width) of each segment and its thirds.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64 bits: bit i is set if more than half of the shingles' hashes have it."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    counts = np.zeros(2048, np.int64)
    for at in range(0, n, 1 << 16):
        lanes = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048)
    ones = np.einsum("lv,vb->lb", counts.reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By remainder: what to add to a word's top 12 bits for its nearest code word, how many
    code words lie within 4 bits (1 or 6), and what to add for the five others."""
    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
        return x

    high = np.arange(1 << 12) << 11
    top = remainder(high)
    code = high | top  # x**11 * m + remainder is divisible by the generator
    seven = code[np.bitwise_count(code) == 7]
    nearest, count, others = np.zeros(2048, np.int64), np.ones(2048, np.int64), np.zeros((2048, 5), np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            s = int(remainder(np.array([error]))[0])
            nearest[s] = error >> 11
            if weight == 3:
                count[s] = 6
                others[s] = seven[seven & error == error] >> 11
    return nearest, count, others


@functools.cache
def _top_remainder() -> np.ndarray:
    x = np.arange(1 << 12) << 11
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


def near_words(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of the code words within 4 bits, nearest first, and how many count."""
    nearest, count, others = golay()
    s = _top_remainder()[word >> 11] ^ (word & 2047)
    first = word >> 11 ^ nearest[s]
    return np.column_stack([first, first[:, None] ^ others[s]]), count[s]


def keys(prints: np.ndarray, thirds: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) for all keys.  The top bits name the kind of key."""
    x = prints.view(np.uint64).astype(np.uint64)
    seg = [((x >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    near = [near_words(s) for s in seg]
    third = [[s & 127, s >> 7 & 127, s >> 14] for s in seg]
    every = np.arange(len(x))
    out_place, out_key, kind = [], [], 0

    def add(place: np.ndarray, key: np.ndarray) -> None:
        nonlocal kind
        out_place.append(place)
        out_key.append(key | kind << 56)

    for a, b in combinations(range(3), 2):
        c = 3 - a - b
        for rest in (third[c] if thirds else [np.zeros_like(seg[0])]):
            for j in range(6):
                (wa, na), (wb, nb) = near[a], near[b]
                use = nb > j
                add(every[use], (wa[:, 0] << 12 | wb[:, j] | rest << 24)[use])
                if j:
                    use = na > j
                    add(every[use], (wa[:, j] << 12 | wb[:, 0] | rest << 24)[use])
            kind += 1
    for a in range(3):
        b = (a + 1) % 3
        for t in third[b]:
            add(every, seg[a] << 8 | t)
            kind += 1
        for b in (x for x in range(3) if thirds and x != a):
            for j in range(6):
                use = near[b][1] > j
                add(every[use], (seg[a] << 12 | near[b][0][:, j])[use])
            kind += 1
    return np.concatenate(out_place), np.concatenate(out_key)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fp; null texts count as empty."""
    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "_row": b["_row"], "fp": [fingerprint(t or "") for t in b["text"]]}
    return arrow_map(docs.select("doc_id", "_row", "text"), "doc_id long, _row long, fp long", run)


class Forest:
    """Sets of fingerprints that grow together."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether that made one set of two."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
            self.above.setdefault(min(a, b), min(a, b))
        return a != b


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def spanning(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Places of links that join all that links within `distance` bits join, each member
    being linked from one reached before."""
    waiting, out = np.arange(len(fp)), []
    while len(waiting):
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            found = np.zeros(len(waiting), bool)
            for at in front:
                near = ~found & _close(fp[waiting], fp[at], distance)
                out += [(int(at), int(x)) for x in waiting[near]]
                found |= near
            front, waiting = waiting[found], waiting[~found]
    return out


def list_links(batches, distance: int, longest: int):
    """From rows sorted by key: links that join each list of equal keys as far as links
    within `distance` bits do, less those that earlier ones of the task imply; and the rows
    of lists of over `longest`, which are only joined in parts here."""
    forest = Forest()
    carried = np.zeros(0, np.int64), np.zeros(0, np.int64)
    none, opened = np.zeros(0, np.int64), False

    def lists(key: np.ndarray, fp: np.ndarray):
        """Links of whole lists, or of a part of one."""
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        size = np.diff(np.append(first, len(key)))
        two = first[size == 2]
        two = two[_close(fp[two], fp[two + 1], distance)] if len(two) else two
        pairs = [p for p in zip(fp[two].tolist(), fp[two + 1].tolist()) if forest.join(*p)]
        for at, n in zip(first[size > 2], size[size > 2]):
            part = fp[at:at + n]
            if len({forest.root(x) for x in part.tolist()}) > 1:
                linked = ((int(part[i]), int(part[j])) for i, j in spanning(part, distance))
                pairs += [p for p in linked if forest.join(*p)]
        return pairs

    def rows(pairs, key, fp):
        u, v = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
        return {"key": np.append(np.zeros(len(u), np.int64), key), "u": np.append(u, fp), "v": np.append(v, fp)}

    for b in batches:
        key, fp = (np.append(held, b[c]) for held, c in zip(carried, ("key", "fp")))
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last and opened:
            # The list that was given out in parts ends here.
            end = int(np.searchsorted(key, key[0], "right"))
            yield rows(lists(key[:end], fp[:end]), key[:end], fp[:end])
            key, fp, last, opened = key[end:], fp[end:], last - end, False
        if last:
            first = np.flatnonzero(np.diff(key[:last], prepend=key[0] - 1))
            long = np.repeat(np.diff(np.append(first, last)) > longest, np.diff(np.append(first, last)))
            yield rows(lists(key[:last][~long], fp[:last][~long]), none, none)
            yield from (rows(lists(key[:last][long][i:i + longest], fp[:last][long][i:i + longest]), key[:last][long][i:i + longest],
                             fp[:last][long][i:i + longest]) for i in range(0, int(long.sum()), longest))
        key, fp = key[last:], fp[last:]
        while len(key) > longest:
            opened = True
            yield rows(lists(key[:longest], fp[:longest]), key[:longest], fp[:longest])
            key, fp = key[longest:], fp[longest:]
        carried = key, fp
    key, fp = carried
    yield rows(lists(key, fp), *((key, fp) if opened else (none, none)))


#: Longer lists of equal keys are compared in blocks of this size, by several tasks.
LIST = 2048


def _across(rows: DataFrame, distance: int, block: int) -> DataFrame:
    """Links (u, v) between the components u, v of rows(key, fp, component) of equal keys:
    the rows outside a list's commonest component against those of other components, a
    block of each at a time."""
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("kinds"),
        F.sum("n").alias("all"), F.max("n").alias("top")).filter("kinds > 1")
    mixed = rows.join(sizes, "key")

    def blocks(df: DataFrame, total: Column, name: str) -> DataFrame:
        share = F.pmod(F.xxhash64("fp"), F.ceil(total / block))
        return df.groupBy("key", share.alias(f"block_{name}")).agg(
            F.collect_list("fp").alias(f"fp_{name}"), F.collect_list("component").alias(f"c_{name}"))

    few = blocks(mixed.filter("component <> most"), F.col("all") - F.col("top"), "a")
    many = blocks(mixed, F.col("all"), "b")

    def run(batches):
        for b in batches:
            forest, pairs = Forest(), []
            for fa, ca, fb, cb in zip(*(b[c] for c in ("fp_a", "c_a", "fp_b", "c_b"))):
                fb, cb = np.array(fb, np.int64), np.array(cb, np.int64)
                for x, c in zip(fa, ca):
                    for other in np.unique(cb[_close(fb, np.int64(x), distance)]).tolist():
                        if forest.join(c, other):
                            pairs.append((c, other))
            yield {"u": [u for u, _ in pairs], "v": [v for _, v in pairs]}

    pairs = few.join(many, "key").drop("key")
    return arrow_map(pairs.repartition("block_a", "block_b", F.hash("fp_a")).select("fp_a", "c_a", "fp_b", "c_b"), "u long, v long", run)


def groups(prints: DataFrame, distance: int = DISTANCE, thirds: bool = True, longest: int = LIST) -> DataFrame:
    """(fp, component) for distinct fingerprints fp: the components of the graph that links
    fingerprints at `distance` or fewer bits (at most 4).

    The keys are sorted, and each list of equal keys is joined where it lies; only links that
    grow a component leave a task.  Lists of over `longest` fingerprints are joined part by
    part, and then those that still mix components once more, by blocks of rows.
    """
    assert 0 <= distance <= DISTANCE

    def run(batches):
        for b in batches:
            fp = np.array(b["fp"], np.int64)
            place, key = keys(fp, thirds)
            for at in range(0, len(key), 1 << 18):
                yield {"key": key[at:at + (1 << 18)], "fp": fp[place[at:at + (1 << 18)]]}

    def find(batches):
        return list_links(batches, distance, longest)

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = arrow_map(prints.select("fp").repartition(parts), "key long, fp long", run)
    found = settle(arrow_map(rows.repartition("key").sortWithinPartitions("key"), "key long, u long, v long", find), "simhash-links")
    first = components(found.filter("u <> v").select("u", "v"))
    again = found.filter("u = v").select("key", F.col("u").alias("fp"))
    if again.isEmpty():
        return first.select(F.col("node").alias("fp"), "component")
    named = again.distinct().join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("component", "fp").alias("component"))
    second = components(_across(settle(named, "simhash-long-lists"), distance, longest)).select(
        F.col("node").alias("component"), F.col("component").alias("whole"))
    joined = first.join(second, "component", "left").select(
        F.col("node").alias("fp"), F.coalesce("whole", "component").alias("component"))
    alone = second.join(first.select("component").distinct(), "component", "left_anti").select(
        F.col("component").alias("fp"), F.col("whole").alias("component"))
    return joined.union(alone)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, thirds: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, _row, fp, component_id (the smallest doc_id whose
    fingerprint is reachable by links; null ids only where a whole component has no other).

    Null and empty texts have fingerprint 0, linked like any other; very long texts are read
    whole, by one task each; equal texts share one fingerprint and are compared once; an
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id())
    return _grouped(settle(fingerprints(rows), "fingerprints"), distance, thirds)


def _grouped(prints: DataFrame, distance: int, thirds: bool) -> DataFrame:
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = groups(distinct, distance, thirds)
    known = distinct.join(linked, "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    least = known.groupBy("c").agg(F.min("least").alias("component_id"))
    named = known.join(least, "c").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "_row", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, thirds: bool = True) -> DataFrame:
    """The columns of documents for one row of each near-duplicate group: that of the
    smallest doc_id, null ids last.  Of rows equal in id and text the one with the least
    remaining columns stays."""
    keyed = docs.select(*DOCUMENTS, F.xxhash64(F.col("doc_id").cast("long"), "text").alias("_row"))
    placed = settle(fingerprints(keyed.withColumn("doc_id", F.col("doc_id").cast("long"))), "fingerprints")
    distinct = placed.groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("best"))
    known = distinct.join(groups(distinct, distance, thirds), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    stay = known.groupBy("c").agg(F.min("best").alias("best")).select(F.col("best._row").alias("_row"))
    # One shuffle serves the join and the choice among equal rows.
    kept = keyed.join(stay, "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*DOCUMENTS)).alias("d"))
    return kept.select("d.*")
