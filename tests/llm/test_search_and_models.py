"""Lexical search, suffix tree scores and whitening against plain versions."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookloom.llm import maxsketch, suffixtree, whitening
from tests.llm.test_llm import WORD, docs, frame, key, none, prose, texts  # noqa: F401  (fixtures)

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- max-sketch search ---------------------------------------------------------------------

def plain_ranks(rows, items, k):
    tfs = [(i, Counter(TERM.findall(lowered(t)))) for i, t in rows]
    tfs = [(i, c) for i, c in tfs if c]
    n, total = len(tfs), sum(c.total() for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in tfs:
            m = 100 - 25 + (25 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in TERM.findall(lowered(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def asked():
    return [(0, prose(25, 900)), (1, prose(8, 7) + " " + prose(8, 7)), (2, None), (3, ""), (4, " .,; "), (5, "WORD word Word"),
            (5, "WORD word Word"), (None, "token abc secret"), (7, "nowhere" * 9), (8, "日本 é日本 line"), (9, prose(3000, 30))]


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, score string")


@pytest.mark.parametrize("k, coordinates, share", [(20, 4096, 1000), (3, 64, 4), (5, 1, 1000)])
def test_search_equals_scoring_everything(spark, docs, texts, k, coordinates, share):  # noqa: F811
    index = maxsketch.build(docs, coordinates)
    got = maxsketch.search(index, items_frame(spark, asked()), k, coordinates, share)
    assert key(got.collect()) == key(plain_ranks(texts, asked(), k))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_ties_and_a_word_in_every_document(spark):
    rows = [(i, "common " + ("rare " if i % 3 == 0 else "") + "filler" * (i % 2)) for i in range(400)]
    got = maxsketch.rank(frame(spark, rows), items_frame(spark, [(1, "rare common"), (2, "common"), (3, "filler rare")]))
    assert key(got.collect()) == key(plain_ranks(rows, [(1, "rare common"), (2, "common"), (3, "filler rare")], 20))


def test_search_of_nothing(spark, docs, none):  # noqa: F811
    items = items_frame(spark, asked())
    assert maxsketch.rank(none, items).isEmpty() and maxsketch.rank(docs, items.limit(0)).isEmpty()
    assert maxsketch.rank(frame(spark, [(1, None), (2, " ")]), items).isEmpty()


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(1, 200)) % 300)) for i in range(300)]
    index = maxsketch.build(frame(spark, rows), 32).toPandas()
    corpus = maxsketch.Corpus(len(index), int(index["n"].sum()))
    df = Counter(t for text in index["text"] for t in maxsketch.counts(text))
    items = maxsketch.Items.of([(0, 0, rows[4][1]), (1, 1, "w1 w2 w3 w3")], {t: corpus.weight(n) for t, n in df.items()}, 32)
    import pyarrow as pa
    bound = items.bounds(corpus, 32, index["n"].tolist(), pa.array(index["at"].tolist(), pa.list_(pa.int32())),
                         pa.array(index["most"].tolist(), pa.list_(pa.int32())))
    for p, (text, n) in enumerate(zip(index["text"], index["n"])):
        for i in range(2):
            assert items.score(i, maxsketch.counts(text), corpus.damping(int(n))) <= bound[p, i]


# --- suffix tree ---------------------------------------------------------------------------

def line(text):
    return b"".join(w.encode() + b" " for w in WORD.findall(lowered(text))) + b"\n"


def plain_tree(lines, depth, share):
    n = [defaultdict(Counter) for _ in range(depth + 1)]
    for t in lines:
        padded = b"\n" * depth + t
        for p in range(depth, len(padded)):
            for k in range(depth + 1):
                n[k][padded[p - k:p]][padded[p]] += 1
    size = sum(n[0][b""].values())
    keep = {b""}
    for k in range(1, depth + 1):
        for c, after in n[k].items():
            of, short = after.total(), n[k - 1][c[1:]]
            gain = sum(x * math.log(x * short.total() / (of * short[a])) for a, x in after.items())
            if of * share >= size and gain >= len(after) * 0.5 * math.log(size):
                keep |= {c[i:] for i in range(k + 1)}
    return n, size, keep


def plain_score(text, model, depth, share):
    n, size, keep = model
    padded, total = b"\n" * depth + line(text), 0.0
    for p in range(depth, len(padded)):
        prob = 1 / 256
        for k in range(depth + 1):
            c = padded[p - k:p]
            if c not in keep:
                break
            after = n[k][c]
            held = {a: x for a, x in after.items() if k == 0 or x * share >= size}
            of = after.total() + len(after)
            prob = held.get(padded[p], 0) / of + (of - sum(held.values())) / of * prob
        total += math.log10(prob)
    return total


@pytest.mark.parametrize("depth, share, word_share", [(3, 1 << 21, 1 << 18), (2, 300, 60), (6, 1 << 21, 1)])
def test_tree_scores(docs, texts, depth, share, word_share):  # noqa: F811
    got = {}
    for r in suffixtree.score(docs, depth, share, word_share).collect():
        got.setdefault((r["doc_id"], r["n_tokens"], r["held_out"]), []).append(r)
    out = [(i, t, zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2) for i, t in texts]
    learnt = [t for _, t, held in out if not held]
    c = Counter(w for t in learnt for w in [*WORD.findall(lowered(t)), "\n"])
    total, distinct = c.total(), len(c)
    model = plain_tree([line(t) for t in learnt], depth, share)
    assert len(model[2]) > 20
    for i, t, held in out:
        tokens = [*WORD.findall(lowered(t)), "\n"]
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tokens)
        want = plain_score(t, model, depth, share)
        rows = got[i, len(tokens), held]
        assert any(abs(r["base_score"] - base) < 1e-6 * max(1, -base) and abs(r["score"] - want) < 1e-6 * max(1, -want)
                   and r["n_known"] == sum(c[w] > 0 for w in tokens) and r["train_tokens"] == total for r in rows), (i, t)
    assert sum(map(len, got.values())) == len(out)


def test_distributions_sum_to_one(spark, docs):  # noqa: F811
    tree = suffixtree.fit(suffixtree.count(docs, 3).cache(), 3, 500)
    for past in (b"\n\n\n", b"the", b"er ", b"zzz", b"ab "):
        code = np.array([(int.from_bytes(past, "big") << 8) | a for a in range(256)], np.int64)
        assert abs((10 ** tree.log10(code)).sum() - 1) < 1e-9


def test_longer_contexts_pay_on_unseen_text(spark):
    rows = [(i, prose(120, 50 + i)) for i in range(150)]
    got = suffixtree.score(frame(spark, rows)).filter("held_out")
    flat = suffixtree.score(frame(spark, rows), 0).filter("held_out")
    total = F.sum("score")
    assert got.agg(total).first()[0] > 0.8 * flat.agg(total).first()[0]


def test_tree_without_training_rows(spark, none):  # noqa: F811
    assert suffixtree.score(none).isEmpty()
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    for r in suffixtree.score(frame(spark, [(i, "Ab c") for i in held])).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
        assert abs(r["score"] - 6 * math.log10(1 / 256)) < 1e-9


# --- whitening -----------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")


def check_whitening(got, rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(len(v) for _, v in good)
    x = [[math.floor(64 * c) + 1000000 for c in np.pad(v, (0, dims - len(v)))] for _, v in good]
    n, s = len(x), [sum(col) for col in zip(*x)]
    cov = np.cov(np.array(x, float).T, bias=True)
    value = np.sort(np.linalg.eigvalsh(cov))[::-1][:k]
    assert len(got) == n * k
    want = Counter((i, sum((n * a - b) ** 2 for a, b in zip(row, s))) for (i, _), row in zip(good, x))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == want
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    for r in got:
        assert abs(r["explained"] - value[r["component"] - 1] / np.trace(cov)) <= 1e-4 * r["explained"]
    w = defaultdict(list)
    for r in got:
        w[r["component"]].append((r["vec_id"], r["whitened"]))
    table = np.array([[v for _, v in sorted(w[c], key=str)] for c in range(1, k + 1)])
    assert abs(table @ table.T / n - np.eye(k)).max() < 1e-4
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-4


def test_whitening(spark):
    rng = np.random.default_rng(8)
    mix = rng.normal(0, 1, (12, 12))
    rows = [(i, (rng.normal(0, 1, 12) @ mix).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (400, None), (401, [None] + [1.0] * 11), (402, [float("nan")] * 12),
             (403, [float("inf")] * 12), (404, [1.0, 2.0]), (405, [])]
    got = whitening.whiten(vectors(spark, rows).repartition(3), "vec_id", "embedding", 5).collect()
    check_whitening(got, rows, 5)


def test_whitening_of_large_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(0, 1, 4) * [1e15, 3, 1e9, 1]).tolist()) for i in range(90)]
    got = whitening.whiten(vectors(spark, rows), "vec_id", "embedding", 1).collect()
    assert len(got) == 90 and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)
    assert abs(np.var([r["whitened"] for r in got]) - 1) < 1e-9


def test_whitening_without_spread_or_rows(spark):
    got = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])]), "vec_id", "embedding").collect()
    assert {(r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {
        (i, c, 0, 0.0, 0.0, 1.0) for i in (1, 2) for c in (1, 2)}
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(vectors(spark, rows), "vec_id", "embedding").isEmpty()


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(4)
    for z in (rng.integers(-900, 900, (131, 5)), rng.integers(-2 ** 61, 2 ** 61, (70, 3)), np.full((3, 2), 7), np.array([[5, -5]])):
        sums, cross = whitening.products(z.astype(np.int64))
        wide = z.astype(object)
        assert sums == [int(v) for v in wide.sum(0)] and (cross == wide.T.dot(wide)).all()
