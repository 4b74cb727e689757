"""Supervised subword embeddings: averaged vectors of hashed word and character n-grams
under a softmax, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import arrow_map

_WORD = re.compile(r"\S+")
CACHED_WORDS = 400_000


@dataclass(frozen=True)
class Settings:
    """`sample_rows` bounds the labelled rows learnt from, taken by a hash of their id."""
    buckets: int = 1 << 17
    dim: int = 16
    shortest: int = 3
    longest: int = 4
    epochs: int = 6
    rate: float = 0.5
    sample_rows: int = 8000
    threshold: float = 0.3
    seed: int = 11


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def word_grams(word: str, s: Settings) -> list[int]:
    """Buckets of a word and of its character n-grams between boundary marks."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i:i + n] for n in range(s.shortest, s.longest + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % s.buckets for g in grams]


class Features:
    """Texts as bucket ids: grams of each word, and one bucket per neighbouring word pair."""

    def __init__(self, s: Settings) -> None:
        self.s, self.grams = s, {}

    def words(self, text: str) -> list[str]:
        return _WORD.findall(text)

    def buckets(self, text: str) -> np.ndarray:
        s, words = self.s, self.words(text)
        if len(self.grams) > CACHED_WORDS:
            self.grams.clear()
        parts = []
        for w in words:
            if (g := self.grams.get(w)) is None:
                g = self.grams[w] = np.array(word_grams(w, s), np.int64)
            parts.append(g)
        if not parts:
            return np.zeros(0, np.int64)
        return np.concatenate([*parts, pair_buckets(np.array([p[0] for p in parts]), s)])


def pair_buckets(first: np.ndarray, s: Settings) -> np.ndarray:
    x = first.astype(np.uint64)
    return (_mix(x[:-1], x[1:]) % np.uint64(s.buckets)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Softmax over classes 0 and 1 of the averaged vectors.  With two classes the score is
    a logistic of the mean of one number per bucket: `weight` holds these."""
    settings: Settings
    weight: np.ndarray
    bias: float

    def score(self, mean: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -60, 60))))


def train(texts: list[str], labels: list[int], s: Settings) -> Model:
    """Each document is one step.  No rows, or one class only: every score is that class's
    smoothed share."""
    feats, rng = Features(s), np.random.default_rng(s.seed)
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return Model(s, np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share))))
    rows = []
    for t in texts:
        ids, n = np.unique(feats.buckets(t), return_counts=True)
        rows.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    embed = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    steps = s.epochs * len(rows)
    done = 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            ids, share_of = rows[i]
            rate = np.float32(s.rate * (1 - done / steps))
            done += 1
            mean = share_of @ embed[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out.T @ p
            out -= rate * np.outer(p, mean)
            bias -= rate * p
            # Every occurrence takes the whole step of the mean, as in averaged embeddings.
            embed[ids] -= (rate * np.minimum(share_of / share_of.mean(), 8))[:, None] * back[None, :]
    return Model(s, (embed @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


class _WordScores(dict):
    """word -> (sum of its buckets' weights, their number, bucket of the word)."""

    def __init__(self, m: Model) -> None:
        super().__init__()
        self.m = m

    def __missing__(self, word: str) -> tuple[float, int, int]:
        ids = word_grams(word, self.m.settings)
        if len(self) > CACHED_WORDS:
            self.clear()
        out = self[word] = (float(self.m.weight[ids].sum()), len(ids), ids[0])
        return out


def score_texts(model: Model, texts: list[str | None], scores: _WordScores) -> list[float]:
    out = []
    for t in texts:
        words = _WORD.findall(t or "")
        if not words:
            out.append(model.score(0.0))
            continue
        total, n, first = map(np.array, zip(*map(scores.__getitem__, words)))
        pairs = pair_buckets(first, model.settings)
        out.append(model.score((total.sum() + model.weight[pairs].sum()) / (n.sum() + len(pairs))))
    return out


def held_out(doc_id: Column) -> Column:
    """Whether the row's id keeps its label from training: crc32 of the id as text divides
    by 5.  A null id counts as the empty text, which does."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn labels.quality from at most s.sample_rows labelled rows that are not held out.
    The rows meet in one task, which returns the model: a number per bucket, a fixed size.
    Of repeated ids each different text is learnt from once, so these may be more rows; a
    very long text is read whole there.  Repeated labels of one id count as the highest."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "text").agg(
        F.max("quality").alias("quality"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        m = train(rows["text"].fillna("").tolist(), rows["quality"].astype(int).tolist(), s)
        return pd.DataFrame({"weight": [m.weight.tobytes()], "bias": [m.bias]})

    got = rows.groupBy().applyInPandas(learn, "weight binary, bias double").first()
    if got is None:
        return train([], [], s)
    return Model(s, np.frombuffer(bytes(got["weight"]), np.float32), got["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.  Null and empty texts get the
    score of no evidence; very long texts are read whole, by one task each; repeated rows
    score alike; other columns are ignored."""
    def run(batches):
        words = _WordScores(model)
        for b in batches:
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score_texts(model, b["text"], words)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = arrow_map(rows, "doc_id long, held_out boolean, score double", run)
    return scored.withColumn("predicted", (F.col("score") >= model.settings.threshold).cast("int"))
