"""Corpus operators against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bookloom.llm import (bpe, classifier, components, packing, queries, rules, secrets, sharding, simhash, suffixes,
                          topk, warc)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns named like things that the operators make themselves.
EXTRA = ", shard int, size string, _row long, key long, fp long, rank int, n_words long, spans string, seed long, v int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_rng = random.Random(5)
_vocab = ["".join(_rng.choice("abdeilnorst") for _ in range(_rng.randint(2, 9))) for _ in range(4000)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(_vocab) + r.choice([" ", " ", " ", "\n", ". "]) for _ in range(n))


def sample_texts() -> list[str | None]:
    base = [prose(r, r) for r in (3, 20, 49, 50, 51, 60, 120, 300, 700)]
    shared, other = prose(60, 900), prose(55, 901)
    near = base[7].split(" ")
    near[40] = "changed"
    return [*base, None, "", " \t\n ", "x", "word " * 400, base[6], base[6], base[6].upper(), " ".join(near),
            prose(30, 11) + shared + prose(30, 12), prose(80, 13) + "\n" + shared, shared + prose(70, 14) + other,
            other, other + prose(5, 15), "ab" * 40000, "é日本😀 " * 30, "a b c d " * 60, prose(5, 1) + "\n" + prose(5, 1),
            "### $$$ %%% " * 30, "line one\nline one\n\nline two " * 12,
            'password = "hunter2hunter2" and token:abc secret: x9K!qqW2zz',
            "AKIA" + "A1" * 8 + " " + "0123456789abcdef" * 2, prose(4000, 21)]


@pytest.fixture(scope="module")
def texts():
    out = list(enumerate(sample_texts()))
    return out + [out[6], out[6], (None, out[7][1]), (None, None)]


def frame(spark, rows, extra=EXTRA):
    return spark.createDataFrame([(i, t, None, "s", len(t) if t else None, *[None] * (extra.count(",") or 0)) for i, t in rows],
                                 SCHEMA + extra)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def key(rows):
    return Counter(map(tuple, rows))


# --- SimHash -------------------------------------------------------------------------------

def plain_print(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """ids -> least id reachable by links of 4 bits or fewer."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash_groups(docs, texts):
    got = simhash.near_duplicates(docs)
    prints = [plain_print(t) for _, t in texts]
    label = plain_components(prints)
    least = defaultdict(lambda: None)
    for (i, _), g in zip(texts, label):
        if i is not None and (least[g] is None or i < least[g]):
            least[g] = i
    want = [(i, p - (1 << 64) if p >> 63 else p, least[g]) for (i, _), p, g in zip(texts, prints, label)]
    assert key(got.select("doc_id", "fp", "component_id").collect()) == key(want)


def test_simhash_keeps_one_of_each_group(docs, texts):
    prints = [plain_print(t) for _, t in texts]
    label = plain_components(prints)
    best = {}
    for (i, t), g in zip(texts, label):
        if g not in best or (i is None, i or 0) < (best[g] is None, best[g] or 0):
            best[g] = i
    got = simhash.keep_one(docs)
    assert got.columns == SCHEMA.replace(",", "").split()[::2]
    assert key(got.select("doc_id").collect()) == key((i,) for i in best.values())


@pytest.mark.parametrize("thirds", [False, True])
def test_simhash_keys_miss_no_pair_within_four_bits(thirds):
    r = np.random.default_rng(3)
    x = r.integers(-2 ** 63, 2 ** 63 - 1, 3000)
    y = x.copy()
    for i in range(len(y)):
        for b in r.choice(64, 4, replace=False):
            y[i] ^= np.int64(1) << np.int64(b)

    def sets(v):
        out = [set() for _ in v]
        for p, k in zip(*simhash.keys(v, thirds)):
            out[p].add(int(k))
        return out
    assert all(a & b for a, b in zip(sets(x), sets(y)))


@pytest.mark.parametrize("longest", [3, 20, 2048])
def test_simhash_dense_and_chained_groups(spark, longest):
    r = np.random.default_rng(4)
    centre = r.integers(-2 ** 63, 2 ** 63 - 1, 6)
    prints = []
    for c in centre:
        x = int(c)
        for _ in range(40):          # a walk: neighbours are near, the ends are not
            x ^= 1 << int(r.integers(0, 63))
            prints.append(x)
        prints += [int(c) ^ (1 << a) ^ (1 << b) for a in range(0, 30, 3) for b in range(1, 30, 4)]
    prints = sorted(set(prints))
    got = dict(simhash.groups(spark.createDataFrame([(p,) for p in prints], "fp long"), longest=longest).collect())
    label = plain_components([p & (1 << 64) - 1 for p in prints])
    same = defaultdict(set)
    for p, g in zip(prints, label):
        same[got.get(p, p)].add(g)
    assert len(same) == len(set(label)) and all(len(s) == 1 for s in same.values())


@pytest.mark.parametrize("flips, longest", [(5, 2048), (5, 16), (6, 2048)])
def test_simhash_balls_that_are_linked_in_parts(spark, flips, longest):
    """Many fingerprints around one centre: near enough to share keys, not all to be linked."""
    r = np.random.default_rng(flips)
    centre, prints = int(r.integers(0, 2 ** 62)), set()
    while len(prints) < 400:
        x = centre
        for b in r.choice(63, flips, replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints = np.array(sorted(prints), np.int64)
    got = dict(simhash.groups(spark.createDataFrame([(int(p),) for p in prints], "fp long"), longest=longest).collect())
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(prints))
    while True:
        least = np.where(near, label[None, :], len(prints)).min(1)
        if (least == label).all():
            break
        label = least
    same = defaultdict(set)
    for p, g in zip(prints.tolist(), label.tolist()):
        same[got.get(p, p)].add(g)
    assert 1 < len(set(label.tolist())) == len(same) and all(len(s) == 1 for s in same.values())


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(3, 3), (50, 51), (51, 50)]
    edges += [(r.randint(200, 260), r.randint(200, 260)) for _ in range(45)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect()) == label


# --- Sharding ------------------------------------------------------------------------------

def plain_jump(k, n):
    k, b, j = k & (1 << 64) - 1, -1, 0
    while j < n:
        b = j
        k = (k * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_jump_hash(spark):
    ids = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, *range(2, 400), *(random.Random(2).getrandbits(62) for _ in range(300))]
    for n in (1, 2, 8, 33):
        got = sharding.assign(spark.createDataFrame([(i,) for i in ids], "id long"), "id", n).collect()
        assert {r["id"]: (r["shard"], r["grown_shard"]) for r in got} == {i: (plain_jump(i, n), plain_jump(i, n + 1)) for i in ids}


def test_shards(docs, texts):
    got = sharding.shard_documents(docs).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", plain_jump(i or 0, 8), plain_jump(i or 0, 9))
            for i, t in texts]
    assert key((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == key(want)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(w[4] == s for w in want)))


# --- Quality rules -------------------------------------------------------------------------

def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + d for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dups = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(repeated) > 50 * n
    bad = failed or chars > 15 * n or chars < 2 * n or 5 * symbols > n or 100 * dups > 50 * len(lines)
    return n, chars, symbols, dups, len(repeated), failed, not bad


def test_rules(docs, texts):
    assert key(rules.measure(docs).collect()) == key((i, *plain_rules(t)) for i, t in texts)


def test_rule_order_changes_no_verdict(docs, texts):
    want = key((i,) for i, t in texts if plain_rules(t)[-1])
    for order in (rules.RULES, rules.RULES[::-1]):
        kept = docs.filter(rules.passes(order, rules.from_text(F.col("text"))))
        assert key(kept.select("doc_id").collect()) == want
    assert key(rules.keep_good(docs).select("doc_id").collect()) == want
    assert sorted(r.name for r in rules.ordered(docs)) == sorted(r.name for r in rules.RULES)


# --- Secrets -------------------------------------------------------------------------------

def test_secret_base_patterns(docs, texts):
    got = {(r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "guess"))
           for r in secrets.scan(docs).collect()}
    want = set()
    for i, t in texts:
        t = t or ""
        found = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.add((i, tuple(sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0]))))))
    assert got == want


def plain_bits(value):
    """The same costs over all segmentations, without the running lengths."""
    low = value.lower()
    best = [0.0] + [float("inf")] * len(value)
    ranks, near, _ = secrets._tables()
    for j in range(1, len(value) + 1):
        best[j] = best[j - 1] + secrets._char_bits(value[j - 1]) + (value[j - 1] != low[j - 1])
        for i in range(j):
            part = low[i:j]
            for form in (part, part.translate(secrets.LEET)):
                if form in ranks and len(part) > 2:
                    best[j] = min(best[j], best[i] + ranks[form] + 1 + 2.0 * ((value[i:j] != part) + (form != part)))
            if len(part) >= 3 and len(set(part)) == 1:
                best[j] = min(best[j], best[i] + secrets._char_bits(part[0]) + np.log2(len(part)) + 1)
            if len(part) >= 3 and all(p in near for p in zip(part, part[1:])):
                best[j] = min(best[j], best[i] + np.log2(94) + np.log2(len(part)) + 1)
            if (d := secrets._date_bits(value[i:j])) is not None:
                best[j] = min(best[j], best[i] + d + 1)
    return best[-1]


def test_guess_cost_is_the_least_segmentation():
    r = random.Random(1)
    parts = ["password", "P4ssword", "qwerty", "2019", "311299", "aaaa", "x9!", "Zq", "abc", "dragon", "1234", "K"]
    for _ in range(150):
        v = "".join(r.choice(parts) for _ in range(r.randint(1, 5)))
        assert secrets.guess_bits(v) <= plain_bits(v) + 1e-9
        if not re.search(r"(.)\1\1\1\1", v):  # a longer run may also be read in parts
            assert secrets.guess_bits(v) == pytest.approx(plain_bits(v), abs=3.0)
    assert secrets.guess_bits("password2019") < 20 < 60 < secrets.guess_bits("x9K!qqW2zz-Lr7#mP0")


def test_masking(spark, docs):
    text = 'my password = "b7db7aa4a5fcc78305" ok'
    assert secrets.mask(text, secrets.find(text)) == 'my [SECRET]" ok'
    assert secrets.find("the password is welcome today, token: soon") == []
    out = {r["doc_id"]: r for r in secrets.masked(docs).collect() if r["doc_id"] is not None}
    before = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] is not None}
    for i, r in out.items():
        if secrets.find(before[i]["text"] or ""):
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert (r["text"], r["n_chars"]) == (before[i]["text"], before[i]["n_chars"])


def test_prose_after_a_credential_word_is_left_alone(spark):
    prose_ = "every login is available and a password is required. the secret is consistency"
    rows = [(i, f"{w} availability available, required consistency {i}") for i, w in enumerate("abcde")]
    rows += [(10 + i, prose_) for i in range(4)]
    rows += [(20 + i, "the password is kqzvwxjyfhbn today") for i in range(5)]   # copies make it no word
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(frame(spark, rows)).collect()}
    assert got == {i: ["guess"] if i >= 20 else [] for i, _ in rows}
    kept = {r["doc_id"]: r["text"] for r in secrets.masked(frame(spark, rows)).collect()}
    assert all(kept[i] == t for i, t in rows if i < 20) and all("[SECRET]" in kept[i] for i, _ in rows if i >= 20)


def test_guess_cost_of_columns_and_blocks():
    assert secrets.guess_bits("1qaz2wsx") < 25 and secrets.guess_bits("zaq1xsw2") < 25
    assert secrets.guess_bits("x9!Kx9!Kx9!K", block=secrets.BLOCK) < secrets.guess_bits("x9!K") + 8
    assert secrets.find("the password is x9!Kx9!Kx9!K") == []


# --- WARC ----------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    inner = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"
    html = ["<p>é</p>", "", None, "same", "same", "same", inner, "x" * 100000, "<p>é</p>"]
    rows = [(i, f"http://www.Host{i % 3}.org/a/{i % 2}?q=1" if i != 4 else None, h) for i, h in enumerate(html)]
    rows += [(None, "http://h/\r\nX: y", "same"), (3, "http://h/3", "same"), (2 ** 62 + 1, "u", "big"), (2 ** 62 + 3, "u", "big")]
    pages = spark.createDataFrame([(*r, None, None) for r in rows], "page_id long, url string, html string, row long, size long")
    got = warc.archive(pages).collect()
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    want, seen = [], set()
    for i, _, h in rows:
        raw = (h or "").encode()
        leads = first[h or ""] == i and (h or "") not in seen
        if leads:
            seen.add(h or "")
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if leads else "revisit",
                     None if leads else first[h or ""]))
    assert key(r[:5] for r in got) == key(want)
    order = [(r["url_key"], r["captured"]) for r in got]
    assert order == sorted(order)
    assert all(r["record_type"] == "response" for r in warc.archive(pages, least_bytes=10 ** 6).collect())


def test_warc_digest_hashes_a_payload_once(spark):
    """Within a lambda the payload would be hashed again for each of 32 digits."""
    texts = ["", "a", "\u00e9\u4e2d", *(chr(97 + i % 26) * i for i in range(1, 200))]
    df = spark.createDataFrame([(t,) for t in texts], "html string").select(
        "html", warc.base32_sha1(F.col("html").cast("binary")).alias("d"))
    assert {r.html: r.d for r in df.collect()} == {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}
    assert "lambda" not in df._jdf.queryExecution().analyzed().toString()


def test_warc_file_is_well_formed(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "text" * i) for i in range(12)], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), str(tmp_path / "w"), per_file=5)
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) == 3
    found = [head for f in files for _, head, _ in warc.records(gzip.decompress(f.read_bytes()))]
    assert sorted(h["WARC-Target-URI"] for h in found) == sorted(f"http://a/{i}" for i in range(12))


def test_loser_tree():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((r.randint(0, 20), r.randint(0, 3)) for _ in range(r.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


# --- BPE -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_tables(docs, texts, byte_tokenizer):
    def want():
        for i, t in texts:
            ids = byte_tokenizer.encode(t or "", add_special_tokens=False).ids
            yield i, tuple(ids), byte_tokenizer.decode(ids, skip_special_tokens=False)
    for long_chars in (bpe.LONG_CHARS, 600):   # with and without parts
        got = bpe.encode(docs, long_chars=long_chars).collect()
        assert key((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == key(want())


def test_bpe_parts_keep_the_pieces_of_the_whole_text(spark, byte_tokenizer):
    """Blanks before a word are split by what follows them, also where a part ends."""
    rows = [(n, "x" * n + gap.join(["foo bar"] * 60)) for n in range(24) for gap in ("\n\n", "\n\n\n", " \n ", "\n\n" + "ab" * 40)]
    rows += [(100, "foo\n\n" + "y" * 300), (101, "\n" * 300 + "x"), (102, " " * 300 + "x"), (103, "a\n\n<|endoftext|>\n\nb" * 20)]
    want = key((i, tuple(byte_tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    got = bpe.encode(frame(spark, rows), long_chars=50).collect()
    assert key((r["doc_id"], tuple(r["ids"])) for r in got) == want


def test_bpe_trees(byte_tokenizer):
    r = random.Random(3)
    coders = [bpe.Coder(bpe.default_path(), leaf=n) for n in (1, 8, 512)]
    bits = ["a", "b", "aa", "the", " ", "  ", "\n", "!", "'s", "'re", "1", "é", "日本", " ", " ", "\x1c", "\x85", "😀",
            "<|endoftext|>", "<|", "क्ष", "İ", "ß"]
    cases = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(500)]
    cases += ["".join(r.choice("abcde") for _ in range(r.randint(0, 1500))) for _ in range(30)]
    cases += [b * r.randint(1, 1500) for b in ("a", "ab", "=", "-", "é", "日", "aab", " ", "\n ")]
    for t in cases:
        ids = byte_tokenizer.encode(t, add_special_tokens=False).ids
        for c in coders:
            assert c.encode(t).tolist() == ids
            assert c.decode(ids) == byte_tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_paths_agree_on_every_code_point(byte_tokenizer):
    """Which characters count as letters is the vocabulary's business on each path."""
    c = bpe.coder(bpe.default_path())
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    points = [ch for ch in points if ord(ch) < 0x33500 or 0xE0000 <= ord(ch) < 0xE0200 or ord(ch) % 997 == 0]
    for at in range(0, len(points), 400):
        short = "".join(f" z {ch}'ll a{ch}1 " for ch in points[at:at + 400])
        long = "x" * 200 + short
        assert c.encode(short).tolist() == byte_tokenizer.encode(short, add_special_tokens=False).ids
        want = byte_tokenizer.encode(long, add_special_tokens=False).ids
        assert c.encode(long).tolist() == want
        assert c.ids[[r for _, _, sizes, raw in bpe.parts_of(c, long, 2000) for r in c.pieced(raw, sizes)]].tolist() == want


# --- Top-k ---------------------------------------------------------------------------------

def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.3, 12).round(2).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [1.0, float("nan")]), (304, [float("inf")] * 12),
             (305, [1.0, None]), (350, []), (400, [1e30] * 12), (401, [0.5]), (100, rows[100][1]), (None, rows[5][1]),
             (450, [300000.0, 1.0]), (451, [300000.0, 1.0]), (452, [400000.0, 0.0]), (453, [262144.0, 900000.0]), (454, [-1e30, 2e30])]
    frame_ = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, id int, q int")
    got = topk.top_k(frame_, "vec_id", "embedding", F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), block_rows=64, query_rows=4)
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    want = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % 50 == 0:
            all_ = [(-sum(x * y for x, y in zip(q, v)), float("inf") if j is None else j, j) for b, (j, v) in enumerate(ok) if b != a]
            want += [(i, n + 1, j, max(-1 << 63, min((1 << 63) - 1, -s))) for n, (s, _, j) in enumerate(sorted(all_, key=lambda x: x[:2])[:5])]
    assert key(got.collect()) == key(want)


def test_top_k_small_blocks(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(rows, "vec_id", "embedding", F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(rows.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


# --- Suffix arrays -------------------------------------------------------------------------

def plain_windows(rows, least):
    """id -> words in a window of `least` words that occurs earlier, by (id, place)."""
    seen, need = {}, defaultdict(set)
    for i, t in rows:
        words = WORD.findall(t or "")
        for p in range(len(words) - least + 1):
            if seen.setdefault(tuple(words[p:p + least]), (i, p)) != (i, p):
                need[i] |= set(range(p, p + least))
    return {i: w for i, w in need.items() if w}


def test_repeats(spark, texts):
    r = random.Random(4)
    rows = [(i, t) for i, t in dict(texts).items() if i is not None]
    parts = [prose(r.randint(20, 120), 3000 + n) for n in range(12)]
    rows += [(100 + n, prose(r.randint(0, 40), 5000 + n) + " " + r.choice(parts) + " " + prose(r.randint(0, 40), 6000 + n)) for n in range(60)]
    want = plain_windows(sorted(rows), 50)
    got = defaultdict(set)
    whole = dict(rows)
    for x in suffixes.repeats(frame(spark, rows).repartition(5)).collect():
        words = list(WORD.finditer(whole[x["doc_id"]]))
        inside = [n for n, m in enumerate(words) if x["start"] <= m.start() and m.end() <= x["end"]]
        assert len(inside) == x["n_words"] >= 50 and words[inside[0]].start() == x["start"] and words[inside[-1]].end() == x["end"]
        got[x["doc_id"]] |= set(inside)
    assert dict(got) == want


def test_repeats_behind_an_earlier_part_of_them(spark):
    """A document that holds only a part of a passage hides no later copy of the whole."""
    rows = []
    for n in range(40):
        for size, a, b in ((55, 3, 52), (60, 8, 52), (69, 10, 59), (50, 0, 49)):
            words = prose(size, 9000 + 10 * n + size).split()[:size]
            for part in (words[a:b], words, words):
                i = len(rows)
                rows.append((i, " ".join([prose(25, 20000 + i), *part, prose(25, 40000 + i)])))
    want = plain_windows(rows, 50)
    got = {}
    for x in suffixes.repeats(frame(spark, rows).repartition(5)).collect():
        words = [m.start() for m in WORD.finditer(rows[x["doc_id"]][1])]
        got.setdefault(x["doc_id"], set()).update(n for n, at in enumerate(words) if x["start"] <= at < x["end"])
    assert got == want


def test_cut_repeats(docs, texts):
    cut = suffixes.cut_repeats(docs)
    assert cut.columns == SCHEMA.replace(",", "").split()[::2]
    got = {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] is not None}
    want = plain_windows(sorted((i, t) for i, t in dict(texts).items() if i is not None), 50)
    for i, t in dict(texts).items():
        if i is None:
            continue
        words = WORD.findall(t or "")
        left = [w for n, w in enumerate(words) if n not in want.get(i, ())]
        if i not in want:
            assert got[i] == t
        elif left:
            assert WORD.findall(got[i]) == left
        else:
            assert i not in got


def test_minimisers_of_a_passage_are_shared():
    h = suffixes._Hashes()
    passage = prose(50, 77).split()[:50]
    a, b = prose(100, 78).split() + passage, passage + prose(100, 79).split()
    pick = [set(suffixes.kept_suffixes([w.encode() for w in x], h, 50, 30)[1].tolist()) for x in (a, b)]
    assert pick[0] & pick[1]


# --- Classifier ----------------------------------------------------------------------------

def test_classifier(spark):
    good = [(i, prose(80, 7000 + i)) for i in range(150)]
    bad = [(1000 + i, prose(60, 8000 + i).upper().replace(" ", "!! ")) for i in range(150)]
    awkward = [(5000, None), (5001, ""), (5001, ""), (None, "x"), (5002, good[0][1] * 50)]
    docs = frame(spark, good + bad + awkward)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(7, None, None), (None, 1, 0), (999999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    s = classifier.Settings(buckets=1 << 14, epochs=4)
    model = classifier.fit(docs, labels, s)
    got = classifier.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 5000]
    assert len(held) > 30 and np.mean([(r["score"] >= 0.5) == (r["doc_id"] < 1000) for r in held]) >= 0.95


def test_classifier_sees_no_held_out_label(spark):
    rows = frame(spark, [(i, prose(30, i)) for i in range(60)])
    flip = F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("doc_id") % 2).otherwise(F.col("doc_id") % 2)
    labels = rows.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    s = classifier.Settings(buckets=1 << 10, epochs=1)
    a, b = (classifier.fit(rows, x, s) for x in (labels, rows.select("doc_id", flip.alias("quality"))))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_classifier_scores_match_the_features():
    s = classifier.Settings(buckets=1 << 10)
    m = classifier.Model(s, np.random.default_rng(0).normal(0, 3, s.buckets).astype(np.float32), 0.25)
    for t in ("", "one", "one two", prose(200, 5)):
        ids = classifier.Features(s).buckets(t)
        want = m.score(float(m.weight[ids].mean()) if len(ids) else 0.0)
        assert classifier.score_texts(m, [t], classifier._WordScores(m))[0] == pytest.approx(want, abs=1e-5)


def test_classifier_without_labels(spark, docs):
    model = classifier.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in classifier.score(docs, model).collect()} == {0.5}


# --- Packing -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_packing(docs, texts, word_tokenizer):
    got = packing.pack(docs).collect()
    want = []
    for i, t in texts:
        ids = word_tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want.append((i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert key(r[:5] for r in got) == key(want)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in places.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_word_ids(word_tokenizer):
    r = random.Random(3)
    words = packing.WordIds(packing.default_path(), cached=50)
    bits = ["a", "The", "LL", " ", "\n", "!", "'s", "'LL", "1", "é", "é", "日本", " ", "\x1c", "\x85", "😀", "ΑΣ", "İ", "ß",
            "<|endoftext|>", "<|startoftext|>", "<|", "क्ष", "ﬁ", "Ǆ"]
    for _ in range(1500):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(packing.text_ids(words, t), "<u4").tolist() == word_tokenizer.encode(t, add_special_tokens=False).ids


def test_planner_uses_every_count_and_fills_exactly():
    r = np.random.default_rng(2)
    for _ in range(20):
        counts = np.zeros(101, np.int64)
        counts[r.integers(1, 101, 12)] = r.integers(1, 40, 12)
        plan = packing.Planner(counts, 100).plan()
        filled = defaultdict(int)
        for length in np.flatnonzero(counts):
            rows = plan[plan[:, 0] == length]
            ends = [*rows[1:, 1], counts[length]]
            for (_, first, uses, seq, offset), end in zip(rows, ends):
                for rank in range(first, end):
                    filled[seq + (rank - first) // uses] += length
        assert sum(filled.values()) == (counts * np.arange(101)).sum() and max(filled.values()) <= 100
    # 40 + 35 + 25 fill 100 exactly; first-fit by size alone would put 60 + 40 and leave gaps.
    counts = np.zeros(101, np.int64)
    counts[[60, 25, 15, 40, 35]] = [3, 3, 3, 2, 2]
    assert packing.Planner(counts, 100).plan()[:, 3].max() + 1 <= 5


def test_sums_find_a_combination_whenever_there_is_one():
    r = random.Random(6)
    for _ in range(15):
        left = np.zeros(61, np.int64)
        for n in r.sample(range(1, 61), 9):
            left[n] = r.randint(1, 3)
        sums = packing.Sums(left, 60)
        while left.any():
            used = Counter()
            for n in r.choices(np.flatnonzero(left).tolist(), k=r.randint(0, 2)):
                used[n] += used[n] < left[n]
            free = [n for n in range(61) for _ in range(int(left[n]) - used[n])]
            for total in range(1, 61):
                want = {size: any(sum(c) == total for c in combinations(free, size)) for size in (1, 2, 3)}
                two, three = sums.pair(total, used), sums.triple(total, used)
                assert (two is not None, three is not None) == (want[2], want[3])
                found = sums.exact(total, used)
                assert (found is not None) == any(want.values())
                for c in filter(None, (two, three, found)):
                    assert sum(c) == total and not Counter(c) - Counter(free)
            left[r.choice(np.flatnonzero(left).tolist())] -= 1


# --- All -----------------------------------------------------------------------------------

def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert rules.measure(none).count() == 0 and rules.keep_good(none).count() == 0
    assert secrets.scan(none).count() == 0 and secrets.masked(none).count() == 0
    assert bpe.encode(none).count() == 0
    assert suffixes.repeats(none).count() == 0 and suffixes.cut_repeats(none).count() == 0
    assert classifier.score(none, classifier.fit(none, labels)).count() == 0
    assert packing.pack(none).count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, texts, word_tokenizer):
    """All stages against plain versions."""
    import corpus_pipeline
    left = [(i, t) for i, t in dict(texts).items() if i is not None]
    docs = frame(spark, left, "")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, None), name)
    left = [(i, t) for i, t in left if plain_rules(t)[-1]]
    label, seen, stay = plain_components([plain_print(t) for _, t in left]), set(), []
    for (i, t), g in zip(left, label):
        if g not in seen:
            seen.add(g)
            stay.append((i, t))
    want_cut, lengths = plain_windows(stay, 50), {}
    for i, t in stay:
        words = list(WORD.finditer(t))
        gone = want_cut.get(i, set())
        runs = [n for n in sorted(gone) if n - 1 not in gone], [n for n in sorted(gone) if n + 1 not in gone]
        for a, e in reversed(list(zip(*runs))):
            t = t[:words[a].start()] + t[words[e].end():]
        if t.strip():
            t = secrets.mask(t, secrets.find(t))
            lengths[i] = len(word_tokenizer.encode(t, add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in docs.collect():
        got[r["doc_id"]] += r["length"]
    assert dict(got) == lengths and len(lengths) > 5
