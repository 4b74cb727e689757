"""Secrets in texts: patterns, and the guess cost of values that follow credential words."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import DOCUMENTS, arrow_map
from bookloom.operators.common import settle

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex", "guess")

#: Words that say a credential follows, then how it may follow, then the value.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth|login)["']?"""
                     r"""(?:\x20*[:=]\x20*|\x20+is\x20+)["']?([^\s"'<>,;]{6,})""", re.ASCII | re.IGNORECASE)
_HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "auth", "login")

#: Frequent password words, most frequent first; a word's rank is its guess count.
WORDS = """password pass word admin user login welcome letmein monkey dragon master shadow sunshine princess
football baseball iloveyou trustno hello test guest root changeme default secret qwerty superman batman summer
winter spring autumn love money freedom computer internet server access system database example sample demo
orange apple banana coffee cookie cheese flower pepper ginger silver golden purple yellow green black white blue
red tiger eagle killer hunter ranger soccer hockey jordan michael charlie thomas robert daniel andrew jessica
ashley january february march april may june july august september october november december monday tuesday
wednesday thursday friday saturday sunday the and for not you with this that""".split()
COLUMNS = ["1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "8ik", "9ol"]
ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz"]
LEET = str.maketrans("4301$5@7", "aeolssat")
GUESS_BITS = 40.0
_SEGMENT_BITS = 1.0
#: The corpus's own words: the commonest WORD_COUNT that stand in WORD_DOCS documents or more.
WORD_COUNT, WORD_DOCS, WORD_CHARS = 50_000, 3, 24
#: Longest block whose repeats are known.
BLOCK = 16


@functools.cache
def _tables() -> tuple[dict[str, float], dict[tuple[str, str], bool], int]:
    ranks = {w: math.log2(n + 2) for n, w in enumerate(dict.fromkeys(WORDS))}
    return ranks, _steps(ROWS), max(map(len, ranks))


def _steps(lines: list[str]) -> dict[tuple[str, str], bool]:
    return {p: True for line in lines for way in (line, line[::-1]) for p in zip(way, way[1:])}


class Known:
    """Words of password lists and of a corpus, both by rank, with their guess costs."""

    def __init__(self, words: list[str] = ()) -> None:
        common, self.near, _ = _tables()
        self.down = _steps(COLUMNS)
        self.ranks = {w: math.log2(n + 2) for n, w in enumerate(words)}
        self.ranks |= {w: min(bits, self.ranks.get(w, bits)) for w, bits in common.items()}
        self.longest = max(map(len, self.ranks))


@functools.cache
def _listed() -> Known:
    return Known()


def _char_bits(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


def _date_bits(s: str) -> float | None:
    """Years, and days written as eight or six digits in any common order."""
    if not s.isdigit():
        return None
    if len(s) == 4 and 1900 <= int(s) <= 2049:
        return math.log2(150)
    if len(s) in (6, 8):
        y = len(s) - 4
        for year, a, b in ((s[:y], s[y:y + 2], s[y + 2:]), (s[4:], s[:2], s[2:4])):
            full = y == 2 or 1900 <= int(year) <= 2049
            if full and (1 <= int(a) <= 12 and 1 <= int(b) <= 31 or 1 <= int(b) <= 12 and 1 <= int(a) <= 31):
                return math.log2(366 * (100 if y == 2 else 150) * 2)
    return None


def guess_bits(value: str, known: Known | None = None, block: int = 1) -> float:
    """log2 of the guesses that the cheapest reading of the value takes: segments that are
    frequent words (also in capitals or with look-alike digits), dates, repeats of one
    character or of blocks of up to `block`, walks along a keyboard or alphabet row or down
    or up a keyboard column, or single brute-force characters.

    best[j] is the least cost of the first j characters.  Words are at most as long as the
    longest known one and a repeat or walk only ever extends the run ending at j, so the
    time is linear in the value's length.
    """
    known = known or _listed()
    ranks, near, down, longest = known.ranks, known.near, known.down, known.longest
    low = value.lower()
    if len(low) != len(value):
        low = value
    leet = low.translate(LEET)
    best, same, walk, fall = [0.0], 0, 0, 0
    again = [0] * (block + 1)
    for j in range(1, len(value) + 1):
        c = low[j - 1]
        same = same + 1 if j > 1 and low[j - 2] == c else 1
        walk = walk + 1 if j > 1 and (low[j - 2], c) in near else 1
        fall = fall + 1 if j > 1 and (low[j - 2], c) in down else 1
        cost = best[j - 1] + _char_bits(value[j - 1]) + (0.0 if value[j - 1] == c else 1.0)
        if same >= 3:
            cost = min(cost, best[j - same] + _char_bits(c) + math.log2(same) + _SEGMENT_BITS)
        for steps in (walk, fall):
            if steps >= 3:
                cost = min(cost, best[j - steps] + math.log2(2 * 47) + math.log2(steps) + _SEGMENT_BITS)
        for n in range(2, min(block, j - 1) + 1):
            # As many characters as there are equal the ones n before them.
            again[n] = again[n] + 1 if value[j - 1] == value[j - 1 - n] else 0
            if again[n] >= n and (times := again[n] // n):
                cost = min(cost, best[j - n * times] + math.log2(block) + math.log2(times + 1) + _SEGMENT_BITS)
        for i in range(max(0, j - longest), j - 2):
            for form in (low, leet):
                if (bits := ranks.get(form[i:j])) is not None:
                    changed = (value[i:j] != low[i:j]) + (low[i:j] != form[i:j])
                    cost = min(cost, best[i] + bits + 2.0 * changed + _SEGMENT_BITS)
        for n in (4, 6, 8):
            if j >= n and (bits := _date_bits(value[j - n:j])) is not None:
                cost = min(cost, best[j - n] + bits + _SEGMENT_BITS)
        best.append(cost)
    return best[-1]


def corpus_words(docs: DataFrame, count: int = WORD_COUNT, least_docs: int = WORD_DOCS) -> list[str]:
    """The commonest words of the texts, lower-cased letters only, by the number of texts
    that hold them.  What follows a credential word is not counted, so that a secret in
    many copies does not become a word.  At most `count` words of WORD_CHARS letters reach
    the driver and the workers; of words equally common all or none do."""
    outside = F.regexp_replace(F.lower("text"), "(?i)" + CONTEXT.pattern, " ")
    words = F.array_distinct(F.regexp_extract_all(outside, F.lit(r"(?<![\p{L}\p{N}])(\p{L}{3,%d})(?![\p{L}\p{N}])" % WORD_CHARS), F.lit(1)))
    found = settle(docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(
        F.col("n") >= least_docs), "words")
    # How many words are how common tells where to stop, before any word is collected.
    total, least = 0, None
    for n, some in sorted(found.groupBy("n").agg(F.count("*")).collect(), reverse=True):
        if (total := total + some) > count:
            break
        least = n
    return [w for w, n in sorted(found.filter(F.col("n") >= least).collect(), key=lambda r: (-r[1], r[0]))] if least else []


def find(text: str, least_bits: float = GUESS_BITS, known: Known | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: code points, end exclusive.  Base kinds are
    whole matches; `guess` is the value after a credential word if guessing it costs at
    least 2**least_bits tries."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
        out += [("guess", *m.span(1)) for m in CONTEXT.finditer(text) if guess_bits(m[1], known, BLOCK) >= least_bits]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def mask(text: str, spans: list[tuple[str, int, int]], filler: str = "[SECRET]") -> str:
    """The text with each stretch covered by spans replaced once."""
    out, done = [], 0
    for _, a, b in spans:
        if a >= done:
            out += [text[done:a], filler]
        done = max(done, b)
    return "".join(out) + text[done:] if spans else text


def scan(docs: DataFrame, least_bits: float = GUESS_BITS) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>> for every row.  Null texts count as empty
    (no spans); very long ones are scanned whole, by one task each, in time that grows with
    the length of the values after credential words; repeated rows are scanned alike; other
    columns are ignored.  The texts' own
    frequent words count as guessable."""
    words = corpus_words(docs)

    def run(batches):
        known = Known(words)
        for b in batches:
            yield {"doc_id": b["doc_id"],
                   "spans": [[dict(zip(("kind", "start", "end"), s)) for s in find(t or "", least_bits, known)] for t in b["text"]]}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, "doc_id long, spans array<struct<kind:string,start:int,end:int>>", run)


def masked(docs: DataFrame, least_bits: float = GUESS_BITS, filler: str = "[SECRET]") -> DataFrame:
    """The columns of documents with every secret replaced by `filler` and n_chars counted
    anew there; rows without one are unchanged, null texts stay null."""
    words = corpus_words(docs)

    def run(batches):
        known = Known(words)
        for b in batches:
            texts, sizes = list(b["text"]), list(b["n_chars"])
            for i, t in enumerate(texts):
                if t and (spans := find(t, least_bits, known)):
                    texts[i] = mask(t, spans, filler)
                    sizes[i] = len(texts[i])
            yield b | {"text": texts, "n_chars": sizes}

    rows = docs.select(*DOCUMENTS)
    return arrow_map(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), run)
