"""WARC archives of pages, and capture histories merged from their sorted index runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import arrow_map
from bookloom.operators.common import fresh_path, settle

RECORDS_PER_FILE = 500
#: Index rows that one merge task holds, about.
ROWS_PER_MERGE = 100_000
# Fixed values of the formats: line end, end of a record, base-32 digits, revisit profile.
CRLF, RECORD_END = "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1_704_067_200
_NO_ID = (1 << 63) - 1


def base32_sha1(raw: Column) -> Column:
    """Bare upper-case base-32 SHA-1: 40 hex digits as four groups of 40 bits, eight digits each.
    No lambda: in one, the whole payload would be hashed again for each digit."""
    digest = F.sha1(raw)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def with_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Each page with its WARC record as text (without the final blank lines).

    Of pages with equal payloads of at least least_bytes, that of the smallest page_id (nulls
    last; of repeated rows the first) becomes a response, the others revisits without the
    payload.  Only groups of two or more are joined back, as (payload hash, first page).
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    raw = html.cast("binary")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("page"),
                        F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"),
                        F.sha2(raw, 256).alias("same"), F.octet_length(raw).cast("long").alias("size"),
                        F.monotonically_increasing_id().alias("row"))
    seen = settle(rows.filter(F.col("size") >= least_bytes).groupBy("same").agg(
        F.min(F.struct("page", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "payloads")
    known = rows.join(seen, "same", "left")
    revisit = F.col("first").isNotNull() & (F.struct("page", "row") != F.col("first"))

    # A target may hold no blanks or line ends: they would end its header line.
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "_")
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod("page", F.lit(1 << 31))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
                    F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = [("WARC-Type", kind), ("WARC-Record-ID", F.format_string("<urn:page:%d:%d>", "page", "row")),
            ("WARC-Date", date), ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html").cast("binary")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(block.cast("binary")).cast("string"))]
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in head]
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), F.format_string("<urn:page:%d:%d>", "first.page", "first.row"),
                                      F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}"))).otherwise(F.lit(""))
    return known.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, refers, F.lit(CRLF), block).alias("record"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, per_file: int = RECORDS_PER_FILE) -> None:
    """Gzipped WARC files of at most per_file records under path, one or more per task.
    Spark's committer writes them, so a task that is run again leaves nothing twice."""
    (with_records(pages, least_bytes).write.option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an unpacked archive.  Blocks are cut by
    Content-Length, so a payload may hold anything, other records' text included."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if data[stop:stop + 4] != RECORD_END.encode():
            raise ValueError(f"the record at byte {at} does not end where it should")
        yield at, head, data[start:stop]
        at = stop + 4


def url_key(url: str) -> str:
    """Sort key of a URL: reversed host name, then path and query, in lower case."""
    try:
        parts = urlsplit(url.lower())
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _page(urn: str) -> int:
    return int(urn.strip("<>").split(":")[2])


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of the archives under path, each file's sorted: run (the file), seq,
    url_key, captured, page, kind, payload_bytes, payload_digest, refers, offset.
    A response's size and digest are taken from its payload, and the digest must be the
    one its header names; a revisit has only the headers."""
    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                out = []
                for at, head, block in records(gzip.decompress(content)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, size, refers = head["WARC-Payload-Digest"].removeprefix("sha1:"), None, None
                    if head["WARC-Type"] == "response":
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                    else:
                        size = int(http.decode().rpartition("Content-Length: ")[2])
                        refers = str(_page(head["WARC-Refers-To"]))
                    out.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], _page(head["WARC-Record-ID"]), at,
                                head["WARC-Type"], size, digest, refers))
                out.sort(key=lambda r: r[:4])
                if out:
                    key, date, page, at, kind, size, digest, refers = map(list, zip(*out))
                    yield {"run": [name] * len(out), "seq": list(range(len(out))), "url_key": key, "captured": date,
                           "page": page, "offset": at, "kind": kind, "payload_bytes": size, "payload_digest": digest,
                           "refers": refers}

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return arrow_map(files, "run string, seq int, url_key string, captured string, page long, offset long, kind string, "
                     "payload_bytes long, payload_digest string, refers string", run)


class LoserTree:
    """Merges k sorted runs: inner nodes hold the loser of their match, so the next row
    takes one comparison per level on the way up from the winner's leaf."""

    def __init__(self, runs: list[Iterable[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, len(self.runs))
        for leaf in range(len(self.runs)):
            self._enter(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """An ended run loses; equal rows go by run."""
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _enter(self, leaf: int) -> None:
        """Plays the leaf upwards; while building, the first to reach a node waits there."""
        node, winner = (leaf + len(self.runs)) // 2, leaf
        while node:
            held = self.losers[node]
            if held < 0:
                self.losers[node] = winner
                return
            if self._beats(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[leaf := self.losers[0]] is not None:
            yield self.heads[leaf]
            self.heads[leaf] = next(self.runs[leaf], None)
            self._enter(leaf)


def histories(index: DataFrame, per_task: int = ROWS_PER_MERGE) -> DataFrame:
    """The index rows ordered by url_key and captured (then page, run, seq) over all
    partitions, in their order, and within each.

    Each task merges one range of the whole key, about per_task rows: every run's share of
    the range arrives sorted, and a loser tree merges the runs.  A URL with a great many
    captures is spread by time over as many ranges as it needs.  index must be written.
    """
    session, key = index.sparkSession, ["url_key", "captured", "page", "run", "seq"]
    tasks = max(-(-index.count() // per_task), int(session.conf.get("spark.sql.shuffle.partitions")))
    names = [*key, *(c for c in index.columns if c not in key)]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if not got:
            return
        rows = pd.concat(got)
        runs = [part.itertuples(index=False, name=None) for _, part in rows.groupby("run", sort=True)]
        # Rows never compare equal within their key, so later columns do not matter.
        yield pd.DataFrame(list(LoserTree(runs)), columns=names)

    ranged = index.select(names).repartitionByRange(tasks, *key).sortWithinPartitions("run", "seq")
    return ranged.mapInPandas(merge, ranged.schema)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC files in the shared folder, reads them back, and returns one row
    per page in order of capture history: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url_key, captured.

    Null html counts as empty, a null url as the empty one; very long html is one
    record, read whole; repeated rows are captures of their own; an empty table gives no rows.  The date of a capture is EPOCH plus page_id
    seconds, as pages have none.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    done = histories(settle(captures(pages.sparkSession, path), "captures"))
    return done.select(F.nullif("page", F.lit(_NO_ID)).alias("page_id"), "payload_bytes", "payload_digest",
                       F.col("kind").alias("record_type"), F.nullif(F.col("refers").cast("long"), F.lit(_NO_ID)).alias("refers_to"),
                       "url_key", "captured")
