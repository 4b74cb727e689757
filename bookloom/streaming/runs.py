"""Live forms: probes while events arrive, and the session ledger as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bookloom.operators import identity
from bookloom.operators.reader import RUN_LENGTH

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROBE_TYPE = "reader_id bigint, seq bigint, run_value string, n bigint, late boolean"


class RunProcessor(StatefulProcessor):
    """Per reader: the value and length of the current tail run, and the last event seen.

    Emits a row each time a rejection brings the run to the threshold or beyond; an
    accept clears it, another value starts a new one.  The events of one trigger may come
    as several batches in any order: they are put in order first, so bound a trigger with
    maxFilesPerTrigger if one reader can bring a great many.  An event that is not after
    the last one of an earlier trigger is late: it is passed on as such and changes nothing.
    """

    def __init__(self, at_least: int = RUN_LENGTH):
        self.at_least = at_least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "value string, n bigint, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        value, n, seen = self.run.get() if self.run.exists() else (None, 0, None)
        events = pd.concat(list(rows)).sort_values("seq")
        out, before = [], seen
        for seq, kind, tag in events[["seq", "type", "value"]].itertuples(index=False):
            if before is not None and seq <= before:
                out.append((key[0], seq, tag, None, True))
                continue
            seen = seq
            if kind == "accepted":
                value, n = None, 0
            elif tag:
                value, n = (tag, n + 1) if tag == value else (tag, 1)
                if n >= self.at_least:
                    out.append((key[0], seq, value, n, False))
        self.run.update((value, n, seen))
        yield pd.DataFrame(out, columns=["reader_id", "seq", "run_value", "n", "late"]).astype({"n": "Int64"})

    def close(self) -> None:
        pass


def live_probes(events: DataFrame, at_least: int = RUN_LENGTH) -> DataFrame:
    """Stream of run rows (late = false) and late events from a stream of (reader_id, seq,
    type, vector, genre).  Needs the RocksDB state store provider."""
    value = F.coalesce(F.nullif("vector", F.lit("")), F.nullif("genre", F.lit("")))
    rows = events.select("reader_id", "seq", "type", value.alias("value")).filter(
        (F.col("type") == "accepted") | ((F.col("type") == "rejected") & F.col("value").isNotNull()))
    return rows.groupBy("reader_id").transformWithStateInPandas(
        statefulProcessor=RunProcessor(at_least), outputStructType=PROBE_TYPE, outputMode="append", timeMode="None")


def live_ledger(marks: DataFrame, items: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream of ledger rows without repeats: a mark seen again inside the delay is
    dropped, and the item's fields are filled in from the static catalogue."""
    once = marks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["reader_id", "seq"])
    facts = identity.pair_index(items).join(items.select("item_key", "primary_genre", "indie", "classic", "pages"),
                                            "item_key")
    from bookloom.functions.text import norm_keep_subtitle
    named = once.withColumns({"title_norm": norm_keep_subtitle("title"), "author_norm": norm_keep_subtitle("author")})
    return named.join(facts, ["title_norm", "author_norm"], "left")
