"""Reader state, the session ledger, structured responses and request batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions import text
from bookloom.operators.common import numbered
from bookloom.operators.identity import pair_index

STATE_TYPE = """n_target bigint, page_budget struct<target_avg: double, cap: double>,
commitment_load struct<long_series_cap: bigint>, floors struct<indie: bigint, classic: bigint,
genres: map<string, bigint>>, preferences struct<series_commitment: string,
expansion_appetite: string, curiosity_targets: array<string>, audio_flagged: boolean,
audio_preference: boolean>, taste_vectors array<struct<name: string, weight: double,
status: string, canonical_signals: array<string>, themes: array<string>,
example_titles: array<string>>>, events array<struct<type: string, key: string, vector: string,
genre: string, title: string, ts: string>>, session_notes array<struct<kind: string, key: string,
title: string>>, negative_signals array<struct<kind: string, canonical: string>>, _bad string"""

# Record validators.
ROLES = ["standalone", "first", "mid", "late", "loose-entry", "loose-mid"]
FIRST_YEAR, LAST_YEAR = 1000, 2100


def _allowed(c: str, options: list[str], default: str) -> Column:
    return F.when(F.col(c).isin(options), F.col(c)).otherwise(default)


def reader_state(raw: DataFrame, body: str = "state") -> DataFrame:
    """Parse state JSON, fill defaults and lift version 1 to version 2.  `bad_state` marks
    text that is no JSON object or holds a value of the wrong type: its defaults are not
    the reader's."""
    s = raw.withColumn("s", F.from_json(body, STATE_TYPE, {"columnNameOfCorruptRecord": "_bad"}))
    audio = (F.coalesce("s.preferences.audio_flagged", F.lit(False))
             | F.coalesce("s.preferences.audio_preference", F.lit(False)))

    def or_empty(c, kind):
        return F.coalesce(c, F.array().cast(kind)).alias(c.split(".")[-1])
    types = {f.name: f.dataType for f in s.schema["s"].dataType.fields}
    return s.select(
        *[c for c in raw.columns if c != body],
        F.lit(2).cast("bigint").alias("version"),
        F.coalesce("s.n_target", F.lit(100)).cast("bigint").alias("n_target"),
        F.coalesce(F.nullif("s.page_budget.target_avg", F.lit(0.0)),
                   "s.page_budget.cap").alias("page_target"),
        F.col("s.commitment_load.long_series_cap").alias("long_series_cap"),
        F.col("s.floors").alias("floors"),
        _allowed("s.preferences.series_commitment", ["binary", "test-first"], "binary")
        .alias("series_commitment"),
        _allowed("s.preferences.expansion_appetite", ["high", "moderate", "low"], "moderate")
        .alias("expansion_appetite"),
        F.coalesce("s.preferences.curiosity_targets", F.array().cast("array<string>"))
        .alias("curiosity_targets"),
        audio.alias("audio_flagged"), audio.alias("audio_preference"),
        (F.col("s").isNull() | F.col("s._bad").isNotNull()).alias("bad_state"),
        *[or_empty(f"s.{c}", types[c]) for c in ("taste_vectors", "events", "session_notes",
                                                 "negative_signals")])


LEDGER_TYPE = """reader_id bigint, title string, author string, batch_id string, status string,
ts string, primary_genre string, indie boolean, classic boolean, pages bigint"""


def ledger_scan(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows; lines that are not a JSON record are dropped."""
    return spark.read.schema(LEDGER_TYPE).option("mode", "DROPMALFORMED").json(path)


def ledger_rows(marks: DataFrame, items: DataFrame) -> DataFrame:
    """Marks ready to append: normalised pair added, and item fields filled in where
    the caller left them out."""
    old = text.norm_keep_subtitle
    known = pair_index(items).join(items.select(
        "item_key", *[F.col(c).alias(f"_{c}") for c in ("primary_genre", "indie", "classic", "pages")]),
        "item_key")
    named = marks.withColumns({"title_norm": old("title"), "author_norm": old("author"),
                               "status": F.coalesce("status", F.lit("shown"))})
    filled = named.join(known, ["title_norm", "author_norm"], "left")
    return filled.select(
        *[c for c in named.columns if c not in ("primary_genre", "indie", "classic", "pages")],
        *[F.coalesce(c, f"_{c}").alias(c) for c in ("primary_genre", "indie", "classic", "pages")])


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def response_map(body: str) -> Column:
    """The JSON object of a response as key -> variant: the first fenced block, else
    first ``{`` to last ``}``; null when neither parses."""
    kind = "map<string, variant>"
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)

    def parsed(c):
        # A map from a broken text may come back partly filled: ask for a whole parse first.
        return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, kind))
    return F.coalesce(parsed(fenced), parsed(braces))


def response_values(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc, raw_key, value) with value as a variant."""
    return docs.select(doc, F.explode(response_map(body)).alias("raw_key", "value"))


def _is(kind: str) -> Column:
    return F.schema_of_variant("value") == kind


def valid_years(rows: DataFrame) -> DataFrame:
    """Null, a whole number, or a numeric string, within range; the rest is dropped."""
    number = (F.when(_is("BIGINT"), F.try_variant_get("value", "$", "bigint"))
              .when(_is("STRING"), F.trim(F.try_variant_get("value", "$", "string")).try_cast("bigint")))
    kept = rows.withColumn("year", number).filter(
        _is("VOID") | F.col("year").between(FIRST_YEAR, LAST_YEAR))
    return kept.drop("value")


def valid_flags(rows: DataFrame) -> DataFrame:
    """True, false or null; the rest is dropped."""
    return (rows.filter(_is("VOID") | _is("BOOLEAN"))
            .withColumn("flag", F.try_variant_get("value", "$", "boolean")).drop("value"))


def valid_entry_points(rows: DataFrame) -> DataFrame:
    """Role from the closed list (else null) and the three-valued entry-point flag."""
    role = F.try_variant_get("value", "$.series_role", "string")
    return rows.select(*[c for c in rows.columns if c != "value"],
                       F.when(role.isin(ROLES), role).alias("series_role"),
                       F.try_variant_get("value", "$.author_entry_point", "boolean").alias("entry_point"))


def valid_ids(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Phrase -> closed-list ID; an unknown ID becomes null."""
    named = rows.withColumn("canonical_id", F.when(_is("STRING"), F.try_variant_get(
        "value", "$", "string"))).drop("value")
    known = vocabulary.select(F.col("tag").alias("canonical_id")).distinct().withColumn("_known", F.lit(True))
    return named.join(known, "canonical_id", "left").withColumn(
        "canonical_id", F.when(F.col("_known"), F.col("canonical_id"))).drop("_known")


def valid_lists(rows: DataFrame) -> DataFrame:
    """(doc, raw_key, pos, pick): string members of list values."""
    members = F.try_variant_get("value", "$", "array<variant>")
    each = rows.select(*[c for c in rows.columns if c != "value"],
                       F.posexplode(members).alias("pos", "value"))
    return each.filter(_is("STRING")).withColumn(
        "pick", F.try_variant_get("value", "$", "string")).drop("value")


def request_batches(items: DataFrame, size: int = 20) -> DataFrame:
    """(chunk, n_rows, prompt): pending rows packed `size` at a time, each with its
    pinned fields as JSON.  Null and blank fields are left out."""
    pinned = ["series", "series_position", "series_status", "pages", "rating"]
    context = F.to_json(F.struct(*[F.nullif(c, F.lit("")).alias(c) if t == "string" else F.col(c)
                                   for c, t in items.dtypes if c in pinned],
                                 F.nullif("primary_genre", F.lit("")).alias("genre_hint")))
    rows = numbered(items.select("item_key", "title", "author", context.alias("context")), ["item_key"])
    rows = rows.withColumns({"chunk": F.floor(F.col("n") / size).cast("bigint"),
                             "line_no": (F.col("n") % size + 1).cast("bigint")})
    line = F.concat(F.col("line_no").cast("string"), F.lit(". "), "title", F.lit(" by "), "author",
                    F.when(F.col("context") != "{}", F.concat(F.lit("\n   Context: "), "context"))
                    .otherwise(""))
    packed = F.array_sort(F.collect_list(F.struct("line_no", line.alias("line"))))
    return rows.groupBy("chunk").agg(F.count("*").alias("n_rows"),
                                     F.array_join(packed["line"], "\n\n").alias("prompt"))
