"""CSV scans and sinks, and the nested and star forms of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions import text, values
from bookloom.operators.common import fresh_path

# Library CSV headers and our column names.
LIBRARY_COLUMNS = {
    "title": "title", "authors": "authors", "#pages": "pages", "#grvotes": "reviews",
    "#modrating": "rating", "series": "series", "series_index": "series_index",
    "#series_type": "series_type", "pubdate": "pubdate", "pub_year": "pub_year",
    "tags": "tags", "#genre": "genre", "#more_tags": "more_tags",
}
# Reading-log CSV headers and our column names.
LOG_COLUMNS = {
    "title": "title", "authors": "author", "my rating": "rating_text",
    "last date read": "date_text", "my_tags": "my_tags", "genre": "genre",
    "series_type": "series_type", "goodreads_shelves": "shelves",
}
# The fields of the slim browse index.
INDEX_FIELDS = ["title", "author", "series", "series_status", "series_role",
                "author_entry_point", "primary_genre"]

ENTRY_TYPE = ("struct<title: string, author: string, series: string, series_position: string, "
              "primary_genre: string, pages: bigint, rating: double, indie: boolean, "
              "classic: boolean, taste_signals: struct<positive: array<string>, "
              "negative: array<string>>, themes: array<string>, content_flags: array<string>, "
              "comparable_books: array<string>>")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, headers lower-cased and stripped, blanks null.  Quoted
    cells may hold commas, quotes and line breaks."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip().lower())
                        for c in raw.columns])


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    kept = [F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns]
    absent = [F.lit(None).cast("string").alias(n) for h, n in names.items() if h not in df.columns]
    return df.select(*kept, *absent)


def library_csv(spark: SparkSession, path: str) -> DataFrame:
    """Library rows that have both a title and an author field."""
    return _renamed(read_csv(spark, path), LIBRARY_COLUMNS).filter(
        F.col("title").isNotNull() & F.col("authors").isNotNull())


def log_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reading log with parsed rating and date beside the original text."""
    return _renamed(read_csv(spark, path), LOG_COLUMNS).withColumns(
        {"rating": values.parse_rating("rating_text"), "read_on": values.parse_date("date_text")})


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with every body cell quoted."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"') \
        .option("nullValue", "").option("emptyValue", "").mode("errorifexists").csv(path)


def stacked(base: DataFrame, proposal: DataFrame, key: str) -> DataFrame:
    """Base rows with every proposed value laid over them; columns the proposal
    lacks, and nulls in it, leave the base as it is."""
    laid = [c for c in base.columns if c in proposal.columns and c != key]
    over = proposal.select(key, *[F.col(c).alias(f"_new_{c}") for c in laid])
    return base.join(over, key, "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in laid else F.col(c) for c in base.columns])


def catalogue_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of nested catalogue files: {"entries": {key: entry}} in any number of files."""
    docs = spark.read.schema(f"entries map<string, {ENTRY_TYPE}>").json(path)
    return docs.select(F.explode("entries").alias("item_key", "entry"))


def star_items(nested: DataFrame) -> DataFrame:
    """One row per entry: scalar fields plus normalised title, short title, author."""
    e = nested.select("item_key", "entry.*")
    return e.select("item_key", "title", text.norm("title").alias("title_norm"),
                    text.title_short("title").alias("title_short"), "author",
                    text.norm("author").alias("author_norm"), "series", "series_position",
                    "primary_genre", "pages", "rating", "indie", "classic")


def star_children(nested: DataFrame) -> DataFrame:
    """(item_key, child, pos, value) for every list of an entry, blanks skipped."""
    lists = {"positive": "entry.taste_signals.positive", "negative": "entry.taste_signals.negative",
             "theme": "entry.themes", "flag": "entry.content_flags",
             "link": "entry.comparable_books"}
    tagged = F.array(*[F.struct(F.lit(n).alias("child"), F.col(c).alias("list"))
                       for n, c in lists.items()])
    return (nested.select("item_key", F.explode(tagged).alias("t"))
            .select("item_key", "t.child", F.posexplode("t.list").alias("pos", "value"))
            .filter(F.coalesce("value", F.lit("")) != ""))


def rebuild(items: DataFrame, children: DataFrame) -> DataFrame:
    """(item_key, entry): the nested form again, lists in their stored order."""
    def listed(child):
        rows = F.array_sort(F.collect_list(F.when(F.col("child") == child, F.struct("pos", "value"))))
        return rows["value"]
    lists = children.groupBy("item_key").agg(
        *[listed(c).alias(f"_{c}") for c in ("positive", "negative", "theme", "flag", "link")])
    empty = F.array().cast("array<string>")

    def part(c):
        return F.coalesce(f"_{c}", empty)
    entry = F.struct(
        "title", "author", "series", "series_position", "primary_genre", "pages", "rating",
        "indie", "classic",
        F.struct(part("positive").alias("positive"), part("negative").alias("negative"))
        .alias("taste_signals"),
        part("theme").alias("themes"), part("flag").alias("content_flags"),
        part("link").alias("comparable_books"))
    return items.join(lists, "item_key", "left").select("item_key", entry.alias("entry"))


def slim_index(items: DataFrame, links: DataFrame) -> DataFrame:
    """The browse index: eight fields, links as an ordered list."""
    lists = links.groupBy(F.col("src_key").alias("item_key")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "dst_key")))["dst_key"].alias("comparable_books"))
    return items.select("item_key", *INDEX_FIELDS).join(lists, "item_key", "left")


def bucketed(df: DataFrame, label: str, key: str = "item_key", buckets: int = 32) -> DataFrame:
    """The frame as a table bucketed and sorted by `key`, in the shared folder: joins and
    groupings on the key need no exchange on its side.  Repeated values of one key lie in one
    bucket, so choose a key that no third of the rows shares."""
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", fresh_path(df.sparkSession, label)).saveAsTable(name)
    return df.sparkSession.table(name)
