"""One query per operator over the whole of its table, with oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.llm import (bpe, classifier, maxsketch, oracles, packing, rules, secrets, sharding, simhash, suffixes, suffixtree, topk,
                          warc, whitening)
from bookloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op2_sharding", oracles.SHARDS)
def op2(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op3_quality_rules", oracles.RULES)
def op3(spark, sf_dir):
    return rules.measure(table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def op4(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def joined(keep):
        return F.array_join(F.transform(F.filter("spans", keep), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"),
                        F.sha2(joined(lambda x: x["kind"].isin("assign", "access", "hex")), 256).alias("base_sha256"),
                        joined(lambda x: F.lit(True)).alias("spans"))


@query("op6_bpe")
def op6(spark, sf_dir):
    coded = bpe.encode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


@query("op10_best_fit_packing")
def op10(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op1_simhash")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_exact_top_k", oracles.TOP_K)
def op7(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding",
                      F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    return suffixes.repeats(table(spark, sf_dir, "documents")).drop("key")


@query("op5_warc", oracles.WARC)
def op5(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages")).drop("url_key")


@query("op11_max_sketch_search", oracles.RANKED)
def op11(spark, sf_dir):
    return maxsketch.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_suffix_tree_scores")
def op12(spark, sf_dir):
    return suffixtree.score(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
