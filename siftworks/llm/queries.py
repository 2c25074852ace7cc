"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, centroids, chat, decontaminate, near_dedup, prefix_trie, quality, substring_dedup, suffix_dedup, token_store, toxicity, url_filter

VOCABULARY = "word_bpe_49k.json"
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Host labels whose pages make the list of blocked keys.
BLOCKED_LABELS = ["spam-farm", "cheap-pills", "free-bets", "ads-track", "casino-win", "adult-x"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return str(public_tokenizers.path(VOCABULARY))


def blocked_keys(pages: DataFrame) -> DataFrame:
    """host+path of the pages on hosts with a blocked label."""
    host = url_filter.url_host(F.col("url"))
    return pages.filter(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, BLOCKED_LABELS)))).select(F.concat(host, url_filter.url_path(F.col("url"))).alias("key"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, blocked_keys(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.phrase_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs, results=("n_words", "n_removed", "kept_sha256"), with_text=False)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return token_store.read_tokens(spark, folder, with_ids=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered as mail with nested quotes, and linked and ordered again from those quotes."""
    return chat.format_chats(chat.as_mail(table(spark, sf_dir, "conversations"))).withColumnRenamed("msg_id", "turn")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("entered", "left")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("centroid_sha256", centroids.centroid_digest(F.col("centroid"))).drop("centroid")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_bytes(docs, with_kept=False).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_decontamination, op3_substring_dedup, op4_bpe, op5_minhash, op6_token_store, op7_quality,
        op8_nearest, op9_toxicity, op10_chat, op11_prefix_trie, op12_centroids, op13_suffix_dedup,
    )
}
