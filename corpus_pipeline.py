"""A training-data pipeline over `documents`: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.llm import bpe, decontaminate, near_dedup, queries, substring_dedup, toxicity
from siftworks.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the model learns from the labelled rows that aren't held out."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, queries.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of the least doc_id."""
    return near_dedup.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that recur go; documents stay, with what is left of their text."""
    aside = {c: f"column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    cut = substring_dedup.dedup_substrings(docs.withColumnsRenamed(aside), results=("n_removed", "kept_text"), with_text=False)
    columns = {c: F.col(aside.get(c, c)) for c in docs.columns} | {"text": F.col("kept_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(columns["n_chars"])
    return cut.select(*(column.alias(name) for name, column in columns.items()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of them and of the decoded text."""
    return bpe.encode_documents(docs.select("doc_id", "text"), queries.vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL expresses neither the learned scores nor the classes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
