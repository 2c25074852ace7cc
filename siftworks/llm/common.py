"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python task holds at a time.
BUCKET_BYTES = 6_000_000
#: Bytes of compressed files of a table that may be broadcast.
SMALL_BYTES = 8_000_000
#: Spark's setting that deletes a query's shuffle files when the query ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="siftworks-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def free_name(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """`df` written to the shared folder, in a folder for each value of `by`, and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # the shuffles of this write are never read again
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by stored() or kept() that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(table: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """A table made by stored() or kept(), marked for broadcast if its files have at most `limit` bytes; else Spark joins it as it sees fit."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    files = path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf())
    return F.broadcast(table) if files.getContentSummary(path).getLength() <= limit else table


def kept(df: DataFrame) -> DataFrame:
    """A small table, written and read back: cheaper than checkpoint(), which computes its rows twice."""
    return stored(df, "small")


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets of about BUCKET_BYTES of text, at least as many as shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def pieces(batch, column: str = "text", limit: int = 4_000_000, lines: int | None = None):
    """Slices of an Arrow batch with about `limit` bytes of text, and `lines` lines, each; a longer row stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    if lines:
        breaks = pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = part + np.cumsum(breaks + 1) // lines
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
