"""Rule findings over streams: scan, deduplication within a time bound, counts by hour, and stalls.

State is bounded by the watermark everywhere: keys, hours and runs that it has passed are let go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RULES, Rule
from ..operators.scan import rule_scan
from ..sources.io import new_folder
from ..tables import to_lines

#: Rows later than this behind the newest are dropped.
LATE = "2 hours"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote; state and output stand in the shared folder."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def source(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files, the oldest first; `path` may name one file or a folder of them, with folders in it."""
    schema = spark.read.option("recursiveFileLookup", "true").parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path if _is_folder(spark, path) else f"{folder}/{name}*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def scan_documents(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Findings of arriving documents (doc_id, source, text): the batch transformation as it is."""
    files = docs.select(F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit("text").alias("lang"), F.col("text").alias("content"))
    return rule_scan(to_lines(files), rules)


def dedupe(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first of each key within the bound after it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def counts_by_hour(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """(hour, key, n) of tumbling hours; an hour comes out once the watermark has passed it."""
    hour = F.window("ts", "1 hour")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(hour.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), key, "n")


STALL = "key long, digest string, from_step long, n long"
#: Open runs of the keys of a bucket: their state.
RUNS = "anon array<boolean>, key array<long>, digest array<string>, from_step array<long>, n array<long>, step array<long>, at array<long>"
#: Buckets of keys: each is one state and one call a batch, however many keys it holds.
BUCKETS = 256


def stalls(results: DataFrame, gap: str = "1 day", least: int = 2, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """(key, digest, from_step, n): runs of equal digests of a key, by step, across batches. results: (key, step, digest, ts).

    Every batch gives the runs of `least` and more that it made longer, as they stand; longest_runs() keeps the last state
    of each. A run ends at another digest, and where a key is silent for more than `gap`. The open run of each key
    is all the state there is; it is let go once the watermark is `gap` beyond it. Rows later than the watermark are dropped. The
    steps of a key must rise with its batches. Null keys make one key; null digests, steps and times are dropped.

    Keys are dealt into `buckets` states, and the keys of a bucket are advanced together.
    """
    micros = round(results.sparkSession.range(1).select(F.expr(f"INTERVAL {gap}").cast("interval day to second").alias("i")).first().i.total_seconds() * 1_000_000)
    names = [c.split()[0] for c in RUNS.split(", ")]

    def step(_, frames, state):
        import pandas as pd

        mark = state.getCurrentWatermarkMs()
        runs = pd.DataFrame(dict(zip(names, state.get, strict=True))) if state.exists else None
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)
            rows = rows[rows["at"] >= mark * 1000]
            rows = rows.assign(from_step=rows["step"], n=1, new=True)[[*names, "new"]]
            both = rows if runs is None else pd.concat([runs.assign(new=False), rows], ignore_index=True)
            both = both.sort_values(["anon", "key", "new", "step", "at"], kind="stable", ignore_index=True)
            same = (both["key"] == both["key"].shift()) & (both["anon"] == both["anon"].shift()) & (both["digest"] == both["digest"].shift())
            # the latest time of a run is that of its whole stretch of one digest, as a run that begins anew is later than all before
            latest = both["at"].groupby((~same).cumsum()).cummax()
            begins = ~same | (both["at"] - latest.shift(fill_value=0) > micros)
            run = both.groupby(begins.cumsum(), sort=False)
            runs = run.agg({"anon": "first", "key": "first", "digest": "first", "from_step": "first", "n": "sum", "step": "last", "at": "max", "new": "any"})
            out = runs[runs["new"] & (runs["n"] >= least)]
            if len(out):
                yield out.assign(key=out["key"].astype("Int64").mask(out["anon"].astype(bool)))[["key", "digest", "from_step", "n"]]
            runs = runs.drop_duplicates(["anon", "key"], keep="last")
        runs = runs[runs["at"] + micros >= mark * 1000]
        if len(runs):
            state.update(tuple(runs[c].tolist() for c in names))
            state.setTimeoutTimestamp(max((int(runs["at"].min()) + micros) // 1000, mark) + 1)
        elif state.exists:
            state.remove()

    timed = results.filter("digest IS NOT NULL AND step IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    key = F.coalesce(F.col("key").cast("long"), F.lit(0))
    rows = timed.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), F.col("key").isNull().alias("anon"), key.alias("key"), F.col("step").cast("long").alias("step"), "digest", F.unix_micros("ts").alias("at"), "ts")
    return rows.groupBy("bucket").applyInPandasWithState(step, STALL, RUNS, "append", "EventTimeTimeout")


def longest_runs(states: DataFrame) -> DataFrame:
    """The last state of every run that stalls() gave."""
    return states.groupBy("key", "digest", "from_step").agg(F.max("n").alias("n"))
