"""Sources and sinks: source trees, commit logs, issue files, NDJSON, task lists, snapshots and findings.

Writers put files into the folder that `spark.checkpoint.dir` names, or a given one; all reading and
writing is Spark's, so any file system it knows will do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siftworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written and read back, which cuts its lineage."""
    folder = new_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Ends each file in a text part.
FILE_END = "\n--END-OF-FILE--\n"


def write_files(files: DataFrame) -> str:
    """Sources as text parts: `<repo>/<path>`, the lines, and FILE_END."""
    folder = new_folder(files.sparkSession, "files")
    files.select(F.concat("repo", F.lit("/"), "path", F.lit("\n"), "content").alias("value")).write.option("lineSep", FILE_END).text(folder)
    return folder


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, language, size, n_lines) of the source files in a folder of text parts, at any depth."""
    parts = spark.read.option("recursiveFileLookup", "true").option("lineSep", FILE_END).text(folder)
    at = F.instr("value", "\n")
    path, content = F.substring("value", F.lit(1), at - 1), F.substring("value", at + 1, F.length("value"))
    return parts.select(path.alias("path"), F.regexp_extract(path, r"\.([^./]*)$", 1).alias("language"), F.length(content).cast("bigint").alias("size"), F.size(F.split(content, "\n")).cast("bigint").alias("n_lines"))


def write_commit_log(commit_files: DataFrame) -> str:
    """One record a commit: `COMMIT:<hash>` and the names of its files."""
    folder = new_folder(commit_files.sparkSession, "log")
    log = commit_files.groupBy("hash").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    log.select(F.concat(F.lit("COMMIT:"), F.col("hash").cast("string"), F.lit("\n"), F.array_join("paths", "\n")).alias("value")).write.text(folder)
    return folder


def read_commit_log(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, path): a record ends where the next header begins, so commits are split between tasks."""
    # A file name may hold the mark, so only one at the begin of a line counts.
    rows = spark.read.option("lineSep", "\nCOMMIT:").text(folder).select(F.regexp_replace("value", r"^COMMIT:", "").alias("value")).filter("value <> ''")
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return rows.select(F.element_at(lines, 1).alias("hash"), F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("path"))


def write_name_status(commit_files: DataFrame) -> str:
    """Tab-separated rows: hash, status, names; a third of the deletions are renames with a score."""
    folder = new_folder(commit_files.sparkSession, "status")
    renamed = (F.col("status") == "D") & (F.col("hash") % 3 == 0)
    status = F.when(renamed, F.concat(F.lit("R"), F.lpad((F.col("hash") % 101).cast("string"), 3, "0"))).otherwise(F.col("status"))
    row = F.concat_ws("\t", F.col("hash").cast("string"), status, "path", F.when(renamed, F.concat("path", F.lit(".new"))))
    commit_files.select(row.alias("value")).write.text(folder)
    return folder


def read_name_status(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, status, from_path, to_path, score, touches_docs); a rename below 100 also counts as modified."""
    p = F.split("value", "\t")
    rename = p[1].startswith("R")
    score = F.when(rename, F.regexp_extract(p[1], r"^R(\d+)", 1).cast("int"))
    to = F.when(rename, p[3])
    docs = p[2].endswith(".md")
    kind = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("status", "from_path", "to_path", "score"), strict=True)])
    none = F.lit(None)
    one = kind(F.substring(p[1], 1, 1), p[2], to, score)
    two = kind(F.lit("M"), p[3], none.cast("string"), none.cast("int"))
    both = F.when(rename & (score < 100), F.array(one, two)).otherwise(F.array(one))
    # try_element_at keeps rows of three fields
    rows = spark.read.text(folder).withColumn("value", F.concat("value", F.lit("\t")))
    return rows.select(p[0].alias("hash"), F.explode(both).alias("x"), docs.alias("touches_docs")).select("hash", "x.*", "touches_docs")


def write_text(rows: DataFrame, name: str) -> str:
    """A column `value` as lines of text."""
    folder = new_folder(rows.sparkSession, name)
    rows.select("value").write.text(folder)
    return folder


def _status_rows(parts: Column, *keys: str) -> list[Column]:
    """Columns of a name-status row split at tabs: one row for it, and one more for a rename below 100."""
    rename = parts[0].startswith("R")
    # names with odd characters come quoted
    name = lambda i: F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(i)), '^"(.*)"$', "$1"), r'\\(["\\])', "$1")
    score = F.when(rename, F.regexp_extract(parts[0], r"^R(\d+)", 1).try_cast("int"))
    to = F.when(rename, name(2))
    docs = F.coalesce(name(1).endswith(".md"), F.lit(False)) | F.coalesce(to.endswith(".md"), F.lit(False))
    row = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("status", "from_path", "to_path", "score", "touches_docs"), strict=True)))
    one = row(F.substring(parts[0], 1, 1), name(1), to, score, docs)
    two = row(F.lit("M"), to, F.lit(None).cast("string"), F.lit(None).cast("int"), docs)
    return [*map(F.col, keys), F.explode(F.when(rename & (score < 100), F.array(one, two)).otherwise(F.array(one))).alias("x")]


def read_diff_status(spark: SparkSession, folder: str) -> DataFrame:
    """(status, from_path, to_path, score, touches_docs) of `diff --name-status` text as it is printed; lines of no such form are left out."""
    rows = spark.read.text(folder).filter(F.col("value").rlike(r"^[A-Z]\d*\t.")).select(F.split("value", "\t").alias("p"))
    return rows.select(*_status_rows(F.col("p"))).select("x.*")


def write_status_log(commit_files: DataFrame) -> str:
    """One record a commit: `COMMIT:<hash>`, an empty line, and statuses with names; a third of the deletions are renames with a score."""
    folder = new_folder(commit_files.sparkSession, "status-log")
    renamed = (F.col("status") == "D") & (F.col("hash") % 3 == 0)
    status = F.when(renamed, F.concat(F.lit("R"), F.lpad((F.col("hash") % 101).cast("string"), 3, "0"))).otherwise(F.col("status"))
    row = F.concat_ws("\t", status, "path", F.when(renamed, F.concat("path", F.lit(".new"))))
    log = commit_files.groupBy("hash").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    log.select(F.concat(F.lit("COMMIT:"), F.col("hash").cast("string"), F.lit("\n\n"), F.array_join("rows", "\n")).alias("value")).write.text(folder)
    return folder


def read_status_log(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, status, from_path, to_path, score, touches_docs) of `log --name-status --format=COMMIT:%H` text."""
    rows = spark.read.option("lineSep", "\nCOMMIT:").text(folder).select(F.split(F.regexp_replace("value", r"^COMMIT:", ""), "\n").alias("lines"))
    each = rows.select(F.trim(F.col("lines")[0]).alias("hash"), F.explode(F.filter("lines", lambda x: x.rlike(r"^[A-Z]\d*\t."))).alias("line"))
    return each.select("hash", F.split("line", "\t").alias("p")).select(*_status_rows(F.col("p"), "hash")).select("hash", "x.*")


def write_issues(issues: DataFrame) -> str:
    folder = new_folder(issues.sparkSession, "issues")
    issues.select("number", "title", F.transform("labels", lambda x: F.struct(x.alias("name"))).alias("labels"), "body").write.json(folder)
    return folder


def read_issues(spark: SparkSession, folder: str, snippet: int = 200) -> DataFrame:
    """(number, title, labels, snippet) from issue JSON whose labels are objects with a name or plain strings; pull requests stay out."""
    rows = spark.read.schema("number long, title string, labels array<string>, body string, pull_request string").json(folder).filter("pull_request IS NULL")
    name = lambda x: F.coalesce(F.get_json_object(x, "$.name"), x)
    return rows.select("number", "title", F.transform("labels", name).alias("labels"), F.substring("body", 1, snippet).alias("snippet"))


def write_ndjson(events: DataFrame) -> str:
    """Rows as NDJSON, every tenth one cut short."""
    folder = new_folder(events.sparkSession, "ndjson")
    row = F.to_json(F.struct("event_id", "event_type"))
    events.select(F.when(F.col("event_id") % 10 == 0, F.substring(row, 1, 12)).otherwise(row).alias("value")).write.text(folder)
    return folder


def read_ndjson(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """NDJSON rows; lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def read_task_list(lines: DataFrame) -> DataFrame:
    """(repo, path, line_no, task) of unchecked boxes."""
    box = r"^\s*[-*]\s+\[ \]\s+(.*)$"
    return lines.filter(F.col("line").rlike(r"^\s*[-*]\s+\[ \]\s+")).select("repo", "path", "line_no", F.regexp_extract("line", box, 1).alias("task"))


def write_snapshot(symbols: DataFrame, snapshot: str, folder: str | None = None) -> str:
    """A symbol map as Parquet under its name, in place of the one of that name.

    Each write has a folder of its own, and its mark is written last: until then, and if the write is lost, the one
    before stays the snapshot. Then what no mark names as the latest is deleted.
    """
    spark = symbols.sparkSession
    folder, version = folder or new_folder(spark, "snapshots"), uuid.uuid4().hex
    symbols.write.parquet(f"{folder}/versions/{version}")
    before = latest_versions(spark, folder).filter(F.col("snapshot") == snapshot).select("version").collect() if _exists(spark, f"{folder}/marks") else []
    _mark(spark, folder, snapshot, version, False)
    for r in before:  # at most one
        _delete(spark, f"{folder}/versions/{r.version}")
    return folder


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def _exists(spark: SparkSession, name: str) -> bool:
    files, path = _path(spark, name)
    return files.exists(path)


def _delete(spark: SparkSession, name: str) -> None:
    files, path = _path(spark, name)
    files.delete(path, True)


def _mark(spark: SparkSession, folder: str, snapshot: str, version: str | None, stale: bool) -> None:
    row = spark.range(1).select(F.lit(snapshot).alias("snapshot"), F.lit(version).cast("string").alias("version"), F.lit(stale).alias("stale"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{folder}/marks")


def latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    """(snapshot, version, stale): the version that stands for each snapshot, and whether it was marked as out of date since."""
    marks = spark.read.schema("snapshot string, version string, stale boolean, at timestamp").parquet(f"{folder}/marks")
    return marks.groupBy("snapshot").agg(F.max_by("version", F.when(F.col("version").isNotNull(), F.col("at"))).alias("version"), F.max_by("stale", "at").alias("stale"))


def mark_stale(spark: SparkSession, folder: str, snapshot: str) -> None:
    """Marks a snapshot as out of date; writing it again lifts the mark."""
    _mark(spark, folder, snapshot, None, True)


def snapshot_status(spark: SparkSession, folder: str) -> DataFrame:
    """(snapshot, symbols, stale) of every snapshot, empty ones too."""
    latest = latest_versions(spark, folder).filter("version IS NOT NULL")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/versions")
    version = F.regexp_extract(F.col("_metadata.file_path"), r"/versions/([^/]+)/", 1)
    counts = rows.select(version.alias("version")).groupBy("version").agg(F.count("*").alias("symbols"))
    return latest.join(counts, "version", "left").select("snapshot", F.coalesce("symbols", F.lit(0).cast("bigint")).alias("symbols"), "stale")


def load_snapshot(spark: SparkSession, folder: str, snapshot: str) -> DataFrame:
    """The rows of one snapshot; an unknown one has none."""
    found = latest_versions(spark, folder).filter((F.col("snapshot") == snapshot) & F.col("version").isNotNull()).select("version").collect()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/versions/{found[0].version}" if found else f"{folder}/versions")
    return rows if found else rows.limit(0)


def write_findings(findings: DataFrame) -> str:
    """Findings as Parquet by severity."""
    folder = new_folder(findings.sparkSession, "findings")
    findings.write.partitionBy("severity").parquet(folder)
    return folder


def compact_findings(findings: DataFrame, rows: int) -> DataFrame:
    """One text line a finding, the most severe first, at most `rows`."""
    rank = F.array_position(F.array(*map(F.lit, ["critical", "high", "medium", "low"])), F.col("severity"))
    top = findings.orderBy(rank, "repo", "path", "line_no", "rule").limit(rows)
    return top.select(F.concat_ws("|", "severity", "rule", "repo", "path", F.col("line_no").cast("string")).alias("row"))


