"""Queries of source trees, change lists, refreshed maps and unified diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..operators import diffs as di
from ..operators import history as hi
from ..operators import refresh as re_
from ..operators import scan
from ..sources import io, tree
from .history import _IMPORTS, NAMES
from .registry import query
from .scans import W, q


@query("a1_scan_tree", W + T.FILES + f""" SELECT repo || '/' || path AS path, CASE lang WHEN 'javascript' THEN 'js' WHEN 'typescript' THEN 'js' ELSE lang END AS language, strlen(content) AS size,
 len(string_split(content, chr(10))) AS n_lines, true AS decoded FROM code_files WHERE lang <> 'markdown' AND NOT regexp_matches(repo || '/' || path, {q(scan.TEST_PATH)}) AND NOT list_has_any(string_split(path, '/'), {scan.EXCLUDED_DIRS})""")
def a1_tree(spark, d):
    """Files of all kinds written one by one in nested folders; the sources among them read back whole."""
    root = tree.write_tree(T.code_files(spark, d).select(F.concat("repo", F.lit("/"), "path").alias("path"), "content"))
    files = tree.scan_tree(spark, root)
    return files.select("path", "language", "size", F.size(F.split("content", "\n")).cast("bigint").alias("n_lines"), "decoded")


@query("a9_read_diff_status", W + T.COMMIT_FILES + """ SELECT CAST(hash AS VARCHAR) AS hash, CASE WHEN status = 'D' AND hash % 3 = 0 THEN 'R' ELSE status END AS status, path AS from_path,
    CASE WHEN status = 'D' AND hash % 3 = 0 THEN path || '.new' END AS to_path, CASE WHEN status = 'D' AND hash % 3 = 0 THEN CAST(hash % 101 AS INTEGER) END AS score, path LIKE '%.md' AS touches_docs FROM commit_files
    UNION ALL SELECT CAST(hash AS VARCHAR), 'M', path || '.new', NULL, NULL, path LIKE '%.md' FROM commit_files WHERE status = 'D' AND hash % 3 = 0 AND hash % 101 < 100""")
def a9_log(spark, d):
    """A log with the names and statuses of each commit, as the version control system prints it."""
    return io.read_status_log(spark, io.write_status_log(T.commit_files(spark, d)))


# An old state and a new one: of each ten documents one is added, one deleted and one renamed; of the others a quarter changes, of the renamed ones half.
_NEW = """old_files AS (SELECT *, repo || '/' || path AS at FROM code_files WHERE doc_id % 10 <> 0 AND lang <> 'markdown'),
 new_files AS (SELECT '' AS repo, CASE WHEN doc_id % 10 = 2 THEN 'moved/' ELSE '' END || repo || '/' || path AS path, doc_id, lang,
  content || CASE WHEN doc_id % 10 <> 0 AND (doc_id % 4 = 3 OR (doc_id % 10 = 2 AND doc_id % 4 = 0)) THEN chr(10) || 'class Added' || doc_id ELSE '' END AS content
  FROM code_files WHERE doc_id % 10 <> 1 AND lang <> 'markdown'),
 code_lines AS (SELECT repo, path, doc_id, lang, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no FROM new_files)"""
REBUILT = W + T.FILES + ", " + _NEW + ", " + NAMES + ", " + _IMPORTS + """ SELECT path, 'symbol' AS part, kind, name, line_no FROM symbols UNION ALL SELECT path, 'import', kind, source, line_no FROM imports"""


def states(spark, d):
    """(doc_id, old path, path, lang, old content, content) of both states, and whether a file is in each."""
    files = T.code_files(spark, d).filter("lang <> 'markdown'")
    at = F.concat("repo", F.lit("/"), "path")
    changed = "doc_id % 10 <> 0 AND (doc_id % 4 = 3 OR (doc_id % 10 = 2 AND doc_id % 4 = 0))"
    grown = F.concat("content", F.when(F.expr(changed), F.concat(F.lit("\nclass Added"), F.col("doc_id").cast("string"))).otherwise(""))
    moved = F.when(F.col("doc_id") % 10 == 2, F.concat(F.lit("moved/"), at)).otherwise(at)
    return files.select("doc_id", "lang", at.alias("old_path"), moved.alias("path"), F.col("content").alias("old_content"), grown.alias("content"), F.expr(changed).alias("changed"))


def old_map(both):
    return re_.symbol_map(both.filter("doc_id % 10 <> 0").select(F.col("old_path").alias("path"), "lang", F.col("old_content").alias("content")))


@query("i6_refresh_map", REBUILT)
def i6_refresh(spark, d):
    """The map of the old state refreshed by the change list of the two states; the SQL scans all files anew."""
    both = states(spark, d)
    by = F.col("doc_id") % 10
    score = F.when(F.col("changed"), "R080").otherwise("R100")
    row = F.when(by == 0, F.concat_ws("\t", F.lit("A"), "path")).when(by == 1, F.concat_ws("\t", F.lit("D"), "old_path")).when(by == 2, F.concat_ws("\t", score, "old_path", "path")).when(F.col("changed"), F.concat_ws("\t", F.lit("M"), "path"))
    changes = io.read_diff_status(spark, io.write_text(both.select(row.alias("value")).filter("value IS NOT NULL"), "status"))
    return re_.refresh_map(old_map(both), changes, both.filter(by != 1).select("path", "lang", "content"))


@query("i5_refresh_map_by_hash", REBUILT)
def i5_refresh(spark, d):
    """The same without a change list: hashes of both states are compared, and the new state is a folder of plain files, of which only the changed ones are opened."""
    both = states(spark, d)
    new = both.filter("doc_id % 10 <> 1")
    root = tree.write_tree(new.select("path", "content"))
    hashed = lambda df, path, content: df.select(F.col(path).alias("path"), F.sha2(content, 256).alias("hash"))
    changes = re_.changes_between(hashed(both.filter("doc_id % 10 <> 0"), "old_path", "old_content"), hashed(new, "path", "content"))
    return re_.refresh_map_from_tree(old_map(both), hi.written(changes), root)


def file_diffs(spark, d):
    """(diff, text): a diff a file that adds all its lines between kept ones, and holds lines that look like file heads."""
    files = T.code_files(spark, d)
    at = F.concat("repo", F.lit("/"), "path")
    n = F.size(F.split("content", "\n")).cast("string")
    head = F.concat(F.lit("diff --git a/"), at, F.lit(" b/"), at, F.lit("\nindex 1111111..2222222 100644\n--- a/"), at, F.lit("\n+++ b/"), at, F.lit("\n@@ -7 +7 @@ top\n-x\n+y\n@@ -10,3 +10,"))
    body = F.concat(F.lit("\n kept\n--- gone\n+++ more\n+"), F.replace("content", F.lit("\n"), F.lit("\n+")), F.lit("\n end\n"))
    return files.select(F.col("doc_id").alias("diff"), at.alias("path"), F.concat(head, (n.cast("int") + 3).cast("string"), F.lit(" @@"), body).alias("text"))


@query("d25_diff_file_stats", W + T.FILES + " SELECT doc_id AS diff, repo || '/' || path AS path, 2 AS hunks, len(string_split(content, chr(10))) + 2 AS added, 2 AS removed FROM code_files")
def d25_diffs(spark, d):
    """Changed lines of unified diffs by file."""
    return di.diff_file_stats(di.diff_lines(file_diffs(spark, d)))


_FORMS = " + ".join(f"CAST(regexp_matches(line, {q(rx)}) AS BIGINT)" for rx in di.BRANCHES)


@query("d28_diff_growth", W + T.LINES + rf""", per AS (SELECT repo || '/' || path AS path, sum({_FORMS}) AS branches, bool_or(regexp_matches(line, {q(di.ASYNC)})) AS a FROM code_lines GROUP BY ALL),
 tests AS (SELECT repo || '/' || path AS path, bool_or(regexp_matches(content || CASE WHEN doc_id % 2 = 0 THEN '.rejects' ELSE '' END, {q(di.REJECTS)})) AS r FROM code_files GROUP BY ALL)
 SELECT path, CAST(branches AS BIGINT) AS branches, CASE WHEN branches > 3 THEN 'high' ELSE 'unknown' END AS complexity, a AND NOT r AS untested_async FROM per JOIN tests USING (path)""")
def d28_diffs(spark, d):
    """Growth read from unified diffs; every second file's test tests rejections, besides those that do so by themselves."""
    files = T.code_files(spark, d)
    rejects = F.when(F.col("doc_id") % 2 == 0, ".rejects").otherwise("")
    tests = files.select(F.concat("repo", F.lit("/"), "path").alias("path"), F.concat("content", rejects).alias("content"))
    return di.diff_growth(di.diff_lines(file_diffs(spark, d)), tests)
