"""Symbol maps brought up to date from a list of changes: only the files that changed are opened and scanned.

A change list has rows (status, from_path, to_path): A added, M modified, D deleted, R renamed; a renamed file that also
changed has a second row M under its new path, as io.read_diff_status() gives it. The map that results is the one that a
scan of all files would give.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tree
from ..tables import to_lines
from .history import extract_imports, extract_symbols, snapshot_diff
from .imports import family

#: Languages of the symbol rules by the tree's language.
SCANNED = {"js": "javascript", "rust": "rust", "go": "go", "python": "python", "java": "java"}


def symbol_map(files: DataFrame) -> DataFrame:
    """(path, part, kind, name, line_no) of files (path, lang, content): their symbols and what they import."""
    lines = to_lines(files.select(F.lit("").alias("repo"), "path", "lang", "content"))
    symbols = extract_symbols(lines).select("path", F.lit("symbol").alias("part"), "kind", "name", "line_no")
    return symbols.unionByName(extract_imports(lines).select("path", F.lit("import").alias("part"), "kind", F.col("source").alias("name"), "line_no"))


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change list of two states (path, hash)."""
    letter = F.when(F.col("change") == "added", "A").when(F.col("change") == "deleted", "D").otherwise("M")
    return snapshot_diff(old, new).select(letter.alias("status"), F.col("path").alias("from_path"), F.lit(None).cast("string").alias("to_path"))


def to_scan(changes: DataFrame) -> DataFrame:
    """(path): sources that have to be scanned again."""
    return changes.filter(F.col("status").isin("A", "M")).select(F.col("from_path").alias("path")).filter(family(F.col("path")).isNotNull()).distinct()


def kept_rows(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of a map (path, ...) that stay: under their new path if renamed, without what is deleted or scanned again."""
    gone = changes.filter("status = 'D'").select(F.col("from_path").alias("path"))
    moves = changes.filter("status = 'R'").groupBy(F.col("from_path").alias("path")).agg(F.min("to_path").alias("to_path"))
    again = changes.filter(F.col("status").isin("A", "M")).select(F.col("from_path").alias("path"))
    rest = [c for c in old.columns if c != "path"]
    moved = old.join(gone, "path", "left_anti").join(moves, "path", "left").select(F.coalesce("to_path", "path").alias("path"), *rest)
    return moved.join(again, "path", "left_anti")


def refresh_map(old: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """The map after the changes; of the new state's files (path, lang, content) only those to be scanned are split into lines."""
    return kept_rows(old, changes).unionByName(symbol_map(files.join(to_scan(changes), "path", "left_semi")))


def refresh_map_from_tree(old: DataFrame, changes: DataFrame, root: str) -> DataFrame:
    """The same for the source tree under `root`: only the files to be scanned are opened. A file that isn't there any more has no rows."""
    files = tree.read_paths(to_scan(changes), root)
    lang = reduce(lambda c, kv: c.when(F.col("language") == kv[0], kv[1]), SCANNED.items(), F.when(F.lit(False), ""))
    return kept_rows(old, changes).unionByName(symbol_map(files.select("path", lang.alias("lang"), "content")))
