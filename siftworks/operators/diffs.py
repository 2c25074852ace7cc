"""Unified diffs as rows: file, hunk, kind and line numbers of every line, and measures on them.

A line inside a hunk is told by the hunk's own counts, not by its looks: `--- x` is a removed line `-- x` while the counts
of the last `@@` aren't used up, and a file head after that. File and hunk are carried along the lines by windows over
one diff. Heads of renames, modes and binary files have no lines. A null diff has none; a hunk that is cut short
gives what is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
# Forms of an added line that open a branch; a line counts once for each form.
BRANCHES = [r"if\s*\(", r"else\s*\{", r"\?.*:", r"switch\s*\(", r"case\s+", r"catch\s*\("]
ASYNC = r"async\s+|await\s+"
REJECTS = r"(?i)\.rejects|\.resolves|async.*expect|try.*catch.*expect"


def _named(line: Column) -> Column:
    """The path of a `---` or `+++` head; null for /dev/null."""
    name = F.regexp_replace(F.regexp_replace(F.substring(line, 5, 1_000_000), r"\t.*$|\r$", ""), "^\"(.*)\"$", "$1")
    return F.when(name != "/dev/null", F.regexp_replace(name, "^[ab]/", ""))


def diff_lines(diffs: DataFrame, id_col: str = "diff", text_col: str = "text") -> DataFrame:
    """(id, path, hunk, kind, old_no, new_no, line) of the lines inside hunks; kind is `+`, `-` or a blank."""
    rows = diffs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    order = Window.partitionBy("id").orderBy("pos")
    number = lambda k: F.regexp_extract("raw", HUNK, k)
    count = lambda k: F.when(number(k) == "", F.lit(1)).otherwise(number(k).try_cast("long"))
    head = F.col("raw").rlike(HUNK)
    at = F.when(head, F.struct(number(1).try_cast("long").alias("old"), count(2).alias("n_old"), number(3).try_cast("long").alias("new"), count(4).alias("n_new")))
    rows = rows.withColumns({"head": head, "h": F.last(at, ignorenulls=True).over(order), "hunk": F.sum(head.cast("long")).over(order)})
    side = lambda marks: (~F.col("head") & (F.substring("raw", 1, 1).isin(*marks) | (F.col("raw") == ""))).cast("long")
    before = Window.partitionBy("id", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    used = lambda marks: F.coalesce(F.sum(side(marks)).over(before), F.lit(0).cast("bigint"))
    rows = rows.withColumns({"was": used((" ", "-")), "now": used((" ", "+"))})
    inside = ~F.col("head") & F.col("h").isNotNull() & ((F.col("was") < F.col("h.n_old")) | (F.col("now") < F.col("h.n_new"))) & ~F.col("raw").startswith("\\")
    outside = ~F.coalesce(inside, F.lit(False))
    old = F.when(outside & F.col("raw").startswith("--- "), F.struct(F.lit("-").alias("side"), _named(F.col("raw")).alias("name")))
    new = F.when(outside & F.col("raw").startswith("+++ "), F.struct(F.lit("+").alias("side"), _named(F.col("raw")).alias("name")))
    rows = rows.withColumns({"inside": ~outside, "old": F.last(old, ignorenulls=True).over(order), "new": F.last(new, ignorenulls=True).over(order)})
    kind = F.when(F.col("raw").rlike(r"^[+-]"), F.substring("raw", 1, 1)).otherwise(" ")
    line_no = lambda start, used, marks: F.when(kind.isin(*marks), F.col(start) + F.col(used))
    return rows.filter("inside").select(
        F.col("id").alias(id_col), F.coalesce("new.name", "old.name").alias("path"), "hunk", kind.alias("kind"),
        line_no("h.old", "was", (" ", "-")).alias("old_no"), line_no("h.new", "now", (" ", "+")).alias("new_no"), F.substring("raw", 2, 2**31 - 1).alias("line"),
    )


def diff_file_stats(lines: DataFrame, id_col: str = "diff") -> DataFrame:
    """(id, path, hunks, added, removed) from diff_lines()."""
    count = lambda k: F.count_if(F.col("kind") == k)
    return lines.groupBy(id_col, "path").agg(F.countDistinct("hunk").alias("hunks"), count("+").alias("added"), count("-").alias("removed"))


def diff_growth(lines: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, branches, complexity, untested_async): added branches, more than three are high; added async code whose test has no rejection.

    tests: (path, content), the test of each source; a source without one has no such test.
    """
    added = lines.filter("kind = '+'")
    forms = sum((F.col("line").rlike(rx).cast("long") for rx in BRANCHES[1:]), F.col("line").rlike(BRANCHES[0]).cast("long"))
    per = added.groupBy("path").agg(F.sum(forms).alias("branches"), F.bool_or(F.col("line").rlike(ASYNC)).alias("is_async"))
    rejects = tests.groupBy("path").agg(F.bool_or(F.col("content").rlike(REJECTS)).alias("rejects"))
    untested = F.col("is_async") & ~F.coalesce("rejects", F.lit(False))
    return per.join(rejects, "path", "left").select("path", "branches", F.when(F.col("branches") > 3, "high").otherwise("unknown").alias("complexity"), untested.alias("untested_async"))
