"""Algebra of findings: union, deduplication, summaries, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CERTAINTIES, FIXES, SEVERITIES
from ..sources.io import written


def rank_of(col: str, order: list[str]) -> Column:
    """Place of a value in `order`, from 1; unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(col))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def union_findings(*phases: DataFrame) -> DataFrame:
    """All findings; columns that a phase lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), phases)


def findings_summary(findings: DataFrame) -> DataFrame:
    """(facet, value, n): counts by severity, certainty, fix and rule, and the total; zeros for known values; and by phase, if they have one."""
    facets = F.array(
        F.struct(F.lit("total").alias("facet"), F.lit("all").alias("value")),
        *[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("severity", "certainty", "fix", "rule", *["phase"] * ("phase" in findings.columns))],
    )
    counts = findings.select(F.explode(facets).alias("x")).groupBy("x.facet", "x.value").count()
    known = [("total", "all")] + [("severity", v) for v in SEVERITIES] + [("certainty", v) for v in CERTAINTIES] + [("fix", v) for v in FIXES]
    zeros = findings.sparkSession.createDataFrame([(a, b, 0) for a, b in known], "facet string, value string, count long")
    return counts.unionByName(zeros).groupBy("facet", "value").agg(F.sum("count").alias("n"))


def certainty_matrix(findings: DataFrame, source: str) -> DataFrame:
    """Per source: counts by certainty and of fixable ones, with a row of totals (`all`)."""
    out = findings.rollup(source).agg(*[F.count_if(F.col("certainty") == c).alias(c.lower()) for c in CERTAINTIES], F.count_if(F.col("fix") != "flag").alias("fixable"))
    return out.withColumn(source, F.coalesce(source, F.lit("all")))


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One row for (path, line, issue text without case and margins): merged sources, fixable if any is."""
    keyed = findings.withColumn("issue", F.lower(F.trim("issue")))
    return keyed.groupBy("path", "line_no", "issue").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or("fixable").alias("fixable"), F.min_by("certainty", F.struct("seq", "certainty")).alias("certainty")
    )


def review_rollup(items: DataFrame) -> DataFrame:
    """Review items by pass: the last version of each (pass, path, line, text) counts, false positives don't."""
    last = items.groupBy("pass", "path", "line_no", "text").agg(F.max_by(F.struct("severity", "status"), "seq").alias("x"))
    live = last.select("pass", "x.severity", "x.status").filter("status <> 'false_positive'")
    return live.groupBy("pass").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe"))


def autofix_breakdown(findings: DataFrame, source: str) -> DataFrame:
    """High certainty and fixable, by source and rule."""
    return findings.filter("certainty = 'HIGH' AND fix <> 'flag'").groupBy(source, "rule").agg(F.count("*").alias("n"))


def top_findings(findings: DataFrame, n: int) -> DataFrame:
    """The first n by certainty, severity, path, line and rule."""
    return findings.orderBy(rank_of("certainty", CERTAINTIES), rank_of("severity", SEVERITIES), "repo", "path", "line_no", "rule").limit(n)


def compact_summary(items: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Counts by key of the first `most` rows, with total, showing and truncated.

    The first rows come from a top-k, so nothing is ranked in one task. Items are made once and written, as two questions are asked of them.
    """
    items = written(items.select(*dict.fromkeys([key, *order])))
    shown = items.orderBy(*order).limit(most).groupBy(key).agg(F.count("*").alias("n"))
    total = items.agg(F.count("*").alias("total"))
    return shown.withColumn("total", total.scalar()).withColumns({"showing": F.least("total", F.lit(most).cast("bigint")), "truncated": F.col("total") > most})


def fp_rate(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of false positives by rule, of the labelled findings (doc_id, rule) and labels (doc_id, wrong)."""
    return findings.join(labels, "doc_id").groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg(F.col("wrong").cast("double")), 6).alias("fp_rate"))


def priority(items: DataFrame) -> DataFrame:
    """Adds `priority`: severity base x category weight x recency x staleness, rounded half up."""
    base = F.when(F.col("severity") == "critical", 15).when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 5).when(F.col("severity") == "low", 2).otherwise(5)
    weights = {"security": 2.0, "bugs": 1.5, "infrastructure": 1.3, "features": 1.0, "documentation": 0.8}
    weight = reduce(lambda c, kv: c.when(F.col("category") == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
    score = base * weight * F.when(F.col("recent"), 1.2).otherwise(1.0) * F.when(F.col("days_stale") > 180, 0.9).otherwise(1.0)
    return items.withColumn("priority", F.floor(F.round(score, 6) + 0.5).cast("bigint"))


def time_buckets(items: DataFrame) -> DataFrame:
    """Items in their time bucket, the best of each up to its size: 5, 10, 15 and 20."""
    bucket = (
        F.when((F.col("severity") == "critical") | (F.col("priority") >= 15), "immediate")
        .when((F.col("severity") == "high") | (F.col("priority") >= 10), "short")
        .when(F.col("priority") >= 5, "medium")
        .otherwise("backlog")
    )
    sizes = {"immediate": 5, "short": 10, "medium": 15, "backlog": 20}
    dealt = items.withColumn("bucket", bucket)
    # Each bucket's best by partial sorts, so that no task holds a bucket.
    best = reduce(DataFrame.unionByName, [dealt.filter(F.col("bucket") == b).orderBy(F.desc("priority"), "id").limit(n) for b, n in sizes.items()])
    return best.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("priority"), "id")))


def score_tasks(tasks: DataFrame, recent_words: DataFrame, as_of: str, top: int) -> DataFrame:
    """The best tasks by label, blocker, effort, recent work, age and reactions. recent_words: one column `word`."""
    has = lambda *w: F.exists("labels", lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(y) for y in w]))
    words = tasks.select("number", F.explode(F.array_distinct(F.split(F.lower("title"), r"\W+"))).alias("word")).filter("length(word) > 3")
    related = words.join(recent_words, "word", "left_semi").select("number").distinct().withColumn("related", F.lit(True))
    t = tasks.join(related, "number", "left")
    part = lambda cond, n: F.when(cond, n).otherwise(0)
    score = (
        part(has("critical", "p0"), 100)
        + part(has("high", "p1"), 50)
        + part(has("medium", "p2"), 25)
        + part(has("security"), 40)
        + part(F.col("body").rlike(r"(?i)blocks #\d+"), 30)
        + part(has("small", "quick"), 20)
        + part(has("large", "complex"), -10)
        + part(F.coalesce("related", F.lit(False)), 15)
        + part(F.exists("labels", lambda x: F.lower(x) == "bug") & (F.datediff(F.lit(as_of), "created") > 30), 10)
        + part(F.col("reactions") > 5, 15)
    )
    return t.select("number", score.cast("bigint").alias("score")).orderBy(F.desc("score"), "number").limit(top)
