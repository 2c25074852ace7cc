"""Queries over findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import rules as R
from ..operators import findings as fi
from ..operators import scan
from ..sources import io
from .registry import query
from .scans import FINDINGS, W

BASE = W + T.LINES + ", " + FINDINGS


def found(spark, d):
    return scan.rule_scan(T.code_lines(spark, d))


_ZEROS = T.values([("total", "all", 0)] + [("severity", v, 0) for v in R.SEVERITIES] + [("certainty", v, 0) for v in R.CERTAINTIES] + [("fix", v, 0) for v in R.FIXES], "facet, value, n")


@query(
    "d1_findings_summary",
    BASE + f""" SELECT facet, value, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'total' AS facet, 'all' AS value, count(*) AS n FROM findings UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY severity
  UNION ALL SELECT 'certainty', certainty, count(*) FROM findings GROUP BY certainty UNION ALL SELECT 'fix', fix, count(*) FROM findings GROUP BY fix
  UNION ALL SELECT 'rule', rule, count(*) FROM findings GROUP BY rule UNION ALL SELECT 'phase', '1', count(*) FROM findings UNION ALL {_ZEROS}) GROUP BY ALL""",
)
def d1(spark, d):
    """Line rules are phase 1."""
    return fi.findings_summary(found(spark, d).withColumn("phase", F.lit("1")))


_MATRIX = """count(*) FILTER (certainty = 'HIGH') AS high, count(*) FILTER (certainty = 'MEDIUM') AS medium, count(*) FILTER (certainty = 'LOW') AS low, count(*) FILTER (fix <> 'flag') AS fixable"""
#: Findings whose certainty depends on the line, as from several analysers.
_MIXED = ", mixed AS (SELECT * REPLACE (['HIGH','MEDIUM','LOW'][line_no % 3 + 1] AS certainty) FROM findings)"


def mixed(spark, d):
    return found(spark, d).withColumn("certainty", F.element_at(F.array(*map(F.lit, R.CERTAINTIES)), (F.col("line_no") % 3 + 1).cast("int")))


@query("d2_certainty_matrix", BASE + _MIXED + f" SELECT coalesce(repo, 'all') AS repo, {_MATRIX} FROM mixed GROUP BY ROLLUP (repo)")
def d2(spark, d):
    return fi.certainty_matrix(mixed(spark, d), "repo")


_MULTI = _MIXED + """, multi AS (SELECT path, line_no, CASE WHEN line_no % 2 = 0 THEN upper(severity) || ' ' ELSE severity END AS issue, 'a' || (length(rule) % 3) AS source, fix <> 'flag' AS fixable, certainty, rule AS seq FROM mixed
  UNION ALL SELECT path, line_no, severity, 'b', false, 'LOW', 'zz' || rule FROM mixed)"""


@query("d3_dedupe_findings", BASE + _MULTI + " SELECT path, line_no, lower(trim(issue)) AS issue, list_sort(list(DISTINCT source)) AS sources, bool_or(fixable) AS fixable, arg_min(certainty, struct_pack(a := seq, b := certainty)) AS certainty FROM multi GROUP BY ALL")
def d3(spark, d):
    m = mixed(spark, d)
    fixable = F.col("fix") != "flag"
    one = F.struct(F.when(F.col("line_no") % 2 == 0, F.concat(F.upper("severity"), F.lit(" "))).otherwise(F.col("severity")).alias("issue"), F.concat(F.lit("a"), (F.length("rule") % 3).cast("string")).alias("source"), fixable.alias("fixable"), F.col("certainty"), F.col("rule").alias("seq"))
    two = F.struct(F.col("severity").alias("issue"), F.lit("b").alias("source"), F.lit(False).alias("fixable"), F.lit("LOW").alias("certainty"), F.concat(F.lit("zz"), "rule").alias("seq"))
    return fi.dedupe_findings(m.select("path", "line_no", F.inline(F.array(one, two))))


_REVIEW = """reviews AS (SELECT 'pass' || (l_suppkey % 4) AS pass, 'f' || (l_partkey % 50) AS path, l_suppkey AS line_no, l_returnflag AS text, ['critical','high','medium','low'][l_linenumber % 4 + 1] AS severity,
  ['open','fixed','false_positive'][l_orderkey % 3 + 1] AS status, l_orderkey * 100 + l_linenumber AS seq FROM lineitem)"""


@query("d4_review_rollup", W + _REVIEW + """, last AS (SELECT pass, path, line_no, text, arg_max(severity, seq) AS severity, arg_max(status, seq) AS status FROM reviews GROUP BY ALL)
 SELECT pass, count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (severity IN ('critical', 'high')) AS severe FROM last WHERE status <> 'false_positive' GROUP BY pass""")
def d4(spark, d):
    li = T.read(spark, d, "lineitem")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (by + 1).cast("int"))
    items = li.select(
        F.concat(F.lit("pass"), (F.col("l_suppkey") % 4).cast("string")).alias("pass"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")).alias("path"),
        F.col("l_suppkey").alias("line_no"),
        F.col("l_returnflag").alias("text"),
        pick(R.SEVERITIES, F.col("l_linenumber") % 4).alias("severity"),
        pick(["open", "fixed", "false_positive"], F.col("l_orderkey") % 3).alias("status"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )
    return fi.review_rollup(items)


@query("d5_autofix_breakdown", BASE + " SELECT repo, rule, count(*) AS n FROM findings WHERE certainty = 'HIGH' AND fix <> 'flag' GROUP BY ALL")
def d5(spark, d):
    return fi.autofix_breakdown(found(spark, d), "repo")


_SEV = "list_position(['critical','high','medium','low'], severity)"


@query("f1_top_findings", BASE + _MIXED + f" SELECT * FROM mixed ORDER BY list_position(['HIGH','MEDIUM','LOW'], certainty), {_SEV}, repo, path, line_no, rule LIMIT 30")
def f1(spark, d):
    return fi.top_findings(mixed(spark, d), 30)


@query("f5_compact_summary", BASE + """, top AS (SELECT * FROM findings ORDER BY repo, path, line_no, rule LIMIT 50), t AS (SELECT count(*) AS total FROM findings)
 SELECT severity, count(*) AS n, any_value(total) AS total, least(any_value(total), 50) AS showing, any_value(total) > 50 AS truncated FROM top, t GROUP BY severity""")
def f5(spark, d):
    return fi.compact_summary(found(spark, d), "severity", ["repo", "path", "line_no", "rule"], 50)


@query("g1_union_findings", BASE + """ SELECT repo, path, rule, line_no, NULL AS n FROM findings UNION ALL SELECT repo, path, 'blank_line_runs', first_line, n FROM (
  SELECT repo, path, min(line_no) AS first_line, count(*) AS n FROM (SELECT repo, path, line_no, line_no - row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS island FROM code_lines WHERE trim(line, ' ') = '') GROUP BY repo, path, island HAVING count(*) >= 3)""")
def g1(spark, d):
    runs = scan.blank_line_runs(T.code_lines(spark, d)).select("repo", "path", F.lit("blank_line_runs").alias("rule"), F.col("first_line").alias("line_no"), "n")
    return fi.union_findings(found(spark, d).select("repo", "path", "rule", "line_no"), runs)


@query("a14_write_findings", BASE + f" SELECT concat_ws('|', severity, rule, repo, path, line_no) AS row FROM (SELECT * FROM findings ORDER BY {_SEV}, repo, path, line_no, rule LIMIT 40)")
def a14(spark, d):
    """Written by severity, read back, and shown in compact form."""
    return io.compact_findings(spark.read.parquet(io.write_findings(found(spark, d))), 40)


@query("c19_fp_rate", BASE + " SELECT rule, count(*) AS n, round(avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END), 6) AS fp_rate FROM findings JOIN code_files USING (repo, path) JOIN labels USING (doc_id) GROUP BY rule")
def c19(spark, d):
    files = T.code_files(spark, d).select("repo", "path", "doc_id")
    labels = T.read(spark, d, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("wrong"))
    return fi.fp_rate(found(spark, d).join(files, ["repo", "path"]), labels)


_ITEMS = T.ISSUES + f""", items AS (SELECT number AS id, ['critical','high','medium','low','none'][number % 5 + 1] AS severity, ['security','bugs','infrastructure','features','documentation','other'][number % 6 + 1] AS category,
  number % 4 = 0 AS recent, date_diff('day', updated, DATE '{T.AS_OF}') AS days_stale FROM issues),
  scored AS (SELECT *, CAST(floor(round(CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 5 END
  * CAST(CASE category WHEN 'security' THEN 2.0 WHEN 'bugs' THEN 1.5 WHEN 'infrastructure' THEN 1.3 WHEN 'features' THEN 1.0 WHEN 'documentation' THEN 0.8 ELSE 1.0 END AS DOUBLE)
  * CAST(CASE WHEN recent THEN 1.2 ELSE 1.0 END AS DOUBLE) * CAST(CASE WHEN days_stale > 180 THEN 0.9 ELSE 1.0 END AS DOUBLE), 6) + 0.5) AS BIGINT) AS priority FROM items)"""


def items(spark, d):
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (F.col("number") % n + 1).cast("int"))
    return T.issues(spark, d).select(
        F.col("number").alias("id"),
        pick([*R.SEVERITIES, "none"], 5).alias("severity"),
        pick(["security", "bugs", "infrastructure", "features", "documentation", "other"], 6).alias("category"),
        (F.col("number") % 4 == 0).alias("recent"),
        F.datediff(F.lit(T.AS_OF), "updated").alias("days_stale"),
    )


@query("f3_priority", W + _ITEMS + " SELECT id, priority FROM scored")
def f3(spark, d):
    return fi.priority(items(spark, d)).select("id", "priority")


@query("f4_time_buckets", W + _ITEMS + """, b AS (SELECT *, CASE WHEN severity = 'critical' OR priority >= 15 THEN 'immediate' WHEN severity = 'high' OR priority >= 10 THEN 'short' WHEN priority >= 5 THEN 'medium' ELSE 'backlog' END AS bucket FROM scored),
  p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY priority DESC, id) AS place FROM b)
  SELECT id, bucket, priority, place FROM p WHERE place <= CASE bucket WHEN 'immediate' THEN 5 WHEN 'short' THEN 10 WHEN 'medium' THEN 15 ELSE 20 END""")
def f4(spark, d):
    return fi.time_buckets(fi.priority(items(spark, d))).select("id", "bucket", "priority", "place")


_HAS = lambda w: f"len(list_filter(labels, lambda x: regexp_matches(x, '{w}'))) > 0"


@query(
    "f2_score_tasks",
    W + T.ISSUES + f""", recent AS (SELECT DISTINCT lower(p_name_word) AS word FROM (SELECT unnest(['login', 'export']) AS p_name_word)),
  rel AS (SELECT DISTINCT number FROM (SELECT number, unnest(regexp_split_to_array(lower(title), '\\W+')) AS word FROM issues) JOIN recent USING (word) WHERE length(word) > 3)
  SELECT number, CAST((CASE WHEN {_HAS('critical|p0')} THEN 100 ELSE 0 END) + (CASE WHEN {_HAS('high|p1')} THEN 50 ELSE 0 END) + (CASE WHEN {_HAS('medium|p2')} THEN 25 ELSE 0 END)
  + (CASE WHEN {_HAS('security')} THEN 40 ELSE 0 END) + (CASE WHEN regexp_matches(body, '(?i)blocks #\\d+') THEN 30 ELSE 0 END) + (CASE WHEN {_HAS('small|quick')} THEN 20 ELSE 0 END)
  - (CASE WHEN {_HAS('large|complex')} THEN 10 ELSE 0 END) + (CASE WHEN number IN (SELECT number FROM rel) THEN 15 ELSE 0 END)
  + (CASE WHEN len(list_filter(labels, lambda x: lower(x) = 'bug')) > 0 AND date_diff('day', created, DATE '{T.AS_OF}') > 30 THEN 10 ELSE 0 END) + (CASE WHEN reactions > 5 THEN 15 ELSE 0 END) AS BIGINT) AS score
  FROM issues ORDER BY score DESC, number LIMIT 5""",
)
def f2(spark, d):
    recent = spark.createDataFrame([("login",), ("export",)], "word string")
    return fi.score_tasks(T.issues(spark, d), F.broadcast(recent), T.AS_OF, 5)
