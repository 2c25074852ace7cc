"""Queries of documents and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..operators import documents as do
from ..operators import scan
from .findings import found
from .registry import query
from .scans import FINDINGS, W, q

MD = W + T.PAGES
SECTIONS = MD + r", sec AS (SELECT *, sum(CAST(regexp_matches(line, '^#{1,6}\s') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM md_lines)"


def pages(spark, d):
    return T.to_lines(T.doc_pages(spark, d))


@query("e7_sections", SECTIONS + " SELECT doc_id, line_no, CAST(section AS BIGINT) AS section FROM sec")
def e7(spark, d):
    return do.sections(pages(spark, d)).select("doc_id", "line_no", "section")


_LEVELS = r"lv AS (SELECT *, length(regexp_extract(line, '^(#+)', 1)) AS level FROM md_lines WHERE regexp_matches(line, '^#{1,6}\s'))"


@query("e8_heading_jumps", MD + ", " + _LEVELS + ', j AS (SELECT doc_id, line_no, lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS "before", level FROM lv) SELECT * FROM j WHERE level - "before" > 1')
def e8(spark, d):
    return do.heading_jumps(pages(spark, d))


def _sizes_sql(long: int, bare: int) -> str:
    return rf""", c AS (SELECT doc_id, CAST(section AS BIGINT) AS section, regexp_matches(line, '^#{{1,6}}\s') AS head, length(regexp_extract(line, '^(#{{1,6}}\s+)', 1)) AS marks,
  length(line) + CASE WHEN line_no = max(line_no) OVER (PARTITION BY doc_id) THEN 0 ELSE 1 END AS chars FROM sec),
 s AS (SELECT doc_id, section, CAST(ceil(sum(chars - CASE WHEN head THEN marks ELSE 0 END) / 4) AS BIGINT) AS tokens, CAST(ceil(sum(CASE WHEN head THEN 0 ELSE chars END) / 4) AS BIGINT) AS below FROM c GROUP BY ALL)
 SELECT doc_id, section, tokens, 'long' AS issue FROM s WHERE section > 0 AND tokens > {long} UNION ALL SELECT doc_id, section, tokens, 'no_headings' FROM s WHERE below > {bare}
 UNION ALL SELECT doc_id, section, tokens, 'tiny' FROM s WHERE section > 0 AND tokens < 20"""


@query("e9_section_sizes", SECTIONS + _sizes_sql(120, 20))
def e9(spark, d):
    """Sections of the fixture are short, so the limits are 120 and 20 tokens."""
    return do.section_sizes(pages(spark, d), 120, 20)


def _late_sql(source: str, least: int, share: float = 0.7) -> str:
    return f"SELECT doc_id, count(*) AS late FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {source}) WHERE line_no > floor(CAST({share} AS DOUBLE) * n) AND regexp_matches(line, {q(do.CRITICAL)}) GROUP BY doc_id HAVING count(*) >= {least}"


@query("e10_late_critical", MD + " " + _late_sql("md_lines", 2, 0.2))
def e10(spark, d):
    """Pages of the fixture end with prose, so the limits are two lines after a fifth of the page."""
    return do.late_critical(pages(spark, d), 0.2, 2)


_TERMS = " + ".join(f"len(regexp_extract_all(line, {q(p)}))" for p in do.BURIED)


def _buried_sql(source: str, least: int, length: int) -> str:
    return f"""SELECT doc_id, CAST(sum({_TERMS}) AS BIGINT) AS buried FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM {source} WHERE trim(line, ' ') <> '')
 WHERE n >= {length} AND rn > floor(CAST(0.3 AS DOUBLE) * n) AND rn <= floor(CAST(0.7 AS DOUBLE) * n) GROUP BY doc_id HAVING sum({_TERMS}) >= {least}"""


@query("e11_buried_critical", MD + " " + _buried_sql("md_lines", 2, 15))
def e11(spark, d):
    """Pages of the fixture are short, so the limits are 2 terms and 15 lines."""
    return do.buried_critical(pages(spark, d), 2, 15)


# Every document as a page: each seventh line is a heading, and each fifth one says that something must hold.
_EVERY = rf"""doc_text AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents),
 all_lines AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 0 THEN '## ' WHEN line_no % 5 = 2 THEN 'This must hold: ' ELSE '' END || line AS line FROM doc_text),
 sec AS (SELECT *, sum(CAST(regexp_matches(line, '^#{{1,6}}\s') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM all_lines)"""


def every_document(spark, d):
    """Lines of the whole text of every document; each seventh line is a heading, and each fifth one says that something must hold."""
    lines = T.to_lines(T.read(spark, d, "documents").select("doc_id", "text"), "text")
    mark = F.when(F.col("line_no") % 7 == 0, "## ").when(F.col("line_no") % 5 == 2, "This must hold: ").otherwise("")
    return lines.withColumn("line", F.concat(mark, "line"))


@query("e7_sections_documents", W + _EVERY + " SELECT doc_id, line_no, CAST(section AS BIGINT) AS section FROM sec")
def e7_every(spark, d):
    return do.sections(every_document(spark, d)).select("doc_id", "line_no", "section")


@query("e9_section_sizes_documents", W + _EVERY + _sizes_sql(1000, 500))
def e9_every(spark, d):
    """Sections of every document, with the production limits."""
    return do.section_sizes(every_document(spark, d))


@query("e10_late_critical_documents", W + _EVERY + " " + _late_sql("all_lines", 3))
def e10_every(spark, d):
    return do.late_critical(every_document(spark, d))


@query("e11_buried_critical_documents", W + _EVERY + " " + _buried_sql("all_lines", 5, 20))
def e11_every(spark, d):
    return do.buried_critical(every_document(spark, d))


@query("e12_context_dependent", SECTIONS + rf""", f AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) AS rn FROM sec WHERE section > 0 AND trim(line, ' ') <> '')
 SELECT doc_id, count(*) AS n FROM f WHERE rn = 2 AND regexp_matches(line, {q(do.DANGLING)}) GROUP BY doc_id HAVING count(*) >= 2""")
def e12(spark, d):
    return do.context_dependent(pages(spark, d))


@query("e13_mixed_topics", SECTIONS + rf""", o AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, section ORDER BY line_no) AS b FROM sec)
 SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) FILTER (b = '' AND regexp_matches(line, {q(do.TRANSITION)})) AS n FROM o GROUP BY ALL HAVING n >= 1""")
def e13(spark, d):
    """Sections of the fixture are short, so one transition is enough."""
    return do.mixed_topics(pages(spark, d), 1)


_FEATURES = "SELECT DISTINCT doc_id, feature FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM (SELECT doc_id, line_no, trim(regexp_extract(line, " + q(do.BULLET) + ", 1), ' ') AS feature FROM {0} WHERE regexp_matches(line, " + q(do.BULLET) + ")) WHERE length(feature) > 5 AND length(feature) < 80) WHERE place <= 20"
_PLANS = "SELECT doc_id, substr(plan, 1, 100) AS plan FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, line_no) AS place FROM (SELECT doc_id, line_no, 1 AS kind, regexp_extract(line, " + q(do.PLAN_LINE) + ", 1) AS plan FROM {0} UNION ALL SELECT doc_id, line_no, 2, regexp_extract(line, " + q(do.PLAN_HEADING) + ", 0) FROM {0}) WHERE plan <> '') WHERE place <= 15"


@query("i4_extract_features", MD + " " + _FEATURES.replace("{0}", "md_lines"))
def i4(spark, d):
    return do.bullet_features(pages(spark, d))


@query("i4_extract_plans", MD + " " + _PLANS.replace("{0}", "md_lines"))
def i4b(spark, d):
    return do.plans(pages(spark, d))


# Every document as a list: each line is a bullet with a bold begin and a tail, and each ninth one a plan.
_LISTED = "doc_text AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents), listed AS (SELECT doc_id, line_no, CASE WHEN line_no % 9 = 0 THEN 'Todo: ' || line ELSE '- **' || substr(line, 1, line_no % 90) || '** - ' || line END AS line FROM doc_text)"


def listed(spark, d):
    lines = T.to_lines(T.read(spark, d, "documents").select("doc_id", "text"), "text")
    bullet = F.concat(F.lit("- **"), F.substring("line", F.lit(1), (F.col("line_no") % 90).cast("int")), F.lit("** - "), "line")
    return lines.withColumn("line", F.when(F.col("line_no") % 9 == 0, F.concat(F.lit("Todo: "), "line")).otherwise(bullet))


@query("i4_extract_features_documents", W + _LISTED + " " + _FEATURES.replace("{0}", "listed"))
def i4_every(spark, d):
    return do.bullet_features(listed(spark, d))


@query("i4_extract_plans_documents", W + _LISTED + " " + _PLANS.replace("{0}", "listed"))
def i4b_every(spark, d):
    return do.plans(listed(spark, d))


def _condense_sql(x: str) -> str:
    for long, short in do.PHRASES:
        x = f"regexp_replace({x}, '\\b{long[0].upper()}(?i:{long[1:]})\\b', '{short[0].upper() + short[1:]}', 'g')"
        x = f"regexp_replace({x}, '\\b{long[0]}(?i:{long[1:]})\\b', '{short}', 'g')"
    return x


@query("j1_condense_phrases", MD + f", p AS (SELECT doc_id, unnest(string_split(content, '```')) AS x, unnest(generate_series(0, len(string_split(content, '```')) - 1)) AS i FROM md) SELECT doc_id, string_agg(CASE WHEN i % 2 = 0 THEN {_condense_sql('x')} ELSE x END, '```' ORDER BY i) AS content FROM p GROUP BY doc_id")
def j1(spark, d):
    return T.doc_pages(spark, d).select("doc_id", do.condense(F.col("content")).alias("content"))


_CALM = "content"
for _w in do.EMPHASIS:
    _CALM = f"regexp_replace({_CALM}, '\\b{_w}\\b', '{_w.lower()}', 'g')"


@query("j2_calm_emphasis", MD + f" SELECT doc_id, regexp_replace({_CALM}, '!{{2,}}', '!', 'g') AS content FROM md")
def j2(spark, d):
    return T.doc_pages(spark, d).select("doc_id", do.calm(F.col("content")).alias("content"))


@query("j3_fix_headings", MD + r""", fn AS (SELECT *, sum(CAST(starts_with(line, '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS fence FROM md_lines),
 hd AS (SELECT doc_id, line_no, line, length(regexp_extract(line, '^(#+)', 1)) AS level, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM fn WHERE fence % 2 = 0 AND regexp_matches(line, '^#{1,6}\s')),
 nw AS (SELECT doc_id, line_no, repeat('#', CAST(i + min(level - i) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER)) || regexp_replace(line, '^#+', '') AS fixed FROM hd)
 SELECT doc_id, line_no, coalesce(fixed, line) AS line FROM md_lines LEFT JOIN nw USING (doc_id, line_no)""")
def j3(spark, d):
    return do.fix_headings(pages(spark, d))


@query("j4_remove_flagged_lines", W + T.LINES + ", " + FINDINGS + " SELECT repo, path, string_agg(line, chr(10) ORDER BY line_no) AS content FROM code_lines ANTI JOIN (SELECT DISTINCT repo, path, line_no FROM findings WHERE fix = 'remove') USING (repo, path, line_no) GROUP BY repo, path")
def j4(spark, d):
    return do.remove_flagged(T.code_lines(spark, d).select("repo", "path", "line_no", "line"), found(spark, d))


_REST = r"regexp_replace(regexp_replace(line, '^[ \t]*', ''), '\s+$', '')"


@query("j5_normalise_whitespace", W + T.LINES + rf" SELECT repo, path, line_no, CASE WHEN {_REST} = '' THEN '' ELSE replace(regexp_extract(line, '^([ \t]*)', 1), chr(9), '    ') || {_REST} END AS line FROM code_lines")
def j5(spark, d):
    return T.code_lines(spark, d).select("repo", "path", "line_no", do.normal_whitespace(F.col("line")).alias("line"))


_METRICS = r"""length(text) AS chars, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS full_lines,
 len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, substr(sha256(text), 1, 16) AS hash16, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS snippet"""


@query("j9_text_metrics", f"SELECT doc_id, {_METRICS} FROM documents")
def j9(spark, d):
    return do.text_metrics(T.read(spark, d, "documents"), "doc_id")


@query("j6_scalars", W + T.FILES + r""" SELECT doc_id, CAST(ceil(length(content) / 4) AS BIGINT) AS tokens, substr(sha256(content), 1, 16) AS hash16, regexp_replace(replace('.\' || replace(path, '/', '\'), '\', '/'), '^\./', '') AS path,
 regexp_replace(path, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS escaped FROM code_files""")
def j6(spark, d):
    windows = F.concat(F.lit(".\\"), F.translate("path", "/", "\\"))
    return T.code_files(spark, d).select("doc_id", do.tokens(F.col("content")).alias("tokens"), do.hash16(F.col("content")).alias("hash16"), do.normal_path(windows).alias("path"), do.escape_regex(F.col("path")).alias("escaped"))


def _doc_rules_sql(source: str, key: str, verbose: bool) -> str:
    parts = []
    count = lambda text, p: f"len(regexp_extract_all({text}, {q(p)}))"
    measures = {
        "chars": "length(text)",
        "words": "len(regexp_split_to_array(text, '\\s+'))",
        "jumps": count(f"array_to_string(regexp_extract_all(text, {q(do.HEADINGS)}, 1), ' ')", do.JUMP),
        "paragraphs": "len(list_filter(regexp_split_to_array(text, '\\n\\n+'), lambda x: trim(x, ' ') <> ''))",
        "brief": "len(list_filter(regexp_split_to_array(text, '\\n\\n+'), lambda x: trim(x, ' ') <> '' AND length(x) <= 76))",
        "short": "len(list_filter(regexp_split_to_array(text, '(?m)^#{1,6}\\s+')[2:], lambda x: length(x) <= 76))",
    }
    for r in [*do.DOC_RULES, *do.TEXT_RULES]:
        if verbose or r.certainty != "LOW":
            when, value = r.render(count, f"regexp_extract(text, {q(do.FRONT)}, 1)", **measures)
            parts.append(f"SELECT {key}, '{r.name}' AS rule, '{r.category}' AS category, '{r.certainty}' AS certainty, {value} AS value FROM {source} WHERE {when}")
    return " UNION ALL ".join(parts)


@query("l1_doc_rule_scan", MD + ", texts AS (SELECT doc_id, content AS text FROM md) " + _doc_rules_sql("texts", "doc_id", True))
def l1(spark, d):
    """On the Markdown pages."""
    return do.doc_rule_scan(T.doc_pages(spark, d).select("doc_id", F.col("content").alias("text")), "doc_id", True)


@query("l1_doc_rule_scan_documents", W + "texts AS (SELECT doc_id, text FROM documents) " + _doc_rules_sql("texts", "doc_id", True))
def l1_documents(spark, d):
    """On the whole text of every document."""
    return do.doc_rule_scan(T.read(spark, d, "documents").select("doc_id", "text"), "doc_id", True)


@query("l1_prompt_rule_scan", W + "texts AS (SELECT conv_id * 100000 + turn AS turn_id, text FROM conversations) " + _doc_rules_sql("texts", "turn_id", False))
def l1b(spark, d):
    c = T.read(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("turn_id"), "text")
    return do.doc_rule_scan(c, "turn_id")


@query("k4_stall_detection", """WITH r AS (SELECT user_id AS key, event_id AS step, event_type AS digest FROM events), n AS (SELECT *, CASE WHEN lag(digest) OVER w IS DISTINCT FROM digest THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY key ORDER BY step)),
 u AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY step) AS run FROM n) SELECT key, digest, min(step) AS from_step, count(*) AS n FROM u GROUP BY key, run, digest HAVING count(*) >= 2""")
def k4(spark, d):
    e = T.read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("step"), F.col("event_type").alias("digest"))
    return do.stall_detection(e)


@query("b1_rule_scan_prompts", W + "pr AS (SELECT 'c' || conv_id AS repo, 't' || turn AS path, 'text' AS lang, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM conversations), hits AS (SELECT repo, path, line_no, 'long_sentence' AS rule FROM pr WHERE regexp_matches(line, '[^.,]{150,}')) SELECT * FROM hits")
def b1p(spark, d):
    """Sentences of 150 characters or more in the turns, by the rule engine."""
    from ..functions.rules import Rule

    c = T.read(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("repo"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("path"), F.lit("text").alias("lang"), F.col("text").alias("content"))
    return scan.rule_scan(T.to_lines(c), [Rule("long_sentence", r"[^.,]{150,}")]).select("repo", "path", "line_no", "rule")
