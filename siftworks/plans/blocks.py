"""Queries of function blocks."""

from __future__ import annotations

from .. import tables as T
from ..operators import blocks as bl
from .registry import query
from .scans import W, q

_COMMENT = r"(regexp_matches(line, '^\s*(//|\*|/\*)') OR (regexp_matches(line, '^\s*#') AND NOT regexp_matches(line, '^\s*#\[')))"
_MASK = rf"array_to_string(list_transform(regexp_extract_all(content, {q(bl.PIECES)}), lambda x: CASE WHEN regexp_matches(x, {q(bl.HIDDEN)}) THEN regexp_replace(x, '[^\n]+', '', 'g') ELSE x END), '')"
_BRACED = "(" + ", ".join(map(q, bl.BRACED)) + ")"
DEPTH = rf"""masked AS (SELECT repo, path, doc_id, lang, unnest(string_split(content, chr(10))) AS line, unnest(string_split(code, chr(10))) AS m, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no
 FROM (SELECT *, {_MASK} AS code FROM code_files)), delta AS (SELECT *, len(regexp_extract_all(m, '\{{')) - len(regexp_extract_all(m, '\}}')) AS dl FROM masked),
 depths AS (SELECT *, CAST(sum(dl) OVER (PARTITION BY repo, path ORDER BY line_no) AS BIGINT) AS depth, CAST(sum(dl) OVER (PARTITION BY repo, path ORDER BY line_no) - dl AS BIGINT) AS "before" FROM delta)"""
BLOCKS = DEPTH + rf""", ev AS (SELECT repo, path, line_no, unnest(regexp_extract_all(m, '[{{}}]')) AS c, unnest(generate_series(1, len(regexp_extract_all(m, '[{{}}]')))) AS k FROM masked WHERE lang IN {_BRACED}),
 lv AS (SELECT *, sum(CASE WHEN c = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY repo, path ORDER BY line_no, k) + CASE WHEN c = '{{' THEN 0 ELSE 1 END AS level FROM ev),
 nx AS (SELECT *, lead(line_no) OVER w AS nl, lead(c) OVER w AS nc FROM lv WINDOW w AS (PARTITION BY repo, path, level ORDER BY line_no, k)),
 brace_pairs AS (SELECT repo, path, line_no AS open_line, nl AS close_line, CAST(level AS BIGINT) AS depth FROM nx WHERE c = '{{' AND nc = '}}'),
 opens AS (SELECT *, min(CASE WHEN regexp_matches(m, '\{{') THEN line_no END) OVER w AS open_line, min(CASE WHEN regexp_matches(m, '[;}}]') THEN line_no END) OVER w AS stop FROM masked
  WHERE lang IN {_BRACED} WINDOW w AS (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 heads AS (SELECT repo, path, lang, line_no AS first_line, open_line FROM opens WHERE regexp_matches(m, {q(bl.FUNCTION)}) AND NOT regexp_matches(m, {q(bl.NO_HEAD)}) AND open_line <= coalesce(stop, open_line)),
 fb AS (SELECT repo, path, lang, first_line, open_line, arg_max(close_line, (-depth, close_line)) AS last_line FROM heads JOIN brace_pairs USING (repo, path, open_line) GROUP BY ALL),
 py AS (SELECT *, length(regexp_extract(line, '^([ \t]*)', 1)) AS ind FROM code_lines WHERE lang = 'python' AND trim(line, ' ') <> ''),
 ph AS (SELECT repo, path, lang, line_no AS first_line, ind AS head FROM py WHERE regexp_matches(line, '^\s*(?:async\s+)?def\s+\w+')),
 pe AS (SELECT h.repo, h.path, first_line, min(line_no) AS nxt FROM ph h JOIN py USING (repo, path) WHERE line_no > first_line AND ind <= head GROUP BY ALL), pl AS (SELECT repo, path, max(line_no) + 1 AS e FROM code_lines WHERE lang = 'python' GROUP BY ALL),
 ib AS (SELECT repo, path, lang, first_line, coalesce(nxt, e) - 1 AS last_line FROM ph LEFT JOIN pe USING (repo, path, first_line) JOIN pl USING (repo, path)),
 blocks AS (SELECT * FROM fb UNION ALL SELECT repo, path, lang, first_line, first_line, last_line FROM ib),
 inside AS (SELECT l.*, first_line FROM masked l JOIN blocks b USING (repo, path) WHERE line_no > open_line AND line_no <= last_line)"""
BASE = W + T.LINES + ", " + BLOCKS


@query("e1_brace_depth", BASE + " SELECT repo, path, line_no, depth, \"before\" FROM depths")
def e1a(spark, d):
    return bl.brace_depth(bl.code_lines(T.code_files(spark, d))).select("repo", "path", "line_no", "depth", "before")


@query("e1_brace_pairs", BASE + " SELECT * FROM brace_pairs")
def e1b(spark, d):
    return bl.brace_pairs(bl.code_lines(T.code_files(spark, d)).filter(f"lang IN {_BRACED}"))


@query("e1_function_blocks", BASE + " SELECT * FROM fb")
def e1(spark, d):
    return bl.function_blocks(bl.code_lines(T.code_files(spark, d)))


@query("e2_indent_blocks", BASE + " SELECT * FROM ib")
def e2(spark, d):
    return bl.indent_blocks(bl.code_lines(T.code_files(spark, d)))


@query("e3_doc_code_ratio", BASE + rf""", dm AS (SELECT repo, path, line_no, {_COMMENT} AS is_doc FROM code_lines), di AS (SELECT *, sum(CASE WHEN is_doc THEN 0 ELSE 1 END) OVER (PARTITION BY repo, path ORDER BY line_no) AS g FROM dm),
 isl AS (SELECT repo, path, count(*) AS doc, max(line_no) + 1 AS first_line FROM di WHERE is_doc GROUP BY repo, path, g)
 SELECT repo, path, first_line, doc, last_line - open_line AS body FROM blocks JOIN isl USING (repo, path, first_line) WHERE last_line - open_line >= 3 AND doc > 3.0 * (last_line - open_line)""")
def e3(spark, d):
    return bl.doc_code_ratio(bl.code_lines(T.code_files(spark, d)))


@query("e4_comment_ratio", BASE + rf""" SELECT repo, path, first_line, count(*) FILTER ({_COMMENT}) AS comments, count(*) FILTER (trim(line, ' ') <> '' AND NOT {_COMMENT}) AS code FROM inside GROUP BY ALL HAVING code >= 3 AND comments > 2.0 * code""")
def e4(spark, d):
    return bl.comment_ratio(bl.code_lines(T.code_files(spark, d)))


@query("e5_dead_code", BASE + rf""", sg AS (SELECT *, length(regexp_extract(line, '^([ \t]*)', 1)) AS ind FROM depths WHERE lang <> 'markdown' AND trim(line, ' ') <> '' AND NOT {_COMMENT}),
 nn AS (SELECT *, lead(line) OVER w AS nl, lead(line_no) OVER w AS nno, lead("before") OVER w AS nb, lead(ind) OVER w AS ni FROM sg WINDOW w AS (PARTITION BY repo, path ORDER BY line_no))
 SELECT repo, path, line_no, nno AS dead_line FROM nn WHERE regexp_matches(line, {q(bl.LEAVES)}) AND nno IS NOT NULL AND regexp_matches(line, '[;)\w''"\]}}]\s*$') AND NOT regexp_matches(line, '[,({{\[]\s*$')
 AND CASE WHEN lang = 'python' THEN ni = ind ELSE nb = "before" AND ni >= ind END AND NOT regexp_matches(nl, {q(bl.ENDS)})""")
def e5(spark, d):
    return bl.dead_code(bl.code_lines(T.code_files(spark, d)))


_CODE = rf"(trim(line, ' ') <> '' AND NOT {_COMMENT} AND NOT regexp_matches(line, '^\s*[}})\]];?\s*$'))"


_STUBS = " ".join(f"WHEN lang IN ({q(lang)}{', ' + q('typescript') if lang == 'javascript' else ''}) THEN regexp_matches(only_, {q(rx)})" for lang, rx in bl.STUBS.items())
_SIGNIFICANT = _CODE + r""" AND NOT (lang = 'python' AND regexp_matches(line, '^\s*("{3}|''{3})'))"""


@query("e6_stub_functions", BASE + rf""", body AS (SELECT repo, path, lang, first_line, line FROM inside UNION ALL
  SELECT repo, path, l.lang, first_line, regexp_extract(line, '\{{(.*)\}}', 1) FROM blocks b JOIN code_lines l USING (repo, path) WHERE b.first_line = l.line_no AND last_line = first_line AND l.lang <> 'python'),
 st AS (SELECT repo, path, lang, first_line, count(*) FILTER ({_SIGNIFICANT}) AS n, max(line) FILTER ({_SIGNIFICANT}) AS only_, bool_or(regexp_matches(line, {q(bl.STUB_TODO)})) AS todo FROM body GROUP BY ALL)
 SELECT repo, path, first_line, CASE WHEN todo THEN 'HIGH' ELSE 'MEDIUM' END AS certainty FROM st WHERE n = 1 AND CASE {_STUBS} ELSE false END""")
def e6(spark, d):
    return bl.stub_functions(bl.code_lines(T.code_files(spark, d)))


@query("e15_complexity", BASE + rf""", cx AS (SELECT repo, path, first_line, CAST(sum(len(regexp_extract_all(m, {q(bl.BRANCH)}))) + 1 AS BIGINT) AS complexity FROM inside WHERE NOT {_COMMENT} GROUP BY ALL)
 SELECT *, CASE WHEN complexity > 4 THEN 'high' WHEN complexity > 2 THEN 'medium' ELSE 'low' END AS level FROM cx""")
def e15(spark, d):
    """Functions of the fixture are short, so the limits are 2 and 4."""
    return bl.complexity(bl.code_lines(T.code_files(spark, d)), 2, 4)
