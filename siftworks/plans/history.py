"""Queries of symbols, snapshots and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..operators import history as hi
from ..operators import imports as im
from ..sources import io
from .registry import query
from .scans import W, q


def _rules_sql(rules, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{kind}' AS kind, regexp_extract(line, {q(rx)}, 1) AS name FROM code_lines WHERE lang IN ({', '.join(map(q, ls))}) AND regexp_matches(line, {q(rx)})" for ls, kind, rx in rules)


NAMES = f"found AS ({_rules_sql(hi.SYMBOLS, 'repo, path, lang, line, line_no')}), symbols AS (SELECT repo, path, lang, kind, name, min(line_no) AS line_no FROM found GROUP BY ALL)"
_LISTS = " UNION ALL ".join(f"SELECT repo, path, regexp_extract(line, {q(rx)}, 1) AS b FROM code_lines WHERE regexp_matches(line, {q(rx)})" for rx in (r"^\s*export\s*\{([^}]*)\}", r"module\.exports\s*=\s*\{([^}]*)\}", r"__all__\s*=\s*\[([^\]]*)\]"))
LISTS = rf"""listed AS (SELECT DISTINCT repo, path, name FROM (SELECT repo, path, regexp_replace(regexp_replace(trim(x, ' '), '^.*\sas\s+', ''), '[''"]|:.*$', '', 'g') AS name FROM (SELECT repo, path, unnest(string_split(b, ',')) AS x FROM ({_LISTS}))) WHERE name <> '')"""
EXPORTS = LISTS + rf""", exports AS (SELECT repo, path, name FROM found WHERE (lang IN ('javascript', 'typescript') AND regexp_matches(line, {q(hi.SHOWN["js"])})) OR (lang = 'python' AND NOT starts_with(name, '_') AND regexp_matches(line, {q(hi.SHOWN["py"])}))
 OR (lang = 'go' AND regexp_matches(name, '^[A-Z]')) OR (lang = 'rust' AND regexp_matches(line, {q(hi.SHOWN["rs"])})) OR (lang = 'java' AND regexp_matches(line, {q(hi.SHOWN["jv"])})) UNION SELECT repo, path, name FROM listed)"""


@query("h1_extract_symbols", W + T.LINES + ", " + NAMES + " SELECT * FROM symbols")
def h1(spark, d):
    return hi.extract_symbols(T.code_lines(spark, d))


@query("h2_export_rules", W + T.LINES + ", " + NAMES + ", " + EXPORTS + " SELECT * FROM exports")
def h2(spark, d):
    return hi.exports(T.code_lines(spark, d))


_IMPORTS = f"""imports AS (SELECT repo, path, source, replace(kind, '-group', '') AS kind, min(line_no) AS line_no FROM (SELECT repo, path, line_no, kind,
 unnest(CASE WHEN kind = 'import-group' THEN regexp_extract_all(name, '"([^"]+)"', 1) ELSE regexp_split_to_array(name, '\\s*,\\s*') END) AS source FROM ({_rules_sql(hi.IMPORTS, 'repo, path, line_no')})) WHERE source <> '' GROUP BY ALL)"""


@query("h3_extract_imports", W + T.LINES + ", " + _IMPORTS + " SELECT * FROM imports")
def h3(spark, d):
    return hi.extract_imports(T.code_lines(spark, d))


# Statements of several lines at each file's end; what they say is known by the file's number.
_GROUPS = {
    "javascript": "\nimport {\n  one,\n  two\n} from './g#';\nexport {\n  one as first#,\n  two\n};\nconst fresh# = async (\n  a,\n  b\n) => {\n};",
    "python": "\nfrom pack#.sub import (\n    one,\n    two,\n)\n__all__ = [\n    'left#',\n    'right',\n]",
    "go": "\nimport (\n\t\"net/http\"\n\tdb \"store/g#\"\n)",
    "rust": "\nuse crate::g#::{\n    One,\n    Two,\n};",
}
_GROUPS["typescript"] = _GROUPS["javascript"]


def grouped_lines(spark, d):
    text = F.lit("")
    for lang, group in _GROUPS.items():
        text = F.when(F.col("lang") == lang, F.replace(F.lit(group), F.lit("#"), F.col("doc_id").cast("string"))).otherwise(text)
    return hi.logical_lines(T.to_lines(T.code_files(spark, d).withColumn("content", F.concat("content", text))))


_ENDS = """ends AS (SELECT repo, path, doc_id, lang, len(string_split(content, chr(10))) + 1 AS n FROM code_files)"""


@query("h3_extract_imports_grouped", W + T.LINES + ", " + _IMPORTS + ", " + _ENDS + """ SELECT * FROM imports UNION ALL SELECT repo, path, './g' || doc_id, 'import', n FROM ends WHERE lang IN ('javascript', 'typescript')
 UNION ALL SELECT repo, path, 'pack' || doc_id || '.sub', 'from', n FROM ends WHERE lang = 'python' UNION ALL SELECT repo, path, unnest(['net/http', 'store/g' || doc_id]), 'import', n FROM ends WHERE lang = 'go'
 UNION ALL SELECT repo, path, 'crate::g' || doc_id, 'use', n FROM ends WHERE lang = 'rust'""")
def h3_grouped(spark, d):
    """Imports that go over several lines, beside those of one line."""
    return hi.extract_imports(grouped_lines(spark, d))


@query("h4_export_list_names_grouped", W + T.LINES + ", " + LISTS + ", " + _ENDS + """ SELECT * FROM listed UNION SELECT repo, path, unnest(['first' || doc_id, 'two']) FROM ends WHERE lang IN ('javascript', 'typescript')
 UNION SELECT repo, path, unnest(['left' || doc_id, 'right']) FROM ends WHERE lang = 'python'""")
def h4_grouped(spark, d):
    return hi.export_list_names(grouped_lines(spark, d))


@query("h1_extract_symbols_grouped", W + T.LINES + ", " + NAMES + ", " + _ENDS + " SELECT * FROM symbols UNION ALL SELECT repo, path, lang, 'function', 'fresh' || doc_id, n + 8 FROM ends WHERE lang IN ('javascript', 'typescript')")
def h1_grouped(spark, d):
    """Function heads cut in several lines, beside those of one line."""
    return hi.extract_symbols(grouped_lines(spark, d))


@query("h4_export_list_names", W + T.LINES + ", " + LISTS + " SELECT * FROM listed")
def h4(spark, d):
    return hi.export_list_names(T.code_lines(spark, d))


@query("h5_dependency_edges", W + T.LINES + ", " + _IMPORTS + " SELECT repo, path, list_sort(list(DISTINCT source)) AS sources FROM imports GROUP BY repo, path")
def h5(spark, d):
    return hi.dependency_edges(hi.extract_imports(T.code_lines(spark, d)))


_EDGES = "nodes AS (SELECT count(*) AS n FROM part), edges AS (SELECT p_partkey AS src, (3 * p_partkey + 1) % n AS dst FROM part, nodes UNION SELECT p_partkey, (7 * p_partkey + 2) % n FROM part, nodes)"


_CYCLES = """e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
 p(nodes, last, done) AS (SELECT [src, dst], dst, false FROM e WHERE src < dst UNION ALL SELECT CASE WHEN e.dst = nodes[1] THEN nodes ELSE list_append(nodes, e.dst) END, e.dst, e.dst = nodes[1] FROM p JOIN e ON p.last = e.src
   WHERE NOT done AND (e.dst = nodes[1] OR (e.dst > nodes[1] AND NOT list_contains(nodes, e.dst) AND len(nodes) < 6)))
 SELECT nodes AS cycle FROM p WHERE done"""
_COMPONENTS = """e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
 r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
 SELECT a.src AS file, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src"""


@query("h6_import_cycles", W.replace("WITH", "WITH RECURSIVE") + _EDGES + ", " + _CYCLES)
def h6(spark, d):
    return hi.import_cycles(import_edges(spark, d))


def import_edges(spark, d):
    part = T.read(spark, d, "part").select("p_partkey")
    n = part.count()
    return part.select(F.col("p_partkey").alias("src"), F.explode(F.array((3 * F.col("p_partkey") + 1) % n, (7 * F.col("p_partkey") + 2) % n)).alias("dst"))


@query("h6_import_components", W.replace("WITH", "WITH RECURSIVE") + _EDGES + ", " + _COMPONENTS)
def h6_components(spark, d):
    return hi.import_components(import_edges(spark, d))


# Files of one repository with a planted import: of each four documents 35 apart, each names the next and the last the first.
_NEXT = "CASE WHEN (doc_id // 35) % 4 = 3 THEN doc_id - 105 ELSE doc_id + 35 END"


def _linked_files(spark, d):
    to = F.when(F.floor(F.col("doc_id") / 35) % 4 == 3, F.col("doc_id") - 105).otherwise(F.col("doc_id") + 35)
    where, name = F.concat(F.lit("m"), (to % 5).cast("string")), F.concat(F.lit("f"), to.cast("string"))
    line = (
        F.when(F.col("lang").isin("javascript", "typescript"), F.concat(F.lit("\nimport { next } from '../"), where, F.lit("/"), name, F.lit("';")))
        .when(F.col("lang") == "python", F.concat(F.lit("\nfrom "), where, F.lit("."), name, F.lit(" import next")))
        .when(F.col("lang") == "java", F.concat(F.lit("\nimport src."), where, F.lit("."), name, F.lit(";")))
        .when(F.col("lang") == "rust", F.concat(F.lit("\nuse crate::"), where, F.lit("::"), name, F.lit(";")))
        .otherwise("")
    )
    return T.code_files(spark, d).withColumns({"repo": F.lit("all"), "content": F.concat("content", line)})


def _file_edges(spark, d):
    files = _linked_files(spark, d)
    return im.file_edges(hi.extract_imports(T.to_lines(files)), files)


# The edges by arithmetic on the document ids: planted ones, and heads of JavaScript and TypeScript that name a file beside them.
_REAL = T.FILES + f""", plain AS (SELECT doc_id, lang, path, {_NEXT} AS t, doc_id % 11 = 0 AS test, doc_id % 13 = 0 AS off, lang IN ('javascript', 'typescript') AS js FROM code_files),
 edges AS (SELECT 'all/' || a.path AS src, 'all/' || b.path AS dst FROM plain a JOIN plain b ON b.doc_id = a.t WHERE NOT b.test AND a.lang NOT IN ('go', 'markdown')
   AND (NOT a.js OR (NOT a.test AND a.off = b.off)) AND (a.lang <> 'rust' OR (NOT a.test AND a.off = b.off))
  UNION SELECT 'all/' || a.path, 'all/' || b.path FROM plain a JOIN plain b ON b.doc_id = (3 * a.doc_id + 1) % 1000 WHERE a.js AND b.js AND NOT a.test AND NOT b.test AND a.off = b.off AND a.doc_id % 5 = b.doc_id % 5)"""


@query("h5_file_edges", W + _REAL + " SELECT src, dst FROM edges WHERE src <> dst")
def h5_files(spark, d):
    """Imports of source files resolved to files."""
    return _file_edges(spark, d)


@query("h6_file_cycles", W.replace("WITH", "WITH RECURSIVE") + _REAL + ", " + _CYCLES)
def h6_files(spark, d):
    """Cycles of real imports, a planted one among them."""
    return hi.import_cycles(_file_edges(spark, d))


@query("h6_file_components", W.replace("WITH", "WITH RECURSIVE") + _REAL + ", " + _COMPONENTS)
def h6_file_components(spark, d):
    return hi.import_components(_file_edges(spark, d))


_SIG = r"trim(line, ' ') <> '' AND NOT regexp_matches(line, '^\s*(//|\*|/\*)') AND NOT (regexp_matches(line, '^\s*#') AND NOT regexp_matches(line, '^\s*#\['))"


@query("h7_duplicate_blocks", W + T.LINES + f""", sig AS (SELECT repo || '/' || path AS path, line_no, trim(line, ' ') AS t, row_number() OVER (PARTITION BY repo || '/' || path ORDER BY line_no) AS rn FROM code_lines WHERE {_SIG}),
 fr AS (SELECT path, rn, line_no, list(t) OVER w AS f FROM sig WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), frames AS (SELECT path, rn, line_no, md5(array_to_string(f, chr(10))) AS h FROM fr WHERE len(f) = 5),
 first_ AS (SELECT h, min(struct_pack(path := path, rn := rn, line_no := line_no)) AS a FROM frames GROUP BY h),
 pairs AS (SELECT a.path AS path_a, a.rn AS rn_a, a.line_no AS line_a, path AS path_b, rn, line_no FROM frames JOIN first_ USING (h) WHERE path <> a.path OR rn - a.rn >= 5),
 isl AS (SELECT *, rn - rn_a AS off, rn - row_number() OVER (PARTITION BY path_a, path_b, rn - rn_a ORDER BY rn) AS island FROM pairs)
 SELECT path_a, min(line_a) AS from_a, path_b, min(line_no) AS from_b, count(*) + 4 AS n FROM isl GROUP BY path_a, path_b, off, island""")
def h7(spark, d):
    return hi.duplicate_blocks(T.code_lines(spark, d).withColumn("path", F.concat("repo", F.lit("/"), "path")))


# Every third file's code stands in one line more or less: each line of it is cut at its spaces.
_WRAPPED = "wrapped AS (SELECT repo || '/' || path AS path, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(content, '(\\w) (\\w)', '\\1' || chr(10) || '\\2', 'g') ELSE content END AS content FROM code_files), code_lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no FROM wrapped)"


@query("h7_duplicate_tokens", W + T.FILES + ", " + _WRAPPED + f""", sig AS (SELECT path, line_no, regexp_extract_all(line, {q(hi.TOKEN)}) AS w FROM code_lines WHERE {_SIG}),
 tok AS (SELECT path, line_no, o, unnest(w) AS t, unnest(generate_series(1, len(w))) AS k FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS o FROM sig WHERE len(w) > 0)),
 num AS (SELECT *, row_number() OVER w AS pos, list(t) OVER f AS f, last_value(line_no) OVER f AS last_, last_value(o) OVER f AS o2 FROM tok WINDOW w AS (PARTITION BY path ORDER BY o, k), f AS (PARTITION BY path ORDER BY o, k ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
 frames AS (SELECT path, pos, line_no, last_, o, o2, md5(array_to_string(f, ' ')) AS h FROM num WHERE len(f) = 50),
 first_ AS (SELECT h, min(struct_pack(path := path, pos := pos, l1 := line_no, l2 := last_, o1 := o, o2 := o2)) AS a FROM frames GROUP BY h),
 pairs AS (SELECT a.path AS path_a, a.l1 AS l1, a.l2 AS l2, a.o1 AS ao1, a.o2 AS ao2, path AS path_b, pos, pos - a.pos AS off, line_no, last_, o, frames.o2 AS o2 FROM frames JOIN first_ USING (h) WHERE path <> a.path OR pos - a.pos >= 50),
 isl AS (SELECT *, pos - row_number() OVER (PARTITION BY path_a, path_b, off ORDER BY pos) AS island FROM pairs)
 SELECT path_a, min(l1) AS from_a, max(l2) AS to_a, path_b, min(line_no) AS from_b, max(last_) AS to_b, count(*) + 49 AS tokens FROM isl GROUP BY path_a, path_b, off, island HAVING greatest(max(ao2) - min(ao1), max(o2) - min(o)) + 1 >= 5""")
def h7_tokens(spark, d):
    """Copies by tokens; the lines of every third file are wrapped, which hides none."""
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("content", r"(\w) (\w)", "$1\n$2")).otherwise(F.col("content"))
    files = T.code_files(spark, d).select(F.lit("all").alias("repo"), F.concat("repo", F.lit("/"), "path").alias("path"), wrapped.alias("content"))
    return hi.duplicate_tokens(T.to_lines(files))


_PAIRS = r"""code AS (SELECT hash, list(path) AS paths FROM commit_files WHERE regexp_matches(path, '\.(js|ts|py|go|rs|java)$') AND NOT regexp_matches(path, '(?i)tests?/') GROUP BY hash HAVING count(*) BETWEEN 2 AND 20),
 flat AS (SELECT hash, unnest(paths) AS path FROM code), pairs AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS times FROM flat a JOIN flat b ON a.hash = b.hash AND a.path < b.path GROUP BY ALL HAVING count(*) >= 3)"""


@query("h8_co_change_pairs", W + T.COMMIT_FILES + ", " + _PAIRS + " SELECT * FROM pairs")
def h8a(spark, d):
    return hi.co_change_pairs(T.commit_files(spark, d))


@query("h8_co_change", W + T.COMMIT_FILES + ", " + _PAIRS + """, both_ AS (SELECT * FROM pairs UNION ALL SELECT file_b, file_a, times FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY file_a ORDER BY times DESC, file_b) AS rank, count(*) OVER (PARTITION BY file_a) AS degree FROM both_)
 SELECT file_a AS file, degree, list(file_b ORDER BY rank) AS partners, CASE WHEN degree >= 10 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE rank <= 5 AND degree >= 5 GROUP BY file_a, degree""")
def h8(spark, d):
    return hi.co_change(hi.co_change_pairs(T.commit_files(spark, d)))


@query("d19_map_stats", W + T.LINES + ", " + NAMES + " SELECT repo, count(DISTINCT path) AS files, count(*) AS symbols FROM symbols GROUP BY repo")
def d19(spark, d):
    return hi.map_stats(hi.extract_symbols(T.code_lines(spark, d)))


@query("a13_snapshot", W + T.LINES + ", " + NAMES + " SELECT repo, path, kind, name FROM symbols WHERE lang = 'python'")
def a13(spark, d):
    """Two snapshots written, one loaded."""
    symbols = hi.extract_symbols(T.code_lines(spark, d)).select("repo", "path", "lang", "kind", "name")
    folder = io.write_snapshot(symbols.filter("lang = 'python'").drop("lang"), "one")
    io.write_snapshot(symbols.filter("lang = 'go'").drop("lang"), "two", folder)
    return io.load_snapshot(spark, folder, "one")


@query("a13_snapshot_status", W + T.LINES + ", " + NAMES + " SELECT lang AS snapshot, count(*) AS symbols, lang = 'go' AS stale FROM symbols WHERE lang IN ('go', 'python') GROUP BY lang")
def a13_status(spark, d):
    """Two snapshots written, one of them marked as stale."""
    symbols = hi.extract_symbols(T.code_lines(spark, d)).select("repo", "path", "lang", "kind", "name")
    folder = io.write_snapshot(symbols.filter("lang = 'python'").drop("lang"), "python")
    io.write_snapshot(symbols.filter("lang = 'go'").drop("lang"), "go", folder)
    io.mark_stale(spark, folder, "go")
    return io.snapshot_status(spark, folder)


@query("g3_removed_exports", W + T.LINES + ", " + NAMES + ", " + EXPORTS + " SELECT repo, path, name FROM exports EXCEPT SELECT repo, path, name FROM listed")
def g3(spark, d):
    lines = T.code_lines(spark, d)
    return hi.exports(lines).subtract(hi.export_list_names(lines))


_SNAPS = """old AS (SELECT repo || '/' || path AS path, sha256(content) AS hash FROM code_files WHERE doc_id % 10 <> 0), new AS (SELECT repo || '/' || path AS path, sha256(content || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'x' ELSE '' END) AS hash FROM code_files WHERE doc_id % 10 <> 1)"""


def snapshots(spark, d):
    files = T.code_files(spark, d)
    path = F.concat("repo", F.lit("/"), "path").alias("path")
    grown = F.concat("content", F.when(F.col("doc_id") % 7 == 0, "\nx").otherwise(""))
    return files.filter("doc_id % 10 <> 0").select(path, F.sha2("content", 256).alias("hash")), files.filter("doc_id % 10 <> 1").select(path, F.sha2(grown, 256).alias("hash"))


@query("i5_snapshot_diff", W + T.FILES + ", " + _SNAPS + " SELECT path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM old o FULL JOIN new n USING (path) WHERE o.hash IS DISTINCT FROM n.hash")
def i5(spark, d):
    return hi.snapshot_diff(*snapshots(spark, d))


@query("i6_apply_changes", W + T.LINES + ", " + NAMES + """, s AS (SELECT repo || '/' || path AS path, name, doc_id FROM symbols JOIN (SELECT repo, path, doc_id FROM code_files) USING (repo, path))
 SELECT CASE WHEN doc_id % 5 = 1 THEN path || '.moved' ELSE path END AS path, name FROM s WHERE doc_id % 5 NOT IN (0, 2) AND doc_id % 3 <> 0 UNION ALL SELECT path, name FROM s WHERE doc_id % 5 = 2 AND doc_id % 2 = 0""")
def i6(spark, d):
    files = T.code_files(spark, d).select("repo", "path", "doc_id")
    s = hi.extract_symbols(T.code_lines(spark, d)).join(files, ["repo", "path"]).select(F.concat("repo", F.lit("/"), "path").alias("path"), "name", "doc_id")
    by = F.col("doc_id") % 5
    status = F.when(by == 0, "D").when(by == 1, "R").when(by == 2, "M")
    at = F.concat("repo", F.lit("/"), "path")
    changes = files.select(status.alias("status"), at.alias("from_path"), F.when(by == 1, F.concat(at, F.lit(".moved"))).alias("to_path")).filter("status IS NOT NULL")
    return hi.apply_changes(s.filter("doc_id % 3 <> 0").select("path", "name"), changes, s.filter("doc_id % 2 = 0").select("path", "name"))


@query("i7_staleness", W + T.ISSUES + ", " + T.COMMITS + """, c AS (SELECT repo, hash, ts FROM commits JOIN issues ON number = hash), b AS (SELECT repo, min(hash) FILTER (hash % 3 = 1) AS base FROM c GROUP BY repo),
 s AS (SELECT repo, CASE WHEN repo = 'repo0' THEN NULL WHEN repo = 'repo1' THEN -1 ELSE base END AS base, 'main' AS branch, CASE WHEN repo = 'repo2' THEN 'next' ELSE 'main' END AS now_branch FROM b),
 j AS (SELECT s.*, c.ts AS base_ts FROM s LEFT JOIN c ON s.repo = c.repo AND s.base = c.hash), l AS (SELECT j.repo, count(*) AS behind FROM j JOIN c ON j.repo = c.repo AND c.ts > base_ts GROUP BY j.repo)
 SELECT repo, CASE WHEN base IS NULL THEN 'no_base' WHEN base_ts IS NULL THEN 'base_gone' WHEN branch <> now_branch THEN 'branch_changed' WHEN coalesce(behind, 0) > 50 THEN 'rebuild' WHEN coalesce(behind, 0) > 0 THEN 'stale' ELSE 'fresh' END AS status, coalesce(behind, 0) AS behind FROM j LEFT JOIN l USING (repo)""")
def i7(spark, d):
    commits = T.commits(spark, d).join(T.issues(spark, d).select("repo", F.col("number").alias("hash")), "hash").select("repo", "hash", "ts")
    base = commits.groupBy("repo").agg(F.min(F.when(F.col("hash") % 3 == 1, F.col("hash"))).alias("b"))
    snaps = base.select("repo", F.when(F.col("repo") == "repo0", None).when(F.col("repo") == "repo1", -1).otherwise(F.col("b")).alias("base"), F.lit("main").alias("branch"), F.when(F.col("repo") == "repo2", "next").otherwise("main").alias("now_branch"))
    return hi.staleness(snaps, commits)
