"""Queries over scans, predicates and line rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import rules as R
from ..operators import scan
from ..sources import io
from .registry import query

W = "WITH "


def q(text: str) -> str:
    return T.quoted(text)


def scan_sql(rules: list[R.Rule], source: str = "code_lines", lines: str = "") -> str:
    """Findings of rules as SQL over (repo, path, lang, line_no, line)."""
    parts = []
    for r in rules:
        cond = r.sql()
        if r.language:
            cond += " AND lang IN ('javascript', 'typescript')" if r.language == "javascript" else f" AND lang = '{r.language}'"
        if (rx := R.excluded_regex(r)) is not None:
            cond += f" AND NOT regexp_matches(path, {q(rx)})"
        parts.append(f"SELECT repo, path, line_no, '{r.name}' AS rule, '{r.severity}' AS severity, '{r.fix}' AS fix, 'HIGH' AS certainty, substr(trim(line, ' '), 1, 100) AS content FROM {source} WHERE {cond}")
    return " UNION ALL ".join(parts)


FINDINGS = f"findings AS ({scan_sql(R.RULES)})"


@query("a1_scan_files", W + T.FILES + r" SELECT repo || '/' || path AS path, regexp_extract(path, '\.([^./]*)$', 1) AS language, length(content) AS size, len(string_split(content, chr(10))) AS n_lines FROM code_files WHERE lang <> 'markdown'")
def a1(spark, d):
    """Sources written as files and read whole, with their language."""
    folder = io.write_files(T.code_files(spark, d).filter("lang <> 'markdown'"))
    return io.scan_files(spark, folder)


@query("a2_to_lines", W + T.LINES + " SELECT repo, path, line_no, line FROM code_lines")
def a2(spark, d):
    return T.code_lines(spark, d).select("repo", "path", "line_no", "line")


_LANG = "CASE regexp_extract(path, '(\\.[^./]*)$', 1) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in scan.LANGUAGE_OF.items()) + " ELSE 'js' END"


@query("a3_tag_language", W + T.FILES + f" SELECT doc_id, path, {_LANG} AS language FROM code_files")
def a3(spark, d):
    return scan.tag_language(T.code_files(spark, d)).select("doc_id", "path", "language")


@query("a4_exclude_dirs", W + T.FILES + f" SELECT doc_id, path FROM code_files WHERE NOT list_has_any(string_split(path, '/'), {scan.EXCLUDED_DIRS})")
def a4(spark, d):
    return scan.exclude_dirs(T.code_files(spark, d)).select("doc_id", "path")


IGNORES = [("*.go", r"(^|/)[^/]*\.go(/|$)"), ("src/m1", r"^src/m1(/|$)"), ("!f1*.js", r"(^|/)f1[^/]*\.js(/|$)"), ("**/f2?.py", r"^.*f2[^/]\.py(/|$)"), ("/tests", r"^tests(/|$)"), ("!tests/f1*", r"^tests/f1[^/]*(/|$)")]
_IGNORED = ", ".join(f"CASE WHEN regexp_matches(path, {q(rx)}) THEN {i * 2 + (not g.startswith('!'))} ELSE -2 END" for i, (g, rx) in enumerate(IGNORES))


@query("a5_apply_ignore_rules", W + T.FILES + f" SELECT doc_id, path FROM code_files WHERE greatest({_IGNORED}) % 2 = 0")
def a5(spark, d):
    files = T.code_files(spark, d)
    globs = F.posexplode(F.array(*[F.lit(g) for g, _ in IGNORES]))
    rules = files.select("repo").distinct().select("repo", globs.alias("seq", "glob"))
    return scan.apply_ignore_rules(files, rules).select("doc_id", "path")


@query("a6_drop_test_files", W + T.FILES + f" SELECT doc_id, path FROM code_files WHERE NOT regexp_matches(path, {q(scan.TEST_PATH)})")
def a6(spark, d):
    return scan.drop_test_files(T.code_files(spark, d)).select("doc_id", "path")


_GLOBS = ["*.test.*", "**/tests/**", "src/*/f1*", "*.{js,ts}"]
_GLOB_SQL = ["^.*\\.test\\..*$", "^.*/tests/.*$", "^src/.*/f1.*$", "^.*\\.(js|ts)$"]


@query("a7_exclude_globs", W + T.FILES + " " + " UNION ALL ".join(f"SELECT doc_id, {q(g)} AS glob FROM code_files WHERE NOT regexp_matches(path, {q(x)})" for g, x in zip(_GLOBS, _GLOB_SQL, strict=True)))
def a7(spark, d):
    files = T.code_files(spark, d)
    kept = F.array_compact(F.array(*[F.when(~F.col("path").rlike(R.glob_regex(g)), F.lit(g)) for g in _GLOBS]))
    return files.select("doc_id", F.explode(kept).alias("glob"))


@query("a8_read_commit_log", W + T.COMMIT_FILES + " SELECT CAST(hash AS VARCHAR) AS hash, path FROM commit_files")
def a8(spark, d):
    """Commit log text (a header line, then file names) written and read back."""
    return io.read_commit_log(spark, io.write_commit_log(T.commit_files(spark, d)))


@query(
    "a9_read_name_status",
    W + T.COMMIT_FILES + """ SELECT CAST(hash AS VARCHAR) AS hash, CASE WHEN status = 'D' AND hash % 3 = 0 THEN 'R' ELSE status END AS status, path AS from_path,
    CASE WHEN status = 'D' AND hash % 3 = 0 THEN path || '.new' END AS to_path, CASE WHEN status = 'D' AND hash % 3 = 0 THEN CAST(hash % 101 AS INTEGER) END AS score, path LIKE '%.md' AS touches_docs FROM commit_files
    UNION ALL SELECT CAST(hash AS VARCHAR), 'M', path || '.new', NULL, NULL, path LIKE '%.md' FROM commit_files WHERE status = 'D' AND hash % 3 = 0 AND hash % 101 < 100""",
)
def a9(spark, d):
    return io.read_name_status(spark, io.write_name_status(T.commit_files(spark, d)))


@query("a10_read_issues", W + T.ISSUES + " SELECT number, title, labels, substr(body, 1, 200) AS snippet FROM issues")
def a10(spark, d):
    return io.read_issues(spark, io.write_issues(T.issues(spark, d)))


@query("a11_read_ndjson", "SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0")
def a11(spark, d):
    """Event rows as NDJSON with every tenth line broken."""
    return io.read_ndjson(spark, io.write_ndjson(T.read(spark, d, "events")), "event_id long, event_type string").select("event_id", "event_type")


@query("a12_read_task_list", W + T.PAGES + r""" SELECT repo, path, line_no, regexp_extract(line, '^\s*[-*]\s+\[ \]\s+(.*)$', 1) AS task FROM md_lines WHERE regexp_matches(line, '^\s*[-*]\s+\[ \]\s+')""")
def a12(spark, d):
    return io.read_task_list(T.to_lines(T.doc_pages(spark, d)))


@query("b1_rule_scan", W + T.LINES + ", " + FINDINGS + " SELECT * FROM findings")
def b1(spark, d):
    return scan.rule_scan(T.code_lines(spark, d))


@query("b1_rules_from_table", W + T.LINES + ", " + FINDINGS + " SELECT * FROM findings")
def b1_table(spark, d):
    """The catalogue written as a table, read back and scanned with."""
    rows = [(i, r.name, r.pattern, r.severity, r.fix, r.language, list(r.exclude), r.part, r.group, r.reject) for i, r in enumerate(R.RULES)]
    made = spark.createDataFrame(rows, "seq int, name string, pattern string, severity string, fix string, language string, exclude array<string>, part string, `group` int, reject string")
    folder = io.new_folder(spark, "rules")
    made.write.parquet(folder)
    return scan.rule_scan(T.code_lines(spark, d), spark.read.parquet(folder))


_TEXT = "text_lines AS (SELECT source AS repo, 'd' || doc_id AS path, 'text' AS lang, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents)"


def text_lines(spark, d):
    docs = T.read(spark, d, "documents")
    return T.to_lines(docs.select(F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit("text").alias("lang"), F.col("text").alias("content")))


@query("b1_rule_scan_documents", W + _TEXT + " " + scan_sql(R.RULES, "text_lines"))
def b1_docs(spark, d):
    return scan.rule_scan(text_lines(spark, d))


_RUNS = """hits AS (SELECT repo, path, line_no, line_no - row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS island FROM code_lines WHERE {cond})
 SELECT repo, path, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n FROM hits GROUP BY repo, path, island HAVING count(*) >= {least}"""


@query("b2_rule_runs", W + T.LINES + ", " + _RUNS.format(cond=R.COMMENTED_CODE.sql(), least=5))
def b2(spark, d):
    return scan.rule_runs(T.code_lines(spark, d))


@query("b3_select_rules", W + T.LINES + " " + scan_sql([r for r in R.RULES if r.language in ("javascript", None) and r.severity == "high" and r.fix == "flag"]))
def b3(spark, d):
    return scan.rule_scan(T.code_lines(spark, d), scan.select_rules("javascript", "high", "flag"))


@query("b4_secret_scan", W + T.LINES + " " + scan_sql([r for r in R.RULES if r.name in R.SECRETS]))
def b4(spark, d):
    return scan.secret_scan(T.code_lines(spark, d))


@query("b4_secret_scan_documents", W + _TEXT + " " + scan_sql([r for r in R.RULES if r.name in R.SECRETS], "text_lines"))
def b4_docs(spark, d):
    """Secrets in every line of the documents."""
    return scan.secret_scan(text_lines(spark, d))


@query(
    "b5_entropy_filter",
    """WITH c AS (SELECT doc_id AS id, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0),
    n AS (SELECT id, c, count(*) AS k FROM c GROUP BY ALL), e AS (SELECT id, sum(k) AS n, sum(k * log2(k)) AS w FROM n GROUP BY ALL)
    SELECT id, round(log2(n) - w / n, 6) AS entropy FROM e WHERE round(log2(n) - w / n, 6) >= 4.2""",
)
def b5(spark, d):
    return scan.entropy_filter(T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("s")), 4.2)


@query("b6_keyword_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 25 OFFSET 5")
def b6(spark, d):
    return scan.keyword_search(T.read(spark, d, "documents"), "License", "doc_id", 25, 5).select("doc_id", "lang")


@query("b7_filter_by_label", W + T.ISSUES + " SELECT number, labels FROM issues WHERE len(list_filter(labels, lambda x: regexp_matches(x, 'bug|fix|error|issue|defect'))) > 0")
def b7(spark, d):
    return scan.filter_by_label(T.issues(spark, d), "bugs").select("number", "labels")


_KINDS = " ".join(f"WHEN contains(lower(path), {q(f)}) THEN '{k}'" for k, f in scan.PROMPT_FOLDERS.items())
_HEADS = {4: "---\nname: a\n---\n", 5: "<system>\n", 6: "---\n\nname: b\n", 7: "x\n## System  Prompt\n"}


@query(
    "b8_prompt_type",
    W + T.FILES + f""", moved AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'kit/Agents/' WHEN 1 THEN 'kit/commands/' WHEN 2 THEN 'kit/skills/' WHEN 3 THEN 'kit/prompts/' ELSE '' END || path AS path,
    CASE doc_id % 9 {' '.join(f'WHEN {k} THEN {q(v)}' for k, v in _HEADS.items())} ELSE '' END || content AS content FROM code_files)
    SELECT doc_id, CASE {_KINDS} WHEN regexp_matches(content, {q(scan.AGENT_TEXT)}) THEN 'agent' WHEN regexp_matches(content, {q(scan.SYSTEM_TEXT)}) THEN 'prompt' ELSE 'markdown' END AS kind FROM moved""",
)
def b8(spark, d):
    at = F.col("doc_id") % 9
    folder = F.when(at == 0, "kit/Agents/").when(at == 1, "kit/commands/").when(at == 2, "kit/skills/").when(at == 3, "kit/prompts/").otherwise("")
    head = F.lit("")
    for k, v in _HEADS.items():
        head = F.when(at == k, v).otherwise(head)
    moved = T.code_files(spark, d).withColumns({"path": F.concat(folder, "path"), "content": F.concat(head, "content")})
    return scan.prompt_type(moved).select("doc_id", "kind")


_ARGS = f""", shell AS (SELECT repo, path, lang, line_no, CASE WHEN doc_id % 4 = 0 AND line_no = 1 THEN '---' WHEN doc_id % 4 = 0 AND line_no = 2 THEN 'tools: Read, Write' || CASE WHEN doc_id % 8 = 0 THEN '(src/*)' ELSE '' END
  WHEN doc_id % 12 = 0 AND line_no = 3 THEN '---' WHEN doc_id % 12 = 4 AND line_no = 4 THEN '---' WHEN line_no % 9 = 0 THEN 'run $ARGUMENTS now' WHEN line_no % 16 = 0 THEN 'Validate input' WHEN line_no % 23 = 0 THEN 'exec(`rm ${{x}}`)'
  WHEN line_no % 29 = 0 THEN 'file = ${{base}}/../x' WHEN line_no % 31 = 0 THEN 'eval (code)' ELSE line END AS line FROM code_lines),
seen AS (SELECT *, max(CAST(regexp_matches(lower(line), '{scan.VALIDATION}') AS INTEGER)) OVER (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s,
 first_value(line) OVER (PARTITION BY repo, path ORDER BY line_no) AS top, coalesce(sum(CAST(line = '---' AS INTEGER)) OVER (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f,
 sum(CAST(line = '---' AS INTEGER)) OVER (PARTITION BY repo, path) AS fs FROM shell)"""


@query("b9_security_scan", W + T.LINES + _ARGS + f""" SELECT repo, path, line_no, rule FROM ({scan_sql(R.SECURITY, 'shell')}) UNION ALL SELECT repo, path, line_no, 'missing_input_validation' FROM seen WHERE contains(line, '$ARGUMENTS') AND s = 0
 UNION ALL SELECT repo, path, line_no, 'broad_file_access' FROM seen WHERE top = '---' AND f = 1 AND fs > 1 AND regexp_matches(line, {q(scan.WRITERS)})""")
def b9(spark, d):
    n, i = F.col("line_no"), F.col("doc_id")
    line = (
        F.when((i % 4 == 0) & (n == 1), "---").when((i % 4 == 0) & (n == 2), F.concat(F.lit("tools: Read, Write"), F.when(i % 8 == 0, "(src/*)").otherwise("")))
        .when((i % 12 == 0) & (n == 3), "---").when((i % 12 == 4) & (n == 4), "---").when(n % 9 == 0, "run $ARGUMENTS now").when(n % 16 == 0, "Validate input").when(n % 23 == 0, "exec(`rm ${x}`)")
        .when(n % 29 == 0, "file = ${base}/../x").when(n % 31 == 0, "eval (code)").otherwise(F.col("line"))
    )
    return scan.security_scan(T.code_lines(spark, d).withColumn("line", line))


@query("b10_find_claim_docs", W + T.FILES + f" SELECT doc_id, path FROM code_files WHERE NOT list_has_any(string_split(path, '/'), {scan.EXCLUDED_DIRS}) AND NOT regexp_matches(path, {q(scan.TEST_PATH)}) AND regexp_matches(path, {q(scan.CLAIM_PATH)})")
def b10(spark, d):
    return scan.find_claim_docs(T.code_files(spark, d)).select("doc_id", "path")


@query("e14_blank_line_runs", W + T.LINES + ", " + _RUNS.format(cond="trim(line, ' ') = ''", least=3))
def e14(spark, d):
    return scan.blank_line_runs(T.code_lines(spark, d))
