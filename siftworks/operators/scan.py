"""Scans, predicates and rule findings over files and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import joint, may_match_any
from ..functions.rules import COMMENTED_CODE, RULES, SECRETS, SECURITY, Rule, excluded_regex

#: Rules from which on their patterns are joined.
JOINED = 8
# Extensions, folders that hold no sources, and test paths.
LANGUAGE_OF = {".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".mjs": "js", ".cjs": "js", ".rs": "rust", ".go": "go", ".py": "python", ".java": "java"}
EXCLUDED_DIRS = ["node_modules", "vendor", "dist", "build", "out", "target", ".git", ".svn", ".hg", "__pycache__", ".pytest_cache", "coverage", ".nyc_output", ".next", ".nuxt", ".cache"]
TEST_PATH = r"\.test\.[jt]sx?$|\.spec\.[jt]sx?$|_tests?\.(go|rs|py)$|test_.*\.py$|__tests__|(?i:tests?/)"
CLAIM_PATH = r"(?i)(^|/)(README|CHANGELOG)|\.(md|js|ts|py|go|rs|java)$"
LABELS = {"bugs": ["bug", "fix", "error", "issue", "defect"], "security": ["security", "vulnerability", "cve", "auth"], "features": ["enhancement", "feature", "new", "improvement"]}


def tag_language(files: DataFrame) -> DataFrame:
    """Adds `language` from the extension; unknown ones count as js."""
    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    found = reduce(lambda c, kv: c.when(ext == kv[0], kv[1]), LANGUAGE_OF.items(), F.when(F.lit(False), ""))
    return files.withColumn("language", found.otherwise("js"))


def exclude_dirs(files: DataFrame, names: list[str] = EXCLUDED_DIRS) -> DataFrame:
    return files.filter(~F.arrays_overlap(F.split("path", r"[\\/]"), F.array(*map(F.lit, names))))


def drop_test_files(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("path").rlike(TEST_PATH))


def ignore_regex(glob: Column) -> Column:
    """Regex of an ignore glob: `**` any text, `*` within a name, `?` one character; a leading slash anchors."""
    body = F.regexp_replace(F.regexp_replace(glob, r"^!", ""), r"/$", "")
    plain = F.regexp_replace(F.regexp_replace(body, r"^/", ""), r"([.+^$()|\[\]{}\\])", r"\\$1")
    some = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\*\*/?", "\u0001"), r"\*", "[^/]*"), r"\?", "[^/]")
    some = F.replace(some, F.lit("\u0001"), F.lit(".*"))
    return F.concat(F.when(body.rlike("/"), "^").otherwise("(^|/)"), some, F.lit("(/|$)"))


def apply_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drops ignored paths. rules: (repo, seq, glob) in order; the last one that matches wins, `!` takes back."""
    globs = rules.select("repo", "seq", F.col("glob").startswith("!").alias("back"), ignore_regex(F.col("glob")).alias("rx"))
    hit = files.select("repo", "path").distinct().join(globs, "repo").filter(F.expr("path rlike rx"))
    ignored = hit.groupBy("repo", "path").agg(F.max_by(~F.col("back"), "seq").alias("ignored")).filter("ignored")
    return files.join(ignored.select("repo", "path"), ["repo", "path"], "left_anti")


def select_rules(language: str | None = None, severity: str | None = None, fix: str | None = None) -> list[Rule]:
    """Rules of a language and universal ones, of a severity, of a fix."""
    return [r for r in RULES if (language is None or r.language in (language, None)) and severity in (None, r.severity) and fix in (None, r.fix)]


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules from a table, in order of its column `seq`: name, pattern, severity, fix, language, exclude, part, group, reject, predicate; only the first two are needed.

    A table of rules is a catalogue, so its rows are read to the driver, where they become one projection.
    """
    known = [c for c in ("name", "pattern", "severity", "fix", "language", "exclude", "part", "group", "reject", "predicate") if c in table.columns]
    rows = (table.orderBy("seq") if "seq" in table.columns else table).select(*known).collect()
    return [Rule(**{k: tuple(v) if k == "exclude" else v for k, v in r.asDict().items() if v is not None}) for r in rows]


def rule_scan(lines: DataFrame, rules: list[Rule] | DataFrame = RULES) -> DataFrame:
    """Findings: one row a line and rule that fires. lines: (repo, path, lang, line_no, line).

    All rules, those of a table too, are one projection over the lines, however long: no join, no shuffle. Before a pattern is
    tried, the line is searched for the strings that the pattern can't do without; where there are many rules, lines are
    read once by all their patterns joined first, and only those that some pattern may match go on.
    """
    rules = rules_of(rules) if isinstance(rules, DataFrame) else rules
    if len(rules) >= JOINED and not any(r.predicate for r in rules) and (all_ := joint([r.pattern for r in rules])) is not None:
        lines = lines.filter(may_match_any(all_, F.col("line")))

    def hit(r: Rule) -> Column:
        cond = r.fires(F.col("line"), F.col("lower"))
        if r.language:
            cond = F.col("lang").isin(*(["javascript", "typescript"] if r.language == "javascript" else [r.language])) & cond
        if (rx := excluded_regex(r)) is not None:
            cond = cond & ~F.col("path").rlike(rx)
        return F.when(cond, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.fix).alias("fix")))

    rows = lines.select("repo", "path", "lang", "line_no", "line", F.lower("line").alias("lower"))
    found = rows.select("repo", "path", "line_no", F.explode(F.array_compact(F.array(*map(hit, rules)))).alias("f"), "line")
    return found.select("repo", "path", "line_no", "f.rule", "f.severity", "f.fix", F.lit("HIGH").alias("certainty"), F.substring(F.trim("line"), 1, 100).alias("content"))


def secret_scan(lines: DataFrame) -> DataFrame:
    return rule_scan(lines, [r for r in RULES if r.name in SECRETS])


def rule_runs(lines: DataFrame, rule: Rule = COMMENTED_CODE, least: int = 5) -> DataFrame:
    """Runs of at least `least` consecutive lines that fire: (repo, path, first_line, last_line, n)."""
    return runs(lines.filter(rule.fires(F.col("line"))), least)


def runs(hits: DataFrame, least: int) -> DataFrame:
    by = Window.partitionBy("repo", "path").orderBy("line_no")
    island = hits.select("repo", "path", "line_no", (F.col("line_no") - F.row_number().over(by)).alias("island"))
    out = island.groupBy("repo", "path", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least).drop("island")


def blank_line_runs(lines: DataFrame) -> DataFrame:
    """More than two blank lines in a row."""
    return runs(lines.filter(F.trim("line") == ""), 3)


def entropy_filter(strings: DataFrame, least: float = 4.5) -> DataFrame:
    """(id, entropy) of the strings (id, s) whose Shannon entropy is at least `least` bits a character; ids tell strings apart."""
    chars = strings.select("id", F.explode(F.split("s", "")).alias("c")).filter("c <> ''")
    each = chars.groupBy("id", "c").count().groupBy("id").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log2("count")).alias("w"))
    return each.select("id", F.round(F.log2("n") - F.col("w") / F.col("n"), 6).alias("entropy")).filter(F.col("entropy") >= least)


def keyword_search(texts: DataFrame, keyword: str, id_col: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows whose text holds the keyword, whatever the case; a page of them by id."""
    return texts.filter(F.lower("text").contains(keyword.lower())).orderBy(id_col).offset(offset).limit(limit)


def filter_by_label(tasks: DataFrame, category: str) -> DataFrame:
    """Tasks with a label that holds one of the category's words."""
    return tasks.filter(F.exists("labels", lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(w) for w in LABELS[category]])))


# Folders and texts that tell what kind of prompt a document is.
PROMPT_FOLDERS = {"agent": "/agents/", "command": "/commands/", "skill": "/skills/", "prompt": "/prompts/"}
AGENT_TEXT, SYSTEM_TEXT = r"(?m)^---\s*\nname:\s*\w+", r"(?i)<system>|(?im)^##?\s*system\s+prompt"


def prompt_type(docs: DataFrame) -> DataFrame:
    """Adds `kind`: by folder first, then by front matter and system prompts, else markdown."""
    path = F.translate(F.lower("path"), "\\", "/")
    kind = reduce(lambda c, kv: c.when(path.contains(kv[1]), kv[0]), PROMPT_FOLDERS.items(), F.when(F.lit(False), ""))
    return docs.withColumn("kind", kind.when(F.col("content").rlike(AGENT_TEXT), "agent").when(F.col("content").rlike(SYSTEM_TEXT), "prompt").otherwise("markdown"))


VALIDATION = "validate|check|verify|sanitize"
WRITERS = r"^tools:\s*.*\b(?:Write|Edit)\b(?:\s*$|\s*[^(\s])"


def security_scan(lines: DataFrame) -> DataFrame:
    """Security rules, `$ARGUMENTS` without a word of validation in it or the five lines before, and front matter that lets a tool write anywhere."""
    plain = rule_scan(lines, SECURITY).select("repo", "path", "line_no", "rule")
    by = Window.partitionBy("repo", "path").orderBy("line_no")
    fence = (F.col("line") == "---").cast("int")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumns({"seen": F.max(F.lower("line").rlike(VALIDATION).cast("int")).over(by.rowsBetween(-5, 0)), "top": F.first(fence).over(by), "fences": F.coalesce(F.sum(fence).over(before), F.lit(0))})
    raw = marked.filter(F.col("line").contains("$ARGUMENTS") & (F.col("seen") == 0))
    # a second fence has to close the front matter: one stands in a later line
    closed = F.sum(fence).over(Window.partitionBy("repo", "path")) > 1
    broad = marked.withColumn("closed", closed).filter((F.col("top") == 1) & (F.col("fences") == 1) & F.col("closed") & F.col("line").rlike(WRITERS))
    named = lambda rows, rule: rows.select("repo", "path", "line_no", F.lit(rule).alias("rule"))
    return plain.unionByName(named(raw, "missing_input_validation")).unionByName(named(broad, "broad_file_access"))


def find_claim_docs(files: DataFrame) -> DataFrame:
    """Documents and sources, without tests and excluded folders, that may hold claims."""
    return drop_test_files(exclude_dirs(files)).filter(F.col("path").rlike(CLAIM_PATH))
