"""Aggregates over files, documents, issues and commits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diffs import ASYNC, BRANCHES

# Entry points of libraries, exports by language, frameworks, feature words, label order.
ENTRY_POINTS = ["index.js", "index.ts", "src/index.js", "src/index.ts", "lib/index.js", "lib/index.ts", "main.js", "main.ts", "lib.rs", "src/lib.rs", "main.go", "__init__.py", "src/__init__.py", "Main.java", "src/Main.java", "App.java", "src/main/java/App.java"]
EXPORTS = {
    "js": [r"export\s+(?:function|class|const|let|var|default|async\s+function)", r"export\s*\{[^}]+\}", r"export\s*\*\s*(?:as\s+\w+\s+)?from", r"module\.exports\s*=", r"exports\.\w+\s*="],
    "rust": [r"(?m)^pub\s+(?:fn|struct|enum|mod|type|trait|const|static)"],
    "go": [r"(?m)^func\s+[A-Z]", r"(?m)^type\s+[A-Z]\w*\s+(?:struct|interface)", r"(?m)^var\s+[A-Z]", r"(?m)^const\s+[A-Z]"],
    "python": [r"__all__\s*=\s*\[", r"(?m)^def\s+[A-Za-z0-9]\w*\s*\(", r"(?m)^class\s+[A-Z]\w*[\s:(]"],
    "java": [r"(?m)^\s*public\s+(?:static\s+)?(?:final\s+)?(?:class|interface|enum)\s+\w+", r"(?m)^\s*public\s+(?:static\s+)?(?:final\s+)?(?:synchronized\s+)?(?:\w+(?:<[^>]*>)?)\s+\w+\s*\("],
}
FEATURES = {
    "authentication": ["auth", "login", "session", "jwt", "oauth"],
    "api": ["routes", "controllers", "handlers", "endpoints"],
    "database": ["models", "schemas", "migrations", "seeds"],
    "ui": ["components", "views", "pages", "layouts"],
    "testing": ["__tests__", "test", "spec", ".test.", ".spec."],
    "docs": ["docs", "documentation", "wiki"],
}
SECTION_WORDS = {"has_install": "install|setup|getting.started", "has_usage": "usage|how.to|example", "has_api": "api|reference|methods", "has_tests": "test|spec|coverage"}
LINT_FILES = [".eslintrc", ".eslintrc.js", ".eslintrc.json", "eslint.config.js", "biome.json"]
CI_PLACES = [".github/workflows", ".gitlab-ci.yml", ".circleci", "Jenkinsfile", ".travis.yml"]
TEST_FOLDERS = ["tests", "__tests__", "test", "spec"]
SIGNALS = {
    "has_db": "(?i)db|migrations?|schema|prisma|typeorm|sql",
    "has_api": "(?i)api|routes?|controllers?|handlers?",
    "has_frontend": r"\.(?:tsx|jsx|vue|svelte)$",
    "has_backend": "(?i)server|backend|services?|domain",
    "has_devops": r"(?i)\.github/workflows|Dockerfile|k8s|terraform",
}
STOP_WORDS = ["the", "a", "an", "is", "are", "to", "for", "in", "on", "at", "with", "and", "or", "of"]
CATEGORIES = [("bug", "bugs"), ("type: bug", "bugs"), ("feature", "features"), ("type: feature", "features"), ("enhancement", "enhancements"), ("security", "security"), ("type: security", "security")]
VERBS = [(r"[_ -]", ""), (r"^(get|fetch|retrieve|find|search)", "get"), (r"^(set|update|modify|change)", "set"), (r"^(create|make|add|new)", "create"), (r"^(delete|remove|destroy)", "delete")]
FILES_PER_EXPORT, LINES_PER_EXPORT, DEPTH = 20, 500, 4


def language_key(lang: str) -> str:
    return "js" if lang in ("javascript", "typescript") else lang


def count_exports(files: DataFrame) -> DataFrame:
    """Adds `exports`: matches of the language's export forms; unknown languages count as js."""
    out = None
    for lang, patterns in EXPORTS.items():
        n = reduce(lambda a, b: a + b, [F.regexp_count("content", F.lit(p)) for p in patterns])
        out = F.when(F.col("language") == lang, n) if out is None else out.when(F.col("language") == lang, n)
    js = reduce(lambda a, b: a + b, [F.regexp_count("content", F.lit(p)) for p in EXPORTS["js"]])
    return files.withColumn("exports", out.otherwise(js).cast("bigint"))


BLOCK_COMMENT = r"(?s)/\*.*?(?:\*/|\z)"
LINE_COMMENTS = ["//", "#", '"'+'""', "'"+"''"]


def count_source_lines(files: DataFrame) -> DataFrame:
    """Adds `code_lines`: lines that aren't blank or line comments of any language once block comments are out, whose line breaks stay."""
    comments = F.regexp_extract_all("content", F.lit(BLOCK_COMMENT), F.lit(0))
    breaks = lambda i: F.coalesce(F.regexp_replace(F.get(comments, i), r"[^\n]+", ""), F.lit(""))
    plain = F.array_join(F.transform(F.split("content", BLOCK_COMMENT), lambda x, i: F.concat(x, F.lit(" "), breaks(i))), "")
    code = lambda x: (F.trim(x) != "") & ~reduce(lambda a, b: a | b, [F.startswith(F.trim(x), F.lit(m)) for m in LINE_COMMENTS])
    lines = F.filter(F.split(F.regexp_replace(plain, r"[\t\r]", " "), "\n"), code)
    return files.withColumn("code_lines", F.size(lines).cast("bigint"))


def public_surface(files: DataFrame) -> DataFrame:
    """Per repo: exports of entry points, else of all sources under src, else 1; with the method taken."""
    entry = F.sum(F.when(F.col("path").isin(ENTRY_POINTS), F.col("exports")))
    src = F.sum(F.when(F.col("path").startswith("src/"), F.col("exports")))
    sums = files.groupBy("repo").agg(entry.alias("entry"), src.alias("src"))
    some = lambda c: F.nullif(F.coalesce(c, F.lit(0)), F.lit(0))
    return sums.select("repo", F.coalesce(some(F.col("entry")), some(F.col("src")), F.lit(1)).alias("surface"), F.when(some(F.col("entry")).isNotNull(), "entry_points").when(some(F.col("src")).isNotNull(), "src").otherwise("fallback").alias("method"))


def depth(path: Column) -> Column:
    return (F.size(F.split(path, "/")) - 1).cast("bigint")


def over_engineering(files: DataFrame) -> DataFrame:
    """Per repo and metric: value, threshold, severity (high at twice the threshold, depth at two more)."""
    counted = count_source_lines(count_exports(files))
    sums = counted.groupBy("repo").agg(F.count("*").alias("files"), F.sum("code_lines").alias("lines"), F.max(depth(F.col("path"))).alias("depth"))
    per = sums.join(public_surface(counted), "repo")
    metric = lambda name, value, limit, high: F.struct(F.lit(name).alias("metric"), F.round(value.cast("double"), 2).alias("value"), F.lit(float(limit)).alias("threshold"), F.lit(float(high)).alias("high"))
    rows = per.select(
        "repo",
        F.explode(
            F.array(
                metric("files_per_export", F.col("files") / F.col("surface"), FILES_PER_EXPORT, 2 * FILES_PER_EXPORT),
                metric("lines_per_export", F.col("lines") / F.col("surface"), LINES_PER_EXPORT, 2 * LINES_PER_EXPORT),
                metric("depth", F.col("depth"), DEPTH, DEPTH + 2),
            )
        ).alias("m"),
    )
    severity = F.when(F.col("value") > F.col("high"), "high").when(F.col("value") > F.col("threshold"), "medium").otherwise("ok")
    return rows.select("repo", "m.*").withColumn("severity", severity).drop("high")


def dir_profile(files: DataFrame) -> DataFrame:
    """Files and greatest depth by repo and first folder."""
    return files.groupBy("repo", F.split("path", "/").getItem(0).alias("folder")).agg(F.count("*").alias("files"), F.max(depth(F.col("path"))).alias("max_depth"))


def top_extensions(files: DataFrame, n: int = 10) -> DataFrame:
    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension").limit(n)


def section_flags(content: Column) -> dict[str, Column]:
    """Whether the first ten second-level headings hold words of the usual sections."""
    first = F.lower(F.array_join(F.slice(F.regexp_extract_all(content, F.lit(r"(?m)^##\s+(.+)$"), F.lit(1)), 1, 10), " "))
    return {name: first.rlike(rx) for name, rx in SECTION_WORDS.items()}


def doc_profile(docs: DataFrame) -> DataFrame:
    """Second-level sections, the first ten of them, flags for usual sections, fenced blocks and words."""
    headings = F.regexp_extract_all("content", F.lit(r"(?m)^##\s+(.+)$"), F.lit(1))
    return docs.select(
        "doc_id",
        F.size(headings).cast("bigint").alias("sections"),
        F.slice(headings, 1, 10).alias("headings"),
        *(flag.alias(name) for name, flag in section_flags(F.col("content")).items()),
        F.floor(F.regexp_count("content", F.lit("```")) / 2).alias("code_blocks"),
        F.size(F.split("content", r"\s+")).cast("bigint").alias("words"),
    )


def checkbox_progress(docs: DataFrame) -> DataFrame:
    """Per repo: checked, unchecked, total boxes."""
    done, todo = F.regexp_count("content", F.lit(r"(?im)^\s*[-*]\s+\[x\]")), F.regexp_count("content", F.lit(r"(?m)^\s*[-*]\s+\[ \]"))
    return docs.groupBy("repo").agg(F.sum(done).alias("checked"), F.sum(todo).alias("unchecked"), F.sum(done + todo).alias("total"))


def doc_gaps(files: DataFrame) -> DataFrame:
    """(repo, type, file, section, severity): no README.md or CHANGELOG.md at the root, or no section on installation or usage in README.md."""
    flags = section_flags(F.col("content"))
    readme, name = F.col("path") == "README.md", F.col("path")
    have = files.groupBy("repo").agg(
        F.bool_or(readme).alias("readme"), F.bool_or(name == "CHANGELOG.md").alias("changelog"),
        F.bool_or(readme & flags["has_install"]).alias("install"), F.bool_or(readme & flags["has_usage"]).alias("usage"),
    )
    row = lambda *v: F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(v, ("type", "file", "section", "severity"), strict=True)))
    gaps = F.array(
        F.when(~F.col("readme"), row("missing", "README.md", None, "high")),
        F.when(F.col("readme") & ~F.col("install"), row("missing-section", "README.md", "Installation", "medium")),
        F.when(F.col("readme") & ~F.col("usage"), row("missing-section", "README.md", "Usage", "medium")),
        F.when(~F.col("changelog"), row("missing", "CHANGELOG.md", None, "low")),
    )
    return have.select("repo", F.explode(F.array_compact(gaps)).alias("g")).select("repo", "g.*")


def repo_health(files: DataFrame) -> DataFrame:
    """Whether a repo has, at its root, a README.md, a linter's settings, settings of a build service, and a folder of tests."""
    p = F.col("path")
    at = lambda names: reduce(lambda a, b: a | b, [(p == n) | p.startswith(n + "/") for n in names])
    folder = reduce(lambda a, b: a | b, [p.startswith(n + "/") for n in TEST_FOLDERS])
    return files.groupBy("repo").agg(F.bool_or(folder).alias("has_tests"), F.bool_or(at(LINT_FILES)).alias("has_linting"), F.bool_or(at(CI_PLACES)).alias("has_ci"), F.bool_or(p == "README.md").alias("has_readme"))


def stack_tags(manifests: DataFrame, tags: DataFrame) -> DataFrame:
    """Frameworks and test framework of repos. manifests: (repo, json) with a dependency map; tags: (dep, tag, seq)."""
    deps = manifests.select("repo", F.explode(F.map_keys(F.from_json("json", "map<string,string>"))).alias("dep"))
    return deps.join(tags, "dep").groupBy("repo").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.min_by("tag", "seq").alias("primary"))


def implemented_features(files: DataFrame) -> DataFrame:
    """(repo, feature) where a folder's name holds one of the feature's words."""
    folders = files.select("repo", F.explode(F.array_distinct(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))))).alias("dir")).distinct()
    hits = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.lower("dir").contains(x) for x in w]), F.lit(f)) for f, w in FEATURES.items()]))
    return folders.select("repo", F.explode(hits).alias("feature")).distinct()


def themes(issues: DataFrame, top: int = 10) -> DataFrame:
    """Title words of more than three letters that stand in two titles or more, the most frequent."""
    words = issues.select(F.explode(F.split(F.lower("title"), r"\s+")).alias("word")).filter((F.length("word") > 3) & ~F.col("word").isin(STOP_WORDS))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(top)


def categorise(issues: DataFrame) -> DataFrame:
    """Adds `category` by the first label pattern that fits, in any case; plurals count, `debug` isn't a bug."""
    out = None
    for word, category in CATEGORIES:
        out = F.when(_label_fits(word), category) if out is None else out.when(_label_fits(word), category)
    return issues.withColumn("category", out.otherwise("other"))


def _label_fits(word: str) -> Column:
    pattern = rf"(^|[^a-z]){word}s?([^a-z]|$)"
    return F.exists("labels", lambda x: F.lower(x).rlike(pattern))


# Fixed value: white space that parts words, that beyond ASCII too; Java and RE2 know only ASCII's by \s.
SPACES = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def repeated_phrases(docs: DataFrame, n: int = 3, least: int = 4) -> DataFrame:
    """(doc_id, phrase, times): word n-grams that occur `least` times or more in a document."""
    # spaces beyond ASCII are looked for only in texts that have such letters, as they take long
    far = (F.octet_length("t") > F.length("t")) & F.col("t").rlike(r"[\x{a0}\x{1680}-\x{feff}]")
    words = F.filter(F.when(far, F.split("t", SPACES)).otherwise(F.split("t", r"\s+")), lambda x: x != "")
    grams = docs.select("doc_id", F.lower("text").alias("t")).select("doc_id", words.alias("w")).filter(F.size("w") >= n)
    starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
    # Sorted within the row, equal phrases make runs; a run's length is the distance to the next one. Nothing is shuffled.
    runs = grams.select("doc_id", F.array_sort(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).alias("s"))
    runs = runs.select("doc_id", "s", F.expr("filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i] <> s[i - 1])").alias("first"))
    times = F.expr("transform(first, (p, k) -> struct(s[p] AS phrase, cast(coalesce(get(first, k + 1), size(s)) - p AS bigint) AS times))")
    return runs.select("doc_id", F.inline(F.filter(times, lambda x: x["times"] >= least)))


def newest_tags(tags: DataFrame, top: int = 10) -> DataFrame:
    """The newest tags (tag, ts); of one time the lesser name first."""
    return tags.orderBy(F.desc("ts"), "tag").limit(top)


def duplicate_strings(lines: DataFrame, more_than: int = 5) -> DataFrame:
    """String literals that a file holds more than `more_than` times."""
    found = lines.select("repo", "path", F.explode(F.regexp_extract_all("line", F.lit(r"'([^'\\]{3,})'|\"([^\"\\]{3,})\""), F.lit(0))).alias("literal"))
    return found.groupBy("repo", "path", "literal").agg(F.count("*").alias("n")).filter(F.col("n") > more_than)


def contributors(commits: DataFrame, top: int = 10) -> DataFrame:
    return commits.groupBy("author").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "author").limit(top)


def name_collisions(names: DataFrame) -> DataFrame:
    """(normal, names): different names that are one after synonyms of verbs are folded."""
    normal = reduce(lambda c, r: F.regexp_replace(c, *r), VERBS, F.lower("name"))
    return names.select("name", normal.alias("normal")).distinct().groupBy("normal").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names")).filter("n > 1")


def diff_stat(changes: DataFrame, commits: DataFrame, since: str) -> DataFrame:
    """Changes by status since a point in time."""
    recent = commits.filter(F.col("ts") >= F.lit(since).cast("timestamp")).select("hash")
    return changes.join(recent, "hash").groupBy("status").agg(F.count("*").alias("changes"), F.countDistinct("path").alias("files"))


def project_signals(files: DataFrame) -> DataFrame:
    """What the paths of a repo point to, and whether it has more than 20 files."""
    return files.groupBy("repo").agg(*(F.bool_or(F.col("path").rlike(rx)).alias(name) for name, rx in SIGNALS.items()), (F.count("*") > 20).alias("large"))


def branch_growth(diff_lines: DataFrame, tests: DataFrame) -> DataFrame:
    """Added branches by file, a line once for each form, more than three are high; async code without a test of rejections. tests: (path, rejects)."""
    added = diff_lines.filter(F.col("line").startswith("+"))
    forms = reduce(lambda a, b: a + b, [F.col("line").rlike(rx).cast("long") for rx in BRANCHES])
    per = added.groupBy("path").agg(F.sum(forms).alias("branches"), F.bool_or(F.col("line").rlike(ASYNC)).alias("is_async"))
    both = per.join(tests, "path", "left")
    return both.select("path", "branches", F.when(F.col("branches") > 3, "high").when(F.col("branches") > 0, "medium").otherwise("none").alias("risk"), (F.col("is_async") & ~F.coalesce("rejects", F.lit(False))).alias("untested_async"))


def check_rollup(checks: DataFrame) -> DataFrame:
    """Failed and passed checks by change."""
    return checks.groupBy("change").agg(F.count_if(F.col("conclusion").isin("failure", "cancelled")).alias("failed"), F.count_if(F.col("conclusion") == "success").alias("passed"))


def stale_items(issues: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Items not updated for more than `days` days, with the days."""
    return issues.withColumn("days_stale", F.datediff(F.lit(as_of), "updated")).filter(F.col("days_stale") > days)


def overdue(milestones: DataFrame, as_of: str) -> DataFrame:
    return milestones.filter((F.col("state") != "closed") & F.col("due_on").isNotNull() & (F.col("due_on") < F.lit(as_of).cast("date")))


def drift_indicators(issues: DataFrame, milestones: DataFrame, progress: DataFrame, docs: DataFrame, pulls: DataFrame, as_of: str) -> DataFrame:
    """(repo, indicator, value): late milestones, little progress, many stale severe issues, old documents, old drafts.

    docs: (repo, path, updated); those unchanged for 180 days are counted. pulls: (repo, number, draft, state, created);
    open drafts of more than 30 days are counted. A null date counts for nothing.
    """
    late = milestones.filter(F.col("state") != "closed").groupBy("repo").agg(F.max(F.datediff(F.lit(as_of), "due_on")).alias("v")).filter("v >= 30")
    stale = stale_items(issues.filter("state = 'open'"), as_of, 60).filter(F.exists("labels", lambda x: x.rlike("high|urgent"))).groupBy("repo").agg(F.count("*").alias("v")).filter("v >= 5")
    old = docs.filter(F.datediff(F.lit(as_of), "updated") >= 180).groupBy("repo").agg(F.count("*").alias("v"))
    drafts = pulls.filter(F.col("draft") & (F.col("state") == "open") & (F.datediff(F.lit(as_of), "created") > 30)).groupBy("repo").agg(F.count("*").alias("v"))
    slow = progress.filter("total > 0").select("repo", F.floor(100 * F.col("checked") / F.col("total")).alias("v")).filter("v < 30")
    parts = [("milestone_late", late), ("severe_stale", stale), ("docs_old", old), ("drafts_old", drafts), ("plan_behind", slow)]
    return reduce(DataFrame.unionByName, [x.select("repo", F.lit(n).alias("indicator"), F.col("v").cast("bigint").alias("value")) for n, x in parts])
