"""Queries of aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..operators import scan
from ..operators import summaries as su
from .registry import query
from .scans import _LANG, W, q


def tagged(spark, d):
    return scan.tag_language(T.code_files(spark, d))


TAGGED = T.FILES + f", tagged AS (SELECT *, {_LANG} AS language FROM code_files)"
_COUNT = lambda rx: f"len(regexp_extract_all(content, {q(rx)}))"
_EXPORTS = "CASE language " + " ".join(f"WHEN '{k}' THEN {' + '.join(map(_COUNT, v))}" for k, v in su.EXPORTS.items()) + f" ELSE {' + '.join(map(_COUNT, su.EXPORTS['js']))} END"
_BLOCK = q(su.BLOCK_COMMENT)
_PLAIN = f"array_to_string(list_transform(regexp_split_to_array(content, {_BLOCK}), lambda x, i: x || ' ' || coalesce(regexp_replace(regexp_extract_all(content, {_BLOCK})[i], '[^\\n]+', '', 'g'), '')), '')"
_STARTS = " OR ".join(f"starts_with(trim(x, ' '), {q(m)})" for m in su.LINE_COMMENTS)
_CODE = f"len(list_filter(string_split(regexp_replace({_PLAIN}, '[\\t\\r]', ' ', 'g'), chr(10)), lambda x: trim(x, ' ') <> '' AND NOT ({_STARTS})))"
COUNTED = TAGGED + f", counted AS (SELECT *, {_EXPORTS} AS exports, {_CODE} AS code_lines FROM tagged)"


@query("d6_count_source_lines", W + COUNTED + " SELECT doc_id, code_lines FROM counted")
def d6(spark, d):
    return su.count_source_lines(tagged(spark, d)).select("doc_id", "code_lines")


@query("d7_count_exports", W + COUNTED + " SELECT doc_id, exports FROM counted")
def d7(spark, d):
    return su.count_exports(tagged(spark, d)).select("doc_id", "exports")


_ENTRY = ", ".join(map(q, su.ENTRY_POINTS))
SURFACE = COUNTED + f""", sums AS (SELECT repo, coalesce(sum(exports) FILTER (path IN ({_ENTRY})), 0) AS e, coalesce(sum(exports) FILTER (starts_with(path, 'src/')), 0) AS s FROM counted GROUP BY repo),
 surface AS (SELECT repo, CAST(CASE WHEN e > 0 THEN e WHEN s > 0 THEN s ELSE 1 END AS BIGINT) AS surface, CASE WHEN e > 0 THEN 'entry_points' WHEN s > 0 THEN 'src' ELSE 'fallback' END AS method FROM sums)"""


@query("d8_public_surface", W + SURFACE + " SELECT * FROM surface")
def d8(spark, d):
    return su.public_surface(su.count_exports(tagged(spark, d)))


@query(
    "d9_over_engineering",
    W + SURFACE + f""", per AS (SELECT repo, count(*) AS files, sum(code_lines) AS lines, max(len(string_split(path, '/')) - 1) AS depth FROM counted GROUP BY repo),
 m AS (SELECT repo, 'files_per_export' AS metric, round(files / surface, 2) AS value, {su.FILES_PER_EXPORT}.0 AS threshold, {2 * su.FILES_PER_EXPORT}.0 AS high FROM per JOIN surface USING (repo)
 UNION ALL SELECT repo, 'lines_per_export', round(lines / surface, 2), {su.LINES_PER_EXPORT}.0, {2 * su.LINES_PER_EXPORT}.0 FROM per JOIN surface USING (repo) UNION ALL SELECT repo, 'depth', depth, {su.DEPTH}.0, {su.DEPTH + 2}.0 FROM per)
 SELECT repo, metric, CAST(value AS DOUBLE) AS value, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN value > high THEN 'high' WHEN value > threshold THEN 'medium' ELSE 'ok' END AS severity FROM m""",
)
def d9(spark, d):
    return su.over_engineering(tagged(spark, d))


@query("d10_dir_profile", W + T.FILES + " SELECT repo, string_split(path, '/')[1] AS folder, count(*) AS files, max(len(string_split(path, '/')) - 1) AS max_depth FROM code_files GROUP BY ALL")
def d10(spark, d):
    return su.dir_profile(T.code_files(spark, d))


@query("d10_top_extensions", W + T.FILES + r" SELECT regexp_extract(path, '(\.[^./]*)$', 1) AS extension, count(*) AS files FROM code_files GROUP BY ALL ORDER BY files DESC, extension LIMIT 10")
def d10b(spark, d):
    return su.top_extensions(T.code_files(spark, d))


_FLAGS = lambda hs: ", ".join(f"regexp_matches(lower(array_to_string({hs}[1:10], ' ')), '{rx}') AS {name}" for name, rx in su.SECTION_WORDS.items())


@query(
    "d11_doc_profile",
    W + T.PAGES + rf""", h AS (SELECT *, regexp_extract_all(content, '(?m)^##\s+(.+)$', 1) AS hs FROM md)
 SELECT doc_id, len(hs) AS sections, hs[1:10] AS headings, {_FLAGS('hs')}, CAST(floor(len(regexp_extract_all(content, '```')) / 2) AS BIGINT) AS code_blocks, len(regexp_split_to_array(content, '\s+')) AS words FROM h""",
)
def d11(spark, d):
    return su.doc_profile(T.doc_pages(spark, d))


_BOXES = r"""boxes AS (SELECT repo, len(regexp_extract_all(content, '(?im)^\s*[-*]\s+\[x\]')) AS done, len(regexp_extract_all(content, '(?m)^\s*[-*]\s+\[ \]')) AS todo FROM md),
 progress AS (SELECT repo, CAST(sum(done) AS BIGINT) AS checked, CAST(sum(todo) AS BIGINT) AS unchecked, CAST(sum(done + todo) AS BIGINT) AS total FROM boxes GROUP BY repo)"""


@query("d12_checkbox_progress", W + T.PAGES + ", " + _BOXES + " SELECT * FROM progress")
def d12(spark, d):
    return su.checkbox_progress(T.doc_pages(spark, d))


# The first page of a repository stands as its README.md if its number is even, and a changelog beside it if that has a third digit of 0.
_ROOTS = rf"""root AS (SELECT repo, min(doc_id) AS i, arg_min(content, doc_id) AS content FROM md GROUP BY repo), h AS (SELECT repo, i % 2 = 0 AS readme, i % 3 = 0 AS changelog, regexp_extract_all(content, '(?m)^##\s+(.+)$', 1) AS hs FROM root),
 have AS (SELECT repo, readme, changelog, {_FLAGS('hs')} FROM h)"""


@query("d13_doc_gaps", W + T.PAGES + ", " + _ROOTS + """ SELECT repo, 'missing' AS type, 'README.md' AS file, NULL AS section, 'high' AS severity FROM have WHERE NOT readme
 UNION ALL SELECT repo, 'missing-section', 'README.md', 'Installation', 'medium' FROM have WHERE readme AND NOT has_install UNION ALL SELECT repo, 'missing-section', 'README.md', 'Usage', 'medium' FROM have WHERE readme AND NOT has_usage
 UNION ALL SELECT repo, 'missing', 'CHANGELOG.md', NULL, 'low' FROM have WHERE NOT changelog""")
def d13(spark, d):
    root = T.doc_pages(spark, d).groupBy("repo").agg(F.min("doc_id").alias("i"), F.min_by("content", "doc_id").alias("content"))
    names = F.array(F.when(F.col("i") % 2 == 0, "README.md").otherwise("page.md"), F.when(F.col("i") % 3 == 0, "CHANGELOG.md").otherwise("other.md"))
    return su.doc_gaps(root.select("repo", F.explode(names).alias("path"), "content"))


# Settings and folders at the root stand in for some of the fixture's files.
_PLACES = {3: "README.md", 7: "biome.json", 11: ".github/workflows/ci.yml", 13: "docs/README.md", 17: "web/.eslintrc", 19: "k8s/Dockerfile", 23: "src/Login/Routes.tsx", 29: "server/migrations/1.sql"}
_PLACED = f"placed AS (SELECT repo, CASE doc_id % 31 {' '.join(f'WHEN {k} THEN {q(v)}' for k, v in _PLACES.items())} ELSE path END AS path FROM code_files)"


def placed(spark, d):
    files, path = T.code_files(spark, d), F.col("path")
    for k, name in _PLACES.items():
        path = F.when(F.col("doc_id") % 31 == k, name).otherwise(path)
    return files.select("repo", path.alias("path"))


_AT = lambda names: " OR ".join(f"path = {q(n)} OR starts_with(path, {q(n + '/')})" for n in names)


@query("d14_repo_health", W + T.FILES + ", " + _PLACED + f""" SELECT repo, bool_or({' OR '.join(f"starts_with(path, '{n}/')" for n in su.TEST_FOLDERS)}) AS has_tests, bool_or({_AT(su.LINT_FILES)}) AS has_linting,
 bool_or({_AT(su.CI_PLACES)}) AS has_ci, bool_or(path = 'README.md') AS has_readme FROM placed GROUP BY repo""")
def d14(spark, d):
    return su.repo_health(placed(spark, d))


TAGS = [("react", "react", 1), ("vue", "vue", 2), ("express", "express", 3), ("jest", "jest", 4), ("pytest", "pytest", 5)]


@query(
    "d15_stack_tags",
    W + f"""deps AS (SELECT source AS repo, ['react','vue','express','jest','pytest','left-pad'][doc_id % 6 + 1] AS dep FROM documents WHERE doc_id % 4 = 0), tags AS ({T.values(TAGS, 'dep, tag, seq')})
 SELECT repo, list_sort(list(DISTINCT tag)) AS tags, arg_min(tag, seq) AS "primary" FROM deps JOIN tags USING (dep) GROUP BY repo""",
)
def d15(spark, d):
    docs = T.read(spark, d, "documents").filter("doc_id % 4 = 0")
    dep = F.element_at(F.array(*map(F.lit, ["react", "vue", "express", "jest", "pytest", "left-pad"])), (F.col("doc_id") % 6 + 1).cast("int"))
    manifests = docs.select(F.col("source").alias("repo"), F.to_json(F.create_map(dep, F.lit("^1.0"))).alias("json"))
    return su.stack_tags(manifests, spark.createDataFrame(TAGS, "dep string, tag string, seq int"))


_FEAT = " UNION ".join(f"SELECT repo, '{f}' AS feature FROM dirs WHERE {' OR '.join(f'contains(lower(dir), {q(x)})' for x in w)}" for f, w in su.FEATURES.items())


@query("d16_implemented_features", W + T.FILES + ", " + _PLACED + ", dirs AS (SELECT DISTINCT repo, unnest(string_split(path, '/')[1 : -2]) AS dir FROM placed) " + _FEAT)
def d16(spark, d):
    return su.implemented_features(placed(spark, d))


_STOP = ", ".join(map(q, su.STOP_WORDS))


@query("d17_themes", W + T.ISSUES + f", w AS (SELECT unnest(regexp_split_to_array(lower(title), '\\s+')) AS word FROM issues) SELECT word, count(*) AS n FROM w WHERE length(word) > 3 AND word NOT IN ({_STOP}) GROUP BY word HAVING count(*) > 1 ORDER BY n DESC, word LIMIT 10")
def d17(spark, d):
    return su.themes(T.issues(spark, d))


_CAT = "CASE " + " ".join(f"WHEN len(list_filter(labels, lambda x: regexp_matches(lower(x), '(^|[^a-z]){w}s?([^a-z]|$)'))) > 0 THEN '{c}'" for w, c in su.CATEGORIES) + " ELSE 'other' END"


@query("d18_categorise_issues", W + T.ISSUES + f" SELECT repo, {_CAT} AS category, count(*) AS n FROM issues GROUP BY ALL")
def d18(spark, d):
    return su.categorise(T.issues(spark, d)).groupBy("repo", "category").agg(F.count("*").alias("n"))


@query(
    "d20_repeated_phrases",
    f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), {q(su.SPACES)}), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT doc_id, array_to_string(w[i : i + 2], ' ') AS phrase FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3))
 SELECT doc_id, phrase, count(*) AS times FROM g GROUP BY ALL HAVING count(*) >= 4""",
)
def d20(spark, d):
    return su.repeated_phrases(T.read(spark, d, "documents"))


@query("d21_duplicate_strings", W + T.LINES + r""", l AS (SELECT repo, path, unnest(regexp_extract_all(line, '''([^''\\]{3,})''|"([^"\\]{3,})"', 0)) AS literal FROM code_lines) SELECT *, count(*) AS n FROM l GROUP BY ALL HAVING count(*) > 1""")
def d21(spark, d):
    return su.duplicate_strings(T.code_lines(spark, d), 1)


@query("d22_contributors", W + T.COMMITS + " SELECT author, count(*) AS commits FROM commits GROUP BY author ORDER BY commits DESC, author LIMIT 10")
def d22(spark, d):
    return su.contributors(T.commits(spark, d))


NAME_VERBS = ["get", "fetch", "find", "set", "update", "create", "add", "delete", "remove", "list"]
_NAMES = f"names AS (SELECT DISTINCT {NAME_VERBS}[p_partkey % 10 + 1] || '_' || lower(replace(p_name, ' ', '_')) AS name FROM part)"
_NORMAL = "lower(name)"
for _rx, _to in su.VERBS:
    _NORMAL = f"regexp_replace({_NORMAL}, {q(_rx)}, '{_to}', 'g')"


@query("d24_name_collisions", W + _NAMES + f" SELECT {_NORMAL} AS normal, count(*) AS n, list_sort(list(name)) AS names FROM names GROUP BY 1 HAVING count(*) > 1")
def d24(spark, d):
    verb = F.element_at(F.array(*map(F.lit, NAME_VERBS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return su.name_collisions(T.read(spark, d, "part").select(F.concat(verb, F.lit("_"), F.lower(F.regexp_replace("p_name", " ", "_"))).alias("name")))


@query("d25_diff_stat", W + T.COMMIT_FILES + ", " + T.COMMITS + " SELECT status, count(*) AS changes, count(DISTINCT path) AS files FROM commit_files JOIN commits USING (hash) WHERE ts >= TIMESTAMP '1996-01-01' GROUP BY status")
def d25(spark, d):
    return su.diff_stat(T.commit_files(spark, d), T.commits(spark, d), "1996-01-01")


_SIGNALS = ", ".join(f"bool_or(regexp_matches(path, {q(rx)})) AS {name}" for name, rx in su.SIGNALS.items())


@query("d26_project_signals", W + T.FILES + ", " + _PLACED + f" SELECT repo, {_SIGNALS}, count(*) > 20 AS large FROM placed GROUP BY repo")
def d26(spark, d):
    return su.project_signals(placed(spark, d))


_DIFF = """diff AS (SELECT repo || '/' || path AS path, '+' || line AS line FROM code_lines), rej AS (SELECT DISTINCT repo || '/' || path AS path, true AS rejects FROM code_files WHERE doc_id % 2 = 0)"""


@query(
    "d28_branch_growth",
    W + T.LINES + ", " + _DIFF + r""", per AS (SELECT path, CAST(sum(""" + " + ".join(f"CAST(regexp_matches(line, {q(rx)}) AS BIGINT)" for rx in su.BRANCHES) + r""") AS BIGINT) AS branches, bool_or(regexp_matches(line, """ + q(su.ASYNC) + r""")) AS a FROM diff GROUP BY path)
 SELECT path, branches, CASE WHEN branches > 3 THEN 'high' WHEN branches > 0 THEN 'medium' ELSE 'none' END AS risk, a AND NOT coalesce(rejects, false) AS untested_async FROM per LEFT JOIN rej USING (path)""",
)
def d28(spark, d):
    at = F.concat("repo", F.lit("/"), "path")
    diff = T.code_lines(spark, d).select(at.alias("path"), F.concat(F.lit("+"), "line").alias("line"))
    tests = T.code_files(spark, d).filter("doc_id % 2 = 0").select(at.alias("path"), F.lit(True).alias("rejects")).distinct()
    return su.branch_growth(diff, tests)


@query("d29_check_rollup", "SELECT user_id AS change, count(*) FILTER (event_id % 7 IN (1, 2)) AS failed, count(*) FILTER (event_id % 7 IN (0, 3, 4, 5)) AS passed FROM events GROUP BY user_id")
def d29(spark, d):
    words = ["success", "failure", "cancelled", "success", "success", "success", "skipped"]
    checks = T.read(spark, d, "events").select(F.col("user_id").alias("change"), F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % 7 + 1).cast("int")).alias("conclusion"))
    return su.check_rollup(checks)


@query("f6_recent_commits", W + T.COMMITS + " SELECT hash, author, ts FROM commits ORDER BY ts DESC, hash LIMIT 20")
def f6(spark, d):
    return T.commits(spark, d).orderBy(F.desc("ts"), "hash").limit(20).select("hash", "author", "ts")


@query("f6_newest_tags", W + T.COMMITS + " SELECT 'v1.' || hash AS tag, ts FROM commits WHERE message LIKE 'feat%' ORDER BY ts DESC, tag LIMIT 10")
def f6b(spark, d):
    """Each feature commit is tagged."""
    tags = T.commits(spark, d).filter("message LIKE 'feat%'").select(F.concat(F.lit("v1."), F.col("hash").cast("string")).alias("tag"), "ts")
    return su.newest_tags(tags, 10)


@query("g2_distinct_features", W + T.FILES + " SELECT DISTINCT repo, lang FROM code_files")
def g2(spark, d):
    return T.code_files(spark, d).select("repo", "lang").distinct()


@query("i1_stale_items", W + T.ISSUES + f" SELECT number, date_diff('day', updated, DATE '{T.AS_OF}') AS days_stale FROM issues WHERE date_diff('day', updated, DATE '{T.AS_OF}') > 90")
def i1(spark, d):
    return su.stale_items(T.issues(spark, d), T.AS_OF).select("number", F.col("days_stale").cast("bigint").alias("days_stale"))


_MILES = "milestones AS (SELECT repo, title, state, updated + 45 AS due_on FROM issues WHERE number % 50 = 0)"


def milestones(spark, d):
    return T.issues(spark, d).filter("number % 50 = 0").select("repo", "title", "state", F.date_add("updated", 45).alias("due_on"))


@query("i2_overdue_milestones", W + T.ISSUES + ", " + _MILES + f" SELECT * FROM milestones WHERE state <> 'closed' AND due_on < DATE '{T.AS_OF}'")
def i2(spark, d):
    return su.overdue(milestones(spark, d), T.AS_OF)


@query(
    "i3_drift_indicators",
    W + T.PAGES + ", " + T.ISSUES + ", " + T.COMMIT_FILES + ", " + _MILES + ", " + _BOXES + f""", day AS (SELECT *, date_diff('day', updated, DATE '{T.AS_OF}') AS dd FROM issues),
 touched AS (SELECT repo, path, max(updated) AS updated FROM commit_files JOIN issues ON number = hash WHERE starts_with(path, 'docs/') GROUP BY repo, path)
 SELECT repo, 'milestone_late' AS indicator, max(date_diff('day', due_on, DATE '{T.AS_OF}')) AS value FROM milestones WHERE state <> 'closed' GROUP BY repo HAVING value >= 30
 UNION ALL SELECT repo, 'severe_stale', count(*) FROM day WHERE state = 'open' AND dd > 60 AND len(list_filter(labels, lambda x: regexp_matches(x, 'high|urgent'))) > 0 GROUP BY repo HAVING count(*) >= 5
 UNION ALL SELECT repo, 'docs_old', count(*) FROM touched WHERE date_diff('day', updated, DATE '{T.AS_OF}') >= 180 GROUP BY repo
 UNION ALL SELECT repo, 'drafts_old', count(*) FROM issues WHERE number % 11 = 0 AND state = 'open' AND date_diff('day', created, DATE '{T.AS_OF}') > 30 GROUP BY repo
 UNION ALL SELECT repo, 'plan_behind', CAST(floor(100 * checked / total) AS BIGINT) FROM progress WHERE total > 0 AND floor(100 * checked / total) < 30""",
)
def i3(spark, d):
    """Documents are as old as the last commit on them; every eleventh issue stands for a draft."""
    issues = T.issues(spark, d)
    touched = T.commit_files(spark, d).filter(F.col("path").startswith("docs/")).join(issues.withColumnRenamed("number", "hash"), "hash")
    docs = touched.groupBy("repo", "path").agg(F.max("updated").alias("updated"))
    pulls = issues.select("repo", "number", (F.col("number") % 11 == 0).alias("draft"), "state", "created")
    return su.drift_indicators(issues, milestones(spark, d), su.checkbox_progress(T.doc_pages(spark, d)), docs, pulls, T.AS_OF)


