"""Rules, word lists and forms: for each a text that fires and one that spares, with results set by hand."""

import pytest
from pyspark.sql import functions as F

from siftworks.functions import rules as R
from siftworks.operators import blocks, documents, findings, joins, scan, summaries
from siftworks.tables import to_lines

LONG = "plain words " * 400
RULE_CASES = {
    "missing_code_language": ("```\na\n```\n", "```js\na\n```\n```py\nb\n```"),
    "unnecessary_prose": ("In this guide, as you may know, we will cover it.", "In this guide. In this section. In this document."),
    "verbose_explanations": ("In order to win, prior to it, make use of it.", "In order to win, prior to it."),
    "readability_with_rag_suggestions": ("Short.\n\nShorter.\n\nTiny.", "A paragraph that goes on for long enough to be worth its place, as it has many words in it."),
    "structure_recommendations": ("- a\n* b\n", "- a\n- b\n"),
    "vague_instructions": ("usually often maybe, when appropriate", "usually often maybe"),
    "negative_only_constraints": ("Don't go. Don't run. Never stop. Do not eat. Avoid eating.", "Don't go. Don't run. Never stop. Do not eat. Avoid eating. Walk instead."),
    "missing_output_format": (LONG, LONG + "## Output format"),
    "aggressive_emphasis": ("STOP NOW AND LISTEN!! CRITICAL", "API JSON XML HTTP SQL CLI stop!"),
    "missing_xml_structure": ("# h\n" * 6 + "```", "# h\n" * 6 + "``` <rules>"),
    "missing_examples": ("Use this format. " * 100, "Use this format. " * 100 + "For example, so."),
    "missing_context_why": ("You must go on. " * 120, "You must go on because of it. " * 120),
    "redundant_cot": ("Think step by step. Reason through each step.", "Think step by step."),
    "prompt_bloat": ("x" * 10_001, "x" * 10_000),
    "json_without_schema": ("Respond with JSON.", "Respond with JSON.\n```json\n{}\n```"),
    "missing_role": ("Do it.", "You are a tester."),
    "agent_missing_output_format": ("Do it.", "## Response\n"),
    "missing_constraints": ("Do it.", "## What you must not do\n"),
    "missing_critical_rules": ("## Rules\n", "## Critical rules\n"),
    "missing_key_commands": ("run npm", "```bash\nnpm test\n```"),
    "deep_nesting": ("##### a\n##### b\n##### c\n", "##### a\n##### b\n"),
}


def test_document_rules_fire_and_spare(spark):
    assert sorted(RULE_CASES) == sorted(r.name for r in documents.DOC_RULES)
    rows = [(f"{name}/{i}", text) for name, pair in RULE_CASES.items() for i, text in enumerate(pair)]
    hits = {(r.id, r.rule) for r in documents.doc_rule_scan(spark.createDataFrame(rows, "id string, text string"), "id", True, documents.DOC_RULES).collect()}
    assert [n for n in RULE_CASES if (f"{n}/0", n) not in hits] == [] and [n for n in RULE_CASES if (f"{n}/1", n) in hits] == []
    levels = {r.name: r.certainty for r in documents.DOC_RULES}
    assert levels["missing_xml_structure"] == "HIGH" and levels["deep_nesting"] == "LOW" and levels["json_without_schema"] == "MEDIUM"


def pages(spark, texts):
    return to_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string"))


def test_section_measures(spark):
    long = "# One\n" + "word " * 560 + "\n# Two\nshort\n"  # 700 tokens below a heading
    got = {(r.doc_id, r.section, r.issue) for r in documents.section_sizes(pages(spark, [long, "x" * 2100, "# A\n" + "y" * 4100])).collect()}
    assert got == {(0, 1, "no_headings"), (0, 2, "tiny"), (1, 0, "no_headings"), (2, 1, "long"), (2, 1, "no_headings")}
    late = ["calm"] * 7 + ["This is important", "a security hole", "it may fail", "fine"]
    early = late[::-1]
    assert [r.doc_id for r in documents.late_critical(pages(spark, ["\n".join(late), "\n".join(early)])).collect()] == [0]
    middle = ["a"] * 7 + ["You must always go", "Note: never stop", "required"] + ["b"] * 10
    assert {(r.doc_id, r.buried) for r in documents.buried_critical(pages(spark, ["\n".join(middle), "\n".join(middle[:19])])).collect()} == {(0, 5)}
    dangling = "# A\n\nThis is it\n# B\nas mentioned above\n# C\nThat is it\n"
    assert {(r.doc_id, r.n) for r in documents.context_dependent(pages(spark, [dangling, "# A\nIt is\n# B\nfine"])).collect()} == {(0, 2)}
    mixed = "# A\n\nAlso one\n\nhowever two\n\nAnother point\n\nThen four\nFinally no\n\nTherefore no"
    assert {(r.section, r.n) for r in documents.mixed_topics(pages(spark, [mixed])).collect()} == {(1, 4)}


def test_features_and_plans(spark):
    text = "- **Fast lookup** - it is fast\n- well-known thing\n* stable order of items\n- tiny\n- stable order of items\ndo it todo: later\n## Roadmap for us\nPLAN: soon\n- " + "z" * 90
    features = sorted(r.feature for r in documents.bullet_features(pages(spark, [text])).collect())
    assert features == ["Fast lookup", "stable order of items"]
    assert [r.plan for r in documents.plans(pages(spark, [text])).collect()] == ["later", "soon", "## Roadmap"]


STUBS = {
    "a.js": ("javascript", "function a() {\n  // TODO later\n  return null;\n}\nfunction b() { return []; }\nfunction c() {\n  throw new Error('TODO');\n}"),
    "a.rs": ("rust", "fn a() -> String {\n    String::new()\n}\nfn b() {\n    todo!()\n}\nfn c() -> u8 {\n    7\n}"),
    "A.java": ("java", "public class A {\n    public List<A> a() {\n        return Collections.emptyList();\n    }\n    public int b() {\n        throw new NotImplementedException(\"x\");\n    }\n    public int c() {\n        return 1;\n    }\n}"),
    "a.go": ("go", "func a() []int {\n\treturn []int{}\n}\nfunc b() {\n\tpanic(\"no\")\n}\nfunc c() int {\n\treturn 1\n}"),
    "a.py": ("python", "def a():\n    \"\"\"Says.\"\"\"\n    return {}\n\ndef b():\n    raise NotImplementedError()\n\ndef c():\n    return 1\n"),
}


def test_stubs_by_language(spark):
    files = spark.createDataFrame([("r", p, lang, i, t) for i, (p, (lang, t)) in enumerate(STUBS.items())], "repo string, path string, lang string, doc_id long, content string")
    got = {(r.path, r.first_line, r.certainty) for r in blocks.stub_functions(blocks.code_lines(files)).collect()}
    assert got == {("a.js", 1, "HIGH"), ("a.js", 5, "MEDIUM"), ("a.rs", 1, "MEDIUM"), ("a.rs", 4, "HIGH"), ("A.java", 2, "MEDIUM"), ("A.java", 5, "MEDIUM"), ("a.go", 1, "MEDIUM"), ("a.go", 4, "MEDIUM"), ("a.py", 1, "MEDIUM"), ("a.py", 5, "MEDIUM")}


SETUPS = [
    ("javascript", "const db = new SqlDatabase(x)", "db", "SqlDatabase"), ("javascript", "let link = await connectAll()", "link", "All"), ("javascript", "var app = server.Start(1)", "app", "Infrastructure"),
    ("python", "pool = net.ThreadPool(2)", "pool", "ThreadPool"), ("python", "conn = await create_link()", "conn", "link"), ("go", "var cl Client = NewClient()", "cl", "Client"), ("go", "st := &RedisStore{}", "st", "RedisStore"),
    ("rust", "let b = WebBuilder::new().port(1).build();", None, None), ("rust", "let bb = WebBuilder::new().port(1).build();", "bb", "WebBuilder"), ("rust", "let mut qq = JobQueue::from(x);", "qq", "JobQueue"),
    ("java", "Web w2 = WebFactory.createNow(1);", "w2", "WebFactory"), ("java", "Web w3 = Web.builder().x().build();", "w3", "Web"), ("java", "@Autowired private UserService users;", "users", "Infrastructure"), ("java", "int n = count();", None, None),
]


def test_setups_and_their_usage(spark):
    rows = [("r", f"f{i}", lang, 1, line) for i, (lang, line, *_) in enumerate(SETUPS)]
    lines = spark.createDataFrame(rows, "repo string, path string, lang string, line_no long, line string")
    got = {(r.path, r.name, r.kind) for r in joins.extract_setups(lines).collect()}
    assert got == {(f"f{i}", name, kind) for i, (_, _, name, kind) in enumerate(SETUPS) if name}
    text = ["const used = createPool(1)", "used.get()", "const idx = createPool(1)", "x = idx [0]", "const arg = createPool(1)", "run(a, arg)", "const back = createPool(1)", "return wrap + back", "const lone = createPool(1)", "// lone words, lonely.x", "export const out = createPool(1)"]
    lines = spark.createDataFrame([("r", "a.js", "javascript", i, x) for i, x in enumerate(text)], "repo string, path string, lang string, line_no long, line string")
    assert [r.name for r in joins.setup_without_usage(joins.extract_setups(lines), lines).collect()] == ["lone"]


def test_references_of_documents(spark):
    text = "[a](src/a.js#x) [b](docs) [c](http://x.y/z.js) [d](#top) `setup.sh` `src/../a b.js` `src/*.js` `$HOME/x` `../out.md` `/abs.md` prose/none.js [e](./src/./gone.js)"
    docs = spark.createDataFrame([("r", 1, text), ("r", 2, None)], "repo string, doc_id long, content string")
    files = spark.createDataFrame([("r", "src/a.js"), ("r", "docs/x.md"), ("q", "setup.sh")], "repo string, path string")
    assert sorted(r.path for r in joins.broken_file_refs(docs, files).collect()) == ["../out.md", "./src/./gone.js", "/abs.md", "setup.sh"]
    said = spark.createDataFrame([("r", 1, "npm run deploy, npm run build, npm lint, npm ci, npm outdated, npm run dev")], "repo string, doc_id long, content string")
    scripts = spark.createDataFrame([("r", "dev")], "repo string, name string")
    assert sorted(r.name for r in joins.broken_command_refs(said, scripts).collect()) == ["deploy", "lint"]


def test_short_hashes_clear_commits(spark):
    commits = spark.createDataFrame([("a1b2c3d" + "0" * 33, "feat: one"), ("b" * 40, "fix: two"), ("c" * 40, "docs: three"), ("a1b2c3e" + "0" * 33, "feat!: four")], "hash string, message string")
    log = spark.createDataFrame([("- done (a1b2c3d)",), ("- see bbbbbb and bbbbbbbc",)], "entry string")
    assert sorted(r.message for r in joins.undocumented_commits(commits, log).collect()) == ["feat!: four", "fix: two"]


def test_test_places_and_quality(spark):
    paths = ["src/a.js", "src/__tests__/a.test.js", "src/a.spec.js", "lib/b.py", "test/test_b.py", "c.go", "c_test.go", "d.ts"]
    files = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    got = {r.path: r.test for r in joins.source_test_map(files).collect()}
    assert got["src/a.js"] == "src/a.spec.js" and got["lib/b.py"] == "test/test_b.py" and got["c.go"] == "c_test.go" and got["d.ts"] is None
    mapped = spark.createDataFrame([("r", f"src/{n}.js", f"{n}.test.js") for n in "abc"], "repo string, path string, test string")
    texts = {"a": "import x from '../src/a'\nit('works on null', f)", "b": "const b = require('./b')\nit('works', f)", "c": "it('handles null', f)"}
    files = spark.createDataFrame([("r", f"{n}.test.js", t) for n, t in texts.items()], "repo string, path string, content string")
    assert {r.path: r.grade for r in joins.test_quality(mapped, files).collect()} == {"src/a.js": "good", "src/b.js": "needs-improvement", "src/c.js": "poor"}


def test_tasks_found_in_code(spark):
    tasks = spark.createDataFrame([(1, "Add the parser"), (2, "Fix login-page"), (3, "the and or"), (4, "Teleport")], "number long, title string")
    files = spark.createDataFrame([("src/a.ts", "class Parser {}"), ("src/p.test.js", "login"), ("b.py", "teleport")], "path string, content string")
    assert {r.number: r.status for r in joins.task_already_done(tasks, files).collect()} == {1: "appears-done", 2: "partially-done", 3: "pending", 4: "pending"}


def test_names_match_across_scripts(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "feature string")
    got = {(r.doc_feature, r.code_feature) for r in joins.feature_match(one("Кэш данных", "User Loaders"), one("кэшданных", "userLoader", "zzz")).collect()}
    assert got == {("Кэш данных", "кэшданных"), ("User Loaders", "userLoader")}


def test_summaries_by_fixed_values(spark):
    text = "a /* x\n y */ b\n# c\n'''d\n/* e */\n\tf = 1; // g\n\"\"\"h\n// i\n/* open\nj"
    files = spark.createDataFrame([("python", text)], "language string, content string")
    assert summaries.count_source_lines(files).first().code_lines == 3
    docs = spark.createDataFrame([(1, "# Install\n## Getting started\n### API\n## How-to\n```\n```\n")], "doc_id long, content string")
    r = summaries.doc_profile(docs).first()
    assert (r.sections, r.headings, r.has_install, r.has_usage, r.has_api, r.has_tests, r.code_blocks) == (2, ["Getting started", "How-to"], True, True, False, False, 1)
    files = [("r", "README.md", "## Usage\n"), ("r", "docs/CHANGELOG.md", ""), ("q", "CHANGELOG.md", ""), ("q", "node_modules/.eslintrc", ""), ("q", "biome.json", ""), ("q", "spec/a.js", ""), ("r", ".circleci/config.yml", "")]
    files = spark.createDataFrame(files, "repo string, path string, content string")
    gaps = {tuple(x) for x in summaries.doc_gaps(files).collect()}
    assert gaps == {("r", "missing-section", "README.md", "Installation", "medium"), ("r", "missing", "CHANGELOG.md", None, "low"), ("q", "missing", "README.md", None, "high")}
    health = {x.repo: (x.has_tests, x.has_linting, x.has_ci, x.has_readme) for x in summaries.repo_health(files).collect()}
    assert health == {"r": (False, False, True, True), "q": (True, True, False, False)}
    assert {(x.repo, x.feature) for x in summaries.implemented_features(spark.createDataFrame([("r", "src/oauth2/x.js"), ("r", "m1/db.js")], "repo string, path string")).collect()} == {("r", "authentication")}
    signals = summaries.project_signals(spark.createDataFrame([("r", "m1/a.py"), ("q", "k8s/App.vue")], "repo string, path string")).collect()
    assert {x.repo: (x.has_db, x.has_backend, x.has_frontend, x.has_devops) for x in signals} == {"r": (False, False, False, False), "q": (False, False, True, True)}


def test_labels_in_any_case(spark):
    issues = spark.createDataFrame([(1, ["Bug"]), (2, ["bugs"]), (3, ["Type: Feature"]), (4, ["debug"])], "number long, labels array<string>")
    assert {r.number: r.category for r in summaries.categorise(issues).collect()} == {1: "bugs", 2: "bugs", 3: "features", 4: "other"}
    tasks = spark.sql("SELECT n AS number, 'x' AS title, l AS labels, '' AS body, DATE '2020-01-01' AS created, 0 AS reactions FROM VALUES (1, array('P0-High')), (2, array('1-urgent')), (3, array('BUG', 'Quick')) AS t(n, l)")
    got = {r.number: r.score for r in findings.score_tasks(tasks, spark.createDataFrame([], "word string"), "2024-01-01", 9).collect()}
    assert got == {1: 150, 2: 0, 3: 30}


def test_patterns_of_documents_are_counted_in_one_pass(spark):
    rules = [documents.TextRule("both", "x", "HIGH", (r"(?i)\bcaf\b", r"o(?=n)"), "{0} >= 1 OR {1} >= 1")]
    docs = spark.createDataFrame([(1, "Caf caf xcaf café"), (2, "on on oh"), (3, "no"), (4, None)], "id long, text string")
    found = documents.doc_rule_scan(docs, "id", True, rules)
    # RE2's word edges are those of ASCII letters; the second pattern is of Java's engine alone
    assert sorted((r.id, r.value) for r in found.collect()) == [(1, 3), (2, 0)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1


def test_texts_within_entries(spark):
    said = ["a", "é", "zq", "add", "api😀 k", "close pool 12", "close pool 1", "close pools", "lose", "drop the old loader of users and their names", "drop the old loader of users and their name", "whole entry"]
    commits = spark.createDataFrame([(f"{i:040x}", f"feat: {x}") for i, x in enumerate(said)], "hash string, message string")
    log = spark.createDataFrame([("- close pool 12",), ("whole entry",), ("see drop the old loader of users and their name!",), ("😀api😀 k é",), ("",), (None,)], "entry string")
    assert sorted(r.message[6:] for r in joins.undocumented_commits(commits, log).collect()) == ["add", "close pools", "drop the old loader of users and their names", "zq"]


def test_texts_are_not_paired_with_entries(spark):
    # all texts and entries share their trigrams, so that a trigram brings all pairs together
    commits = spark.range(2000).selectExpr("id AS hash", "concat('feat: ', translate(lpad(bin(id), 12, '0'), '01', 'ab')) AS message")
    log = commits.filter("hash % 2 = 0").selectExpr("concat('- ', substring(message, 7), '.') AS entry")
    rest = joins.undocumented_commits(commits, log)
    assert sorted(r.hash for r in rest.collect()) == list(range(1, 2000, 2))
    assert "contains(" not in rest._jdf.queryExecution().optimizedPlan().toString().lower()


def test_changelog_is_not_broadcast(spark):
    commits = spark.range(40).selectExpr("sha2(string(id), 256) AS hash", "concat('feat: number ', id) AS message")
    log = commits.selectExpr("concat('- done in ', substring(hash, 1, 7)) AS entry").limit(30)
    rest = joins.undocumented_commits(commits, log)
    assert rest.count() == 10
    plan = rest._jdf.queryExecution().sparkPlan().toString()
    assert "LeftAnti, BuildRight" not in plan and "Inner, BuildRight" not in plan


def test_phrases_of_all_scripts(spark):
    docs = spark.createDataFrame([(1, "один два три " * 4), (2, "你 好 吗 " * 3)], "doc_id long, text string")
    assert {(r.doc_id, r.phrase, r.times) for r in summaries.repeated_phrases(docs).collect()} == {(1, "один два три", 4)}


def test_prompt_kinds(spark):
    docs = [("x/Agents/a.md", "<system>"), ("skills/a.md", ""), ("kit/skills/a.md", ""), ("a.md", "text\n---\nname: b\n"), ("b.md", "# System prompt\n"), ("c.md", "You are a tester\nimport x")]
    got = [r.kind for r in scan.prompt_type(spark.createDataFrame(docs, "path string, content string")).collect()]
    assert got == ["agent", "markdown", "skill", "agent", "prompt", "markdown"]


@pytest.mark.parametrize(("line", "rule"), [
    ("exec(`rm ${x}`)", "command_injection"), ("Bash (echo ${y})", "command_injection"), ("system(a + b)", None), ("join(dir, $a, '../x')", "path_traversal"), ("see ../x.md", None),
    ("token: 'abcdefgh1'", "inline_secret"), ("token: '${abcdefgh}'", None), ("x = Function ('a')", "unsafe_eval"), ("medieval()", None), ("run $ARGUMENTS", "missing_input_validation"), ("check $ARGUMENTS", None),
])
def test_security_rules(spark, line, rule):
    lines = spark.createDataFrame([("r", "a.md", "markdown", 1, line)], "repo string, path string, lang string, line_no long, line string")
    assert [r.rule for r in scan.security_scan(lines).collect()] == ([rule] if rule else [])


def test_front_matter_that_lets_tools_write(spark):
    texts = ["---\nname: a\ntools: Read, Write\n---\n", "---\ntools: Write(src/*)\n---\n", "---\ntools: Edit\n", "x\n---\ntools: Edit\n---\n", "---\n---\ntools: Edit\n---"]
    lines = to_lines(spark.createDataFrame([("r", str(i), "markdown", t) for i, t in enumerate(texts)], "repo string, path string, lang string, content string"))
    assert [(r.path, r.line_no, r.rule) for r in scan.security_scan(lines).collect()] == [("0", 3, "broad_file_access")]
    assert {r.name for r in R.SECURITY} == {"command_injection", "path_traversal", "inline_secret", "unsafe_eval"} and F
