"""Operators on small literal rows with results set by hand."""

import pytest
from pyspark.sql import functions as F

from siftworks.functions import rules as R
from siftworks.functions.literals import joint
from siftworks.operators import blocks, documents, findings, history, joins, scan, summaries
from siftworks.tables import to_lines


def lines_of(spark, files):
    """(repo, path, lang, doc_id, line_no, line) of {path: (language, text)}."""
    return to_lines(files_of(spark, files))


def files_of(spark, files):
    rows = [("r", p, lang, i, text) for i, (p, (lang, text)) in enumerate(files.items())]
    return spark.createDataFrame(rows, "repo string, path string, lang string, doc_id long, content string")


def test_rules_fire_and_spare(spark):
    lines = lines_of(spark, {"a.js": ("javascript", "console.log(1)\nconst password = 'abcd1234efgh';\nconst token = 'test-secret-1';\nx = 250;\ny = 200;"), "a.test.js": ("javascript", "console.log(2)")})
    got = {(r.path, r.line_no, r.rule) for r in scan.rule_scan(lines).collect()}
    assert ("a.js", 1, "console_debugging") in got and ("a.test.js", 1, "console_debugging") not in got
    assert ("a.js", 2, "hardcoded_secrets") in got and ("a.js", 3, "hardcoded_secrets") not in got
    assert ("a.js", 4, "magic_numbers") in got and ("a.js", 5, "magic_numbers") not in got


def test_joined_patterns_spare_no_line(spark):
    """Lines on which the two engines differ: what Java's matches, the joined pattern of RE2 must match."""
    texts = ["x \x0b", "pass ", "except E: pass\r", "import a from b // unused\r", "// perhapsé", "ésk-" + "a" * 40, "// see\x0ba.md", "var\x0bX = 1", "plain text", "", "x = 250"]
    lines = spark.createDataFrame([("r", "a.js", lang, i, t) for lang in ("javascript", "python") for i, t in enumerate(texts)], "repo string, path string, lang string, line_no long, line string")
    whole = [r for x in R.RULES for r in scan.rule_scan(lines, [x]).collect()]  # one rule is scanned without joining
    assert sorted(map(str, scan.rule_scan(lines).collect())) == sorted(map(str, whole)) and len(whole) > 4
    assert "ArrowEvalPython" in scan.rule_scan(lines)._jdf.queryExecution().sparkPlan().toString()
    broken = lines.limit(1).withColumn("line", F.expr("decode(encode('x = 250', 'utf-8'), 'utf-8') || cast(x'ff' AS string)"))
    assert [r.rule for r in scan.rule_scan(broken).collect()] == ["magic_numbers"]


def test_patterns_of_one_engine_are_not_joined():
    assert joint([r"a\s+b$", r"\bword\b"]) is not None
    for only_java in (r"a(?=b)", r"a++", r"[a&&b]", r"[a[bc]]", r"(?m)a$", r"\h", r"\p{L}", r"[^\S]", r"(a)\1"):
        assert joint(["a", only_java]) is None, only_java
    every = [rx for rxs in joins.SETUPS.values() for rx in rxs]
    assert joint(every) is not None and joint([r.pattern for r in R.RULES]) is not None


def test_rule_runs_need_five_lines(spark):
    four, five = "\n".join(["// longer words"] * 4), "\n".join(["// longer words"] * 5)
    got = scan.rule_runs(lines_of(spark, {"a.js": ("javascript", four), "b.js": ("javascript", "x\n" + five)})).collect()
    assert [(r.path, r.first_line, r.last_line, r.n) for r in got] == [("b.js", 2, 6, 5)]


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.test.*", "a.test.js", True), ("*.{js,ts}", "a.ts", True), ("*.{js,ts}", "a.py", False), ("*" * 23, "a", False), ("*a" * 11, "aaaaaaaaaaa", False)])
def test_glob_regex(glob, path, hit):
    import re

    assert bool(re.search(R.glob_regex(glob), path)) is hit


def test_last_ignore_rule_wins(spark):
    files = spark.createDataFrame([("r", "a/x.js"), ("r", "b/x.js"), ("r", "keep.js")], "repo string, path string")
    rules = spark.createDataFrame([("r", 0, "*.js"), ("r", 1, "!keep.js"), ("r", 2, "/b")], "repo string, seq int, glob string")
    assert [r.path for r in scan.apply_ignore_rules(files, rules).collect()] == ["keep.js"]


def test_brace_pairs_equal_a_stack(spark):
    import random

    rng, files = random.Random(7), {}
    for k in range(20):
        files[f"f{k}.js"] = ("javascript", "\n".join("".join(rng.choice("{}x ") for _ in range(rng.randint(0, 6))) for _ in range(30)))
    got = {(r.path, r.open_line, r.close_line) for r in blocks.brace_pairs(blocks.code_lines(files_of(spark, files))).collect()}
    expected = set()
    for path, (_, text) in files.items():
        stack = []
        for n, line in enumerate(text.split("\n"), 1):
            for c in line:
                if c == "{":
                    stack.append(n)
                elif c == "}":
                    if not stack:
                        stack = None
                        break
                    expected.add((path, stack.pop(), n))
            if stack is None:
                break
        if stack is None:  # an unmatched closer: no defined pairing after it
            expected = {x for x in expected if x[0] != path}
            got = {x for x in got if x[0] != path}
    assert got == expected


def test_masked_keeps_lines_and_code(spark):
    text = "a(`x{\n}`); /* {\n*/ b('it{', \"q\\\"{\"); // {\nc / d; don't {\n\"\"\"{\n\"\"\" e /* open {\n}"
    (row,) = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(blocks.masked(F.col("t")).alias("m")).filter("m <> ''").collect()
    assert row.m == "a(\n); \n b(, ); \nc / d; don't {\n\n e \n"


def test_function_blocks(spark):
    js = "function a()\n{\n  x = `}\n}`;\n}\n/*\nfunction no() {\n}\n*/\nfunction b({ p, q }) {\n  y();\n}\nfunction c(\n  p,\n  q\n) {\n  z();\n}"
    rust = "trait S {\n    fn get(&self) -> u32;\n    fn put(&self) -> u32 {\n        1\n    }\n}"
    got = blocks.function_blocks(blocks.code_lines(files_of(spark, {"a.js": ("javascript", js), "b.rs": ("rust", rust), "c.js": ("javascript", ""), "d.js": ("javascript", None)})))
    assert {(r.path, r.first_line, r.open_line, r.last_line) for r in got.collect()} == {("a.js", 1, 2, 5), ("a.js", 10, 10, 12), ("a.js", 13, 16, 18), ("b.rs", 3, 3, 5)}


def test_symbols_exports_and_imports(spark):
    files = {
        "a.js": ("javascript", "export default function () {\nfunction* gen() {\nlet f = async function () {\nexport let v = 1;\nconst K = class {\nexports.w = 1;\nexports.w === 1;\nmodule.exports = gen;\nexport * from 'x';\nimport 'side';\nimport d from \"dq\";"),
        "b.ts": ("typescript", "export abstract class A {\nexport const enum E {\nnamespace N {\nexport as namespace Lib;"),
        "c.rs": ("rust", "pub(crate) fn g() {\nmod inner;\npub mod outer {\nconst fn h() {\nstatic S: u8 = 1;\nuse std::io::*;\nuse a::b::{c, d};\nuse e::f;"),
        "d.java": ("java", "public record P(int x) {\n  private static final int[] Q = {1};\n  public List<String> r() {\nimport static a.b.C;\nimport a.b.*;"),
        "e.go": ("go", "import al \"x/y\""),
    }
    lines = lines_of(spark, files)
    assert {(r.kind, r.name) for r in history.extract_symbols(lines).collect()} == {
        *{("function", x) for x in ("default", "gen", "f", "g", "r")}, ("variable", "v"), *{("class", x) for x in ("K", "A")}, ("value", "w"), ("value", "gen"), ("re-export", "*"),
        *{("type", x) for x in ("E", "N", "P")}, ("namespace", "Lib"), *{("module", x) for x in ("inner", "outer")}, *{("constant", x) for x in ("S", "Q")},
    }
    assert {r.name for r in history.exports(lines).collect()} == {"default", "v", "w", "gen", "*", "A", "E", "Lib", "g", "outer", "P", "r"}
    assert {r.source for r in history.extract_imports(lines).collect()} == {"side", "dq", "std::io", "a::b", "e::f", "a.b.C", "a.b.*", "x/y"}


def test_indent_blocks(spark):
    text = "def a():\n    x\n    def b():\n        y\n    z\nw\ndef c():\n    v"
    got = {(r.first_line, r.last_line) for r in blocks.indent_blocks(lines_of(spark, {"a.py": ("python", text)})).collect()}
    assert got == {(1, 5), (3, 4), (7, 8)}


def test_dead_code_and_stubs(spark):
    js = "function a() {\n  return 1;\n  dead();\n}\nfunction b() {\n  return null;\n}\nfunction c() {\n  if (x) {\n    return 1;\n  }\n  live();\n}"
    lines = blocks.code_lines(files_of(spark, {"a.js": ("javascript", js)}))
    assert [(r.line_no, r.dead_line) for r in blocks.dead_code(lines).collect()] == [(2, 3)]
    assert [r.first_line for r in blocks.stub_functions(lines).collect()] == [5]


def test_stubs_read_their_files_once(spark):
    """Text below the functions, comments that end a block, and a TODO that says more than its mark."""
    files = {
        "a.py": ("python", "def a():\n    # TODO: soon\n    pass\n\ndef b():\n    return 0\n# not of b, TODO\n\n  \ndef c():\n    # one\n# ends c\n    return 0\ndef d():\n\n    pass\n\n# text"),
        "b.js": ("javascript", "function e()\n{\n  // FIXME\n  return null;\n}\nfunction f() { return 0; /* HACK */ }\nfunction g() { return 0; }\n// TODO of nothing {\nfunction h() {\n  x();\n  return 0;\n}"),
        "c.md": ("markdown", "def a():\n    pass\nfunction f() { return 0; }"),
    }
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = files_of(spark, files)
    got = {(r.path, r.first_line): r.certainty for r in blocks.stub_functions(blocks.code_lines(df.mapInArrow(count, df.schema))).collect()}
    assert got == {("a.py", 1): "HIGH", ("a.py", 5): "MEDIUM", ("a.py", 14): "MEDIUM", ("b.js", 1): "HIGH", ("b.js", 7): "MEDIUM"}
    assert made.value == 3


def test_indent_blocks_equal_a_search(spark):
    """Of random lines, in one shuffle."""
    import random

    rng = random.Random(4)
    texts = {f"{i}.py": [" " * rng.randrange(6) + rng.choice(["def f():", "x", "# y", "", "async def g():", "\t"]) for _ in range(40)] for i in range(8)}
    found = blocks.indent_blocks(lines_of(spark, {path: ("python", "\n".join(text)) for path, text in texts.items()}))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    expected = set()
    for path, text in texts.items():
        depth = [len(line) - len(line.lstrip(" \t")) for line in text]
        for i, line in enumerate(text):
            if "def" in line:
                after = (j for j in range(i + 1, len(text)) if text[j].strip(" ") and depth[j] <= depth[i])
                expected.add((path, i + 1, next(after, len(text))))
    assert {(r.path, r.first_line, r.last_line) for r in found.collect()} == expected


def test_fix_headings_equals_a_loop(spark):
    levels = [1, 3, 3, 2, 5, 6, 1, 4]
    lines = lines_of(spark, {"a.md": ("markdown", "\n".join("#" * k + " h" for k in levels))})
    got = [len(r.line.split(" ")[0]) for r in documents.fix_headings(lines).orderBy("line_no").collect()]
    expected, last = [], levels[0]
    for i, k in enumerate(levels):
        last = k if i == 0 else min(k, last + 1)
        expected.append(last)
    assert got == expected


def test_condense_keeps_case_and_fences(spark):
    df = spark.createDataFrame([("In order to win. Prior to it.\n```\nin order to\n```\nin order to",)], "t string")
    assert df.select(documents.condense(F.col("t"))).first()[0] == "To win. Before it.\n```\nin order to\n```\nto"


def test_calm(spark):
    assert spark.createDataFrame([("You MUST stop!!! mUST",)], "t string").select(documents.calm(F.col("t"))).first()[0] == "You must stop! mUST"


def test_import_cycles_equal_a_search(spark):
    edges = [(1, 2), (2, 3), (3, 1), (2, 1), (3, 4), (4, 5), (5, 3), (6, 6)]
    got = {tuple(r.cycle) for r in history.import_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(1, 2), (1, 2, 3), (3, 4, 5)}


def test_import_components_have_no_longest(spark):
    import random

    ring = [(i, (i + 1) % 9) for i in range(9)]
    chain = [(4, 20), (20, 21), (21, 22), (22, 21), (30, 4), (40, 40), (50, 51), (None, 1)]
    df = spark.createDataFrame(ring + chain, "src long, dst long")
    assert {(r.file, r.component) for r in history.import_components(df).collect()} == {(i, 0) for i in range(9)} | {(21, 21), (22, 21)}
    assert not [r for r in history.import_cycles(df).collect() if len(r.cycle) > 6]
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    reach = {i: {i} for i in range(60)}
    for _ in range(60):
        for a, b in edges:
            reach[a] |= reach[b]
    expected = {(i, min(same)) for i in range(60) if len(same := [j for j in reach[i] if i in reach[j]]) > 1}
    assert {(r.file, r.component) for r in history.import_components(spark.createDataFrame(edges, "src long, dst long")).collect()} == expected and expected


def test_co_change_counts(spark):
    rows = [(c, f"{f}.js", "M") for c in range(3) for f in "ab"] + [(9, "a.js", "M"), (9, "tests/a.js", "M"), (8, "a.js", "M"), (8, "c.js", "M")]
    got = history.co_change_pairs(spark.createDataFrame(rows, "hash long, path string, status string")).collect()
    assert [(r.file_a, r.file_b, r.times) for r in got] == [("a.js", "b.js", 3)]


def test_duplicate_blocks_merge_frames(spark):
    block = "\n".join(f"call{i}(x)" for i in range(7))
    lines = lines_of(spark, {"a.js": ("javascript", block), "b.js": ("javascript", "other()\n" + block)})
    got = history.duplicate_blocks(lines).collect()
    assert [(r.path_a, r.from_a, r.path_b, r.from_b, r.n) for r in got] == [("a.js", 1, "b.js", 2, 7)]


def test_dedupe_merges_sources(spark):
    rows = [("p", 1, "Bad ", "x", False, "LOW", 2), ("p", 1, "bad", "y", True, "HIGH", 1), ("p", 2, "bad", "x", False, "LOW", 3)]
    df = spark.createDataFrame(rows, "path string, line_no int, issue string, source string, fixable boolean, certainty string, seq int")
    got = {(r.line_no, tuple(r.sources), r.fixable, r.certainty) for r in findings.dedupe_findings(df).collect()}
    assert got == {(1, ("x", "y"), True, "HIGH"), (2, ("x",), False, "LOW")}


def test_priority_rounds_half_up(spark):
    rows = [("medium", "bugs", False, 0, 8), ("critical", "security", True, 200, 32), ("other", "none", False, 0, 5)]
    df = spark.createDataFrame(rows, "severity string, category string, recent boolean, days_stale int, want long")
    assert all(r.priority == r.want for r in findings.priority(df).collect())


def test_categories_take_plurals_not_debug(spark):
    df = spark.createDataFrame([(1, ["debug"]), (2, ["bugs"]), (3, ["type: feature"]), (4, ["security-fix"])], "n int, labels array<string>")
    assert {r.n: r.category for r in summaries.categorise(df).collect()} == {1: "other", 2: "bugs", 3: "features", 4: "security"}


def test_claims_take_the_longest_word(spark):
    lines = lines_of(spark, {"a.md": ("markdown", "It is secure by default.\nIt should be robust, it is.\nA robust thing")})
    got = {(r.line_no, r.buzzword, r.category, r.positive) for r in joins.extract_claims(lines).collect()}
    assert got == {(1, "secure by default", "security", True), (2, "robust", "reliability", False), (3, "robust", "reliability", False)}


def test_text_overlap_equals_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = [f"word{i}" for i in range(12)]
    text = lambda k: ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(4, 9))) for _ in range(k))
    a, b = [(i, text(3)) for i in range(8)], [(i, text(4)) for i in range(10)]
    got = {r.id: r.covered for r in joins.text_overlap(spark.createDataFrame(a, "a_id long, text string"), spark.createDataFrame(b, "b_id long, text string")).collect()}
    cut = lambda t: [set(s.lower().split()) for s in t.replace("!", ".").split(".") if len(s.strip()) > 20]
    all_b = [w for _, t in b for w in cut(t)]
    assert got == {i: sum(any(len(w & v) > 0.8 * len(w) for v in all_b) for w in cut(t)) for i, t in a}


def test_feature_match_blocks_lose_nothing(spark):
    import itertools

    names = ["add", "adder", "loader", "loadr", "lo", "search page", "SearchPages", "sear-ch", "export", "xport", "abc", "xyz"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    norm = lambda s: "".join(c for c in s.lower() if c.isalnum())
    expected = {(a, b) for a, b in itertools.product(names, names) if min(len(norm(a)), len(norm(b))) > 2 and (norm(a) in norm(b) or norm(b) in norm(a) or edits(norm(a), norm(b)) < 3)}
    df = spark.createDataFrame([(n,) for n in names], "feature string")
    assert {(r.doc_feature, r.code_feature) for r in joins.feature_match(df, df).collect()} == expected


def test_snapshot_diff(spark):
    old, new = [("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]
    got = {tuple(r) for r in history.snapshot_diff(spark.createDataFrame(old, "path string, hash string"), spark.createDataFrame(new, "path string, hash string")).collect()}
    assert got == {("b", "modified"), ("c", "deleted"), ("d", "added")}


def test_stalls(spark):
    rows = [("k", i, d) for i, d in enumerate("aabccc")]
    got = {(r.digest, r.from_step, r.n) for r in documents.stall_detection(spark.createDataFrame(rows, "key string, step long, digest string")).collect()}
    assert got == {("a", 0, 2), ("c", 3, 3)}


def test_broken_anchors_and_links(spark):
    docs = spark.createDataFrame([("r", "a.md", 1, "# The Start!\n[ok](#the-start) [no](#gone) [f](src/a.js) [g](src/b.js) [w](https://x.y)")], "repo string, path string, doc_id long, content string")
    files = spark.createDataFrame([("r", "src/a.js")], "repo string, path string")
    assert [r.slug for r in joins.broken_anchors(docs).collect()] == ["gone"]
    assert [r.target for r in joins.broken_links(docs, files).collect()] == ["src/b.js"]


def test_long_lines_are_judged(spark):
    secret = "x" * 50_000 + " ghp_" + "a" * 36 + " TODO: later " + "y" * 50_000
    heads = ["'", "//", "throw new Error('", "function f(", "=>" + " " * 999, "panic!('", "def f(", "catch (", "except", "eyJ", "f(true,true,true", "interface A<", "exec(", "$(", "w", " ", "\r"]
    files = {"long.txt": ("text", secret)}
    for i, head in enumerate(heads):
        for lang, ext in [("javascript", "js"), ("python", "py"), ("rust", "rs"), ("go", "go")]:
            files[f"f{i}.{ext}"] = (lang, "import a from " + head * (300_000 // len(head)) + "end")
    lines = lines_of(spark, files)
    got = {(r.path, r.rule) for r in scan.rule_scan(lines).collect()}
    assert {("long.txt", "github_token"), ("long.txt", "old_todos")} <= got
    scan.security_scan(lines).collect()


def test_linear_forms_equal_their_patterns(spark):
    import random

    rng = random.Random(5)
    words = " |  |\r|\r |\t|)|(|{|}|{}|:|;|<|>|,|.|...|'|\"|`|//|/*|#|#12|x|_a|f|throw|new|Error|function|=>|panic!|panic|def|pass|catch|except|import | from | // unused|eyJ|eyJabcdefghij|abcdefghijk.|issue |PR |closes|see |in |a/b.md|true|false|interface|exec|system|$(|$ARGUMENTS|${|+|%s|TODO|todo:|implement|not impl|replace me|maybe|i think".split("|")
    parts = [r"throw| new| |Error|(|'|\r|TODO| x", r"function f|()|(|)|{|}| |\r|_a|=>|<|>|interface A|x", r"panic!|panic|(|'|TODO| |\r|implement", r"def f|(|)|:|pass|...| |except|catch", r"f(|true|,| |)|false|\r", r"eyJ|abcdefghij|.|-| ", r"exec|(|)|+|$(|$ARGUMENTS|%s|f'| ", r"//|see|in| |a.md|#1|maybe|\r|'|todo: implement| issue 4", r"import a| from b|import | from | // unused|\r| ", r"interface A| |{|}|<|>", r"def f|(|)|:|pass", r"def f|(|)|:|...", r"eyJabcdefghij|.eyJ|.", r"except|:|pass", r"catch|(|)|{|}", r"f(|true|,|)", r"import a| from b| from c| // unused", r"panic!|(|'|TODO", r"throw new Error('|throw|\r|new\rError(| new Error|('|(\r'|TODO|x", r"function f|(|_a|)|{|}"]
    parts += ["discord|x| |\\r|'|'" + "A" * 24 + "." + "b" * 6 + "." + "C" * 27 + "'|https://discord.com/api/webhooks/1/a", "1|23|x|-" + "a" * 32 + ".apps.googleusercontent.com| |AIza" + "b" * 35]
    pools = [words, *[p.replace("\\r", "\r").split("|") for p in parts]]
    rows = [("".join(rng.choice(pool) for _ in range(rng.randint(1, 16))),) for pool in pools for _ in range(3000)]
    df = spark.createDataFrame(rows, "line string")
    differ = [F.sum((F.col("line").rlike(p) != F.col("line").rlike(x)).cast("int")).alias(f"d{i}") for i, (p, x) in enumerate(R.LINEAR.items())]
    hits = [F.sum(F.col("line").rlike(p).cast("int")).alias(f"n{i}") for i, p in enumerate(R.LINEAR)]
    got = df.agg(*differ, *hits).first().asDict()
    assert {k: v for k, v in got.items() if k[0] == "d" and v != 0} == {}
    assert [k for k, v in got.items() if k[0] == "n" and v == 0] == []


def test_document_scans_read_every_line(spark, tmp_path):
    from siftworks.plans import registry

    text = "first line\n" + "word " * 30_000 + "\ntoken ghp_" + "a" * 36 + "\n" + "maybe sometimes usually often\n"
    spark.createDataFrame([(1, text, "web")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = registry.queries()
    assert [(r.line_no, r.rule) for r in queries["b4_secret_scan_documents"](spark, str(tmp_path)).collect()] == [(3, "github_token")]
    assert {"vague_instructions", "prompt_bloat"} <= {r.rule for r in queries["l1_doc_rule_scan_documents"](spark, str(tmp_path)).collect()}


TEXT_RULE_CASES = {
    "inconsistent_sections": ("## a\n\n**b**\n## c\n**d**\n", "## a\n### b\n## c\n"),
    "suboptimal_example_count": ("<example>x</example>", "## Example\n## Example\n"),
    "examples_without_contrast": ("<example> <example> <example>", "<example> <example> <example> a good example"),
    "missing_instruction_priority": ("You must. " * 300, "You must. " * 300 + "In case of conflict the first wins."),
    "overly_prescriptive": ("\n".join(f"{i}. step" for i in range(10)), "1. one\n2. two"),
    "missing_frontmatter": ("You are a helper.", "---\nname: a\n---\n"),
    "missing_name": ("---\ndescription: b\n---\n", "---\nname: a\n---\n"),
    "missing_description": ("---\nname: a\n---\n", "---\ndescription: b\n---\n"),
    "unrestricted_tools": ("---\nname: a\n---\n", "---\nname: a\ntools: Read\n---\n"),
    "unrestricted_bash": ("---\ntools: Read, Bash\n---\n", "---\ntools: Read, Bash(git:*)\n---\nBash"),
    "agent_missing_xml_structure": ("- a\n```\nb\n```\n", "- a\n```\nb\n```\n<rules>\n"),
    "unnecessary_cot": ("Go step by step.", "Go on."),
    "missing_cot": ("## s\n" * 5 + "review " * 1001, "## s\n" * 5 + "review " * 1001 + "step by step"),
    "example_count_suboptimal": ("## Example\n" * 6, "## Example\n" * 3),
    "agent_vague_instructions": ("usually sometimes often maybe", "usually usually usually usually"),
    "agent_prompt_bloat": ("x" * 8001, "x" * 8000),
    "no_xml_for_data": ("## a\n- b\n" * 4, "## a\n- b\n" * 4 + "<a>b</a>"),
    "suboptimal_chunking": ("# a\nshort\n", "# a\n" + "long enough " * 10),
    "missing_architecture": ("nothing", "## Overview\n"),
    "excessive_token_count": ("x" * 6001, "x" * 6000),
    "verbose_instructions": (("y" * 210 + "\n") * 4, ("y" * 210 + "\n") * 4 + "\n" * 20),
    "memory_missing_why": ("must " * 6, "must " * 6 + "because because"),
    "example_overload": ("```\na\n```\n" * 11, "```\na\n```\n" * 10),
}


def test_text_rules_fire_and_spare(spark):
    from siftworks.operators import documents

    assert sorted(TEXT_RULE_CASES) == sorted(r.name for r in documents.TEXT_RULES)
    rows = [(f"{name}/{i}", text) for name, pair in TEXT_RULE_CASES.items() for i, text in enumerate(pair)]
    found = documents.doc_rule_scan(spark.createDataFrame(rows, "id string, text string"), "id", True, documents.TEXT_RULES)
    hits = {(r.id, r.rule) for r in found.collect()}
    assert [n for n in TEXT_RULE_CASES if (f"{n}/0", n) not in hits] == [] and [n for n in TEXT_RULE_CASES if (f"{n}/1", n) in hits] == []


def test_mention_kinds(spark):
    text = "import { a } from 'src/util/load';\nconst b = require('./util/load');\nsee src/util/load.js and from 'other/load'"
    docs = spark.createDataFrame([("r", 1, text), ("r", 2, "load it"), ("r", 3, "nothing"), ("r", 4, None)], "repo string, doc_id long, content string")
    changed = spark.createDataFrame([("r", "src/util/load.js"), ("r", "lib/load.js")], "repo string, path string")
    got = {(r.doc_id, r.path): r.kinds for r in joins.docs_mentioning(changed, docs).collect()}
    assert got == {
        (1, "src/util/load.js"): ["filename", "full-path", "import", "require"],
        (1, "lib/load.js"): ["filename"],
        (2, "src/util/load.js"): ["filename"],
        (2, "lib/load.js"): ["filename"],
    }


def test_old_documents_and_drafts(spark):
    issues = spark.createDataFrame([], "repo string, number long, title string, labels array<string>, state string, created date, updated date")
    miles = spark.createDataFrame([], "repo string, title string, state string, due_on date")
    progress = spark.createDataFrame([], "repo string, total long, checked long")
    docs = spark.sql("SELECT 'r' AS repo, p AS path, CAST(u AS DATE) AS updated FROM VALUES ('a', '2023-07-05'), ('b', '2023-07-06'), ('c', NULL) AS t(p, u)")
    pulls = spark.sql("SELECT 'r' AS repo, n AS number, d AS draft, s AS state, CAST(c AS DATE) AS created FROM VALUES (1, true, 'open', '2023-12-01'), (2, true, 'open', '2023-12-02'), (3, false, 'open', '2023-01-01'), (4, true, 'closed', '2023-01-01') AS t(n, d, s, c)")
    got = {tuple(r) for r in summaries.drift_indicators(issues, miles, progress, docs, pulls, "2024-01-01").collect()}
    assert got == {("r", "docs_old", 1), ("r", "drafts_old", 1)}


def test_snapshot_marks(spark):
    from siftworks.sources import io

    symbols = spark.createDataFrame([("a.py", "f")], "path string, name string")
    folder = io.write_snapshot(symbols, "one")
    io.write_snapshot(symbols, "two", folder)
    io.mark_stale(spark, folder, "one")
    status = lambda: {(r.snapshot, r.stale) for r in io.snapshot_status(spark, folder).collect()}
    assert status() == {("one", True), ("two", False)}
    io.write_snapshot(symbols, "one", folder)
    assert status() == {("one", False), ("two", False)}


def test_import_components_broadcast_nothing(spark):
    """Their rounds are many, and each broadcast would go through the driver."""
    e = history.written(spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)], "src long, dst long"))
    labels = history.written(e.select(history.F.col("src").alias("node"), history.F.col("dst").alias("label")))
    joined = history._ends(e, labels, "f")
    assert joined.count() == 9
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_import_cycles_meet_in_the_middle(spark):
    """All cycles of a dense graph at every bound, from paths of half a cycle and without a broadcast of the edges."""
    import random

    rng = random.Random(5)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(45)}
    df = history.written(spark.createDataFrame([*edges, *edges, (None, 1), (1, None)], "src long, dst long"))

    def search(path, longest):
        for a, b in edges:
            if a == path[-1] and b == path[0] and len(path) > 1:
                yield path
            if a == path[-1] and b > path[0] and b not in path and len(path) < longest:
                yield from search((*path, b), longest)

    for longest in (2, 3, 6, 7):
        found = history.import_cycles(df, longest)
        got = [tuple(r.cycle) for r in found.collect()]
        assert sorted(got) == sorted(c for i in range(14) for c in search((i,), longest)) and max(map(len, got)) == longest
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_compact_summary_makes_its_items_once(spark):
    """Total and first rows come from one run over the items."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(0, 200, numPartitions=3).selectExpr("id AS n", "if(id % 3 = 0, 'low', 'high') AS severity").mapInArrow(count, "n long, severity string")
    got = {r.severity: (r.n, r.total, r.showing, r.truncated) for r in findings.compact_summary(rows.withColumnRenamed("n", "line_no"), "severity", ["line_no"], 9).collect()}
    assert got == {"low": (3, 200, 9, True), "high": (6, 200, 9, True)}
    assert made.value == 200
