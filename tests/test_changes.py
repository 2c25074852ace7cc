"""Source trees, snapshots, refreshed maps, diffs, rule tables and streams in several batches, with results set by hand."""

import datetime
import os
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftworks.functions import rules as R
from siftworks.functions.literals import required
from siftworks.operators import diffs, documents, history, refresh, scan
from siftworks.sources import io, tree
from siftworks.streaming import stream
from siftworks.tables import to_lines


def test_tree_of_plain_files(spark, tmp_path):
    files = {
        "app/main.py": b"print(1)\n", "app/__init__.py": b"", "src/_private/x.ts": b"let a;\r\nlet b;", "src/deep/a/b/c/d.GO": b"package d", "src/latin.js": "café".encode("latin-1"),
        "src/mark.js": "� ok".encode(), "node_modules/lib/x.js": b"no", "src/dist/y.js": b"no", "tests/test_main.py": b"t", "src/a.test.js": b"t", "README.md": b"# no", "Makefile": b"no", ".hidden/h.rs": b"fn h() {}",
    }
    for name, data in files.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r for r in tree.scan_tree(spark, f"file://{tmp_path}").collect()}
    assert sorted(got) == [".hidden/h.rs", "app/__init__.py", "app/main.py", "src/_private/x.ts", "src/deep/a/b/c/d.GO", "src/latin.js", "src/mark.js"]
    assert got["app/__init__.py"].content == "" and got["app/__init__.py"].size == 0 and got["src/_private/x.ts"].language == "js"
    assert not got["src/latin.js"].decoded and got["src/latin.js"].content == "caf�" and got["src/mark.js"].decoded
    assert {r.path for r in tree.scan_tree(spark, str(tmp_path), extensions=[".py"], tests=True).collect()} == {"app/__init__.py", "app/main.py", "tests/test_main.py"}
    assert tree.scan_tree(spark, str(tmp_path), excluded=[]).filter("path like 'node_modules/%'").count() == 1
    assert tree.scan_tree(spark, f"{tmp_path}/nothing-here").count() == 0
    paths = spark.createDataFrame([("app/main.py",), ("gone.py",), (None,), ("app/main.py",)], "path string")
    assert [(r.path, r.content) for r in tree.read_paths(paths, str(tmp_path)).collect()] == [("app/main.py", "print(1)\n")]


def test_snapshots_are_replaced(spark):
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    folder = io.write_snapshot(rows("a", "b"), "one")
    io.write_snapshot(rows("x"), "two", folder)
    io.write_snapshot(rows("b", "c"), "one", folder)
    names = lambda s: sorted(r.name for r in io.load_snapshot(spark, folder, s).collect())
    assert names("one") == ["b", "c"] and names("two") == ["x"] and names("three") == []
    assert len(os.listdir(f"{folder}/versions".removeprefix("file://"))) == 2
    broken = rows("lost").select(F.raise_error(F.lit("lost")).cast("string").alias("name"))
    with pytest.raises(Exception, match="lost"):
        io.write_snapshot(broken, "one", folder)
    assert names("one") == ["b", "c"]
    io.write_snapshot(rows(), "two", folder)
    assert names("two") == [] and {(r.snapshot, r.symbols) for r in io.snapshot_status(spark, folder).collect()} == {("one", 2), ("two", 0)}


def test_status_text_as_printed(spark):
    text = 'M\tsrc/a.py\nA\tdocs/n.md\nD\t"odd \\"name\\".js"\nR100\told.js\tnew.js\nR087\ta b.py\tc d.py\n\nwarning: something\n'
    rows = spark.createDataFrame([(x,) for x in text.split("\n")], "value string")
    got = {tuple(r) for r in io.read_diff_status(spark, io.write_text(rows, "status")).collect()}
    assert got == {
        ("M", "src/a.py", None, None, False), ("A", "docs/n.md", None, None, True), ("D", 'odd "name".js', None, None, False),
        ("R", "old.js", "new.js", 100, False), ("R", "a b.py", "c d.py", 87, False), ("M", "c d.py", None, None, False),
    }


OLD = {"a.py": "def one(): pass", "b.py": "def two(): pass\nimport os", "c.js": "class Three {}", "d.js": "class Four {}", "e.js": "class Five {}", "notes.md": "def no"}
NEW = {"a.py": "def one(): pass", "b.py": "def changed(): pass", "moved/c.js": "class Three {}", "moved/d.js": "class Four {}\nclass More {}", "f.go": "func Six() {}", "notes.md": "def other"}
CHANGES = [("M", "b.py", None), ("R", "c.js", "moved/c.js"), ("R", "d.js", "moved/d.js"), ("M", "moved/d.js", None), ("D", "e.js", None), ("A", "f.go", None), ("M", "notes.md", None), ("M", "vanished.py", None)]


def test_refresh_equals_rebuild(spark, tmp_path):
    kinds = {"py": "python", "js": "javascript", "go": "go", "md": "markdown"}
    table = lambda files: spark.createDataFrame([(p, kinds[p.rpartition(".")[2]], t) for p, t in files.items()], "path string, lang string, content string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    old, want = refresh.symbol_map(table(OLD)), rows(refresh.symbol_map(table(NEW)))
    changes = spark.createDataFrame(CHANGES, "status string, from_path string, to_path string")
    assert rows(refresh.refresh_map(old, changes, table(NEW))) == want
    for name, text in NEW.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "a.py").unlink()  # not named as changed, so it isn't opened
    (tmp_path / "moved/c.js").unlink()
    assert rows(refresh.refresh_map_from_tree(old, changes, str(tmp_path))) == want
    hashes = lambda files: spark.createDataFrame([(p, str(hash(t))) for p, t in files.items()], "path string, hash string")
    assert rows(refresh.refresh_map(old, refresh.changes_between(hashes(OLD), hashes(NEW)), table(NEW))) == want


DIFF = """commit text that isn't a head
diff --git a/src/a.js b/src/a.js
index 1..2 100644
--- a/src/a.js
+++ b/src/a.js
@@ -1,4 +1,5 @@ function top() {
 keep
--- not a head
+++ not a head either
+if (x) {
 
-last
\\ No newline at end of file
+last
@@ -20 +21,2 @@
-one
+one
+two
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/old name.md b/new name.md
similarity index 90%
rename from old name.md
rename to new name.md
--- a/old name.md\t
+++ "b/new name.md"
@@ -3,2 +3,1 @@
 x"""


def test_diffs_are_read_by_their_counts(spark):
    df = spark.createDataFrame([(1, DIFF), (2, None), (3, ""), (4, "Binary files differ")], "diff long, text string")
    rows = diffs.diff_lines(df).collect()
    of = lambda path: [(r.hunk, r.kind, r.old_no, r.new_no, r.line) for r in sorted(rows, key=lambda r: (r.hunk, r.old_no or 0, r.new_no or 0)) if r.path == path]
    assert {r.path for r in rows} == {"src/a.js", "gone.py", "new name.md"}
    assert set(of("src/a.js")) == {
        (1, " ", 1, 1, "keep"), (1, "-", 2, None, "-- not a head"), (1, "+", None, 2, "++ not a head either"), (1, "+", None, 3, "if (x) {"), (1, " ", 3, 4, ""),
        (1, "-", 4, None, "last"), (1, "+", None, 5, "last"), (2, "-", 20, None, "one"), (2, "+", None, 21, "one"), (2, "+", None, 22, "two"),
    }
    assert of("gone.py") == [(3, "-", 1, None, "a"), (3, "-", 2, None, "b")] and of("new name.md") == [(4, " ", 3, 3, "x")]
    stats = {r.path: (r.hunks, r.added, r.removed) for r in diffs.diff_file_stats(diffs.diff_lines(df)).collect()}
    assert stats == {"src/a.js": (2, 5, 3), "gone.py": (1, 0, 2), "new name.md": (1, 0, 0)}


def test_growth_counts_forms_of_added_lines(spark):
    rows = [("a.js", "+", x) for x in ("if (a) {", "} else {", "x = a ? b : c;", "case 1:", "for (;;) {}", "while (x) {}", "a && b")] + [("a.js", "-", "if (b) {"), ("b.js", "+", "await f();"), ("b.js", "+", "catch (e) {"), ("c.js", "+", "async function f() {}")]
    lines = spark.createDataFrame(rows, "path string, kind string, line string")
    tests = spark.createDataFrame([("b.js", "expect(f()).rejects.toThrow()"), ("c.js", "it('works')")], "path string, content string")
    got = {tuple(r) for r in diffs.diff_growth(lines, tests).collect()}
    assert got == {("a.js", 4, "high", False), ("b.js", 1, "unknown", False), ("c.js", 0, "unknown", True)}


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([r for r in [*R.RULES, *R.SECURITY]]), st.data())
def test_literals_never_hide_a_match(rule, data):
    text = data.draw(st.from_regex(re.compile(rule.pattern, re.ASCII))) if "[^" not in rule.pattern else data.draw(st.from_regex(rule.pattern))
    sets, fold = required(rule.pattern)
    assert all(any(x in (text.lower() if fold else text) for x in found) for found in sets)


def test_literals_of_patterns():
    sets = lambda p: ([sorted(s) for s in required(p)[0]], required(p)[1])
    assert sets("foo(bar|baz)+x?") == ([["foo"], ["ba"]], False) or sets("foo(bar|baz)+x?")[0][0] == ["foo"]
    assert sets(r"\d+[a-z]*") == ([], False) and sets("(?i)KEY=") == ([["key="]], True) and sets("a|\\d") == ([], False) and sets("(?<!x)++bad(") == ([], False)


def test_rules_from_a_table(spark):
    rules = spark.createDataFrame([(2, "shout", "!{3,}", "low", None, None), (1, "goto", r"\bgoto\b", "high", "go", ["*_test.go"]), (3, "odd_length", "", "low", None, None)], "seq int, name string, pattern string, severity string, language string, exclude array<string>")
    R.register_predicate("odd", lambda lines: lines.str.len() % 2 == 1)
    rules = rules.withColumn("predicate", F.when(F.col("name") == "odd_length", "odd"))
    assert [r.name for r in scan.rules_of(rules)] == ["goto", "shout", "odd_length"]
    files = spark.createDataFrame([("r", "a.go", "go", "goto x!!!\nab"), ("r", "a_test.go", "go", "goto xy"), ("r", "a.js", "javascript", "goto")], "repo string, path string, lang string, content string")
    got = {(r.path, r.line_no, r.rule, r.severity, r.fix) for r in scan.rule_scan(to_lines(files), rules).collect()}
    assert got == {("a.go", 1, "goto", "high", "flag"), ("a.go", 1, "shout", "low", "flag"), ("a.go", 1, "odd_length", "low", "flag"), ("a_test.go", 1, "odd_length", "low", "flag")}


def slices(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.05)
    return stream.source(spark, f"file://{tmp_path}/in", 1)


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour, minutes=minute)


def test_streams_over_batches(spark, tmp_path):
    parts = [
        [(1, 1, "x", at(0)), (1, 2, "y", at(1)), (2, 3, "z", at(1))],
        [(1, 4, "y", at(2)), (2, 5, "z", at(2)), (9, 6, "q", at(2))],
        [(1, 7, "y", at(20)), (2, 8, "z", at(50))],
        [(3, 9, "n", at(1)), (1, 10, "w", at(50)), (2, 11, "z", at(51)), (9, 12, "q", at(52))],  # user 3 comes late: too late for a stall
        [(3, 13, "n", at(2)), (2, 14, "z", at(52))],  # and here for all: rows are held against the watermark of the batch before
    ]
    rows = slices(spark, tmp_path, parts, "user long, step long, digest string, ts timestamp")
    results = rows.select(F.col("user").alias("key"), "step", "digest", "ts")
    got = {tuple(r) for r in stream.longest_runs(stream.run_to_table(stream.stalls(results, "1 day"), "stalls")).collect()}
    assert got == {(1, "y", 2, 3), (2, "z", 3, 2), (2, "z", 8, 3)}
    batch = spark.createDataFrame([r for p in parts for r in p if r[0] != 3], "key long, step long, digest string, ts timestamp")
    assert {tuple(r) for r in documents.stall_detection(batch.select("key", "step", "digest")).collect()} == {(1, "y", 2, 3), (2, "z", 3, 5), (9, "q", 6, 2)}
    once = stream.run_to_table(stream.dedupe(rows, ["user", "digest"], "10 hours"), "dedupe")
    assert {(r.user, r.step) for r in once.collect()} == {(1, 1), (1, 2), (2, 3), (9, 6), (3, 9), (1, 10), (2, 14)}  # a key is free again once a batch has ended with the watermark beyond it
    hours = stream.run_to_table(stream.counts_by_hour(rows, "digest", "2 hours"), "hours")
    counted = {(r.hour.hour + 24 * (r.hour.day - 1), r.digest): r.n for r in hours.collect()}
    assert counted == {(0, "x"): 1, (1, "y"): 1, (1, "z"): 1, (2, "y"): 1, (2, "z"): 1, (2, "q"): 1, (20, "y"): 1, (1, "n"): 1}


def test_history_map_is_unchanged(spark):
    files = spark.createDataFrame([("", "a.py", "python", "def f(): pass\nfrom x import y")], "repo string, path string, lang string, content string")
    assert history.extract_symbols(to_lines(files)).count() == 1
    assert {tuple(r) for r in refresh.symbol_map(files).collect()} == {("a.py", "symbol", "function", "f", 1), ("a.py", "import", "from", "x", 2)}


def test_stalls_of_keys_that_share_a_state(spark, tmp_path):
    parts = [
        [(None, 1, "x", at(0)), (0, 2, "x", at(0)), *[(k, 3, "a", at(1)) for k in range(1, 40)]],
        [(None, 4, "x", at(2)), (0, 5, "y", at(2)), *[(k, 6, "a" if k % 2 else "b", at(3)) for k in range(1, 40)]],
        [(0, 7, "y", at(4)), *[(k, 8, "b", at(4) if k % 4 else at(40)) for k in range(1, 40)]],
    ]
    rows = slices(spark, tmp_path, parts, "key long, step long, digest string, ts timestamp")
    expected = {(None, "x", 1, 2), (0, "y", 5, 2)} | {(k, "a", 3, 2) for k in range(1, 40, 2)} | {(k, "b", 6, 2) for k in range(2, 40, 4)}
    for buckets in (1, 5):
        got = {tuple(r) for r in stream.longest_runs(stream.run_to_table(stream.stalls(rows, "1 day", buckets=buckets), "stalls")).collect()}
        assert got == expected
