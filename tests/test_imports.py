"""Import specifiers against files: what resolves to what, and cycles of real imports."""

from siftworks.operators import history as hi
from siftworks.operators import imports as im
from siftworks.tables import to_lines

FILES = [
    "src/app.js", "src/util.js", "src/util.ts", "src/widgets/index.tsx", "src/only.ts", "lib/deep/a/b.mjs", "src/data.json",
    "pkg/__init__.py", "pkg/core.py", "pkg/sub/__init__.py", "pkg/sub/leaf.py", "other/pkg/core.py",
    "cmd/main.go", "internal/store/db.go", "internal/store/cache.go", "internal/store/db_test.go",
    "app/src/main/java/com/acme/Order.java", "app/src/main/java/com/acme/Item.java", "app/src/main/java/com/Main.java",
    "engine/src/lib.rs", "engine/src/parse/mod.rs", "engine/src/parse/token.rs", "engine/src/eval.rs",
]
IMPORTS = [
    ("src/app.js", "./util", ["src/util.js"]), ("src/app.js", "./widgets", ["src/widgets/index.tsx"]), ("src/app.js", "./only.js", ["src/only.ts"]),
    ("src/app.js", "../lib/./deep/a/b.mjs", ["lib/deep/a/b.mjs"]), ("src/app.js", "../../up", []), ("src/app.js", "react", []), ("src/app.js", "./gone", []),
    ("src/widgets/index.tsx", "..//util.ts", ["src/util.ts"]), ("src/app.js", "util", []),
    ("pkg/core.py", ".sub.leaf", ["pkg/sub/leaf.py"]), ("pkg/sub/leaf.py", "..core", ["pkg/core.py"]), ("pkg/sub/leaf.py", ".", ["pkg/sub/__init__.py"]),
    ("cmd/tool.py", "pkg", ["pkg/__init__.py"]), ("cmd/tool.py", "pkg.core", ["pkg/core.py"]), ("cmd/tool.py", "os.path", []), ("cmd/tool.py", "sub.leaf", ["pkg/sub/leaf.py"]),
    ("cmd/main.go", "internal/store", ["internal/store/cache.go", "internal/store/db.go"]), ("cmd/main.go", "fmt", []),
    ("app/src/main/java/com/Main.java", "com.acme.Order", ["app/src/main/java/com/acme/Order.java"]),
    ("app/src/main/java/com/Main.java", "com.acme.*", ["app/src/main/java/com/acme/Item.java", "app/src/main/java/com/acme/Order.java"]),
    ("engine/src/eval.rs", "crate::parse::token::Kind", ["engine/src/parse/token.rs"]), ("engine/src/eval.rs", "crate::parse::Tree", ["engine/src/parse/mod.rs"]),
    ("engine/src/parse/token.rs", "super::Tree", ["engine/src/parse/mod.rs"]), ("engine/src/parse/mod.rs", "self::token::Kind", ["engine/src/parse/token.rs"]), ("engine/src/eval.rs", "serde::Deserialize", []),
]


def test_specifiers_resolve(spark):
    files = spark.createDataFrame([(r, p) for r in ("one", "two") for p in FILES] + [("one", None)], "repo string, path string")
    imports = spark.createDataFrame([("one", p, s) for p, s, _ in IMPORTS] * 2 + [("three", "src/app.js", "./util"), ("one", "src/app.js", None)], "repo string, path string, source string")
    got = {}
    for r in im.resolve_imports(imports, files).collect():
        assert r.repo == "one"
        got.setdefault((r.path, r.source), []).append(r.target)
    assert {k: sorted(v) for k, v in got.items()} == {(p, s): t for p, s, t in IMPORTS if t}


def test_cycles_of_real_files(spark):
    texts = {
        "a/x.js": "import { y } from './y';", "a/y.js": "const z = require('../b/z.js');", "b/z.js": "import '../a/x';\nimport 'left-pad';",
        "a/alone.js": "import { alone } from './alone';", "c/m.py": "from .n import f", "c/n.py": "import c.m", "a/leaf.js": "import { y } from './y';",
    }
    files = spark.createDataFrame([("r", p, "python" if p.endswith("py") else "javascript", t) for p, t in texts.items()], "repo string, path string, lang string, content string")
    edges = im.file_edges(hi.extract_imports(to_lines(files)), files)
    assert sorted(r.cycle for r in hi.import_cycles(edges).collect()) == [["r/a/x.js", "r/a/y.js", "r/b/z.js"], ["r/c/m.py", "r/c/n.py"]]
    parts = {r.file: r.component for r in hi.import_components(edges).collect()}
    assert parts == {"r/a/x.js": "r/a/x.js", "r/a/y.js": "r/a/x.js", "r/b/z.js": "r/a/x.js", "r/c/m.py": "r/c/m.py", "r/c/n.py": "r/c/m.py"}


def test_statements_over_lines(spark):
    texts = {
        "a.js": ("javascript", "import {\n  a,\n  b\n} from './x';\nexport {\n  a as c,\n  b\n};\nconst run = (\n  x\n) => {\n  call(x);\n};\nimport { z } from './z';"),
        "a.go": ("go", "package a\nimport (\n\t\"fmt\"\n\tx \"net/http\"\n)\nfunc F() {\n}"),
        "a.py": ("python", "from p.q import (\n  a,\n  b)\n__all__ = [\n 'a',\n 'b']\nfrom r import ("),
        "a.rs": ("rust", "use crate::m::{\n  A,\n  B,\n};\npub fn f() {}"),
    }
    rows = [("r", p, lang, t) for p, (lang, t) in texts.items()]
    lines = to_lines(spark.createDataFrame(rows, "repo string, path string, lang string, content string"))
    joined = hi.logical_lines(lines)
    assert joined.columns == lines.columns
    assert {(r.path, r.source, r.kind, r.line_no) for r in hi.extract_imports(joined).collect()} == {
        ("a.js", "./x", "import", 1), ("a.js", "./z", "import", 14), ("a.go", "fmt", "import", 2), ("a.go", "net/http", "import", 2),
        ("a.py", "p.q", "from", 1), ("a.py", "r", "from", 7), ("a.rs", "crate::m", "use", 1),
    }
    assert {(r.path, r.name) for r in hi.export_list_names(joined).collect()} == {("a.js", "c"), ("a.js", "b"), ("a.py", "a"), ("a.py", "b")}
    assert {(r.path, r.name, r.line_no) for r in hi.extract_symbols(joined).collect()} == {("a.js", "run", 9), ("a.go", "F", 6), ("a.rs", "f", 5)}
    plain = {r.line for r in joined.filter("path = 'a.js'").collect()}
    assert {"  call(x);", "};"} <= plain


def test_copies_by_tokens(spark):
    code = [f"value{i} = call(one{i}, two{i});" for i in range(8)]  # nine tokens a line
    other = ["x = 1;"] * 3
    files = {
        "a.js": code, "b.js": [*other, *[part for line in code for part in line.replace("(", "(\n").split("\n")]], "c.js": [" ".join(code)],
        "short.js": code[:5], "d.js": [*["begin {"] * 3, "// a note", *code[:6], "", *code[6:], "end();"],
    }
    rows = [("r", p, i + 1, x) for p, ls in files.items() for i, x in enumerate(ls)]
    lines = spark.createDataFrame(rows, "repo string, path string, line_no long, line string")
    got = {(r.path_a, r.from_a, r.to_a, r.path_b, r.from_b, r.to_b, r.tokens) for r in hi.duplicate_tokens(lines).collect()}
    n = 9 * 8
    assert got == {("a.js", 1, 8, "b.js", 4, 19, n), ("a.js", 1, 8, "c.js", 1, 1, n), ("a.js", 1, 8, "d.js", 5, 13, n)}
    assert hi.duplicate_tokens(lines.filter("path in ('c.js')").unionByName(lines.filter("path = 'c.js'").withColumn("path", hi.F.lit("e.js")))).count() == 0  # one line each


def test_copies_by_tokens_are_the_same_in_any_buckets(spark, monkeypatch):
    """A bucket sends each distinct frame once, and files that share code meet across buckets as in one."""
    import pyarrow as pa

    from siftworks.operators import copies

    code = [f"value{i} = call(one{i}, two{i});" for i in range(8)]
    texts = {f"f{i}.js": [f"begin{i} {{", *code[i % 3 :], f"fin{i}();", *(code if i % 4 == 0 else [])] for i in range(12)}
    rows = [(p, i + 1, x) for p, ls in texts.items() for i, x in enumerate(ls)]
    lines = spark.createDataFrame(rows, "path string, line_no long, line string")
    monkeypatch.setattr(hi, "BUCKET_CHARS", 10**9)
    one = sorted(tuple(r) for r in hi.duplicate_tokens(lines).collect())
    monkeypatch.setattr(hi, "BUCKET_CHARS", 300)
    assert sorted(tuple(r) for r in hi.duplicate_tokens(lines).collect()) == one and len(one) >= 12
    same = pa.table({"path": [f"f{i}" for i in range(50) for _ in code], "line_no": [*range(8)] * 50, "line": code * 50})
    frames = copies.distinct(hi.TOKEN, 50)((pa.scalar(0),), same)
    assert frames.num_rows == 9 * 8 - 49 and set(frames.column("k").to_pylist()) == {50} and set(frames.column("path").to_pylist()) == {"f0"}
