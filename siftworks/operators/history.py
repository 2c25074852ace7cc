"""Symbols, imports, snapshots, commit history, import cycles and copied blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written
from .blocks import significant
from .copies import COPIES, FRAMES, copies, distinct
from .scan import TEST_PATH

_JS, _PY, _GO, _RS, _JV = ["javascript", "typescript"], ["python"], ["go"], ["rust"], ["java"]
_OPEN, _PUB = r"^\s*(?:export\s+)?(?:default\s+)?", r"^\s*(?:pub(?:\([^)]*\))?\s+)?"
# Symbol rules (languages, kind, pattern with the name as group 1) and import rules (the source as group 1).
SYMBOLS = [
    (_JS, "function", _OPEN + r"(?:async\s+)?function\b\s*\*?\s*(\w+)"),
    (_JS, "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)\s*=>|function\b)"),
    (_JS, "function", r"^\s*export\s+(default)\s+(?:async\s+)?function\b\s*\*?\s*\("),
    (_JS, "class", _OPEN + r"(?:abstract\s+)?class\s+(\w+)"),
    (_JS, "class", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*class\b"),
    (_JS, "class", r"^\s*export\s+(default)\s+class\s*\{"),
    (_JS, "type", r"^\s*(?:export\s+)?(?:interface|type|(?:const\s+)?enum|namespace)\s+(\w+)"),
    (_JS, "namespace", r"^\s*export\s+as\s+namespace\s+(\w+)"),
    (_JS, "constant", r"^\s*(?:export\s+)?const\s+([A-Z][A-Z0-9_]+)\s*="),
    (_JS, "variable", r"^\s*export\s+(?:let|var)\s+(\w+)"),
    (_JS, "value", r"^\s*export\s+default\s+(\w+)\s*;?\s*$"),
    (_JS, "value", r"^\s*module\.exports\s*=\s*([A-Za-z_]\w*)\s*;?\s*$"),
    (_JS, "value", r"^\s*(?:module\.)?exports\.(\w+)\s*=[^=]"),
    (_JS, "re-export", r"^\s*export\s+(\*)\s+from\b"),
    (_PY, "function", r"^\s*(?:async\s+)?def\s+(\w+)"),
    (_PY, "class", r"^\s*class\s+(\w+)"),
    (_PY, "constant", r"^([A-Z][A-Z0-9_]+)\s*="),
    (_GO, "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    (_GO, "type", r"^type\s+(\w+)\s"),
    (_GO, "constant", r"^(?:const|var)\s+(\w+)"),
    (_RS, "function", _PUB + r"(?:async\s+)?fn\s+(\w+)"),
    (_RS, "type", _PUB + r"(?:struct|enum|trait|type)\s+(\w+)"),
    (_RS, "constant", _PUB + r"(?:const|static)\s+(\w+)\s*:"),
    (_RS, "module", _PUB + r"mod\s+(\w+)"),
    (_JV, "class", r"^\s*(?:public\s+)?(?:abstract\s+|final\s+)?class\s+(\w+)"),
    (_JV, "type", r"^\s*(?:public\s+)?(?:interface|enum|record)\s+(\w+)"),
    (_JV, "constant", r"^\s*(?:public\s+|protected\s+|private\s+)?static\s+final\s+[\w<>\[\],.?]+\s+(\w+)\s*="),
    (_JV, "function", r"^\s*(?:public|protected|private)\s+(?:static\s+)?(?:(?:void|boolean|byte|char|short|int|long|float|double)(?:\[\])*|[\w.]*[A-Z][\w<>\[\],.?]*)\s+(\w+)\s*\("),
]
IMPORTS = [
    (_JS, "import", r"^\s*import\s.*from\s+['\"]([^'\"]+)['\"]"),
    (_JS, "side-effect", r"^\s*import\s+['\"]([^'\"]+)['\"]"),
    (_JS, "require", r"require\(['\"]([^'\"]+)['\"]\)"),
    (_PY, "from", r"^\s*from\s+([\w.]+)\s+import"),
    (_PY, "import", r"^\s*import\s+([\w., ]+)"),
    (_GO, "import", r"^\s*import\s+(?:[\w.]+\s+)?\"([^\"]+)\""),
    (_GO, "import-group", r"^\s*import\s*\(([^)]*)\)"),
    (_RS, "use", r"^\s*(?:pub\s+)?use\s+([\w:]+?)(?:::\*|::\{[^}]*\})?;"),
    (_JV, "import", r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?);"),
]
IMPORT_WORDS = ["import", "require(", "use"]
#: Lines that export the symbols on them.
SHOWN = {"js": r"^\s*(?:export\s|(?:module\.)?exports\b)", "py": r"^\S", "rs": r"^\s*pub\b", "jv": r"^\s*public\s"}


#: Lines that open a statement of imports, exports or a function's head and don't close it, and what closes one.
OPENS = (
    r"^\s*import\s*(?:type\s*)?[\w*,\s]*\{[^}]*$|^\s*import\s*\([^)]*$|^\s*from\s+[\w.]+\s+import\s*\([^)]*$|^\s*(?:pub\s+)?use\s+[\w:]+::\{[^}]*$|^\s*export\s*(?:type\s*)?\{[^}]*$"
    r"|^\s*(?:module\.exports|__all__)\s*=\s*[{\[][^}\]]*$|^\s*(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\([^)]*$"
)
CLOSES = r"[)}\]]"


def logical_lines(lines: DataFrame) -> DataFrame:
    """`lines` with statements that go over several lines joined to one, at their first line's number.

    A statement runs from a line that opens one to the first line that closes a bracket; one that nothing closes stays as it was.
    """
    by = Window.partitionBy("repo", "path").orderBy("line_no")
    opens = F.col("line").rlike(OPENS).cast("int")
    rows = lines.withColumns({"opens": opens, "g": F.sum(opens).over(by)})
    own = Window.partitionBy("repo", "path", "g")
    closed = F.sum((F.col("line").rlike(CLOSES) & (F.col("opens") == 0)).cast("int"))
    before = F.coalesce(closed.over(own.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"joined": (F.col("g") > 0) & (before == 0) & (closed.over(own) > 0), "head": F.min("line_no").over(own)})
    at = F.when(F.col("joined"), F.col("head")).otherwise(F.col("line_no"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    rest = [c for c in lines.columns if c not in ("repo", "path", "line_no", "line")]
    return rows.groupBy("repo", "path", at.alias("at")).agg(text.alias("line"), *(F.first(c).alias(c) for c in rest)).withColumnRenamed("at", "line_no").select(*lines.columns)


def _found(rules, lang: Column, line: Column) -> Column:
    return F.array_compact(F.array(*[F.when(lang.isin(ls) & line.rlike(rx), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, rx, 1).alias("name"))) for ls, kind, rx in rules]))


def extract_symbols(lines: DataFrame) -> DataFrame:
    """(repo, path, lang, kind, name, line_no): the first line of each symbol."""
    rows = lines.select("repo", "path", "lang", "line_no", F.explode(_found(SYMBOLS, F.col("lang"), F.col("line"))).alias("s"))
    return rows.groupBy("repo", "path", "lang", "s.kind", "s.name").agg(F.min("line_no").alias("line_no"))


def export_list_names(lines: DataFrame) -> DataFrame:
    """(repo, path, name) of `export { a as b }`, `module.exports = { .. }` and `__all__`."""
    lists = [r"^\s*export\s*\{([^}]*)\}", r"module\.exports\s*=\s*\{([^}]*)\}", r"__all__\s*=\s*\[([^\]]*)\]"]
    body = F.array_compact(F.array(*[F.when(F.col("line").rlike(rx), F.regexp_extract("line", rx, 1)) for rx in lists]))
    part = lines.select("repo", "path", F.explode(body).alias("b")).select("repo", "path", F.explode(F.split("b", ",")).alias("x"))
    name = F.regexp_replace(F.regexp_replace(F.trim("x"), r"^.*\sas\s+", ""), r"['\"]|:.*$", "")
    return part.select("repo", "path", name.alias("name")).filter("name <> ''").distinct()


def exports(lines: DataFrame) -> DataFrame:
    """(repo, path, name) of what a file exports: export words and lists; Python public names; Go capitals; `pub`, `public`."""
    open_ = {
        "js": F.col("lang").isin(_JS) & F.col("line").rlike(SHOWN["js"]),
        "py": F.col("lang").isin(_PY) & ~F.col("name").startswith("_") & F.col("line").rlike(SHOWN["py"]),
        "go": F.col("lang").isin(_GO) & F.col("name").rlike("^[A-Z]"),
        "rs": F.col("lang").isin(_RS) & F.col("line").rlike(SHOWN["rs"]),
        "jv": F.col("lang").isin(_JV) & F.col("line").rlike(SHOWN["jv"]),
    }
    rows = lines.select("repo", "path", "lang", "line", F.explode(_found(SYMBOLS, F.col("lang"), F.col("line"))).alias("s")).select("repo", "path", "lang", "line", "s.name")
    named = rows.filter(open_["js"] | open_["py"] | open_["go"] | open_["rs"] | open_["jv"]).select("repo", "path", "name")
    return named.unionByName(export_list_names(lines)).distinct()


def extract_imports(lines: DataFrame) -> DataFrame:
    """(repo, path, source, kind, line_no): distinct imports, lists split. No pattern matches without one of IMPORT_WORDS."""
    lines = lines.filter(reduce(lambda a, b: a | b, [F.col("line").contains(w) for w in IMPORT_WORDS]))
    rows = lines.select("repo", "path", "line_no", F.explode(_found(IMPORTS, F.col("lang"), F.col("line"))).alias("s"))
    listed = F.when(F.col("s.kind") == "import-group", F.regexp_extract_all("s.name", F.lit('"([^"]+)"'), F.lit(1))).otherwise(F.split("s.name", r"\s*,\s*"))
    each = rows.select("repo", "path", "line_no", F.regexp_replace("s.kind", "-group$", "").alias("kind"), F.explode(listed).alias("source")).filter("source <> ''")
    return each.groupBy("repo", "path", "source", "kind").agg(F.min("line_no").alias("line_no"))


def dependency_edges(imports: DataFrame) -> DataFrame:
    """(repo, path, sources): distinct sources of each file."""
    return imports.groupBy("repo", "path").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def map_stats(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo").agg(F.countDistinct("path").alias("files"), F.count("*").alias("symbols"))


def import_cycles(edges: DataFrame, longest: int = 6) -> DataFrame:
    """(cycle): simple cycles of up to `longest` nodes, as paths that begin at their least node.

    A cycle is met in its middle: a path of half its edges away from its least node, and one of the other half back to
    it. Neither leaves the nodes above that least one, so each cycle is found once. Joins are merged: a broadcast would
    hold all edges, and the joins that it serves would run in the few tasks of the first one.
    """
    e = written(edges.select("src", "dst").filter("src <> dst").distinct())
    away, back = (_halves(e, *ends, most) for ends, most in ((("src", "dst"), (longest + 1) // 2), (("dst", "src"), longest // 2)))
    met = away.alias("a").join(back.hint("merge").alias("b"), ["least", "last"]).filter(F.size("a.nodes").isin(F.size("b.nodes"), F.size("b.nodes") + 1))
    inner = {side: F.slice(f"{side}.nodes", F.lit(2), F.size(f"{side}.nodes") - 2) for side in "ab"}
    return met.filter(~F.arrays_overlap(inner["a"], inner["b"])).select(F.concat("a.nodes", F.reverse(inner["b"])).alias("cycle"))


def _halves(e: DataFrame, near: str, far: str, most: int) -> DataFrame:
    """(nodes, least, last): simple paths of up to `most` edges, from their least node on, along edges taken from `near` to `far`."""
    paths = e.filter(F.col(near) < F.col(far)).select(F.array(near, far).alias("nodes"))
    found = paths
    for _ in range(most - 1):
        step = paths.join(e.hint("merge"), F.element_at("nodes", -1) == F.col(near))
        paths = step.filter((F.col(far) > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col(far))).select(F.concat("nodes", F.array(far)).alias("nodes"))
        found = found.unionByName(paths)
    return found.select("nodes", F.col("nodes")[0].alias("least"), F.element_at("nodes", -1).alias("last"))


def import_components(edges: DataFrame) -> DataFrame:
    """(file, component): every file on a circular import of any length, by the least file of its strongly connected component.

    A round gives each file the least file that reaches it, and within files of one such label the least that it
    reaches. Where both are the same file, that is its component; edges between open files of the same two labels go
    into the next round, until none is left. Joins are merged: there are many rounds, and each broadcast goes through the driver.
    """
    e = written(edges.filter("src <> dst").select("src", "dst").distinct())
    found = edges.select(F.col("src").alias("file"), F.col("src").alias("component")).limit(0)
    while not e.isEmpty():
        ahead = _ends(e, _least_label(e, "src", "dst"), "f").filter("src_f = dst_f")
        ahead = written(ahead.select("src", "dst", F.col("src_f").alias("f")))
        least = _least_label(ahead, "dst", "src")
        of = ahead.select(F.explode(F.array("src", "dst")).alias("node"), "f").distinct()
        found = found.unionByName(written(of.join(least.hint("merge"), "node").filter("label = f").select(F.col("node").alias("file"), F.col("f").alias("component"))))
        e = written(_ends(ahead, least, "b").filter("src_b = dst_b and src_b <> f").select("src", "dst"))
    many = found.groupBy("component").count().filter("count > 1").select("component")
    return found.join(many, "component").select("file", "component")


def _ends(e: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Edges with the labels of both ends, `src_name` and `dst_name`."""
    for end in ("src", "dst"):
        e = e.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_{name}")).hint("merge"), end)
    return e


def _least_label(e: DataFrame, start: str, end: str) -> DataFrame:
    """(node, label): the least node from which each node is reached along start -> end, by joins until nothing changes."""
    labels = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("label"), F.lit(True).alias("new"))
    step = e.select(F.col(start).alias("node"), F.col(end).alias("to"))
    while not labels.filter("new").isEmpty():
        sent = labels.filter("new").join(step.hint("merge"), "node").select(F.col("to").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        met = labels.select("node", "label", F.col("label").alias("old")).unionByName(sent).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        labels = written(met.select("node", "label", (F.col("label") < F.col("old")).alias("new")))
    return labels.select("node", "label")


def duplicate_blocks(lines: DataFrame, size: int = 5) -> DataFrame:
    """Copied blocks of at least `size` significant lines: (path_a, from_a, path_b, from_b, n).

    Each frame of `size` lines is hashed; a frame is compared with the first place of its hash only, so a
    block in many files gives a row a file and not a row a pair. Frames at one offset merge to one block.
    """
    by = Window.partitionBy("path").orderBy("line_no")
    sig = significant(lines).withColumn("rn", F.row_number().over(by)).withColumn("t", F.trim("line"))
    frame = F.collect_list("t").over(by.rowsBetween(0, size - 1))
    frames = sig.select("path", "rn", "line_no", frame.alias("f")).filter(F.size("f") == size).select("path", "rn", "line_no", F.md5(F.array_join("f", "\n")).alias("h"))
    first = frames.groupBy("h").agg(F.min(F.struct("path", "rn", "line_no")).alias("a"))
    pairs = frames.join(first, "h").filter((F.col("path") != F.col("a.path")) | (F.col("rn") - F.col("a.rn") >= size))
    pairs = pairs.select(F.col("a.path").alias("path_a"), F.col("a.rn").alias("rn_a"), F.col("a.line_no").alias("line_a"), F.col("path").alias("path_b"), "rn", "line_no")
    runs = Window.partitionBy("path_a", "path_b", F.col("rn") - F.col("rn_a")).orderBy("rn")
    islands = pairs.withColumn("island", F.col("rn") - F.row_number().over(runs)).groupBy("path_a", "path_b", (F.col("rn") - F.col("rn_a")).alias("off"), "island")
    return islands.agg(F.min("line_a").alias("from_a"), F.min("line_no").alias("from_b"), (F.count("*") + size - 1).alias("n")).select("path_a", "from_a", "path_b", "from_b", "n")


TOKEN = r"[A-Za-z_]\w*|\d+|[^\s\w]"


#: Characters of code that one Python task holds at a time.
BUCKET_CHARS = 6_000_000


def duplicate_tokens(lines: DataFrame, tokens: int = 50, size: int = 5) -> DataFrame:
    """Copied code of at least `tokens` tokens on `size` lines or more of either side: (path_a, from_a, to_a, path_b, from_b, to_b, tokens).

    Files are compared by their tokens, so other line breaks and spaces don't hide a copy; blank and comment lines, and lines without a path, don't
    count. A frame of `tokens` tokens is compared with the first place of its hash only, so code in many files makes a row a file and
    not a row a pair. Frames at one offset merge to one block.

    Files are dealt into buckets of about BUCKET_CHARS. A bucket sends each of its distinct frames once, with its count and first
    place there, and gets back the first place of those that occur twice or more anywhere; it then finds its blocks by itself.
    """
    rows = significant(lines).filter("path IS NOT NULL AND line_no IS NOT NULL").select("path", F.col("line_no").cast("bigint").alias("line_no"), F.make_valid_utf8("line").alias("line"))
    n = -(-(rows.agg(F.sum(F.length("line"))).first()[0] or 1) // BUCKET_CHARS)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(n))).repartition(n, "bucket")
    frames = dealt.groupBy("bucket").applyInArrow(distinct(TOKEN, tokens), FRAMES)
    of = Window.partitionBy("h1", "h2")
    place = F.struct("path", "pos", "first", "last", "o1", "o2")
    firsts = frames.select("bucket", "at", F.sum("k").over(of).alias("k"), F.min(place).over(of).alias("a")).filter("k > 1").select("bucket", "at", "a.*")
    return dealt.groupBy("bucket").cogroup(firsts.groupBy("bucket")).applyInArrow(copies(TOKEN, tokens, size), COPIES)


def co_change_pairs(commit_files: DataFrame, least: int = 3, most_files: int = 20) -> DataFrame:
    """(file_a, file_b, times): source files that change together, in commits of 2 to `most_files` of them."""
    code = commit_files.select("hash", "path").distinct().filter(F.col("path").rlike(r"\.(js|ts|py|go|rs|java)$") & ~F.col("path").rlike(TEST_PATH))
    sized = code.groupBy("hash").agg(F.collect_set("path").alias("paths")).filter((F.size("paths") >= 2) & (F.size("paths") <= most_files))
    a = sized.select("paths", F.explode("paths").alias("file_a"))
    pairs = a.select("file_a", F.explode("paths").alias("file_b")).filter("file_a < file_b")
    return pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("times")).filter(F.col("times") >= least)


def co_change(pairs: DataFrame, flag: int = 5, high: int = 10, partners: int = 5) -> DataFrame:
    """Files by their number of partners: flagged from `flag`, high from `high`, with the closest partners."""
    both = pairs.unionByName(pairs.select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"), "times"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("file_a").orderBy(F.desc("times"), "file_b"))).withColumn("degree", F.count("*").over(Window.partitionBy("file_a")))
    top = ranked.filter((F.col("rank") <= partners) & (F.col("degree") >= flag))
    per = top.groupBy(F.col("file_a").alias("file"), "degree").agg(F.array_sort(F.collect_list(F.struct("rank", "file_b"))).alias("x"))
    return per.select("file", "degree", F.col("x.file_b").alias("partners"), F.when(F.col("degree") >= high, "high").otherwise("medium").alias("severity"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified (the hash differs) or deleted. old, new: (path, hash)."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).filter("change IS NOT NULL")


def apply_changes(snapshot: DataFrame, changes: DataFrame, scanned: DataFrame) -> DataFrame:
    """The symbol map (path, name) after changes (status, from_path, to_path): deletions go, renames move, the rest is scanned anew."""
    gone = changes.filter("status IN ('D', 'A', 'M')").select(F.col("from_path").alias("path"))
    moves = changes.filter("status = 'R'").select(F.col("from_path").alias("path"), "to_path").dropDuplicates(["path"])
    stay = snapshot.join(gone, "path", "left_anti").join(moves, "path", "left").select(F.coalesce("to_path", "path").alias("path"), "name")
    anew = changes.filter("status IN ('A', 'M')").select(F.col("from_path").alias("path")).distinct()
    return stay.unionByName(scanned.join(anew, "path", "left_semi").select("path", "name"))


def staleness(snapshots: DataFrame, commits: DataFrame, rebuild: int = 50) -> DataFrame:
    """(repo, status, behind): snapshots (repo, base, branch, now_branch) against commits (repo, hash, ts)."""
    base = snapshots.join(commits.select("repo", F.col("hash").alias("base"), F.col("ts").alias("base_ts")), ["repo", "base"], "left")
    later = base.select("repo", "base_ts").join(commits.select("repo", "ts"), "repo").filter("ts > base_ts").groupBy("repo").agg(F.count("*").alias("behind"))
    both = base.join(later, "repo", "left").withColumn("behind", F.coalesce("behind", F.lit(0)))
    status = (
        F.when(F.col("base").isNull(), "no_base")
        .when(F.col("base_ts").isNull(), "base_gone")
        .when(F.col("branch") != F.col("now_branch"), "branch_changed")
        .when(F.col("behind") > rebuild, "rebuild")
        .when(F.col("behind") > 0, "stale")
        .otherwise("fresh")
    )
    return both.select("repo", status.alias("status"), "behind")
