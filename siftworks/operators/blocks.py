"""Function blocks by braces and by indentation, and measures on them; `lines` are those of code_lines()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written

BRACED = ["javascript", "typescript", "go", "rust", "java"]
BRANCH = r"\b(?:if|for|while|case|catch|elif|except|match)\b|&&|\|\||\?"
#: Comment lines of both families.
COMMENT = r"^\s*(//|#(?!\[)|\*|/\*)"
FUNCTION = r"\bfunction\b|=>\s*\{|\bfunc\s|\bfn\s|^\s*(?:public|protected|private)\s+(?:static\s+)?[\w<>]+\s+\w+\s*\(|^\s*(?:async\s+)?\w+\s*\([^;]*\)\s*\{"


def comment(line: Column) -> Column:
    return line.rlike(r"^\s*(//|\*|/\*)") | (line.rlike(r"^\s*#") & ~line.rlike(r"^\s*#\["))


def significant(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return lines.filter((F.trim("line") != "") & ~comment(F.col("line")))


#: A source text in pieces, from left to right: triple-quoted, double, single and back-quoted strings, block and line comments,
#: code between them, and quotes or slashes that open nothing. Block comments, triple and back-quoted strings cross lines.
PIECES = (
    r"\"\"\"[\s\S]*?(?:\"\"\"|\z)|'''[\s\S]*?(?:'''|\z)|\"[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*\"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
    r"|`[^`\\]*(?:\\[\s\S][^`\\]*)*`|/\*[\s\S]*?(?:\*/|\z)|//[^\n]*|[^\"'`/]+|[\"'`/]"
)
HIDDEN = r"^(?:[\"'`][\s\S]|/[/*])"


def masked(text: Column) -> Column:
    """The text without its strings and comments, line breaks kept, so that what looks like code in them doesn't count."""
    each = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.array_join(F.transform(each, lambda x: F.when(x.rlike(HIDDEN), F.regexp_replace(x, r"[^\n]+", "")).otherwise(x)), "")


def code_lines(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row a line, with `line` as it is and `code`, the line without strings and comments; a file is masked as a whole."""
    rest = [c for c in files.columns if c != text_col]
    both = F.arrays_zip(F.split(text_col, "\n").alias("line"), F.split(masked(F.col(text_col)), "\n").alias("code"))
    each = files.select(*rest, F.posexplode(both).alias("pos", "both"))
    return each.select(*rest, F.col("both.line").alias("line"), F.col("both.code").alias("code"), (F.col("pos") + 1).cast("bigint").alias("line_no"))


def brace_depth(lines: DataFrame) -> DataFrame:
    """Adds `depth`, the open braces at each line's end, and `before`, those at its begin."""
    delta = F.regexp_count("code", F.lit(r"\{")) - F.regexp_count("code", F.lit(r"\}"))
    by = Window.partitionBy("repo", "path").orderBy("line_no")
    return lines.withColumn("delta", delta).withColumn("depth", F.sum("delta").over(by)).withColumn("before", F.col("depth") - F.col("delta")).drop("delta")


def brace_pairs(lines: DataFrame) -> DataFrame:
    """(repo, path, open_line, close_line, depth) of matching braces: a closer belongs to the next event of its depth."""
    each = lines.select("repo", "path", "line_no", F.posexplode(F.regexp_extract_all("code", F.lit(r"[{}]"), F.lit(0))).alias("k", "c"))
    order = Window.partitionBy("repo", "path").orderBy("line_no", "k")
    open_ = F.col("c") == "{"
    run = F.sum(F.when(open_, 1).otherwise(-1)).over(order)
    level = each.withColumn("level", run + F.when(open_, 0).otherwise(1))
    same = Window.partitionBy("repo", "path", "level").orderBy("line_no", "k")
    paired = level.withColumn("next", F.lead(F.struct("line_no", "c")).over(same))
    return paired.filter(open_ & (F.col("next.c") == "}")).select("repo", "path", F.col("line_no").alias("open_line"), F.col("next.line_no").alias("close_line"), F.col("level").alias("depth"))


NO_HEAD = r"^\s*(?:if|for|while|switch|catch|match|return|else|\}|//|\*)"


def function_blocks(lines: DataFrame) -> DataFrame:
    """(repo, path, lang, first_line, open_line, last_line): functions from their heads to the end of the block that follows.

    The block opens on the head's line or a later one; a semicolon or a closing brace on a line before it ends the search.
    Only lines with one of these or a head decide that; others don't go into the shuffle.
    """
    head = F.col("code").rlike(FUNCTION) & ~F.col("code").rlike(NO_HEAD)
    braced = lines.filter(F.col("lang").isin(BRACED) & (F.col("code").rlike("[{;}]") | head))
    down = Window.partitionBy("repo", "path").orderBy("line_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first_of = lambda pattern: F.min(F.when(F.col("code").rlike(pattern), F.col("line_no"))).over(down)
    heads = braced.withColumn("open_line", first_of(r"\{")).withColumn("stop", first_of("[;}]"))
    heads = heads.filter(head & (F.col("open_line") <= F.coalesce("stop", "open_line")))
    # Of the pairs that open on a line the outermost is meant; of several such the last, as parameters may hold braces.
    body = brace_pairs(braced).groupBy("repo", "path", "open_line").agg(F.max(F.struct(-F.col("depth"), "close_line")).alias("x"))
    body = body.select("repo", "path", "open_line", F.col("x.close_line").alias("last_line"))
    return heads.select("repo", "path", "lang", F.col("line_no").alias("first_line"), "open_line").join(body.hint("merge"), ["repo", "path", "open_line"]).select("repo", "path", "lang", "first_line", "open_line", "last_line")


def indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^([ \t]*)", 1))


def indent_blocks(lines: DataFrame) -> DataFrame:
    """(repo, path, lang, first_line, last_line): Python functions, up to the line before the next one not indented deeper.

    Such a next line stands right below the head or is indented less than the line before it; others are left out at once.
    """
    text, file = F.col("line"), Window.partitionBy("repo", "path")
    py = lines.filter("lang = 'python'").select("repo", "path", "lang", "line_no", indent(text).alias("indent"), (F.trim("line") != "").alias("full"), text.rlike(r"^\s*(?:async\s+)?def\s+\w+").alias("head"))
    above = F.last(F.when(F.col("full"), F.struct("indent", "head")), ignorenulls=True).over(file.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    levels = F.collect_set(F.when(F.col("full") & F.col("head"), F.col("indent"))).over(file)
    rows = py.withColumns({"above": above, "end": F.max("line_no").over(file) + 1, "levels": levels})
    rows = rows.filter(F.col("full") & (F.col("head") | F.col("above.head") | (F.col("indent") < F.col("above.indent"))))
    # Each line once for each indentation that a head of its file has: the next line not deeper is a running minimum from below.
    rows = rows.select("repo", "path", "lang", "line_no", "indent", "head", "end", F.explode("levels").alias("level"))
    below = Window.partitionBy("repo", "path", "level").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.min(F.when(F.col("indent") <= F.col("level"), F.col("line_no"))).over(below)).filter("head AND indent = level")
    return rows.select("repo", "path", "lang", F.col("line_no").alias("first_line"), (F.coalesce("next", "end") - 1).alias("last_line"))


def all_blocks(lines: DataFrame) -> DataFrame:
    return function_blocks(lines).unionByName(indent_blocks(lines).withColumn("open_line", F.col("first_line")))


def block_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines of each block after the one that opens it: an equi join on line numbers, a row for each line that a block holds."""
    b = blocks.filter("last_line > open_line").select("repo", "path", "first_line", F.explode(F.expr("sequence(open_line + 1, last_line)")).alias("line_no"))
    return lines.join(b, ["repo", "path", "line_no"])


def doc_code_ratio(lines: DataFrame, most: float = 3.0, least: int = 3) -> DataFrame:
    """Functions with a body of `least` lines or more whose comment above is more than `most` times as long."""
    marked = lines.withColumn("is_doc", comment(F.col("line")))
    by = Window.partitionBy("repo", "path").orderBy("line_no")
    island = marked.withColumn("g", F.sum((~F.col("is_doc")).cast("int")).over(by)).filter("is_doc").groupBy("repo", "path", "g").agg(F.count("*").alias("doc"), (F.max("line_no") + 1).alias("first_line")).drop("g")
    blocks = all_blocks(lines).withColumn("body", F.col("last_line") - F.col("open_line"))
    return blocks.join(island, ["repo", "path", "first_line"]).filter((F.col("body") >= least) & (F.col("doc") > most * F.col("body"))).select("repo", "path", "first_line", "doc", "body")


def comment_ratio(lines: DataFrame, most: float = 2.0, least: int = 3) -> DataFrame:
    """Functions of `least` code lines or more with more than `most` comment lines to each."""
    inside = block_lines(lines, all_blocks(lines))
    per = inside.groupBy("repo", "path", "first_line").agg(F.count_if(comment(F.col("line"))).alias("comments"), F.count_if((F.trim("line") != "") & ~comment(F.col("line"))).alias("code"))
    return per.filter((F.col("code") >= least) & (F.col("comments") > most * F.col("code")))


LEAVES = r"^\s*(return|throw|raise|break|continue)\b"
ENDS = r"^\s*(\}|\]|\)|case\b|default\b|else\b|elif\b|catch\b|except\b|finally\b|_\s*=>)"


def dead_code(lines: DataFrame) -> DataFrame:
    """(repo, path, line_no, dead_line): the next significant line after a leaving statement, at the same depth."""
    sig = significant(brace_depth(lines.filter("lang <> 'markdown'"))).withColumn("indent", indent(F.col("line")))
    by = Window.partitionBy("repo", "path").orderBy("line_no")
    nxt = sig.withColumn("n", F.lead(F.struct("line", "line_no", "before", "indent")).over(by)).filter(F.col("line").rlike(LEAVES) & F.col("n").isNotNull())
    whole = F.col("line").rlike(r"[;)\w'\"\]}]\s*$") & ~F.col("line").rlike(r"[,({\[]\s*$")
    same = F.when(F.col("lang") == "python", F.col("n.indent") == F.col("indent")).otherwise((F.col("n.before") == F.col("before")) & (F.col("n.indent") >= F.col("indent")))
    return nxt.filter(whole & same & ~F.col("n.line").rlike(ENDS)).select("repo", "path", "line_no", F.col("n.line_no").alias("dead_line"))


# The one line of a stub, by language.
STUBS = {
    "javascript": r"^\s*return\s+(?:0|null|undefined|true|false|\[\]|\{\}|\"\"|''|``)\s*;?\s*$",
    "rust": r"^\s*(?:return\s+)?(?:None|0|true|false|String::new\(\)|Vec::new\(\)|vec!\[\]|\(\)|\"\"|Default::default\(\))\s*;?\s*$|^\s*(?:todo!\(\)|unimplemented!\(\)|panic!\([^)]*\))\s*;?\s*$",
    "java": r"^\s*return\s+(?:null|0|0L|0\.0|0\.0f|true|false|\"\"|Collections\.emptyList\(\)|Collections\.emptyMap\(\)|Optional\.empty\(\))\s*;\s*$|^\s*throw\s+new\s+(?:Unsupported(?:Operation)?Exception|NotImplementedException|IllegalStateException)\s*\([^)]*\)\s*;\s*$",
    "go": r"^\s*return\s+(?:nil|0|\"\"|false|true|\[\][a-zA-Z_]\w*\{\}|map\[[^\]]+\][a-zA-Z_]\w*\{\}|&?[A-Z]\w*\{\})\s*$|^\s*panic\s*\([^)]*\)\s*$",
    "python": r"^\s*return\s+(?:None|0|True|False|\[\]|\{\}|\"\")\s*$|^\s*pass\s*$|^\s*raise\s+NotImplementedError\s*\([^)]*\)\s*$|^\s*\.\.\.\s*$",
}
STUB_TODO = r"(?i)\b(?:TODO|FIXME|XXX|HACK|STUB)\b"
_DOC_STRING = r"^\s*(\"{3}|'{3})"


def stub_functions(lines: DataFrame) -> DataFrame:
    """Functions whose one significant line is a stub of their language; a TODO in the body raises certainty. A body on the opening line counts too.

    Files are masked and lines chosen once: those that decide are written, and blocks and bodies are made from them.
    """
    lines = written(_deciding(lines))
    line, lang = F.col("line"), F.col("lang")
    within = F.when(F.col("last_line") > F.col("open_line"), F.expr("sequence(open_line + 1, last_line)")).when((F.col("last_line") == F.col("first_line")) & (lang != "python"), F.array("first_line"))
    body = all_blocks(lines).select("repo", "path", "first_line", F.explode(within).alias("line_no"))
    told = lines.filter((lang != "python") | _in_body(line, lang)).select("repo", "path", "lang", "line_no", "line")
    # On a block's first line its body is what stands between the braces.
    said = F.when(F.col("line_no") == F.col("first_line"), F.regexp_extract("line", r"\{(.*)\}", 1)).otherwise(line)
    inside = told.join(body.hint("merge"), ["repo", "path", "line_no"]).withColumn("line", said)
    code, stub = _stub_code(line, lang), F.when(F.lit(False), F.lit(False))
    for name, rx in (STUBS | {"typescript": STUBS["javascript"]}).items():
        stub = stub.when(lang == name, line.rlike(rx))
    marks = inside.select("repo", "path", "lang", "first_line", code.alias("code"), (code & stub).alias("stub"), line.rlike(STUB_TODO).alias("todo"))
    per = marks.groupBy("repo", "path", "lang", "first_line").agg(F.count_if("code").alias("n"), F.count_if("stub").alias("stubs"), F.bool_or("todo").alias("todo"))
    return per.filter("n = 1 AND stubs = 1").select("repo", "path", "first_line", F.when(F.col("todo"), "HIGH").otherwise("MEDIUM").alias("certainty"))


def _stub_code(line: Column, lang: Column) -> Column:
    """Whether a line counts in a body: neither blank, a comment, a doc string of Python nor a closing bracket alone."""
    return (F.trim(line) != "") & ~comment(line) & ~line.rlike(r"^\s*[})\]];?\s*$") & ~((lang == "python") & line.rlike(_DOC_STRING))


def _in_body(line: Column, lang: Column) -> Column:
    return _stub_code(line, lang) | line.rlike(STUB_TODO)


def _deciding(lines: DataFrame) -> DataFrame:
    """Lines that decide on stubs: those that count in a body or hold a TODO, and those that tell where blocks begin and end.

    Any line of Python may end a block by its indentation, so all stay, but of its comments without a TODO only the mark.
    """
    line, code, lang = F.col("line"), F.col("code"), F.col("lang")
    mark = F.when(comment(line) & ~line.rlike(STUB_TODO), F.regexp_extract("line", r"^\s*(?:#|//|/?\*)", 0)).otherwise(line)
    known = lines.filter(lang.isin(*BRACED, "python")).filter((lang == "python") | code.rlike("[{;}]") | code.rlike(FUNCTION) | _in_body(line, lang))
    return known.select("repo", "path", "lang", "line_no", F.when(lang == "python", mark).otherwise(line).alias("line"), F.when(lang != "python", code).alias("code"))


def complexity(lines: DataFrame, medium: int = 10, high: int = 20) -> DataFrame:
    """(repo, path, first_line, complexity, level): one more than the branch words of each function."""
    inside = block_lines(lines, all_blocks(lines)).filter(~comment(F.col("line")))
    per = inside.groupBy("repo", "path", "first_line").agg((F.sum(F.regexp_count("code", F.lit(BRANCH))) + 1).alias("complexity"))
    return per.withColumn("level", F.when(F.col("complexity") > high, "high").when(F.col("complexity") > medium, "medium").otherwise("low"))
