"""Joins between claims, evidence, setups, usage, links, docs, tests, tasks and commits.

Containment questions are turned into equi joins on tokens; a residual test follows. No cross joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.literals import joint, may_match, may_match_any
from .imports import normalised

# Quality words by category, signs of a claim, and evidence by category.
CLAIM_WORDS = {
    "production": ["production-ready", "production-grade", "prod-ready"],
    "enterprise": ["enterprise-grade", "enterprise-ready", "enterprise-class"],
    "security": ["secure", "secure by default", "security-focused"],
    "scale": ["scalable", "high-performance", "performant", "highly scalable"],
    "reliability": ["battle-tested", "robust", "reliable", "rock-solid"],
    "completeness": ["comprehensive", "complete", "full-featured", "feature-complete"],
}
CLAIMS = r"(?i)\bis\s+|\bare\s+|\bprovides?\s+|\boffers?\s+|\bfeatures?\s+|\bfully\s+|\b100%\s+|\bdesigned\s+(for|to\s+be)\s+"
NOT_CLAIMS = r"(?i)\bTODO\b|\bFIXME\b|\bshould\s+be\b|\bwill\s+be\b|\bmake\s+(?:it\s+(?:more|less|better)|this\b)|\bneeds?\s+to\s+be\b|\bplan(?:ning)?\s+to\b|\bwants?\s+to\b"
_TESTS = r"\.test\.[jt]sx?$|\.spec\.[jt]sx?$|__tests__|test_.*\.py$|_test\.go$|_test\.rs$"
EVIDENCE = {
    ("production", "tests"): ("path", _TESTS),
    ("production", "errorHandling"): ("content", r"try\s*\{|catch\s*\(|\.catch\s*\(|except\s*:|if\s+let\s+Err|match.*Err\("),
    ("production", "logging"): ("content", r"(?i)logger\.|\.log\s*\(|console\.error|tracing::|slog\.|log\.(info|warn|error|debug)"),
    ("enterprise", "auth"): ("content", r"(?i)authenticat|authorization|permission|rbac|acl|role"),
    ("enterprise", "audit"): ("content", r"(?i)audit|track.*event|event.*log|activity.*log"),
    ("enterprise", "rateLimit"): ("content", r"(?i)rate.?limit|throttle|limiter"),
    ("security", "validation"): ("content", r"(?i)validat|sanitiz|escape|clean|htmlspecialchars"),
    ("security", "auth"): ("content", r"(?i)\bauth\b|token|jwt|session|login|passport"),
    ("security", "encryption"): ("content", r"(?i)encrypt|decrypt|hash|bcrypt|argon|crypto\."),
    ("scale", "async"): ("content", r"async\s+|await\s+|Promise|Future|tokio|async_std|goroutine"),
    ("scale", "cache"): ("content", r"(?i)\bcache\b|redis|memcache|lru"),
    ("scale", "pool"): ("content", r"(?i)pool|connection.?pool|thread.?pool"),
    ("reliability", "tests"): ("path", _TESTS),
    ("reliability", "coverage"): ("content", r"(?i)coverage|lcov|nyc|istanbul|codecov"),
    ("reliability", "errorHandling"): ("content", r"try\s*\{|catch\s*\(|\.catch\s*\(|except\s*:|if\s+let\s+Err"),
    ("completeness", "edgeCases"): ("content", r"(?i)edge.?case|boundary|corner.?case"),
    ("completeness", "errorHandling"): ("content", r"(?i)\b(handle|handles|handled|handling)\s+(all\s+)?(errors?|exceptions?|failures?)\b"),
    ("completeness", "documentation"): ("content", r"/\*\*|///|\"\"\"|'''"),
}
# Name endings of components, how they are created, and built-in commands.
SUFFIXES = "Client|Connection|Pool|Service|Provider|Manager|Factory|Repository|Gateway|Adapter|Handler|Broker|Queue|Cache|Store|Transport|Channel|Socket|Server|Database"
_MADE = "create|connect|init|initialize|setup"
_TYPE = r"(?:\w+(?:<[^>]*>)?)"
SETUPS = {
    "javascript": [
        rf"(?:const|let|var)\s+(\w+)\s*=\s*new\s+(\w+(?:{SUFFIXES}))",
        rf"(?i)(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?(?:{_MADE})(\w+)",
        rf"(?i)(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?\w+\.(?:{_MADE}|open|start)\(()",
    ],
    "python": [
        rf"(\w+)\s*=\s*(\w+(?:{SUFFIXES}))\(",
        rf"(\w+)\s*=\s*\w+\.(\w+(?:{SUFFIXES}))\(",
        rf"(\w+)\s*=\s*(?:{_MADE})_(\w+)\(",
        rf"(\w+)\s*=\s*await\s+(?:{_MADE})_(\w+)\(",
    ],
    "go": [
        r"(\w+)\s*:=\s*(?:New|Create|Connect|Init|Setup)(\w+)\(",
        r"(\w+)\s*:=\s*\w+\.(?:New|Create|Connect|Init|Setup)(\w+)\(",
        r"var\s+(\w+)\s+.*=\s*(?:New|Create|Connect|Init|Setup)(\w+)\(",
        rf"(\w+)\s*:=\s*&(\w+(?:{SUFFIXES}))\{{",
    ],
    "rust": [
        rf"let\s+(?:mut\s+)?(\w+)\s*=\s*(\w*(?:{SUFFIXES}))::(?:new|create|connect|init|build)\(",
        r"let\s+(?:mut\s+)?(\w+)\s*=\s*(\w+Builder)::new\(\).*\.build\(\)",
        rf"let\s+(?:mut\s+)?(\w+)\s*=\s*(\w*(?:{SUFFIXES}))::from",
    ],
    "java": [
        rf"{_TYPE}\s+(\w+)\s*=\s*new\s+(\w+(?:{SUFFIXES}))(?:<[^>]*>)?\s*\(",
        rf"{_TYPE}\s+(\w+)\s*=\s*(\w+(?:Factory|Builder))\.(?:create|build|get|new)\w*\(",
        rf"{_TYPE}\s+(\w+)\s*=\s*(\w+)\.builder\(\).*\.build\(\)",
        rf"@(?:Autowired|Inject)\s+(?:private\s+)?{_TYPE}\s+(\w+)()",
    ],
}
BUILTINS = ["install", "i", "ci", "test", "t", "start", "build", "publish", "pack"]
TASK_STOP_WORDS = ["the", "a", "an", "is", "are", "and", "or", "to", "for", "in", "on", "at", "by", "add", "fix", "update", "create", "implement"]
IDENTIFIER = r"[A-Za-z_]\w*"


def claim_pattern() -> str:
    words = sorted((w for ws in CLAIM_WORDS.values() for w in ws), key=lambda w: -len(w))
    return r"(?i)\b(" + "|".join(words) + r")\b"


def extract_claims(lines: DataFrame) -> DataFrame:
    """(repo, path, line_no, buzzword, category, positive): quality words, the longest first.

    Lines are searched for the words as plain strings first, so that patterns are tried on few of them.
    """
    words = {w for ws in CLAIM_WORDS.values() for w in ws}
    short = sorted(w for w in words if not any(x != w and x in w for x in words))
    held = lines.select("repo", "path", "line_no", "line", F.lower("line").alias("lower")).filter(reduce(lambda a, b: a | b, [F.col("lower").contains(w) for w in short]))
    said = held.select("repo", "path", "line_no", "line", F.explode(F.regexp_extract_all("line", F.lit(claim_pattern()), F.lit(1))).alias("w"))
    positive = F.col("line").rlike(CLAIMS) & ~F.col("line").rlike(NOT_CLAIMS)
    category = reduce(lambda c, kv: c.when(F.col("buzzword").isin(kv[1]), kv[0]), CLAIM_WORDS.items(), F.when(F.lit(False), ""))
    return said.select("repo", "path", "line_no", positive.alias("positive"), F.lower("w").alias("buzzword")).withColumn("category", category)


def evidence(files: DataFrame) -> DataFrame:
    """(repo, category, hits): distinct (kind, path) that speak for a category."""

    def hit(key: tuple[str, str], where: tuple[str, str]) -> Column:
        cond, text = F.col(where[0]).rlike(where[1]), F.col(where[0])
        if where[0] == "content" and (first := may_match(where[1], text, F.col("lower"))) is not None:
            cond = first & cond
        return F.when(cond, F.struct(F.lit(key[0]).alias("category"), F.lit(key[1]).alias("kind")))

    found = files.select("repo", "path", "content", F.lower("content").alias("lower")).select("repo", "path", F.explode(F.array_compact(F.array(*[hit(k, w) for k, w in EVIDENCE.items()]))).alias("e"))
    return found.groupBy("repo", "e.category").agg(F.countDistinct("e.kind", "path").alias("hits"))


def claims_without_evidence(claims: DataFrame, files: DataFrame, least: int = 2) -> DataFrame:
    """Positive claims with fewer than `least` pieces of evidence: none is high, else medium."""
    both = claims.filter("positive").join(evidence(files), ["repo", "category"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return both.filter(F.col("hits") < least).withColumn("severity", F.when(F.col("hits") == 0, "high").otherwise("medium"))


def extract_setups(lines: DataFrame) -> DataFrame:
    """(repo, path, line_no, line, name, kind): components that are created, one row a name of a file, that of the last form and line.

    Lines are read once by all forms joined, and only those that some form may match go on.
    """
    every = [(lang, rx) for lang, rxs in SETUPS.items() for rx in rxs]
    lines = lines.filter(may_match_any(joint([rx for _, rx in every]), F.col("line")))

    def found(seq: int, lang: str, rx: str) -> Column:
        langs = ["javascript", "typescript"] if lang == "javascript" else [lang]
        kind = F.regexp_extract("line", rx, 2)
        hit = F.col("lang").isin(langs) & F.col("line").rlike(rx)
        return F.when(hit, F.struct(F.lit(seq).alias("seq"), F.regexp_extract("line", rx, 1).alias("name"), F.when(kind == "", "Infrastructure").otherwise(kind).alias("kind")))

    all_ = F.array_compact(F.array(*[found(i, lang, rx) for i, (lang, rx) in enumerate(every)]))
    rows = lines.select("repo", "path", "line_no", "line", F.explode(all_).alias("s")).filter((F.length("s.name") > 1) & ~F.col("s.name").rlike("^[ijkxy]$"))
    last = rows.groupBy("repo", "path", F.col("s.name").alias("name")).agg(F.max(F.struct("s.seq", "line_no", "line", "s.kind")).alias("m"))
    return last.select("repo", "path", "m.line_no", "m.line", "name", "m.kind")


def name_uses(lines: DataFrame) -> DataFrame:
    """(repo, path, line_no, name): names that a line uses: before a member or an index, in parentheses, or in what is returned."""
    line = F.col("line")
    all_ = lambda text, rx: F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    used = F.concat(
        all_(line, r"\w+(?=\s*\.\w)"), all_(line, r"\w+(?=\s*\[)"), all_(line, r"\w+(?=\s*\))"),
        all_(F.regexp_extract(line, r"\((.*)\)", 1), r"\w+"), all_(F.regexp_extract(line, r"return\s+(.*)", 1), r"\w+"),
    )
    return lines.filter(may_match_any(joint([r"[\[()]|return|\w\s*\.\w"]), line)).select("repo", "path", "line_no", F.explode(F.array_distinct(used)).alias("name"))


def setup_without_usage(setups: DataFrame, lines: DataFrame) -> DataFrame:
    """Setups whose name no other line of the repo uses; lines that export, and functions that hold the name, are excused."""
    names = setups.select("repo", "name").distinct()
    uses = name_uses(lines).join(names, ["repo", "name"], "left_semi")
    total = uses.groupBy("repo", "name").agg(F.count("*").alias("n"))
    own = uses.select("repo", "path", "line_no", "name", F.lit(1).alias("own"))
    text = F.lower("line")
    excused = text.contains("export") | (text.contains("function") & text.contains(F.col("name")))
    open_ = setups.filter(~excused).join(own, ["repo", "path", "line_no", "name"], "left").join(total, ["repo", "name"], "left")
    return open_.filter(F.coalesce("n", F.lit(0)) == F.coalesce("own", F.lit(0))).drop("line", "own", "n")


LINK = r"\[[^\]]*\]\(([^)\s]+)\)"


def links(docs: DataFrame) -> DataFrame:
    """(repo, path, doc_id, target) of Markdown links, each once a document."""
    return docs.select("repo", "path", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(LINK), F.lit(1)))).alias("target"))


def broken_links(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Links to files that the repo doesn't have."""
    local = links(docs).filter(~F.col("target").rlike(r"^(https?:|mailto:|#)"))
    return local.join(files.select("repo", F.col("path").alias("target")).distinct(), ["repo", "target"], "left_anti")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\w\s-]", ""), r"\s+", "-")


def broken_anchors(docs: DataFrame) -> DataFrame:
    """`#anchor` links without a heading of that slug in the same document."""
    anchors = links(docs).filter(F.col("target").startswith("#")).select("doc_id", F.lower(F.substring("target", F.lit(2), F.length("target"))).alias("slug"))
    heads = docs.select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1))).alias("h")).select("doc_id", slug(F.col("h")).alias("slug"))
    return anchors.join(heads, ["doc_id", "slug"], "left_anti")


def file_references(docs: DataFrame) -> DataFrame:
    """(repo, doc_id, ref): targets of links without their anchor, and what stands in back quotes with a dot or a slash and without a space."""
    said = lambda rx: F.regexp_extract_all("content", F.lit(rx), F.lit(1))
    linked = F.filter(said(r"\[[^\]]+\]\(([^)]+)\)"), lambda x: ~x.rlike("^(?:http|#|mailto:)"))
    quoted = F.filter(said(r"`([^`]+)`"), lambda x: x.rlike(r"[./]") & ~x.contains(" ") & ~x.startswith("$"))
    refs = F.concat(F.transform(linked, lambda x: F.regexp_replace(x, "#(?s:.*)$", "")), quoted)
    return docs.select("repo", "doc_id", F.explode(F.array_distinct(refs)).alias("ref")).filter("ref <> ''")


def broken_file_refs(docs: DataFrame, files: DataFrame) -> DataFrame:
    """References to files and folders that the repo doesn't have; globs and `${` count as valid, and what leads out of the repo as broken."""
    refs = file_references(docs).filter(~F.col("ref").contains("*") & ~F.col("ref").contains("${"))
    path = F.when(~F.col("ref").startswith("/"), normalised(F.col("ref")))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    there = files.select("repo", F.explode(above).alias("target")).distinct()
    inside = refs.withColumn("target", path).filter("coalesce(target, '-') <> ''")
    return inside.join(there, ["repo", "target"], "left_anti").select("repo", "doc_id", F.col("ref").alias("path"))


def broken_command_refs(docs: DataFrame, scripts: DataFrame) -> DataFrame:
    """`npm run x`, and `npm x` of five common commands, that aren't scripts of the repo or built in. scripts: (repo, name)."""
    said = lambda rx: F.regexp_extract_all("content", F.lit(rx), F.lit(1))
    names = F.concat(said(r"(?i)npm\s+run\s+([a-z][\w:-]*)"), said(r"(?i)npm\s+(test|start|build|lint|install)"))
    each = docs.select("repo", "doc_id", F.explode(F.array_distinct(names)).alias("name"))
    return each.filter(~F.col("name").isin(BUILTINS)).join(scripts.select("repo", "name").distinct(), ["repo", "name"], "left_anti")


def sentences(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, sentence, words): sentences of more than 20 characters with their distinct words."""
    cut = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split("text", r"[.!?]+")).alias("sentence", "s")).filter(F.length(F.trim("s")) > 20)
    return cut.select("id", "sentence", F.array_distinct(F.filter(F.split(F.lower("s"), r"\s+"), lambda x: x != "")).alias("words"))


def text_overlap(a: DataFrame, b: DataFrame, share: float = 0.8, flag: float = 0.4) -> DataFrame:
    """Per document of a: share of its sentences of whose words more than `share` stand in some sentence of b.

    A sentence of b that covers more than `share` of n words holds at least one of any floor((1 - share) n) + 1
    of them, so only the rarest that many are joined on; the share itself is tested on the word arrays.
    """
    sa, sb = sentences(a, "a_id").withColumn("n", F.size("words")), sentences(b, "b_id")
    words_b = sb.select(F.col("id").alias("b_id"), F.col("sentence").alias("b_sentence"), F.explode("words").alias("word"))
    freq = words_b.groupBy("word").agg(F.count("*").alias("f"))
    each = sa.select("id", "sentence", "n", F.explode("words").alias("word")).join(freq, "word", "left")
    rank = F.row_number().over(Window.partitionBy("id", "sentence").orderBy(F.coalesce("f", F.lit(0)), "word"))
    rare = each.withColumn("rank", rank).filter(F.col("rank") <= F.floor((1 - share) * F.col("n") + 1e-9) + 1)
    met = rare.select("id", "sentence", "word").join(words_b, "word").select("id", "sentence", "b_id", "b_sentence").distinct()
    pairs = met.join(sa.select("id", "sentence", "words", "n"), ["id", "sentence"]).join(sb.select(F.col("id").alias("b_id"), F.col("sentence").alias("b_sentence"), F.col("words").alias("b_words")), ["b_id", "b_sentence"])
    hit = pairs.filter(F.size(F.array_intersect("words", "b_words")) > F.col("n") * share).select("id", "sentence").distinct()
    per = sa.join(hit.withColumn("hit", F.lit(1)), ["id", "sentence"], "left").groupBy("id").agg(F.count("*").alias("sentences"), F.coalesce(F.sum("hit"), F.lit(0)).alias("covered"))
    return per.withColumn("flagged", F.col("covered") / F.col("sentences") > flag)


def _blocks(c: Column) -> Column:
    """Keys such that names which contain each other, or are two edits apart, share one.

    Names of ten letters or more keep a trigram through two edits; shorter ones share what is left after two deletions at most.
    """

    def without(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.length(s))))

    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    left = F.concat(F.array(c), without(c), F.flatten(F.transform(without(c), without)))
    near = F.when(F.length(c) <= 9, F.transform(left, lambda s: F.concat(F.lit("#"), s))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(grams, near))


def feature_match(docs: DataFrame, code: DataFrame) -> DataFrame:
    """(doc_feature, code_feature) that contain each other after normalisation or are less than 3 edits apart."""
    normal = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), "s$", "")
    a = docs.select(F.col("feature").alias("doc_feature"), normal("feature").alias("x")).filter("length(x) > 2").distinct()
    b = code.select(F.col("feature").alias("code_feature"), normal("feature").alias("y")).filter("length(y) > 2").distinct()
    met = a.withColumn("k", F.explode(_blocks(F.col("x")))).join(b.withColumn("k", F.explode(_blocks(F.col("y")))), "k").drop("k").distinct()
    return met.filter(F.col("x").contains(F.col("y")) | F.col("y").contains(F.col("x")) | (F.levenshtein("x", "y") < 3)).select("doc_feature", "code_feature")


def alignment_status(docs: DataFrame, code: DataFrame) -> DataFrame:
    """Every feature as aligned, documented only or implemented only."""
    pairs = feature_match(docs, code)
    d = docs.select(F.col("feature").alias("doc_feature")).distinct().join(pairs, "doc_feature", "left")
    full = d.join(code.select("feature").distinct(), F.col("code_feature") == F.col("feature"), "full_outer")
    status = F.when(F.col("doc_feature").isNull(), "implemented_only").when(F.col("code_feature").isNull(), "documented_only").otherwise("aligned")
    return full.select("doc_feature", F.coalesce("code_feature", "feature").alias("code_feature"), status.alias("status"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def docs_mentioning(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """(repo, doc_id, path, kinds): documents that name a changed file, by its path tokens.

    Every mention is a `filename`; the whole path is also a `full-path`; `from '...'` and `require('...')` of the path
    without its suffix, or of its last parts, are also an `import` and a `require`.
    """
    lead = r"(?:(?:from\s+|require\()['\"])?"
    raw = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(lead + r"[\w./-]*\w"), F.lit(0))))
    tokens = docs.select("repo", "doc_id", raw.alias("raw")).withColumn("token", F.regexp_replace("raw", "^" + lead, "")).withColumn("name", F.regexp_replace(file_name(F.col("token")), r"\.\w+$", "")).filter("name <> ''")
    sides = changed.select("repo", "path", F.regexp_replace(file_name(F.col("path")), r"\.\w+$", "").alias("name")).distinct()
    met = tokens.join(sides, ["repo", "name"])
    module = F.concat(F.lit("/"), F.regexp_replace("path", r"\.\w+$", ""))
    target = module.endswith(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("token", r"^(\.{1,2}/)+", ""), r"\.\w+$", "")))
    kinds = F.array(
        F.lit("filename"),
        F.when(F.col("token") == F.col("path"), "full-path"),
        F.when(F.col("raw").rlike(r"^from\s+['\"]") & target, "import"),
        F.when(F.col("raw").rlike(r"^require\(['\"]") & target, "require"),
    )
    return met.select("repo", "doc_id", "path", F.explode(F.array_compact(kinds)).alias("kind")).groupBy("repo", "doc_id", "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def removed_exports_in_docs(old: DataFrame, new: DataFrame, docs: DataFrame) -> DataFrame:
    """Exports gone since the last snapshot that documents still name. old, new: (repo, name)."""
    gone = old.select("repo", "name").distinct().join(new, ["repo", "name"], "left_anti")
    words = docs.select("repo", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IDENTIFIER), F.lit(0)))).alias("name"))
    return words.join(gone, ["repo", "name"])


def undocumented_commits(commits: DataFrame, changelog: DataFrame) -> DataFrame:
    """feat, fix and breaking commits whose text no changelog entry holds and whose hash none names.

    Texts that are whole entries go first, the others are sought within entries. The changelog grows with the commits, so
    its sides are shuffled, whatever the size of the files; only begins of three letters are broadcast. An empty text is
    held by nothing. A short hash is the begin of a hash that is a text; a number is named by a whole number only.
    """
    worth = commits.filter(F.col("message").rlike(r"^(feat|fix)|^\w+!:|BREAKING"))
    text = F.regexp_extract("message", r"^\w+!?:\s*(.*)$", 1)
    entries = changelog.select("entry").distinct()
    whole = entries.select(F.col("entry").alias("text")).hint("merge")
    others = worth.withColumn("text", text).join(whole, "text", "left_anti")
    rest = others.join(_held(others.select("text"), entries).hint("merge"), "text", "left_anti").select("hash", "message")
    # a whole number after #, or seven hex digits or more from the begin of the hash
    said = lambda rx: F.regexp_extract_all("entry", F.lit(rx), F.lit(1))
    h = F.col("hash").cast("string").alias("h")
    named = changelog.select(F.explode(said(r"#(\d+)")).alias("h"))
    if isinstance(commits.schema["hash"].dataType, StringType):
        short = changelog.select(F.explode(said(r"\b([0-9a-f]{7,40})\b")).alias("said")).distinct().withColumn("key", F.substring("said", 1, 7))
        met = worth.select(h, F.substring("hash", 1, 7).alias("key")).join(short.hint("merge"), "key").filter(F.col("h").startswith(F.col("said"))).select("h")
        named = named.unionByName(met)
    return rest.withColumn("h", h).join(named.distinct().hint("merge"), "h", "left_anti").select("hash", "message")


def _held(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(text): parts of entries, among them all texts that an entry holds.

    A text of 3 * 2^k letters, or less than twice as many, has the first 3 * 2^k as its head. Where a head stands in an entry, the
    parts from there on that are as long as one of its texts are texts or not: so work grows with the entries, not with pairs.
    """
    at = lambda least: F.explode(F.sequence(F.lit(1), F.length("entry") - (least - 1)))
    brief = texts.filter("length(text) IN (1, 2)").distinct()
    pairs = entries.filter(F.length("entry") >= 1).select("entry", at(1).alias("i")).select(F.explode(F.array(F.substring("entry", F.col("i"), 1), F.substring("entry", F.col("i"), 2))).alias("text"))
    heads = texts.filter("length(text) >= 3").selectExpr("length(text) AS n", "text", "shiftleft(3, length(bin(length(text) div 3)) - 1) AS size")
    heads = heads.select("size", "n", F.expr("substring(text, 1, size)").alias("head"), F.substring("text", 1, 3).alias("begin"))
    begins = F.broadcast(heads.select("begin").distinct())
    kinds = F.broadcast(heads.select("begin", "size").distinct())
    tails = entries.filter(F.length("entry") >= 3).select("entry", at(3).alias("i")).withColumn("begin", F.expr("substring(entry, i, 3)")).join(begins, "begin", "left_semi")
    tails = tails.select("begin", F.expr("substring(entry, i)").alias("tail"))
    sizes = F.expr("transform(sequence(0, length(bin(length(tail) div 3)) - 1), k -> shiftleft(3, k))")
    tails = tails.select("begin", "tail", F.explode(sizes).alias("size")).join(kinds, ["begin", "size"], "left_semi")
    tails = tails.selectExpr("substring(tail, 1, size) AS head", "substring(tail, 1, 2 * size - 1) AS tail")
    lengths = heads.groupBy("head").agg(F.collect_set("n").alias("ns"))
    parts = tails.join(lengths.hint("merge"), "head").select("tail", F.explode("ns").alias("n")).filter("n <= length(tail)").selectExpr("substring(tail, 1, n) AS text")
    return parts.unionByName(pairs.join(F.broadcast(brief), "text", "left_semi")).distinct()


# Where a source's test may stand, in order; what stands before the source's name, and behind it.
TEST_ENDS = [".test", ".spec", ".test", ".test", ".test", ".spec", ".test", "", "", "_test"]


def test_places(folder: Column) -> list[Column]:
    within = F.concat(folder, F.lit("__tests__/"))
    return [F.lit("tests/"), F.lit("tests/"), F.lit("test/"), F.lit("__tests__/"), folder, folder, within, F.lit("tests/test_"), F.lit("test/test_"), folder]


def source_test_map(files: DataFrame) -> DataFrame:
    """(repo, path, test): the first candidate test path that exists, or null."""
    p = F.col("path")
    src = files.filter(~p.rlike(r"(^|/)tests/") & p.rlike(r"\.(js|ts|py|go|rs|java)$")).select("repo", "path")
    stem, ext, dir_ = F.regexp_extract(p, r"([^/]+)\.\w+$", 1), F.regexp_extract(p, r"(\.\w+)$", 1), F.regexp_extract(p, r"^(.*/)?[^/]+$", 1)
    names = [F.concat(a, stem, F.lit(b), ext) for a, b in zip(test_places(dir_), TEST_ENDS, strict=True)]
    cands = src.select("repo", "path", F.posexplode(F.array(*names)).alias("pos", "test"))
    met = cands.join(files.select("repo", F.col("path").alias("test")).distinct(), ["repo", "test"]).groupBy("repo", "path").agg(F.min_by("test", "pos").alias("test"))
    return src.join(met, ["repo", "path"], "left")


def changed_without_test(mapped: DataFrame, changed: DataFrame) -> DataFrame:
    """(repo, path, test): changed sources whose test exists and didn't change. changed: (repo, path)."""
    both = mapped.filter("test IS NOT NULL").join(changed.distinct(), ["repo", "path"])
    return both.join(changed.select("repo", F.col("path").alias("test")).distinct(), ["repo", "test"], "left_anti").select("repo", "path", "test")


def coverage_summary(mapped: DataFrame) -> DataFrame:
    n = F.count("*")
    has = F.count_if(F.col("test").isNotNull())
    return mapped.groupBy("repo").agg(has.alias("with_tests"), (n - has).alias("without"), F.round(100 * has / n, 2).alias("percent"))


def untested_exports(exports: DataFrame, mapped: DataFrame, files: DataFrame) -> DataFrame:
    """Exports (repo, path, name) that the paired test never names."""
    tokens = files.select("repo", F.col("path").alias("test"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IDENTIFIER), F.lit(0)))).alias("name"))
    return exports.join(mapped.filter("test IS NOT NULL"), ["repo", "path"]).join(tokens, ["repo", "test", "name"], "left_anti").select("repo", "path", "name")


# Trivial assertions, titled cases, and words of edge cases.
TRIVIAL = r"expect\s*\(\s*true\s*\)|expect\s*\(\s*1\s*\)\s*\.toBe\s*\(\s*1\s*\)|assert\s*\(\s*True\s*\)|\.toBeDefined\s*\(\s*\)"
CASES = r"(?:describe|it)\s*\(\s*['\"`][^'\"`]+['\"`]"
EDGES = r"(?i)null|undefined|empty|error|invalid|edge|boundary"


def test_quality(mapped: DataFrame, files: DataFrame) -> DataFrame:
    """Tests as good, needs-improvement or poor: trivial assertions, no titled cases, no edge words; poor if the source isn't imported."""
    pairs = mapped.filter("test IS NOT NULL").join(files.select("repo", F.col("path").alias("test"), "content"), ["repo", "test"])
    c, stem = F.col("content"), F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    said = lambda rx: F.regexp_extract_all(c, F.lit(rx), F.lit(1))
    named = F.concat(said(r"from\s+['\"]([^'\"]*)['\"]"), said(r"require\s*\(\s*['\"]([^'\"]*)['\"]"))
    imported = F.exists(named, lambda x: x.endswith(stem)) | F.exists(said(r"import\s+(.*)"), lambda x: x.contains(stem))
    flags = {"trivial": c.rlike(TRIVIAL), "no_cases": ~c.rlike(CASES), "no_edges": ~c.rlike(EDGES), "no_import": ~imported}
    any_ = reduce(lambda x, y: x | y, flags.values())
    return pairs.select("repo", "path", *[f.alias(n) for n, f in flags.items()], F.when(flags["no_import"], "poor").when(any_, "needs-improvement").otherwise("good").alias("grade"))


def exclude_claimed(tasks: DataFrame, claimed: DataFrame) -> DataFrame:
    return tasks.join(claimed, "number", "left_anti")


def task_already_done(tasks: DataFrame, files: DataFrame, keywords: int = 5) -> DataFrame:
    """Tasks as pending, partially-done (a hit is a test file) or appears-done, by title words found as words of JavaScript and TypeScript files."""
    title = F.split(F.regexp_replace(F.lower("title"), "[^a-z0-9 ]", " "), " ")
    words = F.slice(F.filter(title, lambda x: (x != "") & ~x.isin(TASK_STOP_WORDS)), 1, keywords)
    asked = tasks.select("number", F.explode(F.array_distinct(words)).alias("word"))
    code = files.filter(F.col("path").rlike(r"\.[cm]?[jt]sx?$"))
    is_test = F.col("path").rlike(r"\.test\.|\.spec\.|__tests__")
    tokens = code.select(is_test.alias("is_test"), F.explode(F.array_distinct(F.split(F.lower("content"), "[^a-z0-9]+"))).alias("word")).groupBy("word").agg(F.bool_or("is_test").alias("is_test"))
    hits = asked.join(tokens, "word").groupBy("number").agg(F.bool_or("is_test").alias("tested"))
    both = tasks.select("number").join(hits, "number", "left")
    return both.select("number", F.when(F.col("tested").isNull(), "pending").when(F.col("tested"), "partially-done").otherwise("appears-done").alias("status"))


def old_markers(findings: DataFrame, ages: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Markers whose line (repo, path, line_no, committed) is older than `days`."""
    old = findings.join(ages, ["repo", "path", "line_no"]).withColumn("age", F.datediff(F.lit(as_of), "committed"))
    return old.filter(F.col("age") > days).select("repo", "path", "line_no", "age")


def mark_exported(symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """Symbols with an exported flag, and rows for exports without a symbol."""
    flag = exports.select("repo", "path", "name").distinct().withColumn("exported", F.lit(True))
    marked = symbols.join(flag, ["repo", "path", "name"], "left").withColumn("exported", F.coalesce("exported", F.lit(False)))
    rest = flag.join(symbols, ["repo", "path", "name"], "left_anti").withColumn("kind", F.lit("export"))
    return marked.select("repo", "path", "name", "kind", "exported").unionByName(rest.select("repo", "path", "name", "kind", "exported"))


def doc_examples_of_changed(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """Imports in fenced code of documents that point at a changed file. changed: (repo, path)."""
    fences = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)```\w*\n(.*?)```"), F.lit(1)))
    imports = docs.select("repo", "doc_id", fences.alias("code")).select("repo", "doc_id", F.explode(F.regexp_extract_all("code", F.lit(r"from\s+'\./([^']+)'"), F.lit(1))).alias("stem")).distinct()
    stems = changed.select("repo", "path", F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("stem"))
    return imports.join(stems, ["repo", "stem"]).select("repo", "doc_id", "path")


def version_mismatch(docs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Documents that name a version other than the manifest's. manifests: (repo, version)."""
    named = docs.select("repo", "doc_id", F.regexp_extract("content", r"(?i)version is (\d+\.\d+\.\d+)", 1).alias("said")).filter("said <> ''")
    return named.join(manifests, "repo").filter("said <> version")
