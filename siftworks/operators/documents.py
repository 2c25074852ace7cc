"""Document and prompt work: sections, headings, wording, cleaning, measures and rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import pattern_counts, readable

# Verbose phrases and their short forms, words of emphasis, critical terms, dangling openers and transitions.
PHRASES = [("in order to", "to"), ("for the purpose of", "for"), ("in the event that", "if"), ("at this point in time", "now"), ("due to the fact that", "because"), ("has the ability to", "can"), ("is able to", "can"), ("make use of", "use"), ("a large number of", "many"), ("a small number of", "few"), ("the majority of", "most"), ("prior to", "before"), ("subsequent to", "after")]
EMPHASIS = ["CRITICAL", "IMPORTANT", "MUST", "NEVER", "ALWAYS", "REQUIRED", "MANDATORY", "ESSENTIAL", "WARNING", "CAUTION"]
CRITICAL = r"(?i)\b(?:important|critical|must|required|warning|caution|danger)\b|\b(?:error|fail|break|crash|security|vulnerability)\b"
BURIED = [r"(?i)\b(?:important|critical|must|essential|required|mandatory)\b", r"(?i)\b(?:always|never)\s+\w+", r"(?i)\b(?:warning|caution|note)\s*:"]
DANGLING = r"(?i)^(?:It|This|These|Those|They|The above|As mentioned)\s"
TRANSITION = (
    r"(?i)^(?:additionally|also|furthermore|moreover|on another note|separately|however|on the other hand|alternatively|in contrast"
    r"|next|then|finally|lastly|another (?:thing|point|topic))"
)
HEADING = r"^#{1,6}\s"


def tokens(text: Column) -> Column:
    """A rough count: a token for each four characters."""
    return F.ceil(F.length(text) / 4)


def hash16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def text_metrics(docs: DataFrame, id_col: str) -> DataFrame:
    """Characters, tokens, lines, non-empty lines, words, digest and a snippet of each text."""
    lines = F.split("text", "\n")
    return docs.select(
        id_col,
        F.length("text").cast("bigint").alias("chars"),
        tokens(F.col("text")).alias("tokens"),
        F.size(lines).cast("bigint").alias("lines"),
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("bigint").alias("full_lines"),
        F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("bigint").alias("words"),
        hash16(F.col("text")).alias("hash16"),
        truncate(F.col("text"), 60).alias("snippet"),
    )


def sections(lines: DataFrame) -> DataFrame:
    """Adds `section`: the number of headings up to the line, in its document."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("section", F.sum(F.col("line").rlike(HEADING).cast("int")).over(by))


def heading_levels(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line").rlike(HEADING)).withColumn("level", F.length(F.regexp_extract("line", r"^(#+)", 1)))


def heading_jumps(lines: DataFrame) -> DataFrame:
    """Headings more than one level below the one before."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    return heading_levels(lines).withColumn("before", F.lag("level").over(by)).filter(F.col("level") - F.col("before") > 1).select("doc_id", "line_no", "before", "level")


def section_sizes(lines: DataFrame, long: int = 1000, bare: int = 500, tiny: int = 20) -> DataFrame:
    """(doc_id, section, tokens, issue): sections of more than `long` tokens, more than `bare` below a heading or before the first one, fewer than `tiny`.

    A section's tokens count its heading without the marks; a section may have two issues.
    """
    marks = F.length(F.regexp_extract("line", r"^(#{1,6}\s+)", 1))
    head = F.col("line").rlike(HEADING)
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("line_no"))) == 1
    chars = F.length("line") + F.when(last, 0).otherwise(1)
    rows = sections(lines).withColumns({"chars": chars - F.when(head, marks).otherwise(0), "below": F.when(head, 0).otherwise(chars)})
    per = rows.groupBy("doc_id", "section").agg(F.ceil(F.sum("chars") / 4).alias("tokens"), F.ceil(F.sum("below") / 4).alias("below"))
    issues = F.array(
        F.when((F.col("section") > 0) & (F.col("tokens") > long), "long"), F.when(F.col("below") > bare, "no_headings"), F.when((F.col("section") > 0) & (F.col("tokens") < tiny), "tiny")
    )
    return per.select("doc_id", "section", "tokens", F.explode(F.array_compact(issues)).alias("issue"))


def late_critical(lines: DataFrame, share: float = 0.7, least: int = 3) -> DataFrame:
    """Documents with `least` critical lines or more after `share` of their lines."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    late = lines.withColumn("n", n).filter((F.col("line_no") > F.floor(share * F.col("n"))) & F.col("line").rlike(CRITICAL))
    return late.groupBy("doc_id").agg(F.count("*").alias("late")).filter(F.col("late") >= least)


def buried_critical(lines: DataFrame, least: int = 5, length: int = 20) -> DataFrame:
    """Texts of `length` full lines or more with `least` critical terms or more between 30 and 70 % of them."""
    full = lines.filter(F.trim("line") != "")
    placed = full.withColumns({"rn": F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")), "n": F.count("*").over(Window.partitionBy("doc_id"))})
    mid = placed.filter((F.col("n") >= length) & (F.col("rn") > F.floor(0.3 * F.col("n"))) & (F.col("rn") <= F.floor(0.7 * F.col("n"))))
    terms = reduce(lambda a, b: a + b, [F.regexp_count("line", F.lit(p)) for p in BURIED])
    return mid.groupBy("doc_id").agg(F.sum(terms).alias("buried")).filter(F.col("buried") >= least)


def context_dependent(lines: DataFrame, least: int = 2) -> DataFrame:
    """Documents with `least` sections or more whose first line below the heading opens with It, This, Those and the like."""
    full = sections(lines).filter((F.trim("line") != "") & (F.col("section") > 0))
    second = full.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("line_no"))).filter("rn = 2")
    return second.filter(F.col("line").rlike(DANGLING)).groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def mixed_topics(lines: DataFrame, least: int = 3) -> DataFrame:
    """Sections with `least` transitions or more at the begin of a line after an empty one."""
    before = F.lag("line").over(Window.partitionBy("doc_id", "section").orderBy("line_no"))
    opener = (before == "") & F.col("line").rlike(TRANSITION)
    rows = sections(lines).withColumn("opens", opener.cast("int"))
    return rows.groupBy("doc_id", "section").agg(F.coalesce(F.sum("opens"), F.lit(0)).alias("n")).filter(F.col("n") >= least)


# Bullets, whose feature ends before a dash and stands without bold marks, and plans in lines and headings.
BULLET = r"^[-*]\s+\*{0,2}(.+?)\*{0,2}(?:\s*[-–]\s*(.+))?$"
PLAN_LINE, PLAN_HEADING = r"(?i)(?:TODO|FIXME|PLAN):\s*(.+)", r"(?i)^##\s+(?:Roadmap|Future|Planned|Coming Soon)"


def bullet_features(lines: DataFrame, cap: int = 20) -> DataFrame:
    """(doc_id, feature): the first `cap` features of 6 to 79 characters of a document, each once."""
    rows = lines.filter(F.col("line").rlike(BULLET)).select("doc_id", "line_no", F.trim(F.regexp_extract("line", BULLET, 1)).alias("feature"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    sized = rows.filter((F.length("feature") > 5) & (F.length("feature") < 80))
    return sized.withColumn("place", place).filter(F.col("place") <= cap).select("doc_id", "feature").distinct()


def plans(lines: DataFrame, cap: int = 15) -> DataFrame:
    """(doc_id, plan): what stands behind TODO, FIXME and PLAN, then roadmap headings, the first `cap` of a document, of at most 100 characters."""
    said, heading = F.regexp_extract("line", PLAN_LINE, 1), F.regexp_extract("line", PLAN_HEADING, 0)
    kinds = F.array(F.when(said != "", F.struct(F.lit(1).alias("kind"), said.alias("plan"))), F.when(heading != "", F.struct(F.lit(2).alias("kind"), heading.alias("plan"))))
    found = lines.select("doc_id", "line_no", F.explode(F.array_compact(kinds)).alias("p"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("p.kind", "line_no"))
    return found.withColumn("place", place).filter(F.col("place") <= cap).select("doc_id", F.substring("p.plan", 1, 100).alias("plan"))


def outside_fences(text: Column, change) -> Column:
    """`change` applied to the text outside fenced code."""
    parts = F.split(text, "```", -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, change(x)).otherwise(x)), "```")


def condense(text: Column) -> Column:
    """Verbose phrases replaced; the case of the first letter stays; fenced code isn't touched."""

    def change(x: Column) -> Column:
        for long, short in PHRASES:
            x = F.regexp_replace(x, rf"\b{long[0].upper()}(?i:{long[1:]})\b", short[0].upper() + short[1:])
            x = F.regexp_replace(x, rf"\b{long[0]}(?i:{long[1:]})\b", short)
        return x

    return outside_fences(text, change)


def calm(text: Column) -> Column:
    """Words of emphasis lowered, runs of exclamation marks cut to one."""
    return F.regexp_replace(reduce(lambda c, w: F.regexp_replace(c, rf"\b{w}\b", w.lower()), EMPHASIS, text), "!{2,}", "!")


def fix_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): headings outside fences without jumps of level.

    The new level of the i-th heading is i plus the least of level - i so far, by a running minimum.
    """
    by = Window.partitionBy("doc_id").orderBy("line_no")
    fenced = lines.withColumn("fence", F.sum(F.col("line").startswith("```").cast("int")).over(by))
    heads = fenced.filter((F.col("fence") % 2 == 0) & F.col("line").rlike(HEADING)).withColumn("level", F.length(F.regexp_extract("line", r"^(#+)", 1)))
    heads = heads.withColumn("i", F.row_number().over(by)).withColumn("new", F.col("i") + F.min(F.col("level") - F.col("i")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = heads.select("doc_id", "line_no", F.concat(F.repeat(F.lit("#"), F.col("new").cast("int")), F.regexp_replace("line", r"^#+", "")).alias("fixed"))
    return lines.join(fixed, ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.coalesce("fixed", "line").alias("line"))


def rebuilt(lines: DataFrame, *keys: str) -> DataFrame:
    """Texts put together again from their lines."""
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))


def remove_flagged(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """Files without the lines of findings whose fix is `remove`."""
    gone = findings.filter("fix = 'remove'").select("repo", "path", "line_no").distinct()
    return rebuilt(lines.join(gone, ["repo", "path", "line_no"], "left_anti"), "repo", "path")


def normal_whitespace(line: Column) -> Column:
    """Trailing white space cut, tabs at the begin as four spaces."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(line, r"^[ \t]*", ""), r"\s+$", "")
    return F.when(rest == "", "").otherwise(F.concat(F.regexp_replace(lead, "\t", "    "), rest))


@dataclass(frozen=True)
class TextRule:
    """A rule on one text that weighs several counts.

    when: a condition in SQL. {0}, {1} ... count the patterns in the text, {f0} ... the front patterns in its front matter;
    {chars}, {words}, {jumps} (headings more than a level below the one before), {short} (sections of fewer than 20 tokens),
    {paragraphs} and {brief} (those of fewer than 20 tokens).
    """

    name: str
    category: str
    certainty: str
    patterns: tuple[str, ...]
    when: str
    front: tuple[str, ...] = ()

    def render(self, count, front: str, **measures: str) -> tuple[str, str]:
        """(condition, value) in one engine's SQL. count(text, pattern): its expression; front: that of the front matter."""
        counts = [count("text", p) for p in self.patterns]
        fields = {f"f{i}": count(front, p) for i, p in enumerate(self.front)}
        return self.when.format(*counts, **fields, **measures), counts[0] if counts else measures["chars"]


FRONT, HEADINGS, JUMP = r"(?s)^\s*---[ \t]*\n(.*?)\n---", r"(?m)^(#{1,6})\s", r"(?:^| )(?:# #{3}|## #{4}|### #{5}|#### #{6})"
_VAGUE = ("usually", "sometimes", "often", "rarely", "maybe", "might", "could", "should probably", "try to", "as much as possible", "if possible")
_COT = (r"(?i)step[- ]by[- ]step|<thinking>", r"##\s+")
_XML = r"<\w+>"
_VAGUE_TERMS = (*_VAGUE[:6], "should probably", "try to", "as much as possible", "if possible", "when appropriate", "as needed")
_PLAIN_CAPS = ("API", "JSON", "XML", "HTML", "CSS", "URL", "HTTP", "HTTPS", "SQL", "CLI", "SDK", "JWT", "UUID", "REST", "YAML", "EOF", "TODO", "FIXME", "NOTE", "README", "MCP")
_PROSE = (
    r"in this (?:document|section|guide)", r"as you (?:can see|may know|probably know)", r"it(?:'s| is) (?:important|worth noting) (?:to note |that )?", r"please note that",
    r"the following (?:section|document|guide) (?:will |provides )", r"let(?:'s| us) (?:take a look|explore|dive into)", r"we(?:'ll| will) (?:cover|discuss|explore)",
    r"this allows you to", r"you(?:'ll| will) (?:learn|discover|find)", r"as mentioned (?:earlier|above|before)",
)
_NEGATIVES = (r"\bdon['’]t\s+\w+", r"\bnever\s+\w+", r"\bdo not\s+\w+", r"\bavoid\s+\w+ing\b", r"\brefrain from\b")
_FORMATS = (
    r"##\s*output\s*format", r"##\s*response\s*format", r"##\s*format", r"\brespond\s+(?:with|in)\s+(?:JSON|XML|markdown|YAML)",
    r"\boutput\s*:\s*```", r"<output_format>", r"<response_format>", r"your\s+(?:response|output)\s+should\s+(?:be|follow)",
)
_EXAMPLES = (r"##\s*example", r"<example>", r"<good[_-]?example>", r"<bad[_-]?example>", r"\bfor example\b", r"\be\.g\.\b", r"\bsample\s+(?:input|output|response)", r"(?s:input:\s*\n.{1,500}\noutput:)")
_RULES = (r"\b(?:must|should|always|never)\s+\w+", r"\bdo not\b", r"\b(?:required|mandatory)\b")
_WHYS = (r"\bbecause\b", r"\bsince\b", r"\bthis (?:is|ensures?|prevents?|helps?)", r"\bto (?:ensure|prevent|avoid|maintain)", r"\bwhy:\s", r"\*why\*")
_STEPS = (r"\bthink\s+step[- ]by[- ]step\b", r"\bstep[- ]by[- ]step\s+(?:reasoning|thinking|approach)\b", r"\blet['’]s\s+think\s+(?:through|about)\s+this\b", r"\breason\s+through\s+each\s+step\b")


def _any_case(patterns: tuple[str, ...]) -> tuple[str, ...]:
    return tuple("(?i)" + p for p in patterns)


def _sum(first: int, n: int, most: int | None = None) -> str:
    """The counts `first` ... added up, each of at most `most`."""
    return "(" + " + ".join(f"least({{{i}}}, {most})" if most else f"{{{i}}}" for i in range(first, first + n)) + ")"


# Rules of documents, prompts, agents and instruction files on one text; 4 characters make a token.
DOC_RULES = [
    TextRule("missing_code_language", "code", "HIGH", ("```", r"```[a-zA-Z][a-zA-Z0-9_-]*"), "floor({0} / 2) > {1}"),
    TextRule("unnecessary_prose", "efficiency", "HIGH", _any_case(_PROSE), _sum(0, len(_PROSE), 2) + " >= 3"),
    TextRule("verbose_explanations", "efficiency", "HIGH", tuple(rf"(?i)\b{p}\b" for p, _ in PHRASES), _sum(0, len(PHRASES)) + " >= 3"),
    TextRule("readability_with_rag_suggestions", "balance", "LOW", (r"(?i)```|<example>|for example|e\.g\.", r"(?i)because|since|therefore|this means", r"(?s)```.*?```", r"(?im)^##?\s+(?:summary|overview|tldr|key points)"), "2 * {brief} > {paragraphs} OR ({0} > 0 AND {1} = 0) OR ({2} >= 5 AND {3} = 0)"),
    TextRule("structure_recommendations", "structure", "LOW", (r"(?m)^#{1,6}\s+", r"(?im)^##?\s+(?:table of contents|contents|toc)", r"(?m)^\s*-\s+\[.+\]\(#", r"(?m)^#{1,6}\s+.+", r"(?im)^##?\s+(?:introduction|overview|about|getting started)", r"(?m)^-\s+", r"(?m)^\*\s+"), "({chars} > 8000 AND {0} >= 5 AND {1} = 0 AND {2} = 0) OR ({chars} > 4000 AND {3} > 0 AND {4} = 0) OR ({5} > 0 AND {6} > 0)"),
    TextRule("vague_instructions", "clarity", "HIGH", tuple(rf"(?i)\b{w}\b" for w in _VAGUE_TERMS), _sum(0, len(_VAGUE_TERMS)) + " >= 4"),
    TextRule("negative_only_constraints", "clarity", "HIGH", (*_any_case(_NEGATIVES), r"(?i)\binstead\b|\brather\b"), _sum(0, len(_NEGATIVES), 2) + " >= 5 AND {5} = 0"),
    TextRule("missing_output_format", "output", "HIGH", _any_case(_FORMATS), "{chars} > 800 AND " + _sum(0, len(_FORMATS)) + " = 0"),
    TextRule("aggressive_emphasis", "clarity", "HIGH", (r"\b[A-Z]{3,}\b", r"!{2,}", r"(?i)\bCRITICAL(?:LY)?\b", r"(?i)\bMUST\s+(?:ALWAYS|NEVER)\b", r"(?i)\bABSOLUTELY\b", r"(?i)\bEXTREMELY\s+IMPORTANT\b", rf"\b(?:{'|'.join(_PLAIN_CAPS)})\b"), _sum(0, 6) + " - {6} >= 5"),
    TextRule("missing_xml_structure", "structure", "HIGH", (r"(?m)^#{1,6}\s+", "```", r"(?i)<[a-z_][a-z0-9_-]*>"), "({chars} > 3200 OR ({0} >= 6 AND {1} > 0)) AND {2} = 0"),
    TextRule("missing_examples", "examples", "HIGH", (*_any_case(_EXAMPLES), r"(?i)\bformat\b|\bjson\b|\bxml\b|\bstructured\b"), "{chars} > 1196 AND " + _sum(0, len(_EXAMPLES)) + " = 0 AND {8} > 0"),
    TextRule("missing_context_why", "context", "MEDIUM", (*_any_case(_RULES), *_any_case(_WHYS)), "{chars} > 1596 AND " + _sum(0, 3) + " >= 8 AND " + _sum(3, 6) + " < 0.3 * " + _sum(0, 3)),
    TextRule("redundant_cot", "anti-pattern", "HIGH", _any_case(_STEPS), _sum(0, len(_STEPS)) + " >= 2"),
    TextRule("prompt_bloat", "anti-pattern", "LOW", (), "{chars} > 10000"),
    TextRule("json_without_schema", "output", "MEDIUM", (r"(?i)\b(?:respond|output|return)\s+(?:with|in|as)?\s*JSON\b", r"(?i)\bJSON\s+(?:object|response|format)\b", r"(?is)\bproperties\b.{1,200}\btype\b", r"(?i)```json\s*\n\s*\{", r"(?i)<json[_-]?schema>"), "{0} + {1} > 0 AND {2} + {3} + {4} = 0"),
    TextRule("missing_role", "structure", "HIGH", (r"(?i)you are", r"(?i)##\s+(?:your\s+)?role"), "{0} + {1} = 0"),
    TextRule("agent_missing_output_format", "structure", "HIGH", (r"(?i)##\s+output\s+format", r"(?i)##\s+format", r"(?i)##\s+response"), "{0} + {1} + {2} = 0"),
    TextRule("missing_constraints", "structure", "HIGH", (r"(?i)##\s+constraints", r"(?i)##\s+(?:what\s+)?(?:you\s+)?(?:must\s+)?not\s+do", r"(?i)##\s+rules"), "{0} + {1} + {2} = 0"),
    TextRule("missing_critical_rules", "structure", "HIGH", (r"(?i)##\s+critical\s+rules", r"(?i)##\s+priority\s+rules", r"(?i)<critical-rules>", r"(?i)##\s+must[- ]know"), "{0} + {1} + {2} + {3} = 0"),
    TextRule("missing_key_commands", "structure", "HIGH", (r"(?i)##\s+(?:key\s+)?commands", r"(?i)##\s+scripts", r"(?i)##\s+usage", r"(?is)```(?:bash|sh|shell).*?(?:npm|yarn|pnpm|git|make)"), "{0} + {1} + {2} + {3} = 0"),
    TextRule("deep_nesting", "quality", "LOW", (r"(?m)^#{5}", r"(?m)^(?:\s{8,}[-*]|\t{3,}[-*])", r"(?m)^#{4}"), "{0} > 2 OR {1} > 5 OR ({2} > 5 AND {1} > 3)"),
]
# More rules of the same kind.
TEXT_RULES = [
    TextRule("inconsistent_sections", "structure", "MEDIUM", (r"(?m)^##\s+", r"(?m)^\*\*[^*]+\*\*\s*$"), "({0} >= 2 AND {1} >= 2) OR {jumps} > 0"),
    TextRule("suboptimal_example_count", "examples", "MEDIUM", (r"(?i)##\s*example|<good[_-]?example>|<bad[_-]?example>|<example>",), "{0} = 1 OR {0} > 7"),
    TextRule("examples_without_contrast", "examples", "MEDIUM", (r"(?i)<example>|##\s*example", r"(?i)<good[_-]?example>|\bgood example\b|\bcorrect\b", r"(?i)<bad[_-]?example>|\bbad example\b|\bincorrect\b|\bwrong\b"), "{0} >= 3 AND {1} = 0 AND {2} = 0"),
    TextRule("missing_instruction_priority", "context", "MEDIUM", (r"(?i)##\s*(?:constraints?|rules?|requirements?)", r"(?i)\bmust\b", r"(?i)##\s*(?:priority|priorities)|<instruction[_-]?priority>|\bin case of conflict|\bpriority\s*(?:order|:\s*\d)|\b(?:highest|lowest|first|second|third)\s+priority\b"), "{chars} > 2396 AND {2} = 0 AND ({0} >= 2 OR {1} >= 8)"),
    TextRule("overly_prescriptive", "anti-pattern", "MEDIUM", (r"(?m)^\s*\d+\.\s+\w+", r"(?i)\b(?:first|then|next|finally),?\s+(?:you\s+)?(?:must|should|need to)\b"), "{0} >= 10 OR {1} >= 6"),
    TextRule("missing_frontmatter", "structure", "HIGH", (r"^\s*---",), "{0} = 0"),
    TextRule("missing_name", "structure", "HIGH", (r"^\s*---",), "{0} > 0 AND {f0} = 0", (r"(?m)^name:[ \t]*\S",)),
    TextRule("missing_description", "structure", "HIGH", (r"^\s*---",), "{0} > 0 AND {f0} = 0", (r"(?m)^description:[ \t]*\S",)),
    TextRule("unrestricted_tools", "tool", "HIGH", (r"^\s*---",), "{0} > 0 AND {f0} = 0", (r"(?m)^tools:\s*\S",)),
    TextRule("unrestricted_bash", "tool", "HIGH", (r"^\s*---",), "{0} > 0 AND {f0} > 0", (r"(?m)^tools:(?:.*[,\[ \t])?[Bb]ash[ \t]*(?:[,\]]|$)|^\s*-[ \t]*[Bb]ash[ \t]*$",)),
    TextRule("agent_missing_xml_structure", "xml", "MEDIUM", (r"##\s+", r"(?m)^\s*[-*]\s+", "```", _XML), "({0} >= 5 OR ({1} > 0 AND {2} > 0)) AND {3} = 0"),
    TextRule("unnecessary_cot", "cot", "MEDIUM", _COT, "{0} > 0 AND {1} < 4 AND {words} < 500"),
    TextRule("missing_cot", "cot", "MEDIUM", (*_COT, r"(?i)analy[sz]e|evaluate|assess|review", r"(?i)reasoning|think\s+through"), "{words} > 1000 AND {1} >= 5 AND {2} > 0 AND {0} = 0 AND {3} = 0"),
    TextRule("example_count_suboptimal", "example", "LOW", (r"(?i)##\s+example|<good[- ]?example>|<bad[- ]?example>",), "{0} > 0 AND ({0} < 2 OR {0} > 5)"),
    TextRule("agent_vague_instructions", "anti-pattern", "MEDIUM", tuple(rf"(?i)\b{w}\b" for w in _VAGUE), " + ".join(f"least({{{i}}}, 1)" for i in range(len(_VAGUE))) + " > 3"),
    TextRule("agent_prompt_bloat", "anti-pattern", "LOW", (), "{chars} > 8000"),
    TextRule("no_xml_for_data", "cross-platform", "LOW", (r"(?s)```.+?```", r"(?m)^[-*]\s+.+$", r"(?m)^##\s+", r"(?s)<\w+>.*?</\w+>"), "({0} > 0 OR {1} > 0) AND {2} >= 4 AND {3} = 0"),
    TextRule("suboptimal_chunking", "rag", "MEDIUM", (r"(?m)^#{1,6}\s+",), "({chars} > 2000 AND {0} < floor(ceil({chars} / 4) / 500)) OR {short} > 0"),
    TextRule("missing_architecture", "structure", "HIGH", (r"(?i)##\s+architecture|##\s+(?:project\s+)?structure|##\s+overview", r"(?s)```.*?(?:├──|└──|lib/|src/).*?```"), "{0} = 0 AND {1} = 0"),
    TextRule("excessive_token_count", "efficiency", "MEDIUM", (), "{chars} > 6000"),
    TextRule("verbose_instructions", "efficiency", "MEDIUM", (r"[^\n]{200,}", r"\n"), "{0} > 3 AND {chars} - {1} > 80 * ({1} + 1)"),
    TextRule("memory_missing_why", "quality", "MEDIUM", (r"(?i)must|never|always|do not|required|important", r"(?i)\*WHY:|WHY:|because|reason:|rationale:"), "{0} > 5 AND 3 * {1} < {0}"),
    TextRule("example_overload", "efficiency", "LOW", (r"(?s)```.*?```", r"(?i)##\s+example", r"(?i)<(?:good-)?example>"), "{0} + {1} + {2} > 10"),
]


def _literal(text: str) -> str:
    """A string literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: The end of a word of ASCII letters, whatever letters stand beside it: Java's own \\b knows all letters, but its \\w doesn't.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _count(text: str, pattern: str) -> str:
    capitals = "[A-Z]" in pattern or _PLAIN_CAPS[0] in pattern  # other words don't stand beside such letters
    return f"regexp_count({text}, {_literal(pattern.replace(chr(92) + 'b', EDGE) if capitals else pattern)})"


_FRONT_MATTER = f"regexp_extract(text, {_literal(FRONT)}, 1)"
_MEASURES = {
    "chars": "length(text)",
    "words": f"size(split(text, {_literal(chr(92) + 's+')}))",
    "jumps": _count(f"array_join(regexp_extract_all(text, {_literal(HEADINGS)}, 1), ' ')", JUMP),
    "paragraphs": f"size(filter(split(text, {_literal(chr(92) + 'n' + chr(92) + 'n+')}), x -> trim(x) <> ''))",
    "brief": f"size(filter(split(text, {_literal(chr(92) + 'n' + chr(92) + 'n+')}), x -> trim(x) <> '' AND length(x) <= 76))",
    "short": f"size(filter(slice(split(text, {_literal('(?m)^#{1,6}' + chr(92) + 's+')}, -1), 2, 1000000000), x -> length(x) <= 76))",
}


def doc_rule_scan(docs: DataFrame, id_col: str, verbose: bool = False, rules: list[TextRule] = [*DOC_RULES, *TEXT_RULES]) -> DataFrame:  # noqa: B006
    """(id, rule, category, certainty, value) of the rules that fire; those of LOW certainty only if verbose.

    The rules' patterns are counted by RE2, a batch of texts and a pattern at a time; those that it can't read, by Java's engine.
    """
    picked = [r for r in rules if verbose or r.certainty != "LOW"]
    place = {p: i for i, p in enumerate(p for p in dict.fromkeys(p for r in picked for p in r.patterns) if readable(p))}
    found = lambda text, p: f"counts[{place[p]}]" if text == "text" and p in place else _count(text, p)

    def row(r: TextRule) -> Column:
        when, first = r.render(found, _FRONT_MATTER, **_MEASURES)
        return F.when(F.expr(when), F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.certainty).alias("certainty"), F.expr(first).cast("bigint").alias("value")))

    counted = docs.filter("text IS NOT NULL").select(id_col, "text", pattern_counts(F.make_valid_utf8("text"), list(place)).alias("counts"))
    return counted.select(id_col, F.explode(F.array_compact(F.array(*map(row, picked)))).alias("x")).select(id_col, "x.*")


def stall_detection(results: DataFrame, least: int = 2) -> DataFrame:
    """(key, digest, from_step, n): results that repeat `least` times or more in a row. results: (key, step, digest)."""
    by = Window.partitionBy("key").orderBy("step")
    new = (F.lag("digest").over(by) != F.col("digest")) | F.lag("digest").over(by).isNull()
    runs = results.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(by))
    return runs.groupBy("key", "run", "digest").agg(F.min("step").alias("from_step"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("run")
