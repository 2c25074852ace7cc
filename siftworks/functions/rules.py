"""Line rules: fixed values of the catalog, and their form as columns and SQL.

A rule fires on a line that its pattern matches. Where the meaning needs a condition on what was matched,
`part` takes the pieces (group `group` of that pattern) and at least one must not match `reject`; so no
pattern needs look-around and both engines agree.

Java's engine backtracks: where a pattern would take quadratic time on a long line, LINEAR holds a form of it
that hits the same lines in linear time, so that lines of any length are judged. SQL has the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import may_match

# Globs of paths that rules leave out.
TEST_JS = ("*.test.*", "*.spec.*")
KEYS = (*TEST_JS, "*.example.*")
CONSOLE = (*TEST_JS, "*.config.*", "bin/**", "**/bin/**", "scripts/**", "**/scripts/**", "cli.js", "**/cli.js", "**/cli/**", "**/e2e/**", "**/test/**", "**/tests/**", "**/seed*.{js,ts}", "**/fixtures/**", "**/mocks/**", "globalSetup.*", "globalTeardown.*", "**/*-manager.{js,ts}", "**/*Manager.{js,ts}")
NUMBERS = (
    *TEST_JS, "**/test/**", "**/tests/**", "**/e2e/**", "**/__tests__/**",
    "*.json", "*.yaml", "*.yml", "*.toml", "*.lock", "*.config.*", "**/config/**", "**/.env*", "**/package.json", "**/tsconfig.json",
    "*.css", "*.scss", "*.sass", "*.less", "*.styl", "**/*style*", "**/*Style*", "**/*styles*", "**/*Styles*", "**/*theme*", "**/*Theme*", "**/*colors*", "**/*Colors*", "**/*design*", "**/*spacing*", "**/*layout*",
    "**/*constants*", "**/*Constants*", "**/*const.{js,ts}", "**/*enums*", "**/*Enums*", "**/constants/**",
    "**/migrations/**", "**/prisma/**", "**/db/**", "**/*migration*", "**/*seed*", "**/*fixture*",
    "**/fixtures/**", "**/mocks/**", "**/*mock*", "**/*Mock*",
    "*.html", "*.ejs", "*.pug", "*.hbs", "dist/**", "build/**", ".next/**", "out/**",
)
TEST_PY = ("test_*.py", "*_test.py", "conftest.py")
#: Predicates of rules that no pattern can state, by name: each takes a pandas Series of lines and gives one of booleans.
PREDICATES: dict[str, Callable] = {}


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    severity: str = "low"
    fix: str = "flag"
    language: str | None = None
    exclude: tuple[str, ...] = ()
    part: str | None = None
    group: int = 0
    reject: str | None = None
    predicate: str | None = None

    def fires(self, line: Column, lower: Column | None = None) -> Column:
        """Whether the rule fires on a line; with its lower case at hand, lines without what the pattern needs are told first."""
        if self.predicate:
            return F.coalesce(F.pandas_udf(PREDICATES[self.predicate], "boolean")(line), F.lit(False))
        hit = line.rlike(LINEAR.get(self.pattern, self.pattern))
        if lower is not None and (first := may_match(self.pattern, line, lower)) is not None:
            hit = first & hit
        if self.part:
            hit = hit & F.exists(F.regexp_extract_all(line, F.lit(self.part), F.lit(self.group)), lambda x: ~x.rlike(self.reject))
        return hit

    def sql(self, line: str = "line") -> str:
        q = lambda s: "'" + s.replace("'", "''") + "'"
        hit = f"regexp_matches({line}, {q(self.pattern)})"
        if self.part:
            hit += f" AND len(list_filter(regexp_extract_all({line}, {q(self.part)}, {self.group}), lambda x: NOT regexp_matches(x, {q(self.reject)}))) > 0"
        return f"({hit})"


_SECRET = r"(?i)(password|secret|api[_-]?key|token|credential|auth)[_-]?(key|token|secret|pass)?\s*[:=]\s*[\"'`]([^\"'`\s]{8,})[\"'`]"
# Names, patterns, severities and fixes of the line rules.
RULES = [
    Rule("console_debugging", r"console\.(log|debug|info|warn)\(", "medium", "remove", "javascript", CONSOLE),
    Rule("python_debugging", r"(print\(|import pdb|breakpoint\(\)|import ipdb)", "medium", "remove", "python", TEST_PY),
    Rule("rust_debugging", r"(println!|dbg!|eprintln!)\(", "medium", "remove", "rust", ("*_test.rs", "*_tests.rs")),
    Rule("old_todos", r"(TODO|FIXME|HACK|XXX):"),
    Rule("placeholder_text", r"(?i)(?://|/\*|#|[\"'`]).*?\b(lorem ipsum|test test test|asdf asdf|foo bar baz|replace (?:this|me)|todo:?\s+implement|this is a placeholder)", "high", exclude=(*TEST_JS, "README.*", "*.md", "**/fixtures/**", "**/mocks/**")),
    Rule("placeholder_not_implemented_js", r"(?i)throw\s+new\s+Error\s*\(\s*['\"`].*(?:TODO|implement|not\s+impl)", "high", language="javascript", exclude=TEST_JS),
    Rule("placeholder_empty_function_js", r"(?:function\s+\w+\s*\([^)]*\)|=>\s*)\s*\{\s*\}", "high", language="javascript", exclude=(*TEST_JS, "*.d.ts")),
    Rule("placeholder_todo_rust", r"\b(?:todo|unimplemented)!\s*\(", "high", language="rust", exclude=("*_test.rs", "*_tests.rs", "**/tests/**")),
    Rule("placeholder_panic_todo_rust", r"(?i)\bpanic!\s*\(\s*[\"'].*(?:TODO|implement)", "high", language="rust", exclude=("*_test.rs", "*_tests.rs", "**/tests/**")),
    Rule("placeholder_not_implemented_py", r"raise\s+NotImplementedError", "high", language="python", exclude=(*TEST_PY, "**/tests/**")),
    Rule("placeholder_pass_only_py", r"def\s+\w+\s*\([^)]*\)\s*:\s*pass\s*$", "high", language="python", exclude=TEST_PY),
    Rule("placeholder_ellipsis_py", r"def\s+\w+\s*\([^)]*\)\s*:\s*\.\.\.\s*$", "high", language="python", exclude=("*.pyi", "test_*.py", "*_test.py")),
    Rule("placeholder_panic_go", r"(?i)panic\s*\(\s*[\"'].*(?:TODO|implement|not\s+impl)", "high", language="go", exclude=("*_test.go", "**/testdata/**")),
    Rule("placeholder_unsupported_java", r"throw\s+new\s+UnsupportedOperationException\s*\(", "high", language="java", exclude=("*Test.java", "**/test/**")),
    Rule("empty_catch_js", r"catch\s*\([^)]*\)\s*\{\s*\}", "high", "add_logging", "javascript"),
    Rule("empty_except_py", r"except\s*[^:]*:\s*pass\s*$", "high", "add_logging", "python"),
    Rule("magic_numbers", r"[2-9][0-9]{1,2}", part=r"[#$\w]+", reject=r"^(?:[^2-9].*|.|[2-9][0-9]{3,}.*|[2-9][0-9]{1,2}[a-zA-Z_].*|[2-9][a-zA-Z_#$].*|(?:200|201|204|400|401|403|404|500|502|503)(?:[#$].*)?)$", exclude=NUMBERS),
    Rule("disabled_linter", r"(eslint-disable|pylint: disable|#\s*noqa|@SuppressWarnings|#\[allow\()", exclude=(*TEST_JS, "**/tests/**", "**/test/**")),
    Rule("unused_imports_hint", r"^import .* from .* // unused$", fix="remove"),
    Rule("mixed_indentation", r"^\t+ +|^ +\t+", fix="replace", exclude=("Makefile", "*.mk")),
    Rule("trailing_whitespace", r"\s+$", fix="remove", exclude=("*.md",)),
    Rule("hardcoded_secrets", _SECRET, "critical", exclude=(*TEST_JS, "*.example.*", "*.sample.*", "README.*", "*.md", "**/*fixture*.{js,ts}", "**/*mock*.{js,ts}"), part=_SECRET, group=3, reject=r"^(?:\$\{|\{\{|<[A-Z_]|[x*#]{8}|[X*#]{8}|(?i:test|mock|dummy))"),
    Rule("jwt_tokens", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "critical", exclude=KEYS),
    Rule("openai_api_key", r"sk-[a-zA-Z0-9]{32,}", "critical", exclude=KEYS),
    Rule("github_token", r"(ghp_[a-zA-Z0-9]{36}|gho_[a-zA-Z0-9]{36}|ghu_[a-zA-Z0-9]{36}|ghs_[a-zA-Z0-9]{36}|ghr_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59})", "critical", exclude=KEYS),
    Rule("aws_credentials", r"(?i)(AKIA[0-9A-Z]{16}|aws_secret_access_key\s*[:=]\s*[\"'`][A-Za-z0-9/+=]{40}[\"'`])", "critical", exclude=KEYS),
    Rule("google_api_key", r"(AIza[0-9A-Za-z_-]{35}|[0-9]+-[a-z0-9_]{32}\.apps\.googleusercontent\.com)", "critical", exclude=KEYS),
    Rule("stripe_api_key", r"(sk_live_[a-zA-Z0-9]{24,}|sk_test_[a-zA-Z0-9]{24,}|rk_live_[a-zA-Z0-9]{24,}|rk_test_[a-zA-Z0-9]{24,})", "critical", exclude=KEYS),
    Rule("slack_token", r"(xoxb-[0-9]{10,}-[0-9]{10,}-[a-zA-Z0-9]{24}|xoxp-[0-9]{10,}-[0-9]{10,}-[a-zA-Z0-9]{24}|xoxa-[0-9]{10,}-[a-zA-Z0-9]{24}|https://hooks\.slack\.com/services/T[A-Z0-9]{8}/B[A-Z0-9]{8,}/[a-zA-Z0-9]{24})", "critical", exclude=KEYS),
    Rule("discord_token", r"(?i)(discord.*[\"'`][A-Za-z0-9_-]{24}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27}[\"'`]|https://discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+)", "critical", exclude=KEYS),
    Rule("sendgrid_api_key", r"SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43}", "critical", exclude=KEYS),
    Rule("twilio_credentials", r"(AC[a-f0-9]{32}|SK[a-f0-9]{32})", "critical", exclude=KEYS),
    Rule("npm_token", r"npm_[a-zA-Z0-9]{36}", "critical", exclude=KEYS),
    Rule("private_key", r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----", "critical", exclude=(*KEYS, "*.pem.example")),
    Rule("high_entropy_string", r"[\"'`][A-Za-z0-9+/=_-]{40,}[\"'`]", "medium", exclude=(*KEYS, "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml")),
    Rule("process_exit", r"process\.exit\(", "high", language="javascript", exclude=("*.test.*", "cli.js", "index.js", "bin/**", "**/bin/**", "scripts/**", "**/scripts/**", "prisma/**", "**/prisma/**", "**/seed*.{js,ts}", "**/migration*.{js,ts}", "**/backfill*.{js,ts}", "**/cli/**", "**/*.cli.{js,ts}")),
    Rule("bare_urls", r"https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", exclude=("*.test.*", "*.md", "package.json", "README.*")),
    Rule("issue_pr_references", r"(?i)//.*(?:#\d+|issue\s+#?\d+|PR\s+#?\d+|pull\s+request\s+#?\d+|fixed\s+in\s+#?\d+|closes?\s+#?\d+|resolves?\s+#?\d+|iteration\s+\d+)", "medium", "remove", exclude=("*.md", "README.*", "CHANGELOG.*", "CONTRIBUTING.*")),
    Rule("file_path_references", r"(?i)//.*(?:see|refer\s+to|in|per|documented\s+in)\s+([a-zA-Z0-9_\-./]+\.(?:md|js|ts|json|yaml|yml|toml|txt))", exclude=("*.md", "README.*", *TEST_JS)),
    Rule("verbosity_preambles", r"(?i)//\s*(?:certainly|i'd\s+be\s+happy|great\s+question|absolutely|of\s+course|happy\s+to\s+help|let\s+me\s+help|i\s+can\s+help)", exclude=(*TEST_JS, "*.md")),
    Rule("verbosity_buzzwords", r"(?i)\b(?:synergize|operationalize|paradigm\s+shift|best-in-class|world-class|cutting-edge|game-changing|holistic|revolutionary|transformative|seamless|next-generation|bleeding-edge|industry-leading)\b", exclude=(*TEST_JS, "*.md", "CHANGELOG.*", "README.*")),
    Rule("verbosity_hedging", r"(?i)//.*\b(?:it'?s?\s+worth\s+noting|generally\s+speaking|more\s+or\s+less|arguably|perhaps|possibly|might\s+be|should\s+work|i\s+think|i\s+believe|probably|maybe)\b", exclude=TEST_JS),
    Rule("boolean_blindness", r"(?i)\w+\s*\([^)]*(?:true|false)\s*,\s*(?:true|false)\s*,\s*(?:true|false)[^)]*\)", "medium", exclude=(*TEST_JS, "**/tests/**", "**/test/**")),
    Rule("mutable_globals_js", r"^(?:let|var)\s+[A-Z][A-Z0-9_]*\s*=", "high", language="javascript", exclude=(*TEST_JS, "*.config.*", "**/tests/**", "constants.js", "constants.ts")),
    Rule("mutable_globals_py", r"^[A-Z][A-Z0-9_]*\s*=\s*(?:\[|\{|dict\(|list\(|set\()", "high", language="python", exclude=(*TEST_PY, "**/tests/**", "constants.py", "settings.py")),
    Rule("speculative_generality_unused_params", r"function\s+\w+\s*\([^)]*_\w+[^)]*\)", language="javascript", exclude=(*TEST_JS, "*.d.ts", "**/tests/**")),
    Rule("speculative_generality_empty_interface", r"interface\s+\w+\s*(?:<[^>]*>)?\s*\{\s*\}", language="javascript", exclude=(*TEST_JS, "**/tests/**")),
]
SECRETS = {r.name for r in RULES if r.severity == "critical"} | {"high_entropy_string"}
#: Rules that fire on runs of lines.
COMMENTED_CODE = Rule("commented_code", r"^\s*(//|#)\s*\w{5,}", "medium", "remove")
_SHELL, _WHERE = r"(?:exec|spawn|system|shell|`|Bash)\s*[(`]", "(?:path|file|dir)"
_TOLD = r"(?i)(?:api[_-]?key|secret|token|password|credential)\s*[:=]\s*[\"'`]([^\"'`\s]{8,})[\"'`]"
SECURITY = [
    Rule("command_injection", _SHELL + r".*\$\{", "high"),
    Rule("path_traversal", _WHERE + r".*\$.*\.\./|\.\./.*\$", "high"),
    Rule("inline_secret", _TOLD, "high", part=_TOLD, group=1, reject=r"^(?:\$\{|\{\{)"),
    Rule("unsafe_eval", r"\b(?:eval|Function)\s*\(", "high"),
]


def register_predicate(name: str, test: Callable) -> None:
    """Makes `test` known to rules under `name`: the open end of rule tables."""
    PREDICATES[name] = test


def _then(head: str, tail: str) -> str:
    r"""`head.*tail`, tried from the first head after each line terminator only; heads that span a \r are tried by themselves."""
    parts = re.split(r"(\\s[*+])", head)
    over = [rf"{''.join([*parts[:i], r'[^\S\r]*+\r\s*+', *parts[i + 1 :]])}.*{tail}" for i in range(1, len(parts), 2)]
    return "|".join([rf"(?m:^)(?>.*?{head}).*{tail}", *over])


def _within(stop: str, head: str, tail: str) -> str:
    """`head` and then `tail`, tried from the first head of each stretch without the character `stop` only; heads hold no `stop`."""
    return rf"(?<![^{stop}])(?>[^{stop}]*?{head}){tail}"


_BOOL = "(?:true|false)"
_BOOLS = rf"{_BOOL}\s*,\s*{_BOOL}\s*,\s*{_BOOL}"
#: Equal forms without backtracking, by rule.
_LINEAR = {
    "placeholder_text": "(?i)" + _then("(?://|/\\*|#|[\"'`])", r"\b(?:lorem ipsum|test test test|asdf asdf|foo bar baz|replace (?:this|me)|todo:?\s+implement|this is a placeholder)"),
    "placeholder_not_implemented_js": "(?i)" + _then(r"throw\s+new\s+Error\s*\(\s*['\"`]", r"(?:TODO|implement|not\s+impl)"),
    "placeholder_empty_function_js": _within(")", r"function\s+\w+\s*\(", r"[^)]*+\)\s*\{\s*\}") + r"|=>\s*\{\s*\}",
    "placeholder_panic_todo_rust": "(?i)" + _then(r"\bpanic!\s*\(\s*[\"']", "(?:TODO|implement)"),
    "placeholder_pass_only_py": _within(")", r"def\s+\w+\s*\(", r"[^)]*+\)\s*:\s*pass\s*$"),
    "placeholder_ellipsis_py": _within(")", r"def\s+\w+\s*\(", r"[^)]*+\)\s*:\s*\.\.\.\s*$"),
    "placeholder_panic_go": "(?i)" + _then(r"panic\s*\(\s*[\"']", r"(?:TODO|implement|not\s+impl)"),
    "empty_catch_js": _within(")", r"catch\s*\(", r"[^)]*+\)\s*\{\s*\}"),
    "empty_except_py": _within(":", "except", r"[^:]*+:\s*pass\s*$"),
    "unused_imports_hint": r"^import (?>.*? from ).* // unused$",
    "trailing_whitespace": r"\s$",
    "jwt_tokens": r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}|(?<![0-9])[0-9]++-[a-z0-9_]{32}\.apps\.googleusercontent\.com",
    "discord_token": "(?i)(?:" + _then("discord", r"[\"'`][A-Za-z0-9_-]{24}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27}[\"'`]") + r"|https://discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+)",
    "issue_pr_references": "(?i)" + _then("//", r"(?:#\d+|issue\s+#?\d+|PR\s+#?\d+|pull\s+request\s+#?\d+|fixed\s+in\s+#?\d+|closes?\s+#?\d+|resolves?\s+#?\d+|iteration\s+\d+)"),
    "file_path_references": "(?i)" + _then("//", r"(?:see|refer\s+to|in|per|documented\s+in)\s+[a-zA-Z0-9_\-./]+\.(?:md|js|ts|json|yaml|yml|toml|txt)"),
    "verbosity_hedging": "(?i)" + _then("//", r"\b(?:it'?s?\s+worth\s+noting|generally\s+speaking|more\s+or\s+less|arguably|perhaps|possibly|might\s+be|should\s+work|i\s+think|i\s+believe|probably|maybe)\b"),
    "boolean_blindness": "(?i)" + _within(")", r"\w\s*\(", rf"(?>[^)]*?{_BOOLS})[^)]*+\)"),
    "speculative_generality_unused_params": _within(")", r"function\s+\w+\s*\(", r"(?>[^)]*?_\w)[^)]*+\)"),
    "speculative_generality_empty_interface": r"interface\s+\w+\s*\{\s*\}|" + _within(">", r"interface\s+\w+\s*<", r"[^>]*+>\s*\{\s*\}"),
    "command_injection": _then(_SHELL, r"\$\{"),
    "path_traversal": rf"(?m:^)(?>.*?{_WHERE})(?>.*?\$).*\.\./|(?m:^)(?>.*?\.\./).*\$",
}
LINEAR = {r.pattern: _LINEAR[r.name] for r in [*RULES, *SECURITY] if r.name in _LINEAR}
SEVERITIES, CERTAINTIES = ["critical", "high", "medium", "low"], ["HIGH", "MEDIUM", "LOW"]
FIXES = ["remove", "replace", "add_logging", "flag", "none"]
MAX_WILDCARDS = 10


def glob_regex(glob: str) -> str:
    """Anchored regex: `*` and `**` mean any text, `{a,b}` either; too many wildcards match the empty path only."""
    if glob.count("*") > MAX_WILDCARDS:
        return "^$"
    out, braces = "", 0
    for c in glob.replace("**", "*"):
        if c == "*":
            out += ".*"
        elif c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += "\\" + c if c in ".+?^$()[]|\\{}" else c
    return f"^{out}$"


def excluded_regex(rule: Rule) -> str | None:
    """Matches paths, or their last names, that the rule leaves out."""
    if not rule.exclude:
        return None
    return "|".join(f"^(?:.*/)?{glob_regex(g)[1:-1]}$" for g in rule.exclude)
