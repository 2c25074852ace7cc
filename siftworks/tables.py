"""Tables: the driver's parquet tables, and code, history and document tables derived from them.

Every derivation stands twice, as a DataFrame and as DuckDB SQL from the same literals, so that oracles
run on the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ["javascript", "python", "go", "rust", "java", "typescript", "markdown"]
EXTENSIONS = {"javascript": ".js", "python": ".py", "go": ".go", "rust": ".rs", "java": ".java", "typescript": ".ts", "markdown": ".md"}

_JS = [
    "export function loadUser(id) {\n  console.log('load', id);\n  const user = lookup(id);\n  if (!user) {\n    throw new Error('missing user');\n  }\n  return user;\n  cleanup(user);\n}",
    "function pending() {\n  throw new Error('TODO: implement pending');\n}\n\nfunction stubTotal() {\n  return 0;\n}",
    "const cache = new RedisCache({ host: 'local' });\nconst pool = createPool(20);\ncache.get('a');\n// TODO: drop this after the move\nlet LIMIT = 250;",
    "try {\n  risky();\n} catch (err) {}\n\n\n\nconst apiKey = 'k9f8d7s6a5q4w3e2r1';\nconst token = 'test-token-12345';",
    "// first line of old code\n// second line of old code\n// third line of old code\n// fourth line of old code\n// fifth line of old code\nrender(page, true, false, true);",
    "/**\n * Adds two values.\n * Takes any numbers.\n * Gives their sum.\n * Never fails.\n * See docs/api.md for more.\n * Fixed in #42.\n * Last reviewed long ago.\n * Kept for callers.\n */\nexport const add = (a, b) => {\n  const x = a;\n  return x + b;\n};",
    "export class OrderService {\n  find(id) {\n    for (const o of this.orders) {\n      if (o.id === id && o.open) {\n        return o;\n      } else if (o.id === id || o.old) {\n        continue;\n      }\n    }\n    return null;\n  }\n}",
    "export { add, loadUser as load };\nmodule.exports = { add, loadUser };\n// see notes.md for the secure and robust plan\nconst blob = 'QWxhZGRpbjpvcGVuIHNlc2FtZQABCDEFGHIJKLMNOPQRSTUV0123456789';  ",
    "function mapAll(list, _unused) {\n  // walk the list\n  // keep the order\n  // return new values\n  // never change the input\n  // stop at the end\n  // this is fully robust\n  // and is production-ready\n  const out = [];\n  return out;\n}",
]
_PY = [
    "def load_user(user_id):\n    print(user_id)\n    user = lookup(user_id)\n    if user is None:\n        raise KeyError(user_id)\n    return user",
    "def pending(task):\n    raise NotImplementedError\n\ndef stub_total():\n    return 0\n\ndef nothing(): pass",
    "client = HttpClient(timeout=250)\nsession = create_session('db')\nclient.get('/a')\n# TODO: retry later\nSETTINGS = {}",
    "try:\n    risky()\nexcept ValueError: pass\n\n\n\npassword = 'hunter2hunter2'\nsecret = 'dummy-secret-value'",
    "__all__ = ['load_user', 'Order']\n\nclass Order:\n    def total(self):\n        for item in self.items:\n            if item.free and item.old:\n                continue\n            elif item.sold or item.lost:\n                break\n        return self.sum\n        self.close()",
    "# alpha section of removed code\n# bravo section of removed code\n# gamma section of removed code\n# delta section of removed code\n# sigma section of removed code\nvalue = compute(True, False, True)  # noqa",
    "def _private(a):\n    return a\n\nasync def fetch_all(urls):\n    # maybe slow\n    result = await gather(urls)\n    return result\n\ndef later(): ...",
]
_GO = [
    "func LoadUser(id int) string {\n\tfmt.Println(id)\n\tif id > 250 {\n\t\treturn \"big\"\n\t}\n\treturn \"small\"\n}",
    "func pending() {\n\tpanic(\"TODO implement pending\")\n}\n\nfunc stubTotal() int {\n\treturn 0\n}",
    "type Order struct {\n\tID int\n}\n\nconst MaxItems = 40\nclient := redis.NewClient(addr)\nclient.Ping()",
    "func walk(items []int) int {\n\tfor _, i := range items {\n\t\tif i > 3 && i < 9 {\n\t\t\treturn i\n\t\t}\n\t}\n\treturn 0\n}",
]
_RUST = [
    "pub fn load_user(id: u32) -> u32 {\n    println!(\"{}\", id);\n    if id > 300 {\n        return 1;\n    }\n    id\n}",
    "fn pending() {\n    todo!()\n}\n\nfn broken() {\n    panic!(\"TODO later\")\n}",
    "pub struct Order {\n    id: u32,\n}\n\npub const LIMIT: u32 = 64;\n#[allow(dead_code)]\nlet client = RedisClient::new();",
    "pub trait Store {\n    fn get(&self) -> u32;\n}\n\nfn pick(a: u32) -> u32 {\n    match a {\n        1 => 2,\n        _ => 3,\n    }\n}",
]
_JAVA = [
    "public class UserLoader {\n    public String loadUser(int id) {\n        if (id > 350) {\n            throw new UnsupportedOperationException(\"later\");\n        }\n        return null;\n    }\n}",
    "public interface Finder {\n    Object find(int id);\n}\n@SuppressWarnings(\"unused\")\nclass Hidden {}",
    "public enum Color {\n    RED, BLUE\n}\nHttpClient client = new HttpClient();\nclient.send();",
    "public class Totals {\n    public int total() {\n        return 0;\n    }\n}",
]
_TS = [
    "export interface Empty {}\nexport type Id = string;\nexport enum Kind { A, B }",
    "import { a } from 'lib-a'; // unused\nexport async function fetchAll(urls: string[]): Promise<void> {\n  await Promise.all(urls);\n}",
]
_MD = [
    "# Overview\n\nIt is a secure and scalable tool in order to load users.\n\n### Install\n\n```bash\nnpm run build\nnpm run launch\n```\n\n- [x] write the loader\n- [ ] write the tests for loader",
    "## Usage\n\nThis project is fully production-ready. CRITICAL: you MUST read it!!\n\n```js\nimport { helper } from './f8';\n```\n\n- supports fast lookup of users\n- keeps the order of items stable\n- [ ] add more examples",
    "## API\n\nAt this point in time the API is comprehensive. See [setup](#install) and [gone](#no-such-part).\n\n- TODO: plan the second release\n- short",
    "## Roadmap\n\nHowever, we will be battle-tested.\nTherefore the plan grows.\nMoreover it is due to the fact that users ask.\nFurthermore the list is long.\n\n### Tests\n\n- [ ] prove the store is safe\n- exports loadUser and add from src/m1/f1.js",
    "## Tests\n\nThose parts make use of a large number of fixtures. IMPORTANT: keep them small.\nIMPORTANT: never skip them.\nNEVER edit by hand. ALWAYS run them.\n\n#### Deep\n\nThe version is 1.2.3 here.",
]
SNIPPETS = {"javascript": _JS, "python": _PY, "go": _GO, "rust": _RUST, "java": _JAVA, "typescript": _TS + _JS, "markdown": _MD}
HEADERS = {
    "javascript": ("import { helper } from './f", "';"),
    "typescript": ("import { helper } from './f", "';"),
    "python": ("from app.f", " import helper"),
    "go": ('import "app/f', '"'),
    "rust": ("use crate::f", "::helper;"),
    "java": ("import app.f", ";"),
    "markdown": ("See [file](src/m1/f", ".js) and [top](#overview)."),
}
PARTS = 4
#: What stands before each line of a text in a file; `//` elsewhere.
MARKS = {"python": "# ", "markdown": ""}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A DuckDB table of literals."""

    def one(v) -> str:
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


def _per_language(lang: Column, pick) -> Column:
    out = None
    for name in LANGUAGES:
        out = F.when(lang == name, pick(name)) if out is None else out.when(lang == name, pick(name))
    return out


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, doc_id, lang, content): one source file or Markdown page for each document, with its whole text.

    The text's lines are comment lines of a source file and the body's last part of a page, after a head and snippets.
    """
    lang = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("said"))
    ext = _per_language(F.col("lang"), lambda n: F.lit(EXTENSIONS[n]))
    test = F.col("doc_id") % 11 == 0
    name = F.concat(F.lit("f"), (F.col("doc_id") + F.when(test, 7).otherwise(0)).cast("string"))
    folder = F.concat(F.when(F.col("doc_id") % 13 == 0, "node_modules/").otherwise(""), F.when(test, "tests/").otherwise(F.concat(F.lit("src/m"), (F.col("doc_id") % 5).cast("string"), F.lit("/"))))
    path = F.concat(folder, name, F.when(test, ".test").otherwise(""), ext)
    k = ((3 * F.col("doc_id") + 1) % 1000).cast("string")
    head = _per_language(F.col("lang"), lambda n: F.concat(F.lit(HEADERS[n][0]), k, F.lit(HEADERS[n][1])))

    def part(i: int) -> Column:
        return _per_language(F.col("lang"), lambda n: F.element_at(F.array(*map(F.lit, SNIPPETS[n])), ((F.col("doc_id") * 7 + i * 13) % len(SNIPPETS[n]) + 1).cast("int")))

    mark = _per_language(F.col("lang"), lambda n: F.lit(MARKS.get(n, "// ")))
    said = F.concat(mark, F.replace(F.col("said"), F.lit("\n"), F.concat(F.lit("\n"), mark)))
    return docs.select("repo", path.alias("path"), "doc_id", "lang", F.concat_ws("\n", head, *[part(i) for i in range(PARTS)], said).alias("content"))


def _case(pick) -> str:
    return "CASE lang " + " ".join(f"WHEN '{n}' THEN {pick(n)}" for n in LANGUAGES) + " END"


def _files_sql() -> str:
    parts = [_case(lambda n, i=i: f"[{', '.join(map(quoted, SNIPPETS[n]))}][(doc_id * 7 + {i * 13}) % {len(SNIPPETS[n])} + 1]") for i in range(PARTS)]
    head = _case(lambda n: f"{quoted(HEADERS[n][0])} || ((3 * doc_id + 1) % 1000) || {quoted(HEADERS[n][1])}")
    mark = _case(lambda n: quoted(MARKS.get(n, "// ")))
    said = f"{mark} || replace(said, chr(10), chr(10) || {mark})"
    ext = _case(lambda n: quoted(EXTENSIONS[n]))
    return f"""code_docs AS (SELECT doc_id, source AS repo, coalesce(text, '') AS said, {LANGUAGES}[doc_id % 7 + 1] AS lang FROM documents),
code_files AS (SELECT repo, (CASE WHEN doc_id % 13 = 0 THEN 'node_modules/' ELSE '' END) || (CASE WHEN doc_id % 11 = 0 THEN 'tests/' ELSE 'src/m' || (doc_id % 5) || '/' END)
  || 'f' || (doc_id + CASE WHEN doc_id % 11 = 0 THEN 7 ELSE 0 END) || (CASE WHEN doc_id % 11 = 0 THEN '.test' ELSE '' END) || {ext} AS path,
  doc_id, lang, concat_ws(chr(10), {head}, {', '.join(parts)}, {said}) AS content FROM code_docs)"""


def to_lines(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row a line, numbered from 1; a null text has no lines."""
    rest = [c for c in files.columns if c != text_col]
    return files.select(*rest, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos").cast("bigint") + 1).drop("pos")


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_lines(code_files(spark, sf_dir))


FILES = _files_sql()
LINES = FILES + """,
code_lines AS (SELECT repo, path, doc_id, lang, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no FROM code_files)"""


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown files."""
    return code_files(spark, sf_dir).filter("lang = 'markdown'")


PAGES = LINES + """,
md AS (SELECT * FROM code_files WHERE lang = 'markdown'), md_lines AS (SELECT * FROM code_lines WHERE lang = 'markdown')"""

#: The day on which age questions are asked.
AS_OF = "1998-12-01"
THEMES = ["login page fails", "login token expires", "search results slow", "search page layout", "export report broken", "update login docs", "crash during export", "report totals wrong"]


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues from orders: (number, repo, title, labels, state, created, updated, reactions, body)."""
    o = read(spark, sf_dir, "orders")
    title = F.element_at(F.array(*map(F.lit, THEMES)), (F.col("o_orderkey") % len(THEMES) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % len(KINDS) + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("number"),
        F.concat(F.lit("repo"), (F.col("o_custkey") % 7).cast("string")).alias("repo"),
        title.alias("title"),
        F.array(F.lower("o_orderpriority"), kind).alias("labels"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"),
        F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 300).cast("int")).alias("created"),
        F.to_date("o_orderdate").alias("updated"),
        (F.col("o_orderkey") % 9).alias("reactions"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("This blocks #"), F.col("o_custkey").cast("string"))).otherwise("plain body").alias("body"),
    )


KINDS = ["bug", "bugs", "type: feature", "enhancement", "security", "debug", "small docs", "large"]
ISSUES = f"""issues AS (SELECT o_orderkey AS number, 'repo' || (o_custkey % 7) AS repo, {THEMES}[o_orderkey % {len(THEMES)} + 1] AS title,
  [lower(o_orderpriority), {KINDS}[o_orderkey % {len(KINDS)} + 1]] AS labels, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state,
  CAST(o_orderdate AS DATE) - CAST(o_orderkey % 300 AS INTEGER) AS created, CAST(o_orderdate AS DATE) AS updated, o_orderkey % 9 AS reactions,
  CASE WHEN o_orderkey % 5 = 0 THEN 'This blocks #' || o_custkey ELSE 'plain body' END AS body FROM orders)"""


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, path, status) from lineitem: an order is a commit, a supplier a file."""
    supp = F.col("l_suppkey")
    path = F.when(supp % 10 == 0, F.concat(F.lit("tests/t"), supp.cast("string"), F.lit(".js"))).when(supp % 10 == 1, F.concat(F.lit("docs/d"), supp.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("src/s"), supp.cast("string"), F.lit(".js")))
    status = F.element_at(F.array(*map(F.lit, "AMDM")), F.pmod("l_orderkey", F.lit(4)).cast("int") + 1)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), path.alias("path"), status.alias("status")).distinct()


COMMIT_FILES = """commit_files AS (SELECT DISTINCT l_orderkey AS hash,
  CASE WHEN l_suppkey % 10 = 0 THEN 'tests/t' || l_suppkey || '.js' WHEN l_suppkey % 10 = 1 THEN 'docs/d' || l_suppkey || '.md' ELSE 'src/s' || l_suppkey || '.js' END AS path,
  ['A','M','D','M'][l_orderkey % 4 + 1] AS status FROM lineitem)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, author, ts, message) from orders."""
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("o_orderkey") % len(MESSAGES) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("hash"), F.concat(F.lit("dev"), (F.col("o_custkey") % 40).cast("string")).alias("author"), F.col("o_orderdate").alias("ts"), F.concat(message, F.lit(" "), F.col("o_orderkey").cast("string")).alias("message")
    )


MESSAGES = ["feat: add loader", "fix: close pool", "chore: bump", "docs: reword", "refactor!: drop api", "test: cover store"]
COMMITS = f"""commits AS (SELECT o_orderkey AS hash, 'dev' || (o_custkey % 40) AS author, o_orderdate AS ts,
  {MESSAGES}[o_orderkey % {len(MESSAGES)} + 1] || ' ' || o_orderkey AS message FROM orders)"""
