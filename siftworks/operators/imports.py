"""Import specifiers resolved to files: the edges that circular imports are looked for on.

Every file is entered under the keys by which its language may name it, every specifier is turned into the keys it may
mean, and both meet in one equi join by repository, language family and key. No path is compared with every other.

- JavaScript and TypeScript: relative specifiers only, against the importing file's folder; the exact file, then an
  extension (in the order of ENDINGS), then an index file; `x.js` also means `x.ts`.
- Python: dotted names as ends of paths, leading dots against the own folder; a module or a package's `__init__`.
- Go: the package path as the end of a folder; every source of the package but tests.
- Java: a class as the end of a path; `name.*` is every source of that folder.
- Rust: `crate::`, `self::` and `super::` paths; the longest part of the path that is a file, a `mod.rs` or a `lib.rs`.

Where several files fit, the best key counts, then the shorter path, then the lesser one. Specifiers that fit no file are
outside and give no edge. A null source or path gives none either; repeated imports give one edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of each family, in the order in which they are tried.
ENDINGS = {"js": ["js", "jsx", "ts", "tsx", "mjs", "cjs"], "py": ["py"], "go": ["go"], "java": ["java"], "rs": ["rs"]}
_EXTENSION = r"\.([^./]+)$"


def family(path: Column) -> Column:
    """The language family of a path, by its extension; null for others."""
    ext = F.regexp_extract(path, _EXTENSION, 1)
    return reduce(lambda c, kv: c.when(ext.isin(kv[1]), kv[0]), ENDINGS.items(), F.when(F.lit(False), ""))


def normalised(path: Column) -> Column:
    """`path` without `.`, empty and `..` segments; null where it leads out of the root."""
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def ends_of(path: Column) -> Column:
    """All ends of a path that begin at a segment, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def file_keys(files: DataFrame) -> DataFrame:
    """(repo, family, key, rank, file): the names under which each file may be imported, better ones with a lower rank."""
    path = F.col("path")
    kind = family(path)
    ext = F.regexp_extract(path, _EXTENSION, 1)
    stem = F.regexp_replace(path, _EXTENSION, "")
    rows = files.select("repo", "path", kind.alias("family"), ext.alias("ext"), stem.alias("stem"), folder(path).alias("dir")).filter("family IS NOT NULL").distinct()
    entry = lambda key, rank: F.struct(key.alias("key"), rank.cast("int").alias("rank"))
    order = F.array_position(F.array(*map(F.lit, ENDINGS["js"])), F.col("ext"))
    last = F.regexp_extract("stem", r"([^/]*)$", 1)
    whole = {"js": ["index"], "py": ["__init__"], "rs": ["mod", "lib"]}
    of_folder = reduce(lambda c, kv: c | ((F.col("family") == kv[0]) & last.isin(kv[1])), whole.items(), F.lit(False))
    js = F.array(
        entry(F.col("path"), F.lit(0)),
        entry(F.col("stem"), order),
        F.when(F.col("ext").isin("ts", "tsx"), entry(F.concat("stem", F.lit(".js")), F.lit(10))),
        F.when(of_folder, entry(F.col("dir"), 20 + order)),
    )
    ranked = lambda keys, rank: F.transform(keys, lambda k: entry(k, F.lit(rank)))
    module = F.when(of_folder, ranked(ends_of(F.col("dir")), 1)).otherwise(ranked(ends_of(F.col("stem")), 0))
    package = F.when(F.col("family").isin("go", "java"), ranked(F.transform(ends_of(F.col("dir")), lambda k: F.concat(k, F.lit("/*"))), 5))
    crate = F.array(F.when(of_folder, entry(F.col("dir"), F.lit(1))).otherwise(entry(F.col("stem"), F.lit(0))))  # Rust paths are whole
    keys = F.when(F.col("family") == "js", js).when(F.col("family") == "rs", crate).when(F.col("family") == "go", package).when(F.col("family") == "java", F.concat(module, package)).otherwise(module)
    made = rows.filter(~((F.col("family") == "go") & F.col("stem").endswith("_test"))).select("repo", "family", F.col("path").alias("file"), F.explode(F.array_compact(keys)).alias("k"))
    return made.select("repo", "family", "k.key", "k.rank", "file").filter("key <> ''")


def wanted_keys(imports: DataFrame) -> DataFrame:
    """(repo, path, source, family, key, rank): the keys that each import may mean."""
    own, source = folder(F.col("path")), F.col("source")
    rows = imports.select("repo", "path", "source", family(F.col("path")).alias("family")).distinct()
    relative = normalised(F.concat(own, F.lit("/"), source))
    dots = F.length(F.regexp_extract("source", r"^(\.*)", 1))
    dotted = F.replace(F.regexp_replace("source", r"^\.+", ""), F.lit("."), F.lit("/"))
    python = F.when(dots == 0, dotted).otherwise(normalised(F.concat(own, F.repeat(F.lit("/.."), dots - 1), F.lit("/"), dotted)))
    java = F.replace(source, F.lit("."), F.lit("/"))
    # crate:: begins at the last src folder above the file, self:: at its own module and super:: at the one above
    root = F.regexp_extract("path", r"^((?:.*/)?src)/", 1)
    module = F.regexp_replace(F.regexp_replace("path", r"\.rs$", ""), r"/(?:mod|lib|main)$", "")
    start = F.when(source.startswith("crate::"), root).when(source.startswith("self::"), module).when(source.startswith("super::"), folder(module))
    steps = F.split(F.regexp_replace("source", r"^(?:crate|self|super)::", ""), "::")
    rust = F.transform(F.sequence(F.size(steps), F.lit(0)), lambda n: F.array_join(F.concat(F.array(start), F.slice(steps, F.lit(1), n)), "/"))
    keys = (
        F.when((F.col("family") == "js") & source.startswith("."), F.array(relative))
        .when(F.col("family") == "py", F.array(python))
        .when(F.col("family") == "go", F.array(F.concat(source, F.lit("/*"))))
        .when(F.col("family") == "java", F.array(java))
        .when((F.col("family") == "rs") & start.isNotNull(), rust)
    )
    return rows.select("repo", "path", "source", "family", F.posexplode(keys).alias("rank", "key")).filter("key IS NOT NULL")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, source, target): the files that imports (repo, path, source) name among files (repo, path)."""
    have, want = file_keys(files), wanted_keys(imports)
    met = want.withColumnRenamed("rank", "try").join(have, ["repo", "family", "key"])
    every = F.col("key").endswith("/*")
    best = F.min(F.when(~every, F.struct("try", "rank", F.length("file").alias("size"), "file")))
    one = met.groupBy("repo", "path", "source").agg(best.alias("b"), F.collect_set(F.when(every, F.col("file"))).alias("all"))
    target = F.when(F.col("b").isNotNull(), F.array("b.file")).otherwise(F.col("all"))
    return one.select("repo", "path", "source", F.explode(target).alias("target"))


def file_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): files that import files, named repo/path."""
    name = lambda c: F.concat("repo", F.lit("/"), c)
    return resolve_imports(imports, files).select(name("path").alias("src"), name("target").alias("dst")).filter("src <> dst").distinct()
