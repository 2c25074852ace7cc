"""Source trees as they lie in a folder: plain files, read whole by path.

Spark's own file sources leave out every name that begins with `_` (so `__init__.py` and `__tests__`), hence a data
source of its own: the driver lists folders only until there are enough parts, and each task walks and reads its
part. Extensions, excluded folders and the tests switch are tested before a file is opened. Any file system that Arrow
knows will do (local, HDFS, S3, GCS).

A file that isn't UTF-8 comes with replacement characters and `decoded` false; one that vanishes or can't be opened in
between is left out. Empty files have empty content. Paths are relative to the root, with `/`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.scan import EXCLUDED_DIRS, LANGUAGE_OF, TEST_PATH
from .io import new_folder

FILE = "path string, language string, size long, content string, decoded boolean"
#: Parts that the driver lists folders for.
PARTS = 64


def file_system(root: str):
    """An Arrow file system and the root's path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if re.match(r"^\w+:", root) else "file://" + root)


def wanted(path: str, extensions: set[str], tests: bool) -> bool:
    dot = path.rfind(".")
    return dot > path.rfind("/") and path[dot:].lower() in extensions and (tests or not re.search(TEST_PATH, path))


def read_file(files, base: str, path: str) -> tuple | None:
    """One row of FILE; None if the file can't be opened."""
    try:
        with files.open_input_stream(f"{base}/{path}") as f:
            data = f.read()
    except OSError:
        return None
    text = data.decode("utf-8", "replace")
    dot = path.rfind(".")
    return path, LANGUAGE_OF.get(path[dot:].lower(), "js") if dot > path.rfind("/") else "js", len(data), text, "�" not in text or text.encode() == data


@dataclass
class Part(InputPartition):
    """A folder, with all below it or only the files in it."""

    folder: str
    deep: bool

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.extensions = set(options.get("extensions", ",".join(LANGUAGE_OF)).split(","))
        self.excluded = set(filter(None, options.get("excluded", ",".join(EXCLUDED_DIRS)).split(",")))
        self.tests = options.get("tests", "false") == "true"

    def entries(self, files, base: str, folder: str) -> tuple[list[str], list[str]]:
        """Folders and files in a folder, without the excluded ones."""
        from pyarrow import fs

        found = files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
        names = [(f"{folder}/{x.base_name}".lstrip("/"), x.type) for x in found if x.base_name not in self.excluded]
        return sorted(n for n, t in names if t == fs.FileType.Directory), sorted(n for n, t in names if t == fs.FileType.File)

    def partitions(self) -> list[Part]:
        files, base = file_system(self.root)
        parts, deep = [], [""]
        while deep and len(parts) + len(deep) < PARTS:
            below = []
            for folder in deep:
                parts.append(Part(folder, False))
                below += self.entries(files, base, folder)[0]
            deep = below
        return parts + [Part(folder, True) for folder in deep]

    def read(self, part: Part) -> Iterator[tuple]:
        files, base = file_system(self.root)
        todo = [part.folder]
        while todo:
            folders, names = self.entries(files, base, todo.pop())
            todo += folders if part.deep else []
            for name in names:
                if wanted(name, self.extensions, self.tests) and (row := read_file(files, base, name)) is not None:
                    yield row


class TreeSource(DataSource):
    """spark.read.format("source_tree"); options path, extensions, excluded (comma-separated) and tests."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, tests: bool = False, excluded: list[str] | None = None) -> DataFrame:
    """(path, language, size, content, decoded) of the source files under `root`."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("tests", str(tests).lower())
    for name, value in (("extensions", extensions), ("excluded", excluded)):
        if value is not None:
            reader = reader.option(name, ",".join(value))
    return reader.load(root)


def read_paths(paths: DataFrame, root: str) -> DataFrame:
    """(path, language, size, content, decoded) of the files that `paths` (path) names; only they are opened."""

    def make(batches):
        import pandas as pd

        files, base = file_system(root.rstrip("/"))
        for b in batches:
            for at in range(0, len(b), 256):
                rows = [row for p in b["path"][at : at + 256] if p and (row := read_file(files, base, p)) is not None]
                yield pd.DataFrame(rows, columns=["path", "language", "size", "content", "decoded"])

    return paths.select("path").distinct().mapInPandas(make, FILE)


def write_tree(files: DataFrame, root: str | None = None) -> str:
    """Files (path, content) as plain files under `root`; tasks write them, and writing again gives the same."""
    root = root or new_folder(files.sparkSession, "tree")

    def make(batches):
        import pandas as pd

        system, base = file_system(root)
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                system.create_dir(f"{base}/{path}".rpartition("/")[0])
                with system.open_output_stream(f"{base}/{path}") as f:
                    f.write(content.encode())
            yield pd.DataFrame({"n": [len(b)]})

    files.filter("path IS NOT NULL").select("path", F.coalesce("content", F.lit("")).alias("content")).mapInPandas(make, "n long").agg(F.sum("n")).collect()
    return root
