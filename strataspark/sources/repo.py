"""Scanning a source tree into a table.

Spark's own file sources leave out names that begin with ``_`` or ``.``, ``__init__.py`` among them, so the tree is listed
by a Python data source: the driver lists names, tasks read contents.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import IGNORED_DIRS

SCHEMA = "path string, abs_path string, size bigint, is_symlink boolean, content string"


def normalised_root(path: str) -> str:
    """The real path of a directory; blank or missing ones are errors."""
    if not path or not path.strip():
        raise ValueError("a repository path is needed")
    root = os.path.realpath(path)
    if not os.path.isdir(root):
        raise NotADirectoryError(path)
    return root


def within(root: str, candidate: str) -> str | None:
    """The candidate's real path if it lies in ``root``."""
    real, base = os.path.realpath(os.path.join(root, candidate)), os.path.realpath(root)
    return real if real == base or real.startswith(base.rstrip(os.sep) + os.sep) else None


def listing(root: str, ignored: tuple[str, ...] = (), hidden_files: bool = False) -> Iterator[tuple[str, int, bool]]:
    """(relative path, size, symlink) in lexical order. Hidden and ignored directories aren't entered, the root always is."""
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith(".") and f not in ignored and not os.path.islink(os.path.join(folder, f)))
        for name in sorted(files):
            if name.startswith(".") and not hidden_files:
                continue
            full = os.path.join(folder, name)
            link = os.path.islink(full)
            yield os.path.relpath(full, root).replace(os.sep, "/"), 0 if link else os.path.getsize(full), link


class Slice(InputPartition):
    def __init__(self, rows: list[tuple[str, int, bool]]):
        self.rows = rows


class RepoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = normalised_root(options.get("path", ""))
        self.extensions = tuple(x for x in options.get("extensions", "").split(",") if x)
        self.ignored = tuple(x for x in options.get("ignored", "").split(",") if x)
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.slice_bytes = int(options.get("slicebytes", 8 << 20))

    def partitions(self) -> list[InputPartition]:
        """Slices of about equal bytes; names outside the wanted extensions are dropped before anything is read."""
        out, rows, size = [], [], 0
        for row in listing(self.root, self.ignored, self.hidden):
            if self.extensions and not row[0].endswith(self.extensions):
                continue
            rows.append(row)
            size += row[1] + 1024
            if size >= self.slice_bytes:
                out.append(Slice(rows))
                rows, size = [], 0
        return [*out, Slice(rows)] if rows or not out else out

    def read(self, partition: Slice):
        for path, size, link in partition.rows:
            full, content = os.path.join(self.root, path), None
            if not link and within(self.root, path) is not None:
                try:
                    with open(full, encoding="utf-8", errors="replace", newline="") as f:
                        content = f.read()
                except OSError:  # a file that can't be read has no content
                    content = None
            yield path, full, size, link, content


class RepoSource(DataSource):
    """``spark.read.format("repo").load(root)``; options extensions, ignored, hidden, sliceBytes. Files are read whole."""

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RepoReader({k.lower(): v for k, v in dict(self.options).items()})


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), hidden: bool = False, ignored: tuple[str, ...] = ()) -> DataFrame:
    """files(path, abs_path, size, is_symlink, content) of a tree. Directories with a leading dot aren't entered; each adapter,
    and the detector (``detectable``), leaves out others of its own."""
    spark.dataSource.register(RepoSource)
    reader = spark.read.format("repo").option("extensions", ",".join(extensions)).option("ignored", ",".join(ignored)).option("hidden", str(hidden).lower())
    return reader.load(normalised_root(root))


def detectable(files: DataFrame) -> DataFrame:
    """What tells a repository's language: no links, no hidden files, nothing below ignored directories."""
    return files.filter(~F.col("is_symlink") & ~_base().startswith(".") & _outside(IGNORED_DIRS))


def _base():
    return F.element_at(F.split("path", "/"), -1)


def _outside(names: tuple[str, ...]):
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    return ~F.exists(folders, lambda s: s.isin(*names) | s.startswith("."))


def go_files(files: DataFrame, tests: bool = False) -> DataFrame:
    found = files.filter(F.col("path").endswith(".go") & ~_base().startswith("."))
    return found if tests else found.filter(~F.col("path").endswith("_test.go"))


def python_files(files: DataFrame) -> DataFrame:
    base = _base()
    return files.filter(F.col("path").endswith(".py") & ~base.startswith(".") & ~base.endswith("_test.py") & ~base.startswith("test_") & _outside(("__pycache__",)))


def script_files(files: DataFrame, language: str) -> DataFrame:
    """JavaScript or TypeScript."""
    pattern = r"(?i)\.jsx?$" if language == "JavaScript" else r"(?i)\.tsx?$"
    return files.filter(F.col("path").rlike(pattern) & ~F.col("is_symlink") & _outside(("node_modules", "dist", "build")))


def counts(files: DataFrame) -> DataFrame:
    """(files, go_files, go_lines) of a tree without docs."""
    go = F.col("path").endswith(".go")
    return files.filter(_outside(("docs",))).agg(F.count("*").alias("files"), F.count_if(go).alias("go_files"), F.coalesce(F.sum(F.when(go, F.size(F.split("content", "\n", -1)))), F.lit(0)).alias("go_lines"))


def progress_total(files: DataFrame) -> DataFrame:
    """(total): Go files, 1 at least."""
    return files.agg(F.greatest(F.lit(1), F.count_if(F.col("path").endswith(".go"))).alias("total"))
