"""Imports, metrics and evidence of JavaScript and TypeScript: built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import metadata

SOURCE, PACKAGE, CONFIG = 1.2, 1.0, 1.5


def imports(files: DataFrame) -> DataFrame:
    """(path, imports): the last part after `` from `` of lines that begin with ``import``."""
    lines = F.transform(T.lines(F.col("content")), T.trim)
    found = F.filter(lines, lambda x: F.startswith(x, F.lit("import ")) & F.contains(x, F.lit(" from ")))
    return files.select("path", F.transform(found, lambda x: F.btrim(F.element_at(F.split(x, " from "), -1), F.lit(" '\";"))).alias("imports"))


def metrics(files: DataFrame) -> DataFrame:
    """(path, lines, imports)."""
    c = F.col("content")
    times = lambda s: F.size(F.split(c, s, -1)) - 1
    return files.select("path", T.split_lines(c).alias("lines"), (times("import ") + times(r"require\(")).alias("imports"))


def folders(files: DataFrame) -> DataFrame:
    """(dir, package_json, tsconfig, warning) of the directories with metadata files."""
    named = files.filter(T.base_name(F.col("path")).isin("package.json", "tsconfig.json"))
    checked = metadata.guarded(named)
    name, ok = T.base_name(F.col("path")), F.col("ok")
    return checked.groupBy(T.parent(F.col("path")).alias("dir")).agg(
        F.bool_or((name == "package.json") & ok).alias("package_json"),
        F.bool_or((name == "tsconfig.json") & ok).alias("tsconfig"),
        F.array_join(F.array_sort(F.collect_list(F.when(~ok, F.concat_ws(": ", "path", "warning")))), "; ").alias("warning"),
    )


def evidence(files: DataFrame, sources: DataFrame, language: str) -> DataFrame:
    """(language, signal, weight, path): each source file, and the valid metadata beside it."""
    beside = sources.select("path", T.parent(F.col("path")).alias("dir")).join(folders(files), "dir", "left")
    item = lambda signal, weight, on: F.when(on, F.struct(F.lit(signal).alias("signal"), F.lit(weight).alias("weight")))
    signals = F.array(item("source_file", SOURCE, F.lit(True)), item("package_json", PACKAGE, F.col("package_json")), item("tsconfig", CONFIG, F.col("tsconfig") & F.lit(language == "TypeScript")))
    each = beside.select("path", F.explode(F.filter(signals, lambda x: x.isNotNull())).alias("x"))
    return each.select(F.lit(language).alias("language"), "x.signal", "x.weight", "path").orderBy("path", "signal", "language", "weight")
