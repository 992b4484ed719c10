"""Imports, metrics and evidence of Python sources: built-in expressions but for relative imports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_BYTES, MAX_LINE, MAX_EVIDENCE_FILES = 2 << 20, 64 << 10, 5000
ABSOLUTE, RELATIVE = 0.40, 2.10


def imports(files: DataFrame) -> DataFrame:
    """(path, package, imports): first parts of ``import x`` and ``from x import``; files over 2 MiB or with a line of 64 KiB are left out."""
    lines = T.lines(F.col("content"))
    fit = files.filter((F.octet_length("content") <= MAX_BYTES) & ~F.exists(lines, lambda x: F.octet_length(x) >= MAX_LINE))
    name = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^[\t\n\f\r ]*import[\t\n\f\r ]+([0-9A-Za-z_.]+)", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"^[\t\n\f\r ]*from[\t\n\f\r ]+([0-9A-Za-z_.]+)[\t\n\f\r ]+import", 1), F.lit("")))
    found = F.filter(F.transform(lines, name), lambda x: x.isNotNull())
    return fit.select("path", F.regexp_replace(T.base_name(F.col("path")), r"\.py$", "").alias("package"), F.transform(found, lambda x: F.split_part(x, F.lit("."), F.lit(1))).alias("imports"))


def metrics(files: DataFrame) -> DataFrame:
    """(path, lines, imports, functions) of files up to 2 MiB."""
    lines = F.transform(T.lines(F.col("content")), T.trim)
    starts = lambda *words: F.size(F.filter(lines, lambda x: F.array_contains(F.array(*[F.startswith(x, F.lit(w)) for w in words]), True)))
    return files.filter(F.octet_length("content") <= MAX_BYTES).select("path", T.split_lines(F.col("content")).alias("lines"), starts("import ", "from ").alias("imports"), starts("def ").alias("functions"))


def _params(inner: Column) -> Column:
    t = T.trim(inner)
    return F.when(t.isin("", "self", "cls"), 0).otherwise(F.size(F.split(t, ",")))


def functions(files: DataFrame) -> DataFrame:
    """(path, line, name, params) of lines that begin with ``def``."""
    each = files.select("path", F.posexplode(T.lines(F.col("content"))).alias("n", "text")).withColumn("t", T.trim(F.col("text"))).filter(F.startswith("t", F.lit("def ")))
    return each.select("path", (F.col("n") + 1).alias("line"), T.trim(F.split_part(F.substr("t", F.lit(5)), F.lit("("), F.lit(1))).alias("name"), _params(F.regexp_extract("t", r"\(([^)]*)", 1)).alias("params"))


def classes(files: DataFrame) -> DataFrame:
    """(path, line, name, exported)."""
    each = files.select("path", F.posexplode(T.lines(F.col("content"))).alias("n", "text")).withColumn("t", T.trim(F.col("text"))).filter(F.startswith("t", F.lit("class ")))
    name = T.trim(F.split_part(F.split_part(F.substr("t", F.lit(7)), F.lit(":"), F.lit(1)), F.lit("("), F.lit(1)))
    return each.select("path", (F.col("n") + 1).alias("line"), name.alias("name"), name.rlike("^[A-Z]").alias("exported"))


def import_evidence(files: DataFrame) -> DataFrame:
    """(path, module, relative, level): every name of ``import a, b as c``, and the module of ``from m import``."""
    lines = files.select("path", F.explode(T.lines(F.col("content"))).alias("text")).select("path", T.trim(F.col("text")).alias("t")).filter(~F.startswith("t", F.lit("#")))
    plain = lines.filter(F.startswith("t", F.lit("import "))).select("path", F.explode(F.split(F.substr("t", F.lit(8)), ",")).alias("part"))
    plain = plain.select("path", F.regexp_replace(T.trim(F.col("part")), r"(?U)\s.*$", "").alias("module"), F.lit(False).alias("relative"), F.lit(0).alias("level")).filter("module <> ''")
    named = lines.filter(F.startswith("t", F.lit("from ")) & F.contains("t", F.lit(" import "))).select("path", T.trim(F.split_part(F.substr("t", F.lit(6)), F.lit(" import "), F.lit(1))).alias("m"))
    dots = F.length(F.regexp_extract("m", r"^(\.*)", 1))
    return plain.unionByName(named.select("path", F.regexp_replace("m", r"^\.+", "").alias("module"), (dots > 0).alias("relative"), dots.alias("level")))


def module_roots(files: DataFrame) -> DataFrame:
    """(dir, root): the topmost directory of the unbroken chain of packages (with ``__init__.py``) that ``dir`` is in."""
    packages = files.filter(T.base_name(F.col("path")) == "__init__.py").select(T.parent(F.col("path")).alias("p")).distinct()
    dirs = files.select(T.parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).select("dir", "n", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("n")), "/").alias("p"))
    marked = up.join(packages.withColumn("is_package", F.lit(True)), "p", "left")
    last_gap = F.coalesce(F.max(F.when(F.col("is_package").isNull(), F.col("n"))), F.lit(0))
    chain = marked.groupBy("dir").agg(last_gap.alias("gap"))
    return chain.select("dir", F.when(F.col("dir") == ".", ".").when(F.col("gap") == 0, F.lit(".")).otherwise(F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("gap")), "/")).alias("root"))


def resolved(directory: str, root: str, module: str, level: int) -> str:
    """First segment, from the repository's root, of a relative import; empty for one of the root itself."""
    parts = [] if directory in (".", "") else directory.split("/")
    base = [] if root in (".", "") else root.split("/")
    for _ in range(max(0, level - 1)):
        if len(parts) > len(base):
            parts.pop()
    return [*parts, *[m for m in module.split(".") if m], ""][0]


def normalised(evidence: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, module, relative): what import_evidence's rows refer to; empty ones are dropped."""

    @F.pandas_udf("string")
    def climb(d: pd.Series, r: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([resolved(*row) for row in zip(d, r, m, n)], dtype=object)

    with_root = evidence.withColumn("dir", T.parent(F.col("path"))).join(roots, "dir", "left")
    name = F.when(F.col("relative"), climb("dir", F.coalesce("root", F.lit(".")), "module", "level")).otherwise(F.split_part("module", F.lit("."), F.lit(1)))
    return with_root.select("path", name.alias("module"), "relative").filter("module <> ''")


def evidence(files: DataFrame, tree: DataFrame | None = None, most_files: int = MAX_EVIDENCE_FILES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(language, signal, weight, path): a signal for each import of the first ``most_files`` files by path, in the order of paths.

    An import that names nothing below the root (``from . import x`` in a file of the root) gives none. ``tree``: all files of
    the repository, whose ``__init__.py`` make packages; ``files`` where it isn't given.
    """
    first = files.filter(~F.col("is_symlink") & (F.octet_length("content") <= most_bytes)).orderBy("path").limit(most_files)
    weight = F.when(F.col("relative"), F.lit(RELATIVE)).otherwise(F.lit(ABSOLUTE))
    signal = F.when(F.col("relative"), "relative_import").otherwise("import")
    found = normalised(import_evidence(first), module_roots(files if tree is None else tree))
    return found.select(F.lit("Python").alias("language"), signal.alias("signal"), weight.alias("weight"), "path").orderBy("path", "signal", "language", "weight")


def warnings(files: DataFrame) -> DataFrame:
    """(path, warning) of files that give no evidence: links, unreadable ones, and those over 2 MiB."""
    why = F.when(F.col("is_symlink"), "a link").when(F.col("content").isNull(), "unreadable").when(F.octet_length("content") > MAX_BYTES, "too large")
    return files.select("path", why.alias("warning")).filter("warning IS NOT NULL")
