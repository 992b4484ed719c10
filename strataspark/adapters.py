"""Languages as adapters: which files are a language's, what they import, how they measure; and the detector over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import detect, rules
from .parsers import golang, python, scripts
from .session import materialise
from .sources import repo

EMPTY = {
    "functions": "path string, name string, line int, lines int, params int",
    "structs": "dir string, file string, name string, line int, fields int, exported boolean",
    "methods": "dir string, name string, method string",
}


class Unsupported(ValueError):
    pass


@dataclass(frozen=True)
class Adapter:
    """``tables(files)`` gives imports, metrics, functions, structs and methods of a language's own files.

    ``evidence(files)`` gives (language, signal, weight, path); None where a language has none. ``capabilities`` are what an
    analysis may ask for.
    """

    language: str
    own_files: Callable[[DataFrame], DataFrame]
    tables: Callable[[DataFrame], dict[str, DataFrame]]
    normalise: Callable[[Column], Column]
    evidence: Callable[[DataFrame], DataFrame] | None = None
    capabilities: frozenset[str] = frozenset({"graph", "metrics"})

    def is_stdlib(self, c: Column) -> Column:
        return T.is_stdlib(c, self.language)


def _go(files: DataFrame) -> dict[str, DataFrame]:
    parsed = materialise(golang.parsed(repo.go_files(files)), "go-parse")
    sources = parsed.filter("functions IS NOT NULL")
    lines = files.select("path", T.file_lines(F.col("content")).alias("lines"))
    structs = sources.select("path", F.explode("structs").alias("s")).select(T.parent(F.col("path")).alias("dir"), F.col("path").alias("file"), "s.*")
    methods = sources.select("path", F.explode("methods").alias("m")).filter("m.receiver IS NOT NULL").select(T.parent(F.col("path")).alias("dir"), F.col("m.receiver").alias("name"), F.col("m.name").alias("method"))
    return {
        "imports": parsed.filter("imports IS NOT NULL").select("path", "imports"),
        "metrics": sources.join(lines, "path").select("path", "lines", F.size("imports").alias("imports"), F.size("functions").alias("functions")),
        "functions": sources.select("path", F.explode("functions").alias("f")).select("path", "f.*"),
        "structs": structs,
        "methods": methods,
    }


def _with_empty(spark: SparkSession, **tables: DataFrame) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in EMPTY.items()} | tables


def _python(files: DataFrame) -> dict[str, DataFrame]:
    own = repo.python_files(files)
    return _with_empty(files.sparkSession, imports=python.imports(own).select("path", "imports"), metrics=python.metrics(own))


def _scripts(language: str) -> Adapter:
    own = lambda files: repo.script_files(files, language)

    def tables(files: DataFrame) -> dict[str, DataFrame]:
        return _with_empty(files.sparkSession, imports=scripts.imports(own(files)), metrics=scripts.metrics(own(files)).withColumn("functions", F.lit(0)))

    return Adapter(language, own, tables, T.js_import, lambda files: scripts.evidence(files, own(files), language))


GO = Adapter("Go", repo.go_files, _go, T.go_import)
PYTHON = Adapter("Python", repo.python_files, _python, T.python_import, lambda files: python.evidence(repo.python_files(files), files))
DEFAULT = (GO, PYTHON, _scripts("JavaScript"), _scripts("TypeScript"))


class Detector:
    """Finds the language of a table of files among the registered adapters."""

    def __init__(self, adapters: Iterable[Adapter] = DEFAULT, policy: detect.Policy = detect.Policy()):
        self.adapters: dict[str, Adapter] = {}
        self.policy = policy
        for a in adapters:
            self.register(a)

    def register(self, adapter: Adapter) -> None:
        if adapter.language in self.adapters:
            raise ValueError(f"{adapter.language} has an adapter already")
        self.adapters[adapter.language] = adapter

    def supported(self) -> list[str]:
        return sorted(self.adapters)

    def evidence(self, files: DataFrame) -> DataFrame | None:
        """(language, signal, weight, path) of all languages that give any."""
        parts = [a.evidence(files) for a in self.adapters.values() if a.evidence]
        return rules.union(parts) if parts else None

    def stats(self, files: DataFrame) -> DataFrame:
        """Weighted files, evidence and markers by language, in the order of languages."""
        known = repo.detectable(files).withColumn("language", detect.language_of(F.col("path"))).filter(F.col("language").isin(*self.adapters) & F.col("content").isNotNull())
        counted = known.select(F.concat(F.lit("/"), "path").alias("path"), "language", T.scanned_lines(F.col("content")).alias("lines"))
        found = detect.language_stats(counted, self.policy)
        if (signals := self.evidence(files)) is not None:
            found = detect.with_evidence(found, detect.evidence_sums(signals.select("language", F.col("weight").cast("decimal(10,4)").alias("weight"))))
        return detect.boosted(found, detect.marker_boosts(files)).orderBy("language")

    def detect(self, files: DataFrame, needs: Iterable[str] = ("graph", "metrics")) -> Adapter:
        """The adapter of the dominant language; an error if there is none, or if it lacks what is needed."""
        top = detect.dominant(self.stats(files), self.policy).collect()
        if not top:
            raise Unsupported("no supported language in the repository")
        adapter = self.adapters[top[0].language]
        if missing := set(needs) - adapter.capabilities:
            raise Unsupported(f"{adapter.language} has no {', '.join(sorted(missing))}")
        return adapter
