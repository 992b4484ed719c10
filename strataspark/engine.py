"""Analysis of a repository: scan, detect, parse, graph, rules, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .adapters import Detector, Unsupported  # noqa: F401
from .functions import text as T
from .operators import detect, graph, rules, score
from .parsers import golang, python, scripts
from .session import materialise
from .sources import repo


@dataclass
class Analysis:
    """Tables of one run. ``violations``, ``score``: as in operators.rules and operators.score."""

    root: str
    language: str
    stats: DataFrame
    files: DataFrame
    file_metrics: DataFrame
    functions: DataFrame
    structs: DataFrame
    edges: DataFrame
    violations: DataFrame
    score: DataFrame
    outcome: rules.Outcome


def policy(cfg: dict) -> detect.Policy:
    found = cfg["language_detection"]
    return detect.Policy(found["weights"], tuple(found["tie_break_order"]), found["segment_weights"])


def language_stats(files: DataFrame, p: detect.Policy = detect.Policy()) -> DataFrame:
    return Detector(policy=p).stats(files)


def module_index(files: DataFrame, module: str, language: str) -> DataFrame:
    """(token, file), for Python and scripts (src, token, file): the import tokens that name a file of the repository.

    A Go package is its first file. A Python token is the first part of a dotted name, here looked up by the whole name in the
    importing file: its longest part that is a module or package. A script's ./ and ../ are relative to the importing file.
    """
    path = F.col("path")
    if language == "Go":
        folder = T.parent(path)
        token = F.when(folder == ".", F.lit(module)).otherwise(F.concat(F.lit(module + "/"), folder))
        return repo.go_files(files).groupBy(token.alias("token")).agg(F.min("path").alias("file"))
    if language == "Python":
        own = repo.python_files(files)
        names = own.select(F.regexp_replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), "/", ".").alias("name"), path.alias("file"))
        names = names.groupBy("name").agg(F.min("file").alias("file"))
        wanted = python.import_evidence(own)
        folder = F.when(T.parent(path) == ".", F.array().cast("array<string>")).otherwise(F.split(T.parent(path), "/"))
        above = F.slice(folder, F.lit(1), F.greatest(F.lit(0), F.size(folder) - (F.col("level") - 1)))
        parts = F.filter(F.split("module", r"\."), lambda x: x != "")
        wanted = wanted.select("path", F.split_part("module", F.lit("."), F.lit(1)).alias("token"), F.when(F.col("relative"), F.concat(above, parts)).otherwise(parts).alias("parts")).filter("size(parts) > 0").distinct()
        up = wanted.select("path", "token", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"), "parts").select("path", "token", "n", F.array_join(F.slice("parts", F.lit(1), F.col("n")), ".").alias("name"))
        return up.join(names, "name").groupBy(path.alias("src"), "token").agg(F.max_by("file", F.struct("n", "name")).alias("file"))
    own = repo.script_files(files, language)
    stems = own.groupBy(F.regexp_replace(path, r"(/index)?\.[jt]sx?$", "").alias("stem")).agg(F.min("path").alias("file"))
    tokens = scripts.imports(own).select(path.alias("src"), F.explode("imports").alias("token")).filter(F.col("token").rlike(r"^\.\.?(/|$)")).distinct()
    folder = F.when(T.parent(F.col("src")) == ".", F.array().cast("array<string>")).otherwise(F.split(T.parent(F.col("src")), "/"))
    walk = F.aggregate(F.split("token", "/"), folder, lambda at, x: F.when(x.isin(".", ""), at).when(x == "..", F.slice(at, F.lit(1), F.greatest(F.lit(0), F.size(at) - 1))).otherwise(F.concat(at, F.array(x))))
    stem = F.regexp_replace(F.array_join(walk, "/"), r"(/index)?(\.[jt]sx?)?$", "")
    return tokens.withColumn("stem", stem).join(stems, "stem").select("src", "token", "file")


def analyze(spark: SparkSession, path: str, cfg: dict | None = None, resolve: bool = False, registry: rules.Registry | None = None, detector: Detector | None = None) -> Analysis:
    """Analyse the tree at ``path``. ``resolve``: imports become the files they name, so that cycles between files are seen."""
    cfg = cfg or settings.completed({})
    root = repo.normalised_root(path)
    files = materialise(repo.scan(spark, root, hidden=True), "scan")
    detector = detector or Detector(policy=policy(cfg))
    adapter = detector.detect(files)
    language, tables = adapter.language, adapter.tables(files)
    edges = graph.edges_of(tables["imports"])
    if resolve:
        named = files.filter("path = 'go.mod'").select(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("m")).collect()
        edges = graph.resolve(edges, module_index(files, named[0].m if named else "", language))
    edges = materialise(edges, "edges")
    context = rules.Context(spark, node_contents(edges, files, adapter.own_files(files)), tables["functions"], tables["structs"], tables["methods"], edges, (language,), limits(cfg))
    outcome = rules.Executor(registry or rules.default_registry(cfg), budget=float("inf")).execute(context)
    weights = score.Weights(**{k: float(v) for k, v in cfg["weights"].items()})
    return Analysis(root, language, detector.stats(files), files, tables["metrics"], tables["functions"], tables["structs"], edges, outcome.violations, score.score(outcome.violations, weights), outcome)


def node_contents(edges: DataFrame, files: DataFrame, own: DataFrame) -> DataFrame:
    """(path, content) of every node of the graph, files without imports too; import tokens, and files that can't be read, have
    an empty content."""
    nodes = graph.nodes(edges).withColumnRenamed("node", "path").union(own.select("path")).distinct()
    return nodes.join(files.select("path", "content"), "path", "left").select("path", F.coalesce("content", F.lit("")).alias("content"))


def limits(cfg: dict) -> dict:
    return {"max_file_lines": cfg["size"]["max_file_lines"], "max_function_lines": cfg["size"]["max_function_lines"], "max_fields": cfg["god_object"]["max_fields"], "max_methods": cfg["god_object"]["max_methods"]}


def extract(spark: SparkSession, path: str, module: str = "") -> DataFrame:
    """(path, package, import) of all Go files, tests included: no standard library, the module's own as paths; null import where a file has none."""
    root = repo.normalised_root(path)
    own = repo.go_files(repo.scan(spark, root, (".go",), ignored=("vendor", "node_modules", "docs")), tests=True)
    each = golang.parsed(own).filter("imports IS NOT NULL")
    kept = F.filter("imports", lambda x: ~T.is_go_stdlib(x))
    return each.select("path", "package", F.explode_outer(F.array_distinct(F.transform(kept, lambda x: T.module_import(x, module)))).alias("import"))


def extract_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("path").alias("files"), F.count("import").alias("imports"))


def totals_of(metrics: DataFrame, structs: DataFrame) -> DataFrame:
    """(files, lines, functions, structs) of metrics(lines, functions) and structs: a row."""
    sums = metrics.agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("functions").alias("functions"))
    return sums.crossJoin(structs.agg(F.count("*").alias("structs")))


def totals(analysis: Analysis) -> DataFrame:
    return totals_of(analysis.file_metrics, analysis.structs)
