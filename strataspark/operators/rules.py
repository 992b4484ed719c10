"""Architecture rules: each is a query that gives violations, and a registry that runs them.

Violations: rule_id, severity, category, message, file, line, impact, and what the message says in columns of its own
(struct, subject, actual, threshold, related).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise
from . import graph

CATEGORIES = ("architecture", "maintainability", "size", "structural", "testing")
SCHEMA = "rule_id string, severity string, category string, message string, file string, line int, impact double, struct string, subject string, actual bigint, threshold bigint, related array<string>"


def _rows(df: DataFrame, rule_id: str, severity: str, category: str, impact: float, message: Column, **columns: Column) -> DataFrame:
    given = {"rule_id": F.lit(rule_id), "severity": F.lit(severity), "category": F.lit(category), "message": message, "impact": F.lit(impact), "line": F.lit(0)} | columns
    parts = [p.rsplit(" ", 1) for p in SCHEMA.split(", ")]
    return df.select(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in parts])


def large_files(files: DataFrame, most: int = 500) -> DataFrame:
    """Files(path, content) of more filled lines than ``most``."""
    counted = files.select("path", T.filled_lines(F.col("content")).alias("n")).filter(F.col("n") > most)
    message = F.format_string(f"File %s has %d lines (threshold: {most})", "path", "n")
    return _rows(counted, "rule.size", "warning", "size", -3.0, message, file=F.col("path"), actual=F.col("n"), threshold=F.lit(most), subject=F.lit("file"))


def large_functions(functions: DataFrame, most: int = 80) -> DataFrame:
    """functions(path, name, line, lines) over ``most`` lines."""
    message = F.format_string(f"Function %s in %s has %d lines (threshold: {most})", "name", "path", "lines")
    found = functions.filter(F.col("lines") > most)
    return _rows(found, "rule.size", "warning", "size", -3.0, message, file=F.col("path"), line=F.col("line"), actual=F.col("lines"), threshold=F.lit(most), subject=F.col("name"))


def upward_imports(edges: DataFrame) -> DataFrame:
    """Edges from a layer to one above it (handler, service, repo, from the top)."""
    tagged = edges.select("src", "dst").distinct().withColumn("a", T.layer(F.col("src"))).withColumn("b", T.layer(F.col("dst")))
    found = tagged.filter(T.layer_order(F.col("b")) < T.layer_order(F.col("a")))
    message = T.layer_message(F.col("src"), F.col("a"), F.col("dst"), F.col("b"))
    return _rows(found, "rule.layer-validation", "error", "architecture", -5.0, message, file=F.col("src"), related=F.array("src", "dst"))


def with_methods(structs: DataFrame, methods: DataFrame) -> DataFrame:
    """structs(dir, name, ...) with the count of their methods(dir, name): counted first, so the join is one row a struct."""
    counts = methods.groupBy("dir", "name").agg(F.count("*").alias("methods"))
    return structs.join(counts, ["dir", "name"], "left").withColumn("methods", F.coalesce("methods", F.lit(0).cast("bigint")))


def god_objects(structs: DataFrame, methods: DataFrame, most_fields: int = 15, most_methods: int = 10) -> DataFrame:
    """A row for each of fields and methods that a struct has too many of."""
    limits = F.array(
        F.struct(F.lit("fields").alias("subject"), F.col("fields").cast("bigint").alias("actual"), F.lit(most_fields).alias("most")),
        F.struct(F.lit("methods").alias("subject"), F.col("methods").alias("actual"), F.lit(most_methods).alias("most")),
    )
    each = with_methods(structs, methods).select("file", "name", "line", F.explode(limits).alias("x")).select("file", "name", "line", "x.*").filter("actual > most")
    message = F.format_string("Struct %s has %d %s (threshold: %d)", "name", "actual", "subject", "most")
    return _rows(each, "rule.god-object", "warning", "maintainability", -5.0, message, file=F.col("file"), line=F.col("line"), struct=F.col("name"), subject=F.col("subject"), actual=F.col("actual"), threshold=F.col("most"))


def merged_god_objects(violations: DataFrame) -> DataFrame:
    """(file, struct, fields, methods): one row a struct; what isn't over its limit is 0."""
    part = lambda s: F.coalesce(F.sum(F.when(F.col("subject") == s, F.col("actual"))), F.lit(0)).cast("bigint").alias(s)
    return violations.filter("rule_id = 'rule.god-object'").groupBy("file", "struct").agg(part("fields"), part("methods"))


def cycles(edges: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A row for each back edge of the sorted depth-first walk; of graphs over ``most`` edges, whose walk no one machine should
    hold, a row for each component with a cycle (``cyclic_components``)."""
    if not graph.at_most(edges, most):
        return cyclic_components(edges)
    found = graph.back_edges(edges, most)
    message = F.concat(F.lit("Circular dependency detected: "), T.cycle_text(F.col("path")))
    return _rows(found, "rule.circular-dependency", "critical", "architecture", -10.0, message, file=F.element_at("path", 1), related=F.col("path"))


def cyclic_components(edges: DataFrame) -> DataFrame:
    """A row for each strongly connected component with a cycle; distributed, for graphs of any size."""
    found = graph.cyclic(edges).groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("path"))
    message = F.concat(F.lit("Circular dependency among: "), F.array_join("path", ", "))
    return _rows(found, "rule.circular-dependency", "critical", "architecture", -10.0, message, file=F.col("component"), related=F.col("path"))


def outside(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges that ``allowed(src, dst)`` doesn't have."""
    return edges.select("src", "dst").join(allowed.select("src", "dst"), ["src", "dst"], "left_anti")


def boundaries(edges: DataFrame, matrix: dict[str, Iterable[str]], banned: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """Violations of package imports(src, dst): between packages of the matrix that its row doesn't list, and banned ones."""
    spark = edges.sparkSession
    pairs = [(a, b) for a, bs in matrix.items() for b in {*bs, a}]
    allowed = spark.createDataFrame(pairs, "src string, dst string")
    known = F.col("src").isin(*matrix) & F.col("dst").isin(*matrix)
    crossed = outside(edges.filter(known), allowed)
    wrong = spark.createDataFrame([(a, b) for a, bs in (banned or {}).items() for b in bs], "src string, dst string")
    risky = edges.select("src", "dst").join(F.broadcast(wrong), ["src", "dst"], "left_semi")
    message = F.concat_ws(" ", F.col("src"), F.lit("must not import"), F.col("dst"))
    return _rows(crossed.unionByName(risky).distinct(), "rule.boundary", "error", "architecture", -5.0, message, file=F.col("src"), related=F.array("src", "dst"))


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def in_order(violations: DataFrame) -> DataFrame:
    return violations.orderBy("rule_id", "file", "line", "message")


def eligible(listed: DataFrame, languages: list[str]) -> DataFrame:
    """Rules(aware, multi, languages) that run for the languages: not language-aware, for any language, or with one of them."""
    return listed.filter(~F.col("aware") | F.col("multi") | F.arrays_overlap("languages", F.array(*[F.lit(x) for x in languages]).cast("array<string>")))


@dataclass
class Context:
    """What rules look at: lazy tables, built once."""

    spark: SparkSession
    files: DataFrame
    functions: DataFrame
    structs: DataFrame
    methods: DataFrame
    edges: DataFrame
    languages: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    """evaluate(context) -> violations. ``languages`` empty: not language-aware; ``multi``: for every language."""

    id: str
    category: str
    severity: str
    evaluate: Callable[[Context], DataFrame]
    languages: tuple[str, ...] = ()
    multi: bool = False

    def runs_for(self, languages: tuple[str, ...]) -> bool:
        return not self.languages or self.multi or bool({*self.languages} & {*languages})


class Registry:
    """Rules by id; listings are sorted."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self._rules: dict[str, Rule] = {}
        for r in rules:
            self.register(r)

    def register(self, rule: Rule) -> None:
        if not rule.id:
            raise ValueError("a rule needs an id")
        if rule.category not in CATEGORIES:
            raise ValueError(f"unknown category {rule.category!r}")
        if rule.id in self._rules:
            raise ValueError(f"rule {rule.id!r} is registered already")
        self._rules[rule.id] = rule

    def get(self, rule_id: str) -> Rule | None:
        return self._rules.get(rule_id)

    def all(self) -> list[Rule]:
        return [self._rules[i] for i in self.ids()]

    def by_category(self, category: str) -> list[Rule]:
        return [r for r in self.all() if r.category == category]

    def ids(self) -> list[str]:
        return sorted(self._rules)

    def __len__(self) -> int:
        return len(self._rules)


def default_registry(settings: dict | None = None) -> Registry:
    """The rules that ``settings`` (see config.py) leave on, with their severities; all of them without settings."""
    given = settings or {}
    switches, sizes, gods = given.get("rules", {}), given.get("size", {}), given.get("god_object", {})
    size = lambda c: large_files(c.files, c.settings.get("max_file_lines", 500)).unionByName(large_functions(c.functions, c.settings.get("max_function_lines", 80)))

    def god(c: Context) -> DataFrame:
        kept = c.structs.filter(~T.excluded(F.col("file"), tuple(gods["exclude"]))) if gods.get("exclude") else c.structs
        return god_objects(kept, c.methods, c.settings.get("max_fields", 15), c.settings.get("max_methods", 10))

    def severe(evaluate: Callable[[Context], DataFrame], severity: str) -> Callable[[Context], DataFrame]:
        return lambda c: evaluate(c).withColumn("severity", F.lit(severity))

    listed = [
        (switches.get("enable_size_rule", True) and sizes.get("enabled", True), Rule("rule.size", "size", level := sizes.get("severity", "warning"), severe(size, level))),
        (switches.get("enable_god_object_rule", True) and gods.get("enabled", True), Rule("rule.god-object", "maintainability", level := gods.get("severity", "warning"), severe(god, level))),
        (switches.get("enable_layer_rule", True), Rule("rule.layer-validation", "architecture", "error", lambda c: upward_imports(c.edges))),
        (switches.get("enable_circular_rule", True), Rule("rule.circular-dependency", "architecture", "critical", lambda c: cycles(c.edges))),
    ]
    return Registry(rule for on, rule in listed if on)


@dataclass
class Outcome:
    violations: DataFrame
    executed: int
    failed: dict[str, str]
    timed_out: bool


class Executor:
    """Runs rules that fit the context's languages, one after another; the budget is looked at between rules.

    Each rule's violations are written as a table in its turn: a rule that raises, when it is planned or on a row, gives no
    rows and is listed, and the time that counts is that of its work.
    """

    def __init__(self, registry: Registry, budget: float = 2.0):
        self.registry, self.budget = registry, budget

    def execute(self, context: Context) -> Outcome:
        return self._run(self.registry.all(), context)

    def by_category(self, context: Context, category: str) -> Outcome:
        return self._run(self.registry.by_category(category), context)

    def by_ids(self, context: Context, ids: list[str]) -> Outcome:
        """In the order given; unknown ids are left out, repeated ones run again."""
        return self._run([r for i in ids if (r := self.registry.get(i))], context)

    def _run(self, rules: list[Rule], context: Context) -> Outcome:
        chosen = [r for r in rules if r.runs_for(context.languages)]
        began, parts, failed, late = time.monotonic(), [none(context.spark)], {}, False
        for r in chosen:
            if time.monotonic() - began > self.budget:
                late = True
                break
            try:
                parts.append(materialise(r.evaluate(context).select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]), "violations"))
            except Exception as error:  # isolation: a faulty rule doesn't end the analysis
                failed[r.id] = f"{type(error).__name__}: {error}"
        return Outcome(in_order(union(parts)), len(chosen), failed, late)
