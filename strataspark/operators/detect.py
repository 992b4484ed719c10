"""Which language a repository is written in: weighted files, evidence, markers, and a top-1 with a fixed tie order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WIDE = "decimal(38,6)"  # sums don't depend on their order, so ties are ties
BASE = "0.35"
MARKERS = (("pyproject.toml", "Python", "5"), ("requirements.txt", "Python", "5"), ("setup.py", "Python", "5"), ("go.mod", "Go", "5"), ("tsconfig.json", "TypeScript", "5"), ("package.json", "JavaScript", "3"))
LANGUAGE_OF = {"go": "Go", "py": "Python", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript"}


@dataclass(frozen=True)
class Policy:
    language_weights: dict[str, float] = field(default_factory=lambda: {"Python": 1.0, "TypeScript": 1.0, "JavaScript": 1.0, "Go": 1.0})
    tie_break: tuple[str, ...] = ("Python", "TypeScript", "JavaScript", "Go")
    segment_weights: dict[str, float] = field(default_factory=lambda: {"src": 1.0, "app": 1.0, "pkg": 1.0, "tools": 0.2, "scripts": 0.2})


def language_of(path: Column) -> Column:
    """Language by the path's extension, null for others. Only the extensions of JavaScript and TypeScript ignore case."""
    exact = F.regexp_extract(path, r"\.(go|py)$", 1)
    loose = F.lower(F.regexp_extract(path, r"(?i)\.(jsx?|tsx?)$", 1))
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.try_element_at(pairs, F.when(exact != "", exact).otherwise(loose))


def language_stats(files: DataFrame, policy: Policy = Policy(), plain: bool = False) -> DataFrame:
    """(language, count, lines, score, product) of files(path, language, lines); one aggregation, no UDF.

    A file weighs lines + 0.35, by its role, its segment and its language; ``plain`` leaves the weights out.
    """
    base = F.col("lines").cast("decimal(20,0)") + F.lit(BASE).cast("decimal(4,2)")
    role = T.path_role(F.col("path"))
    weight = F.lit(1).cast("decimal(2,0)") if plain else T.role_weight(role) * T.segment_weight(F.col("path"), policy.segment_weights) * T.language_weight(F.col("language"), policy.language_weights)
    each = files.select("language", "lines", (base * weight).cast(WIDE).alias("s"), F.when(role == "product", base).otherwise(F.lit(0)).cast(WIDE).alias("p"))
    return each.groupBy("language").agg(F.count("*").alias("count"), F.sum("lines").alias("lines"), F.sum("s").cast(WIDE).alias("score"), F.sum("p").cast(WIDE).alias("product"))


def evidence_sums(evidence: DataFrame) -> DataFrame:
    """(language, weight, signals): positive weights of named languages."""
    return evidence.filter((F.col("weight") > 0) & (F.col("language") != "")).groupBy("language").agg(F.sum("weight").alias("weight"), F.count("*").alias("signals"))


def with_evidence(stats: DataFrame, sums: DataFrame) -> DataFrame:
    """Stats with the evidence added to their scores; a language that has evidence only gets a row."""
    zero = lambda kind: F.lit(0).cast(kind)
    extra = sums.select("language", zero("bigint").alias("count"), zero("bigint").alias("lines"), F.col("weight").cast(WIDE).alias("score"), zero(WIDE).alias("product"))
    both = stats.select("language", "count", F.col("lines").cast("bigint"), "score", "product").unionByName(extra)
    return both.groupBy("language").agg(*[F.sum(c).alias(c) for c in ("count", "lines", "score", "product")])


def boosted(stats: DataFrame, boosts: DataFrame) -> DataFrame:
    """``boosts(language, boost)`` added to the languages that have stats already; a few rows, hence broadcast."""
    extra = F.coalesce(F.col("boost").cast(WIDE), F.lit(0).cast(WIDE))
    return stats.join(F.broadcast(boosts), "language", "left").withColumn("score", (F.col("score") + extra).cast(WIDE)).drop("boost")


def marker_boosts(files: DataFrame) -> DataFrame:
    """(language, boost) of the marker files in the repository's root; a language is boosted once."""
    markers = files.sparkSession.createDataFrame(MARKERS, "path string, language string, boost string")
    return files.select("path").join(F.broadcast(markers), "path").groupBy("language").agg(F.max("boost").alias("boost"))


def dominant(stats: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The first language by product, score, lines, count, the tie order (of listed ones), and name."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in policy.tie_break]), F.col("language")), F.lit(0))
    known = F.when(place > 0, place).otherwise(F.lit(len(policy.tie_break) + 1))
    return stats.orderBy(F.desc("product"), F.desc("score"), F.desc("lines"), F.desc("count"), known, "language").limit(1)


def several(files: DataFrame) -> DataFrame:
    """(several, languages): whether there is more than one language, and their sorted names."""
    names = F.array_sort(F.collect_set("language"))
    return files.agg(names.alias("languages")).select((F.size("languages") > 1).alias("several"), "languages")


def python_version(files: DataFrame) -> DataFrame:
    """One row (version): the trimmed ``.python-version``, or that pyproject.toml names one; null without either."""
    pinned = F.max(F.when(F.col("path") == ".python-version", T.trim(F.col("content"))))
    named = F.max(F.when((F.col("path") == "pyproject.toml") & F.col("content").contains("requires-python"), F.lit("from pyproject.toml")))
    return files.filter(F.col("path").isin(".python-version", "pyproject.toml")).agg(F.coalesce(pinned, named).alias("version"))
