"""Scores, report summaries and trends over violations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Weights:
    circular: float = 10.0
    layer: float = 5.0
    size: float = 3.0
    god_object: float = 5.0


KINDS = {"circular": "rule.circular-dependency", "layer": "rule.layer-validation", "size": "rule.size", "god_object": "rule.god-object"}


def _counts():
    """Violations by rule; a god object counts once, however many limits it breaks."""
    for name, rule in KINDS.items():
        hit = F.col("rule_id") == rule
        yield F.countDistinct(F.when(hit, F.struct("file", "struct"))).alias(name) if name == "god_object" else F.count_if(hit).alias(name)


def score(violations: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """One row: counts, penalties, total (100 less the penalties, 0 at least), exit code."""
    out = violations.agg(*_counts())
    for name in KINDS:
        out = out.withColumn(f"{name}_penalty", F.col(name) * F.lit(float(getattr(weights, name))))
    penalty = sum((F.col(f"{n}_penalty") for n in KINDS), F.lit(0.0))
    return out.withColumn("total", F.greatest(F.lit(0.0), F.lit(100.0) - penalty)).withColumn("exit_code", F.when(F.col("circular") + F.col("layer") > 0, 2).otherwise(0))


def by_group(rows: DataFrame, weight: int) -> DataFrame:
    """(name, failing, total) of rows(name, failed)."""
    return rows.groupBy("name").agg(F.count_if("failed").alias("failing")).withColumn("total", F.greatest(F.lit(0), 100 - weight * F.col("failing")).cast("double"))


def summary(violations: DataFrame) -> DataFrame:
    return violations.agg(*_counts(), F.count("*").alias("total")).withColumn("has_violations", F.col("total") > 0)


def trend(history: DataFrame) -> DataFrame:
    """history(ts, score) with the change against the entry before and its name.

    A history is one row an analysis run: its window is one partition by nature, after any aggregation.
    """
    before = F.lag("score").over(Window.orderBy("ts"))
    return history.withColumn("delta", F.col("score") - before).withColumn("trend", T.trend_text(F.col("delta")))


def last_entry(history: DataFrame) -> DataFrame:
    """(ts, score, entries)."""
    return history.agg(F.max("ts").alias("ts"), F.max_by("score", "ts").alias("score"), F.count("*").alias("entries"))


def explained(row: dict) -> str:
    """The score in words."""
    lines = [f"Score {row['total']:.1f} of 100"]
    lines += [f"  {name.replace('_', ' ')}: {row[name]} found, {row[f'{name}_penalty']:.1f} points" for name in KINDS if row[name]]
    return "\n".join(lines)
