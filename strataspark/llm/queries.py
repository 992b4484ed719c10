"""Queries over the driver's tables, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, decontaminate, html_paths, near_dup, pii, quality_fm, ring, rules, secrets, warc


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda spark, d: pii.scan(table(spark, d, "documents")),
    "op2_warc": lambda spark, d: warc.frames(table(spark, d, "pages")),
    "op3_secrets": lambda spark, d: secrets.scan(table(spark, d, "documents")),
    "op4_ring": lambda spark, d: ring.assign(table(spark, d, "documents")),
    "op5_quality_fm": lambda spark, d: quality_fm.score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_near_duplicates": lambda spark, d: near_dup.links(table(spark, d, "documents")),
    "op7_bpe": lambda spark, d: bpe.encode(table(spark, d, "documents")),
    "op8_quality_rules": lambda spark, d: rules.ledger(table(spark, d, "documents")),
    "op9_html_paths": lambda spark, d: html_paths.content(table(spark, d, "pages")),
    "op10_decontamination": lambda spark, d: decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "quality_rules_ablation": lambda spark, d: rules.ablation(rules.ledger(table(spark, d, "documents")), 2),
    "pipeline": _pipeline,
}

ORACLES: dict[str, str] = {
    "op8_quality_rules": rules.LEDGER_SQL,
    "quality_rules_ablation": rules.ABLATION_SQL,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
