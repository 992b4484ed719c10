"""Checks of JSON metadata files: size, syntax, depth, key length."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches

MAX_BYTES, MAX_DEPTH, MAX_KEY = 2 << 20, 8, 128


def too_deep(value, limit: int = MAX_DEPTH, depth: int = 1) -> bool:
    """Whether maps and lists are nested deeper than ``limit``."""
    work = [(value, depth)]
    while work:
        v, at = work.pop()
        if isinstance(v, (dict, list)):
            if at > limit:
                return True
            work += [(x, at + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return False


def problem(content: str | None) -> str | None:
    """What is wrong with a metadata file; None if nothing is."""
    if content is None:
        return "unreadable"
    if len(content.encode("utf-8", "replace")) > MAX_BYTES:
        return "too large"
    try:
        value = json.loads(content)
    except (ValueError, RecursionError):
        return "invalid JSON"
    if too_deep(value):
        return "nested too deep"
    if not isinstance(value, dict):
        return "not an object"
    if any(len(k.encode("utf-8", "replace")) > MAX_KEY for k in value):
        return "key too long"
    return None


def guarded(files: DataFrame) -> DataFrame:
    """(path, ok, warning) of files(path, content)."""
    bound_batches(files.sparkSession)

    @F.pandas_udf("string")
    def warn(content: pd.Series) -> pd.Series:
        return content.map(problem, na_action=None)

    return files.select("path", warn("content").alias("warning")).select("path", F.col("warning").isNull().alias("ok"), "warning")
