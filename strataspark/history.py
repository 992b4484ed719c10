"""Score history as an appended table, and its JSON form."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import score

SCHEMA = "ts timestamp, score double"


def append(spark: SparkSession, folder: str, value: float) -> None:
    """One entry at the present second. The folder is best kept outside the tree that is analysed."""
    entry = spark.createDataFrame([(float(value),)], "score double").select(F.date_trunc("second", F.current_timestamp()).alias("ts"), "score")
    entry.coalesce(1).write.mode("append").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """history(ts, score); empty where there is none."""
    if "://" not in folder and not (os.path.isdir(folder) and any(x.endswith(".parquet") for x in os.listdir(folder))):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """history of a JSON array of {timestamp, score}; empty where it is missing or malformed."""
    try:
        with open(path, encoding="utf-8") as f:
            rows = [(str(x["timestamp"]), float(x["score"])) for x in json.load(f)]
    except (OSError, ValueError, KeyError, TypeError):
        rows = []
    return spark.createDataFrame(rows, "timestamp string, score double").select(F.to_timestamp("timestamp").alias("ts"), "score")


def to_json(history: DataFrame) -> str:
    stamped = history.orderBy("ts").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "score")
    return json.dumps([r.asDict() for r in stamped.collect()], indent=2)


def summary(history: DataFrame, current: float, least: int = 2) -> str:
    """The change against the last entry, once there are ``least`` of them."""
    last = score.last_entry(history).first()
    if last.entries < least:
        return "No earlier score to compare with"
    delta = current - last.score
    name = "increased" if delta > 0 else "decreased" if delta < 0 else "unchanged"
    return f"Current Score: {current:.1f}\nPrevious Score: {last.score:.1f}\nDelta: {delta:+.1f} ({name})"
