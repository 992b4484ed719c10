"""File events of a tree as a stream.

The tree is listed again for every batch: what is new since the last listing was created, what has another time was written,
what is gone was removed. New directories are in the next listing, so they need no subscription of their own.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .repo import listing, normalised_root

SCHEMA = "name string, op string, ts timestamp"
IGNORED = ("obj", "bin", "build", "dist", "vendor", "node_modules")


class EventReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root, self.seen, self.log = normalised_root(root), None, []
        self.first = 0  # number of the first event in the log

    def snapshot(self) -> dict[str, int]:
        out = {}
        for path, _, _ in listing(self.root, IGNORED):
            try:
                out[path] = os.stat(os.path.join(self.root, path)).st_mtime_ns
            except FileNotFoundError:  # it went while the tree was listed
                continue
        return out

    def initialOffset(self) -> dict:
        self.seen = self.snapshot()
        return {"event": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.seen is None:
            self.seen, self.first = self.snapshot(), start["event"]
        now, stamp = self.snapshot(), dt.datetime.now(dt.timezone.utc)
        for path in sorted({*now, *self.seen}):
            op = "CREATE" if path not in self.seen else "REMOVE" if path not in now else "WRITE" if now[path] != self.seen[path] else None
            if op:
                self.log.append((path, op, stamp))
        self.seen = now
        end = {"event": self.first + len(self.log)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.log[max(0, start["event"] - self.first) : max(0, end["event"] - self.first)])

    def commit(self, end: dict) -> None:
        done = max(0, min(len(self.log), end["event"] - self.first))
        del self.log[:done]
        self.first += done


class RepoEvents(DataSource):
    """``spark.readStream.format("repo_events").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "repo_events"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return EventReader(self.options.get("path", ""))


def stream(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(RepoEvents)
    return spark.readStream.format("repo_events").load(normalised_root(root))
