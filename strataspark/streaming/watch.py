"""Watching a repository: file events, bursts, and an analysis after each burst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATIONS = ("WRITE", "CREATE", "REMOVE", "RENAME")
GAP = "500 milliseconds"
SLOTS = 4096


def wanted(name: Column, op: Column) -> Column:
    """Go files without a leading dot, and exactly one of the four operations."""
    base = F.element_at(F.split(name, "/"), -1)
    return name.endswith(".go") & ~base.startswith(".") & op.isin(*OPERATIONS)


def _bursts_of_table(events: DataFrame, gap: str, order: str) -> DataFrame:
    """Events of one slot as wide as the gap are of one burst, so slots are counted first. They are joined to sessions within
    periods of ``SLOTS`` slots, and what passes the border of a period is joined by a window over one row a period."""
    width = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {gap})")
    at = F.unix_micros("ts")
    slots = events.groupBy(F.floor(at / width).alias("slot")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"), F.max(F.struct(F.col(order).alias("k"), "name")).alias("end"))
    in_order = Window.partitionBy("period").orderBy("slot")
    apart = F.coalesce(F.col("first") - F.lag("last").over(in_order) >= width, F.lit(True))
    slots = slots.withColumn("period", F.floor(F.col("slot") / SLOTS)).withColumn("apart", apart.cast("int"))
    slots = slots.withColumn("n", F.sum("apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = slots.groupBy("period", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"), F.max("end").alias("end"))
    periods = parts.groupBy("period").agg(F.max("n").alias("parts"), F.min("first").alias("p_first"), F.max("last").alias("p_last"), F.max("first").alias("last_start"))
    by_period = Window.orderBy("period")
    periods = periods.withColumn("joined", F.coalesce(F.col("p_first") - F.lag("p_last").over(by_period) < width, F.lit(False)))
    own = F.when((F.col("parts") > 1) | ~F.col("joined"), F.col("last_start"))
    periods = periods.withColumn("before", F.last(own, ignorenulls=True).over(by_period.rowsBetween(Window.unboundedPreceding, -1)))
    burst = F.when((F.col("n") == 1) & F.col("joined"), F.col("before")).otherwise(F.col("first"))
    each = parts.join(periods.select("period", "joined", "before"), "period").groupBy(burst.alias("burst")).agg(F.sum("events").alias("events"), F.max("end").alias("end"))
    return each.select(F.timestamp_micros("burst").alias("started"), "events", F.col("end.name").alias("name"))


def bursts(events: DataFrame, gap: str = GAP, order: str = "ts") -> DataFrame:
    """(started, events, name): events less than ``gap`` apart are one burst, named after its last event."""
    if not events.isStreaming:
        return _bursts_of_table(events.filter("ts IS NOT NULL"), gap, order)
    # Streams need a key besides the window; debouncing is over all files, so it is the same for all.
    window = [F.session_window("ts", gap), F.col("name").isNull().alias("nameless")]
    sessions = events.groupBy(*window).agg(F.min("ts").alias("started"), F.count("*").alias("events"), F.max_by("name", order).alias("name"))
    return sessions.select("started", "events", "name")


def debounced(stream: DataFrame, gap: str = GAP, late: str = "0 seconds") -> DataFrame:
    """Bursts of a stream(name, op, ts); a burst comes out once the watermark has passed its gap."""
    return bursts(stream.filter(wanted(F.col("name"), F.col("op"))).withWatermark("ts", late), gap)


def run_on_bursts(stream: DataFrame, analyse: Callable[[str], int], checkpoint: str, gap: str = GAP):
    """Start a query that calls ``analyse(name)`` once for each burst; runs never overlap.

    ``checkpoint`` is on storage that all executors share. A failing analysis is reported and doesn't stop the query.
    """

    def step(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("started").select("name").toLocalIterator():
            try:
                print(f"analysis after {row.name}: exit code {analyse(row.name)}", flush=True)
            except Exception as error:  # the loop goes on, whatever a run did
                print(f"analysis after {row.name} failed: {error}", flush=True)

    return debounced(stream, gap).writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).start()
