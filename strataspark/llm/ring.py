"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A ring of 2**ring_bits slots holds ``virtual_nodes`` nodes of each shard. A key belongs to the slot of its hash's top bits and
so to the next node clockwise. No shard takes more than ceil((1 + slack) * keys / shards) keys: in ring order (slot, then
the rest of the hash, then doc_id), a key whose shard is full goes on clockwise to the next node whose shard isn't.

Only counts by slot reach the driver, 2**ring_bits of them at most, whatever the input. They fix the shard of nearly every slot;
the few slots that a full shard cuts in two have their keys ranked. What is broadcast is one row a slot.

Defined results: keys are doc_ids, null being one; equal keys are next to each other on the ring, and repeated rows are
keys each; a doc_id that doesn't cast to bigint is an error; ties have no effect on a shard's load; an empty table has an empty result; other columns are not looked at.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    shards: int = 64
    virtual_nodes: int = 128
    slack: float = 0.05
    ring_bits: int = 16


def node_slots(p: Params) -> list[tuple[int, int]]:
    """(slot, shard) of the virtual nodes in ring order. A shard's nodes don't depend on how many shards there are."""
    import xxhash

    nodes = []
    for shard in range(p.shards):
        for n in range(p.virtual_nodes):
            nodes.append((xxhash.xxh3_64_intdigest(struct.pack("<qq", shard, n)) >> (64 - p.ring_bits), shard))
    return sorted(nodes)


def capacity(keys: int, p: Params) -> int:
    whole = int(round((1 + p.slack) * 1_000_000)) * keys
    return -(-whole // (1_000_000 * p.shards))


def place(counts: dict[int, int], p: Params) -> dict[int, list[tuple[int, int, int, int]]]:
    """slot -> (first rank, last rank, shard, hops) of its keys, ranks from 1; hops: nodes passed, their shards full."""
    nodes = node_slots(p)
    slots = [s for s, _ in nodes]
    room = [capacity(sum(counts.values()), p)] * p.shards
    # after[i]: the next node from i on whose shard had room when last looked at (path compression)
    after = list(range(len(nodes)))

    def free(i: int) -> int:
        path = []
        while room[nodes[i][1]] == 0:
            path.append(i)
            after[i] = (i + 1) % len(nodes) if after[i] == i else after[i]
            i = after[i]
        for j in path:
            after[j] = i
        return i

    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for slot in sorted(counts):
        home, left, done = bisect_left(slots, slot) % len(nodes), counts[slot], 0
        out[slot] = []
        while left:
            at = free(home)
            shard = nodes[at][1]
            taken = min(left, room[shard])
            out[slot].append((done + 1, done + taken, shard, (at - home) % len(nodes)))
            room[shard] -= taken
            done, left = done + taken, left - taken
    return out


def assign(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, home, shard, hops) of each row: the shard that the ring alone would give, the one that has it, and the nodes between."""
    spark = docs.sparkSession
    hashed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).withColumn("h", F.xxhash64("doc_id"))
    keys = hashed.withColumn("slot", F.shiftrightunsigned("h", 64 - p.ring_bits).cast("int"))
    counts = {r[0]: r[1] for r in keys.groupBy("slot").count().collect()}
    nodes = node_slots(p)
    slots = [s for s, _ in nodes]
    placed = place(counts, p)
    rows = [(slot, nodes[bisect_left(slots, slot) % len(nodes)][1], *(parts[0][2:] if len(parts) == 1 else (None, None))) for slot, parts in placed.items()]
    whole = spark.createDataFrame(rows, "slot int, home int, shard int, hops int")
    found = keys.join(F.broadcast(whole), "slot")  # at most 2**ring_bits rows
    sure = found.filter("shard IS NOT NULL").select("doc_id", "home", "shard", "hops")
    cut = [(slot, *part) for slot, parts in placed.items() if len(parts) > 1 for part in parts]
    if not cut:
        return sure
    # Fewer than shards + cut slots: each part but a slot's last one fills a shard.
    parts = spark.createDataFrame(cut, "slot int, first bigint, last bigint, shard int, hops int")
    in_order = Window.partitionBy("slot").orderBy(F.col("h").bitwiseXOR(F.lit(-(2**63)).cast("bigint")), "doc_id")
    ranked = found.filter("shard IS NULL").select("doc_id", "home", "slot", F.row_number().over(in_order).cast("bigint").alias("rank"))
    split = ranked.join(F.broadcast(parts), "slot").filter("rank BETWEEN first AND last").select("doc_id", "home", "shard", "hops")
    return sure.unionByName(split)
