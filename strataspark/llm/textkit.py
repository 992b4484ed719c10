"""Helpers shared by the text operators: Arrow plumbing, word hashing, size-checked joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class WordHasher:
    """word -> 64-bit hash through a dictionary that is emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        import xxhash

        self.limit, self.known, self.digest = limit, {}, xxhash.xxh3_64_intdigest

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.array([known[w] for w in words], U64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.digest(w.encode("utf-8", "surrogatepass"))
            return np.array([known[w] for w in words], U64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter non-empty text is one shingle."""
    n = len(words)
    if not n:
        return words
    out = np.zeros(max(1, n - k + 1), U64)
    if n < k:
        for w in words:
            out = mix(out * M1 + w + M3)
    else:
        for i in range(k):
            out = out * M1 + mix(words[i : n - k + 1 + i] + U64((i + 1) * int(M2) % 2**64))
    return np.unique(mix(out))


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of words that aren't empty, by multilinear hashing of their bytes: the sum of a random number for each byte
    value times one for each place."""
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    starts, lengths = starts[:-1] - starts[0], np.diff(starts)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    values, places = mix(np.arange(1, 257, dtype=U64) * M2), mix(np.arange(1, lengths.max() + 1, dtype=U64) * M3) | U64(1)
    return mix(np.add.reduceat(values[data] * places[place], starts) + lengths.astype(U64) * M1)


def batch_shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text of a batch; words are lower-cased runs of no white space. A
    shorter text with a word is one shingle."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    flat, ends = lists.flatten(), np.cumsum(np.concatenate([[0], np.diff(lists.offsets.to_numpy())]))
    filled = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    ends, flat = before[ends], flat.filter(filled)
    words = word_hashes(flat) if len(flat) else np.array([], U64)
    out = np.zeros(max(0, len(words) - k + 1), U64)
    for i in range(k):
        out = out * M1 + mix(words[i : len(out) + i] + U64((i + 1) * int(M2) % 2**64))
    out, made = mix(out), []
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if end - start < k:
            made.append(shingles(words[start:end], k))
            continue
        one = np.sort(out[start : end - k + 1])
        made.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
    return made


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with one ``make()`` a task, so that caches live as long as the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, broadcast_rows: int) -> DataFrame:
    """Broadcast ``small`` only if its counted rows allow; otherwise the shuffle join that Spark picks."""
    return big.join(F.broadcast(small) if small_enough(small, broadcast_rows) else small, on, how)


SLOTS = 64


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in its slot of ``2**bits``; the slot is its lowest bits. Low bits: samples have small hashes."""
    k = keys >> U64(6)
    return (k & U64((1 << bits) - 1)).astype(np.int64), ((k * M1) >> U64(64 - bits)).astype(np.int64)


def bloom_filter(keys: DataFrame) -> tuple[list[bytes], int]:
    """A Bloom filter of keys(key), one part a slot, and the bits of a part; at most 256 MB, beyond which it only thins less."""
    bits = min(25, max(10, math.ceil(math.log2(12 * keys.count() / SLOTS + 1))))
    slotted = keys.withColumn("slot", F.col("key").bitwiseAND(SLOTS - 1).cast("int"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on: dict[int, np.ndarray] = {}
        for batch in batches:
            own, slot = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()
            for s in np.unique(slot).tolist():
                table = on.setdefault(s, np.zeros(1 << bits, bool))
                for at in _places(own[slot == s], bits):
                    table[at] = True
        for s, table in on.items():
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], ["slot", "bits"])

    rows = slotted.repartition("slot").mapInArrow(part, "slot int, bits binary").collect()  # a row a slot
    parts = {r.slot: bytes(r.bits) for r in rows}
    return [parts.get(i, bytes(1 << bits >> 3)) for i in range(SLOTS)], bits


def in_filter(keys: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which of the keys may be in the filter whose parts, joined, are ``table``."""
    found, slot = np.ones(len(keys), bool), (keys & U64(SLOTS - 1)).astype(np.int64) << bits
    for at in _places(keys, bits):
        at = slot + at
        found &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return found
