"""Byte-level BPE encoding and decoding.

A pre-token's bytes form a doubly linked list of symbols. A heap holds the possible merges by (rank, position); an
entry is stale, and skipped, when either symbol has changed since it was pushed. The vocabulary is a ``.tiktoken`` file
(base64 bytes and rank a line); its rank order is the merge order. Decoding concatenates the vocabulary's byte strings.

The vocabulary file is read on the driver and sent to the workers as bytes: executors need no copy of it.

Defined results: a null text has null tokens; an empty text has none; a repeated row is encoded again, with the same
result; texts are encoded whole; special tokens have no meaning in a text; decoding nulls gives null; ids outside the
vocabulary raise an error, and so does a vocabulary without all 256 bytes, on the driver; a doc_id that doesn't cast to bigint
is an error; other columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .textkit import map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Contractions, letters, digits or other signs with one leading space, and runs of white space. The second form says
#: the same in the faster ``re``, but for texts with numbers that aren't decimals, the signs \\x1c to \\x1f, or
#: characters beyond the first plane.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FAST = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
APART = re.compile("[\x1c-\x1f" + "".join(c for c in map(chr, range(1 << 16)) if unicodedata.category(c) in ("Nl", "No")) + "]")
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def load_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """encode(str) -> bytes of little-endian int32 ids; decode(ids) -> bytes."""

    def __init__(self, vocabulary: bytes, remember: int = 200_000):
        import regex

        pairs = (line.split() for line in vocabulary.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.strings = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.strings[rank] = token
        if lacking := [i for i in range(256) if bytes([i]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks {len(lacking)} of the 256 bytes")
        self.slow, self.fast, self.remember, self.known, self.older = regex.compile(PATTERN).findall, re.compile(FAST).findall, remember, {}, {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        symbols: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                heap.append((rank, i, data[i : i + 2]))
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) == n or len(left) + len(symbols[j]) != len(joined) or left + symbols[j] != joined:
                continue  # stale: a symbol of this entry has been merged since
            symbols[i], symbols[j], k = joined, None, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (rank := ranks.get(pair := joined + symbols[k])) is not None:
                    heapq.heappush(heap, (rank, i, pair))
            if (h := before[i]) >= 0 and (rank := ranks.get(pair := symbols[h] + joined)) is not None:
                heapq.heappush(heap, (rank, h, pair))
        return [ranks[s] for s in symbols if s is not None]

    def split(self, text: str) -> list[str]:
        return self.slow(text) if APART.search(text) or BEYOND.search(text) else self.fast(text)

    def encode(self, text: str) -> bytes:
        parts = self.split(text)
        out = list(map(self.known.get, parts))
        if None in out:
            for at, ids in enumerate(out):
                if ids is None:
                    out[at] = self.look_up(parts[at])
        return b"".join(out)

    def look_up(self, part: str) -> bytes:
        """The ids of a pre-token that the younger of two generations of the cache may not hold."""
        ids = self.known.get(part) or self.older.get(part)
        if ids is None:
            ids = np.array(self.merge(part.encode()), "<i4").tobytes()
        if len(part) <= 64:
            if len(self.known) >= self.remember:
                self.older, self.known = self.known, {}
            self.known[part] = ids
        return ids

    def decode(self, ids: list[int]) -> bytes:
        strings = self.strings
        return b"".join([strings[i] for i in ids])


def encode(docs: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, token_ids, round_trip): the ids of each text; round_trip says that decoding them gives the text."""
    bound_batches(docs.sparkSession)
    data = load_vocabulary() if vocabulary is None else vocabulary
    Codec(data)
    shared = docs.sparkSession.sparkContext.broadcast(data)  # of fixed size: the vocabulary file

    def make():
        codec = Codec(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, offsets, counts, sizes, same, at = [], [0], [], [], [], 0
            for text in batch.column(1).to_pylist():
                if text is None:
                    counts.append(None), sizes.append(None), same.append(None), offsets.append(at)
                    continue
                raw, ids = text.encode(), codec.encode(text)
                array = np.frombuffer(ids, "<i4")
                flat.append(array)
                at += len(array)
                counts.append(len(array)), sizes.append(len(raw)), offsets.append(at)
                same.append(codec.decode(array.tolist()) == raw)
            values = pa.array(np.concatenate(flat) if flat else np.array([], np.int32), pa.int32())
            mask = pa.array([c is None for c in counts], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)
            return pa.record_batch([batch.column(0), pa.array(counts, pa.int32()), pa.array(sizes, pa.int64()), ids, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "n_bytes", "token_ids", "round_trip"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), make, "doc_id bigint, n_tokens int, n_bytes bigint, token_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids)."""
    bound_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary() if vocabulary is None else vocabulary)

    def make():
        codec = Codec(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if ids is None else codec.decode(ids).decode() for ids in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return map_batches(encoded.select(F.col("doc_id").cast("bigint"), "token_ids"), make, "doc_id bigint, text string")
