"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are joined on shared seeds (``min_match`` tokens in a row). What the seeds cover bounds
from above what tiles can cover, so pairs under the threshold are dropped exactly. On the rest, Running Karp-Rabin
marks the longest matches that do not overlap, again and again, until none of ``min_match`` tokens is left; reordered
passages are found because every tile counts, wherever it stands. The share of an item's tokens under tiles is its
coverage.

The seed table is held in memory by each task. A benchmark of more than ``slice_items`` items is taken in slices of about so
many different texts, one after another, so that neither the driver nor a task holds more. A filter of all its seeds (256 MB
at most) first finds the documents that have any; only these are read again for each slice.

Defined results: tokens are lower-cased runs of word characters; a null or empty text matches nothing; items of null
text or of fewer than ``min_match`` tokens match nothing; a null doc_id or item_id is carried along; repeated documents
or items give repeated rows; of equally long matches the first in the item, then in the document, is marked first; an
empty table on either side gives no matches; ids that don't cast to bigint are an error; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, discard, materialise
from .textkit import M1, WordHasher, bloom_filter, in_filter, join_checked, map_batches, mix, shingles

WORD = re.compile(r"\w+")
PRIME, BASE = (1 << 61) - 1, 1_000_003


@dataclass(frozen=True)
class Params:
    min_match: int = 4
    coverage: float = 0.6
    first_length: int = 16  # the search length that Running Karp-Rabin begins with
    slice_items: int = 20_000
    broadcast_rows: int = 300_000


def _windows(tokens: list[int], marked: list[bool], s: int):
    """(start, hash) of the windows of ``s`` unmarked tokens; a None token ends a window."""
    top, h, run = pow(BASE, s - 1, PRIME), 0, 0
    for i, x in enumerate(tokens):
        if x is None or marked[i]:
            h = run = 0
            continue
        if run >= s:
            h = (h - tokens[i - s] * top) % PRIME
        h = (h * BASE + x) % PRIME
        run += 1
        if run >= s:
            yield i - s + 1, h


def tile(item: list[int], text: list[int | None], min_match: int, first_length: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, length), each token in one tile at most; None in ``text`` matches nothing."""
    in_item, in_text = [False] * len(item), [False] * len(text)
    tiles, s = [], max(min_match, min(first_length, len(item)))
    while True:
        table = defaultdict(list)
        for i, h in _windows(item, in_item, s):
            table[h].append(i)
        found, longest = defaultdict(list), 0
        for j, h in _windows(text, in_text, s):
            for i in table.get(h, ()):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not in_item[i + n] and not in_text[j + n]:
                    n += 1
                if n >= s:
                    found[n].append((i, j))
                    longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        for n in sorted(found, reverse=True):
            for i, j in sorted(found[n]):
                if not any(in_item[i : i + n]) and not any(in_text[j : j + n]):
                    in_item[i : i + n] = in_text[j : j + n] = [True] * n
                    tiles.append((i, j, n))
        # A match that a longer one overlapped may have a free part: the same length is searched again until nothing is marked.
        if found and longest >= s and any(n >= s for n in found):
            if _again(item, text, in_item, in_text, s):
                continue
        if s == min_match:
            return tiles
        s = max(min_match, s // 2)


def _again(item, text, in_item, in_text, s) -> bool:
    left = {h for _, h in _windows(item, in_item, s)}
    return bool(left) and any(h in left for _, h in _windows(text, in_text, s))


class Seeds:
    """The seeds of benchmark items; ``matches`` tiles one document against all of them."""

    def __init__(self, items: list[tuple[int | None, str | None]], p: Params):
        self.p, self.ids, self.tokens, self.words = p, [], [], {}
        for item_id, text in items:
            words = WORD.findall((text or "").lower())
            if len(words) >= p.min_match:
                self.ids.append(item_id)
                self.tokens.append([self.words.setdefault(w, len(self.words) + 1) for w in words])
        places = defaultdict(list)
        for n, tokens in enumerate(self.tokens):
            for at, h in enumerate(self._grams(np.array(tokens, np.uint64)).tolist()):
                places[h].append((n, at))
        self.hashes = np.array(sorted(places), np.uint64)
        self.places = [places[h] for h in self.hashes.tolist()]

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        k, n = self.p.min_match, len(ids) - self.p.min_match + 1
        out = np.zeros(max(0, n), np.uint64)
        for i in range(k if n > 0 else 0):
            out = out * M1 + mix(ids[i : i + n] + np.uint64(i << 40))
        return out

    def matches(self, text: str | None) -> list[tuple]:
        """(item_id, coverage, matched tokens, item tokens, tiles) of the items covered to the threshold."""
        k, get = self.p.min_match, self.words.get
        if not text or not len(self.hashes):
            return []
        ids = np.array([get(w, 0) for w in WORD.findall(text.lower())], np.uint64)
        if len(ids) < k:
            return []
        known = np.cumsum(np.concatenate([[0], ids == 0]))
        at = np.flatnonzero(known[k:] == known[:-k])
        if not len(at):
            return []
        grams = np.zeros(len(at), np.uint64)
        for i in range(k):
            grams = grams * M1 + mix(ids[at + i] + np.uint64(i << 40))
        where = np.searchsorted(self.hashes, grams)
        where[where == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[where] == grams)
        by_item = defaultdict(lambda: (set(), set()))
        for h in hit.tolist():
            for item, place in self.places[where[h]]:
                seen, starts = by_item[item]
                seen.add(place)
                starts.add(int(at[h]))
        out = []
        for item in sorted(by_item):
            places, starts = by_item[item]
            tokens = self.tokens[item]
            covered = len({q for x in places for q in range(x, x + k)})
            if covered < self.p.coverage * len(tokens):
                continue
            positions, part, last = [], [], None
            for x in sorted({q for s in starts for q in range(s, s + k)}):
                if last is not None and x != last + 1:
                    part.append(None)
                    positions.append(-1)
                part.append(int(ids[x]))
                positions.append(x)
                last = x
            tiles = [(i, positions[j], n) for i, j, n in tile(tokens, part, k, self.p.first_length)]
            matched = sum(n for *_, n in tiles)
            if matched >= self.p.coverage * len(tokens):
                out.append((self.ids[item], matched / len(tokens), matched, len(tokens), sorted(tiles)))
        return out


def _few(benchmark: DataFrame, p: Params) -> list[tuple] | None:
    """The items, if they are no more than a slice."""
    items = benchmark.select("item_id", "text").limit(p.slice_items + 1).collect()
    return [tuple(r) for r in items] if len(items) <= p.slice_items else None


MATCHES = "doc_id bigint, item_id bigint, coverage double, matched int, item_tokens int, tiles array<struct<item_start:int,doc_start:int,length:int>>"
TILES = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))


def _tiled(docs: DataFrame, items: list[tuple], p: Params, schema: str, item: pa.DataType) -> DataFrame:
    """A row for each of docs(id, text) and each item that it covers; ``schema``: as MATCHES, with the types of both ids."""

    def make():
        seeds = Seeds(items, p)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, *found[:4], [dict(zip(("item_start", "doc_start", "length"), t)) for t in found[4]]) for i, text in enumerate(batch.column(1).to_pylist()) for found in seeds.matches(text)]
            kinds = [item, pa.float64(), pa.int32(), pa.int32(), TILES]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int32()))
            return pa.record_batch([ids, *[pa.array([r[i + 1] for r in rows], kind) for i, kind in enumerate(kinds)]], [x.split(" ")[0] for x in schema.split(", ")])

        return step

    return map_batches(docs, make, schema)


def _in_slices(texts: DataFrame, benchmark: DataFrame, p: Params) -> DataFrame:
    """As MATCHES, but ids are the MD5 of the texts: matches of texts(id, text), of different ones, with a large benchmark."""
    spark = texts.sparkSession
    items = benchmark.select(F.md5("text").alias("id"), "text").filter("id IS NOT NULL").dropDuplicates(["id"])
    parts = -(-items.count() // p.slice_items)
    items = materialise(items.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(parts))), "items")

    def grams():
        hasher = WordHasher()
        return lambda text: shingles(hasher(words), p.min_match) if len(words := WORD.findall((text or "").lower())) >= p.min_match else np.array([], np.uint64)

    def seeds():
        of = grams()
        return lambda batch: pa.record_batch([pa.array(np.concatenate([of(t) for t in batch.column(0).to_pylist()]).view(np.int64))], ["key"])

    table, bits = bloom_filter(map_batches(items.select("text"), seeds, "key bigint"))
    shared = spark.sparkContext.broadcast(table)

    def touched():
        of, joined = grams(), np.frombuffer(b"".join(shared.value), np.uint8)
        return lambda batch: batch.filter(pa.array([bool(in_filter(of(t), joined, bits).any()) for t in batch.column(1).to_pylist()], pa.bool_()))

    near = materialise(map_batches(texts, touched, "id string, text string"), "touched")
    shared.unpersist()
    schema, out = MATCHES.replace("doc_id bigint, item_id bigint", "doc string, item string"), None
    for i in range(parts):
        one = [tuple(r) for r in items.filter(F.col("slice") == i).select("id", "text").collect()]
        part = materialise(_tiled(near, one, p, schema, pa.string()), "tiled")
        out = part if out is None else out.unionByName(part)
    discard(items, near)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """A row for each document and benchmark item of which the document's tiles cover the threshold or more."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    if (items := _few(benchmark, p)) is not None:
        return _tiled(texts, items, p, MATCHES, pa.int64())
    found = _in_slices(texts.select(F.md5("text").alias("id"), "text").filter("id IS NOT NULL").dropDuplicates(["id"]), benchmark, p)
    named = found.join(texts.select("doc_id", F.md5("text").alias("doc")), "doc").join(benchmark.select(F.col("item_id").cast("bigint"), F.md5("text").alias("item")), "item")
    return named.select(*[x.split(" ")[0] for x in MATCHES.split(", ")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` without the documents that cover a benchmark item to the threshold; rows and columns stay as they are."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    if (items := _few(benchmark, p)) is None:
        texts = docs.select(F.md5("text").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL").dropDuplicates(["id"])
        found = materialise(_in_slices(texts, benchmark, p).select("doc").distinct(), "contaminated")
        name = "__doc"
        while name in (c.lower() for c in docs.columns):
            name += "_"
        return join_checked(docs.withColumn(name, F.md5("text")), found.withColumnRenamed("doc", name), [name], "left_anti", p.broadcast_rows).select(*docs.columns)

    def make():
        seeds = Seeds(items, p)
        return lambda batch: batch.filter(pa.array([not seeds.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, make, docs.schema)
