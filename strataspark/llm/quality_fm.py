"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words (hashed to 2**bits slots, each of value ``word_value``), the levels of its
structure statistics, and its language and source (value 1). The machine's score

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

takes time linear in the features. Two heads share the features: quality (labels.quality) and toxicity (labels.toxic).
A document is kept if its quality is at least ``least_quality`` and its toxicity at most ``most_toxicity``.

Training runs on the driver over at most about ``train_rows`` labelled documents, chosen by a hash of doc_id; all else
covers the whole table. Features in fewer than ``least_df`` of the training documents have no weight.

Defined results: null or empty texts have no words and the statistics of an empty text; null lang and source are
values like any other; labels with nulls, and labels without a document, aren't used; several labels or documents of one
doc_id are all used; without labelled documents, or with labels of one class only, a head says 1 (quality) or 0 (toxicity),
so nothing is rejected for it; repeated rows get equal scores; columns other than these are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .textkit import map_batches

EDGES = ".,;:!?*$&%#|\"'()[]{}<>-_"


@dataclass(frozen=True)
class Params:
    bits: int = 18
    factors: int = 8
    word_value: float = 1.0
    train_rows: int = 12_000
    least_df: int = 4
    epochs: int = 12
    rate: float = 1.0
    rate_pairs: float = 0.02
    l1: float = 10.0
    l2: float = 1e-3
    seed: int = 11
    least_quality: float = 0.5
    most_toxicity: float = 0.5


class Features:
    """Feature slots of a document: words below 2**bits, then statistics and metadata."""

    def __init__(self, bits: int):
        import xxhash

        self.mask, self.digest, self.known = (1 << bits) - 1, xxhash.xxh3_64_intdigest, {}

    def word(self, raw: str) -> int:
        return self.digest(raw.strip(EDGES).encode()) & self.mask

    def other(self, name: str) -> int:
        return self.mask + 1 + (self.digest(name.encode()) & 0xFFF)

    def statistics(self, text: str, words: list[str], distinct: int) -> list[str]:
        n = max(1, len(words))
        lines = [x for x in text.split("\n") if x]
        signs = sum(map(text.count, "*$%&#!|"))
        values = {
            "signs": signs / n,
            "upper": sum(map(str.isupper, words)) / n,
            "distinct": distinct / n,
            "lines": len(set(lines)) / max(1, len(lines)),
            "mean": len(text) / n / 10,
        }
        out = [f"{k}:{min(20, int(v * 10))}" for k, v in values.items()]
        return [*out, f"length:{int(math.log2(n))}"]

    def __call__(self, text: str | None, lang: str | None, source: str | None) -> list[int]:
        text = text or ""
        words = text.split()
        known = self.known
        distinct = set(words)
        slots = set()
        for w in distinct:
            slot = known.get(w)
            if slot is None:
                if len(known) > 200_000:
                    known.clear()
                slot = known[w] = self.word(w.lower())
            slots.add(slot)
        extra = [*self.statistics(text, words, len(distinct)), f"lang={lang}", f"source={source}"]
        return [*sorted(slots), *sorted({self.other(x) for x in extra})]


@dataclass
class Model:
    """rows: feature slot -> row of w and v, -1 where it has no weight; a head is a column of w0 and w, a slice of v."""

    rows: np.ndarray
    w0: np.ndarray
    w: np.ndarray
    v: np.ndarray
    constant: tuple
    bits: int
    word_value: float

    def scores(self, lists: list[list[int]]) -> np.ndarray:
        """Probabilities (documents x heads)."""
        lengths = np.array([len(x) for x in lists])
        slots = np.concatenate([np.array(x, np.int64) for x in lists]) if len(lists) else np.array([], np.int64)
        doc = np.repeat(np.arange(len(lists)), lengths)
        at = self.rows[slots]
        keep = at >= 0
        return self.of(at[keep], doc[keep], np.where(slots[keep] < 1 << self.bits, np.float32(self.word_value), np.float32(1)), len(lists))

    def of(self, at, doc, x, n) -> np.ndarray:
        starts = np.searchsorted(doc, np.arange(n + 1))
        add = lambda a: np.add.reduceat(np.concatenate([a, np.zeros((1, *a.shape[1:]), a.dtype)]), np.minimum(starts[:-1], len(a))) * (starts[1:] > starts[:-1]).reshape(-1, *[1] * (a.ndim - 1))
        out = np.zeros((n, 2))
        for h in range(2):
            if self.constant[h] is not None:
                out[:, h] = self.constant[h]
                continue
            vx = self.v[at, h] * x[:, None]
            score = self.w0[h] + add(self.w[at, h] * x) + 0.5 * (add(vx) ** 2 - add(vx**2)).sum(1)
            out[:, h] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return out


def train(lists: list[np.ndarray], labels: np.ndarray, p: Params) -> Model:
    """Log loss, weighted to balance the classes of each head; rows are in the given order.

    w is learnt by FTRL-proximal with an L1 term, so that words of no bearing get no weight; v by Adagrad, for the
    features that have a w.
    """
    size = (1 << p.bits) + 4096
    df = np.zeros(size, np.int64)
    for x in lists:
        df[x] += 1
    rows = np.full(size, -1, np.int32)
    used = np.flatnonzero(df >= p.least_df)
    rows[used] = np.arange(len(used))
    m, rng = len(used), np.random.default_rng(p.seed)
    w0, w, v = np.zeros(2), np.zeros((m, 2), np.float32), np.zeros((m, 2, p.factors), np.float32)
    constant: list = [None, None]
    docs = [(r := rows[x])[r >= 0] for x in lists]
    values = [np.where(x[rows[x] >= 0] < 1 << p.bits, np.float32(p.word_value), np.float32(1)) for x in lists]
    for h in range(2):
        y = labels[:, h].astype(np.float64) if len(labels) else np.zeros(0)
        if len(np.unique(y)) < 2:
            constant[h] = (1.0, 0.0)[h]
            continue
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        wh, z, n = np.zeros(m), np.zeros(m), np.zeros(m)
        vh, gv, bias, gb = rng.normal(0, 0.01, (m, p.factors)), np.full((m, p.factors), 1e-2), 0.0, 1e-2
        for _ in range(p.epochs):
            order = rng.permutation(len(docs))
            for part in np.array_split(order, max(1, len(order) // 128)):
                lens = [len(docs[i]) for i in part]
                at, x = np.concatenate([docs[i] for i in part]), np.concatenate([values[i] for i in part])
                doc = np.repeat(np.arange(len(part)), lens)
                ux, inv = np.unique(at, return_inverse=True)
                live = wh[at] != 0
                vx = vh[at] * (x * live)[:, None]
                sums = np.stack([np.bincount(doc, vx[:, f], len(part)) for f in range(p.factors)], 1)
                squares = np.bincount(doc, (vx**2).sum(1), len(part))
                score = bias + np.bincount(doc, wh[at] * x, len(part)) + 0.5 * ((sums**2).sum(1) - squares)
                g = weight[part] * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[part])
                each = g[doc] * x
                dw = np.bincount(inv, each, len(ux))
                z[ux] += dw - (np.sqrt(n[ux] + dw**2) - np.sqrt(n[ux])) / p.rate * wh[ux]
                n[ux] += dw**2
                wh[ux] = np.where(np.abs(z[ux]) > p.l1, (np.sign(z[ux]) * p.l1 - z[ux]) / ((1 + np.sqrt(n[ux])) / p.rate + p.l2), 0)
                on = np.flatnonzero(live)
                few, back = np.unique(at[on], return_inverse=True)
                dv = np.stack([np.bincount(back, each[on] * (sums[doc[on], f] - vx[on, f]), len(few)) for f in range(p.factors)], 1) / len(part) * 16 + p.l2 * vh[few]
                gv[few] += dv**2
                vh[few] -= p.rate_pairs * dv / np.sqrt(gv[few])
                gb += g.sum() ** 2
                bias -= p.rate * g.sum() / math.sqrt(gb)
        w0[h], w[:, h], v[:, h] = bias, wh, np.where(wh[:, None] != 0, vh, 0)
    return Model(rows, w0, w, v, tuple(constant), p.bits, p.word_value)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))


def _sample(labels: DataFrame, p: Params) -> DataFrame:
    """Labelled ids (doc_id, quality, toxic): all of them, or about ``train_rows`` by a hash of doc_id."""
    usable = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int"), F.col("toxic").cast("int")).dropna()
    count = usable.count()
    if count <= p.train_rows:
        return usable
    return usable.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(p.seed)), F.lit(1_000_000)) < int(1e6 * p.train_rows / count))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """The model of the labelled documents. The sample's ids are broadcast: ``train_rows`` bounds their number."""
    bound_batches(docs.sparkSession)
    labelled = _columns(docs).join(F.broadcast(_sample(labels, p)), "doc_id")

    def make():
        features = Features(p.bits)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, text, lang, source, quality, toxic = (c.to_pylist() for c in batch.columns)
            slots = [np.array(features(*row), "<u4").tobytes() for row in zip(text, lang, source)]
            return pa.record_batch([batch.column(0), pa.array(slots, pa.binary()), pa.array(quality, pa.int32()), pa.array(toxic, pa.int32())], ["doc_id", "slots", "quality", "toxic"])

        return step

    rows = map_batches(labelled, make, "doc_id bigint, slots binary, quality int, toxic int").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.slots), r.quality, r.toxic))
    lists = [np.frombuffer(bytes(r.slots), "<u4").astype(np.int64) for r in rows]
    return train(lists, np.array([(r.quality > 0, r.toxic > 0) for r in rows]).reshape(-1, 2), p)


def _scorer(shared, p: Params):
    """text, lang and source lists -> probabilities (documents x 2)."""
    features, model = Features(p.bits), shared.value
    return lambda text, lang, source: model.scores([features(*row) for row in zip(text, lang, source)])


def score(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, quality, toxicity, keep) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, p))  # bounded by 2**bits slots

    def make():
        scorer = _scorer(shared, p)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scorer(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
            keep = (found[:, 0] >= p.least_quality) & (found[:, 1] <= p.most_toxicity)
            return pa.record_batch([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(keep)], ["doc_id", "quality", "toxicity", "keep"])

        return step

    return map_batches(_columns(docs), make, "doc_id bigint, quality double, toxicity double, keep boolean")


def keep(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, p))
    places = [docs.columns.index(c) for c in ("text", "lang", "source")]

    def make():
        scorer = _scorer(shared, p)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scorer(*(batch.column(i).to_pylist() for i in places))
            return batch.filter(pa.array((found[:, 0] >= p.least_quality) & (found[:, 1] <= p.most_toxicity)))

        return step

    return map_batches(docs, make, docs.schema)
