"""Toxicity scores by a factorization machine over hashed terms.

Terms are lower-cased words and their first four and five bytes, hashed into
``2 ** BITS`` slots; a document has a term or not. The score is the logistic of a bias,
a weight a term, and the inner product of two factor vectors for each pair of terms in
the document, summed in linear time. The model is fitted on the driver on a bounded
sample: at most ``SAMPLE_ROWS`` labelled documents whose terms take at most
``SAMPLE_BYTES`` (documented parameters), chosen by hash from those whose crc32(doc_id)
mod 5 is not 0. All documents are scored whole.

Weights alone are fitted first, to the terms that go with the label beyond chance. What
they leave over is then summed for all pairs of the ``PAIR_TERMS`` most frequent terms:
a pair that is toxic, or clean, only together stands out there, even if neither term says
anything alone. The leading eigenvectors of these sums are the first factors of such
terms, and weights and factors are then learned together.

Null or empty texts have no terms and score the bias; null ids are never learned from
and count as held out only if the crc32 of the empty text says so; labels that repeat
for an id count once (toxic wins); of several texts of one id the one with the least hash
is learned from; rows with a null label are left out; without labels of both classes the
score is the share of toxic labels (0 without any). Repeated rows are all scored; ties (a
score of 0.5) count as toxic; a very long text is scored whole, alone in its step; an
empty table gives an empty one; other columns are kept, but one named ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, tidy
from .textvec import LOWER, chunks, span_hashes, words

BITS = 18
FACTORS = 8
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 48 << 20
LEAST_DOCS = 3
LEAST_Z = 4.0
PAIR_TERMS = 1536
PAIR_Z = 8.0
PAIR_SHARE = 0.75
MOST_PAIRS = 1000
EPOCHS = 12
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[97:123] = _GAP[128:] = False


def chunk_terms(buf: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the distinct terms of each text, sorted."""
    low = LOWER[buf]
    starts, ends, first = words(low, off, _GAP)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    keys = []
    for kind, length in enumerate((0, 4, 5)):
        long = ends - starts >= length
        s, t = starts[long], text[long]
        h = span_hashes(low, s, ends[long] if not length else s + length)
        slot = ((h + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            use = wanted[slot]
            slot, t = slot[use], t[use]
        keys.append(t << BITS | slot)
    both = np.unique(np.concatenate(keys))
    return both >> BITS, both & (1 << BITS) - 1


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 2)):
        out = []
        for _, buf, off in chunks(batch.column(2)):
            text, slot = chunk_terms(buf, off)
            bounds = np.searchsorted(text, np.arange(len(off)))
            slot = slot.astype("<u4")
            out += [slot[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "toxic", "terms"])


class Machine:
    """Bias, weights and factors, with the learning and the scoring."""

    def __init__(self, bias: float, weights: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias, self.weights, self.factors = bias, weights, factors
        self.wanted = None if weights is None else (weights != 0) | (factors != 0).any(1)

    def raw(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(rows, self.weights[slots], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[slots, f].astype(np.float64)
            out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return out

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.weights is None:
            return np.full(n, self.bias)
        rows, slots = chunk_terms(buf, off, self.wanted)
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, slots, n), -40, 40)))

    @classmethod
    def fit(cls, terms: list[np.ndarray], labels: np.ndarray, seed: int = 5, pairs: bool = True) -> Machine:
        """``pairs``: look for pairs of terms (else factors belong to telling terms only)."""
        n = len(labels)
        share = float(labels.mean()) if n else 0.0
        if share in (0.0, 1.0):
            return cls(share)
        size = 1 << BITS
        docs = np.bincount(np.concatenate(terms), minlength=size)
        bad = np.bincount(np.concatenate([t for t, y in zip(terms, labels, strict=True) if y]), minlength=size)
        # Terms that go with the label beyond chance; the others would only add noise to
        # long texts.
        z = (bad - docs * share) / np.sqrt(np.maximum(docs * share * (1 - share), 1e-9))
        alone = (docs >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)
        rng = np.random.default_rng(seed)
        first = cls._learn([t[alone[t]] for t in terms], labels, np.zeros((size, 0), np.float32), np.zeros(size, bool), rng)
        v = rng.normal(0, 0.01, (size, FACTORS)).astype(np.float32) * alone[:, None]
        paired = np.zeros(size, bool)
        if pairs:
            slots, start = leading_pairs(terms, labels, first.on(terms), docs)
            paired[slots] = True
            v[slots] += start
        use = alone | paired
        return cls._learn([t[use[t]] for t in terms], labels, v, use, rng)

    def on(self, terms: list[np.ndarray]) -> np.ndarray:
        """The scores of documents given by their terms."""
        out = []
        for lo in range(0, len(terms), 1000):
            part = [t[self.wanted[t]] for t in terms[lo : lo + 1000]]
            rows = np.repeat(np.arange(len(part)), [len(t) for t in part])
            out.append(self.raw(rows, np.concatenate(part).astype(np.int64), len(part)))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -40, 40)))

    @classmethod
    def _learn(cls, terms: list[np.ndarray], labels: np.ndarray, v: np.ndarray, use: np.ndarray, rng: np.random.Generator) -> Machine:
        """Weights and factors by gradient steps (Adagrad) on small batches."""
        n, size, factors = len(labels), len(v), v.shape[1]
        share = float(labels.mean())
        bias, w = np.log(share / (1 - share)), np.zeros(size)
        v = v.astype(np.float64)
        gw, gv, gb = np.full(size, 1e-3), np.full((size, factors), 1e-2), 1.0
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for lo in range(0, n, 256):
                part = order[lo : lo + 256]
                rows = np.repeat(np.arange(len(part)), [len(terms[i]) for i in part])
                slots = np.concatenate([terms[i] for i in part]).astype(np.int64)
                m = cls.__new__(cls)
                m.bias, m.weights, m.factors = bias, w, v
                p = 1 / (1 + np.exp(-np.clip(m.raw(rows, slots, len(part)), -40, 40)))
                err = (p - labels[part]) / len(part)
                seen, back = np.unique(slots, return_inverse=True)
                e = err[rows]
                g = np.bincount(back, e, len(seen)) + 1e-6 * w[seen]
                gw[seen] += g * g
                w[seen] -= 0.3 * g / np.sqrt(gw[seen])
                for f in range(factors):
                    x = v[slots, f]
                    total = np.bincount(rows, x, len(part))
                    g = np.bincount(back, e * (total[rows] - x), len(seen)) + 1e-5 * v[seen, f]
                    gv[seen, f] += g * g
                    v[seen, f] -= 0.05 * g / np.sqrt(gv[seen, f])
                gb += err.sum() ** 2
                bias -= 0.1 * err.sum() / np.sqrt(gb)
        return cls(float(bias), w.astype(np.float32), (v * use[:, None]).astype(np.float32))


def leading_pairs(terms: list[np.ndarray], labels: np.ndarray, scores: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of pairs of terms that the scores leave unexplained, and first factors for them.

    For each pair the labels' excess over the scores is summed over the documents that
    have both terms, and set against its spread. All pairs of the most frequent terms are
    looked at, by matrix products over small batches of documents.
    """
    count = np.where(docs <= PAIR_SHARE * len(labels), docs, 0)
    slots = np.sort(np.argsort(-count, kind="stable")[:PAIR_TERMS])
    slots = slots[count[slots] >= LEAST_DOCS]
    none = np.empty(0, np.int64), np.empty((0, FACTORS), np.float32)
    if len(slots) < 2:
        return none
    place = np.full(len(docs), -1, np.int64)
    place[slots] = np.arange(len(slots))
    over, spread = (np.zeros((len(slots), len(slots)), np.float32) for _ in range(2))
    for lo in range(0, len(labels), 500):
        part = [place[t] for t in terms[lo : lo + 500]]
        x = np.zeros((len(part), len(slots)), np.float32)
        for i, at in enumerate(part):
            x[i, at[at >= 0]] = 1
        y, p = labels[lo : lo + 500], scores[lo : lo + 500]
        over += x.T @ (x * (y - p).astype(np.float32)[:, None])
        spread += x.T @ (x * (p * (1 - p)).astype(np.float32)[:, None])
    np.fill_diagonal(over, 0)
    spread += 1
    i, j = np.nonzero(over * over >= PAIR_Z**2 * spread)
    i, j = i[i < j], j[i < j]
    strong = np.abs(over[i, j]) / np.sqrt(spread[i, j])
    best = np.argsort(-strong, kind="stable")[:MOST_PAIRS]
    i, j = i[best], j[best]
    if not len(i):
        return none
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    step = np.zeros((len(used), len(used)))
    a, b = back[: len(i)], back[len(i) :]
    # One step towards the pair's own coefficient.
    step[a, b] = step[b, a] = np.clip(over[i, j] / spread[i, j], -4, 4)
    value, vector = np.linalg.eigh(step)
    top = np.argsort(-value)[:FACTORS]
    factors = np.zeros((len(used), FACTORS), np.float32)
    factors[:, : len(top)] = vector[:, top] * np.sqrt(np.maximum(value[top], 0))
    return slots[used], factors


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Machine:
    known = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0)
    one = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # At most sample_rows rows of two numbers: a bounded broadcast.
    sample = F.broadcast(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    held = materialize(rows.mapInArrow(tidy(_terms), "doc_id long, toxic int, terms binary"), "terms")
    sizes = sorted((r["h"], r["doc_id"], r["n"]) for r in held.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.length("terms").alias("n")).collect())
    total = np.cumsum([n for _, _, n in sizes])
    fits = int(np.searchsorted(total, sample_bytes, "right"))
    if fits < len(sizes):
        held = held.where(F.xxhash64("doc_id") < F.lit(sizes[max(fits, 1)][0]))
    got = held.collect()
    got.sort(key=lambda r: r["doc_id"])
    return Machine.fit([np.frombuffer(r["terms"], "<u4") for r in got], np.array([r["toxic"] > 0 for r in got], np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of ``docs`` and score."""
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            parts = [m.score(buf, off) for _, buf, off in chunks(batch.column(place).cast(pa.string()))]
            scores = pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    machine = train(docs, labels)
    place = rows.withColumn("held_out", fold(F.col("doc_id")) == 0)
    scored = score(place, machine)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
