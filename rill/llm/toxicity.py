"""Operator 10: toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of w[t] + sum over pairs of <v[t], v[u]>): the pair term learns that two terms together say
more, or something else, than each alone. Terms are lower-cased runs of letters and digits, hashed to 2**HASH_BITS
buckets; a term that comes back in a document also counts as a second, "repeated" term. Terms are tried whatever their
own relation to the label: one that says nothing by itself can matter in a pair.

Training: labelled rows with crc32(doc_id as text) mod 4 <> 2, at most TRAIN_ROWS of them (those with the least hashes of
doc_id, then of doc_id and text; a documented bound). Labels, lang, source and doc_id are no inputs. The model has the terms that the
training rows show to matter, and goes to the executors once. Scoring is one pass, no shuffle.

Defined cases: null or empty text has no terms and scores as the bias says; without labels, or with one class, the
model is the share of toxic labels (0 if there are none); labels without a document or with nulls are left out; repeated
doc_ids are scored row by row; equal rows with equal labels train once, a doc_id with several texts or labels with each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, id_text, in_pieces, mix, prefix_hash, span_hash

HASH_BITS, FACTORS, INIT = 22, 2, 0.05
TRAIN_ROWS = 20_000
#: Steps over all rows, step size, and what a unit of a linear weight or of a term's factors costs, in rows.
STEPS, RATE, COST, FACTOR_COST = 200, 0.05, 4.0, 2.0
#: Between steps over all terms, steps over those with weights alone; the first steps are over all.
FIRST, ALL_TERMS_EVERY = 10, 38
#: Steps over some terms take the rows in this many parts in turn, if a part has LEAST_PART rows at least.
PARTS, LEAST_PART = 3, 1500
#: Places of terms that are worked on at once.
CHUNK = 1 << 19
THRESHOLD = 0.3
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, and where each text's begin (one more entry than texts)."""
    # upper-case accented Latin letters are two bytes, c3 80..9e, their lower-case forms c3 a0..be
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buf = np.frombuffer(b" ".join(texts).translate(_FOLD), dtype=np.uint8)
    if len(buf) > 1:
        second = np.flatnonzero(buf[:-1] == 0xC3) + 1
        upper = second[(buf[second] >= 0x80) & (buf[second] <= 0x9E) & (buf[second] != 0x97)]
        if len(upper):
            buf = buf.copy()
            buf[upper] += 32
    base = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=base[1:])
    edge = np.flatnonzero(np.diff(_TERM[buf].view(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    h = (span_hash(prefix_hash(buf), start, end) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    doc = np.searchsorted(base, start, side="right") - 1
    key, n = np.unique(doc << HASH_BITS | h, return_counts=True)
    again = key[n > 1]
    twice = (again >> HASH_BITS << HASH_BITS) | (mix((again & ((1 << HASH_BITS) - 1)).astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    key = np.unique(np.concatenate((key, twice)))
    return key & ((1 << HASH_BITS) - 1), np.searchsorted(key >> HASH_BITS, np.arange(len(texts) + 1))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x (by row) over [first[i], first[i + 1]); empty ones are 0."""
    total = np.zeros((len(x) + 1, *x.shape[1:]))
    np.cumsum(x, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class FactorizationMachine:
    """terms: hashed terms that have weights, ascending; w and v: their weights."""

    def __init__(self, terms: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.bias, self.w, self.v = terms, bias, w, v

    def place(self, hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Only the terms that have weights, by their place."""
        if not len(self.terms):
            return hashed[:0], np.zeros_like(first)
        at = np.minimum(np.searchsorted(self.terms, hashed), len(self.terms) - 1)
        known = self.terms[at] == hashed
        return at[known], np.concatenate(([0], np.cumsum(known)))[first]

    def score(self, hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
        at, begin = self.place(hashed, first)
        v = self.v[at]
        s, q = _sums(v, begin), _sums(v * v, begin)
        return _sigmoid(self.bias + _sums(self.w[at], begin) + 0.5 * (s * s - q).sum(axis=1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def loss_gradient(at: np.ndarray, first: np.ndarray, y: np.ndarray, bias: float, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Of the summed log loss of rows, by bias and by each term's weights (linear, then factors). Works on so many rows
    at once as CHUNK places hold."""
    total, out = 0.0, np.zeros(weights.shape)
    cut = [0]
    while cut[-1] < len(y):
        cut.append(max(cut[-1] + 1, int(np.searchsorted(first, first[cut[-1]] + CHUNK, side="right")) - 1))
    for a, z in zip(cut, cut[1:], strict=False):
        mine, begin = at[first[a] : first[z]], first[a : z + 1] - first[a]
        row = np.repeat(np.arange(z - a, dtype=np.int32), np.diff(begin))
        x = weights[mine]
        s = _sums(x, begin)
        x = x[:, 1:]
        g = _sigmoid(bias + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(axis=1) - _sums((x * x).sum(axis=1), begin))) - y[a:z]
        total += float(g.sum())
        mine = mine.astype(np.intp)
        out[:, 0] += np.bincount(mine, g[row], minlength=len(weights))
        for k in range(x.shape[1]):
            out[:, k + 1] += np.bincount(mine, (g * s[:, k + 1])[row] - g[row] * x[:, k], minlength=len(weights))
    return total, out


def fit(hashed: np.ndarray, first: np.ndarray, y: np.ndarray) -> FactorizationMachine:
    """Proximal steps of adaptive size on the summed log loss plus COST times the linear weights' absolute values plus
    FACTOR_COST times the lengths of the terms' factors; so terms that the rows say nothing about end with no weights.
    A term of COST rows or fewer can't overcome the cost and isn't tried. Rows come in an order of their own, so the
    model doesn't depend on partitions."""
    t1, t0 = int(y.sum()), int(len(y) - y.sum())
    if not t1 or not t0:
        rate = t1 / len(y) if len(y) else 0.0
        return FactorizationMachine(np.zeros(0, dtype=np.int64), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), np.zeros(0), np.zeros((0, FACTORS)))
    mixed = np.random.default_rng(11).permutation(len(y))  # so that parts of the rows are alike
    size = np.diff(first)[mixed]
    begin = np.concatenate(([0], np.cumsum(size)))
    hashed, first, y = hashed[np.repeat(first[mixed] - begin[:-1], size) + np.arange(begin[-1])], begin, y[mixed]
    terms, at, rows_of = np.unique(hashed, return_inverse=True, return_counts=True)
    tried = rows_of > COST
    held = tried[at]
    at, first = (np.cumsum(tried) - 1)[at[held]].astype(np.int32), np.concatenate(([0], np.cumsum(held)))[first]
    terms = terms[tried]
    weights = np.zeros((len(terms), 1 + FACTORS))
    weights[:, 1:] = INIT * np.random.default_rng(7).standard_normal((len(terms), FACTORS))
    bias, of_bias = float(np.log(t1 / t0)), np.zeros(2)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    n = len(y)
    parts = PARTS if n >= PARTS * LEAST_PART else 1
    for step in range(1, STEPS + 1):
        every = step <= FIRST or step % ALL_TERMS_EVERY == 0
        if every or step == FIRST + 1 or step % ALL_TERMS_EVERY == 1:
            live = np.arange(len(terms)) if every else np.flatnonzero(weights.any(axis=1))
            here, begin = at, first
            if not every:
                place = np.full(len(terms), -1, dtype=np.int32)
                place[live] = np.arange(len(live))
                here = place[at]
                begin = np.concatenate(([0], np.cumsum(here >= 0)))[first]
                here = here[here >= 0]
        a, z = (0, n) if every else (n * (step % parts) // parts, n * (step % parts + 1) // parts)
        g, grad = loss_gradient(here[begin[a] : begin[z]], begin[a : z + 1] - begin[a], y[a:z], bias, weights[live])
        g, grad = g * n / (z - a), grad * (n / (z - a))
        mean[live] += 0.1 * (grad - mean[live])
        square[live] += 0.02 * (grad * grad - square[live])
        of_bias += (0.1 * (g - of_bias[0]), 0.02 * (g * g - of_bias[1]))
        one, two = 1 - 0.9**step, 1 - 0.98**step
        size = RATE / (np.sqrt(square[live] / two) + 1)
        now = weights[live] - size * mean[live] / one
        now[:, 0] = np.sign(now[:, 0]) * np.maximum(np.abs(now[:, 0]) - size[:, 0] * COST, 0)
        length = np.sqrt((now[:, 1:] ** 2).sum(axis=1))
        now[:, 1:] *= np.maximum(1 - size[:, 1:].mean(axis=1) * FACTOR_COST / np.maximum(length, 1e-12), 0)[:, None]
        weights[live] = now
        bias -= RATE * (of_bias[0] / one) / (np.sqrt(of_bias[1] / two) + 1)
    live = weights.any(axis=1)
    return FactorizationMachine(terms[live], bias, weights[live, 0], weights[live, 1:])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> FactorizationMachine:
    """The driver gets at most `most` rows of hashed terms, whatever repeats in documents or labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out())
    # by their ids alone: texts aren't shuffled, and what is broadcast has `most` rows at most
    there = known.distinct().join(id_text(docs).select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    joined = id_text(docs).join(F.broadcast(chosen), "doc_id").withColumn("at", F.xxhash64("doc_id", "text"))
    last = joined.select("at", "toxic").distinct().orderBy("at", "toxic").limit(most).agg(F.max("at")).first()[0]
    schema = pa.schema([("at", pa.int64()), ("toxic", pa.int32()), ("terms", pa.binary())])

    def run(batches):
        for b in batches:
            for lo, hi, texts in in_pieces(b):
                hashed, first = terms_of(texts)
                yield batch_of(schema, at=b.column("at")[lo:hi], toxic=b.column("toxic")[lo:hi], terms=[hashed[a:z].astype("<u4").tobytes() for a, z in zip(first, first[1:], strict=False)])

    if last is None:
        return fit(np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0))
    chosen = joined.filter(F.col("at") <= last).select("at", "toxic", "text").dropDuplicates(["at", "toxic"])
    rows = arrow_map(chosen, run, "at long, toxic int, terms binary").orderBy("at", "toxic").limit(most).toArrow()
    parts = [np.frombuffer(x, dtype="<u4") for x in rows.column("terms").to_pylist()]
    return fit(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64), np.array(rows.column("toxic").to_pylist(), dtype=float))


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, score."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        fm = spread.value
        for b in batches:
            for lo, hi, texts in in_pieces(b):
                yield batch_of(schema, doc_id=b.column("doc_id")[lo:hi], score=fm.score(*terms_of(texts)))

    return arrow_map(id_text(docs), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
