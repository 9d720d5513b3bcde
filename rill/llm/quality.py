"""Operator 4: text quality from weak labels.

Heuristic labellers that overlap and err vote good, bad or nothing on every document. Expectation-maximisation over the
counts of vote patterns (all documents; bounded by the number of patterns) estimates each labeller's accuracy; the
posterior of a document's pattern is its weak label. A hashed linear scorer learns the weak labels from features that
the labellers don't use as such: how often each shape of word occurs, binned and hashed into 2**HASH_BITS weights. It is
trained on at most TRAIN_ROWS documents (those with the least hash of doc_id and text, equal rows once; a documented
bound) and scores every document. No table of true labels is read.

Three passes over the texts, one only to hash them; nothing is shuffled but counts, hashes and the training rows. Defined cases: null or empty text, and text
without words, gets every vote that such a text earns and is scored like any other; repeated and null doc_ids are rows
like any other; where all documents vote alike the posterior is that of the labellers' majority; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, id_text, in_pieces, mix, words_of

HASH_BITS = 14
TRAIN_ROWS = 20_000
EM_ROUNDS, FIT_ROUNDS = 100, 200
KEEP = 0.5
N_LABELLERS = 8
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other symbol, 1 lower, 2 upper, 3 digit, 4 punctuation, 5 non-ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[44, 46, 59, 58, 63, 33, 39, 34, 40, 41, 45]] = 4


def _share(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    return x / np.maximum(total, 1)


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(votes, shapes) of the texts: votes as one number of 2 bits a labeller (1 bad, 2 good, 0 none); shapes as a count
    of words by shape."""
    h, first, start, end = words_of(texts)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n)
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    kind = _CLASS[raw]
    a, z = start + base[doc], end + base[doc]

    def by_doc(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=flag, minlength=len(texts))

    size = z - a
    last, head = kind[z - 1], kind[a]
    before = kind[np.maximum(z - 2, a)]
    symbol_end = (last == 0) | ((last == 4) & (before == 4) & (size > 1))
    bare = (size == 1) & (last == 0)
    shape = ((head * 6 + before) * 6 + last) * 4 + np.minimum(size // 4, 3)
    shapes = np.bincount(doc * 1024 + shape, minlength=1024 * len(texts)).reshape(-1, 1024)
    uppers = np.concatenate(([0], np.cumsum(kind == 2)))
    letters = np.concatenate(([0], np.cumsum((kind == 1) | (kind == 2) | (kind == 5))))
    upper, letter = uppers[base[1:]] - uppers[base[:-1]], letters[base[1:]] - letters[base[:-1]]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    once = np.unique(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(doc[once], minlength=len(texts))
    symbols, bars = _share(by_doc(symbol_end), n), _share(by_doc(bare), n)
    loud, stutter = _share(upper, letter), _share(by_doc(again), n)
    fresh = np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2))  # of distinct words to words, at any length
    stops, length = _share(by_doc(last == 4), n), _share(by_doc(size), n)
    few = np.full(len(texts), False)
    rules = [
        (symbols > 0.2, symbols < 0.05),
        (bars > 0.1, few),
        (loud > 0.5, loud < 0.25),
        (stutter > 0.2, stutter < 0.05),
        ((fresh < 0.77) & (n >= 20), (fresh > 0.85) & (n >= 20)),
        ((stops < 0.01) & (n >= 20) | (stops > 0.5), (stops > 0.03) & (stops < 0.35)),
        ((length < 2) | (length > 15), (length > 3) & (length < 10)),
        (n < 3, n >= 10),
    ]
    votes = np.zeros(len(texts), dtype=np.int64)
    for k, (bad, good) in enumerate(rules):
        votes |= np.where(bad, 1, np.where(good, 2, 0)).astype(np.int64) << 2 * k
    return votes, shapes


def features(shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and where each row's begin: (shape, binned share of the words)."""
    total = np.maximum(shapes.sum(axis=1, keepdims=True), 1)
    row, shape = np.nonzero(shapes)
    bins = np.round(2 * np.log2(1 + 64 * shapes[row, shape] / total[row, 0])).astype(np.uint64)
    hashed = (mix(shape.astype(np.uint64) * np.uint64(64) + bins + np.uint64(1)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    return hashed, np.searchsorted(row, np.arange(len(shapes) + 1))


def vote_counts(docs: DataFrame) -> list[tuple[int, int]]:
    schema = pa.schema([("votes", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for _, _, texts in in_pieces(b):
                v, n = np.unique(measures(texts)[0], return_counts=True)
                yield batch_of(schema, votes=v, n=n)

    counts = arrow_map(id_text(docs), run, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return sorted((r.votes, r.n) for r in counts.collect())


def estimate(counts: list[tuple[int, int]]) -> dict[int, float]:
    """Posterior of "good" by vote pattern."""
    if not counts:
        return {}
    votes = np.array([[v >> 2 * k & 3 for k in range(N_LABELLERS)] for v, _ in counts])
    n = np.array([c for _, c in counts], dtype=float)
    one = np.eye(3)[votes]
    good, bad = (votes == 2).sum(1), (votes == 1).sum(1)
    post = np.clip((good + 0.5) / (good + 3 * bad + 1.0), 0.02, 0.98)
    for _ in range(EM_ROUNDS):
        weight = np.stack([n * (1 - post), n * post])
        table = np.einsum("ci,ikv->ckv", weight, one) + 0.5
        table /= table.sum(-1, keepdims=True)
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        score = np.log(prior)[:, None] + np.einsum("ikv,ckv->ci", one, np.log(table))
        post = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
    return {v: float(p) for (v, _), p in zip(counts, post, strict=True)}


def fit(hashed: np.ndarray, first: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Weights of the scorer, the last one its bias."""
    w = np.zeros((1 << HASH_BITS) + 1)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    row = np.repeat(np.arange(len(post)), np.diff(first))
    for step in range(1, FIT_ROUNDS + 1 if len(post) else 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[hashed], minlength=len(post)) + w[-1], -30, 30)))
        g = (p - post) / len(post)
        grad = np.append(np.bincount(hashed, g[row], minlength=1 << HASH_BITS), g.sum()) + 1e-5 * w
        m1 += 0.1 * (grad - m1)
        m2 += 0.001 * (grad * grad - m2)
        w -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> tuple[dict[int, float], np.ndarray]:
    """Rows to train on are chosen before features are made: of the least hashes, equal ones once."""
    post = estimate(vote_counts(docs))
    hashed_rows = id_text(docs).withColumn("at", F.xxhash64("doc_id", "text"))
    last = hashed_rows.select("at").distinct().orderBy("at").limit(most).agg(F.max("at")).first()[0]
    if last is None:
        return post, fit(np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0))
    chosen = hashed_rows.filter(F.col("at") <= last).select("at", "text").dropDuplicates(["at"])
    schema = pa.schema([("at", pa.int64()), ("votes", pa.int64()), ("features", pa.binary())])

    def run(batches):
        for b in batches:
            for lo, hi, texts in in_pieces(b):
                votes, shapes = measures(texts)
                hashed, first = features(shapes)
                yield batch_of(schema, at=b.column("at")[lo:hi], votes=votes, features=[hashed[a:z].astype("<u2").tobytes() for a, z in zip(first, first[1:], strict=False)])

    rows = arrow_map(chosen, run, "at long, votes long, features binary").orderBy("at").toArrow()
    parts = [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in rows.column("features").to_pylist()]
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return post, fit(np.concatenate(parts), first, np.array([post[v] for v in rows.column("votes").to_pylist()]))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, votes (pattern), weak_label (posterior), score, kept."""
    spread = docs.sparkSession.sparkContext.broadcast(train(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.int64()), ("weak_label", pa.float64()), ("score", pa.float64())])

    def run(batches):
        post, w = spread.value
        for b in batches:
            for lo, hi, texts in in_pieces(b):
                votes, shapes = measures(texts)
                hashed, first = features(shapes)
                row = np.repeat(np.arange(len(texts)), np.diff(first))
                x = np.bincount(row, w[hashed], minlength=len(texts)) + w[-1]
                yield batch_of(schema, doc_id=b.column("doc_id")[lo:hi], votes=votes, weak_label=[post.get(v, 0.5) for v in votes.tolist()], score=1 / (1 + np.exp(-np.clip(x, -30, 30))))

    scored = arrow_map(id_text(docs), run, "doc_id long, votes long, weak_label double, score double")
    return scored.withColumn("kept", F.col("score") >= KEEP)
