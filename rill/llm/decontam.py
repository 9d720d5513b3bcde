"""Operator 8: benchmark decontamination by greedy string tiling.

Seeds are runs of SEED words that a document and a benchmark item share (shorter items seed with all their words), found
by their hashes as in Karp and Rabin's search and compared word by word. Seeds on one diagonal join into maximal
matches; the longest match is marked first, then the longest of what is left unmarked, and so on, so that every word
belongs to one tile at most. The share of the item's words in tiles is its coverage, whatever order the passages stand in.

A seed that more than COMMON items have leads only to those items that common seeds alone can cover enough; any other
item has to share a rarer seed as well to reach the share. Of a candidate the words under all shared seeds are counted
first, and only if they reach the share is it tiled. So a phrase that all items begin with doesn't pair every item with
every document that has it, and nothing that reaches the share is left out.

The benchmark is a stated query set: it goes to the executors in blocks of at most BLOCK_WORDS words, one pass over the
documents for each block (one, unless the benchmark is very large). Documents aren't shuffled.

Defined cases: null or empty texts, and items without words, match nothing; repeated doc_ids, item_ids or texts each
give rows of their own; null ids are kept; no rows on either side give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, id_text, in_pieces, mix, words_of

SEED = 5
LEAST_TILE = 5
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000
#: Items that may share a seed before it is a common one; seeds of one document and item that are expanded at once.
COMMON, EXPAND = 64, 1 << 20
_BLOOM_BITS = 22


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words, whatever text they belong to."""
    if len(h) < width:
        return h[:0]
    x = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        x = mix(x * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - width + 1 + k])
    return x


def covered(at: np.ndarray, width: int, n: int) -> int:
    """Words of n under the runs of width words from each place."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


class SeedIndex:
    """Of one block of items: by seed width, sorted seed hashes and the items that they lead to."""

    def __init__(self, items: list[tuple[int | None, str]], share: float, common: int = COMMON):
        self.ids, self.share = [i for i, _ in items], share
        self.words, self.first, _, _ = words_of([t.encode() for _, t in items]) if items else (np.zeros(0, np.uint64), np.zeros(1, np.int64), None, None)
        self.sizes = np.diff(self.first)
        self.by_width = {}
        for width in sorted({min(SEED, int(n)) for n in self.sizes if n}):
            seeds, item = [], []
            chosen = np.flatnonzero(np.minimum(self.sizes, SEED) == width)
            for k in chosen:
                x = self.seeds(k, width)
                seeds.append(x)
                item.append(np.full(len(x), k))
            pairs = np.unique(np.stack([np.concatenate(seeds).view(np.int64), np.concatenate(item)], axis=1), axis=0)
            seed, item = pairs[:, 0].view(np.uint64), pairs[:, 1]
            _, place, n = np.unique(seed, return_inverse=True, return_counts=True)
            many = np.unique(seed[n[place] > common])
            heavy = [k for k in chosen if len(many) and covered(np.flatnonzero(np.isin(self.seeds(k, width), many)), width, int(self.sizes[k])) >= share * self.sizes[k]]
            leads = (n[place] <= common) | np.isin(item, heavy)
            order = np.argsort(seed[leads], kind="stable")
            maybe = np.zeros(1 << _BLOOM_BITS, dtype=bool)
            maybe[seed[leads] >> np.uint64(64 - _BLOOM_BITS)] = True
            self.by_width[width] = (seed[leads][order], item[leads][order], maybe)

    def of_item(self, k: int) -> np.ndarray:
        return self.words[self.first[k] : self.first[k + 1]]

    def seeds(self, k: int, width: int) -> np.ndarray:
        return runs(self.of_item(k), width)

    def candidates(self, words: np.ndarray, first: np.ndarray):
        """(document, width, items) of a batch of texts, for each document that has a seed leading somewhere."""
        for width, (seeds, item, maybe) in self.by_width.items():
            x = runs(words, width)
            if not len(x) or not len(seeds):
                continue
            at = np.flatnonzero(maybe[x >> np.uint64(64 - _BLOOM_BITS)])
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at + width <= first[doc + 1]
            at, doc = at[inside], doc[inside]
            lo, hi = np.searchsorted(seeds, x[at], side="left"), np.searchsorted(seeds, x[at], side="right")
            lo, hi, doc = (v[hi > lo] for v in (lo, hi, doc))
            cuts = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, z in zip(cuts, np.append(cuts[1:], len(doc))[: len(cuts)], strict=True):
                spans = np.unique(np.stack([lo[a:z], hi[a:z]], axis=1), axis=0).tolist()
                yield int(doc[a]), width, np.unique(np.concatenate([item[p:q] for p, q in spans]))


def matches(one: np.ndarray, other: np.ndarray, width: int, sorted_other=None, expand: int = EXPAND) -> list[tuple[int, int, int]]:
    """(words, place in one, place in other) of all maximal common runs of width words or more."""
    seeds, (order, keys) = runs(one, width), sorted_other or _sorted_runs(other, width)
    lo, hi = np.searchsorted(keys, seeds, side="left"), np.searchsorted(keys, seeds, side="right")

    def same(p, q):
        """Whether the words are equal, not only the hashes."""
        ok = np.ones(len(q), dtype=bool)
        for j in range(width):
            ok &= one[p + j] == other[q + j]
        return ok

    if (hi - lo).sum() <= expand:
        n = hi - lo
        p = np.repeat(np.arange(len(seeds)), n)
        q = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ok = same(p, q)
        p, d = p[ok], (q - p)[ok]
        if not len(p):
            return []
        by = np.lexsort((p, d))
        p, d = p[by], d[by]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 0) | (np.diff(p) != 1))))
        stop = np.append(new[1:], len(p)) - 1
        return list(zip((p[stop] - p[new] + width).tolist(), p[new].tolist(), (p[new] + d[new]).tolist(), strict=True))
    out, ends, begun = [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for p in range(len(seeds) + 1):  # runs that go on from place to place, of which each holds its first place
        here = np.sort(order[lo[p] : hi[p]]) if p < len(seeds) else ends[:0]
        here = here[same(p, here)] if len(here) else here
        goes_on = np.isin(ends + 1, here)
        out += [(p - b + width - 1, b, e - (p - 1 - b)) for b, e in zip(begun[~goes_on].tolist(), ends[~goes_on].tolist(), strict=True)]
        start = np.full(len(here), p, dtype=np.int64)
        if goes_on.any():
            start[np.searchsorted(here, ends[goes_on] + 1)] = begun[goes_on]
        ends, begun = here, start
    return out


def _sorted_runs(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = runs(words, width)
    order = np.argsort(x, kind="stable")
    return order, x[order]


def tiles(shared: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of maximal matches: (place in item, place in document, words) of each tile; of matches of
    one length the one that comes first in the item, then in the document."""
    queue = [(-n, a, b) for n, a, b in shared]
    heapq.heapify(queue)
    item_marked: set[int] = set()
    doc_marked: set[int] = set()
    out = []
    while queue:
        n, a, b = heapq.heappop(queue)
        free = [a + k not in item_marked and b + k not in doc_marked for k in range(-n)]
        if all(free):
            item_marked.update(range(a, a - n))
            doc_marked.update(range(b, b - n))
            out.append((a, b, -n))
            continue
        k = 0
        while k < -n:
            if not free[k]:
                k += 1
                continue
            z = k
            while z < -n and free[z]:
                z += 1
            if z - k >= least:
                heapq.heappush(queue, (k - z, a + k, b + k))
            k = z
    return out


def found(index: SeedIndex, texts: list[bytes]):
    """(text, item, coverage, tiles) of the pairs of one piece of a batch that reach the index's share."""
    words, first, start, end = words_of(texts)
    for d, width, items in index.candidates(words, first):
        text = words[first[d] : first[d + 1]]
        in_order = _sorted_runs(text, width)
        for k in items.tolist():
            size = int(index.sizes[k])
            seeds = index.seeds(k, width)
            at = np.minimum(np.searchsorted(in_order[1], seeds), len(in_order[1]) - 1)
            if covered(np.flatnonzero(in_order[1][at] == seeds), width, size) < index.share * size:
                continue
            got = tiles(matches(index.of_item(k), text, width, in_order), min(LEAST_TILE, width))
            share = sum(n for *_, n in got) / size
            if share >= index.share:
                yield d, k, share, [(x, y, n, int(start[first[d] + y]), int(end[first[d] + y + n - 1])) for x, y, n in got]


def item_blocks(benchmark: DataFrame, most_words: int = BLOCK_WORDS):
    """Lists of (item_id, text), each of at most most_words words (or one longer item); the driver holds one block."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block: list[tuple[int | None, str]] = []
    held = 0
    for r in rows.toLocalIterator():
        n = len(r.text.split())
        if block and held + n > most_words:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += n
    if block:
        yield block


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("matched_words", pa.int64()), ("longest_tile", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = COVERAGE, most_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item whose tiles cover at least share of the item's words."""
    texts, out = id_text(docs), None
    spark = docs.sparkSession
    for block in item_blocks(benchmark, most_words):
        spread = spark.sparkContext.broadcast(SeedIndex(block, share))

        def run(batches, spread=spread):
            index = spread.value
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[lo + d], index.ids[k], s, len(t), sum(x[2] for x in t), max(x[2] for x in t)) for lo, _, piece in in_pieces(b) for d, k, s, t in found(index, piece)]
                if rows:
                    yield batch_of(_SCHEMA, **dict(zip(_SCHEMA.names, map(list, zip(*rows, strict=True)), strict=True)))

        rows = arrow_map(texts, run, "doc_id long, item_id long, coverage double, n_tiles long, matched_words long, longest_tile long")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, coverage double, n_tiles long, matched_words long, longest_tile long")
