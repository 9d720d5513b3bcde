"""Operator 1: context-triggered piecewise hashing.

A hash rolls over seven bytes; where it hits a residue of the block size, a chunk ends and one signature letter is
made of the chunk. A fingerprint is ``block:letters:letters at twice the block:digest of the text``. Two fingerprints are
compared by the edit distance of their letters where block sizes are equal or one is twice the other. Short texts have
blocks down to one byte, so that they too have a letter for every few bytes. Fingerprints with different digests are of
different texts and count as one edit apart at least, whatever their letters.

Defined cases: null text is empty and has no letters; equal texts have equal fingerprints; two equal fingerprints are
alike 1.0, no others are; texts that repeat themselves so that no block gives LETTERS / 2 to MOST_LETTERS letters have
those of the block next to it, one letter at worst; incompatible block sizes are alike 0.0; repeated doc_ids stand next to each other, ordered
by a hash of the text; null doc_ids come first; an only document is its own next document; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, id_text, partitions, pieces, saved

WINDOW = 7
#: Block sizes are powers of two from here on.
LEAST_BLOCK = 1
LETTERS, MOST_LETTERS = 64, 256
#: Letters that two signatures must share in one run to be compared at all; of short ones a quarter.
COMMON_RUN = 7
#: Bytes hashed at once, so that one very long text needs no more memory than this many bytes take.
SEGMENT = 1 << 20
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_FACTORS = [np.uint32(0x01000193 ** (k + 1) & 0xFFFFFFFF) for k in range(WINDOW)]
_ZERO = np.zeros(1, dtype=np.int64)


def _grams(data: bytes, at: int) -> np.ndarray:
    """Mixed hash of the WINDOW bytes up to each byte of the segment that starts at at."""
    lead = min(at, WINDOW - 1)
    seg = np.frombuffer(data, dtype=np.uint8, offset=at - lead, count=min(len(data), at + SEGMENT) - at + lead).astype(np.uint32) + np.uint32(1)
    roll = seg * _FACTORS[0]
    for k in range(1, min(WINDOW, len(seg))):
        roll[k:] += seg[:-k] * _FACTORS[k]
    roll = roll[lead:]
    roll ^= roll >> np.uint32(16)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    roll *= np.uint32(0xC2B2AE35)
    roll ^= roll >> np.uint32(16)
    return roll


def _letters(data: bytes, block: int, kept: dict) -> tuple[str, str]:
    """Signatures at block and at twice block. A chunk's letter is made of the sum of its mixed windows."""
    signs = []
    for size in (block, 2 * block):
        parts, carry, is_open = [], np.zeros(1, dtype=np.uint32), False
        for at in range(0, len(data), SEGMENT):
            gram = kept.get(at)
            if gram is None:
                gram = _grams(data, at)
                if len(data) <= SEGMENT:
                    kept[at] = gram
            n = len(gram)
            ends = np.flatnonzero((gram & np.uint32(size - 1)) == size - 1) + 1
            cuts = np.concatenate((_ZERO, ends[:-1] if len(ends) and ends[-1] == n else ends))
            sums = np.add.reduceat(gram, cuts, dtype=np.uint32)
            sums[:1] += carry
            is_open = not (len(ends) and ends[-1] == n)
            parts.append(sums[:-1] if is_open else sums)
            carry = sums[-1:].copy() if is_open else np.zeros(1, dtype=np.uint32)
        if is_open:
            parts.append(carry)
        sums = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        signs.append(_ALPHABET[(sums * np.uint32(0x9E3779B1)) >> np.uint32(26)].tobytes().decode())
    return signs[0], signs[1]


def fingerprint(text: str) -> str:
    data = text.encode("utf-8")
    digest = hashlib.blake2b(data, digest_size=8).hexdigest()
    block = LEAST_BLOCK
    while block * LETTERS < len(data):
        block *= 2
    kept: dict = {}
    found = None
    while True:
        a, b = _letters(data, block, kept)
        if len(a) <= MOST_LETTERS:
            if len(a) >= LETTERS // 2 or block == LEAST_BLOCK or found == "":
                return f"{block}:{a}:{b}:{digest}"
            found = f"{block}:{a}:{b}:{digest}"
            block //= 2
        elif found:
            return found
        else:
            found = ""
            block *= 2


def edit_distance(a: str, b: str) -> int:
    """Levenshtein's, by bit vectors as long as a."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for ch in b:
        eq = places.get(ch, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        grow, shrink = down | ~(diag | up) & full, up & diag
        score += bool(grow & top) - bool(shrink & top)
        grow, shrink = (grow << 1 | 1) & full, (shrink << 1) & full
        up, down = shrink | ~(diag | grow) & full, grow & diag
    return score


def _alike(a: str, b: str) -> float:
    """Of signatures of different texts."""
    run = min(COMMON_RUN, max(1, min(len(a), len(b)) // 4))
    if not a or not b or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 1.0 - max(1, edit_distance(a, b)) / max(len(a), len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints alone."""
    if x == y:
        return 1.0
    n, a, aa, _ = x.split(":")
    m, b, bb, _ = y.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_alike(a, b), _alike(aa, bb))
    if n == 2 * m:
        return _alike(a, bb)
    return _alike(aa, b) if m == 2 * n else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in pieces(batches):
            yield batch_of(schema, doc_id=b.column("doc_id"), fingerprint=[fingerprint(t) for t in b.column("text").to_pylist()])

    return arrow_map(id_text(docs), run, "doc_id long, fingerprint string")


def _row(doc, text, print_, then_text, then_print) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + then_text[: n // 2]
    ep = fingerprint(edited)
    return doc, n, hashlib.sha256(edited.encode()).hexdigest(), print_, ep, likeness(print_, ep), likeness(print_, then_print)


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and its successor in order of doc_id.

    One range shuffle puts successors side by side. The first and last document of each range, as many as there are
    partitions, meet in a second small step.
    """
    spark = docs.sparkSession
    side = pa.schema([*_RESULT, ("part", pa.int32()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        part, first, held = TaskContext.get().partitionId(), None, None
        blank = {"n_chars": None, "edited_sha256": None, "edited_fingerprint": None, "near_edited": None, "near_next": None}
        for b in pieces(batches):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                now = (doc, text, fingerprint(text))
                if held is None:
                    first = now
                else:
                    rows.append(_row(*held, *now[1:]))
                held = now
            if rows:
                yield batch_of(side, **{f.name: list(v) for f, v in zip(_RESULT, zip(*rows, strict=True), strict=True)}, part=[part] * len(rows), role=["done"] * len(rows), text=[None] * len(rows))
        if held is not None:
            ends = (first, held)
            yield batch_of(side, doc_id=[x[0] for x in ends], fingerprint=[x[2] for x in ends], **{k: [v, v] for k, v in blank.items()}, part=[part] * 2, role=["first", "last"], text=[x[1] for x in ends])

    def close(batches):
        for b in batches:
            rows = [_row(*x) for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_print")), strict=True)]
            if rows:
                yield batch_of(_RESULT, **{f.name: list(v) for f, v in zip(_RESULT, zip(*rows, strict=True), strict=True)})

    tied = id_text(docs).withColumn("tie", F.xxhash64("text"))
    dealt = tied.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    all_rows = saved(arrow_map(dealt, run, f"{_COLUMNS}, part int, role string, text string"))
    ends = all_rows.filter("role <> 'done'")
    firsts = ends.filter("role = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    #: One row for each range: bounded by the number of partitions.
    order = firsts.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    lasts = ends.filter("role = 'last'").select("doc_id", "text", "fingerprint", "part").join(order, "part").drop("part")
    met = lasts.join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_print")
    return all_rows.filter("role = 'done'").select(*_RESULT.names).unionByName(arrow_map(met, close, _COLUMNS))
