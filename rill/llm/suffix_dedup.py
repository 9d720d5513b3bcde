"""Operator 2: exact substring dedup by prefix-free parsing.

A rolling hash over TRIGGER bytes cuts every text into phrases that overlap by a trigger, so equal text is parsed
equally wherever it stands. Two texts share a position in the corpus order of suffixes, up to LENGTH bytes, if they
agree on the rest of a phrase and on the parse after it. This operator needs only that equality, not the order:

- dictionary: which phrases the corpus has more than once;
- parse: for every place in the parse, the name (hash) of the phrases from the one before it until LENGTH bytes are
  covered; where a name occurs twice, all LENGTH-byte strings that start there repeat, without looking at any of them;
- only where a repeat begins or ends inside a phrase are strings named one by one, and only those that contain no phrase
  that the dictionary has once, together with those known to repeat that begin with the same whole phrase.

Classes are named by hashes of bytes and counted, instead of sorted into suffix arrays: a sort would bring all suffixes of
one common passage, perhaps a third of the corpus, into one range. Names travel once a block. Whatever is to be removed
has a second name, of an independent family of hashes: places of the parse from the start, single strings once the first
name repeats. Only what repeats by both names goes.

Defined cases: null or empty text, and texts shorter than LENGTH, lose nothing; matches never cross documents; repeated
doc_ids are separate rows; null doc_ids are kept; a table without rows gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import load, mark_repeated, over_blocks, repeated, save, write_blocks
from .common import batch_of, drop_folder, mix, prefix_hash, span_hash

LENGTH = 200
TRIGGER, MODULUS = 8, 32


class Parse:
    """Phrases of the texts of one block."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.base = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        n = len(self.buf)
        roll = np.zeros(max(0, n - TRIGGER + 1), dtype=np.uint32)
        wide = self.buf.astype(np.uint32) + np.uint32(1)
        for k in range(TRIGGER):
            roll += wide[k : k + len(roll)] * np.uint32(0x01000193 ** (k + 1) & 0xFFFFFFFF)
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x85EBCA6B)
        roll ^= roll >> np.uint32(13)
        roll *= np.uint32(0xC2B2AE35)
        at = np.flatnonzero((roll >> np.uint32(16)) % np.uint32(MODULUS) == 0)
        doc = np.searchsorted(self.base, at, side="right") - 1
        inside = at + TRIGGER <= self.base[doc + 1]
        self.at, self.doc = at[inside], doc[inside]
        self.sums = [prefix_hash(self.buf), None]
        self._places()

    def spans(self, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
        if self.sums[family] is None:
            self.sums[family] = prefix_hash(self.buf, family)
        return span_hash(self.sums[family], start, end, family)

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every phrase, from a trigger to the end of the next."""
        same = self.doc[1:] == self.doc[:-1]
        return self.at[:-1][same], self.at[1:][same] + TRIGGER

    def _places(self) -> None:
        """For each stretch of string starts between two triggers: first and last start, and the span it is named by."""
        base, length = self.base, self.length
        n_docs = len(base) - 1
        first_of = np.searchsorted(self.at, base)  # first trigger of each text
        # an entry for each trigger and one more for the end of each text
        slot = np.arange(len(self.at)) + self.doc
        end_slot = first_of[1:] + np.arange(n_docs)
        total = len(self.at) + n_docs
        own = np.zeros(total, dtype=np.int64)
        doc = np.zeros(total, dtype=np.int64)
        own[slot], doc[slot] = self.at, self.doc
        own[end_slot], doc[end_slot] = base[1:], np.arange(n_docs)
        begin = np.ones(total, dtype=bool)
        begin[1:] = doc[1:] != doc[:-1]
        before = np.concatenate(([0], own[:-1]))
        low = np.where(begin, base[doc], before + 1)
        high = np.minimum(own, base[doc + 1] - length)
        span_start = np.where(begin, base[doc], before)
        far = np.searchsorted(self.at, own + length - TRIGGER)
        known = far < len(self.at)
        reach = np.where(known, far, 0)
        near = known & (self.doc[reach] == doc) if len(self.at) else np.zeros(total, dtype=bool)
        span_end = np.where(near, (self.at[reach] if len(self.at) else 0) + TRIGGER, base[doc + 1])
        # the phrase that follows a stretch's trigger, and the first start whose string holds all of it
        phrase = np.full(total, -1, dtype=np.int64)
        holds = np.full(total, len(self.buf) + 1, dtype=np.int64)
        if len(self.at):
            same = np.append(self.doc[1:] == self.doc[:-1], False)
            phrase[slot] = np.where(same, np.cumsum(same) - 1, -1)
            holds[slot] = np.where(same, np.append(self.at[1:], 0) + TRIGGER - length, len(self.buf) + 1)
        some = low <= high
        self.low, self.high, self.span_start, self.span_end, self.phrase, self.holds, self.begin = (x[some] for x in (low, high, span_start, span_end, phrase, holds, begin))

    def places(self, family: int = 0, chosen=slice(None)) -> np.ndarray:
        """Names of the places' spans."""
        # a text may begin with a trigger: its first two places then have one span, and must not take each other for a copy
        salt = np.where(self.begin[chosen], np.uint64(0x2545F491), np.uint64(0x51ED270B))
        return mix(self.spans(self.span_start[chosen], self.span_end[chosen], family) + salt)

    def names(self) -> np.ndarray:
        """Names of the phrases, then both names of the places."""
        return np.concatenate((self.spans(*self.phrases()), self.places(), self.places(1)))

    def settle(self, marks: bytes) -> None:
        """Takes the reply on names: which phrases and which places repeat."""
        known = repeated(self.names(), marks)
        n, m = len(self.phrases()[0]), len(self.low)
        self.twice, self.sure = known[:n], known[n : n + m] & known[n + m :]
        self.rest = self._open_starts()
        self._ask()

    def settled(self) -> bytes:
        return np.packbits(np.concatenate((self.twice, self.sure))).tobytes()

    def resume(self, settled: bytes) -> None:
        """Takes what settled() gave for the same texts."""
        n, m = len(self.phrases()[0]), len(self.low)
        known = np.unpackbits(np.frombuffer(settled, dtype=np.uint8), count=n + m).astype(bool)
        self.twice, self.sure = known[:n], known[n:]
        self.rest = self._open_starts()
        self._ask()

    def _open_starts(self) -> np.ndarray:
        """Starts outside of sure places whose strings may repeat."""
        sure = self.sure
        n = len(self.buf) + 1
        open_ = np.zeros(n + 1, dtype=np.int32)
        np.add.at(open_, self.low[~sure], 1)
        np.add.at(open_, self.high[~sure] + 1, -1)
        a, z = self.phrases()
        once = ~self.twice & (z - a <= self.length)
        dead = np.zeros(n + 1, dtype=np.int32)
        np.add.at(dead, np.maximum(z - self.length, self.base[np.searchsorted(self.base, a, side="right") - 1])[once], 1)
        np.add.at(dead, a[once] + 1, -1)
        return np.flatnonzero((np.cumsum(open_[:-1]) > 0) & ~(np.cumsum(dead[:-1]) > 0))

    def of_places(self, chosen: np.ndarray) -> np.ndarray:
        """All starts of the chosen places."""
        size = (self.high - self.low + 1)[chosen]
        return np.repeat(self.low[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def keys(self, starts: np.ndarray) -> np.ndarray:
        """For each start the first phrase that its string holds whole from the first trigger on, or -1."""
        place = np.searchsorted(self.low, starts, side="right") - 1
        return np.where(starts >= self.holds[place], self.phrase[place], -1)

    def _ask(self) -> None:
        """Phrases that stand first in sure places or in starts that may repeat, and which of them in the latter."""
        of_rest = np.unique(self.keys(self.rest))
        every = np.union1d(of_rest, np.unique(self.phrase[self.sure]))
        self.asked = every[every >= 0]
        self.of_rest = np.isin(self.asked, of_rest)

    def asked_names(self) -> np.ndarray:
        a, z = self.phrases()
        return self.spans(a[self.asked], z[self.asked])

    def strings_to_name(self, wanted: bytes) -> np.ndarray:
        """Starts that may repeat, then those of sure places that such starts elsewhere may equal."""
        known = self.of_places(np.flatnonzero(self.sure))
        key = self.keys(known)
        need = np.ones(len(known), dtype=bool)
        if len(self.twice):
            asked = np.zeros(len(self.twice), dtype=bool)
            asked[self.asked] = repeated(self.asked_names(), wanted)
            need = (key < 0) | asked[np.maximum(key, 0)]
        return np.concatenate((self.rest, known[need]))

    def strings(self, starts: np.ndarray, family: int = 0) -> np.ndarray:
        return self.spans(starts, starts + self.length, family)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining bytes if with_text."""
    blocks, folder = write_blocks(docs)
    names, known, phrases, strings, likely, again = (f"{folder}/{x}" for x in ("names", "known", "phrases", "strings", "likely", "again"))

    def wanted(block, _, texts):
        p = Parse(texts, length)
        p.settle(load(names, block, len(p.low) + len(p.phrases()[0]) > 0))
        save(known, block, p.settled())
        return p.asked_names(), 2 * p.of_rest

    def parsed(block, texts) -> Parse:
        p = Parse(texts, length)
        p.resume(load(known, block, True))
        return p

    def starts_of(p: Parse, block) -> np.ndarray:
        return p.strings_to_name(load(phrases, block, len(p.asked) > 0))

    def single(block, _, texts):
        p = parsed(block, texts)
        return p.strings(starts_of(p, block)), None

    def single_again(block, _, texts):
        p = parsed(block, texts)
        starts = starts_of(p, block)
        hit = repeated(p.strings(starts), load(strings, block, len(starts) > 0))
        outside = np.arange(len(starts)) < len(p.rest)
        save(likely, block, np.stack([starts[hit], outside[hit]]).astype("<i8").tobytes())
        return p.strings(starts[hit], 1), None

    mark_repeated(blocks, lambda _, __, texts: (Parse(texts, length).names(), None), names)
    mark_repeated(blocks, wanted, phrases)
    drop_folder(docs.sparkSession, names)
    mark_repeated(blocks, single, strings)
    mark_repeated(blocks, single_again, again)
    drop_folder(docs.sparkSession, phrases)
    drop_folder(docs.sparkSession, strings)
    schema = _RESULT if with_text else pa.schema(list(_RESULT)[:-1])

    def final(block, doc_ids, texts):
        p = parsed(block, texts)
        hit = np.zeros(len(p.buf) + 1, dtype=bool)
        hit[p.of_places(np.flatnonzero(p.sure))] = True
        starts, outside = np.frombuffer(load(likely, block, True), dtype="<i8").reshape(2, -1)
        hit[starts[(outside == 1) & repeated(p.strings(starts, 1), load(again, block, len(starts) > 0))]] = True
        at = np.flatnonzero(hit)
        cover = np.zeros(len(p.buf) + 1, dtype=np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        rows = []
        for k, doc in enumerate(doc_ids):
            a, z = p.base[k], p.base[k + 1]
            g = gone[a:z]
            n = int(g.sum())
            left = texts[k] if not n else p.buf[a:z][~g].tobytes()
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0
            rows.append((doc, int(z - a), n, spans, hashlib.sha256(left).hexdigest(), left)[: len(schema)])
        yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    return over_blocks(blocks, final, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
