"""Operator 6: byte-level BPE, encoded and decoded here from a public vocabulary file.

Encoding keeps a priority queue of merge ranks over a doubly linked list of symbols: the least rank (then the leftmost
place) is merged next, and an entry whose symbols have changed meanwhile is stale and skipped. Decoding concatenates
the vocabulary's byte strings.

A text is cut at single spaces between other characters, where no piece of the pattern can cross; each such part is
encoded once as long as a worker's cache holds it. Nothing is shuffled.

Defined cases: null or empty text has no ids and decodes to empty text; special strings become their single ids;
repeated or null doc_ids are rows like any other; ids that don't decode to UTF-8 give replacement characters.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, batch_of, id_text, pieces

CACHE_PARTS, CACHE_CHARS = 600_000, 64
#: The pattern that byte-level BPE vocabularies of this kind are made for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_UNSAFE = re.compile(r" \s|\s |^ | $")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the rest
    take the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {ch: b for b, ch in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(back[ch] for ch in s) for s, i in vocab.items() if all(ch in back for ch in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.pieces = regex.compile(PIECES).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.of_piece: dict[str, bytes] = {}
        self.of_part: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        sym = [self.first[b] for b in data]
        n = len(sym)
        if n < 2:
            return sym
        merge, pop, push = self.merge, heapq.heappop, heapq.heappush
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merge.get((sym[i], sym[i + 1]))
            if found:
                queue.append((found[0], i, sym[i], sym[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = pop(queue)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            j = right[i] = right[j]
            if j < n:
                left[j] = i
                found = merge.get((new, sym[j]))
                if found:
                    push(queue, (found[0], i, new, sym[j], found[1]))
            k = left[i]
            if k >= 0:
                found = merge.get((sym[k], new))
                if found:
                    push(queue, (found[0], k, sym[k], new, found[1]))
        return [s for s in sym if s >= 0]

    def _part(self, part: str) -> bytes:
        kept, out = self.of_piece, []
        for p in self.pieces(part):
            ids = kept.get(p)
            if ids is None:
                ids = np.array(self.merged(p.encode()), dtype="<u4").tobytes()
                if len(p) <= CACHE_CHARS:
                    kept[p] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        parts = (_SAFE_CUT.split(text) if _UNSAFE.search(text) else text.split(" "))
        out, kept = [self._part(parts[0])], self.of_part
        rest = list(map(kept.get, parts[1:]))
        if None in rest:
            for k, ids in enumerate(rest):
                if ids is None:
                    part = parts[k + 1]
                    ids = kept.get(part)
                    if ids is None:
                        ids = self._part(" " + part)
                        if len(part) <= CACHE_CHARS:
                            kept[part] = ids
                    rest[k] = ids
        return b"".join(out + rest)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        for kept in (self.of_piece, self.of_part):
            if len(kept) > CACHE_PARTS:
                kept.clear()
        if self.at_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[s]], dtype="<u4").tobytes() if s in self.special else self._plain(s) for s in self.at_special.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", errors="replace")


def bpe_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary), decoded text: for callers that want the ids themselves."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        bpe = ByteBpe(tokenizer_path)
        for b in pieces(batches):
            ids = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield batch_of(schema, doc_id=b.column("doc_id"), n_tokens=[len(x) // 4 for x in ids], ids=ids, decoded=[bpe.decode(x) for x in ids])

    return arrow_map(id_text(docs), run, "doc_id long, n_tokens long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; ids and texts don't leave the worker."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = ByteBpe(tokenizer_path)
        for b in pieces(batches):
            ids = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield batch_of(
                schema,
                doc_id=b.column("doc_id"),
                n_tokens=[len(x) // 4 for x in ids],
                ids_sha256=[hashlib.sha256(x).hexdigest() for x in ids],
                decoded_sha256=[hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            )

    return arrow_map(id_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
