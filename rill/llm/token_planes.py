"""Operator 5: token-id files of shuffled bit or byte planes.

File: magic, chunks, chunk index, document index, footer. A chunk is a block of at most CHUNK ids, each 32 bits,
transposed into 4 byte planes (or 32 bit planes); each plane is compressed with zstandard by itself. The chunk index
has where a chunk stands, its ids and the sizes of its planes, so that a reader can fetch any range of ids alone.

Documents are encoded and written in ascending doc_id order: one range shuffle, one file for each range. A task writes
under a name of its own and renames at the end, so a repeated task leaves a whole file or none.

Defined cases: null or empty text gives the end id alone; repeated doc_ids are ordered by a hash of the text, null ones
come first; a table without rows gives no files and no rows; special strings in a text are encoded as the library does.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, filesystem, fresh_folder, id_text, in_pieces, partitions, saved

MAGIC = b"RPLN1\n"
CHUNK = 1 << 18
LEVEL = 1
#: Words (and pieces of words) whose ids a worker keeps from task to task, and the longest word kept.
CACHE_WORDS, CACHE_BYTES = 500_000, 64
#: Words that the library gets in one call.
CALL_WORDS = 4096
#: One alternative of a cutting pattern that can't reach over white space: a literal, or a class without it.
_ALTERNATIVE = re.compile(r"[A-Za-z']+|\[(?:\\p\{[LN]\})+\]\+?|\[\^\\s(?:\\p\{[LN]\})*\]\+?")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    flat = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), bitorder="little")[:n] for p in planes], axis=1)
    return np.packbits(flat, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes ids as they come; holds one chunk and the document index."""

    def __init__(self, sink, bits: bool = False, chunk: int = CHUNK):
        self.sink, self.bits, self.chunk = sink, bits, chunk
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[bytes] = []
        self.held_ids = self.n_ids = 0
        self.at = len(MAGIC)
        self.index: list[list[int]] = []
        self.docs: list[tuple[int | None, int]] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        self.docs.append((doc_id, len(ids) // 4))
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        if self.held_ids >= self.chunk:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        whole = np.frombuffer(b"".join(self.held), dtype="<u4")
        stop = len(whole) if last else len(whole) - len(whole) % self.chunk
        for k in range(0, stop, self.chunk):
            part = whole[k : min(k + self.chunk, stop)]
            planes = [self.press.compress(p) for p in to_planes(part, self.bits)]
            self.index.append([self.at, len(part), *map(len, planes)])
            for p in planes:
                self.sink.write(p)
                self.at += len(p)
            self.n_ids += len(part)
        self.held, self.held_ids = [whole[stop:].tobytes()], len(whole) - stop

    def close(self) -> None:
        self._flush(last=True)
        ids = np.array([0 if d is None else d for d, _ in self.docs], dtype="<i8")
        no_id = np.array([d is None for d, _ in self.docs], dtype=np.uint8)
        sizes = np.array([n for _, n in self.docs], dtype="<i8")
        tables = [np.array(self.index, dtype="<i8").tobytes(), ids.tobytes(), no_id.tobytes(), sizes.tobytes()]
        tail = b"".join(packed := [self.press.compress(t) for t in tables])
        foot = json.dumps({"tables": self.at, "sizes": list(map(len, packed)), "planes": 32 if self.bits else 4, "chunks": len(self.index), "ids": self.n_ids, "docs": len(self.docs)}).encode()
        self.sink.write(tail + foot + struct.pack("<I", len(foot)) + MAGIC)


class PlaneReader:
    """Reads an index first, then chunks one at a time."""

    def __init__(self, source, size: int):
        self.source = source
        end = self._at(size - 4 - len(MAGIC), 4 + len(MAGIC))
        if end[4:] != MAGIC:
            raise ValueError("not a plane file, or one cut short")
        n = struct.unpack("<I", end[:4])[0]
        self.foot = json.loads(self._at(size - 4 - len(MAGIC) - n, n))
        un, at, tables = zstandard.ZstdDecompressor(), self.foot["tables"], []
        for k in self.foot["sizes"]:
            tables.append(un.decompress(self._at(at, k)) if k else b"")
            at += k
        self.index = np.frombuffer(tables[0], dtype="<i8").reshape(self.foot["chunks"], self.foot["planes"] + 2)
        self.doc_ids = [None if no else int(d) for d, no in zip(np.frombuffer(tables[1], dtype="<i8"), tables[2], strict=True)]
        self.sizes = np.frombuffer(tables[3], dtype="<i8")
        self.un = un

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k].tolist()
        raw, planes = self._at(at, sum(sizes)), []
        for s in sizes:
            planes.append(self.un.decompress(raw[:s]))
            raw = raw[s:]
        return from_planes(planes, n)

    def documents(self):
        """(doc_id, ids as little-endian bytes), in file order, a chunk at a time."""
        k, held = 0, b""
        for doc, n in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            parts, need = [], 4 * n
            while len(held) < need:
                parts.append(held)
                need -= len(held)
                held, k = self.chunk(k).tobytes(), k + 1
            parts.append(held[:need])
            held = held[need:]
            yield doc, b"".join(parts)


def cutting_pattern(spec: dict) -> str | None:
    """The pattern that cuts normalized text into pieces, of a tokenizer file by which words between ASCII white space
    are encoded alone: its normalizers work on characters, its pattern's pieces hold no white space, its model sees a
    piece at a time, and its special strings are plain ones. None for any other file."""
    normalizer, cutter, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    steps = normalizer.get("normalizers", []) if normalizer.get("type") == "Sequence" else []
    known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    cuts = cutter.get("pretokenizers", []) if cutter.get("type") == "Sequence" else []
    if steps != known or len(cuts) != 2 or spec.get("post_processor") is not None:
        return None
    split, letters = cuts
    pattern = (split.get("pattern") or {}).get("Regex", "")
    fits = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    fits &= letters.get("type") == "ByteLevel" and letters.get("add_prefix_space") is False and letters.get("use_regex") is False
    fits &= model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
    fits &= all(_ALTERNATIVE.fullmatch(x) for x in pattern.split("|"))
    plain = lambda t: not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]))
    return pattern if fits and all(map(plain, spec.get("added_tokens", []))) else None


class LibraryEncoder:
    """The library's ids of whole texts. With a tokenizer file that cutting_pattern() knows, each word between ASCII white
    space is encoded once as long as the cache holds it: printable ASCII words are cut by the file's own pattern, and
    the library's model encodes each piece; words with other characters go through the library's whole pipeline, many
    in one call, and its offsets tell which ids are whose; so do words with a special string, one by one. With any other
    file, whole texts go through the library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = cutting_pattern(spec)
        self.cut = regex.compile(pattern).findall if pattern else None
        self.model = self.tok.model
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.kept: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        out = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _together(self, words: list[str]) -> list[bytes]:
        """Each word's ids, from one call on the words with spaces between them."""
        found = self.tok.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found))
        ids = np.array(found.ids, dtype="<u4").tobytes()
        cut = [0, *(4 * np.searchsorted(starts, ends)).tolist()]
        return [ids[a:z] for a, z in zip(cut, cut[1:], strict=False)]

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        known, out, other, special = self.pieces, {}, [], []
        joined = b" ".join(words)
        if any(x in joined for x in self.special):
            special = [w for w in words if any(x in w for x in self.special)]
            words = list(set(words).difference(special))
        for w in words:
            s = w.decode()
            if not w.isascii() or not s.isprintable():
                other.append(w)
                continue
            s = s.lower()
            ids = known.get(s)  # a word that is one piece, as most are
            if ids is None:
                cut = self.cut(s)
                ids = self._learn(s) if len(cut) == 1 else b"".join([known.get(p) or self._learn(p) for p in cut])
            out[w] = ids
        for k in range(0, len(other), CALL_WORDS):
            part = other[k : k + CALL_WORDS]
            out.update(zip(part, self._together([w.decode() for w in part]), strict=True))
        if special:
            out.update(zip(special, self._whole([w.decode() for w in special]), strict=True))
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.cut is None:
            return self._whole([t.decode() for t in texts])
        for d in (self.kept, self.pieces):
            if len(d) > CACHE_WORDS:
                d.clear()
        kept = self.kept
        split = [t.split() for t in texts]
        long: dict[bytes, bytes] = {}
        for w, ids in self._encode([w for w in set().union(*split) if w not in kept]).items():
            (kept if len(w) <= CACHE_BYTES else long)[w] = ids
        if not long:
            return [b"".join(map(kept.__getitem__, ws)) for ws in split]
        return [b"".join([kept[w] if w in kept else long[w] for w in ws]) for ws in split]


_encoders: dict[tuple, LibraryEncoder] = {}


def encoder_of(path: str) -> LibraryEncoder:
    """The encoder of a tokenizer file that this worker made for an earlier task, with the words it knows by now; a worker
    holds one, and a file that was written anew gets a new one."""
    stat = os.stat(path)
    key = (path, stat.st_ino, stat.st_size, stat.st_mtime_ns)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = LibraryEncoder(path)
    return _encoders[key]


def write_planes(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, bits: bool = False) -> DataFrame:
    """Writes files in doc_id order into folder (a shared URI); a row for each file: part, path, n_ids, n_docs."""
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])
    end = struct.pack("<I", end_id)

    def run(batches):
        encode, out = None, None
        part = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        for b in batches:
            if b.num_rows == 0:
                continue
            if out is None:
                encode = encoder_of(tokenizer_path)
                fs.create_dir(root, recursive=True)
                draft = f"{root}/_{part}-{uuid.uuid4().hex}"
                sink = fs.open_output_stream(draft)
                out = PlaneWriter(sink, bits)
            docs_ = b.column("doc_id").to_pylist()
            for lo, hi, texts in in_pieces(b):
                for doc, ids in zip(docs_[lo:hi], encode(texts), strict=True):
                    out.add(doc, ids + end)
        if out is not None:
            out.close()
            sink.close()
            path = f"{root}/part-{part:06d}.planes"
            fs.move(draft, path)
            yield batch_of(schema, part=[part], path=[path], n_ids=[out.n_ids], n_docs=[len(out.docs)])

    tied = id_text(docs).withColumn("tie", F.xxhash64("text"))
    dealt = tied.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return saved(arrow_map(dealt, run, "part int, path string, n_ids long, n_docs long"))


def read_planes(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        fs, _ = filesystem(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    rows: list[tuple] = []
                    held = 0
                    for doc, ids in PlaneReader(source, source.size()).documents():
                        rows.append((doc, start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 1 << 22:
                            yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))
                            rows, held = [], 0
                    if rows:
                        yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    #: One row for each file, so this window's only partition is as long as the number of ranges.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "start")
    return arrow_map(placed.repartition(partitions(files.sparkSession), "path"), run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, bits: bool = False) -> DataFrame:
    """Writes every document, reads the files back: doc_id, start, n_tokens, ids_crc32."""
    folder = fresh_folder(docs.sparkSession, "planes")
    back = read_planes(write_planes(docs, tokenizer_path, end_id, folder, bits), folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


