"""Text in blocks, and an exchange that tells each block which of its hashes occur more than once in the corpus.

Blocks are rows of a written table in the shared folder: a block is about BLOCK_BYTES of whole texts, so a pass over
the table meets the same blocks again whatever executors are left. A pass emits, for each block, its distinct 64-bit
hashes in packed ranges ("buckets"); a hash that a block has many times travels once, so a hot one is at most one entry
for each block. Replies return as one file for each block. Texts are never shuffled.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, filesystem, fresh_folder, id_text, partitions, small_batches

BLOCK_BYTES = 1 << 21
#: Of hashes that one task of an exchange is meant to hold: the number of its tasks follows the number of blocks.
EXCHANGE_BYTES = 1 << 26
_BLOCK = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary()))])


def write_blocks(docs: DataFrame) -> tuple[DataFrame, str]:
    """(blocks, folder for the replies)."""
    folder = fresh_folder(docs.sparkSession, "blocks")

    def run(batches):
        ids, texts, held, n = [], [], 0, 0

        def flush():
            nonlocal n
            n += 1
            return batch_of(_BLOCK, block=[f"{TaskContext.get().partitionId()}-{n}"], doc_ids=[ids], texts=[texts])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                if ids and held + len(text) > BLOCK_BYTES:
                    yield flush()
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(text)
                held += len(text)
        if ids:
            yield flush()

    spark = docs.sparkSession
    with small_batches(spark):
        arrow_map(id_text(docs), run, "block string, doc_ids array<long>, texts array<binary>").write.option("compression", "zstd").parquet(f"{folder}/texts")
    return spark.read.parquet(f"{folder}/texts"), folder


def over_blocks(blocks: DataFrame, fn: Callable[[str, list, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn(block, doc_ids, texts) yields record batches."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                yield from fn(b.column("block")[k].as_py(), b.column("doc_ids")[k].as_py(), b.column("texts")[k].as_py())

    return blocks.mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Shuffle files of a finished exchange stay on the executors until the driver collects its garbage; asks for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def save(folder: str, name: str, data: bytes) -> None:
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    draft = f"{root}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(zstandard.ZstdCompressor(level=1).compress(data))
    try:
        fs.move(draft, f"{root}/{name}")
    except OSError:  # a task that runs again finds what it wrote before, the same bytes
        if fs.get_file_info(f"{root}/{name}").type == FileType.NotFound:
            raise
        fs.delete_file(draft)


def load(folder: str, name: str, expected: bool) -> bytes:
    """A reply; empty if the block sent nothing. A reply that is expected and isn't there is an error."""
    if not expected:
        return b""
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/{name}") as f:
        return zstandard.ZstdDecompressor().stream_reader(f.read()).readall()


def _buckets(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket of sorted hashes ends: buckets are equal ranges of the upper 32 bits."""
    upper = (np.arange(1, n_buckets, dtype=np.uint64) << np.uint64(32)) // np.uint64(n_buckets) << np.uint64(32)
    return np.concatenate(([0], np.searchsorted(hashes, upper), [len(hashes)]))


def exchange_tasks(blocks: DataFrame) -> int:
    """Shuffle partitions for an exchange: at least the session's, more where blocks are many."""
    return max(partitions(blocks.sparkSession), -(-blocks.count() * BLOCK_BYTES // EXCHANGE_BYTES))


def _least_and_most(place: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest label of each place; places are 0, 1, 2 ... without gaps."""
    order = np.lexsort((labels, place))
    place, labels = place[order], labels[order]
    edge = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, dtype=np.int64)
    return labels[edge], labels[np.append(edge[1:], len(place))[: len(edge)] - 1]


def mark_repeated(blocks: DataFrame, hashes_of: Callable[[str, list, list[bytes]], tuple[np.ndarray, np.ndarray | None]], folder: str, divided: bool = False) -> None:
    """For every block writes a file: for its distinct hashes in ascending order, 1 if the hash has a weight of 2 or
    more in all blocks together, else 0. hashes_of(block, doc_ids, texts): uint64 hashes, with repeats, and their
    weights (None: 1 each, so that a 1 in the reply means that the hash occurs more than once). divided: in place of
    weights come labels, and 1 means that the hash occurs with several of them."""
    spark = blocks.sparkSession
    tasks = exchange_tasks(blocks)
    n = 4 * tasks
    sent = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("hashes", pa.binary()), ("many", pa.binary()), ("labels", pa.binary())])
    back = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("marks", pa.binary())])

    def emit(block, doc_ids, texts):
        hashes, weights = hashes_of(block, doc_ids, texts)
        found, place = np.unique(hashes, return_inverse=True)
        cut = _buckets(found, n)
        if divided:
            labels, most = _least_and_most(place, weights)
            many = np.where(labels == most, 1, 2).astype(np.uint8)
        else:
            labels = np.zeros(0, dtype=np.int64)
            many = np.minimum(np.bincount(place, weights=weights, minlength=len(found)), 2).astype(np.uint8)
        parts = [(k, found[a:z].tobytes(), many[a:z].tobytes(), labels[a:z].tobytes()) for k, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a]
        if parts:
            yield batch_of(sent, bucket=[p[0] for p in parts], block=[block] * len(parts), hashes=[p[1] for p in parts], many=[p[2] for p in parts], labels=[p[3] for p in parts])

    def answered(rows):
        every = np.concatenate([np.frombuffer(r[2], dtype=np.uint64) for r in rows])
        weight = np.concatenate([np.frombuffer(r[3], dtype=np.uint8) for r in rows])
        _, place = np.unique(every, return_inverse=True)
        if divided:
            low, high = _least_and_most(place, np.concatenate([np.frombuffer(r[4], dtype=np.int64) for r in rows]))
            marks = ((low != high) | (np.bincount(place, weights=weight == 2) > 0)).astype(np.uint8)[place]
        else:
            marks = (np.bincount(place, weights=weight) >= 2).astype(np.uint8)[place]
        ends = np.cumsum([len(r[3]) for r in rows])
        return batch_of(back, block=[r[1] for r in rows], bucket=[r[0] for r in rows], marks=[marks[e - len(r[3]) : e].tobytes() for r, e in zip(rows, ends, strict=True)])

    def meet(batches):
        rows = []  # of one bucket
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in sent.names), strict=True):
                if rows and rows[0][0] != r[0]:
                    yield answered(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield answered(rows)

    def store(batches):
        now, parts = None, []
        for b in batches:
            for block, marks in zip(b.column("block").to_pylist(), b.column("marks").to_pylist(), strict=True):
                if block != now and now is not None:
                    save(folder, now, b"".join(parts))
                    parts = []
                now = block
                parts.append(marks)
        if now is not None:
            save(folder, now, b"".join(parts))
        yield pa.RecordBatch.from_arrays([pa.array([1], type=pa.int32())], names=["done"])

    given = over_blocks(blocks, emit, "bucket int, block string, hashes binary, many binary, labels binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    replies = arrow_map(given, meet, "block string, bucket int, marks binary").repartition(tasks, "block").sortWithinPartitions("block", "bucket")
    with small_batches(spark):
        arrow_map(replies, store, "done int").count()
    del given, replies
    release(spark)


def repeated(hashes: np.ndarray, marks: bytes) -> np.ndarray:
    """For each hash of a block (with repeats, as hashes_of gave them), whether the corpus has it more than once."""
    found, place = np.unique(hashes, return_inverse=True)
    return (np.frombuffer(marks, dtype=np.uint8) == 1)[place] if len(found) else np.zeros(0, dtype=bool)


def store_by_block(rows: DataFrame, columns: list[str], folder: str, blocks: DataFrame) -> None:
    """Writes, for each block, its rows' columns (long, not null) as one little-endian table file; an empty one for a
    block without rows, so that a reader knows a missing file for a loss."""
    spark = rows.sparkSession

    def store(batches):
        now, parts = None, []
        for b in batches:
            real = b.column(columns[0]).is_valid().to_pylist()
            table = np.stack([b.column(c).fill_null(0).to_numpy() for c in columns], axis=1) if b.num_rows else np.zeros((0, len(columns)), dtype=np.int64)
            for k, block in enumerate(b.column("block").to_pylist()):
                if block != now and now is not None:
                    save(folder, now, b"".join(parts))
                    parts = []
                now = block
                if real[k]:
                    parts.append(table[k].astype("<i8").tobytes())
        if now is not None:
            save(folder, now, b"".join(parts))
        yield pa.RecordBatch.from_arrays([pa.array([1], type=pa.int32())], names=["done"])

    every = rows.select("block", *columns).unionByName(blocks.select("block", *(F.lit(None).cast("long").alias(c) for c in columns)))
    dealt = every.repartition(partitions(spark), "block").sortWithinPartitions("block")
    with small_batches(spark):
        arrow_map(dealt, store, "done int").count()
    del dealt
    release(spark)
