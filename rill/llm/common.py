"""What the text operators share: document views, bounded Arrow maps, word hashes and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once (one longer text is still taken whole).
KERNEL_BYTES = 1 << 19
#: Bytes of an Arrow batch in the jobs that an operator runs itself; what it returns runs with the session's setting.
BATCH_BYTES = 1 << 23

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read; a null text is empty. Other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow. Spark bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch); functions that make much of
    a text go through pieces() or in_pieces(), whatever the session's setting."""
    return df.mapInArrow(fn, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local master, where driver and executors are one process, may do
    without: it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named is None and have.isDefined():
        return have.get()
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/rill-checkpoints"
    if not have.isDefined():
        spark.sparkContext.setCheckpointDir(named)
        _gone_at_exit(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return named


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For the jobs that run inside: Arrow batches of BATCH_BYTES at most. The session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder; survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def _on_storage(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _gone_at_exit(spark: SparkSession, uri: str) -> None:
    fs, path = _on_storage(spark, uri)
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A shared folder of its own, which goes when the application ends; drop_folder() removes what is read sooner."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _gone_at_exit(spark, folder)
    return folder


def drop_folder(spark: SparkSession, uri: str) -> None:
    fs, path = _on_storage(spark, uri)
    fs.delete(path, True)


def filesystem(uri: str):
    """(file system, path) of a shared URI, for executors that write or read their own files."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else os.path.abspath(uri))
    return fs.FileSystem.from_uri(uri)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, by array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Two polynomials modulo 2**31 - 1 make one 62-bit name. The bases of a family are fixed; a second family names the
#: same bytes independently of the first.
_PRIME = (1 << 31) - 1
_FAMILIES = ((1_318_699_081, 1_779_033_703), (1_013_904_242, 1_541_459_225))
_P, _FOLD = np.uint64(_PRIME), np.uint64(31)
_powers: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, up to one prime too much; products with numbers below 2**31 still fit 64 bits."""
    x = (x & _P) + (x >> _FOLD)
    return (x & _P) + (x >> _FOLD)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, 2 ... modulo the prime; at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(1, dtype=np.uint64)
        while len(have) < size:
            have = np.concatenate((have, _reduced(have * np.uint64(pow(base, len(have), _PRIME))) % _P))
        _powers[base] = have
    return have


def prefix_hash(buf: np.ndarray, family: int = 0) -> tuple[np.ndarray, ...]:
    """Running sums, from which span_hash() has the hash of any span."""
    out = []
    for base in _FAMILIES[family]:
        x = (buf.astype(np.uint64) + np.uint64(1)) * _power(base, len(buf) + 1)[: len(buf)]
        c = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((x & _P) + (x >> _FOLD), out=c[1:])
        out.append(c)
    return tuple(out)


def span_hash(sums: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit names of buf[start:end], the same for equal bytes wherever they stand."""
    name = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for c, base, place in zip(sums, _FAMILIES[family], (0, 31), strict=True):
        down = _power(pow(base, -1, _PRIME), len(c))
        x = _reduced(_reduced(c[end] - c[start]) * down[start])
        x = np.where(x >= _P, x - _P, x)
        name = name ^ (x << np.uint64(place))
    return mix(name)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of texts after lower-casing A-Z: hash of each word, first word of each text
    (one more entry than texts), and byte start and end of each word within its own text."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    raw = b" ".join(texts).translate(_LOWER)
    buf = np.frombuffer(raw, dtype=np.uint8)
    base = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=base[1:])
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    h = span_hash(prefix_hash(buf), start, end) if len(start) else np.zeros(0, dtype=np.uint64)
    first = np.searchsorted(start, base)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return h, first, start - base[doc], end - base[doc]


def _cuts(batch: pa.RecordBatch, column: str, most: int) -> list[int]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    out, held = [0], 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            out.append(k)
            held = 0
        held += n
    return [*out, batch.num_rows]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about most bytes of text."""
    for batch in batches:
        cuts = _cuts(batch, column, most)
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z > a:
                yield batch.slice(a, z - a)


def in_pieces(batch: pa.RecordBatch, column: str = "text", most: int = KERNEL_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from row, to row, texts as UTF-8) so that each piece holds about most bytes."""
    cuts = _cuts(batch, column, most)
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield a, z, batch.column(column).slice(a, z - a).cast(pa.large_binary()).to_pylist()


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words of one text; of a shorter text, one hash of all its words; of none, none."""
    n = len(h)
    if n == 0:
        return h
    width = min(width, n)
    x = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        x = mix(x * np.uint64(0x9FB21C651E98DF25) + h[k : n - width + 1 + k])
    return x


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
