"""Delimited text and fixed-width binary records.

Binary fields are little-endian. A time is microseconds since the epoch; not-a-date-time (null) and the two infinities
(INFINITE, the least and greatest time that Python knows) have fixed values of their own. Packing and unpacking work on
whole Arrow batches as structured arrays.
"""

from __future__ import annotations

import datetime
import os
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.scalar import parse_time

#: Type codes, Spark type, bytes in the binary form and their numpy type.
TYPES = {
    "b": ("byte", 1, "<i1"), "ub": ("short", 1, "<u1"), "w": ("short", 2, "<i2"), "uw": ("int", 2, "<u2"),
    "i": ("int", 4, "<i4"), "ui": ("long", 4, "<u4"), "l": ("long", 8, "<i8"), "ul": ("decimal(20,0)", 8, "<u8"),
    "f": ("float", 4, "<f4"), "d": ("double", 8, "<f8"), "c": ("string", 1, "S1"),
    "t": ("timestamp_ntz", 8, "<i8"), "tp": ("timestamp_ntz", 8, "<i8"), "lt": ("timestamp_ntz", 12, [("s", "<i8"), ("ns", "<i4")]),
}
_TIMES = ("t", "tp", "lt")
#: Not-a-date-time, and the times that stand for the infinities with their binary values.
NO_TIME = -(1 << 63)
INFINITE = {(1 << 63) - 1: datetime.datetime(9999, 12, 31, 23, 59, 59, 999999), 1 - (1 << 63): datetime.datetime(1, 1, 1)}
_EPOCH = datetime.datetime(1970, 1, 1)
_INFINITE_MICROS = {k: (v - _EPOCH) // datetime.timedelta(microseconds=1) for k, v in INFINITE.items()}
#: Bytes of a file that one task reads.
SPLIT_BYTES = 1 << 26
#: Records unpacked at once.
BATCH_RECORDS = 1 << 17


def expand_format(spec: str) -> list[str]:
    """``2d,s[4]`` to ``[d, d, s[4]]``."""
    out = []
    for part in spec.split(","):
        m = re.fullmatch(r"(\d*)([a-z]+(?:\[\d+\])?)", part.strip())
        if not m or not (m[2] in TYPES or m[2].startswith("s[")):
            raise ValueError(f"unknown type {part}")
        out += [m[2]] * int(m[1] or 1)
    return out


def format_size(spec: str) -> int:
    return sum(int(c[2:-1]) if c.startswith("s[") else TYPES[c][1] for c in expand_format(spec))


def collapse_format(spec: str) -> str:
    out: list[list] = []
    for c in expand_format(spec):
        if out and out[-1][0] == c:
            out[-1][1] += 1
        else:
            out.append([c, 1])
    return ",".join(f"{n if n > 1 else ''}{c}" for c, n in out)


def from_lines(lines: DataFrame, fields: str, spec: str | None = None, delimiter: str = ",", line: str = "value") -> DataFrame:
    """Named fields of delimited lines; unnamed ones are skipped, blank lines too, and quotes are only stripped."""
    names = fields.split(",")
    kinds = expand_format(spec) if spec else ["s[0]"] * len(names)
    text = F.regexp_replace(F.col(line), "\r$", "")
    parts = F.split(text, re.escape(delimiter))

    def typed(k: int) -> Column:
        x = F.nullif(F.regexp_replace(F.get(parts, F.lit(k)), '^"|"$', ""), F.lit(""))
        kind = kinds[k]
        if kind.startswith("s["):
            return x
        if kind in _TIMES:
            signs = {"+infinity": 0, "+inf": 0, "inf": 0, "-infinity": 1, "-inf": 1}
            ends = [F.lit(v) for v in INFINITE.values()]
            special = reduce(lambda out, name: F.when(x == name, ends[signs[name]]).otherwise(out), signs, F.lit(None))
            return F.coalesce(special.cast("timestamp_ntz"), parse_time(x, "iso"))
        return x if kind == "c" else x.cast(TYPES[kind][0])

    return lines.filter(F.trim(text) != "").select(*(typed(k).alias(n) for k, n in enumerate(names) if n))


def read_text(spark: SparkSession, path: str, fields: str, spec: str | None = None, delimiter: str = ",") -> DataFrame:
    return from_lines(spark.read.text(path), fields, spec, delimiter)


def to_lines(df: DataFrame, delimiter: str = ",", precision: int | None = None) -> DataFrame:
    """Records as lines; nulls are empty. precision: significant digits of floating point numbers, as %g has them."""

    def text(c: str, kind: str) -> Column:
        x = F.col(f"`{c}`")
        if precision is not None and kind in ("double", "float"):
            digits = F.format_string(f"%.{precision - 1}e", x.cast("double")).cast("double").cast("string")
            return F.regexp_replace(digits, r"\.0$", "")
        return x.cast("string")

    return df.select(F.concat_ws(delimiter, *(F.coalesce(text(c, k), F.lit("")) for c, k in df.dtypes)).alias("value"))


def guess_format(line: str, delimiter: str = ",", no_integers: bool = False) -> str:
    """The format of a text record by its first line: times, integers, doubles, else strings of 1024."""

    def kind(x: str) -> str:
        if re.fullmatch(r"\d{8}T\d{6}(\.\d{1,6})?|not-a-date-time|[+-]?inf(inity)?", x):
            return "t"
        if not no_integers and re.fullmatch(r"[+-]?\d{1,18}", x):
            return "l"
        try:
            float(x)
        except ValueError:
            return "s[1024]"
        return "d"

    return ",".join(kind(x) for x in line.rstrip("\r\n").split(delimiter))


def read_guessed(spark: SparkSession, path: str, fields: str, delimiter: str = ",") -> DataFrame:
    """Text records with the types of the first line that isn't blank; a value that doesn't fit them is an error."""
    lines = spark.read.text(path)
    first = lines.filter(F.trim("value") != "").first()
    if first is None:
        return from_lines(lines, fields, None, delimiter)
    spec = guess_format(first[0], delimiter)
    names = fields.split(",")
    return from_lines(lines, ",".join(names[: len(spec.split(","))]), ",".join(spec.split(",")[: len(names)]), delimiter)


def fixed_columns(sizes: list[int], names: list[str], line: str = "value") -> list[Column]:
    """Fields of fixed-column text; trailing blanks go."""
    at, out = 1, []
    for n, name in zip(sizes, names, strict=True):
        out.append(F.rtrim(F.substring(line, at, n)).alias(name))
        at += n
    return out


def from_columns(lines: DataFrame, sizes: list[int], names: list[str], line: str = "value") -> DataFrame:
    return lines.select(*fixed_columns(sizes, names, line))


def record_type(spec: str) -> np.dtype:
    return np.dtype([(f"f{k}", f"S{c[2:-1]}" if c.startswith("s[") else TYPES[c][2]) for k, c in enumerate(expand_format(spec))])


def record_schema(spec: str, names: list[str]) -> T.StructType:
    spark_type = {"byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "decimal(20,0)": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp_ntz": T.TimestampNTZType()}
    kinds = ["string" if c.startswith("s[") else TYPES[c][0] for c in expand_format(spec)]
    return T.StructType([T.StructField(n, spark_type[k]) for n, k in zip(names, kinds, strict=True)])


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("s[") or kind == "c":
        return pa.string()
    return {"byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0), "float": pa.float32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}[TYPES[kind][0]]


def _to_binary(column: pa.Array, kind: str) -> np.ndarray:
    """A field's values, nulls (but of times) as anything."""
    if kind.startswith("s[") or kind == "c":
        size = 1 if kind == "c" else int(kind[2:-1])
        raw = column.cast(pa.binary()).fill_null(b"").to_pylist()
        for x in raw:
            if len(x) > size:
                raise ValueError(f"{x!r} is longer than {kind}")
        return np.array(raw, dtype=f"S{size}")
    if kind in _TIMES:
        x = column.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(NO_TIME).to_numpy(zero_copy_only=False).copy()
        for value, micros in _INFINITE_MICROS.items():
            x[x == micros] = value
        if kind != "lt":
            return x
        out = np.zeros(len(x), dtype=TYPES[kind][2])
        special = (x == NO_TIME) | (x == NO_TIME + 1) | (x == (1 << 63) - 1)
        out["s"], out["ns"] = np.where(special, x, x // 1_000_000), np.where(special, 0, x % 1_000_000 * 1000)
        return out
    to = np.dtype(TYPES[kind][2])
    if kind in ("f", "d"):
        return column.cast(pa.float64() if kind == "d" else pa.float32()).fill_null(0).to_numpy(zero_copy_only=False).astype(to)
    if kind == "ul" or pa.types.is_decimal(column.type):
        values = np.array([0 if v is None else int(v) for v in column.to_pylist()], dtype=object)
    else:
        values = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    limits = np.iinfo(to)
    if len(values) and (values.min() < limits.min or values.max() > limits.max):
        raise ValueError(f"a value doesn't fit {kind}: {values.min()} to {values.max()}")
    return values.astype(to)


def _from_binary(x: np.ndarray, kind: str) -> pa.Array:
    if kind.startswith("s[") or kind == "c":
        return pa.array(x.astype(object), type=pa.binary()).cast(pa.string())  # numpy strips the padding
    if kind in _TIMES:
        if kind == "lt":
            special = (x["s"] == NO_TIME) | (x["s"] == NO_TIME + 1) | (x["s"] == (1 << 63) - 1)
            with np.errstate(over="ignore"):
                x = np.where(special, x["s"], x["s"] * 1_000_000 + x["ns"] // 1000)
        out = x.copy()
        for value, micros in _INFINITE_MICROS.items():
            out[x == value] = micros
        return pa.array(out, mask=x == NO_TIME, type=pa.int64()).cast(pa.timestamp("us"))
    if kind == "ul":
        return pa.array(x.astype(object).tolist(), type=pa.decimal128(20, 0)) if len(x) else pa.array([], type=pa.decimal128(20, 0))
    return pa.array(np.ascontiguousarray(x)).cast(_arrow_type(kind))


def _packed(batch: pa.RecordBatch, spec: str) -> tuple[np.ndarray, np.ndarray]:
    """(records, which of them have a null other than a time)."""
    kinds, kind = expand_format(spec), record_type(spec)
    if len(kinds) != batch.num_columns:
        raise ValueError(f"{spec} has {len(kinds)} fields, the records have {batch.num_columns}")
    out, missing = np.zeros(batch.num_rows, dtype=kind), np.zeros(batch.num_rows, dtype=bool)
    for k, c in enumerate(kinds):
        out[f"f{k}"] = _to_binary(batch.column(k), c)
        if c not in _TIMES:
            missing |= batch.column(k).is_null().to_numpy(zero_copy_only=False)
    return out, missing


def _unpacked(data: np.ndarray, spec: str, names: list[str], missing: np.ndarray | None = None) -> pa.RecordBatch:
    kinds = expand_format(spec)
    columns = [_from_binary(data[f"f{k}"], c) for k, c in enumerate(kinds)]
    if missing is not None and missing.any():
        place = pa.array(np.where(missing, 0, np.cumsum(~missing) - 1), mask=missing, type=pa.int64())
        columns = [c.take(place) for c in columns]
    return pa.RecordBatch.from_arrays(columns, names=names)


def pack(df: DataFrame, spec: str) -> DataFrame:
    """Each record as fixed-width bytes: `record`. A null time is not-a-date-time; any other null makes the record null.
    A string too long for its field, or a number out of its range, is an error."""
    size = format_size(spec)

    def run(batches):
        for b in batches:
            data, missing = _packed(b, spec)
            raw = data[~missing].tobytes()
            ends = np.concatenate(([0], np.cumsum(np.where(missing, 0, size)))).astype("<i4")
            valid = np.packbits(~missing, bitorder="little").tobytes()
            records = pa.Array.from_buffers(pa.binary(), b.num_rows, [pa.py_buffer(valid), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([records], names=["record"])

    return df.mapInArrow(run, "record binary")


def unpack(records: DataFrame, spec: str, names: list[str], record: str = "record") -> DataFrame:
    """Fields of fixed-width records; a null record has null fields, one of another size is an error. The payload of a
    nan is not kept."""
    size, kind = format_size(spec), record_type(spec)

    def run(batches):
        for b in batches:
            column = b.column(0).cast(pa.binary())
            missing = column.is_null().to_numpy(zero_copy_only=False)
            sizes = column.fill_null(b"").to_pylist()
            if any(len(x) != size for x, no in zip(sizes, missing, strict=True) if not no):
                raise ValueError(f"a record of {spec} has {size} bytes")
            yield _unpacked(np.frombuffer(b"".join(sizes), dtype=kind), spec, names, missing)

    return records.select(record).mapInArrow(run, record_schema(spec, names))


def text_to_binary(lines: DataFrame, spec: str, delimiter: str = ",") -> DataFrame:
    """Delimited lines as binary records; empty fields have their type's default (0, or nothing for strings)."""
    kinds = expand_format(spec)
    names = [f"c{k}" for k in range(len(kinds))]
    rows = from_lines(lines, ",".join(names), spec, delimiter)
    filled = [F.col(n) if k in _TIMES else F.coalesce(F.col(n), F.lit("" if k.startswith("s[") or k == "c" else 0).cast(dict(rows.dtypes)[n])) for n, k in zip(names, kinds, strict=True)]
    return pack(rows.select(*filled), spec)


def binary_to_text(records: DataFrame, spec: str, delimiter: str = ",", precision: int | None = None, record: str = "record") -> DataFrame:
    """Binary records as delimited lines: times as iso, doubles with the given significant digits."""
    kinds = expand_format(spec)
    names = [f"c{k}" for k in range(len(kinds))]
    from ..functions.scalar import iso

    rows = unpack(records, spec, names, record)
    shown = [F.coalesce(iso(F.col(n)), F.lit("not-a-date-time")).alias(n) if k in _TIMES else F.col(n) for n, k in zip(names, kinds, strict=True)]
    return to_lines(rows.select(*shown), delimiter, precision)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


class _BinaryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.spec, self.names = options["path"], options["format"], options["fields"].split(",")
        self.split = int(options.get("split", SPLIT_BYTES))
        self.skip, self.count = int(options.get("skip", 0)), int(options.get("count", -1))

    def partitions(self):
        """Ranges of whole records. skip and count leave out a file's first records and all beyond the count."""
        from pyarrow import fs

        size = format_size(self.spec)
        system, root = _file_system(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not os.path.basename(f.path).startswith(("_", "."))), key=lambda f: f.path)
        step, out = max(1, self.split // size) * size, []
        for f in files:
            if f.size % size:
                raise ValueError(f"{f.path}: {f.size} bytes are not whole records of {size}")
            stop = f.size if self.count < 0 else min(f.size, (self.skip + self.count) * size)
            out += [_Range(f.path, k, min(k + step, stop)) for k in range(self.skip * size, stop, step)]
        return out

    def read(self, partition):
        if partition is None:
            return
        system, _ = _file_system(self.path)
        kind, size = record_type(self.spec), format_size(self.spec)
        with system.open_input_file(partition.path) as f:
            for at in range(partition.start, partition.end, BATCH_RECORDS * size):
                f.seek(at)
                data = f.read(min(BATCH_RECORDS * size, partition.end - at))
                yield _unpacked(np.frombuffer(data, dtype=kind), self.spec, self.names)


class _Written(WriterCommitMessage):
    def __init__(self, draft: str, name: str):
        self.draft, self.name = draft, name


class _BinaryWriter(DataSourceArrowWriter):
    """One file a task, under a draft's name until the whole write is committed."""

    def __init__(self, options: dict):
        self.path, self.spec = options["path"], options["format"]

    def write(self, iterator):
        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.bin"
        with system.open_output_stream(f"{root}/_{name}") as f:
            for b in iterator:
                data, missing = _packed(b, self.spec)
                if missing.any():
                    raise ValueError("a binary record has no nulls but of times")
                f.write(data.tobytes())
        return _Written(f"{root}/_{name}", f"{root}/{name}")

    def commit(self, messages):
        system, _ = _file_system(self.path)
        for m in messages:
            if m is not None:
                system.move(m.draft, m.name)

    def abort(self, messages):
        system, _ = _file_system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.draft)


class BinaryRecords(DataSource):
    """Files of fixed-width records: options format and fields; skip, count and split for reading."""

    @classmethod
    def name(cls):
        return "fixed_records"

    def schema(self):
        return record_schema(self.options["format"], self.options["fields"].split(","))

    def reader(self, schema):
        return _BinaryReader(self.options)

    def writer(self, schema, overwrite):
        return _BinaryWriter(self.options)


def read_binary(spark: SparkSession, path: str, spec: str, fields: str, skip: int = 0, count: int = -1, split: int = SPLIT_BYTES) -> DataFrame:
    """A file, or a folder of files, of fixed-width records, read in ranges of whole records, many tasks a file."""
    spark.dataSource.register(BinaryRecords)
    return spark.read.format("fixed_records").option("format", spec).option("fields", fields).option("skip", skip).option("count", count).option("split", split).load(path)


def write_binary(df: DataFrame, path: str, spec: str) -> None:
    """Records as files of fixed width in a folder."""
    df.sparkSession.dataSource.register(BinaryRecords)
    df.write.format("fixed_records").option("format", spec).option("fields", ",".join(df.columns)).mode("append").save(path)


#: Ranges of the integer types.
_RANGES = {k: (-(1 << 8 * n - 1), (1 << 8 * n - 1) - 1) for k, n in (("b", 1), ("w", 2), ("i", 4), ("l", 8))} | {k: (0, (1 << 8 * n) - 1) for k, n in (("ub", 1), ("uw", 2), ("ui", 4), ("ul", 8))}


def cast_records(df: DataFrame, spec: str, to: str, force: bool = False) -> DataFrame:
    """Fields of one format as fields of another. Narrowing (a type that can't hold all values of the other) is an error;
    forced, integers wrap and fractions are cut. A time comes only from a string or a time."""
    out = []
    for c, a, b in zip(df.columns, expand_format(spec), expand_format(to), strict=True):
        x, text = F.col(f"`{c}`"), a.startswith("s[") or a == "c"
        if b in _TIMES:
            if not text and a not in _TIMES:
                raise ValueError(f"{c}: a time can't be made of {a}")
            out.append((parse_time(x, "iso") if text else x).alias(c))
            continue
        if b.startswith("s[") or b == "c":
            size = 1 if b == "c" else int(b[2:-1])
            if not force and text and int(a[2:-1] if a != "c" else 1) > size:
                raise ValueError(f"{c}: {a} doesn't fit {b}")
            out.append((F.substring(x.cast("string"), 1, size) if force else x.cast("string")).alias(c))
            continue
        if a in _TIMES or text:
            raise ValueError(f"{c}: {b} can't be made of {a}")
        if b in ("f", "d"):
            if not force and (b == "f" and a not in ("b", "ub", "w", "uw", "f")):
                raise ValueError(f"{c}: {a} doesn't fit {b}")
            out.append(x.cast(TYPES[b][0]).alias(c))
            continue
        low, high = _RANGES[b]
        if not force and (a in ("f", "d") or _RANGES[a][0] < low or _RANGES[a][1] > high):
            raise ValueError(f"{c}: {a} doesn't fit {b}")
        whole = (F.floor(F.abs(x)) * F.signum(x)).cast("decimal(38,0)") if a in ("f", "d") else x.cast("decimal(38,0)")
        span = F.lit(str(high - low + 1)).cast("decimal(38,0)")
        out.append((F.pmod(whole - F.lit(str(low)).cast("decimal(38,0)"), span) + F.lit(str(low)).cast("decimal(38,0)")).cast(TYPES[b][0]).alias(c))
    return df.select(*out)


def layout_distances(records: DataFrame, most: int, record: str = "record") -> DataFrame:
    """Of the bytes of long values: how often the next equal byte stands so far away (up to most). Peaks tell the size of
    the records that a binary file is made of."""

    def run(batches):
        for b in batches:
            total = np.zeros(most + 1, dtype=np.int64)
            for x in b.column(0).cast(pa.large_binary()).drop_null().to_pylist():
                data = np.frombuffer(x, dtype=np.uint8)
                order = np.argsort(data, kind="stable")
                gap = np.diff(order)[data[order][1:] == data[order][:-1]]
                total += np.bincount(gap[gap <= most], minlength=most + 1)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["distance", "n"])

    return records.select(record).mapInArrow(run, "distance long, n long").groupBy("distance").agg(F.sum("n").alias("n"))


def line_lengths(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines with their length in bytes before them, as a frame of two columns."""
    return lines.select(F.octet_length(line).alias("length"), line)


def sql_inserts(df: DataFrame, table: str) -> DataFrame:
    """An insert statement for each record."""
    value = lambda c, t: F.when(F.col(c).isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'")) if t == "string" else F.col(c).cast("string"))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({','.join(df.columns)}) VALUES ("), F.concat_ws(",", *(value(c, t) for c, t in df.dtypes)), F.lit(");")).alias("statement"))
