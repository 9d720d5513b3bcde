"""Generated records: sequences, indices of N-dimensional arrays, random values. All are ranges, made in parallel."""

from __future__ import annotations

from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fold import folded


def line_numbers(spark: SparkSession, count: int, begin: int = 0, step: int = 1, block_size: int = 1, index: bool = False, reverse: bool = False) -> DataFrame:
    """`number`: begin, begin + step and so on, each block_size times; with index, the place within its block instead,
    counting down if reverse."""
    lines = spark.range(count)
    place = F.col("id") % block_size
    if index:
        return lines.select((F.lit(block_size - 1) - place if reverse else place).alias("number"))
    return lines.select((F.lit(begin) + F.floor(F.col("id") / block_size) * step * (-1 if reverse else 1)).alias("number"))


def indices(spark: SparkSession, shape: list[int], repeat: int = 1) -> DataFrame:
    """`i0`, `i1` ... over all places of an array, the last dimension fastest; the whole `repeat` times."""
    return spark.range(prod(shape) * repeat).select(*(F.pmod(F.floor(F.col("id") / prod(shape[k + 1 :])), F.lit(n)).cast("long").alias(f"i{k}") for k, n in enumerate(shape)))


def random_values(spark: SparkSession, count: int, distribution: str = "uniform", a: float = 0.0, b: float = 1.0, seed: int | None = 0, parts: int | None = None, kind: str = "double", between: tuple[float, float] | None = None) -> DataFrame:
    """`value`: uniform in [a, b), normal with mean a and deviation b, or exponential with rate a, as a type of Spark's.
    The same for a seed and number of partitions; without a seed, other values each time. between: values out of the
    range are drawn again."""
    if distribution not in ("uniform", "normal", "exponential"):
        raise ValueError(f"distribution {distribution!r}: expected one of uniform, normal, exponential")
    rows = spark.range(0, count, 1, parts)
    u = F.rand(seed) if seed is not None else F.rand()
    whole = kind in ("byte", "short", "int", "long")
    if between is not None and distribution != "uniform":
        return _redrawn(rows, distribution, a, b, seed, between).select((F.floor("value") if whole else F.col("value")).cast(kind).alias("value"))
    low, high = (max(a, between[0]), min(b, between[1])) if between is not None else (a, b)
    n = F.randn(seed) if seed is not None else F.randn()
    value = {"uniform": lambda: u * (high - low) + low, "normal": lambda: n * b + a, "exponential": lambda: -F.log1p(-u) / (a or 1.0)}[distribution]()
    return rows.select((F.floor(value) if whole else value).cast(kind).alias("value"))


def _redrawn(rows: DataFrame, distribution: str, a: float, b: float, seed: int | None, between: tuple[float, float]) -> DataFrame:
    """Values of which those out of the range are drawn again, a batch at a time."""
    low, high = between
    if distribution == "exponential" and high <= 0 or low >= high:
        raise ValueError(f"no {distribution} value lies between {low} and {high}")

    def run(batches):
        draw = np.random.default_rng(None if seed is None else [seed, TaskContext.get().partitionId()])
        one = (lambda n: draw.normal(a, b, n)) if distribution == "normal" else (lambda n: draw.exponential(1 / (a or 1.0), n))
        for batch in batches:
            out = one(batch.num_rows)
            while len(beyond := np.flatnonzero((out < low) | (out > high))):
                out[beyond] = one(len(beyond))
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])

    return rows.mapInArrow(run, "value double")


def with_random(df: DataFrame, seed: int | None = None, out: str = "random") -> DataFrame:
    """Records with a uniform value appended."""
    return df.withColumn(out, F.rand(seed) if seed is not None else F.rand())


def split_to_files(df: DataFrame, ids: list[str], folder: str, kind: str = "parquet") -> None:
    """A directory for each id; rows of one id from several tasks become several files in it."""
    df.write.partitionBy(*ids).format(kind).mode("errorifexists").save(folder)


def by_period(df: DataFrame, t: str, period: float, by: list[str], order: list[str], out: str = "file") -> DataFrame:
    """The time at which each record's file begins: a new one where t is more than period seconds after the first time of
    the file, so the data anchor the files, not a grid. For split_to_files(). One key's records are one task's."""
    limit = round(period * 1_000_000)

    def step(state, row):
        at = row["__micros"]
        if state is None or at > state + limit:
            state = at
        return state, (state,)

    placed = df.withColumn("__micros", F.unix_micros(F.col(t).cast("timestamp")))
    return folded(placed, step, [f"{out} long"], by, order).drop("__micros").withColumn(out, F.timestamp_micros(out).cast("timestamp_ntz"))


def by_times(df: DataFrame, t: str, times: list, out: str = "file") -> DataFrame:
    """The last of the listed times at or before each record's; null before the first. The list stands in the plan."""
    listed = F.array(*(F.lit(x).cast("timestamp_ntz") for x in sorted(times)))
    return df.withColumn(out, F.array_max(F.filter(listed, lambda x: x <= F.col(t))))


def numbered(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """Records with their place in the whole order, from 0. order[0] is a number or a time that isn't null: it deals the
    records into ranges, each numbered on its own behind the ranges before; only the bounds and sizes of the ranges (one
    a shuffle partition) are held together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.unix_micros(F.col(order[0]).cast("timestamp")) if dict(df.dtypes)[order[0]].startswith("timestamp") else F.col(order[0])
    at = at.cast("double")
    bounds = df.agg(F.percentile_approx(at, [k / n for k in range(1, n)] or [1.0])).first()[0] or []
    held = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= at)) if bounds else F.lit(0)
    placed = df.withColumn("__range", held.cast("int"))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return placed.withColumn("__own", own).join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range").withColumn(out, (F.col("__own") + F.col("__before")).cast("long")).drop("__range", "__own", "__before")


def seek(positions: DataFrame, records: DataFrame, order: list[str], index: str | None = None, ratio: str | None = None, permissive: bool = False) -> DataFrame:
    """The record at each position, an index from 0 or a ratio of the number of records in [0, 1): as the struct `record`.
    A position out of the records is an error, or goes if permissive."""
    total = records.count()
    place = F.col(index) if index else F.floor(F.col(ratio) * total)
    known = place.between(0, total - 1)
    asked = positions.withColumn("__place", place.cast("long"))
    asked = asked.filter(known if permissive else F.when(F.coalesce(known, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"a position is not among {total} records")).cast("boolean")))
    row = numbered(records, order, "__place").select("__place", F.struct(*records.columns).alias("record"))
    return asked.join(row, "__place").drop("__place")
