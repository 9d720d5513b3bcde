"""Runs of records ("blocks"), by windows over an order within a partition key.

Every function takes `by`, the columns that split the stream into independent ones, and `order`, a unique order within
each. Without `by` the whole stream is one ordered sequence, and Spark runs such a window in one task; give `by`, or
number the blocks upstream, for streams that don't fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import folded
from .joins import null_safe_join


def window(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def group_by_change(df: DataFrame, ids: list[str], by: list[str], order: list[str], out: str = "block") -> DataFrame:
    """Block number from 0, up by one where the id columns differ from the record before."""
    w = window(by, order)
    same = F.lit(True)
    for c in ids:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    change = F.when((F.row_number().over(w) > 1) & ~same, 1).otherwise(0)
    return df.withColumn("__change", change).withColumn(out, F.sum("__change").over(w).cast("long")).drop("__change")


def group_by_gap(df: DataFrame, scalar: Column, gap: float, by: list[str], order: list[str], out: str = "block") -> DataFrame:
    """A new block where |x - previous x| >= gap."""
    w = window(by, order)
    change = F.when(F.abs(scalar - F.lag(scalar).over(w)) >= gap, 1).otherwise(0)
    return df.withColumn("__change", change).withColumn(out, F.sum("__change").over(w).cast("long")).drop("__change")


def group_by_span(df: DataFrame, scalar: str, span: float, by: list[str], order: list[str], out: str = "block") -> DataFrame:
    """A new block where |x - first x of the block| >= span. The block's start depends on the block before, so a key's
    records pass through one task in order, which holds a start and a number. x is a number or a time (span in seconds)."""
    timed = dict(df.dtypes)[scalar].startswith("timestamp")
    x = F.unix_micros(F.col(scalar).cast("timestamp")) / 1e6 if timed else F.col(scalar).cast("double")

    def step(state, row):
        start, n = state or (None, -1)
        if start is None or abs(row["__x"] - start) >= span:
            start, n = row["__x"], n + 1
        return (start, n), (n,)

    return folded(df.withColumn("__x", x), step, [f"{out} long"], by, order).drop("__x")


def group_by_range(df: DataFrame, scalar: Column, low: float, high: float, by: list[str], order: list[str], out: str = "block", discard: bool = False) -> DataFrame:
    """Block number goes up on entering or leaving [low, high]; with discard, records outside go and leaving alone counts."""
    w = window(by, order)
    inside = F.coalesce(scalar.between(low, high), F.lit(False))
    before = F.lag(inside).over(w)
    change = F.when(before & ~inside if discard else before != inside, 1).otherwise(0)
    numbered = df.withColumn("__in", inside).withColumn("__change", change).withColumn(out, F.sum("__change").over(w).cast("long"))
    return (numbered.filter("__in") if discard else numbered).drop("__change", "__in")


def group_by_count(df: DataFrame, size: int, by: list[str], order: list[str], out: str = "block") -> DataFrame:
    """Blocks of size records each, from 0."""
    return df.withColumn(out, F.floor((F.row_number().over(window(by, order)) - 1) / size).cast("long"))


def index(df: DataFrame, by: list[str], order: list[str], reverse: bool = False, out: str = "index") -> DataFrame:
    """Place in the block, from 0; reverse counts down to 0."""
    ahead = (F.row_number().over(window(by, order)) - 1).cast("long")
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(out, total - 1 - ahead if reverse else ahead)


def head(df: DataFrame, n: int, block: str, by: list[str]) -> DataFrame:
    """The first n blocks of each stream."""
    return df.withColumn("__rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(block))).filter(F.col("__rank") <= n).drop("__rank")


def read_until(df: DataFrame, done: Column, by: list[str], order: list[str], inclusive: bool = True) -> DataFrame:
    """Records up to the first for which done holds, with it if inclusive."""
    w = window(by, order).rowsBetween(Window.unboundedPreceding, -1 if inclusive else Window.currentRow)
    return df.withColumn("__done", F.coalesce(F.max(F.coalesce(done, F.lit(False)).cast("int")).over(w), F.lit(0))).filter("__done = 0").drop("__done")


def accumulate(df: DataFrame, ids: list[str], by: list[str], order: list[str], block: str = "block") -> DataFrame:
    """At the end of each block, the last record of every id seen so far, with the block's number. Blocks count up by
    one. Only the last record of an id in a block is carried on."""
    rest = [c for c in df.columns if c not in {*by, *ids, block}]
    last = df.groupBy(*by, *ids, block).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    tops = df.groupBy(*by).agg(F.max(block).alias("__top"))
    ended = last.join(tops, by) if by else last.crossJoin(F.broadcast(tops))
    until = F.coalesce(F.lead(block).over(Window.partitionBy(*by, *ids).orderBy(block)) - 1, F.col("__top"))
    carried = ended.withColumn("__until", until).withColumn(block, F.explode(F.sequence(F.col(block), F.col("__until"))))
    return carried.select(*by, *ids, block, "__row.*")


def increment(df: DataFrame, step: int, block: str = "block", out: str = "next_block") -> DataFrame:
    return df.withColumn(out, F.col(block) + step)


def last_block(df: DataFrame, ids: list[str], block: str = "block") -> DataFrame:
    """All records of the last block of each id."""
    return null_safe_join(df, df.groupBy(*ids).agg(F.max(block).alias(block)), [*ids, block], "left_semi")
