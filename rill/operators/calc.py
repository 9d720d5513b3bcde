"""Statistics by group: every operation over every named field, named field/operation with the usual suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import folded
from .joins import null_safe_join


def percentile_interpolated(x: str, p: float) -> Column:
    """Place p(n + 1) among the sorted values, linear between neighbours (Hyndman-Fan 6). Sorts a group's values."""
    s = F.array_sort(F.collect_list(x))
    n = F.size(s)
    at = F.lit(p) * (n + 1)
    low = F.floor(at).cast("int")
    between = F.element_at(s, low) + (at - low) * (F.element_at(s, low + 1) - F.element_at(s, low))
    return F.when(n == 0, None).when(at <= 1, F.element_at(s, 1)).when(at >= n, F.element_at(s, -1)).otherwise(between)


def operation(name: str, x: str) -> Column:
    op, *args = name.replace("=", ":").split(":")
    n = F.count(x)
    sample = "sample" in args
    if op in ("min", "max", "sum"):
        return getattr(F, op)(x)
    if op == "mean":
        return F.avg(x)
    if op == "mode":
        return F.mode(x, True)
    if op == "centre":
        return F.min(x) + (F.max(x) - F.min(x)) / 2
    if op == "diameter":
        return F.max(x) - F.min(x)
    if op == "radius":
        return (F.max(x) - F.min(x)) / 2
    if op == "size":
        return n
    if op == "percentile":
        p = float(args[0])
        return percentile_interpolated(x, p) if "interpolate" in args else F.expr(f"percentile_disc({p}) within group (order by `{x}`)")
    if op == "var":
        return F.var_samp(x) if sample else F.var_pop(x)
    if op == "stddev":
        return F.stddev_samp(x) if sample else F.stddev_pop(x)
    if op == "skew":
        return F.skewness(x) * (F.sqrt(n * (n - 1.0)) / (n - 2) if sample else F.lit(1.0))
    if op == "kurtosis":
        excess = F.kurtosis(x)
        if sample:
            excess = F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * excess + 6)).otherwise(F.lit(float("nan")))
        return excess if "excess" in args else excess + 3
    raise ValueError(f"unknown operation {name}")


def column_name(field: str, op: str) -> str:
    return f"{field}_{op.replace('=', '_').replace('.', '_').replace(':', '_')}"


def calc(df: DataFrame, ops: list[str], fields: list[str], by: list[str]) -> DataFrame:
    """One row a group; partial aggregates go before the shuffle."""
    return df.groupBy(*by).agg(*(operation(o, f).alias(column_name(f, o)) for o in ops for f in fields))


def calc_append(df: DataFrame, ops: list[str], fields: list[str], by: list[str], once_in_order: list[str] | None = None) -> DataFrame:
    """All records with their group's statistics, or only the first of each group in the given order. The statistics
    are aggregated first and joined back, so a group with very many records needs no task of its own."""
    stats = calc(df, ops, fields, by)
    if once_in_order:
        row = F.min(F.struct(*once_in_order, F.struct(*df.columns).alias("row"))).alias("least")
        df = df.groupBy(*by).agg(row).select("least.row.*")
    return null_safe_join(df, stats, by)


def _mean_of_whole(x: str) -> Column:
    """The mean of whole numbers as SQL's avg(bigint) has it: a double, the nearest to the quotient (here one of ten
    decimals) of the exact sum and the count."""
    return F.avg(F.col(x).cast("decimal(26,6)")).cast("double")


def typed_calc(df: DataFrame, ops: list[str], fields: list[str], by: list[str]) -> DataFrame:
    """calc() over times as well: least, greatest, mean and centre of a time are times, spreads are seconds; a sum or a
    percentile of times is an error. The mean is SQL's round(avg(microseconds)): the quotient is a double, which has
    quarters of a microsecond in these years, so that it can be one off the exact mean."""
    kinds = dict(df.dtypes)
    times = [f for f in fields if kinds[f].startswith("timestamp")]
    for o in ops if times else []:
        if o.split("=")[0] in ("sum", "percentile"):
            raise ValueError(f"{o}: not defined for times")
    micros = df.withColumns({f: F.unix_micros(F.col(f).cast("timestamp")).cast("decimal(20,0)") for f in times})  # whole, so a sum loses nothing
    aggregate = lambda o, f: _mean_of_whole(f) if f in times and o == "mean" else operation(o, f)
    out = micros.groupBy(*by).agg(*(aggregate(o, f).alias(column_name(f, o)) for o in ops for f in fields))
    for f in times:
        for o in ops:
            c, op = column_name(f, o), o.split("=")[0]
            if op in ("min", "max", "mean", "centre", "mode"):
                out = out.withColumn(c, F.timestamp_micros(F.round(F.col(c)).cast("long")).cast(kinds[f]))
            elif op in ("diameter", "radius", "stddev"):
                out = out.withColumn(c, F.col(c) / 1e6)
            elif op == "var":
                out = out.withColumn(c, F.col(c) / 1e12)
    return out


def moving_average(df: DataFrame, field: str, alpha: float, by: list[str], order: list[str], spread: int = 1, out: str = "average") -> DataFrame:
    """Exponential moving average; the plain mean of the first `spread` values."""

    def step(state, row):
        n, value = state or (0, 0.0)
        x = row[field]
        n += 1
        value = value + (x - value) / n if n <= spread else value + (x - value) * alpha
        return (n, value), (value,)

    return folded(df, step, [f"{out} double"], by, order)


def interval_stats(df: DataFrame, t: str, by: list[str], order: list[str]) -> DataFrame:
    """Of the seconds between successive records: count, mean, least, greatest and deviation."""
    gap = (F.unix_micros(F.col(t).cast("timestamp")) - F.unix_micros(F.lag(t).over(Window.partitionBy(*by).orderBy(*order)).cast("timestamp"))) / 1e6
    gaps = df.select(*by, gap.alias("gap"))
    return gaps.groupBy(*by).agg(F.count("gap").alias("intervals"), F.avg("gap").alias("mean"), F.min("gap").alias("least"), F.max("gap").alias("greatest"), F.stddev_pop("gap").alias("deviation"))
