"""Joins of record streams: by key, by radius, by time, by interval and by state."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fold import folded

#: Transitions of a state machine that every task may hold.
MOST_MOVES = 100_000


def matching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys, "left_semi")


def not_matching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys, "left_anti")


def flag_matching(df: DataFrame, other: DataFrame, keys: list[str], out: str = "matching") -> DataFrame:
    flags = other.select(*keys).distinct().withColumn(out, F.lit(1))
    return df.join(flags, keys, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def unique(other: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first record of each key."""
    return other.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*other.columns).alias("row"))).alias("least")).select("least.row.*")


def null_safe_join(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join by which null keys equal each other, as they do in groups; the keys come once."""
    right = other.select(*(F.col(f"`{k}`").alias(f"__key_{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`") for c in other.columns if c not in keys))
    met = reduce(lambda x, y: x & y, (df[f"`{k}`"].eqNullSafe(right[f"__key_{i}"]) for i, k in enumerate(keys)), F.lit(True))
    return df.join(right, met, how).drop(*(f"__key_{i}" for i in range(len(keys))))


def unique_strict(other: DataFrame, keys: list[str]) -> DataFrame:
    """The records, of which no two may share a key: fails at run time on a repeated one."""
    counted = other.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*other.columns)).alias("row"))
    ok = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("more than one record for "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True))
    return counted.filter(ok).select("row.*")


def first_matching(df: DataFrame, other: DataFrame, keys: list[str], order: list[str], other_order: list[str]) -> DataFrame:
    """One output a key: its first record on either side; the key is then used up. Null keys match each other."""
    return null_safe_join(unique(df, keys, order), unique(other, keys, other_order), keys)


def equal(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair of records with equal keys."""
    return df.join(other, keys)


def every_pair(df: DataFrame, other: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Each record with each of the other side, which must be a small table: it is counted first, and more than most
    records are an error. The result has the product of both sizes."""
    n = other.limit(most + 1).count()
    if n > most:
        raise ValueError(f"the other side has more than {most} records; give keys to join on")
    return df.crossJoin(F.broadcast(other))


def require_matched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join, which fails at run time on a record without a match."""
    tagged = df.join(other.withColumn("__found", F.lit(True)), keys, "left")
    ok = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True))
    return tagged.filter(ok).drop("__found")


#: Sides whose bytes, as the planner estimates them, have a product up to this are joined as they are.
_SMALL = 1e11
#: Others go to so many partitions; a cell with more pairs than this is dealt over several.
_PARTS, _PAIRS = 800, 5_000_000


def _met(left: DataFrame, right: DataFrame, cells: list[str]) -> DataFrame:
    """Pairs of records that share a cell. Few bytes can make very many pairs, so large sides aren't left to partitions
    (or a broadcast) by bytes: they go to a fixed number, and a cell of very many pairs is cut along its larger side,
    with the smaller one copied to each part."""
    size = lambda d: float(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size(left) * size(right) <= _SMALL:
        return left.join(right, cells)
    counts = left.groupBy(*cells).agg(F.count(F.lit(1)).alias("__l")).join(right.groupBy(*cells).agg(F.count(F.lit(1)).alias("__r")), cells)
    pairs = F.col("__l").cast("double") * F.col("__r")
    parts = F.least(F.ceil(pairs / _PAIRS), F.greatest("__l", "__r").cast("double")).cast("int")
    hot = F.broadcast(counts.filter(pairs > _PAIRS).select(*cells, parts.alias("__parts"), (F.col("__l") >= F.col("__r")).alias("__long")))

    def dealt(d: DataFrame, long: Column) -> DataFrame:
        placed = d.withColumn("__id", F.monotonically_increasing_id()).join(hot, cells, "left")
        part = F.when(F.col("__parts").isNull(), F.array(F.lit(0))).when(long, F.array(F.pmod("__id", "__parts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("__parts") - 1))
        return placed.withColumn("__part", F.explode(part)).drop("__id", "__parts", "__long").repartition(_PARTS, *cells, "__part")

    return dealt(left, F.col("__long")).join(dealt(right, ~F.col("__long")).hint("shuffle_hash"), [*cells, "__part"]).drop("__part")


def radius_join(df: DataFrame, other: DataFrame, x: str | list[str], y: str | list[str], radius: float, nearest: list[str] | None = None) -> DataFrame:
    """Pairs with |x - y| <= radius, in one dimension or (lists of columns) in several, by cells of that width: each right
    record goes to its own cell, each left one to its cell and the neighbours. nearest: the left columns that name a
    record; only the nearest right values stay (ties: the lower). In one dimension those are found in order, not in pairs."""
    xs, ys = ([x], [y]) if isinstance(x, str) else (x, y)
    if nearest is not None and len(xs) == 1:
        return _nearest_within(df, other, xs[0], ys[0], radius, nearest)
    cells = [f"__b{k}" for k in range(len(xs))]
    left, right = df, other
    for b, c, d in zip(cells, xs, ys, strict=True):
        left = left.withColumn(b, F.explode(F.array(*(F.floor(F.col(c) / radius).cast("long") + k for k in (-1, 0, 1)))))
        right = right.withColumn(b, F.floor(F.col(d) / radius).cast("long"))
    apart = F.abs(F.col(xs[0]) - F.col(ys[0])) if len(xs) == 1 else F.sqrt(reduce(lambda u, v: u + v, ((F.col(c) - F.col(d)) ** 2 for c, d in zip(xs, ys, strict=True))))
    met = _met(left, right, cells).drop(*cells).filter(apart <= radius)
    if nearest is None:
        return met
    value = F.struct(*ys)
    best = met.groupBy(*nearest).agg(F.min(F.struct(apart.alias("d"), value.alias("v"))).alias("__best"))
    return null_safe_join(met, best, nearest).filter(value == F.col("__best.v")).drop("__best")


def _nearest_within(df: DataFrame, other: DataFrame, x: str, y: str, radius: float, nearest: list[str]) -> DataFrame:
    """The nearest right value of a record is the last at or below its own or the first above: no pairs are formed but
    those that stay."""
    values = other.select(F.col(y).alias("v")).distinct()
    found = _bounded(df.select(*dict.fromkeys([*nearest, x])), values, x, "v", [], ("lower", "upper"))
    ends = found.select("row.*", F.explode(F.array(F.col("__lower.v"), F.col("__upper.v"))).alias("v")).withColumn("d", F.abs(F.col(x) - F.col("v")))
    best = ends.filter(F.col("d") <= radius).groupBy(*nearest).agg(F.min(F.struct("d", "v")).alias("__best"))
    named = null_safe_join(df, best, nearest).withColumn("__best", F.col("__best.v"))
    return named.join(other, F.col("__best") == F.col(y)).filter(F.abs(F.col(x) - F.col(y)) <= radius).drop("__best")


def _point(c: Column, kind: str) -> Column:
    """A time as whole microseconds, anything else as it is."""
    return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c


#: Records without a key go to ranges of about this many, at most so many of them.
_RANGE, _MOST_RANGES = 50_000, 1000


def _in_ranges(left: DataFrame, right: DataFrame, kind: str) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with the number of the range of their time `__t`, `__range`; how many there are. Of a time that fills
    several ranges the bounding records are in the first, the others are dealt over all."""
    real = kind in ("float", "double")
    point = lambda d: _point(F.col("__t"), d.select("__t").dtypes[0][1]).cast("double" if real else "long")
    points = left.select(point(left).alias("at")).unionByName(right.select(point(right).alias("at")))
    points = points.filter(~F.isnan("at")) if real else points
    n, cuts = points.agg(F.count("at"), F.percentile_approx("at", [k / _MOST_RANGES for k in range(1, _MOST_RANGES)], 10_000)).first()
    step = max(1, math.ceil(_MOST_RANGES * _RANGE / max(n, 1)))
    cuts = (cuts or [])[step - 1 :: step]
    values = sorted(set(cuts))
    times = [cuts.count(v) for v in values] + [1]
    starts = [sum(times[:k]) for k in range(len(times))]
    if not values:
        return left.withColumn("__range", F.lit(0)), right.withColumn("__range", F.lit(0)), 1
    array = lambda of, type_: F.lit(of).cast(f"array<{type_}>")
    values_, starts_, times_ = array(values, "double" if real else "long"), array(starts, "int"), array(times, "int")
    halves = F.lit([1 << k for k in reversed(range(len(values).bit_length()))]).cast("array<int>")

    def placed(d: DataFrame) -> DataFrame:  # how many of the values are less
        at = point(d)
        return d.withColumn("__place", F.aggregate(halves, F.lit(0), lambda i, h: F.when(F.get(values_, i + h - 1) < at, i + h).otherwise(i)))

    left, right = placed(left), placed(right)
    turn = F.when(F.get(values_, F.col("__place")) == point(left), F.pmod(F.monotonically_increasing_id(), F.get(times_, F.col("__place")))).otherwise(F.lit(0)).cast("int")
    left = left.withColumn("__range", F.get(starts_, F.col("__place")) + turn).drop("__place")
    return left, right.withColumn("__range", F.get(starts_, F.col("__place"))).drop("__place"), starts[-1] + 1


def _bounded(df: DataFrame, bounds: DataFrame, t: str, bound_t: str, by: list[str], sides: tuple[str, ...], bound_order: list[str] | None = None) -> DataFrame:
    """Each record as `row`, its time `__t`, and of the sides asked for the last bounding record at or before it,
    `__lower`, and the first after it, `__upper`."""
    df, bounds = df.filter(F.col(t).isNotNull()), bounds.filter(F.col(bound_t).isNotNull())
    bound_type = bounds.select(F.struct(*bounds.columns)).schema[0].dataType
    row_type = df.select(F.struct(*df.columns)).schema[0].dataType
    tie, bound = F.struct(*(bound_order or bounds.columns)), F.struct(*bounds.columns)
    tie_type = bounds.select(tie).schema[0].dataType
    nothing = lambda kind: F.lit(None).cast(kind)
    left = df.select(*by, F.col(t).alias("__t"), F.lit(1).alias("__side"), nothing(tie_type).alias("__tie"), F.struct(*df.columns).alias("row"), *(nothing(bound_type).alias(f"__{s}") for s in sides))
    right = bounds.select(*by, F.col(bound_t).alias("__t"), F.lit(0).alias("__side"), tie.alias("__tie"), nothing(row_type).alias("row"), *(bound.alias(f"__{s}") for s in sides))
    found, keys = left.unionByName(right), by
    if not by and found.select("__t").dtypes[0][1] in ("timestamp", "timestamp_ntz", "tinyint", "smallint", "int", "bigint", "float", "double"):
        ends = {"lower": F.max_by("bound", "tie"), "upper": F.min_by("bound", "tie")}
        least = bounds.select(F.col(bound_t).alias("__t"), bound.alias("bound"), tie.alias("tie")).groupBy("__t").agg(*(ends[s].alias(f"__{s}") for s in sides))
        right = least.select("__t", F.lit(0).alias("__side"), nothing(tie_type).alias("__tie"), nothing(row_type).alias("row"), *(f"__{s}" for s in sides))
        left, right, count = _in_ranges(left, right, found.select("__t").dtypes[0][1])
        # the last bounding record of each range holds over into those after it, the first into those before it
        of_range = right.groupBy("__range").agg(*((F.max_by if s == "lower" else F.min_by)(F.struct("__t", f"__{s}"), "__t").alias(s) for s in sides))
        found = left.unionByName(right)
        ranges = found.sparkSession.range(count).select(F.col("id").cast("int").alias("__range")).join(of_range, "__range", "left")
        for s in sides:
            before = Window.orderBy(F.col("__range") if s == "lower" else F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
            held = ranges.select("__range", F.last(s, True).over(before).alias("held")).filter("held is not null")
            found = found.unionByName(held.select("__range", "held.__t", F.lit(0).alias("__side"), f"held.__{s}"), True)
        keys = ["__range"]
    up = Window.partitionBy(*keys).orderBy("__t", "__side", "__tie")
    down = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in ("__t", "__side", "__tie")))
    for s, order in (("lower", up), ("upper", down)):
        if s in sides:
            found = found.withColumn(f"__{s}", F.last(f"__{s}", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return found.filter("__side = 1").select("row", "__t", *(f"__{s}" for s in sides))


def time_join(df: DataFrame, bounds: DataFrame, t: str, bound_t: str, by: list[str], how: str = "lower", within: Column | None = None, bound_order: list[str] | None = None) -> DataFrame:
    """Each record with one of the bounding records of its key: the last at or before it ("lower"), the first after it
    ("upper"), or the nearer of both ("nearest"; a tie takes the upper). Both sides are sorted together, once for each
    direction; a running last value finds the bound, so a key costs what its records cost, and no range join is made.
    bound_order orders the bounding records of one time (all their columns, if not given): the last of them is the
    lower, the first the upper. The bounding record comes as the struct `bound`; records without one go, and so do those
    for which within fails, or whose time is null. One key's records are one task's; without keys the records go to
    ranges of their times, for which one aggregate is run when called."""
    found = _bounded(df, bounds, t, bound_t, by, ("lower", "upper") if how == "nearest" else (how,), bound_order)
    if how == "nearest":
        kind, bound_kind = dict(df.dtypes)[t], dict(bounds.dtypes)[bound_t]
        at = _point(F.col("__t"), kind)
        gap_low, gap_high = at - _point(F.col(f"__lower.{bound_t}"), bound_kind), _point(F.col(f"__upper.{bound_t}"), bound_kind) - at
        chosen = F.when(F.col("__upper").isNull() | (gap_low < gap_high), F.col("__lower")).otherwise(F.col("__upper"))
    else:
        chosen = F.col(f"__{how}")
    out = found.select("row.*", chosen.alias("bound")).filter("bound is not null")
    return out if within is None else out.filter(within)


def time_difference(t: Column, bound_t: Column, absolute: bool = False) -> Column:
    """Seconds from the bounding record's time to the record's."""
    diff = (F.unix_micros(t.cast("timestamp")) - F.unix_micros(bound_t.cast("timestamp"))) / 1e6
    return F.abs(diff) if absolute else diff


def queue_match(df: DataFrame, other: DataFrame, t: str, other_t: str, by: list[str], most: float) -> DataFrame:
    """Pairs as two queues give them whose fronts are compared: fronts at most `most` seconds apart leave as a pair,
    else the earlier one is purged. other's record comes as the struct `match`. A key's records are folded in order."""
    limit = round(most * 1e6)
    types = T.StructType([*df.schema.fields, T.StructField("match", T.StructType(other.schema.fields))])
    side = lambda d, at, which: d.select(*by, _point(F.col(at), dict(d.dtypes)[at]).alias("__t"), F.lit(which).alias("__side"), F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}).alias("__row"))
    both = side(df, t, 0).unionByName(side(other, other_t, 1))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__t", kind="stable")
        a, b = (rows[rows["__side"] == k][["__t", "__row"]].to_numpy().tolist() for k in (0, 1))
        i = j = 0
        out = []
        while i < len(a) and j < len(b):
            if abs(a[i][0] - b[j][0]) <= limit:
                out.append((a[i][1], b[j][1]))
                i, j = i + 1, j + 1
            elif a[i][0] < b[j][0]:
                i += 1
            else:
                j += 1
        return pd.DataFrame(out, columns=["row", "match"])

    pairs = both.groupBy(*by).applyInPandas(run, "row string, match string")
    return pairs.select(F.from_json("row", T.StructType(df.schema.fields)).alias("row"), F.from_json("match", types["match"].dataType).alias("match")).select("row.*", "match")


#: An interval goes to buckets of the least width, times a power of this, that leaves it in at most as many of them.
_SPREAD = 8


def _levels(intervals: DataFrame, low: Column, high: Column, width: float, levels: int) -> DataFrame:
    """Intervals with the buckets they meet: of a width by their own length, so that each has few. `__level`, `__b`."""
    length = (high - low).cast("double")
    level = F.least(F.greatest(F.ceil(F.log(length / width / _SPREAD) / math.log(_SPREAD)), F.lit(0)), F.lit(levels - 1)).cast("int")
    level = F.when(length > 0, level).otherwise(F.lit(0))
    size = F.lit(float(width)) * F.pow(F.lit(float(_SPREAD)), F.col("__level"))
    first, last = (F.floor(x.cast("double") / size).cast("long") for x in (low, high))
    return intervals.filter(low < high).withColumn("__level", level).withColumn("__b", F.explode(F.sequence(first, last)))


def _level_count(intervals: DataFrame, low: Column, high: Column, width: float) -> int:
    longest = intervals.filter(low < high).agg(F.max((high - low).cast("double"))).first()[0] or 0.0
    return 1 + max(0, math.ceil(math.log(max(longest / width / _SPREAD, 1.0), _SPREAD)))


def _at_levels(df: DataFrame, x: str, width: float, levels: int) -> DataFrame:
    """Records once for each width of bucket: `__level`, `__b`."""
    spread = df.withColumn("__level", F.explode(F.array(*map(F.lit, range(levels)))))
    return spread.withColumn("__b", F.floor(F.col(x).cast("double") / (F.lit(float(width)) * F.pow(F.lit(float(_SPREAD)), F.col("__level")))).cast("long"))


def interval_join(df: DataFrame, intervals: DataFrame, x: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Pairs with low <= x < high, a null bound being open; how "left_semi" or "left_anti": the records with or without
    any interval. By buckets: the longer an interval, the wider its buckets, so that each is in a few of them; a record
    is in one bucket of every width (as many widths as the logarithm of the longest interval). Choose a width near the
    usual length. Open intervals are met apart, each with the records beyond its one bound."""
    a, b = F.col(low), F.col(high)
    if how == "left_semi":
        return contain(df, intervals, x, low, high, width, "__in").filter("__in = 1").drop("__in")
    if how == "left_anti":
        return contain(df, intervals, x, low, high, width, "__in").filter("__in = 0").drop("__in")
    bounded, open_ = intervals.filter(a.isNotNull() & b.isNotNull()), intervals.filter(a.isNull() | b.isNull())
    levels = _level_count(bounded, a, b, width)
    met = _met(_at_levels(df, x, width, levels), _levels(bounded, a, b, width, levels), ["__level", "__b"]).drop("__level", "__b").filter((F.col(x) >= a) & (F.col(x) < b))
    if open_.isEmpty():
        return met
    beyond = (a.isNull() | (F.col(x) >= a)) & (b.isNull() | (F.col(x) < b))
    return met.unionByName(df.filter(F.col(x).isNotNull()).join(open_, beyond))


def split_intervals(intervals: DataFrame, low: str, high: str, by: list[str], least: int = 1, most: int | None = None, limits: tuple | None = None, distinct: bool = True) -> DataFrame:
    """Intervals cut where others of their key begin or end: a row for each piece and each interval over it, with the
    piece's `from` and `to`, the count of intervals over it (`overlap`, from least to most) and the interval's other
    columns. limits stand in for null bounds; without them intervals with a null bound go. Equal records count once
    unless distinct is off. Pieces are numbered by key and each interval takes the numbers from its own start to its
    end, so no pairs of intervals are formed."""
    if limits is not None:
        intervals = intervals.withColumns({low: F.coalesce(F.col(low), F.lit(limits[0])), high: F.coalesce(F.col(high), F.lit(limits[1]))})
    real = intervals.filter(F.col(low) < F.col(high))
    real = real.distinct() if distinct else real
    keys = [f"__by_{k}" for k in range(len(by))]
    at = Window.partitionBy(*keys).orderBy("__at")
    ends = real.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.explode(F.array(F.col(low), F.col(high))).alias("__at")).distinct()
    points = ends.withColumn("__n", F.row_number().over(at)).withColumn("__to", F.lead("__at").over(at))
    same = lambda p, c, x: reduce(lambda u, v: u & v, (real_[b].eqNullSafe(p[k]) for b, k in zip(by, keys, strict=True)), real_[c] == p[x])
    real_ = real
    first, last = points.select(*keys, F.col("__at").alias("__x"), F.col("__n").alias("__first")), points.select(*keys, F.col("__at").alias("__y"), F.col("__n").alias("__last"))
    placed = real_.join(first, same(first, low, "__x")).drop(*keys, "__x")
    real_ = placed
    placed = real_.join(last, same(last, high, "__y")).drop(*keys, "__y")
    pieces = placed.withColumn("__piece", F.explode(F.sequence(F.col("__first"), F.col("__last") - 1))).drop("__first", "__last")
    counts = pieces.groupBy(*by, "__piece").agg(F.count(F.lit(1)).alias("overlap"))
    counts = counts.filter(F.col("overlap") >= least) if most is None else counts.filter(F.col("overlap").between(least, most))
    spans = points.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), F.col("__n").alias("__piece"), F.col("__at").alias("__from"), "__to")
    known = null_safe_join(counts, spans, [*by, "__piece"])
    rest = [c for c in intervals.columns if c not in (low, high, *by)]
    out = null_safe_join(pieces.drop(low, high), known, [*by, "__piece"])
    return out.select(*by, F.col("__from").alias("from"), F.col("__to").alias("to"), *rest, "overlap")


def elementary_intervals(intervals: DataFrame, low: str, high: str, by: list[str]) -> DataFrame:
    """Splits intervals where others of their key begin or end: from, to and the count of intervals over each piece.
    A sweep: +1 at a start, -1 at an end, summed in order; no pairs of intervals are formed."""
    steps = reduce(DataFrame.unionByName, [intervals.select(*by, F.col(c).alias("at"), F.lit(s).alias("s")) for c, s in ((low, 1), (high, -1))])
    points = steps.groupBy(*by, "at").agg(F.sum("s").alias("s"))
    w = Window.partitionBy(*by).orderBy("at")
    return points.select(*by, F.col("at").alias("from"), F.lead("at").over(w).alias("to"), F.sum("s").over(w).cast("long").alias("overlap")).filter("overlap > 0 and `to` is not null")


def block_less(df: DataFrame, other: DataFrame, block: str, by: list[str], ids: list[str]) -> DataFrame:
    """Each record joins, on its ids, the records of the latest block of the other side at or before its own block."""
    stops = other.select(*by, F.col(block).alias("__block")).distinct()
    placed = time_join(df, stops, block, "__block", by).withColumn("__block", F.col("bound.__block")).drop("bound")
    return placed.join(other.withColumnRenamed(block, "__block"), [*by, "__block", *ids])


def state_join(df: DataFrame, moves: DataFrame, start: int, by: list[str], order: list[str]) -> DataFrame:
    """Events that the machine (event, state, next_state) accepts in its current state, with state and next_state; the
    others leave the state as it is. moves is a table of transitions, checked to be small. Each key's events pass
    through one task in order, which holds a state and a batch."""
    table = moves.select("event", "state", "next_state").limit(MOST_MOVES + 1).collect()
    if len(table) > MOST_MOVES:
        raise ValueError(f"more than {MOST_MOVES} transitions")
    to = {(str(r.event), int(r.state)): int(r.next_state) for r in table}

    def step(state, row):
        here = start if state is None else state
        target = to.get((str(row["event"]), here))
        return (here, None) if target is None else (target, (here, target))

    return folded(df, step, ["state int", "next_state int"], by, order)


def contain(df: DataFrame, intervals: DataFrame, x: str, low: str, high: str, width: float, out: str = "contained") -> DataFrame:
    """Flags with 1 the records whose x lies in any [low, high), a null bound being open; 0 the others and null x.
    Bounded intervals go to buckets as in interval_join. Of open ones only the outermost bound on either side matters:
    one row in all."""
    below, above = F.col(low).isNull(), F.col(high).isNull()
    edges = intervals.agg(F.max(F.when(below & ~above, F.col(high))).alias("__below"), F.min(F.when(above & ~below, F.col(low))).alias("__above"), F.coalesce(F.max((below & above).cast("int")), F.lit(0)).alias("__all"))
    bounded = intervals.filter(~below & ~above)
    levels = _level_count(bounded, F.col(low), F.col(high), width)
    spread = _levels(bounded, F.col(low), F.col(high), width, levels).select(F.col(low).alias("__low"), F.col(high).alias("__high"), F.col("__level").alias("__l"), F.col("__b").alias("__c"))
    placed = df.crossJoin(F.broadcast(edges))
    open_ = F.coalesce((F.col(x) < F.col("__below")) | (F.col(x) >= F.col("__above")) | (F.col(x).isNotNull() & (F.col("__all") == 1)), F.lit(False))
    for k in range(levels):  # what no narrower bucket's interval has is looked for in the wider ones
        size = float(width) * _SPREAD**k
        placed = placed.withColumn(f"__b{k}", F.floor(F.col(x).cast("double") / size).cast("long"))
    hits, rest = [], placed
    for k in range(levels):
        of_level = spread.filter(F.col("__l") == k)
        cond = (F.col(f"__b{k}") == F.col("__c")) & (F.col(x) >= F.col("__low")) & (F.col(x) < F.col("__high"))
        hits.append(rest.join(of_level, cond, "left_semi").withColumn(out, F.lit(1)))
        rest = rest.join(of_level, cond, "left_anti")
    every = reduce(DataFrame.unionByName, hits, rest.withColumn(out, open_.cast("int")))
    return every.drop("__below", "__above", "__all", *(f"__b{k}" for k in range(levels)))


def block_wise(df: DataFrame, other: DataFrame, block: str, by: list[str], ids: list[str]) -> DataFrame:
    """The n-th block of one side joins, on ids, the n-th block of the other, whatever their numbers; the other side's
    number is `other_block`. Only the blocks' numbers are ranked, not the records."""

    def placed(side: DataFrame) -> DataFrame:
        stops = side.select(*by, block).distinct().withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(block)))
        return side.join(stops, [*by, block])

    return placed(df).join(placed(other).withColumnRenamed(block, "other_block"), [*by, "__n", *ids]).drop("__n")
