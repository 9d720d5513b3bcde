"""Selections, sorts, deduplication, upserts and reshaping of ordered records."""

from __future__ import annotations

import heapq
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import null_safe_join


def select_records(df: DataFrame, conditions: list[Column], any_of: bool = False, invert: bool = False, flag: str | None = None) -> DataFrame:
    """Records that meet all (or any) of the conditions; with flag, all records and 1 or 0."""
    met = conditions[0]
    for c in conditions[1:]:
        met = met | c if any_of else met & c
    met = F.coalesce(met, F.lit(False))
    met = ~met if invert else met
    return df.withColumn(flag, met.cast("int")) if flag else df.filter(met)


def first_match(df: DataFrame, conditions: list[Column], order: list[str]) -> DataFrame:
    """The one record, first in order, that meets all conditions."""
    return head(select_records(df, conditions), 1, order)


def head(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first n records in order."""
    return df.orderBy(*order).limit(n)


def sort_records(df: DataFrame, keys: list[str], order: list[str], by: list[str] | None = None, reverse: bool = False, unique: bool = False, place: str | None = None) -> DataFrame:
    """Records sorted by keys within each block (`by`, ascending); equal keys keep their order, in reverse too. unique:
    the first record of each key in a block. With place, a column numbers the records of a block from 0 instead, and
    nothing is sorted as a whole."""
    by = by or []
    if unique:
        df = keep_first(df, [*by, *keys], order)
    sort = [F.col(k).desc() if reverse else F.col(k).asc() for k in keys]
    if place:
        return df.withColumn(place, (F.row_number().over(Window.partitionBy(*by).orderBy(*sort, *order)) - 1).cast("long"))
    return df.orderBy(*by, *sort, *order)


def matches(c: str, pattern: str) -> Column:
    """The whole value matches a regular expression."""
    return F.col(c).rlike(f"^(?:{pattern})$")


def is_not_a_value(c: str, kind: str) -> Column:
    """True for nan and for a missing value or time."""
    return F.col(c).isNull() | F.isnan(c) if kind in ("double", "float") else F.col(c).isNull()


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first record of each key. A grouped minimum, so records of one key are reduced before the shuffle."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*df.columns).alias("row"))).alias("least")).select("least.row.*")


def extremes(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Records with the least or the greatest key of their group, ties included; `side` tells which (a group whose
    records all tie is given once, as min)."""
    ends = df.groupBy(*by).agg(F.min(key).alias("__min"), F.max(key).alias("__max"))
    side = F.when(F.col(key) == F.col("__min"), "min").when(F.col(key) == F.col("__max"), "max")
    return null_safe_join(df, ends, by).withColumn("side", side).filter("side is not null").drop("__min", "__max")


def in_order(df: DataFrame, key: str, by: list[str], order: list[str]) -> DataFrame:
    """Without records whose key is below that of a record before."""
    before = F.max(key).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__top", before).filter(F.col("__top").isNull() | (F.col(key) >= F.col("__top"))).drop("__top")


def thin(df: DataFrame, rate: float, by: list[str], order: list[str], invert: bool = False) -> DataFrame:
    """Keeps record n (from 1) if floor(n rate) > floor((n - 1) rate); invert: the others."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    kept = F.floor(F.col("__n") * rate + 1e-9) > F.floor((F.col("__n") - 1) * rate + 1e-9)
    return df.withColumn("__n", n).filter(~kept if invert else kept).drop("__n")


def thin_by_time(df: DataFrame, seconds: Column, period: float, by: list[str], order: list[str]) -> DataFrame:
    """The first record in each cell of a grid that the key's first record anchors."""
    w = Window.partitionBy(*by).orderBy(*order)
    cell = F.floor((seconds - F.first(seconds).over(w)) / period)
    placed = df.withColumn("__cell", cell)
    top = F.max("__cell").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("__top", top).filter("__top is null or __cell > __top").drop("__cell", "__top")


def enumerate_keys(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct keys with a dense id by first appearance and their count. order[0] is a number or a time: it deals the
    keys into ranges, each numbered on its own, and adds up the sizes of the ranges before. Nothing is one task's but
    the ranges' bounds (one number a shuffle partition)."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"), F.count(F.lit(1)).alias("count"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col(f"__first.{order[0]}")
    at = F.unix_micros(at.cast("timestamp")).cast("double") if dict(df.dtypes)[order[0]] in ("timestamp", "timestamp_ntz", "date") else at.cast("double")
    bounds = first.agg(F.percentile_approx(at, [k / n for k in range(1, n)] or [1.0])).first()[0] or []
    held = F.lit(0) if not bounds else F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= at))
    placed = first.withColumn("__range", held.cast("int"))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))  # at most n rows
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__first"))
    out = placed.withColumn("__own", own).join(F.broadcast(offsets), "__range")
    return out.withColumn("id", (F.col("__own") + F.col("__before") - 1).cast("long")).drop("__first", "__range", "__own", "__before")


def enumerate_rows(df: DataFrame, keys: list[str], order: list[str], out: str = "id") -> DataFrame:
    """Every record with its key's dense id by first appearance."""
    return null_safe_join(df, enumerate_keys(df, keys, order).select(*keys, F.col("id").alias(out)), keys)


def running_update(df: DataFrame, fields: list[str], by: list[str], order: list[str], last_only: bool = False, erase=None) -> DataFrame:
    """Every record with the last non-null value of each field so far; or only the final state of each key. A field that
    holds the erasing value is empty from there on, until it has a value again."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = {f.name: f.dataType for f in df.schema}

    def given(c: str) -> Column:
        """A value, or an erased one, in a struct; null where the record says nothing."""
        value = F.col(c)
        if erase is not None:
            value = F.when(value != F.lit(erase), value)
        return F.when(F.col(c).isNotNull(), F.struct(value.cast(kinds[c]).alias("value")))

    if last_only:
        at = F.struct(*order)
        return df.groupBy(*by).agg(*(F.max_by(given(f)["value"], F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields))
    return df.select(*(F.last(given(c), True).over(w)["value"].alias(c) if c in fields else F.col(c) for c in df.columns))


def running_last_block(df: DataFrame, fields: list[str], ids: list[str], block: str, order: list[str]) -> DataFrame:
    """All records of the last block of each id, with the running values, earlier blocks' included."""
    now = running_update(df, fields, ids, order)
    return null_safe_join(now, now.groupBy(*ids).agg(F.max(block).alias(block)), [*ids, block], "left_semi")


def update_line(df: DataFrame, values: dict, keys: list[str]) -> DataFrame:
    """Records of one key, given with its new values in one line, updated; nothing is appended."""
    met = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(values[k])) for k in keys), F.lit(True))
    return df.select(*(F.when(met, F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values and c not in keys and values[c] is not None else F.col(c) for c in df.columns))


def update_from(df: DataFrame, updates: DataFrame, keys: list[str], fields: list[str], matched_only: bool = False) -> DataFrame:
    """Records with their key's update over them (null update values leave the old ones), then unmatched updates."""
    new = updates.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields))
    out = df.join(new, keys, "left").select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns))
    if matched_only:
        return out
    return out.unionByName(updates.join(df, keys, "left_anti").select(*keys, *fields), allowMissingColumns=True)


def sliding_rows(df: DataFrame, size: int, step: int, by: list[str], order: list[str], incremental: bool = False) -> DataFrame:
    """Each record once for every complete window of size records (a new one every step) that holds it: `window`. With
    incremental, windows grow to their size first: those of 1, 2 and so on records, in steps of one, come before."""
    if incremental:
        grown = sliding_rows(df, size, step, by, order).withColumn("window", F.col("window") + size - 1)
        i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
        total = F.count(F.lit(1)).over(Window.partitionBy(*by))
        early = df.withColumn("__i", i.cast("long")).withColumn("__n", F.least(total, F.lit(size - 1))).filter("__i < __n")
        return early.withColumn("window", F.explode(F.sequence(F.col("__i"), F.col("__n") - 1))).drop("__i", "__n").unionByName(grown)
    w = Window.partitionBy(*by).orderBy(*order)
    i = (F.row_number().over(w) - 1).cast("long")
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = df.withColumn("__i", i).withColumn("__n", total)
    low = F.greatest(F.lit(0), F.ceil((F.col("__i") - size + 1) / step)).cast("long")
    high = F.least(F.floor(F.col("__i") / step), F.floor((F.col("__n") - size) / step)).cast("long")
    return placed.withColumn("window", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>")))).drop("__i", "__n")


def concatenate(df: DataFrame, column: str, n: int, by: list[str], order: list[str], wrap: bool = False) -> DataFrame:
    """Each record's value beside the next n - 1 in a sliding window: `c_0` to `c_{n-1}`; wrap goes on with the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, total = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*by))
    out = df.withColumn("__p", place).withColumn("__t", total)
    for k in range(n):
        value = F.lead(column, k).over(w)
        if wrap and k:
            value = F.when(F.col("__p") + k <= F.col("__t"), value).otherwise(F.coalesce(*(F.when(F.col("__p") + k - F.col("__t") == j, F.nth_value(column, j).over(whole)) for j in range(1, k + 1))))
        out = out.withColumn(f"{column}_{k}", value)
    return (out if wrap else out.filter(F.col("__p") + n - 1 <= F.col("__t"))).drop("__p", "__t")


def concatenate_blocks(df: DataFrame, column: str, n: int, by: list[str], order: list[str], step: int = 1) -> DataFrame:
    """Values of n records in one, without overlap: of every (n - 1) * step + 1 records each step-th. `c_0` to `c_{n-1}`
    and the place `part` in the stream; a tail too short for a record is an error, as nothing says how to fill it."""
    size = (n - 1) * step + 1
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    placed = df.select(*by, F.col(column).alias("__v"), i.alias("__i")).withColumn("part", F.floor(F.col("__i") / size).cast("long")).withColumn("__k", F.col("__i") % size)
    cells = [F.max(F.when(F.col("__k") == k * step, F.col("__v"))).alias(f"{column}_{k}") for k in range(n)]
    out = placed.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("__n"), *cells)
    whole = F.when(F.col("__n") < size, F.raise_error(F.lit(f"a block's last {size} records are not complete"))).otherwise(F.lit(True))
    return out.filter(whole).drop("__n")


def fill_holes(df: DataFrame, t: str, period: float, by: list[str], order: list[str], since=None, until=None) -> DataFrame:
    """Repeats a record every period seconds until the next one of its key, and at the next one's time, if that is a
    period or more away: `at`, and `repeated` 1 or 0; sort by (at, repeated desc) for the order of arrival. The last
    record goes on until `until`; the first one is repeated from `since` to its own time as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.make_dt_interval(secs=F.lit(period))
    kind = dict(df.dtypes)[t]
    # whether what was last goes on to now, and when it shows again
    again = lambda last, now: F.when(now >= last + step, F.array_distinct(F.concat(F.sequence(last + step, now, step), F.array(now)))).otherwise(F.array().cast(f"array<{kind}>"))
    ends = F.lead(t).over(w)
    if until is not None:
        ends = F.coalesce(ends, F.lit(until).cast(kind))
    placed = df.withColumn("__next", ends).withColumn("__place", F.row_number().over(w))
    later = F.transform(F.coalesce(again(F.col(t), F.col("__next")), F.array().cast(f"array<{kind}>")), lambda x: F.struct(x.alias("at"), F.lit(1).alias("repeated")))
    times = F.concat(F.array(F.struct(F.col(t).alias("at"), F.lit(0).alias("repeated"))), later)
    if since is not None:
        begin = F.lit(since).cast(kind)
        before = F.concat(F.array(begin), again(begin, F.col(t)))
        times = F.when(F.col("__place") == 1, F.concat(F.transform(before, lambda x: F.struct(x.alias("at"), F.lit(1).alias("repeated"))), times)).otherwise(times)
    return placed.withColumn("__z", F.explode(times)).select(*df.columns, "__z.at", "__z.repeated")


def sliding_sort(df: DataFrame, key: str, size: int, by: list[str], order: list[str], tail: bool = False) -> DataFrame:
    """Sorts within a sliding window: whenever size records of a stream are held, the one with the least key (the
    earliest, of equal keys) leaves; `place` counts from 0. The last size - 1 records are never followed by enough
    others and only leave with tail. A task holds size records; null keys come first."""
    fields = df.columns

    def run(batches):
        heap, stream, place, n = [], None, 0, 0

        def emitted(enough):
            nonlocal place
            while len(heap) >= enough:
                yield {**heapq.heappop(heap)[-1], "place": place}
                place += 1

        for b in batches:
            out = []
            for row in b.to_pylist():
                if (now := tuple(row[c] for c in by)) != stream:
                    out += emitted(1) if tail else ()
                    heap, stream, place, n = [], now, 0, 0
                heapq.heappush(heap, ((row[key] is not None, 0 if row[key] is None else row[key]), n, row))
                n += 1
                out += emitted(size)
            yield pa.RecordBatch.from_pylist(out, schema=b.schema.append(pa.field("place", pa.int64())))
            schema = b.schema
        if tail and heap:
            yield pa.RecordBatch.from_pylist(list(emitted(1)), schema=schema.append(pa.field("place", pa.int64())))

    if size < 2:
        raise ValueError("a sliding window has at least 2 records")
    dealt = df.repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("place", T.LongType())])).select(*fields, "place")


def paste(sides: list[DataFrame], orders: list[list[str]], by: list[str]) -> DataFrame:
    """Zips streams by place within their key; ends with the first stream."""
    placed = [s.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*o))) for s, o in zip(sides, orders, strict=True)]
    out = placed[0]
    for p in placed[1:]:
        out = out.join(p, [*by, "__i"])
    return out.drop("__i")


def _lot(order: list[str], seed: int) -> Column:
    """A record's lot: the same for a seed, wherever and in whatever partition it is drawn."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in order)))


def sample_size(df: DataFrame, size: int, by: list[str], order: list[str], seed: int = 0) -> DataFrame:
    """size records of each block, drawn without replacement; all of a smaller block. Records out of the draw leave
    before the shuffle, as only the first few ranks are kept."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__lot", *order))
    return df.withColumn("__lot", _lot(order, seed)).withColumn("__place", place).filter(F.col("__place") <= size).drop("__lot", "__place")


def sample_ratio(df: DataFrame, ratio: float, order: list[str], seed: int = 0) -> DataFrame:
    """Each record with probability ratio; a filter, no shuffle."""
    return df.filter(F.conv(F.substring(_lot(order, seed), 1, 8), 16, 10).cast("double") < ratio * 2**32)


def shuffled(df: DataFrame, order: list[str], seed: int = 0) -> DataFrame:
    """Records in the order of their lots."""
    return df.withColumn("__lot", _lot(order, seed)).orderBy("__lot", *order).drop("__lot")


def repeat_rows(df: DataFrame, n: int, out: str = "copy") -> DataFrame:
    """Every record n times, numbered from 0."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def concatenated(sources: list[DataFrame], out: str = "source") -> DataFrame:
    """The records of all sources, each with its source's number; by name, whatever the columns' order."""
    return reduce(DataFrame.unionByName, [d.withColumn(out, F.lit(k)) for k, d in enumerate(sources)])


def interleaved(sources: list[DataFrame], orders: list[list[str]], block: int = 1) -> DataFrame:
    """Sources taken in turn, block records of each: `turn` and `source`, by which the result is to be sorted."""
    placed = [d.withColumn("turn", F.floor((F.row_number().over(Window.orderBy(*o)) - 1) / block).cast("long")) for d, o in zip(sources, orders, strict=True)]
    return concatenated(placed)


def erase(df: DataFrame, fields: list[str], value) -> DataFrame:
    """Fields that hold the erasing value become null, as an update then leaves them empty."""
    return df.select(*(F.when(F.col(c) != F.lit(value), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns))


def replay(sources: list[DataFrame], t: str, speed: float = 1.0, since=None, until=None) -> DataFrame:
    """Sources of one shape merged by time: `source`, and `after`, seconds from the first record at the given speed."""
    merged = reduce(DataFrame.unionByName, [s.withColumn("source", F.lit(k)) for k, s in enumerate(sources)])
    for keep in ([F.col(t) >= since] if since is not None else []) + ([F.col(t) <= until] if until is not None else []):
        merged = merged.filter(keep)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first = F.broadcast(merged.agg(F.min(t).alias("__first")))
    return merged.crossJoin(first).withColumn("after", (micros(t) - micros("__first")) / 1e6 / speed).drop("__first").orderBy(t, "source")


def split_rows(df: DataFrame, values: Column, n: int, names: list[str], repeat: int = 0) -> DataFrame:
    """An array's values in rows of n (`part` from 0), each with the array's first `repeat` values before them. A short
    last row ends in nulls; an empty array gives one row of nulls."""
    rest = df.withColumn("__v", values)
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("__v") - repeat) / n).cast("int") - 1))
    placed = rest.withColumn("part", F.explode(parts))
    at = lambda k: F.lit(k) if k < repeat else F.col("part") * n + k
    return placed.select("*", *(F.get("__v", at(k)).alias(c) for k, c in enumerate(names))).drop("__v")
