"""Streams: joins, updates, blocks, thinning and watchdogs on Structured Streaming's keyed state; routing of batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_join(left: DataFrame, right: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Each left record with the newest right value of its key that came before it; none yet: dropped. One value of
    state a key; both sides have the columns (key, t, value)."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([t, "side"], kind="stable")
        last = state.get[0] if state.exists else None
        out = []
        for at, v, side in zip(rows[t], rows[value], rows["side"], strict=True):
            if side == 0:
                last = v
            elif last is not None:
                out.append((k[0], at, v, last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, t, value, "latest"])

    both = left.select(key, t, value).withColumn("side", F.lit(1)).unionByName(right.select(key, t, value).withColumn("side", F.lit(0)))
    kinds = dict(left.dtypes)
    return both.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {t} {kinds[t]}, {value} {kinds[value]}, latest {kinds[value]}", f"last {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def gate(left: DataFrame, control: DataFrame, key: str, t: str, value: str, open_above: float) -> DataFrame:
    """Left records while the newest control value of their key is above a level."""
    return latest_join(left, control, key, t, value).filter(F.col("latest") > open_above).drop("latest")


def hold_last(df: DataFrame, key: str, value: str, period_ms: int) -> DataFrame:
    """Every record, and its value again once a key was silent for a period of processing time (repeated = 1)."""
    kinds = dict(df.dtypes)

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, repeated = state.get[0], 1
            yield pd.DataFrame([(k[0], last, repeated)], columns=[key, value, "repeated"])
        else:
            rows = pd.concat(list(frames))
            state.update((rows[value].iloc[-1],))
            yield pd.DataFrame({key: k[0], value: rows[value], "repeated": 0})
        state.setTimeoutDuration(period_ms)

    return df.select(key, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {value} {kinds[value]}, repeated int", f"last {kinds[value]}", "append", GroupStateTimeout.ProcessingTimeTimeout)


def bandwidth(df: DataFrame, t: str, payload: str, window: str, slide: str, late: str) -> DataFrame:
    """Records and bytes by sliding window of event time."""
    return df.withWatermark(t, late).groupBy(F.window(t, window, slide)).agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length(payload)).alias("bytes")).select("window.start", "window.end", "records", "bytes")


def _micros(x) -> int:
    return int(pd.Timestamp(x).value // 1000) if not isinstance(x, (int, float)) else x


def bounded_join(left: DataFrame, bounds: DataFrame, key: str, t: str, value: str, most: int | None = None) -> DataFrame:
    """Time join of live streams, both with the columns (key, t, value) and in order of time within a key: a left record
    waits until a bounding record at or after its time has come, then leaves with the last bound at or before it (those
    without one go). State: the waiting records and the bounds that may still matter. most: waiting records a key may
    have; beyond, the oldest leave with the bound known so far."""
    kinds = dict(left.dtypes)

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([t, "side"], kind="stable")
        waiting, held = (json.loads(x) for x in state.get) if state.exists else ([], [])
        out = []

        def settle(enough):
            while waiting and enough(waiting[0]):
                at, raw = waiting.pop(0)
                known = [b for b in held if b[0] <= at]
                if known:
                    held[:] = held[held.index(known[-1]) :]
                    out.append((k[0], at, raw, known[-1][1]))

        for at, v, side in zip(rows[t], rows[value], rows["side"], strict=True):
            if side == 0:
                held.append([_micros(at), v])
                settle(lambda w: w[0] <= held[-1][0])
            else:
                waiting.append([_micros(at), v])
                settle(lambda w: most is not None and len(waiting) > most)
        if not waiting:
            held[:] = held[-1:]
        state.update((json.dumps(waiting), json.dumps(held)))
        yield pd.DataFrame(out, columns=[key, "at", value, "bound"])

    both = left.select(key, t, value).withColumn("side", F.lit(1)).unionByName(bounds.select(key, t, value).withColumn("side", F.lit(0)))
    return both.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, at long, {value} {kinds[value]}, bound {kinds[value]}", "waiting string, held string", "append", GroupStateTimeout.NoTimeout)


def watchdog(df: DataFrame, key: str, timeout_ms: int, fail: bool = False) -> DataFrame:
    """A row (key, silent_ms) once a key was silent for the timeout; with fail, the query fails instead."""
    kind = dict(df.dtypes)[key]

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if fail:
                raise TimeoutError(f"{k[0]}: nothing for {timeout_ms} ms")
            state.remove()
            yield pd.DataFrame([(k[0], timeout_ms)], columns=[key, "silent_ms"])
        else:
            for _ in frames:
                pass
            state.update((True,))
            state.setTimeoutDuration(timeout_ms)
            yield pd.DataFrame([], columns=[key, "silent_ms"])

    return df.select(key).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, silent_ms long", "seen boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def thin_by_clock(df: DataFrame, key: str, value: str, period_ms: int) -> DataFrame:
    """Of each key a record, then none until the period of processing time has passed."""
    kinds = dict(df.dtypes)

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, rows = state.getCurrentProcessingTimeMs(), pd.concat(list(frames))
        if state.exists and now < state.get[0] + period_ms:
            yield rows.iloc[:0][[key, value]]
        else:
            state.update((now,))
            yield rows.iloc[:1][[key, value]]

    return df.select(key, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {value} {kinds[value]}", "last long", "append", GroupStateTimeout.NoTimeout)


def block_totals(df: DataFrame, key: str, block: str, value: str) -> DataFrame:
    """Count, sum, least and greatest value of each block of a key, out when the key's block changes; the last block is
    open until then. Records come in order within a key. State: one block's totals."""
    kinds = dict(df.dtypes)

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        out = []
        for f in frames:
            for b, v in zip(f[block], f[value], strict=True):
                if now is not None and now[0] != b:
                    out.append((k[0], *now))
                    now = None
                now = [b, 1, v, v, v] if now is None else [b, now[1] + 1, now[2] + v, min(now[3], v), max(now[4], v)]
        if now is not None:
            state.update(tuple(now))
        yield pd.DataFrame(out, columns=[key, block, "n", "total", "least", "greatest"])

    return df.select(key, block, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {block} {kinds[block]}, n long, total double, least double, greatest double", f"{block} {kinds[block]}, n long, total double, least double, greatest double", "append", GroupStateTimeout.NoTimeout)


def running_update(df: DataFrame, key: str, t: str, fields: list[str]) -> DataFrame:
    """Every record with the latest value of each field of its key so far."""
    kinds = dict(df.dtypes)

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None] * len(fields)
        rows = pd.concat(list(frames)).sort_values(t, kind="stable")
        out = []
        for at, *values in zip(rows[t], *(rows[f] for f in fields), strict=True):
            now = [o if pd.isna(v) else v for o, v in zip(now, values, strict=True)]
            out.append((k[0], at, *now))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=[key, t, *fields])

    shape = ", ".join(f"{f} {kinds[f]}" for f in fields)
    return df.select(key, t, *fields).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {t} {kinds[t]}, {shape}", shape, "append", GroupStateTimeout.NoTimeout)


def routed(df: DataFrame, by: str, sinks: dict, rest=None):
    """A batch function for foreachBatch: the records of each value of a column to its sink (a function of a DataFrame),
    the others to the rest, if given. The batch is read once."""

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for value, sink in sinks.items():
                sink(batch.filter(F.col(by) == value))
            if rest is not None:
                rest(batch.filter(~F.coalesce(F.col(by).isin(list(sinks)), F.lit(False))))
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(run)


def tee(df: DataFrame, *sinks):
    """Every batch to each of several sinks (functions of a DataFrame); the batch is read once."""

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(run)


def paced(df: DataFrame, seconds: float):
    """A writer that starts a batch every so many seconds."""
    return df.writeStream.trigger(processingTime=f"{round(seconds * 1000)} milliseconds")
