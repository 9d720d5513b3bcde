"""Ordered folds: what depends on all records before, and no window expresses."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def folded(df: DataFrame, step: Callable[[object, dict], tuple[object, tuple | None]], new: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Each stream's records in order through step(state, record), which gives the next state (None at first) and the
    values of the new columns ("name type"), or None to drop the record. A stream is one task's, which holds a state and
    a batch of records; without `by` the whole table is one stream. Nulls of `by` are a stream of their own."""
    kinds = T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(new)).fields])
    places = [df.columns.index(c) for c in by]
    n_new = len(new)

    def run(batches):
        stream, state, begun = None, None, False
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in places), strict=True)) if places else [()] * b.num_rows
            keep, values = [], [[] for _ in range(n_new)]
            for k, row in enumerate(b.to_pylist()):
                if not begun or keys[k] != stream:
                    stream, state, begun = keys[k], None, True
                state, got = step(state, row)
                if got is not None:
                    keep.append(k)
                    for v, x in zip(values, got, strict=True):
                        v.append(x)
            taken = b.take(pa.array(keep, type=pa.int64()))
            names = [f.split()[0] for f in new]
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(v, type=_arrow(kinds[c].dataType)) for c, v in zip(names, values, strict=True))], names=[*b.schema.names, *names])

    dealt = df.repartition(*by).sortWithinPartitions(*by, *order) if by else df.repartition(1).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, kinds)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
