"""Assignments such as ``a=x+y;b=where(x>1,y,0)`` as columns, so that Catalyst sees them. What has no column form runs as
numpy over Arrow batches, what carries values from record to record as an ordered fold."""

from __future__ import annotations

import ast
import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.blocks import read_until
from ..operators.fold import folded

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Mod: lambda a, b: F.pmod(a, b), ast.FloorDiv: lambda a, b: F.floor(a / b), ast.Pow: F.pow, ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
_CALLS = {
    "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "clip": lambda x, a, b: F.least(F.greatest(x, a), b),
    "minimum": F.least,
    "maximum": F.greatest,
    "abs": F.abs,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": F.log,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arctan2": F.atan2,
    "floor": F.floor,
    "ceil": F.ceil,
    "round": F.round,
    "sign": F.signum,
    "isnan": F.isnan,
    "logical_and": lambda a, b: a & b,
    "logical_or": lambda a, b: a | b,
    "logical_not": lambda a: ~a,
    "logical_xor": lambda a, b: a != b,
    "power": F.pow,
    "mod": F.pmod,
    "fmod": lambda a, b: a % b,
    "square": lambda a: a * a,
    "cbrt": F.cbrt,
    "hypot": F.hypot,
    "log10": F.log10,
    "log2": F.log2,
    "log1p": F.log1p,
    "expm1": F.expm1,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "degrees": F.degrees,
    "radians": F.radians,
    "rint": F.rint,
    "trunc": lambda a: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)),
    "bitwise_and": lambda a, b: a.bitwiseAND(b),
    "bitwise_or": lambda a, b: a.bitwiseOR(b),
    "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "less": lambda a, b: a < b,
    "less_equal": lambda a, b: a <= b,
    "greater": lambda a, b: a > b,
    "greater_equal": lambda a, b: a >= b,
    "isfinite": lambda a: ~F.isnan(a) & (F.abs(a) < float("inf")),
    "isinf": lambda a: F.abs(a) == float("inf"),
    "char.upper": F.upper,
    "char.lower": F.lower,
    "char.strip": F.trim,
    "char.add": F.concat,
    "char.str_len": F.length,
    "char.startswith": lambda a, b: F.startswith(a, b),
    "char.endswith": lambda a, b: F.endswith(a, b),
    "char.replace": F.replace,
    "seconds": lambda a: F.make_dt_interval(secs=a),
}
_OVER = {"min": F.least, "max": F.greatest}


def _function(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    return f"{node.value.id}.{node.attr}" if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) else None


def column(node: ast.AST, names: dict[str, Column]) -> Column:
    match node:
        case ast.Expression(body=body):
            return column(body, names)
        case ast.Constant(value=value):
            return F.lit(value)
        case ast.Name(id=name):
            if name not in names:
                raise ValueError(f"unknown field {name}")
            return names[name]
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            return _BINARY[type(op)](column(a, names), column(b, names))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -column(x, names)
        case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
            return ~column(x, names)
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
            return _COMPARE[type(op)](column(a, names), column(b, names))
        case ast.Call(func=func, args=args, keywords=[]) if _function(func) in _CALLS:
            return _CALLS[_function(func)](*(column(x, names) for x in args))
        case ast.Call(func=ast.Name(id=name), args=[ast.Tuple(elts=parts) | ast.List(elts=parts)], keywords=[ast.keyword(arg="axis", value=ast.Constant(value=0))]) if name in _OVER:
            return _OVER[name](*(column(x, names) for x in parts))
    raise ValueError(f"can't express {ast.unparse(node)}")


def evaluate(df: DataFrame, code: str) -> DataFrame:
    """Assigned fields are replaced, new ones appended; later assignments see earlier ones."""
    for name, value in assignments(code):
        df = df.withColumn(name, column(value, {c: F.col(c) for c in df.columns}))
    return df


_ARRAY_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv, ast.Pow: operator.pow, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.xor}
_ARRAY_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
#: Functions of arrays beside numpy's element-wise ones.
_ARRAY_CALLS = {"where": np.where, "clip": np.clip, "round": np.round, "nan_to_num": np.nan_to_num, "select": np.select, "interp": np.interp, "isin": np.isin, "min": lambda x, axis: np.min(x, axis=axis), "max": lambda x, axis: np.max(x, axis=axis)}


def array_value(node: ast.AST, names: dict):
    """An expression over numpy arrays (or plain numbers) by name; only numpy's element-wise functions and a few others
    can be called, and nothing is handed to the interpreter."""
    match node:
        case ast.Expression(body=body):
            return array_value(body, names)
        case ast.Constant(value=value):
            return value
        case ast.Name(id=name) if name in names:
            return names[name]
        case ast.Tuple(elts=parts) | ast.List(elts=parts):
            return [array_value(x, names) for x in parts]
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARRAY_BINARY:
            return _ARRAY_BINARY[type(op)](array_value(a, names), array_value(b, names))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -array_value(x, names)
        case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
            return np.logical_not(array_value(x, names))
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _ARRAY_COMPARE:
            return _ARRAY_COMPARE[type(op)](array_value(a, names), array_value(b, names))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=more) if name in _ARRAY_CALLS or isinstance(getattr(np, name, None), np.ufunc):
            call = _ARRAY_CALLS.get(name) or getattr(np, name)
            return call(*(array_value(x, names) for x in args), **{k.arg: array_value(k.value, names) for k in more})
    raise ValueError(f"can't express {ast.unparse(node)}")


def assignments(code: str) -> list[tuple[str, ast.AST]]:
    out = []
    for statement in ast.parse(code).body:
        if not isinstance(statement, ast.Assign) or len(statement.targets) != 1 or not isinstance(statement.targets[0], ast.Name):
            raise ValueError("only assignments to fields are possible")
        out.append((statement.targets[0].id, statement.value))
    return out


def evaluate_batches(df: DataFrame, code: str, new: dict[str, str] | None = None) -> DataFrame:
    """evaluate() for functions that have no column form: numpy over Arrow batches. new: types of appended fields (double,
    if not given); assigned fields keep theirs."""
    made, kinds = assignments(code), dict(df.dtypes)
    new = {n: (new or {}).get(n, "double") for n, _ in made if n not in kinds}
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in new.items())).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            names = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names)}
            for n, node in made:
                value = array_value(node, names)
                names[n] = np.full(b.num_rows, value) if np.ndim(value) == 0 else value
            changed = {n for n, _ in made}
            columns = [pa.array(names[f.name], from_pandas=False).cast(f.type, safe=False) if f.name in changed else b.column(f.name) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def evaluate_running(df: DataFrame, code: str, initial: dict[str, float], by: list[str], order: list[str]) -> DataFrame:
    """evaluate() with variables that live from record to record of a stream, such as `total=total+x` from 0. All
    variables with an initial value come out as fields, as they are after the record."""
    made = assignments(code)
    kind = {bool: "boolean", int: "long", float: "double", str: "string"}
    fresh = [f"{n} {kind[type(v)]}" for n, v in initial.items()] + [f"{n} double" for n, _ in made if n not in initial and n not in df.columns]
    if set(df.columns) & {n for n, _ in made}:
        raise ValueError("fields of the records can't be assigned with running values")
    names_out = [f.split()[0] for f in fresh]
    cast = [{"boolean": bool, "long": int, "double": float, "string": str}[f.split()[1]] for f in fresh]

    def step(state, row):
        names = {**row, **(initial if state is None else state)}
        for n, node in made:
            names[n] = array_value(node, names)
        return {n: names[n] for n in initial}, tuple(c(names[n]) for n, c in zip(names_out, cast, strict=True))

    return folded(df, step, fresh, by, order)


def until(df: DataFrame, code: str, by: list[str], order: list[str], with_error: bool = False) -> DataFrame:
    """Records before the first for which the condition holds; with_error, such a record is an error instead."""
    if with_error:
        return df.filter(F.when(condition(df, code), F.raise_error(F.concat(F.lit(f"{code}: "), F.to_json(F.struct(*df.columns))))).otherwise(F.lit(True)))
    return read_until(df, condition(df, code), by, order, inclusive=False)


def condition(df: DataFrame, code: str) -> Column:
    return column(ast.parse(code, mode="eval"), {c: F.col(c) for c in df.columns})


_TOLERANT = re.compile(r"([\w.]+)\s*==\s*([^&|;,()]+?)\s*\+/-\s*([\w.]+)")


def tolerant(code: str) -> str:
    """`a == b +/- c` as `abs(a-(b)) <= c`, for evaluate() and condition()."""
    return _TOLERANT.sub(r"(abs(\1-(\2)) <= \3)", code)
