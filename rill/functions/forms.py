"""Texts of property trees: json, xml, ini, info, path-value and dot, as lists of (path, value)."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Leaves = list[tuple[str, str | None]]
_STEP = re.compile(r"([^/\[\]]+)|\[(\d+)\]")


def _leaves(value, path: str = "") -> Iterator[tuple[str, str | None]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}/{k}" if path else k)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from _leaves(v, f"{path}[{k}]")
    else:
        yield path, None if value is None else json.dumps(value) if isinstance(value, bool) else str(value)


def _of_element(e: ElementTree.Element) -> dict | str | None:
    out: dict = {}
    for k, v in e.attrib.items():
        out.setdefault("<xmlattr>", {})[k] = v
    for child in e:
        value = _of_element(child)
        if child.tag in out:
            out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), value]
        else:
            out[child.tag] = value
    text = (e.text or "").strip()
    return out or text


def _of_ini(text: str) -> Leaves:
    section, out = "", []
    for line in map(str.strip, text.splitlines()):
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
        elif line and line[0] not in ";#":
            name, _, value = line.partition("=")
            out.append((f"{section}/{name.strip()}" if section else name.strip(), value.strip()))
    return out


def _unquoted(x: str) -> str:
    return x[1:-1] if len(x) > 1 and x[0] == x[-1] == '"' else x


def _of_info(text: str) -> Leaves:
    """Lines of a name and a value; braces hold what is below a name."""
    out, above, last = [], [], ""
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] == ";":
            continue
        if line == "{":
            above.append(last)
        elif line == "}":
            above.pop()
        else:
            opens = line.endswith("{")
            name, _, value = line.rstrip("{").strip().partition(" ")
            last = _unquoted(name)
            if value:
                out.append(("/".join([*above, last]), _unquoted(value.strip())))
            if opens:
                above.append(last)
    return out


def parse(text: str, kind: str, take_last: bool = False, unique: bool = False) -> Leaves:
    """Leaves in the order of the text. path-value lines may hold a path again: take_last keeps the last one, unique makes
    it an error."""
    if kind == "json":
        out = list(_leaves(json.loads(text)))
    elif kind == "xml":
        root = ElementTree.fromstring(text)
        out = list(_leaves({root.tag: _of_element(root)}))
    elif kind == "ini":
        out = _of_ini(text)
    elif kind == "info":
        out = _of_info(text)
    elif kind == "path-value":
        pairs = [line.partition("=") for line in text.splitlines() if line.strip()]
        out = [(a.strip().strip("/"), _unquoted(b.strip())) for a, _, b in pairs]
    else:
        raise ValueError(f"format {kind!r}: expected json, xml, ini, info or path-value")
    if unique and len({p for p, _ in out}) < len(out):
        raise ValueError("a path stands more than once")
    return list(dict(out).items()) if take_last else out


def tree(leaves: Leaves):
    """Nested dictionaries and lists."""
    root: dict = {}
    for path, value in leaves:
        steps = [a or int(b) for a, b in _STEP.findall(path)]
        at = root
        for step, then in zip(steps, [*steps[1:], None], strict=True):
            below = value if then is None else [] if isinstance(then, int) else {}
            if isinstance(at, list):
                at.extend([None] * (step + 1 - len(at)))
                at[step] = below if then is None or at[step] is None else at[step]
            else:
                at[step] = below if then is None else at.get(step, below)
            at = at[step]
    return root


def _xml(name: str, value) -> str:
    if isinstance(value, list):
        return "".join(_xml(name, v) for v in value)
    if isinstance(value, dict):
        attributes = "".join(f' {k}="{escape(str(v))}"' for k, v in value.get("<xmlattr>", {}).items())
        return f"<{name}{attributes}>" + "".join(_xml(k, v) for k, v in value.items() if k != "<xmlattr>") + f"</{name}>"
    return f"<{name}>{escape(value or '', quote=False)}</{name}>"


def _info(value, indent: int = 0) -> Iterator[str]:
    for k, v in value.items() if isinstance(value, dict) else (("", v) for v in value):
        name = f'"{k}"' if not k or " " in k else k
        if isinstance(v, (dict, list)):
            yield " " * indent + name
            yield " " * indent + "{"
            yield from _info(v, indent + 4)
            yield " " * indent + "}"
        else:
            shown = "" if v is None else f'"{v}"' if " " in v or not v else v
            yield " " * indent + f"{name} {shown}".rstrip()


def render(leaves: Leaves, kind: str) -> str:
    if kind == "json":
        return json.dumps(tree(leaves), ensure_ascii=False, separators=(",", ":"))
    if kind == "xml":
        return "".join(_xml(k, v) for k, v in tree(leaves).items())
    if kind == "info":
        return "\n".join(_info(tree(leaves)))
    if kind == "path-value":
        return "\n".join(f"{p}={v or ''}" for p, v in leaves)
    if kind == "ini":
        sections: dict[str, list[str]] = {"": []}
        for p, v in leaves:
            above, _, name = p.rpartition("/")
            sections.setdefault(above, []).append(f"{name}={v or ''}")
        return "\n".join(line for k, lines in sections.items() for line in ([f"[{k}]"] if k else []) + lines)
    if kind == "dot":
        edges = []
        for p, v in leaves:
            steps = p.split("/")
            edges += [f'"{"/".join(steps[:k])}" -> "{"/".join(steps[: k + 1])}"' for k in range(1, len(steps))]
            edges.append(f'"{p}" [label="{steps[-1]}={v or ""}"]')
        return "digraph {\n" + "\n".join(dict.fromkeys(edges)) + "\n}"
    raise ValueError(f"format {kind!r}: expected json, xml, ini, info, path-value or dot")


def parse_trees(df: DataFrame, column: str, keys: list[str], kind: str, **how) -> DataFrame:
    """One row a leaf of each document: its place in the document (`leaf`), path and value. Null documents have none; a
    document that can't be read is an error."""

    def run(batches):
        for b in batches:
            at, found = [], []
            for k, text in enumerate(b.column(len(keys)).to_pylist()):
                if text is not None:
                    leaves = parse(text, kind, **how)
                    at += [k] * len(leaves)
                    found += [(i, *x) for i, x in enumerate(leaves)]
            kept = b.select(range(len(keys))).take(pa.array(at, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x[0] for x in found], type=pa.int32()), pa.array([x[1] for x in found], type=pa.string()), pa.array([x[2] for x in found], type=pa.string())], names=[*keys, "leaf", "path", "value"])

    kinds = dict(df.dtypes)
    return df.select(*keys, column).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "leaf int", "path string", "value string"]))


def render_trees(paths: DataFrame, keys: list[str], kind: str, order: str = "path") -> DataFrame:
    """Leaves of each document, in order, as its text: `document`. One document's leaves are one row's."""
    grouped = paths.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.col("path").alias("__p"), F.col("value").alias("__v")))).alias("__leaves"))

    def run(batches):
        for b in batches:
            made = [render([(x["__p"], x["__v"]) for x in leaves], kind) for leaves in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(made, type=pa.string())], names=[*keys, "document"])

    kinds = dict(paths.dtypes)
    return grouped.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "document string"]))


def at(d: dict, path: str):
    """The value at a path of nested dictionaries and lists; KeyError if there is none."""
    for a, b in _STEP.findall(path):
        try:
            d = d[a] if a else d[int(b)]
        except (IndexError, TypeError) as e:
            raise KeyError(path) from e
    return d


def has(d: dict, path: str) -> bool:
    try:
        at(d, path)
    except KeyError:
        return False
    return True


def leaves(d: dict) -> Leaves:
    return list(_leaves(d))


def parents(path: str) -> list[str]:
    """The paths above a path, the shortest first."""
    steps = path.split("/")
    return ["/".join(steps[:k]) for k in range(1, len(steps))]


def set_at(d: dict, path: str, value) -> dict:
    """A copy with the value at the path; what is missing above it is made."""
    kept = [(p, v) for p, v in _leaves(d) if p != path and not p.startswith((path + "/", path + "["))]
    return tree([*kept, (path, value)])


def updated(d: dict, other: dict) -> dict:
    """A copy with all leaves of the other over it."""
    return tree([*_leaves(d), *_leaves(other)])
