"""Headers as delimited field names, and the same changes on a DataFrame's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _names(fields: str) -> list[str]:
    return fields.split(",")


def _under(name: str, path: str) -> bool:
    return name == path or name.startswith(path + "/")


def numbers(fields: str, begin: int = 0, prefix: str = "") -> str:
    """Each field's place."""
    return ",".join(f"{prefix}{k}" for k, _ in enumerate(_names(fields), begin))


def cleared(fields: str, keep: str | None = None, mask: str | None = None) -> str:
    """Names blanked: all but those under keep, or those under mask."""
    kept, masked = (None if x is None else _names(x) for x in (keep, mask))
    stays = lambda f: any(_under(f, p) for p in kept) if kept is not None else not any(_under(f, p) for p in masked or [f])
    return ",".join(f if stays(f) else "" for f in _names(fields))


def cut(fields: str, wanted: str | None = None, but: str | None = None) -> str:
    """Only the fields under wanted, or all but those under but."""
    if wanted is not None:
        return ",".join(f for f in _names(fields) if any(_under(f, p) for p in _names(wanted)))
    return ",".join(f for f in _names(fields) if not any(_under(f, p) for p in _names(but or "")))


def default(fields: str, value: str) -> str:
    """Blank names filled with value."""
    return ",".join(f or value for f in _names(fields))


def has(fields: str, wanted: str, any_of: bool = False) -> bool:
    return (any if any_of else all)(any(_under(f, p) for f in _names(fields)) for p in _names(wanted))


def prefixed(fields: str, prefix: str, path: bool = False, but: str = "") -> str:
    """Names with a prefix, or under a path; blank names and those in but stay."""
    return ",".join(f if not f or f in _names(but) else prefix + "/" * path + f for f in _names(fields))


def stripped(fields: str, prefix: str) -> str:
    return ",".join(f.removeprefix(prefix) for f in _names(fields))


def basenames(fields: str) -> str:
    return ",".join(f.rsplit("/", 1)[-1] for f in _names(fields))


def renamed(fields: str, old: str, new: str) -> str:
    """Names, or paths above them, renamed."""
    pairs = list(zip(_names(old), _names(new), strict=True))
    return ",".join(next((b + f[len(a) :] for a, b in pairs if _under(f, a)), f) for f in _names(fields))


def shuffle(df: DataFrame, fields: str) -> DataFrame:
    """Columns selected, reordered or repeated (`c`, then `c_1`); blank names are constant nulls `empty_<place>`."""
    seen: dict[str, int] = {}
    out = []
    for k, f in enumerate(_names(fields)):
        n = seen[f] = seen.get(f, -1) + 1
        out.append(F.col(f"`{f}`").alias(f"{f}_{n}" if n else f) if f else F.lit(None).cast("string").alias(f"empty_{k}"))
    return df.select(*out)
