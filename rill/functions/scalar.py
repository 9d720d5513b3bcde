"""Scalar functions as columns: path strings, times, units, bits, bytes."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor and offset to the metric unit of each kind.
UNITS = {
    "metres": ("length", 1.0, 0.0),
    "feet": ("length", 0.3048, 0.0),
    "statute-miles": ("length", 1609.344, 0.0),
    "nautical-miles": ("length", 1852.0, 0.0),
    "kilograms": ("mass", 1.0, 0.0),
    "pounds": ("mass", 0.45359237, 0.0),
    "metres-per-second": ("speed", 1.0, 0.0),
    "knots": ("speed", 1852.0 / 3600, 0.0),
    "kelvin": ("temperature", 1.0, 0.0),
    "celsius": ("temperature", 1.0, 273.15),
    "fahrenheit": ("temperature", 5.0 / 9, 459.67 * 5.0 / 9),
    "radians": ("angle", 1.0, 0.0),
    "degrees": ("angle", 3.141592653589793 / 180, 0.0),
    "seconds": ("time", 1.0, 0.0),
    "minutes": ("time", 60.0, 0.0),
    "hours": ("time", 3600.0, 0.0),
    "fraction": ("ratio", 1.0, 0.0),
    "percent": ("ratio", 0.01, 0.0),
}
#: Day (UTC) from which TAI is so many seconds ahead of UTC; 0 before.
LEAP_SECONDS = (
    ("1972-01-01", 10), ("1972-07-01", 11), ("1973-01-01", 12), ("1974-01-01", 13),
    ("1975-01-01", 14), ("1976-01-01", 15), ("1977-01-01", 16), ("1978-01-01", 17),
    ("1979-01-01", 18), ("1980-01-01", 19), ("1981-07-01", 20), ("1982-07-01", 21),
    ("1983-07-01", 22), ("1985-07-01", 23), ("1988-01-01", 24), ("1990-01-01", 25),
    ("1991-01-01", 26), ("1992-07-01", 27), ("1993-07-01", 28), ("1994-07-01", 29),
    ("1996-01-01", 30), ("1997-07-01", 31), ("1999-01-01", 32), ("2006-01-01", 33),
    ("2009-01-01", 34), ("2012-07-01", 35), ("2015-07-01", 36), ("2017-01-01", 37),
)


def convert(x: Column, source: str, target: str) -> Column:
    (kind, a, b), (other, c, d) = UNITS[source], UNITS[target]
    if kind != other:
        raise ValueError(f"{source} and {target} measure different things")
    return (x * a + b - d) / c


def convert_from(x: Column, unit: Column, target: str) -> Column:
    """x from the unit that a sibling column names; null for a unit of another kind, or none."""
    out = F.lit(None).cast("double")
    for name, (kind, *_) in UNITS.items():
        if kind == UNITS[target][0]:
            out = F.when(unit == name, convert(x, name, target)).otherwise(out)
    return out


def linear(x: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return x * scale + offset


def equal_within(a: Column, b: Column, epsilon: float = 2.220446049250313e-16) -> Column:
    """Equal numbers, up to an epsilon; nans are equal to nothing."""
    return ~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) < epsilon)


def less_within(a: Column, b: Column, epsilon: float = 2.220446049250313e-16) -> Column:
    return (a < b) & ~equal_within(a, b, epsilon)


def cyclic(x: Column, low: float, high: float) -> Column:
    """x moved by whole cycles into [low, high)."""
    return F.lit(low) + F.pmod(x - low, F.lit(high - low))


def hull(low: Column, high: Column) -> tuple[Column, Column]:
    """Aggregates: the least interval that holds all intervals."""
    return F.min(low), F.max(high)


def with_affixes(x: Column, prefix: str = "", suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), x, F.lit(suffix))


def path_basename(path: Column, tail: int = 1, head: int | None = None) -> Column:
    """The last tail parts; or, with head, all but the first head ones. A path too short is returned whole."""
    parts = F.split(path, "/")
    n = F.size(parts)
    if head is not None:
        return F.when(n <= head, path).otherwise(F.array_join(F.slice(parts, head + 1, F.greatest(n - head, F.lit(0))), "/"))
    return F.when(n <= tail, path).otherwise(F.array_join(F.slice(parts, n - tail + 1, tail), "/"))


def path_dirname(path: Column, tail: int = 1, head: int | None = None) -> Column:
    """The path without its last tail parts; or, with head, its first head parts. An absolute path keeps its root, which
    counts as none of its parts."""
    parts = F.split(path, "/")
    count = F.size(parts) - tail if head is None else F.lit(head) + F.when(path.startswith("/"), 1).otherwise(0)
    kept = F.array_join(F.slice(parts, 1, F.greatest(F.least(count, F.size(parts)), F.lit(0))), "/")
    return F.when(path.startswith("/") & (kept == ""), "/").otherwise(kept)


def path_normal(path: Column) -> Column:
    """A path without empty and `.` parts, `..` taken back where a part stands before it; as text, no file is looked at."""
    root = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, p: Column) -> Column:
        back = (p == "..") & (F.size(done) > 0) & (F.element_at(F.concat(done, F.array(F.lit("x"))), F.greatest(F.size(done), F.lit(1))) != "..")
        above = (p == "..") & root & (F.size(done) == 0)
        return F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(above, done).otherwise(F.concat(done, F.array(p)))

    out = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(root, F.concat(F.lit("/"), out)).when(out == "", ".").otherwise(out)


def quoted(x: Column, force: bool = False, delimiter: str | None = None, mangled: str = ";") -> Column:
    """Quotes what isn't a number, or with force everything; delimiters inside a quoted value can be mangled."""
    inside = F.replace(x, F.lit(delimiter), F.lit(mangled)) if delimiter else x
    wrapped = F.concat(F.lit('"'), inside, F.lit('"'))
    return wrapped if force else F.when(x.try_cast("double").isNull(), wrapped).otherwise(x)


def unquoted(x: Column) -> Column:
    """Without one pair of double quotes around it."""
    return F.when((F.length(x) > 1) & x.startswith('"') & x.endswith('"'), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)


def iso(t: Column, fractions: bool = False) -> Column:
    """yyyymmddThhmmss, with microseconds where there are any, or always."""
    base = F.date_format(t, "yyyyMMdd'T'HHmmss")
    part = F.date_format(t, "SSSSSS")
    long = F.concat(base, F.lit("."), part)
    return long if fractions else F.when(part == "000000", base).otherwise(long)


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def _seconds_text(t: Column) -> Column:
    """Seconds since the epoch, with as many digits after the point as are needed."""
    return F.regexp_replace((_micros(t).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(20,6)").cast("string"), r"\.?0+$", "")


def format_time(t: Column, kind: str, zone: str = "UTC") -> Column:
    """A time (UTC, without zone) as text: iso, iso-always-with-fractions, seconds, microseconds, sql, xsd, local (iso in
    the zone), tai (iso, ahead by the leap seconds), or `format;` and a pattern of letters such as yyyy-MM-dd."""
    if kind.startswith("format;"):
        return F.date_format(t, kind[7:])
    with_part = lambda pattern: F.regexp_replace(F.date_format(t, pattern + ".SSSSSS"), r"\.0{6}$", "")
    forms = {
        "iso": lambda: iso(t),
        "iso-always-with-fractions": lambda: iso(t, True),
        "seconds": lambda: _seconds_text(t),
        "microseconds": lambda: _micros(t).cast("string"),
        "sql": lambda: with_part("yyyy-MM-dd HH:mm:ss"),
        "xsd": lambda: with_part("yyyy-MM-dd'T'HH:mm:ss"),
        "local": lambda: iso(F.from_utc_timestamp(t.cast("timestamp"), zone)),
        "tai": lambda: iso(t + F.make_dt_interval(secs=tai_offset(t).cast("decimal(18,6)"))),
    }
    if kind not in forms:
        raise ValueError(f"time format {kind!r}: expected one of {', '.join(forms)} or format;<pattern>")
    return forms[kind]()


_XSD = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d{1,6})?\d*(Z|[+-]\d{2}(?::?\d{2})?)?$"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x where x is evaluated once a row, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _xsd(x: Column) -> Column:
    """With an offset (`Z`, `+11:00`, `+1100`, `+11`) taken off. One regular expression tells if it is one; its parts are
    at fixed places, but for the offset, which follows the digits."""
    local = F.try_to_timestamp(F.concat(F.substring(x, 1, 10), F.lit(" "), F.substring(x, 12, 8)), F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = F.ltrim(F.substr(x, F.lit(20)), F.lit(".0123456789"))
    fraction = F.when(F.substring(x, 20, 1) == ".", F.rpad(F.substring(F.substr(x, F.lit(21), F.length(x) - 20 - F.length(zone)), 1, 6), 6, "0").try_cast("long")).otherwise(F.lit(0))
    digits = F.translate(zone, "Z:+-", "")
    offset = F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60
    east = F.when(zone.isin("", "Z"), F.lit(0)).when(zone.startswith("-"), -offset).otherwise(offset)
    micros = F.unix_micros(local) + fraction - east.cast("long") * 1_000_000
    return F.when(x.rlike(_XSD), F.timestamp_micros(micros))


def parse_time(x: Column, kind: str = "guess", strict: bool = False) -> Column:
    """Text as a time without zone, in UTC: iso, xsd (with or without offset), sql, seconds, microseconds, tai, or guess,
    which tries iso, xsd, sql and seconds. Empty text, null and not-a-date-time are null; so is what can't be read, or,
    if strict, an error."""
    if kind not in _KINDS:
        raise ValueError(f"time format {kind!r}: expected one of {', '.join(_KINDS)}")
    return once(x, lambda text: _parsed(text, kind, strict))


_KINDS = ("iso", "xsd", "sql", "seconds", "microseconds", "guess", "tai")


def _parsed(x: Column, kind: str, strict: bool) -> Column:
    forms = {
        "iso": lambda: F.try_to_timestamp(x, F.lit("yyyyMMdd'T'HHmmss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]")),
        "xsd": lambda: _xsd(x),
        "sql": lambda: F.when(x.contains(" "), _xsd(x)),
        "seconds": lambda: F.timestamp_micros((x.try_cast("decimal(26,6)") * 1_000_000).cast("long")),
        "microseconds": lambda: F.timestamp_micros(x.try_cast("long")),
        "guess": lambda: F.coalesce(forms["iso"](), forms["xsd"](), forms["seconds"]()),
        "tai": lambda: once(forms["iso"](), _from_tai),
    }
    out = forms[kind]().cast("timestamp_ntz")
    if strict:
        none = x.isNull() | x.isin("", "not-a-date-time")
        out = F.when(none | out.isNotNull(), out).otherwise(F.raise_error(F.concat(F.lit("expected a time, got "), x)).cast("timestamp_ntz"))
    return out


def _from_tai(t: Column) -> Column:
    """UTC of a TAI time: the offset that holds at the UTC it gives."""
    out = t
    for day, s in LEAP_SECONDS:
        begins = F.to_timestamp_ntz(F.lit(day))
        moved = t.cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(s))
        out = F.when(moved >= begins, moved.cast("timestamp")).otherwise(out)
    return out


def delay(t: Column, seconds: float) -> Column:
    return t + F.make_dt_interval(secs=F.lit(seconds))


def tai_offset(t: Column) -> Column:
    """Seconds that TAI is ahead of UTC; null for null."""
    out = F.when(t.isNotNull(), 0)
    for day, s in LEAP_SECONDS:
        out = F.when(t >= F.to_timestamp_ntz(F.lit(day)), s).otherwise(out)
    return out


def unpack_bits(x: Column, sizes: list[int]) -> list[Column]:
    """Bit fields from the most significant on, as integers."""
    out, low = [], sum(sizes)
    for n in sizes:
        low -= n
        out.append(F.shiftright(x, low).bitwiseAND((1 << n) - 1))
    return out


def reversed_bytes(x: Column, size: int) -> Column:
    """Byte order of an integer's lowest size bytes reversed."""
    out = F.lit(0).cast("long")
    for k in range(size):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), 8 * k).bitwiseAND(255), 8 * (size - 1 - k)))
    return out


def voxel(x: Column, resolution: float, origin: float = 0.0) -> Column:
    return F.floor((x - origin) / resolution).cast("long")


def interpolate_grid(x: Column, y: Column, grid: list[list[float]], origin: tuple[float, float], step: tuple[float, float]) -> Column:
    """Bilinear lookup in a small table; null outside of it."""
    flat = [[float(v)] for row in grid for v in row]
    return F.get(interpolate([x, y], flat, (len(grid), len(grid[0])), origin, step), F.lit(0))


#: Numbers of a grid that may stand in an expression.
MOST_GRID = 10_000


def interpolate(at: list[Column], grid: list[list[float]], shape: tuple[int, ...], origin: tuple[float, ...], step: tuple[float, ...]) -> Column:
    """Multilinear lookup in a small grid of any number of dimensions: an array of as many values as a place of the grid
    has. grid lists the places, the last dimension fastest. Null outside of it."""
    if math.prod(shape) != len(grid) or min(shape) < 2:
        raise ValueError(f"a grid of shape {shape} has {math.prod(shape)} places, two or more in each dimension; got {len(grid)}")
    if len(grid) * len(grid[0]) > MOST_GRID:
        raise ValueError(f"a grid of more than {MOST_GRID} numbers is to be joined as a table")
    u = [(x - o) / s for x, o, s in zip(at, origin, step, strict=True)]
    low = [F.least(F.floor(v), F.lit(n - 2)).cast("int") for v, n in zip(u, shape, strict=True)]
    inside = reduce(lambda a, b: a & b, (v.between(0, n - 1) for v, n in zip(u, shape, strict=True)))
    values = []
    for k in range(len(grid[0])):
        table = F.array(*(F.lit(float(place[k])) for place in grid))
        total = F.lit(0.0)
        for corner in range(1 << len(shape)):
            place, weight = F.lit(0), F.lit(1.0)
            for d, n in enumerate(shape):
                up = corner >> d & 1
                place = place * n + low[d] + up
                weight = weight * ((u[d] - low[d]) if up else (1 - (u[d] - low[d])))
            total = total + F.get(table, place) * weight
        values.append(total)
    return F.when(inside, F.array(*values))


#: Generator, start value and whether bits are reflected, of each 16-bit code.
CRC16 = {"16": (0x8005, 0, True), "ccitt": (0x1021, 0xFFFF, False), "xmodem": (0x1021, 0, False)}


def crc(data: Column, which: str = "ccitt") -> Column:
    """Checksum of binary data as a long: "16", "ccitt", "xmodem" or "32"; null for null."""
    if which == "32":
        return F.crc32(data)
    generator, start, reflected = CRC16[which]
    if reflected:
        generator = int(f"{generator:016b}"[::-1], 2)

    def bit(now: Column, k: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, (k / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        now = F.when(k % 8 == 0, now.bitwiseXOR(byte if reflected else F.shiftleft(byte, 8))).otherwise(now)
        if reflected:
            return F.shiftright(now, 1).bitwiseXOR(now.bitwiseAND(F.lit(1)) * generator)
        return F.shiftleft(now, 1).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.shiftright(now, 15) * generator)

    bits = F.sequence(F.lit(0), F.octet_length(data) * 8 - 1)
    return F.when(F.octet_length(data) == 0, F.lit(start)).when(data.isNotNull(), F.aggregate(bits, F.lit(start), bit)).cast("long")


def crc_wrapped(line: Column, which: str = "ccitt", delimiter: str = ",") -> Column:
    """A line with the checksum of its bytes as its last field."""
    return F.concat(line, F.lit(delimiter), crc(line.cast("binary"), which).cast("string"))


def crc_holds(line: Column, which: str = "ccitt", delimiter: str = ",") -> Column:
    """Whether a line's last field is the checksum of what stands before it."""
    rest = F.regexp_extract(line, "(?s)^(.*)" + re.escape(delimiter) + "([0-9]+)$", 1)
    last = F.regexp_extract(line, "(?s)^(.*)" + re.escape(delimiter) + "([0-9]+)$", 2)
    return F.coalesce(crc(rest.cast("binary"), which) == last.try_cast("long"), F.lit(False))


def crc_checked(line: Column, which: str = "ccitt", delimiter: str = ",") -> Column:
    """What stands before the checksum; a line whose checksum doesn't hold is an error."""
    rest = F.regexp_extract(line, "(?s)^(.*)" + re.escape(delimiter) + "([0-9]+)$", 1)
    return F.when(crc_holds(line, which, delimiter), rest).otherwise(F.raise_error(F.concat(F.lit("checksum fails: "), line)))


def crc_bytes(data: bytes, which: str = "ccitt") -> int:
    """crc() of bytes, outside of a plan."""
    if which == "32":
        return zlib.crc32(data)
    generator, now, reflected = CRC16[which]
    if reflected:
        generator = int(f"{generator:016b}"[::-1], 2)
    for byte in data:
        now ^= byte if reflected else byte << 8
        for _ in range(8):
            if reflected:
                now = now >> 1 ^ (generator if now & 1 else 0)
            else:
                now = (now << 1 ^ (generator if now & 0x8000 else 0)) & 0xFFFF
    return now


def recovered_packets(data: bytes, size: int, which: str = "ccitt", after: int = 1) -> list[bytes]:
    """Payloads of the packets (size bytes and their little-endian checksum) of a stream. After a packet that fails,
    packets are looked for byte by byte, and taken again once `after` in a row hold."""
    width = 4 if which == "32" else 2
    whole = size + width
    good = lambda at: at + whole <= len(data) and int.from_bytes(data[at + size : at + whole], "little") == crc_bytes(data[at : at + size], which)
    out, at, trusted = [], 0, True
    while at + whole <= len(data):
        if trusted and good(at) or not trusted and all(good(at + k * whole) for k in range(after)):
            out.append(data[at : at + size])
            at, trusted = at + whole, True
        else:
            at, trusted = at + 1, False
    return out


def path_common(path: Column) -> Column:
    """An aggregate: the longest path that all paths begin with, by whole elements. Arrays compare element by element,
    so the least and the greatest path agree exactly as far as all do."""
    parts = F.split(path, "/")
    low, high = F.min(parts), F.max(parts)
    same = F.transform(F.arrays_zip(low.alias("a"), high.alias("b")), lambda p: p["a"].eqNullSafe(p["b"]))
    differ = F.array_position(same, F.lit(False)).cast("int")
    return F.array_join(F.slice(low, F.lit(1), F.when(differ > 0, differ - 1).otherwise(F.size(low))), "/")


def make_fixed(line: Column, count: int, delimiter: str = ",", value: str = "") -> Column:
    """A delimited line with exactly count fields: padded with value, or chopped."""
    parts = F.split(line, "\\Q" + delimiter + "\\E", -1)
    return F.array_join(F.slice(F.concat(parts, F.array_repeat(F.lit(value), count)), 1, count), delimiter)
