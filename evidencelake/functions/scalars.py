"""Scalar expressions: times, strings, flags. All are built-in columns; none is a Python function of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds from 1601, 1904 and 2001 to 1970.
FROM_1601, FROM_1904, FROM_2001 = 11_644_473_600, 2_082_844_800, -978_307_200
# ROT13.
_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_NOP = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def _time(micros: Column, raw: Column) -> Column:
    """Null for zero, null or a year past 9999."""
    inside = (raw != 0) & micros.between(-62135596800000000, 253402300799999999)
    return F.when(inside, F.timestamp_micros(micros))


def filetime(v: Column) -> Column:
    """100 ns from 1601."""
    return _time(F.call_function("div", v, F.lit(10)) - FROM_1601 * 1_000_000, v)


def webkit(v: Column) -> Column:
    """Microseconds from 1601."""
    return _time(v - FROM_1601 * 1_000_000, v)


def unix(v: Column, per_second: int = 1) -> Column:
    return _time(v * (1_000_000 // per_second), v)


def mac_absolute(v: Column) -> Column:
    """Seconds from 2001."""
    return _time((v - FROM_2001) * 1_000_000, v)


def hfs(v: Column) -> Column:
    """Seconds from 1904."""
    return _time((v - FROM_1904) * 1_000_000, v)


def apfs(v: Column) -> Column:
    """Nanoseconds from 1970."""
    return _time(F.call_function("div", v, F.lit(1000)), v)


def dos(packed: Column) -> Column:
    """Date in the high half, time in the low; zoneless."""
    bits = lambda at, width: F.shiftright(packed, at).bitwiseAND((1 << width) - 1)
    made = F.try_make_timestamp_ntz(bits(25, 7) + 1980, bits(21, 4), bits(16, 5), bits(11, 5), bits(5, 6), (bits(0, 5) * 2).cast("decimal(16,6)"))
    return F.when(packed != 0, made)


def iso(v: Column) -> Column:
    """A timestamp as ISO text in UTC (the session's zone)."""
    return F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rot13(v: Column) -> Column:
    return F.translate(v, _ABC, _NOP)


def csv_guard(v: Column) -> Column:
    """A quote before what a spreadsheet would run."""
    return F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)


def reverse_host(v: Column) -> Column:
    """``moc.elpmaxe.`` to ``example.com``."""
    return F.regexp_replace(F.reverse(v), r"^\.", "")


def size_text(v: Column) -> Column:
    text = None
    for k, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        hit = v >= 1024**k
        value = F.format_string(f"%.1f {unit}", v / 1024.0**k)
        text = F.when(hit, value) if text is None else text.when(hit, value)
    return text.otherwise(F.concat(v.cast("string"), F.lit(" B")))


def flag_names(v: Column, names: dict[int, str]) -> Column:
    """The names of the bits that are set, in order of the bits."""
    pairs = F.array(*(F.struct(F.lit(bit).cast("long").alias("bit"), F.lit(name).alias("name")) for bit, name in sorted(names.items())))
    return F.transform(F.filter(pairs, lambda p: v.cast("long").bitwiseAND(p["bit"]) != 0), lambda p: p["name"])


def printable(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"[^\x20-\x7e]", "·"))


def shifted(v: Column, minutes: Column) -> Column:
    """A UTC time at an offset of whole minutes."""
    return v + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def nth_weekday(year: Column, month: int, weekday: str, nth: int) -> Column:
    """The nth such day of a month, -1 the last: as zone rules name them."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if nth > 0:
        return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (nth - 1))
    return F.date_sub(F.next_day(F.last_day(first), weekday), 7)
