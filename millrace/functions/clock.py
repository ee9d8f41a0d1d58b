"""Times as texts: date, time, datetime, julianday and strftime over milliseconds since 1970, in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dynamic import Value, computed, let

#: 1970-01-01 as a Julian day, in milliseconds.
EPOCH = 210866760000000
DAY = 86_400_000
DATED = r"^(\d{4})-(\d{2})-(\d{2})(?:[ Tt]+(\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?)?\s*(?:[zZ]|([+-])(\d{2}):(\d{2}))?\s*$"
CLOCK = r"^(\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?$"
UNITS = {"day": DAY, "hour": 3_600_000, "minute": 60_000, "second": 1000}
MODIFIER = re.compile(r"^\s*([+-]?\d+(?:\.\d+)?)\s+(day|hour|minute|second)s?\s*$", re.I)
SHIFT = re.compile(r"^\s*([+-])(\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?\s*$")


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("long")


def _millis_of_text(t: Column) -> Column:
    zero = F.lit(0).cast("long")
    parts = [_part(t, DATED, k) for k in range(1, 4)] + [F.coalesce(_part(t, DATED, k), zero) for k in (4, 5, 6, 9, 10)]
    names = ["y", "mo", "d", "h", "mi", "s", "zh", "zm"]
    fraction = F.coalesce(F.nullif(F.regexp_extract(t, DATED, 7), F.lit("")).try_cast("double"), F.lit(0.0))
    west = F.regexp_extract(t, DATED, 8) == "-"

    def moment(p: Column) -> Column:
        fine = p["mo"].between(1, 12) & p["d"].between(1, 31) & (p["h"] < 24) & (p["mi"] < 60) & (p["s"] < 60)
        # days of the civil calendar, counted from 1970 with years that begin in March
        days = let(p["y"] - F.when(p["mo"] <= 2, 1).otherwise(0), lambda y: y * 365 + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400))
        days = days + F.floor((153 * (p["mo"] + F.when(p["mo"] > 2, -3).otherwise(9)) + 2) / 5) + p["d"] - 1 - 719468
        zone = (p["zh"] * 60 + p["zm"]) * F.when(p["west"], -1).otherwise(1)
        return F.when(fine, days * DAY + p["h"] * 3_600_000 + (p["mi"] - zone) * 60_000 + p["s"] * 1000 + F.floor(F.least(p["f"], F.lit(0.999)) * 1000 + 0.5)).cast("long")

    dated = let(F.struct(*[c.alias(n) for c, n in zip(parts, names)], fraction.alias("f"), west.alias("west")), moment)
    clock = (_part(t, CLOCK, 1) * 3600 + _part(t, CLOCK, 2) * 60 + F.coalesce(_part(t, CLOCK, 3), zero)) * 1000 + F.lit(946684800000)
    number = (F.floor(t.try_cast("double") * DAY + 0.5) - EPOCH).cast("long")
    return F.when(t.rlike(DATED), dated).when(t.rlike(CLOCK), clock).when(t.rlike(r"^\s*[0-9]+(\.[0-9]*)?\s*$"), number)


def millis(v: Value) -> Column | None:
    """Milliseconds since 1970 of a text or, as a Julian day, of a number; null where it is neither or out of years 0 to 9999."""
    parts = [_millis_of_text(v.t)] if v.t is not None else []
    parts += [(F.floor(x.cast("double") * DAY + 0.5) - EPOCH).cast("long") for x in (v.i, v.r) if x is not None]
    if not parts:
        return None
    out = F.coalesce(*parts) if len(parts) > 1 else parts[0]
    return let(out, lambda x: F.when(x.between(-62167219200000, 253402300799999), x))


def shifted(ms: Column, modifier: str) -> Column:
    """±N day|hour|minute|second and ±HH:MM[:SS]; null for anything else."""
    if m := MODIFIER.match(modifier):
        return ms + round(float(m[1]) * UNITS[m[2].lower()])
    if m := SHIFT.match(modifier):
        span = (int(m[2]) * 3600 + int(m[3]) * 60 + int(m[4] or 0)) * 1000 + round(float(m[5] or 0) * 1000)
        return ms + (-span if m[1] == "-" else span)
    return F.lit(None).cast("long")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _parts(ms: Column) -> dict[str, Column]:
    days, rest = F.floor(ms / DAY), F.pmod(ms, F.lit(DAY).cast("long"))
    date = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    second = F.floor(rest / 1000) % 60
    return {
        "Y": F.lpad(F.year(date).cast("string"), 4, "0"), "m": _two(F.month(date)), "d": _two(F.dayofmonth(date)), "H": _two(F.floor(rest / 3_600_000)), "M": _two(F.floor(rest / 60_000) % 60),
        "S": _two(second), "j": F.lpad(F.dayofyear(date).cast("string"), 3, "0"), "%": F.lit("%"), "f": F.concat(_two(second), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0")),
        "w": (F.dayofweek(date) - 1).cast("string"), "J": ((ms + EPOCH) / float(DAY)).cast("string"), "s": F.floor(ms / 1000).cast("string"),
    }


FORMATS = {"date": "%Y-%m-%d", "time": "%H:%M:%S", "datetime": "%Y-%m-%d %H:%M:%S"}


def called(name: str, arguments: list[Value], shape: str | None) -> Value:
    return _called(*arguments, name=name, shape=shape)


@computed
def _called(*arguments: Value, name: str, shape: str | None) -> Value:
    """date, time, datetime, julianday, or strftime with its format in `shape`. Modifiers must be literals or arguments."""
    ms = millis(arguments[0])
    for m in arguments[1:]:
        if m.constant is None or ms is None:
            return Value()
        ms = shifted(ms, str(m.constant))
    if ms is None:
        return Value()
    inside = lambda x: F.when(x.between(-62167219200000, 253402300799999), x)
    if name == "julianday":
        return Value(r=let(ms, lambda x: (inside(x) + EPOCH) / F.lit(float(DAY))))
    pieces = [p for p in re.split(r"(%.)", shape or FORMATS[name]) if p]
    if any(p.startswith("%") and p[1:] not in "YmdHMSj%fwJs" for p in pieces):
        return Value()

    def written(x: Column) -> Column:
        parts = _parts(x)
        return F.when(x.isNotNull(), F.concat(F.lit(""), *[parts[p[1:]] if p.startswith("%") else F.lit(p) for p in pieces]))

    return Value(t=let(let(ms, inside), written))
