"""Dates and times: time values, the ordered modifiers, strftime, julian days, differences."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIX_EPOCH = 2440587.5


def _c(x):
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def time_value(x):
    """ISO text in its several forms, or a julian day number, as a timestamp; null if it is none."""
    x = _c(x).cast("string")
    forms = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS"]
    clock = [F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), x), F.lit(f"yyyy-MM-dd {f}")) for f in ("HH:mm", "HH:mm:ss", "HH:mm:ss.SSS")]
    number = F.when(x.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.timestamp_micros(((x.try_cast("double") - UNIX_EPOCH) * 86400e6).cast("long")))
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in forms), *clock, number).cast("timestamp_ntz")


def julianday(ts):
    return F.unix_micros(_c(ts).cast("timestamp")) / 86400e6 + UNIX_EPOCH


def unixepoch(ts):
    return F.unix_seconds(_c(ts).cast("timestamp"))


def _months(ts, n: int):
    """Month arithmetic that rolls over: January 31 and a month is March 2 or 3."""
    first = F.add_months(F.trunc(ts.cast("date"), "month"), n)
    day = F.date_add(first, F.dayofmonth(ts) - 1)
    return (day.cast("timestamp_ntz") + (ts - F.date_trunc("day", ts).cast("timestamp_ntz"))).cast("timestamp_ntz")


def _months_floor(ts, n: int):
    day = F.add_months(ts.cast("date"), n)
    return (day.cast("timestamp_ntz") + (ts - F.date_trunc("day", ts).cast("timestamp_ntz"))).cast("timestamp_ntz")


def modify(ts, *modifiers: str):
    """The modifiers in their order."""
    ts, last = _c(ts).cast("timestamp_ntz"), None
    for m in map(str.strip, modifiers):
        low = m.lower()
        if found := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s+(second|minute|hour|day|month|year)s?", low):
            n, unit = float(found[1]), found[2]
            if unit in ("month", "year"):
                count = int(n) * (12 if unit == "year" else 1)
                last = ts, count
                ts = _months(ts, count)
            else:
                seconds = n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
                ts = (ts + F.expr(f"INTERVAL '{seconds:.6f}' SECOND")).cast("timestamp_ntz")
        elif low.startswith("start of "):
            ts = F.date_trunc(low.removeprefix("start of "), ts).cast("timestamp_ntz")
        elif found := re.fullmatch(r"weekday\s+([0-6])", low):
            ahead = F.pmod(F.lit(int(found[1])) - (F.dayofweek(ts) - 1), F.lit(7))
            ts = (F.date_add(ts.cast("date"), ahead).cast("timestamp_ntz") + (ts - F.date_trunc("day", ts).cast("timestamp_ntz"))).cast("timestamp_ntz")
        elif low == "floor" and last:
            ts = _months_floor(*last)
        elif low in ("ceiling", "utc", "localtime", "auto", "subsec", "subsecond"):
            pass  # rolling over is the default; sessions run in UTC
        else:
            raise ValueError(f"unknown modifier {m!r}")
    return ts


def strftime(pattern: str, ts):
    ts = _c(ts).cast("timestamp_ntz")
    num = lambda x, n, fill="0": F.lpad(x.cast("string"), n, fill)
    form = lambda f: F.date_format(ts, f)
    year = F.when(F.year(ts).between(0, 9999), num(F.year(ts), 4)).otherwise(F.year(ts).cast("string"))  # yyyy counts years of the era and puts + before those of five digits
    hour12 = F.pmod(F.hour(ts) + 11, F.lit(12)) + 1
    own = {
        "d": form("dd"), "e": num(F.dayofmonth(ts), 2, " "), "f": form("ss.SSS"), "F": F.concat(year, form("-MM-dd")), "H": form("HH"), "I": num(hour12, 2), "j": num(F.dayofyear(ts), 3), "J": julianday(ts).cast("string"), "k": num(F.hour(ts), 2, " "), "l": num(hour12, 2, " "),
        "m": form("MM"), "M": form("mm"), "p": F.when(F.hour(ts) < 12, "AM").otherwise("PM"), "P": F.when(F.hour(ts) < 12, "am").otherwise("pm"), "R": form("HH:mm"), "s": unixepoch(ts).cast("string"), "S": form("ss"), "T": form("HH:mm:ss"),
        "u": (F.pmod(F.dayofweek(ts) + 5, F.lit(7)) + 1).cast("string"), "w": (F.dayofweek(ts) - 1).cast("string"), "W": num(F.floor((F.dayofyear(ts) + 6 - F.pmod(F.dayofweek(ts) + 5, F.lit(7))) / 7), 2), "Y": year, "%": F.lit("%"),
    }
    parts = re.findall(r"%(.)|([^%]+)", pattern)
    return F.concat(*(own[code] if code else F.lit(text) for code, text in parts))


def timediff(a, b):
    """(+|-)YYYY-MM-DD HH:MM:SS.SSS: what to add to b for a; months first, then the rest."""
    a, b = _c(a).cast("timestamp_ntz"), _c(b).cast("timestamp_ntz")
    high, low = F.greatest(a, b), F.least(a, b)
    raw = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low)
    step = lambda n: F.add_months(low.cast("date"), n).cast("timestamp_ntz") + (low - F.date_trunc("day", low).cast("timestamp_ntz"))
    months = F.when(step(raw) > high, raw - 1).otherwise(raw)
    ms = F.unix_millis(high.cast("timestamp")) - F.unix_millis(step(months).cast("timestamp"))
    num = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    text = F.concat(
        F.when(a >= b, "+").otherwise("-"), num(months / 12, 4), F.lit("-"), num(months % 12, 2), F.lit("-"), num(ms / 86400000, 2), F.lit(" "),
        num(ms / 3600000 % 24, 2), F.lit(":"), num(ms / 60000 % 60, 2), F.lit(":"), num(ms / 1000 % 60, 2), F.lit("."), num(ms % 1000, 3),
    )
    return F.when(a.isNotNull() & b.isNotNull(), text)


def duration(n, unit: str):
    """Nanoseconds of n units: ns, us, ms, s, m, h."""
    return (_c(n) * F.lit({"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}[unit]).cast("long")).cast("long")


def add_duration(ts, ns):
    return F.timestamp_micros(F.unix_micros(_c(ts).cast("timestamp")) + F.floor(_c(ns) / 1000)).cast("timestamp_ntz")


def sub_times(a, b):
    """Nanoseconds from b to a."""
    return (F.unix_micros(_c(a).cast("timestamp")) - F.unix_micros(_c(b).cast("timestamp"))) * 1000


def time_round(ts, ns: int):
    us = F.unix_micros(_c(ts).cast("timestamp"))
    step = ns // 1000
    return F.timestamp_micros(F.floor((us + step // 2) / step) * step).cast("timestamp_ntz")
