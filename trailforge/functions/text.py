"""Numbers and times as text, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, rounded as printf does: by the exact binary value, ties to even.

    Java's own formatter rounds the shortest decimal text half up, which differs in about one of twenty values. Here
    x * 10^digits is split into a rounded product and its exact error (Dekker's product), and the error decides
    what looks like a tie. Exact below 2^52 / 10^digits; larger values are integers to that precision or print Java's digits.
    """
    scale, unit = float(10**digits), 10**digits

    def rounded(a: Column) -> Column:
        big = a * 134217729.0
        hi = big - (big - a)
        error = (hi * scale - a * scale) + (a - hi) * scale
        base = F.floor(a * scale)
        rest = a * scale - base
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (base % 2 == 1))))
        return F.when(up, base + 1).otherwise(base).cast("long")

    def written(n: Column) -> Column:
        return F.concat(((n - n % unit) / unit).cast("long").cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0"))

    def text(v: Column) -> Column:
        a = F.abs(v)
        body = F.when(a < 2.0**52 / scale, bind(rounded(a), written)).otherwise(F.format_string(f"%.{digits}f", a))
        negative = (v < 0) | ((v == 0) & v.cast("string").startswith("-"))
        inf = F.when(v > 0, "inf").otherwise("-inf")
        return F.when(F.isnan(v), "nan").when(a == float("inf"), inf).otherwise(F.concat(F.when(negative, "-").otherwise(""), body))

    return bind(x, text)


def time_tag(t: Column) -> Column:
    """[HH:MM:SS] of HHMMSS and what follows; digits are not checked."""
    part = lambda k: F.substring(t, k, 2)
    tag = F.concat(F.lit("["), part(1), F.lit(":"), part(3), F.lit(":"), part(5), F.lit("]"))
    return F.when(F.length(t) >= 6, tag).otherwise("[??:??:??]")


def epoch_time(seconds: Column) -> Column:
    """HHMMSS in UTC of seconds since 1970, whatever the session's time zone."""
    day = F.pmod(seconds, F.lit(86400).cast("decimal(20,0)")).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(F.floor(day / 3600)), two(F.floor(day % 3600 / 60)), two(day % 60))
