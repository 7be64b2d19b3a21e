"""NMEA-0183 text: check sums, fields and numbers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind

KNOT_KMH = 1.852
_NUMBER = r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?))"
_HEX = r"^[ \t\n\x0B\f\r]*[+-]?0[xX]([0-9a-fA-F]{1,13})"
_SPECIAL = r"(?i)^[ \t\n\x0B\f\r]*[+-]?(inf|nan)"
_NAN = r"(?i)^[ \t\n\x0B\f\r]*[+-]?nan"


def checksum(line: Column) -> Column:
    """XOR of the UTF-8 bytes between the first $ and the first *; 0 where either is missing or the * comes first."""

    def of(x: Column) -> Column:
        dollar, star = F.instr(x, "$"), F.instr(x, "*")
        body = F.hex(F.encode(F.substring(x, dollar + 1, star - dollar - 1), "UTF-8"))
        return F.when((dollar > 0) & (star > dollar + 1), bind(body, _xor)).otherwise(0)

    return bind(line, of)


def _xor(body: Column) -> Column:
    byte = lambda i: F.conv(F.substring(body, i, F.lit(2)), 16, 10).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(body) - 1, F.lit(2)), F.lit(0), lambda a, i: a.bitwiseXOR(byte(i)))


def valid(line: Column) -> Column:
    """Whether the two hexadecimal digits after the first * are the check sum; what follows them doesn't matter."""

    def of(x: Column) -> Column:
        given = F.regexp_extract(x, r"^[^*]*\*([0-9a-fA-F]{2})", 1)
        return F.when((given != "") & (F.instr(x, "$") > 0), F.conv(given, 16, 10).cast("int") == checksum(x)).otherwise(False)

    return bind(line, of)


def fields(line: Column) -> Column:
    """The comma-separated fields between $ and *, less one empty field at the end."""
    all_of = bind(line, lambda x: F.split(F.substring(x, F.lit(2), F.instr(x, "*") - 2), ",", -1))
    return bind(all_of, lambda f: F.when(F.element_at(f, -1) == "", F.slice(f, F.lit(1), F.size(f) - 1)).otherwise(f))


def number(text: Column) -> Column:
    """The double at the start of a text; null where there is none, or it overflows or underflows.

    Takes decimal numbers, inf, nan and whole hexadecimal numbers."""

    def usual(x: Column) -> Column:
        def of(digits: Column) -> Column:
            value = digits.try_cast("double")
            return F.when((F.abs(value) == float("inf")) | ((value == 0) & digits.rlike("^[^eE]*[1-9]")), None).otherwise(value)

        return bind(F.regexp_extract(x, _NUMBER, 1), of)

    def of(x: Column) -> Column:
        sign = F.when(x.rlike(r"^[ \t\n\x0B\f\r]*-"), -1.0).otherwise(1.0)
        special = F.when(x.rlike(_NAN), float("nan")).otherwise(sign * F.lit(float("inf")))
        return F.when(x.rlike(_SPECIAL), special).when(x.rlike(_HEX), sign * F.conv(F.regexp_extract(x, _HEX, 1), 16, 10).try_cast("double")).otherwise(usual(x))

    return bind(text, of)


def integer(text: Column) -> Column:
    """The int at the start of a text; null where there is none or it is out of range."""
    return F.regexp_extract(text, r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1).try_cast("int")


def coordinate(value: Column, direction: Column) -> Column:
    """Degrees of [D]DDMM.MMMM; S and W are negative, any other direction is not. 0 without a point, or with fewer than two
    characters before it; null where degrees or minutes are no number."""

    def of(x: Column) -> Column:
        dot = F.instr(x, ".") - 1
        degrees = number(F.substring(x, F.lit(1), dot - 2)) + number(F.substring(x, dot - 1, F.length(x))) / 60.0
        return F.when(dot < 2, 0.0).otherwise(degrees)

    sign = F.when(F.substring(direction, 1, 1).isin("S", "W"), -1.0).otherwise(1.0)
    return sign * bind(value, of)


def knots_to_kmh(knots: Column) -> Column:
    return knots * KNOT_KMH
