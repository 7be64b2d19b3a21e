import math
import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailforge.functions import geo, nmea, sentence
from trailforge.functions.text import epoch_time, fixed, time_tag


def column(spark, values, kind, *made):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [tuple(r)[1:] for r in df.select("k", *made).orderBy("k").collect()]


def test_fixed_is_printf(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 0.05, 0.25, 2.25, 2.35, 0.5, 1.5, -2.25, 37.659465, 1e-9, 99.95, 99.949999, 1893.05, 4e9, 123456.5]
    values += [rng.uniform(-400, 400) for _ in range(2000)] + [round(rng.uniform(-180, 180), rng.randint(1, 7)) for _ in range(4000)] + [rng.randint(-4000, 4000) / 8 for _ in range(500)]
    got = column(spark, values, "double", fixed(F.col("x"), 1), fixed(F.col("x"), 5))
    assert got == [("%.1f" % v, "%.5f" % v) for v in values]
    assert column(spark, [math.nan, math.inf, -math.inf], "double", fixed(F.col("x"), 1)) == [("nan",), ("inf",), ("-inf",)]


def test_times(spark):
    assert column(spark, ["120001.50", "1200", "", "ab:cd!"], "string", time_tag(F.col("x"))) == [("[12:00:01]",), ("[??:??:??]",), ("[??:??:??]",), ("[ab::c:d!]",)]
    assert column(spark, [1706356800, 0, 86399], "long", epoch_time(F.col("x").cast("decimal(20,0)"))) == [("120000",), ("000000",), ("235959",)]


LINES = ["", "$AB*03", "$AB*0", "$AB*", "AB*03", "$AB", "*$AB03", "$A*41", "$A*41\r", "$A*4g", "$A*42", "$b,ü*1f", "$GPRMC,1,*00", "$*00", "x$AB*03"]


def test_checksums(spark):
    got = column(spark, LINES, "string", nmea.checksum(F.col("x")), nmea.valid(F.col("x")))
    assert got == [(sentence.checksum(x), sentence.valid(x)) for x in LINES]
    assert dict(zip(LINES, got, strict=True))["$AB*03"] == (3, True) and sentence.valid("$A*41\r") and not sentence.valid("$A*4g")


NUMBERS = ["12", "12abc", "12d", ".5", "5.", "-.5e1x", "+3", "", "abc", "-", " 7", "1e999", "1e-999", "0e-999", "0x1F", "-0x10z", "inf", "-Infinity", "nan", "1e", "00.50"]


def python_of(f, x):
    try:
        return f(x)
    except sentence.Malformed:
        return None


def test_numbers(spark):
    got = column(spark, NUMBERS, "string", nmea.number(F.col("x")), nmea.integer(F.col("x")))
    want = [(python_of(sentence.number, x), python_of(sentence.integer, x)) for x in NUMBERS]
    assert repr(got) == repr(want)
    assert python_of(sentence.number, "12abc") == 12.0 and python_of(sentence.number, "1e999") is None and sentence.number("-0x10z") == -16.0
    assert python_of(sentence.integer, "99999999999") is None and sentence.integer("12.7") == 12


def test_coordinates(spark):
    values = ["5545.1234", "03739.5678", "45.5", "5.5", "554", "", "1234.", "ab45.0", "05.5", "-145.0"]
    for way in ("N", "S", "W", "x", "Sx"):
        got = column(spark, values, "string", nmea.coordinate(F.col("x"), F.lit(way)))
        assert repr([r[0] for r in got]) == repr([python_of(lambda x, way=way: sentence.coordinate(x, way), v) for v in values])
    assert sentence.coordinate("5545.1234", "S") == pytest.approx(-55.752056667) and sentence.coordinate("554", "N") == 0.0
    assert python_of(lambda x: sentence.coordinate(x, "N"), "45.5") is None


def test_fields(spark):
    got = column(spark, ["$A,b,,c*00", "$A,*00", "$A,,*00", "$A*00"], "string", nmea.fields(F.col("x")))
    assert [r[0] for r in got] == [["A", "b", "", "c"], ["A"], ["A", ""], ["A"]] == [sentence.fields(x) for x in ("$A,b,,c*00", "$A,*00", "$A,,*00", "$A*00")]


def test_haversine(spark):
    assert geo.haversine_m(55.75205, 37.65946, 55.75205, 37.65946) == 0
    assert geo.haversine_m(0, 0, 0, 180) == pytest.approx(math.pi * geo.RADIUS_M) and math.isnan(geo.haversine_m(math.nan, 0, 0, 0))
    got = column(spark, [55.766666666667], "double", geo.haversine(F.lit(55.752058333333), F.lit(37.659465), F.col("x"), F.lit(37.675)))
    assert got[0][0] == pytest.approx(1892.9603, abs=1e-3) == geo.haversine_m(55.752058333333, 37.659465, 55.766666666667, 37.675)


@given(st.floats(allow_nan=False, width=32))
def test_float_bits(x):
    from trailforge.sources import binary  # the layout's types only name what struct knows

    assert {k for _, _, k in binary.LAYOUT} <= {"u8", "u16", "u32", "u64", "i16", "i32", "f32"} and struct.unpack("<f", struct.pack("<f", x))[0] == x
