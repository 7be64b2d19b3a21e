"""The row types: a point on a track, and the parts of a 196-byte receiver record."""

from __future__ import annotations

from pyspark.sql import types as T

SATELLITE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("prn", "elevation", "azimuth", "snr")])

#: What a decoded position holds.
FIX = [
    T.StructField("time", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("speed_kmh", T.DoubleType()),
    T.StructField("course", T.DoubleType()),
    T.StructField("altitude", T.DoubleType()),
    T.StructField("satellites", T.IntegerType()),
    T.StructField("hdop", T.DoubleType()),
    T.StructField("stopped", T.BooleanType()),
    T.StructField("satellites_in_view", T.ArrayType(SATELLITE)),
]

#: A record of a track: where it stands (track, file, record), its fix, or the text of a decoding error.
RECORD = T.StructType(
    [
        T.StructField("track_id", T.StringType()),
        T.StructField("file_idx", T.IntegerType()),
        T.StructField("rec_idx", T.LongType()),
        *FIX,
        T.StructField("error", T.StringType()),
    ]
)

#: Columns that order the records of a track.
ORDER = ("file_idx", "rec_idx")
