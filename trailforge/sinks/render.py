"""Records as the lines that a log shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, time_tag

_INDENT = " " * 11


def _side(x: Column, plus: str, minus: str) -> Column:
    name = F.when((x >= 0) & ~F.isnan(x), plus).otherwise(minus)
    return F.concat(fixed(F.abs(x), 5), F.lit("°"), name)


def point_text() -> Column:
    """A passed record: position, motion and quality, and the satellites in view where there are any."""
    view = F.col("satellites_in_view")
    one = lambda s: F.concat(F.lit("  PRN"), s["prn"], F.lit(" el="), s["elevation"], F.lit("° az="), s["azimuth"], F.lit("° snr="), s["snr"])
    seen = F.concat(F.lit(f"\n{_INDENT}In view ("), F.size(view), F.lit("):"), F.array_join(F.transform(view, one), ""))
    parts = [
        time_tag(F.col("time")),
        F.lit(" Coordinates: "), _side(F.col("lat"), "N", "S"), F.lit(", "), _side(F.col("lon"), "E", "W"),
        F.lit(f"\n{_INDENT}Speed: "), fixed(F.col("speed_kmh"), 1), F.lit(" km/h"), F.when(F.col("stopped"), " (stopped)").otherwise(""),
        F.lit(", Course: "), fixed(F.col("course"), 1), F.lit("°"),
        F.lit(f"\n{_INDENT}Altitude: "), fixed(F.col("altitude"), 1), F.lit(" m, Satellites: "), F.col("satellites"),
        F.lit(", HDOP: "), fixed(F.col("hdop"), 1),
        F.when(F.size(view) > 0, seen).otherwise(""),
    ]
    return F.concat(*(p.cast("string") for p in parts))


def text_of() -> Column:
    """A record's text without the last line end: an error as it is, a rejection with its time and reason, or a point."""
    rejected = F.concat(time_tag(F.col("time")), F.lit(" Point rejected: "), F.col("reason"))
    return F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("reason").isNotNull(), rejected).otherwise(point_text())


def rendered(processed: DataFrame) -> DataFrame:
    """track_id, file_idx, rec_idx and text of processed records."""
    return processed.select("track_id", "file_idx", "rec_idx", text_of().alias("text"))
