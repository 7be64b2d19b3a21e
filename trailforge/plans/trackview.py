"""The driver's event table seen as tracks: every user is a track, event ids are in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same view in SQL, for the oracle.
SQL = """
tv AS (
  SELECT CAST(user_id AS VARCHAR) AS track_id, event_id AS rec_idx, strftime(ts, '%H%M%S') AS time, k,
    55.75 + k / 10000.0 AS lat, 37.66 + (event_id % 100) / 10000.0 AS lon, value AS speed_kmh, CAST(k * 3.6 AS DOUBLE) AS course,
    value AS altitude, CAST(k % 13 AS INTEGER) AS satellites, (k % 80) / 10.0 AS hdop,
    list_transform(range(1, k % 6 + 1), lambda i: CAST((k * 7 + i * 13) % 40 AS INTEGER)) AS snr,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def track_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of tracks; only the columns of a record are read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select("user_id", "event_id", "ts", "value", k.alias("k"))
    k, i32 = F.col("k"), lambda c: c.cast("int")
    view = F.transform(
        F.slice(F.sequence(F.lit(1), F.lit(5)), F.lit(1), k % 6),
        lambda i: F.struct(i32(i).alias("prn"), i32(k * i % 90).alias("elevation"), i32(k * 37 * i % 360).alias("azimuth"), i32((k * 7 + i * 13) % 40).alias("snr")),
    )
    return e.select(
        F.col("user_id").cast("string").alias("track_id"),
        F.lit(0).alias("file_idx"),
        F.col("event_id").alias("rec_idx"),
        F.date_format("ts", "HHmmss").alias("time"),
        (F.lit(55.75) + k / F.lit(10000.0)).alias("lat"),
        (F.lit(37.66) + (F.col("event_id") % 100) / F.lit(10000.0)).alias("lon"),
        F.col("value").alias("speed_kmh"),
        (k * F.lit(3.6)).alias("course"),
        F.col("value").alias("altitude"),
        i32(k % 13).alias("satellites"),
        ((k % 80) / F.lit(10.0)).alias("hdop"),
        F.lit(False).alias("stopped"),
        view.alias("satellites_in_view"),
        F.lit(None).cast("string").alias("error"),
    )
