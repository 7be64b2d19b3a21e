"""Queries over the track view, one for each operator, and their SQL."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..carry import carried
from ..config import Filters, Height, Jump, JumpSuppress, LowPass, Parking, Quality, Satellite, Speed, Stop
from ..functions import geo, nmea, sentence
from ..functions.lines import stars
from ..operators import gates as g
from ..operators import stages as s
from ..sinks.render import text_of
from ..sources import binary
from ..sources.files import read_path
from ..sources.nmea import pair, pair_clean, sentences
from .chain import run_chain, stages, summary
from .trackview import SQL, track_view

Query = Callable[[SparkSession, str], DataFrame]

#: Settings under which every reason occurs on the view.
CHAIN = Filters(
    satellite=Satellite(True, 3, 4, 2),
    quality=Quality(True, 7.0, 12),
    speed=Speed(True, 150.0),
    height=Height(True, 1.0, 140.0, 50.0),
    jump=Jump(True, 500.0),
    jump_suppress=JumpSuppress(True, 4.0, 9.0, 2),
    stop=Stop(True, 3.0),
    parking=Parking(True, 20.0),
    lpf=LowPass(True, "pif", 0.2),
)
FIR_CUTOFF = 0.15


def six(c: str) -> Column:
    return F.round(c, 6).alias(c)


def _reasons(chain: list) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_chain(track_view(spark, sf_dir), chain).select("track_id", "rec_idx", "reason")

    return query


def _values(chain: list, *columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_chain(track_view(spark, sf_dir), chain).select("track_id", "rec_idx", *(c if c == "stopped" else six(c) for c in columns))

    return query


ALL = ("lat", "lon", "speed_kmh", "altitude")


def full_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_chain(track_view(spark, sf_dir), stages(CHAIN))
    return out.select("track_id", "rec_idx", "reason", "stopped", *map(six, ALL))


def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(run_chain(track_view(spark, sf_dir), stages(CHAIN)))


def render_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_chain(track_view(spark, sf_dir), stages(CHAIN))
    return out.select("track_id", "rec_idx", text_of().alias("text"))


def render_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as a point, before any stage."""
    return run_chain(track_view(spark, sf_dir), []).select("track_id", "rec_idx", text_of().alias("text"))


def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = track_view(spark, sf_dir)
    d = geo.haversine(F.col("lat"), F.col("lon"), F.lit(55.75), F.lit(37.66))
    return v.select("track_id", "rec_idx", F.round(d, 6).alias("metres"))


def knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_view(spark, sf_dir).select("track_id", "rec_idx", F.round(nmea.knots_to_kmh(F.col("speed_kmh")), 6).alias("kmh"))


def _minutes(deg: Column, width: int) -> Column:
    """DDMM.MMMM of degrees, made of integers so that both engines write the same text."""
    n = F.round(deg * 600000).cast("long")
    whole = (n - n % 600000) / 600000
    return F.concat(F.lpad(whole.cast("long").cast("string"), width, "0"), F.lpad(((n % 600000 - n % 10000) / 10000).cast("long").cast("string"), 2, "0"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))


def coord_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = track_view(spark, sf_dir).withColumn("text", _minutes(F.col("lat"), 2))
    way = F.when(F.col("rec_idx") % 2 == 0, "N").otherwise("S")
    return v.select("track_id", "rec_idx", "text", F.round(nmea.coordinate(F.col("text"), way), 6).alias("degrees"))


def with_sums(bodies: DataFrame) -> DataFrame:
    """bodies (last column line) as sentences with their check sums."""
    names = bodies.columns

    def run(batches):
        for batch in batches:
            # a body that begins with ! gets a wrong sum
            lines = [f"${b.lstrip('!')}*{sentence.checksum(f'${b.lstrip(chr(33))}*') ^ (b[0] == '!'):02X}" for b in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lines, pa.string())], names=names)

    return bodies.mapInArrow(carried(run), bodies.schema)


def nmea_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as sentences: GSV, RMC and GGA for each record."""
    v = track_view(spark, sf_dir)
    view = F.col("satellites_in_view")
    one = lambda x: F.concat_ws(",", x["prn"], x["elevation"], x["azimuth"], x["snr"])
    text = lambda c, k: F.col(c).cast(f"decimal(18,{k})").cast("string")
    lat, lon = F.concat(_minutes(F.col("lat"), 2), F.lit(",N")), F.concat(_minutes(F.col("lon"), 3), F.lit(",E"))
    gsv = F.concat(F.lit("GPGSV,1,1,"), F.size(view), F.when(F.size(view) > 0, ",").otherwise(""), F.array_join(F.transform(view, one), ","))
    rmc = F.concat_ws(",", F.lit("GPRMC"), F.col("rec_idx"), F.lit("A"), lat, lon, text("speed_kmh", 2), text("course", 1), F.lit("010124,,,A"))
    gga = F.concat_ws(",", F.lit("GPGGA"), F.col("rec_idx"), lat, lon, F.lit("1"), F.col("satellites"), text("hdop", 1), text("altitude", 2), F.lit("M,14.0,M,,"))
    lines = v.select("track_id", "file_idx", "rec_idx", F.posexplode(F.array(gsv, rmc, gga)).alias("at", "line"))
    return with_sums(lines.select("track_id", "file_idx", (F.col("rec_idx") * 3 + F.col("at")).alias("rec_idx"), "line"))


def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by expression, and validity by expression and as files are read; every fifth line says a wrong sum, or none."""
    line, n = F.col("line"), F.col("rec_idx")
    spoilt = F.when(n % 10 == 0, F.concat(F.expr("left(line, length(line) - 1)"), F.lit("G"))).when(n % 5 == 0, F.expr("left(line, length(line) - 1)")).otherwise(line)
    lines = nmea_lines(spark, sf_dir).select("track_id", "rec_idx", spoilt.alias("line"))

    def run(batches):
        for batch in batches:
            _, right = stars(batch.column("line").cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(right)], names=["track_id", "rec_idx", "line", "read_valid"])

    return lines.mapInArrow(carried(run), "track_id string, rec_idx long, line string, read_valid boolean").select("track_id", "rec_idx", nmea.checksum(line).alias("checksum"), nmea.valid(line).alias("valid"), "read_valid")


FIXES = ("time", "lat", "lon", "speed_kmh", "course", "altitude", "satellites", "hdop")


def _fixes(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("track_id", F.floor(F.col("rec_idx") / 3).alias("rec_idx"), *(six(c) if kinds[c] == "double" else c for c in FIXES))


def nmea_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixes(pair(sentences(nmea_lines(spark, sf_dir))))


def nmea_pairing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixes(pair_clean(sentences(nmea_lines(spark, sf_dir))))


def gsv_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pair(sentences(nmea_lines(spark, sf_dir)))
    v = F.explode("satellites_in_view").alias("v")
    return found.select("track_id", F.floor(F.col("rec_idx") / 3).alias("rec_idx"), v).select("track_id", "rec_idx", "v.*")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as sentences that cross, repeat, are void, wrong or foreign, with satellites in several parts. Times are the records'
    numbers in their track; MIXED says what each record has: sentence, time less the record's, and a number added to what it says."""
    v = track_view(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("track_id").orderBy("rec_idx")).cast("long"))
    view, ways = F.col("satellites_in_view"), F.when(F.col("n") % 3 == 0, "S").otherwise("N")
    one = lambda x: F.concat_ws(",", x["prn"], x["elevation"], x["azimuth"], x["snr"])
    text = lambda c, k, more=0: (F.col(c).cast(f"decimal(18,{k})") + F.lit(more)).cast(f"decimal(18,{k})").cast("string")
    lat, lon = F.concat(_minutes(F.col("lat"), 2), F.lit(","), ways), F.concat(_minutes(F.col("lon"), 3), F.lit(",W"))

    def body(what: str, later: int, more: int) -> Column:
        time = (F.col("n") + later).cast("string")
        if what[:3] == "GSV":
            return F.concat_ws(",", F.lit(f"GPGSV,{what[4]},{what[3]}"), F.lit("5"), F.when(F.size(view) > 0, F.array_join(F.transform(view, one), ",")))
        if what == "GGA":
            return F.concat_ws(",", F.lit("GPGGA"), time, lat, lon, F.lit("1"), F.col("satellites"), text("hdop", 1), text("altitude", 2, more), F.lit("M,14.0,M,,"))
        talker, status = {"FOREIGN": "GN"}.get(what, "GP"), {"VOID": "V"}.get(what, "A")
        wrong = "!" if what == "WRONG" else ""
        return F.concat_ws(",", F.lit(f"{wrong}{talker}RMC"), time, F.lit(status), lat, lon, text("speed_kmh", 2, more), text("course", 1), F.lit("010124,,,A"))

    said = F.element_at(F.array(*(F.array(*(body(*x) for x in case)) for case in MIXED)), (F.col("n") % len(MIXED) + 1).cast("int"))
    lines = v.select("track_id", "file_idx", "n", F.posexplode(said).alias("at", "line"))
    return with_sums(lines.select("track_id", "file_idx", (F.col("n") * 10 + F.col("at")).alias("rec_idx"), "line"))


#: Of the records of a track in turn: sentences, less or more time, more speed or height. GSVnt is part n of t.
MIXED = (
    (("GSV12", 0, 0), ("GSV22", 0, 0), ("RMC", 0, 0), ("GGA", 0, 0)),
    (("GGA", 0, 0), ("RMC", 0, 0)),
    (("VOID", 0, 0), ("RMC", 0, 0), ("GGA", 0, 0), ("GGA", 0, 1)),
    (("RMC", 0, 0), ("GGA", 1, 2)),
    (("RMC", 0, 1), ("RMC", 0, 2)),
    (("FOREIGN", 0, 0), ("GGA", 0, 0), ("GGA", 0, 3), ("RMC", 0, 0)),
    (("GSV13", 0, 0), ("GSV22", 0, 0), ("GSV23", 0, 0), ("WRONG", 0, 0), ("RMC", 0, 0), ("GGA", 0, 0)),
    (("GSV11", 0, 0), ("GSV12", 0, 0), ("GGA", 0, 0), ("RMC", -1, 0), ("RMC", 0, 4)),
    (("GSV11", 0, 0), ("RMC", 0, 0)),
)


def _mixed(made: DataFrame) -> DataFrame:
    weight = F.aggregate("satellites_in_view", F.lit(0).cast("long"), lambda a, x: a + x["prn"] * x["snr"])
    done = run_chain(made, []).withColumns({"in_view": F.size("satellites_in_view"), "prn_by_snr": weight})
    return done.select("track_id", "rec_idx", "time", *map(six, ("lat", "lon", "speed_kmh", "altitude")), "in_view", "prn_by_snr", F.when(F.col("error").isNotNull(), text_of()).alias("error_text"))


def nmea_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(pair(sentences(mixed_lines(spark, sf_dir))))


def nmea_mixed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the fast path, which leaves such tracks to the ordered pass."""
    return _mixed(pair_clean(sentences(mixed_lines(spark, sf_dir))))


#: Files that tracks are dealt to, by track modulo their number.
NAMES = ("a/b.nmea", "a/a.bin", "a.nmea", "_c.bin", "b/.h.nmea")


def files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks written to files of both formats by the executors, and read back as one listing."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="trailforge-")
    top = os.path.join("/" + re.sub("^file:/*|^/+", "", shared), f"files-{uuid.uuid4().hex}")
    number = F.col("track_id").cast("long") % len(NAMES)
    texts = nmea_lines(spark, sf_dir).select("track_id", "rec_idx", F.concat(F.encode("line", "UTF-8"), F.lit(b"\n")).alias("content"))
    records = binary_records(spark, sf_dir).select("track_id", "rec_idx", F.col("rec").alias("content"))
    text = number.isin([k for k, n in enumerate(NAMES) if n.endswith(".nmea")])
    rows = texts.where(text).unionByName(records.where(~text)).select(number.cast("int").alias("file"), "rec_idx", "content")

    def write(batches):
        made, now = [], None
        for batch in batches:
            for k, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if k != now:
                    now, path = k, os.path.join(top, NAMES[k])
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    made.append((k, open(path, "wb")))  # noqa: SIM115
                made[-1][1].write(content)
        for _, f in made:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32())], names=["file"])

    rows.repartition(len(NAMES), "file").sortWithinPartitions("file", "rec_idx").select("file", "content").mapInArrow(carried(write), "file int").collect()  # a row for each file
    out = read_path(spark, top, recursive=True)
    return out.select("file_idx", "rec_idx", "time", *map(six, ("lat", "lon", "speed_kmh", "altitude")), "satellites", "error")


def binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as packed records; every seventh has no fix of its own."""
    v = track_view(spark, sf_dir).select("track_id", "file_idx", "rec_idx", "lat", "lon", "altitude", "speed_kmh", "course", "hdop", "satellites")

    def run(batches):
        for batch in batches:
            col = lambda c, batch=batch: batch.column(c).to_numpy(zero_copy_only=False)
            near = lambda c, k: np.floor(col(c) * k + 0.5)  # noqa: B023, E731
            n = col("rec_idx")
            r = np.zeros(len(n), binary.PACKED)
            r["datetime"], r["pdop"], r["sat_count"] = n + 1_700_000_000, 10, col("satellites")
            r["nav_status"] = np.where(n % 7 == 0, np.array([1, 2, 3, 255])[n % 4], 0)
            r["latitude"], r["longitude"] = near("lat", 1e6) * np.where(n % 2 == 0, -1, 1), -near("lon", 1e6)
            r["height"], r["speed"], r["course"], r["hdop"] = near("altitude", 1) - 100, near("speed_kmh", 10), near("course", 10), near("hdop", 10)
            r["signal"] = (n[:, None] + np.arange(96) * 7) % 128 + np.arange(96) % 2 * 128
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in r], pa.binary())], names=["track_id", "file_idx", "rec_idx", "rec"])

    return v.mapInArrow(carried(run), "track_id string, file_idx int, rec_idx long, rec binary")


def binary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = binary.decode(binary_records(spark, sf_dir))
    total = F.aggregate("satellites_in_view", F.lit(0).cast("long"), lambda a, x: a + x["prn"] * x["snr"])
    kinds = dict(out.dtypes)
    return out.select("track_id", "rec_idx", *(six(c) if kinds[c] == "double" else c for c in FIXES), F.size("satellites_in_view").alias("in_view"), total.alias("prn_by_snr"), "error")


def file_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences to text: pairing, the default chain and rendering in one plan."""
    return run_chain(pair(sentences(nmea_lines(spark, sf_dir))), stages(Filters())).select("track_id", "rec_idx", text_of().alias("text"))


def queries() -> dict[str, Query]:
    c = CHAIN
    return {
        "full_chain": full_chain,
        "satellite_gate": _reasons([s.SatelliteGate(3, 4, 2)]),
        "quality_filter": _reasons([s.QualityGate(c.quality.max_hdop, c.quality.min_snr)]),
        "speed_filter": _reasons([s.SpeedGate(100.0)]),
        "height_range": _reasons([s.HeightRange(1.0, 140.0)]),
        "height_jump": _reasons([g.Gates((g.HeightGate(1.0, 140.0, 50.0),))]),
        "coord_jump": _reasons([g.Gates((g.CoordinateJumpGate(500.0),))]),
        "jump_suppress": _reasons([g.Gates((g.JumpSuppressGate(4.0, 9.0, 2),))]),
        "stop_flag": _values([s.StopMark(3.0)], "stopped"),
        "parking_freeze": _values([s.ParkingFreeze(20.0)], "lat", "lon", "altitude", "stopped"),
        "moving_average": _values([s.MovingAverage(4)], *ALL),
        "fir_lowpass": _values([s.LowPassFir(FIR_CUTOFF)], *ALL),
        "reject_summary": reject_summary,
        "haversine": haversine,
        "knots": knots,
        "coord_convert": coord_convert,
        "checksum": checksum,
        "nmea_pairing": nmea_pairing,
        "nmea_pairing_join": nmea_pairing_join,
        "nmea_mixed": nmea_mixed,
        "nmea_mixed_join": nmea_mixed_join,
        "files_read": files_read,
        "gsv_attach": gsv_attach,
        "binary_decode": binary_decode,
        "render_points": render_points,
        "render_lines": render_lines,
        "file_chain": file_chain,
    }


# ---- SQL ---------------------------------------------------------------------------------------------

_DISTANCE = """2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a}))"""


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return _DISTANCE.format(a=a)


def _satellite(source: str, least: int = 3, start: int = 4, wait: int = 2) -> str:
    return f"""sat AS (SELECT *, CASE WHEN n <= {wait} THEN 'satellite: grace period'
    WHEN NOT bool_or(n > {wait} AND satellites >= {start}) OVER (PARTITION BY track_id ORDER BY n) THEN 'insufficient satellites (' || satellites || ' < START {start})'
    WHEN satellites < {least} THEN 'insufficient satellites (' || satellites || ' < {least})' END AS reason FROM {source})"""


_QUALITY = "CASE WHEN hdop >= 7.0 THEN 'quality: HDOP too high' WHEN len(snr) > 0 AND len(list_filter(snr, lambda x: x >= 12)) < 3 THEN 'quality: insufficient usable satellites' END"


def _speed(limit: float) -> str:
    return f"CASE WHEN speed_kmh > {limit} THEN 'speed too high (' || printf('%.1f', speed_kmh) || ' > {limit:.1f} km/h)' END"


def _fold(source: str, height: bool, jump: bool, suppress: bool) -> str:
    """gated: the rows of source (n numbers the alive ones of a track from 1) with reason, by recursion over n."""
    none = "CAST(NULL AS VARCHAR)"
    h = "CASE WHEN s.altitude < 1.0 THEN 'height: below minimum' WHEN s.altitude > 140.0 THEN 'height: above maximum' WHEN abs(s.altitude - p.h) > 50.0 THEN 'height: altitude jump' END" if height else none
    d = _haversine("p.la", "p.lo", "s.lat", "s.lon")
    j = f"CASE WHEN {d} > 500.0 THEN 'coordinate jump detected (' || printf('%.1f', {d}) || ' m > 500.0 m)' END" if jump else none
    v = "CASE WHEN p.wrong >= 2 THEN NULL WHEN abs(s.speed_kmh / 3.6 - p.v) > 9.0 THEN 'jump_suppress: velocity jump' WHEN abs(s.speed_kmh / 3.6 - p.v) > 4.0 THEN 'jump_suppress: excessive acceleration' END" if suppress else none
    return f"""gate(track_id, n, rh, rj, rv, h, la, lo, v, wrong) AS (
  SELECT track_id, 0::BIGINT, {none}, {none}, {none}, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0 FROM {source} GROUP BY track_id
  UNION ALL
  SELECT track_id, n, rh, CASE WHEN rh IS NULL THEN rj END, CASE WHEN rh IS NULL AND rj IS NULL THEN rv END,
    CASE WHEN rh IS NULL THEN altitude ELSE h END, CASE WHEN rh IS NULL AND rj IS NULL THEN lat ELSE la END, CASE WHEN rh IS NULL AND rj IS NULL THEN lon ELSE lo END,
    CASE WHEN rh IS NULL AND rj IS NULL AND rv IS NULL THEN speed_kmh / 3.6 ELSE v END,
    CASE WHEN rh IS NULL AND rj IS NULL THEN CASE WHEN rv IS NULL THEN 0 ELSE wrong + 1 END ELSE wrong END
  FROM (SELECT s.track_id, s.n, s.altitude, s.lat, s.lon, s.speed_kmh, p.h, p.la, p.lo, p.v, p.wrong, {h} AS rh, {j} AS rj, {v} AS rv
    FROM gate p JOIN {source} s ON s.track_id = p.track_id AND s.n = p.n + 1)),
gated AS (SELECT s.*, coalesce(rh, rj, rv) AS reason FROM {source} s JOIN gate USING (track_id, n))"""


def _parking(source: str, below: float) -> str:
    """parked: rows of source (numbered by n) while slow with the place of the first slow one."""
    w = "(PARTITION BY track_id ORDER BY n)"
    return f"""slow AS (SELECT *, speed_kmh < {below} AS slow, sum(CASE WHEN speed_kmh < {below} THEN 0 ELSE 1 END) OVER {w} AS run FROM {source}),
parked AS (SELECT * REPLACE (CASE WHEN slow THEN first_value(lat) OVER r ELSE lat END AS lat, CASE WHEN slow THEN first_value(lon) OVER r ELSE lon END AS lon,
  CASE WHEN slow THEN first_value(altitude) OVER r ELSE altitude END AS altitude) FROM slow WINDOW r AS (PARTITION BY track_id, run, slow ORDER BY n))"""


def _mean(c: str, w: int) -> str:
    near = f"(PARTITION BY track_id ORDER BY n ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"(sum({c}) OVER {near} + ({w} - count(*) OVER {near}) * first_value({c}) OVER (PARTITION BY track_id ORDER BY n)) / {w}"


def _fir(c: str) -> str:
    w = "OVER (PARTITION BY track_id ORDER BY n)"
    return " + ".join(f"(SELECT c FROM fir WHERE k = {k}) * coalesce(lag({c}, {k}) {w}, first_value({c}) {w})" for k in range(21))


#: The coefficients by their definition: a sinc at the cutoff under a Hamming window, of unit gain.
_COEFFICIENTS = f"""raw AS (SELECT k, CASE WHEN k = 10 THEN {FIR_CUTOFF} ELSE sin(pi() * {FIR_CUTOFF} * (k - 10)) / (pi() * (k - 10)) END * (0.54 - 0.46 * cos(2 * pi() * k / 20)) AS c FROM range(21) t(k)),
fir AS (SELECT k, c / (SELECT sum(c) FROM raw) AS c FROM raw)"""


def _full() -> str:
    """Common tables of the full chain; done has all records."""
    return f"""{SQL}, {_satellite("tv")},
pre AS (SELECT * REPLACE (coalesce(reason, {_QUALITY}, {_speed(150.0)}) AS reason) FROM sat),
live AS (SELECT * EXCLUDE (n, reason), row_number() OVER (PARTITION BY track_id ORDER BY rec_idx) AS n FROM pre WHERE reason IS NULL),
{_fold("live", True, True, True)},
kept AS (SELECT * EXCLUDE (n, reason), speed_kmh AS v, row_number() OVER (PARTITION BY track_id ORDER BY rec_idx) AS n FROM gated WHERE reason IS NULL),
{_parking("kept", 20.0)},
smooth AS (SELECT track_id, rec_idx, v < 20.0 AS stopped, {", ".join(f"{_mean(c, 4)} AS {c}" for c in ALL)} FROM parked),
done AS (SELECT t.track_id, t.rec_idx, t.time, t.course, t.satellites, t.hdop, t.snr, t.k, coalesce(p.reason, q.reason) AS reason, coalesce(m.stopped, false) AS stopped,
  {", ".join(f"coalesce(m.{c}, t.{c}) AS {c}" for c in ALL)}
  FROM tv t JOIN pre p USING (track_id, rec_idx) LEFT JOIN gated q USING (track_id, rec_idx) LEFT JOIN smooth m USING (track_id, rec_idx))"""


_TAG = "'[' || substr(time, 1, 2) || ':' || substr(time, 3, 2) || ':' || substr(time, 5, 2) || ']'"
_VIEW = """CASE WHEN len(snr) > 0 THEN chr(10) || '           In view (' || len(snr) || '):' || array_to_string(list_transform(snr,
  lambda x, i: '  PRN' || i || ' el=' || (k * i % 90) || '° az=' || (k * 37 * i % 360) || '° snr=' || x), '') ELSE '' END"""


def _point_sql(view: str = _VIEW) -> str:
    return f"""{_TAG} || ' Coordinates: ' || printf('%.5f', abs(lat)) || '°N, ' || printf('%.5f', abs(lon)) || '°E' || chr(10)
  || '           Speed: ' || printf('%.1f', speed_kmh) || ' km/h' || CASE WHEN stopped THEN ' (stopped)' ELSE '' END || ', Course: ' || printf('%.1f', course) || '°' || chr(10)
  || '           Altitude: ' || printf('%.1f', altitude) || ' m, Satellites: ' || satellites || ', HDOP: ' || printf('%.1f', hdop) || {view}"""


#: The view's sentences; degrees and numbers are what their texts say.
_SENTENCES = """m AS (SELECT *, round(lat * 600000)::BIGINT AS y, round(lon * 600000)::BIGINT AS x FROM tv),
p AS (SELECT *, printf('%02d%02d.%04d,N', y // 600000, y % 600000 // 10000, y % 10000) || ',' || printf('%03d%02d.%04d,E', x // 600000, x % 600000 // 10000, x % 10000) AS place FROM m),
body AS (SELECT track_id, rec_idx, unnest(range(0, 3)) AS which, unnest([
    'GPGSV,1,1,' || len(snr) || CASE WHEN len(snr) > 0 THEN ',' ELSE '' END || array_to_string(list_transform(snr, lambda s, i: i || ',' || (k * i % 90) || ',' || (k * 37 * i % 360) || ',' || s), ','),
    'GPRMC,' || rec_idx || ',A,' || place || ',' || printf('%.2f', speed_kmh) || ',' || printf('%.1f', course) || ',010124,,,A',
    'GPGGA,' || rec_idx || ',' || place || ',1,' || satellites || ',' || printf('%.1f', hdop) || ',' || printf('%.2f', altitude) || ',M,14.0,M,,']) AS b FROM p)"""
_READ = """m AS (SELECT *, round(lat * 600000)::BIGINT AS y, round(lon * 600000)::BIGINT AS x FROM tv),
fix AS (SELECT track_id, rec_idx, n, k, snr, satellites, hdop, altitude, CAST(rec_idx AS VARCHAR) AS time, y // 600000 + (y % 600000) / 10000.0 / 60.0 AS lat,
  x // 600000 + (x % 600000) / 10000.0 / 60.0 AS lon, speed_kmh * 1.852 AS speed_kmh, CAST(printf('%.1f', course) AS DOUBLE) AS course FROM m)"""


def _file_chain() -> str:
    """The default chain over the fixes of the view's sentences."""
    tag = f"CASE WHEN length(time) >= 6 THEN {_TAG} ELSE '[??:??:??]' END"
    return f"""WITH RECURSIVE {SQL}, {_READ}, {_satellite("fix", 4, 4, 0)},
pre AS (SELECT * REPLACE (coalesce(reason, {_speed(200.0)}) AS reason) FROM sat),
live AS (SELECT * EXCLUDE (n, reason), row_number() OVER (PARTITION BY track_id ORDER BY rec_idx) AS n FROM pre WHERE reason IS NULL),
{_fold("live", False, True, False)},
done AS (SELECT pre.* REPLACE (coalesce(pre.reason, gated.reason) AS reason), pre.speed_kmh < 3.0 AS stopped FROM pre LEFT JOIN gated USING (track_id, rec_idx))
SELECT track_id, rec_idx * 3 + 2 AS rec_idx, CASE WHEN reason IS NULL THEN {_point_sql().replace(_TAG, tag)} ELSE {tag} || ' Point rejected: ' || reason END AS text FROM done"""


def _rounded(columns: tuple[str, ...]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _mixed_sql() -> str:
    """Pairing as a recursion over the sentences of a track: the latest RMC (r) and GGA (g) until their times are equal, and the satellites
    since a first part, as long as totals agree."""
    rows = []
    for case, said in enumerate(MIXED):
        for at, (what, later, more) in enumerate(said):
            kind = {"GGA": "G", "VOID": "V", "WRONG": "W", "FOREIGN": "X"}.get(what, "S" if what[:3] == "GSV" else "R")
            part, total = (what[3], what[4]) if kind == "S" else (0, 0)
            rows.append(f"({case}, {at}, '{kind}', {later}, {more}, {part}, {total})")
    ident = lambda c: f"CASE WHEN done THEN NULL ELSE {c} END"
    return f"""WITH RECURSIVE {SQL}, mixed(c, pos, kind, later, more, part, total) AS (VALUES {", ".join(rows)}),
said AS (SELECT t.track_id, t.n * 10 + pos AS rec_idx, kind, CAST(t.n + later AS VARCHAR) AS time, more, part, total, row_number() OVER (PARTITION BY t.track_id ORDER BY t.n, pos) AS i, t.n,
  {_LAT6} AS y, {_LON6} AS x, speed_kmh, altitude, k, list_transform(snr, lambda s, j: {{'prn': j, 'snr': s}}) AS sats FROM tv t JOIN mixed ON t.n % {len(MIXED)} = c),
state(track_id, i, r, rt, g, gt, tot, sats, done, er, eg, es) AS (
  SELECT track_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, 0, []::STRUCT(prn BIGINT, snr INTEGER)[], false, NULL::BIGINT, NULL::BIGINT, []::STRUCT(prn BIGINT, snr INTEGER)[] FROM said GROUP BY track_id
  UNION ALL
  SELECT track_id, i, {ident("r")}, {ident("rt")}, {ident("g")}, {ident("gt")}, CASE WHEN done THEN 0 ELSE tot END, CASE WHEN done THEN [] ELSE sats END, done, r, g, sats
  FROM (SELECT *, r IS NOT NULL AND g IS NOT NULL AND rt = gt AND kind IN ('R', 'G') AS done
    FROM (SELECT s.track_id, s.i, s.kind, CASE WHEN s.kind = 'R' THEN s.i ELSE p.r END AS r, CASE WHEN s.kind = 'R' THEN s.time ELSE p.rt END AS rt,
        CASE WHEN s.kind = 'G' THEN s.i ELSE p.g END AS g, CASE WHEN s.kind = 'G' THEN s.time ELSE p.gt END AS gt,
        CASE WHEN s.kind = 'S' AND s.part = 1 THEN s.total ELSE p.tot END AS tot,
        CASE WHEN s.kind <> 'S' THEN p.sats WHEN s.part = 1 THEN s.sats WHEN s.total = p.tot THEN list_concat(p.sats, s.sats) ELSE p.sats END AS sats
      FROM state p JOIN said s ON s.track_id = p.track_id AND s.i = p.i + 1)))
SELECT p.track_id, s.rec_idx, r.time, round(CASE WHEN r.n % 3 = 0 THEN -r.y ELSE r.y END, 6) AS lat, round(-r.x, 6) AS lon,
  round((CAST(printf('%.2f', r.speed_kmh) AS DOUBLE) + r.more) * 1.852, 6) AS speed_kmh, round(CAST(printf('%.2f', g.altitude) AS DOUBLE) + g.more, 6) AS altitude,
  len(p.es)::INTEGER AS in_view, coalesce(list_sum(list_transform(p.es, lambda z: z.prn * z.snr)), 0)::BIGINT AS prn_by_snr, NULL AS error_text
FROM state p JOIN said s USING (track_id, i) JOIN said r ON r.track_id = p.track_id AND r.i = p.er JOIN said g ON g.track_id = p.track_id AND g.i = p.eg WHERE p.done
UNION ALL
SELECT track_id, rec_idx, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  CASE WHEN length(time) >= 6 THEN {_TAG} ELSE '[??:??:??]' END || CASE WHEN kind = 'V' THEN ' No valid GPS fix' ELSE ' Parse error: invalid checksum' END FROM said WHERE kind IN ('V', 'W')"""


def _files_sql() -> str:
    order = {k: i for i, k in enumerate(sorted(range(len(NAMES)), key=lambda k: NAMES[k].split("/")))}
    place = "CASE f " + " ".join(f"WHEN {k} THEN {i}" for k, i in order.items()) + " END"
    kind = ", ".join(str(k) for k, n in enumerate(NAMES) if n.endswith(".bin"))
    none = "f IN ({}) AND rec_idx % 7 = 0".format(kind)
    pick = lambda b, t: f"CASE WHEN {none} THEN NULL WHEN f IN ({kind}) THEN {b} ELSE {t} END"
    stamp = "strftime(to_timestamp(rec_idx + 1700000000) AT TIME ZONE 'UTC', '{}')"
    return f"""WITH {SQL}, f AS (SELECT *, CAST(track_id AS BIGINT) % {len(NAMES)} AS f FROM tv), o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY rec_idx) - 1 AS j FROM f)
SELECT {place} AS file_idx, CASE WHEN f IN ({kind}) THEN j ELSE 3 * j + 2 END AS rec_idx, {pick(stamp.format("%H%M%S"), "CAST(rec_idx AS VARCHAR)")} AS time,
  {pick("round(round(lat * 1e6) / 1e6 * CASE WHEN rec_idx % 2 = 0 THEN -1 ELSE 1 END, 6)", f"round({_LAT6}, 6)")} AS lat, {pick("round(-round(lon * 1e6) / 1e6, 6)", f"round({_LON6}, 6)")} AS lon,
  {pick("round(round(speed_kmh * 10) / 10.0, 6)", "round(speed_kmh * 1.852, 6)")} AS speed_kmh, {pick("round(altitude) - 100", "round(altitude, 6)")} AS altitude, {pick("satellites", "satellites")} AS satellites,
  CASE WHEN {none} THEN '[' || {stamp.format("%H:%M:%S")} || '] ' || ['Receiver error', 'Cell-tower position (LBS)', 'External location source (EL)', 'Last-known position (boot state)'][rec_idx % 4 + 1] END AS error FROM o"""


_LAT6, _LON6 = "round(lat * 600000)::BIGINT / 600000.0", "round(lon * 600000)::BIGINT / 600000.0"


def oracle_sql() -> dict[str, str]:
    key = "SELECT track_id, rec_idx"
    reason = f"{key}, reason FROM"
    tv = f"WITH {SQL}"
    recursive = f"WITH RECURSIVE {SQL}"
    fixes = f"""{key}, CAST(rec_idx AS VARCHAR) AS time, round({_LAT6}, 6) AS lat, round({_LON6}, 6) AS lon, round(speed_kmh * 1.852, 6) AS speed_kmh,
      round(CAST(printf('%.1f', course) AS DOUBLE), 6) AS course, round(altitude, 6) AS altitude, satellites, round(hdop, 6) AS hdop FROM tv"""
    none = "rec_idx % 7 = 0"
    fix = lambda e: f"CASE WHEN NOT {none} THEN {e} END"
    stamp = "strftime(to_timestamp(rec_idx + 1700000000) AT TIME ZONE 'UTC', '{}')"
    return {
        "full_chain": f"WITH RECURSIVE {_full()} {key}, reason, stopped, {_rounded(ALL)} FROM done",
        "satellite_gate": f"{tv}, {_satellite('tv')} {reason} sat",
        "quality_filter": f"{tv} {key}, {_QUALITY} AS reason FROM tv",
        "speed_filter": f"{tv} {key}, {_speed(100.0)} AS reason FROM tv",
        "height_range": f"{tv} {key}, CASE WHEN altitude < 1.0 THEN 'height: below minimum' WHEN altitude > 140.0 THEN 'height: above maximum' END AS reason FROM tv",
        "height_jump": f"{recursive}, {_fold('tv', True, False, False)} {reason} gated",
        "coord_jump": f"{recursive}, {_fold('tv', False, True, False)} {reason} gated",
        "jump_suppress": f"{recursive}, {_fold('tv', False, False, True)} {reason} gated",
        "stop_flag": f"{tv} {key}, speed_kmh < 3.0 AS stopped FROM tv",
        "parking_freeze": f"{tv}, {_parking('tv', 20.0)} {key}, {_rounded(('lat', 'lon', 'altitude'))}, slow AS stopped FROM parked",
        "moving_average": f"{tv} {key}, {', '.join(f'round({_mean(c, 4)}, 6) AS {c}' for c in ALL)} FROM tv",
        "fir_lowpass": f"{tv}, {_COEFFICIENTS} {key}, {', '.join(f'round({_fir(c)}, 6) AS {c}' for c in ALL)} FROM tv",
        "reject_summary": f"""WITH RECURSIVE {_full()} SELECT track_id, CASE WHEN reason IS NULL THEN 'point' ELSE 'rejected' END AS kind,
          regexp_replace(coalesce(reason, ''), ' ?\\([^)]*\\)', '', 'g') AS what, count(*) AS records FROM done GROUP BY ALL""",
        "haversine": f"{tv} {key}, round({_haversine('lat', 'lon', '55.75', '37.66')}, 6) AS metres FROM tv",
        "knots": f"{tv} {key}, round(speed_kmh * 1.852, 6) AS kmh FROM tv",
        "coord_convert": f"""{tv} {key}, printf('%02d%02d.%04d', m // 600000, m % 600000 // 10000, m % 10000) AS text,
          round((m // 600000 + (m % 600000) / 10000.0 / 60.0) * CASE WHEN rec_idx % 2 = 0 THEN 1 ELSE -1 END, 6) AS degrees FROM (SELECT *, round(lat * 600000)::BIGINT AS m FROM tv)""",
        "checksum": f"""{tv}, {_SENTENCES} SELECT track_id, rec_idx * 3 + which AS rec_idx,
          list_reduce(list_transform(range(1, length(b) + 1), lambda i: ascii(substr(b, i::BIGINT, 1))), lambda a, c: xor(a, c))::INTEGER AS checksum, (rec_idx * 3 + which) % 5 <> 0 AS valid, (rec_idx * 3 + which) % 5 <> 0 AS read_valid FROM body""",
        "file_chain": _file_chain(),
        "nmea_mixed": _mixed_sql(),
        "nmea_mixed_join": _mixed_sql(),
        "files_read": _files_sql(),
        "nmea_pairing": f"{tv} {fixes}",
        "nmea_pairing_join": f"{tv} {fixes}",
        "gsv_attach": f"""{tv} {key}, i::INTEGER AS prn, (k * i % 90)::INTEGER AS elevation, (k * 37 * i % 360)::INTEGER AS azimuth, snr[i] AS snr
          FROM (SELECT *, unnest(range(1, len(snr) + 1)) AS i FROM tv)""",
        "binary_decode": f"""{tv}, b AS (SELECT *, list_filter(list_transform(range(0, 96), lambda i: {{'prn': CASE WHEN i < 64 THEN i + 1 ELSE 63 - i END, 'snr': (rec_idx + i * 7) % 128}}), lambda x: x.snr > 0) AS sats FROM tv)
          {key}, {fix(stamp.format('%H%M%S'))} AS time, {fix("round(round(lat * 1e6) / 1e6 * CASE WHEN rec_idx % 2 = 0 THEN -1 ELSE 1 END, 6)")} AS lat,
          {fix("round(-round(lon * 1e6) / 1e6, 6)")} AS lon, {fix("round(round(speed_kmh * 10) / 10.0, 6)")} AS speed_kmh, {fix("round(round(course * 10) / 10.0, 6)")} AS course,
          {fix("round(altitude) - 100")} AS altitude, {fix("satellites")} AS satellites, {fix("round(round(hdop * 10) / 10.0, 6)")} AS hdop,
          {fix("len(sats)::INTEGER")} AS in_view, {fix("list_sum(list_transform(sats, lambda x: x.prn * x.snr))::BIGINT")} AS prn_by_snr,
          CASE WHEN {none} THEN '[' || {stamp.format('%H:%M:%S')} || '] ' || ['Receiver error', 'Cell-tower position (LBS)', 'External location source (EL)', 'Last-known position (boot state)'][rec_idx % 4 + 1] END AS error FROM b""",
        "render_points": f"{tv} {key}, {_point_sql()} AS text FROM (SELECT *, false AS stopped FROM tv)",
        "render_lines": f"WITH RECURSIVE {_full()} {key}, CASE WHEN reason IS NULL THEN {_point_sql()} ELSE {_TAG} || ' Point rejected: ' || reason END AS text FROM done",
    }
