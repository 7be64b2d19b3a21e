"""Made-up tracks and files for tests."""

import random
import struct

from trailforge.functions.sentence import checksum
from trailforge.schema import RECORD

F1 = """# six cases

$GPRMC,120000,A,5545.1234,N,03739.5678,E,025.0,045.0,270124,,,A*70
$GPGGA,120000,5545.1234,N,03739.5678,E,1,10,0.8,150.0,M,14.0,M,,*4E
$GPRMC,120001,A,5545.1235,N,03739.5679,E,001.2,045.0,270124,,,A*75
$GPGGA,120001,5545.1235,N,03739.5679,E,1,10,0.8,150.0,M,14.0,M,,*4F
$GPRMC,120002,A,5546.0000,N,03740.5000,E,025.0,045.0,270124,,,A*72
$GPGGA,120002,5546.0000,N,03740.5000,E,1,10,0.8,150.0,M,14.0,M,,*4C
$GPRMC,120003,A,5545.1236,N,03739.5680,E,025.0,045.0,270124,,,A*76
$GPGGA,120003,5545.1236,N,03739.5680,E,1,03,2.5,150.0,M,14.0,M,,*45
$GPRMC,120004,V,,,,,,,270124,,,N*56
$GPRMC,120005,A,5545.1234,N,03739.5678,E,025.0,045.0,270124,,,A*00
"""


def sentence(body: str) -> str:
    return f"${body}*{checksum(f'${body}*'):02X}"


def rmc(time="120000", lat="5545.1234,N", lon="03739.5678,E", speed="025.0", course="045.0", status="A") -> str:
    return sentence(f"GPRMC,{time},{status},{lat},{lon},{speed},{course},270124,,,A")


def gga(time="120000", sats="10", hdop="0.8", alt="150.0") -> str:
    return sentence(f"GPGGA,{time},5545.1234,N,03739.5678,E,1,{sats},{hdop},{alt},M,14.0,M,,")


def record(status=0, lat=55752057, lon=37659463, height=150, speed=463, course=450, hdop=8, sats=10, at=1706356800, signal=None) -> bytes:
    out = bytearray(196)
    struct.pack_into("<QBiihHHBBB", out, 8, at, status, lat, lon, height, speed, course, hdop, 10, sats)
    for k, level in (signal or {}).items():
        out[100 + k] = level
    return bytes(out)


def points(track: str, speeds=None, **columns) -> list[tuple]:
    """Records of a track; columns are lists or single values."""
    n = len(speeds or next(v for v in columns.values() if isinstance(v, list)))
    base = {"time": "120000", "lat": 55.0, "lon": 37.0, "speed_kmh": speeds or 50.0, "course": 1.0, "altitude": 100.0, "satellites": 10, "hdop": 1.0, "stopped": False, "satellites_in_view": None, "error": None} | columns
    at = lambda v, k: v[k] if isinstance(v, list) else v
    rows = []
    for k in range(n):
        row = {"track_id": track, "file_idx": 0, "rec_idx": k} | {c: at(v, k) for c, v in base.items()}
        rows.append(tuple(row[c] for c in RECORD.names))
    return rows


def frame(spark, *tracks):
    return spark.createDataFrame([r for t in tracks for r in t], RECORD)


def wild(rng: random.Random, track: str, n: int) -> list[tuple]:
    """A track with jumps, losses, errors and NaN."""
    rows, lat, lon, alt, v = [], 55.0, 37.0, 100.0, 30.0
    for k in range(n):
        lat, lon = lat + rng.gauss(0, 0.0003) + (rng.random() < 0.05) * 0.02, lon + rng.gauss(0, 0.0003)
        alt, v = alt + rng.gauss(0, 5) + (rng.random() < 0.05) * rng.choice((-80, 80)), max(0.0, v + rng.gauss(0, 8) + (rng.random() < 0.1) * rng.choice((-60, 90)))
        view = rng.choice((None, [], [(i, 10, 20, rng.randint(0, 40)) for i in range(rng.randint(1, 7))]))
        row = {
            "track_id": track, "file_idx": k // 50, "rec_idx": k, "time": f"{k:06d}", "lat": lat, "lon": lon,
            "speed_kmh": float("nan") if rng.random() < 0.01 else round(v, 1), "course": 10.0, "altitude": float("nan") if rng.random() < 0.01 else round(alt, 1),
            "satellites": rng.randint(2, 12), "hdop": float("nan") if rng.random() < 0.01 else round(rng.uniform(0.5, 6), 1),
            "stopped": False, "satellites_in_view": view, "error": "[00:00:00] x" if rng.random() < 0.05 else None,
        }
        rows.append(tuple(row[c] for c in RECORD.names))
    return rows
