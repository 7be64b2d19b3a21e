"""Distances on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees."""
    p, q = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = p * p + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * q * q
    return F.lit(2 * RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """The same of floats."""
    p, q = math.sin((math.radians(lat2) - math.radians(lat1)) / 2), math.sin((math.radians(lon2) - math.radians(lon1)) / 2)
    a = p * p + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * q * q
    if math.isnan(a):
        return math.nan
    return 2 * RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))
