"""Stages of a filter chain that are expressions or windows.

A stage sees the records of a track that are alive: decoded, and rejected by no stage before. It writes `reason` where
it rejects, or changes columns. What a window sees is kept apart by column ALIVE, set before the stage from what
earlier stages have decided, so a rejected record moves no later state. All windows share one partitioning and order.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..schema import ORDER
from .design import low_pass

ALIVE = "__alive"
SMOOTHED = ("lat", "lon", "speed_kmh", "altitude")


class Stage(Protocol):
    """What a chain is made of. Own stages need no more than this; one with `ordered = False` promises to look at single records
    alone, and is run where they are."""

    def apply(self, df: DataFrame) -> DataFrame: ...


def alive() -> Column:
    return F.col("reason").isNull() & F.col("error").isNull()


def track() -> WindowSpec:
    """Records of a track in order, alive ones by themselves."""
    return Window.partitionBy("track_id", ALIVE).orderBy(*ORDER)


def so_far() -> WindowSpec:
    return track().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def reject(df: DataFrame, reason: Column) -> DataFrame:
    """df with reason set where a record is alive and reason is not null."""
    return df.withColumn("reason", F.when(alive(), reason).otherwise(F.col("reason")))


def holds(test: Column, *numbers: Column) -> Column:
    """test, and false where one of the numbers is NaN, which SQL sorts above all others."""
    for x in numbers:
        test = test & ~F.isnan(x)
    return test


@dataclass(frozen=True)
class SatelliteGate:
    """Rejects the first `wait` records, then all until one has `start` satellites, then those with fewer than `least`."""

    least: int = 4
    start: int = 4
    wait: int = 0

    def apply(self, df: DataFrame) -> DataFrame:
        n, seen = F.col("satellites"), F.col("__seen")
        df = df.withColumn(ALIVE, alive()).withColumn("__seen", F.row_number().over(track()))
        df = df.withColumn("__started", F.max((seen > self.wait) & (n >= self.start)).over(so_far()))
        few = lambda end: F.concat(F.lit("insufficient satellites ("), n.cast("string"), F.lit(end))
        why = (
            F.when(seen <= self.wait, "satellite: grace period")
            .when(~F.col("__started"), few(f" < START {self.start})"))
            .when(n < self.least, few(f" < {self.least})"))
        )
        return reject(df, why).drop("__seen", "__started")


@dataclass(frozen=True)
class QualityGate:
    """Rejects poor geometry, and fewer than three satellites in view above a signal level where any are listed."""

    max_hdop: float = 5.0
    min_snr: int = 19
    usable: int = 3

    ordered = False

    def apply(self, df: DataFrame) -> DataFrame:
        view, hdop = F.col("satellites_in_view"), F.col("hdop")
        good = F.size(F.filter(view, lambda s: s["snr"] >= self.min_snr))
        why = F.when(holds(hdop >= self.max_hdop, hdop), "quality: HDOP too high").when(
            view.isNotNull() & (F.size(view) > 0) & (good < self.usable), "quality: insufficient usable satellites"
        )
        return reject(df, why)


@dataclass(frozen=True)
class SpeedGate:
    """Rejects speeds above a limit."""

    max_kmh: float = 200.0

    ordered = False

    def apply(self, df: DataFrame) -> DataFrame:
        v = F.col("speed_kmh")
        text = F.concat(F.lit("speed too high ("), fixed(v, 1), F.lit(f" > {'%.1f' % self.max_kmh} km/h)"))
        return reject(df, F.when(holds(v > self.max_kmh, v), text))


@dataclass(frozen=True)
class HeightRange:
    """The part of the height gate that needs no memory."""

    low: float = -50.0
    high: float = 2000.0

    ordered = False

    def apply(self, df: DataFrame) -> DataFrame:
        h = F.col("altitude")
        why = F.when(holds(h < self.low, h), "height: below minimum").when(holds(h > self.high, h), "height: above maximum")
        return reject(df, why)


@dataclass(frozen=True)
class StopMark:
    """Marks slow records as stopped."""

    below_kmh: float = 2.0

    ordered = False

    def apply(self, df: DataFrame) -> DataFrame:
        v = F.col("speed_kmh")
        return df.withColumn("stopped", F.coalesce("stopped", F.lit(False)) | (alive() & holds(v < self.below_kmh, v)))


@dataclass(frozen=True)
class ParkingFreeze:
    """While a track is slow, its position and altitude stay those of the first slow record."""

    below_kmh: float = 4.0

    def apply(self, df: DataFrame) -> DataFrame:
        v, slow = F.col("speed_kmh"), F.col("__slow")
        df = df.withColumn(ALIVE, alive()).withColumn("__slow", holds(v < self.below_kmh, v))
        df = df.withColumn("__begins", slow & ~F.coalesce(F.lag("__slow").over(track()), F.lit(False)))
        here = F.struct("lat", "lon", "altitude")
        df = df.withColumn("__held", F.last(F.when(F.col("__begins"), here), ignorenulls=True).over(so_far()))
        on = F.col(ALIVE) & slow
        for c in ("lat", "lon", "altitude"):
            df = df.withColumn(c, F.when(on, F.col(f"__held.{c}")).otherwise(F.col(c)))
        return df.withColumn("stopped", F.coalesce("stopped", F.lit(False)) | on).drop("__slow", "__begins", "__held")


@dataclass(frozen=True)
class MovingAverage:
    """Mean of the last `window` records, as if the first one had been there for ever."""

    window: int = 5

    def apply(self, df: DataFrame) -> DataFrame:
        df = df.withColumn(ALIVE, alive())
        near = track().rowsBetween(-(self.window - 1), Window.currentRow)
        n = F.count(F.lit(1)).over(near)

        def mean(c: str) -> Column:
            before = F.when(n < self.window, (self.window - n) * F.first(c).over(so_far())).otherwise(0.0)  # 0 * NaN is NaN
            return (F.sum(c).over(near) + before) / self.window

        return _smooth(df, {c: mean(c) for c in SMOOTHED})


@dataclass(frozen=True)
class LowPassFir:
    """Convolution with a windowed sinc, as if the first record had been there for ever."""

    cutoff: float = 0.2
    taps: int = 21

    def apply(self, df: DataFrame) -> DataFrame:
        df, h = df.withColumn(ALIVE, alive()), low_pass(self.cutoff, self.taps)

        def output(c: str) -> Column:
            first = F.first(c).over(so_far())
            total = F.lit(h[0]) * F.col(c)
            for k in range(1, self.taps):
                total = total + F.lit(h[k]) * F.coalesce(F.lag(c, k).over(track()), first)
            return total

        return _smooth(df, {c: output(c) for c in SMOOTHED})


def _smooth(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    df = df.withColumns({f"__{c}": x for c, x in made.items()})
    df = df.withColumns({c: F.when(F.col(ALIVE), F.col(f"__{c}")).otherwise(F.col(c)) for c in made})
    return df.drop(*(f"__{c}" for c in made))
