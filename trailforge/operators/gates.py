"""Gates that compare a record with the last one they accepted.

What was accepted last depends on every decision before, so no window holds it. The gates of a chain stand together and
run in one pass over sorted partitions: Arrow batches in, one gate state per track, never a whole track in memory. Where a record was
accepted, numpy has already told which of the next ones may be refused if all up to them are accepted; the stretch before the
first of these is accepted at once, and records are judged one by one only from there to the next accepted one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..carry import carried
from ..functions.geo import RADIUS_M, haversine_m
from ..schema import ORDER

#: Takes (altitude, lat, lon, speed_kmh); returns why the record is rejected, or None. Its accept() takes the same.
Judge = Callable[[float, float, float, float], str | None]


@dataclass
class HeightJudge:
    gate: HeightGate
    last: float = math.nan

    def __call__(self, altitude, lat, lon, speed):
        if altitude < self.gate.low:
            return "height: below minimum"
        if altitude > self.gate.high:
            return "height: above maximum"
        if abs(altitude - self.last) > self.gate.jump:
            return "height: altitude jump"
        return self.accept(altitude, lat, lon, speed)

    def accept(self, altitude, lat, lon, speed) -> None:
        self.last = altitude


@dataclass
class DistanceJudge:
    gate: CoordinateJumpGate
    last: tuple[float, float] | None = None

    def __call__(self, altitude, lat, lon, speed):
        if self.last is not None and (d := haversine_m(*self.last, lat, lon)) > self.gate.limit:
            return f"coordinate jump detected ({d:.1f} m > {self.gate.limit:.1f} m)"
        return self.accept(altitude, lat, lon, speed)

    def accept(self, altitude, lat, lon, speed) -> None:
        self.last = (lat, lon)


@dataclass
class SpeedChangeJudge:
    gate: JumpSuppressGate
    last: float | None = None
    wrong: int = 0

    def __call__(self, altitude, lat, lon, speed):
        v, g = speed / 3.6, self.gate
        step = 0.0 if self.last is None or self.wrong >= g.patience else abs(v - self.last)
        if step > g.max_step or step > g.max_acceleration:
            self.wrong += 1
            return "jump_suppress: velocity jump" if step > g.max_step else "jump_suppress: excessive acceleration"
        return self.accept(altitude, lat, lon, speed)

    def accept(self, altitude, lat, lon, speed) -> None:
        self.last, self.wrong = speed / 3.6, 0


@dataclass(frozen=True)
class HeightGate:
    """Rejects heights out of range, and steps of more than `jump` from the last accepted height."""

    low: float = -50.0
    high: float = 2000.0
    jump: float = 50.0

    def judge(self) -> Judge:
        return HeightJudge(self)

    def may_refuse(self, altitude: np.ndarray, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray) -> np.ndarray:
        """For each record but the first: whether it may be refused after the one before it was accepted."""
        return (altitude[1:] < self.low) | (altitude[1:] > self.high) | (np.abs(np.diff(altitude)) > self.jump)


@dataclass(frozen=True)
class CoordinateJumpGate:
    """Rejects points further than `limit` metres from the last accepted one."""

    limit: float = 500.0

    def judge(self) -> Judge:
        return DistanceJudge(self)

    def may_refuse(self, altitude: np.ndarray, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray) -> np.ndarray:
        """As above; distances that come out near the limit may be refused, too."""
        y, x = np.radians(lat), np.radians(lon)
        a = np.sin(np.diff(y) / 2) ** 2 + np.cos(y[:-1]) * np.cos(y[1:]) * np.sin(np.diff(x) / 2) ** 2
        return 2 * RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a))) > self.limit - 1e-6 * (1 + abs(self.limit))


@dataclass(frozen=True)
class JumpSuppressGate:
    """Rejects sudden changes of speed, one second from record to record; after `patience` rejections one is accepted."""

    max_acceleration: float = 6.0
    max_step: float = 20.0
    patience: int = 5

    def judge(self) -> Judge:
        return SpeedChangeJudge(self)

    def may_refuse(self, altitude: np.ndarray, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray) -> np.ndarray:
        step = np.abs(np.diff(speed / 3.6))
        return (step > self.max_step) | (step > self.max_acceleration) if self.patience > 0 else step < 0


@dataclass(frozen=True)
class Gates:
    """Gates in order, as one stage."""

    gates: tuple

    def apply(self, df: DataFrame) -> DataFrame:
        names = df.columns
        key, reason, error, *needs = (names.index(c) for c in ("track_id", "reason", "error", "altitude", "lat", "lon", "speed_kmh"))
        gates = self.gates

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, judges, calm = object(), [], False  # calm: the track's last record was accepted by all
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                track, reasons = batch.column(key), batch.column(reason).to_pylist()
                live = pc.and_(pc.is_null(batch.column(reason)), pc.is_null(batch.column(error))).to_numpy(zero_copy_only=False)
                numbers = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in needs]
                # tracks follow each other, and a null is a track too
                codes = pc.fill_null(track.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), n]
                for a, b in zip(starts, starts[1:], strict=False):
                    if (name := track[a].as_py()) != now:
                        now, judges, calm = name, [g.judge() for g in gates], False
                    at = a + np.flatnonzero(live[a:b])
                    calm = _judge(at, [x[at] for x in numbers], gates, judges, calm, reasons)
                columns = [*batch.columns]
                columns[reason] = pa.array(reasons, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return df.sortWithinPartitions("track_id", *ORDER).mapInArrow(carried(run), df.schema)


def _judge(at: np.ndarray, numbers: list[np.ndarray], gates: tuple, judges: list[Judge], calm: bool, reasons: list) -> bool:
    """Sets the reasons of a track's live records (positions at); returns whether the last one was accepted."""
    n = len(at)
    if not n:
        return calm
    doubt = np.ones(n, bool)  # the first follows a record of another batch, or none
    if n > 1:
        with np.errstate(invalid="ignore"):
            doubt[1:] = np.logical_or.reduce([g.may_refuse(*numbers) if hasattr(g, "may_refuse") else np.ones(n - 1, bool) for g in gates])
    doubtful = np.flatnonzero(doubt).tolist()
    rows = list(zip(*(x.tolist() for x in numbers), strict=True))
    places, i, k = at.tolist(), 0, 0
    while i < n:
        if calm:
            while k < len(doubtful) and doubtful[k] < i:
                k += 1
            stop = doubtful[k] if k < len(doubtful) else n
            if stop > i:
                for judge in judges:  # the last of the stretch is what counts from here on
                    judge.accept(*rows[stop - 1])
                i = stop
                continue
        why = None
        for judge in judges:
            if (why := judge(*rows[i])) is not None:
                break
        calm, i = why is None, i + 1
        if why is not None:
            reasons[places[i - 1]] = why
    return calm
