"""Every stage of a chain as a step for one record after another, with a state that can be stored."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

from ..operators import gates as g
from ..operators import stages as s
from ..operators.design import low_pass


@dataclass
class SatelliteStep:
    stage: s.SatelliteGate
    seen: int = 0
    started: bool = False

    def __call__(self, p: dict) -> str | None:
        self.seen += 1
        n, t = p["satellites"], self.stage
        if self.seen <= t.wait:
            return "satellite: grace period"
        self.started = self.started or n >= t.start
        if not self.started:
            return f"insufficient satellites ({n} < START {t.start})"
        return f"insufficient satellites ({n} < {t.least})" if n < t.least else None


@dataclass
class QualityStep:
    stage: s.QualityGate

    def __call__(self, p: dict) -> str | None:
        if p["hdop"] >= self.stage.max_hdop:
            return "quality: HDOP too high"
        view = p["satellites_in_view"]
        if view is not None and len(view) and sum(v["snr"] >= self.stage.min_snr for v in view) < self.stage.usable:
            return "quality: insufficient usable satellites"
        return None


@dataclass
class SpeedStep:
    stage: s.SpeedGate

    def __call__(self, p: dict) -> str | None:
        v, top = p["speed_kmh"], self.stage.max_kmh
        return f"speed too high ({v:.1f} > {top:.1f} km/h)" if v > top else None


@dataclass
class HeightRangeStep:
    stage: s.HeightRange

    def __call__(self, p: dict) -> str | None:
        h = p["altitude"]
        return "height: below minimum" if h < self.stage.low else "height: above maximum" if h > self.stage.high else None


@dataclass
class GateStep:
    judges: list

    def __call__(self, p: dict) -> str | None:
        values = (p["altitude"], p["lat"], p["lon"], p["speed_kmh"])
        return next((why for j in self.judges if (why := j(*values)) is not None), None)


@dataclass
class StopStep:
    stage: s.StopMark

    def __call__(self, p: dict) -> None:
        p["stopped"] = bool(p["stopped"]) or p["speed_kmh"] < self.stage.below_kmh


@dataclass
class ParkingStep:
    stage: s.ParkingFreeze
    held: tuple | None = None

    def __call__(self, p: dict) -> None:
        if not p["speed_kmh"] < self.stage.below_kmh:
            self.held = None
            return
        self.held = self.held or (p["lat"], p["lon"], p["altitude"])
        p["lat"], p["lon"], p["altitude"] = self.held
        p["stopped"] = True


@dataclass
class SmoothStep:
    """Weights of the record itself and those before it."""

    weights: list[float]
    past: dict = field(default_factory=dict)

    def __call__(self, p: dict) -> None:
        for c in s.SMOOTHED:
            q = self.past.setdefault(c, deque([p[c]] * len(self.weights), maxlen=len(self.weights)))
            q.appendleft(p[c])
            p[c] = math.fsum(w * x for w, x in zip(self.weights, q, strict=True)) if all(map(math.isfinite, q)) else sum(w * x for w, x in zip(self.weights, q, strict=True))


def step_of(stage) -> object:
    """The step of a stage."""
    match stage:
        case s.SatelliteGate():
            return SatelliteStep(stage)
        case s.QualityGate():
            return QualityStep(stage)
        case s.SpeedGate():
            return SpeedStep(stage)
        case s.HeightRange():
            return HeightRangeStep(stage)
        case g.Gates():
            return GateStep([x.judge() for x in stage.gates])
        case s.StopMark():
            return StopStep(stage)
        case s.ParkingFreeze():
            return ParkingStep(stage)
        case s.MovingAverage():
            return SmoothStep([1 / stage.window] * stage.window)
        case s.LowPassFir():
            return SmoothStep(low_pass(stage.cutoff, stage.taps))
    raise TypeError(f"{type(stage).__name__} has no step")


def process(steps: list, p: dict) -> dict:
    """p after the steps, with reason: the first rejection ends its way. Records with an error take no part."""
    p.setdefault("reason", None)
    if p.get("error") is None and p["reason"] is None:
        for step in steps:
            if (why := step(p)) is not None:
                p["reason"] = why
                break
    return p
