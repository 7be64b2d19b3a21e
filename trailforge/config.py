"""Settings of a run: input, the filter chain and output, read from JSON or from the command line."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints


class ConfigError(ValueError):
    """The settings can't be read."""


@dataclass
class Satellite:
    enabled: bool = True
    min_satellites: int = 4
    start_count: int = 4
    wait_seconds: int = 0


@dataclass
class Quality:
    enabled: bool = False
    max_hdop: float = 5.0
    min_snr: int = 19


@dataclass
class Speed:
    enabled: bool = True
    max_speed_kmh: float = 200.0


@dataclass
class Height:
    enabled: bool = False
    min_m: float = -50.0
    max_m: float = 2000.0
    max_jump_m: float = 50.0


@dataclass
class Jump:
    enabled: bool = True
    max_distance_m: float = 500.0


@dataclass
class JumpSuppress:
    enabled: bool = False
    max_acc_ms2: float = 6.0
    max_jump_ms: float = 20.0
    max_wrong: int = 5


@dataclass
class Stop:
    enabled: bool = True
    threshold_kmh: float = 3.0


@dataclass
class Parking:
    enabled: bool = False
    speed_kmh: float = 4.0


@dataclass
class LowPass:
    enabled: bool = False
    type: str = "pif"
    cutoff: float = 0.2

    def window(self) -> int:
        """Points that the moving average spans."""
        if not self.cutoff > 0:
            raise ConfigError("a moving average needs a cutoff above 0")
        return max(3, math.floor(0.886 / self.cutoff + 0.5))


@dataclass
class Filters:
    satellite: Satellite = field(default_factory=Satellite)
    quality: Quality = field(default_factory=Quality)
    speed: Speed = field(default_factory=Speed)
    height: Height = field(default_factory=Height)
    jump: Jump = field(default_factory=Jump)
    jump_suppress: JumpSuppress = field(default_factory=JumpSuppress)
    stop: Stop = field(default_factory=Stop)
    parking: Parking = field(default_factory=Parking)
    lpf: LowPass = field(default_factory=LowPass)


@dataclass
class Rotation:
    max_size_kb: int = 1024
    max_files: int = 5


@dataclass
class Output:
    type: str = "console"
    path: str = "gps_output.log"
    rotation: Rotation = field(default_factory=Rotation)


@dataclass
class Input:
    type: str = "auto"
    path: str = ""
    recursive: bool = False


@dataclass
class Config:
    input: Input = field(default_factory=Input)
    filters: Filters = field(default_factory=Filters)
    output: Output = field(default_factory=Output)


def _leaf(name: str, kind: type, value: Any) -> Any:
    """value as kind: booleans and numbers don't stand for each other, but an integer is a float too."""
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, bool) != (kind is bool) or not isinstance(value, kind):
        raise ConfigError(f"{name}: {kind.__name__} expected, got {value!r}")
    return value


def _fill(section: Any, given: Any, name: str = "") -> None:
    """Sets what is given; a null leaves the default, except in rotation, and unknown keys are ignored."""
    if not isinstance(given, dict):
        if given is None and name and not isinstance(section, Rotation):
            return
        raise ConfigError(f"{name or 'config'}: object expected")
    kinds = get_type_hints(type(section))
    for f in fields(section):
        if f.name not in given:
            continue
        value, at = given[f.name], f"{name}.{f.name}".lstrip(".")
        if is_dataclass(kinds[f.name]):
            _fill(getattr(section, f.name), value, at)
        elif value is not None or isinstance(section, Rotation):
            setattr(section, f.name, _leaf(at, kinds[f.name], value))


def loads(text: str) -> Config:
    try:
        given = json.loads(text)
    except json.JSONDecodeError as e:
        raise ConfigError(f"not JSON: {e}") from e
    config = Config()
    _fill(config, given)
    return config


def load(path: str) -> Config:
    """Settings from a file; a byte order mark is skipped."""
    try:
        with open(path, encoding="utf-8-sig") as f:
            return loads(f.read())
    except OSError as e:
        raise ConfigError(f"cannot open config file: {path}") from e


def from_flags(lpf: str = "pif", cutoff: float = 0.2) -> Config:
    """Settings of a run without a file: defaults, and smoothing unless the cutoff is 1."""
    config = Config()
    config.filters.lpf = LowPass(cutoff < 1.0, lpf, cutoff)
    return config


def with_path(config: Config, path: str) -> Config:
    """A path on the command line: never recursive; type auto is settled by the path's own ending, even for a folder."""
    config.input.path, config.input.recursive = path, False
    if config.input.type == "auto":
        config.input.type = "binary" if path.endswith(".bin") else "nmea"
    return config
