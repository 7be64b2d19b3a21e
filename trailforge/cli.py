"""python -m trailforge <path> [--config <file>] [-lpf <pif|fir>] [-cf <0.01..1>]"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import config as c
from .plans.chain import run_chain, stages
from .sinks.logs import RotatingLog, to_console, to_rotating_log
from .sources.files import read_path

USAGE = """Usage: python -m trailforge <path> [--config <cfg.json>] [-lpf <pif|fir>] [-cf <0.01..1>]
  <path>    a file (.nmea, .bin) or a folder
  --config  settings as JSON, instead of -lpf and -cf
  -lpf      smoothing: pif (moving average) or fir (windowed sinc)
  -cf       low-pass cutoff, 1 for no smoothing; 0.2 unless given"""


class UsageError(ValueError):
    """The arguments are wrong; usage says whether the usage text helps."""

    def __init__(self, message: str, usage: bool = False):
        super().__init__(message)
        self.usage = usage


def parse(args: Sequence[str]) -> c.Config:
    """Settings of a command line."""
    path, file, lpf, cutoff = "", "", "pif", 0.2
    rest = list(args)
    while rest:
        arg = rest.pop(0)
        if not arg.startswith("-"):
            if path:
                raise UsageError(f"unexpected argument '{arg}'", usage=True)
            path = arg
        elif arg == "--config":
            if not rest:
                raise UsageError("--config requires a file path")
            file = rest.pop(0)
        elif arg == "-lpf":
            if not rest:
                raise UsageError("-lpf requires an argument (pif or fir)")
            if (lpf := rest.pop(0)) not in ("pif", "fir"):
                raise UsageError(f"-lpf must be 'pif' or 'fir', got '{lpf}'")
        elif arg == "-cf":
            if not rest:
                raise UsageError("-cf requires a numeric argument")
            given = rest.pop(0)
            try:
                cutoff = float(given)
            except ValueError:
                raise UsageError(f"-cf value '{given}' is not a number") from None
            if not 0.01 <= cutoff <= 1.0:
                raise UsageError(f"-cf must be in [0.01, 1.0], got {given}")
        else:
            raise UsageError(f"unknown argument '{arg}'", usage=True)
    if not path and not file:
        raise UsageError("", usage=True)
    settings = c.load(file) if file else c.from_flags(lpf, cutoff)
    return c.with_path(settings, path) if path else settings


def process(spark: SparkSession, settings: c.Config, track_id: str = "track") -> DataFrame:
    """The records that settings name, after their chain."""
    chain = stages(settings.filters)
    records = read_path(spark, settings.input.path, settings.input.type, settings.input.recursive, track_id)
    return run_chain(records, chain)


def run(spark: SparkSession, settings: c.Config) -> None:
    """Processes and writes. The output opens before the input."""
    out = settings.output
    chain_ok = stages(settings.filters)  # wrong coefficients fail before a file is touched
    log = RotatingLog(out.path, out.rotation.max_size_kb, out.rotation.max_files) if out.type == "file" else None
    assert chain_ok is not None
    processed = process(spark, settings)
    if log:
        to_rotating_log(processed, log)
    else:
        to_console(processed)


def main(args: Sequence[str] | None = None) -> int:
    try:
        settings = parse(sys.argv[1:] if args is None else args)
        spark = SparkSession.builder.appName("trailforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        run(spark, settings)
    except UsageError as e:
        if str(e):
            print(f"Error: {e}", file=sys.stderr)
        if e.usage:
            print(USAGE, file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0
