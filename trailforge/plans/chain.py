"""From settings to a plan: which stages a chain has, and how they run.

The order of stages is fixed. A chain of stages that look at one record alone moves no data. Records are dealt by track before the
first stage that needs their order; windows before the gates share that exchange, the gates run in one pass over it, and
windows after the gates need one more, as Spark can't see that a Python pass keeps partitions. Chains without gates are
native throughout.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Filters
from ..operators import gates as g
from ..operators import stages as s


def stages(filters: Filters) -> list:
    """The enabled stages; gates that stand together become one."""
    f, out, memory = filters, [], []
    if f.satellite.enabled:
        out.append(s.SatelliteGate(f.satellite.min_satellites, f.satellite.start_count, f.satellite.wait_seconds))
    if f.quality.enabled:
        out.append(s.QualityGate(f.quality.max_hdop, f.quality.min_snr))
    if f.speed.enabled:
        out.append(s.SpeedGate(f.speed.max_speed_kmh))
    if f.height.enabled:
        memory.append(g.HeightGate(f.height.min_m, f.height.max_m, f.height.max_jump_m))
    if f.jump.enabled:
        memory.append(g.CoordinateJumpGate(f.jump.max_distance_m))
    if f.jump_suppress.enabled:
        memory.append(g.JumpSuppressGate(f.jump_suppress.max_acc_ms2, f.jump_suppress.max_jump_ms, f.jump_suppress.max_wrong))
    if memory:
        out.append(g.Gates(tuple(memory)))
    if f.stop.enabled:
        out.append(s.StopMark(f.stop.threshold_kmh))
    if f.parking.enabled:
        out.append(s.ParkingFreeze(f.parking.speed_kmh))
    if f.lpf.enabled and f.lpf.cutoff < 1.0:
        out.append(s.LowPassFir(f.lpf.cutoff) if f.lpf.type == "fir" else s.MovingAverage(f.lpf.window()))
    return out


def run_chain(records: DataFrame, chain: Iterable) -> DataFrame:
    """records after every stage, with reason: null for what passed. Records with an error take no part."""
    out = records
    for name, kind in (("error", "string"), ("reason", "string")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    dealt = False
    for stage in chain:
        if getattr(stage, "ordered", True) and not dealt:
            out, dealt = out.repartition("track_id"), True
        out = stage.apply(out)
        if isinstance(stage, g.Gates):
            dealt = False  # one exchange for all windows to come
    return out.drop(s.ALIVE)


def kinds(processed: DataFrame) -> DataFrame:
    """processed and kind: point, rejected or error."""
    return processed.withColumn("kind", F.when(F.col("error").isNotNull(), "error").when(F.col("reason").isNotNull(), "rejected").otherwise("point"))


def summary(processed: DataFrame) -> DataFrame:
    """Records of each track by kind and reason, the numbers in reasons left out. An extension for reports."""
    what = F.regexp_replace(F.coalesce("error", "reason", F.lit("")), r" ?\([^)]*\)|\[[^\]]*\] ?", "")
    return kinds(processed).groupBy("track_id", "kind", what.alias("what")).agg(F.count("*").alias("records"))
