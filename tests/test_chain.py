import math
import random

import pytest

from tests.tracks import frame, points, wild
from trailforge.config import Filters
from trailforge.operators import gates as g
from trailforge.operators import stages as s
from trailforge.operators.design import low_pass
from trailforge.plans.chain import kinds, run_chain, stages, summary
from trailforge.plans.queries import CHAIN
from trailforge.schema import RECORD
from trailforge.streaming.steps import process, step_of


def passes(spark, chain, rows):
    out = run_chain(frame(spark, rows), chain).orderBy("rec_idx").collect()
    return "".join("P" if r.reason is None else "R" for r in out), [r.reason for r in out], out


@pytest.mark.parametrize(
    ("stage", "columns", "want"),
    [
        (s.SatelliteGate(3, 4, 3), {"satellites": [10, 10, 10, 10]}, "RRRP"),
        (s.SatelliteGate(3, 5, 1), {"satellites": [10, 4, 5, 3]}, "RRPP"),
        (s.SatelliteGate(3, 4, 0), {"satellites": [4, 2]}, "PR"),
        (s.SatelliteGate(5, 4, 0), {"satellites": [4, 5]}, "RP"),
        (s.SpeedGate(200), {"speeds": [200.0, 200.1, math.nan]}, "PRP"),
        (s.QualityGate(5, 19), {"hdop": [4.99, 5.0, math.nan]}, "PRP"),
        (s.QualityGate(10, 19), {"satellites_in_view": [[(1, 1, 1, x) for x in v] for v in ([19, 20, 25, 5, 10], [19, 25, 5, 10], [])]}, "PRP"),
        (g.Gates((g.HeightGate(),)), {"altitude": [-51.0, 2001.0, -50.0]}, "RRP"),
        (g.Gates((g.HeightGate(),)), {"altitude": [100.0, 160.0, 150.0]}, "PRP"),
        (g.Gates((g.HeightGate(),)), {"altitude": [100.0, 160.0, 161.0, 120.0]}, "PRRP"),
        (g.Gates((g.CoordinateJumpGate(500),)), {"lat": [55.0, 56.0, 55.0001]}, "PRP"),
        (g.Gates((g.JumpSuppressGate(6, 20, 5),)), {"speeds": [36.0, 50.4]}, "PP"),
        (g.Gates((g.JumpSuppressGate(6, 20, 5),)), {"speeds": [36.0, 61.2]}, "PR"),
        (g.Gates((g.JumpSuppressGate(6, 20, 3),)), {"speeds": [0.0, 200.0, 200.0, 200.0, 200.0]}, "PRRRP"),
        (g.Gates((g.JumpSuppressGate(6, 20, 0),)), {"speeds": [0.0, 200.0, 0.0]}, "PPP"),
        (g.Gates((g.CoordinateJumpGate(500), g.JumpSuppressGate(6, 20, 5))), {"lat": [55.0, 56.0, 55.0], "speeds": [0.0, 10.0, 21.0]}, "PRP"),
    ],
)
def test_sequences(spark, stage, columns, want):
    assert passes(spark, [stage], points("t", **columns))[0] == want


def test_reasons(spark):
    said = lambda stage, **c: passes(spark, [stage], points("t", **c))[1]
    assert said(s.SatelliteGate(3, 4, 1), satellites=[9, 3, 4, 2]) == ["satellite: grace period", "insufficient satellites (3 < START 4)", None, "insufficient satellites (2 < 3)"]
    assert said(s.SpeedGate(200), speeds=[250.25, 250.35]) == ["speed too high (250.2 > 200.0 km/h)", "speed too high (250.3 > 200.0 km/h)"]
    assert said(g.Gates((g.JumpSuppressGate(100, 20, 5),)), speeds=[0.0, 76.0])[1] == "jump_suppress: velocity jump"
    assert said(g.Gates((g.CoordinateJumpGate(500),)), lat=[55.0, 55.01])[1] == "coordinate jump detected (1111.9 m > 500.0 m)"
    assert said(g.Gates((g.HeightGate(),)), altitude=[0.0, 60.0, -60.0, 3000.0])[1:] == ["height: altitude jump", "height: below minimum", "height: above maximum"]
    assert said(s.HeightRange(), altitude=[-50.0, -51.0, 2001.0])[1:] == ["height: below minimum", "height: above maximum"]


def test_marks_and_freezes(spark):
    out = passes(spark, [s.StopMark(5)], points("t", [4.9, 5.0]))[2]
    assert [r.stopped for r in out] == [True, False]
    rows = points("t", [2.0, 1.0, 9.0, 3.0, 2.0], lat=[55.0, 55.1, 55.2, 55.3, 55.4], altitude=[1.0, 2.0, 3.0, 4.0, 5.0])
    out = passes(spark, [s.ParkingFreeze(4)], rows)[2]
    assert [(r.lat, r.altitude, r.stopped) for r in out] == [(55.0, 1.0, True), (55.0, 1.0, True), (55.2, 3.0, False), (55.3, 4.0, True), (55.3, 4.0, True)]
    assert [r.speed_kmh for r in out] == [2.0, 1.0, 9.0, 3.0, 2.0]


def test_smoothing(spark):
    out = passes(spark, [s.MovingAverage(3)], points("t", [30.0, 60.0, 30.0, 0.0], lat=[1.0, 2.0, 3.0, 4.0]))[2]
    assert [r.lat for r in out] == pytest.approx([1, 4 / 3, 2, 3]) and out[1].speed_kmh == pytest.approx(40)
    out = passes(spark, [s.LowPassFir(0.5)], points("t", [7.0] * 30))[2]
    assert [r.speed_kmh for r in out] == pytest.approx([7.0] * 30, abs=1e-6)
    out = passes(spark, [s.LowPassFir(0.05, 51)], points("t", [0.0, 10.0] * 100))[2]
    assert out[-1].speed_kmh == pytest.approx(5, abs=0.5)


def test_coefficients():
    h = low_pass(0.15)
    assert h[0] == pytest.approx(-0.0026012824532543146) and h[10] == pytest.approx(0.153228184594796) and sum(h) == pytest.approx(1)
    assert h == pytest.approx(h[::-1])
    for bad in ((0, 21), (1.1, 21), (0.5, 2), (math.nan, 21)):
        with pytest.raises(ValueError):
            low_pass(*bad)


def sequential(rows, chain):
    """The chain as steps, record after record."""
    out, steps = {}, {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        p = dict(zip(RECORD.names, row, strict=True))
        view = p["satellites_in_view"]
        p["satellites_in_view"] = None if view is None else [dict(zip(("prn", "elevation", "azimuth", "snr"), v, strict=True)) for v in view]
        mine = steps.setdefault(row[0], [step_of(x) for x in chain])
        out[row[0], row[2]] = process(mine, p)
    return out


@pytest.mark.parametrize("lpf", ["pif", "fir"])
def test_plans_agree_with_steps(spark, lpf):
    import copy

    rng = random.Random(11)
    filters = copy.deepcopy(CHAIN)
    filters.height.max_m, filters.lpf.type = 400.0, lpf
    rows = [r for k in range(6) for r in wild(rng, f"t{k}", 160)]
    rng.shuffle(rows)
    for chain in (stages(filters), [x for x in stages(filters) if not isinstance(x, g.Gates)]):
        want = sequential(rows, chain)
        got = run_chain(frame(spark, rows), chain).collect()
        assert len(got) == len(rows)
        seen = set()
        for r in got:
            w = want[r.track_id, r.rec_idx]
            assert (r.reason, r.error, bool(r.stopped)) == (w["reason"], w["error"], bool(w["stopped"]))
            seen.add((r.reason or "").split(" (")[0])
            for c in s.SMOOTHED:
                assert r[c] == pytest.approx(w[c], abs=1e-6, nan_ok=True)
        assert len(seen) >= (9 if any(isinstance(x, g.Gates) for x in chain) else 5)


def test_stretches_decide_as_records_do(spark):
    """Long tracks in small batches, so that stretches end anywhere: at doubts, at batches, at tracks."""
    rng = random.Random(21)
    rows = [r for k in range(3) for r in wild(rng, f"t{k}", 400)]
    chains = [(g.HeightGate(-50, 2000, 30),), (g.CoordinateJumpGate(100),), (g.JumpSuppressGate(3, 5, 3),), (g.JumpSuppressGate(3, 5, 0),), (g.HeightGate(-50, 2000, 30), g.CoordinateJumpGate(100), g.JumpSuppressGate(3, 5, 3))]
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            for gates in chains:
                want = sequential(rows, [g.Gates(gates)])
                got = run_chain(frame(spark, rows), [g.Gates(gates)]).collect()
                assert len(got) == len(rows) and all(r.reason == want[r.track_id, r.rec_idx]["reason"] for r in got)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_errors_take_no_part(spark):
    rows = points("t", [50.0] * 4, satellites=[10, 0, 10, 10], error=[None, "e", None, None])
    done = run_chain(frame(spark, rows), [s.SatelliteGate(3, 4, 2)])
    assert [r.kind for r in kinds(done).orderBy("rec_idx").collect()] == ["rejected", "error", "rejected", "point"]
    assert {(r.kind, r.what, r.records) for r in summary(done).collect()} == {("rejected", "satellite: grace period", 2), ("error", "e", 1), ("point", "", 1)}


def test_no_exchange_without_order(spark):
    plan = lambda chain: run_chain(frame(spark, points("t", [1.0, 2.0])), chain)._jdf.queryExecution().executedPlan().toString()
    alone = [s.QualityGate(), s.SpeedGate(), s.HeightRange(), s.StopMark()]
    for chain in ([], alone, *([x] for x in alone)):
        assert "Exchange" not in plan(chain) and "Window" not in plan(chain)
    assert plan([*alone, s.MovingAverage(3)]).count("Exchange ") == 1
    assert plan([s.StopMark(), g.Gates((g.HeightGate(),)), s.StopMark()]).count("Exchange ") == 1

    class Own:
        def apply(self, df):
            return df

    assert plan([Own()]).count("Exchange ") == 1  # a stage that promises nothing may need the order


def test_one_exchange_without_gates(spark):
    plan = lambda chain: run_chain(frame(spark, points("t", [1.0, 2.0])), chain)._jdf.queryExecution().executedPlan().toString()
    native = [x for x in stages(CHAIN) if not isinstance(x, g.Gates)]
    assert plan(native).count("Exchange ") == 1 and "Arrow" not in plan(native)
    assert plan(stages(CHAIN)).count("Exchange ") == 2 and plan(stages(CHAIN)).count("MapInArrow") == 1
    assert run_chain(frame(spark, points("t", [1.0])).limit(0), stages(Filters())).count() == 0
