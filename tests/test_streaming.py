import random

import pytest

from tests.tracks import frame, wild
from trailforge.operators import stages as s
from trailforge.plans.chain import run_chain, stages
from trailforge.plans.queries import CHAIN
from trailforge.schema import RECORD
from trailforge.streaming.live import run_live


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    rng = random.Random(3)
    rows = [r for k in range(3) for r in wild(rng, f"t{k}", 60)]
    chain = stages(CHAIN)
    for part in range(3):  # three files, three micro-batches
        frame(spark, [r for r in rows if r[2] // 20 == part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run_live(stream, chain).writeStream.format("memory").queryName("live").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.track_id, r.rec_idx): r for r in spark.table("live").collect()}
    want = run_chain(frame(spark, rows), chain).collect()
    assert len(got) == len(want)
    for w in want:
        r = got[w.track_id, w.rec_idx]
        assert (r.reason, r.error) == (w.reason, w.error)
        for c in s.SMOOTHED:
            assert (float("nan") if r[c] is None else r[c]) == pytest.approx(w[c], abs=1e-6, nan_ok=True)  # pandas has no null of its own
