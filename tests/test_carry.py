"""Passes on workers that have none of this repository's modules, or others of the same name."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle

import __spark_entry__ as entry
from trailforge.carry import carried
from trailforge.functions import sentence
from trailforge.functions.lines import stars
from trailforge.plans import queries as tracks


def passes():
    def run(batches):
        for batch in batches:
            yield sentence.checksum("$A*"), stars(batch)[1].tolist()

    return run


@pytest.mark.parametrize("stale", [False, True])
def test_a_pass_brings_its_modules(tmp_path, stale):
    lines = pa.array([b"$A*00", b"$A*41"])
    before = "import sys, pickle"
    if stale:  # as a reused worker may have them, by an archive or a path
        for name in ("trailforge", "trailforge/functions"):
            (tmp_path / name).mkdir()
            (tmp_path / name / "__init__.py").write_text("")
        (tmp_path / "trailforge/functions/sentence.py").write_text("checksum = None")
        before += "; import trailforge.functions.sentence"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != here]
    (tmp_path / "pass").write_bytes(cloudpickle.dumps((carried(passes()), lines)))
    code = f"{before}; run, lines = pickle.load(open('pass', 'rb')); print(next(run([lines]))); import trailforge.functions.lines as x; print(x.__spec__.origin)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(paths)})
    assert said.stdout.splitlines() == ["(65, [False, True])", "carried trailforge.functions.lines"], said.stderr


def test_track_queries_give_nothing_to_the_application(spark, monkeypatch):
    """What addPyFile registers is fetched by every later task of the application, also of native queries, and can fail them all."""
    monkeypatch.setattr(entry, "_shipped", lambda context: pytest.fail("track queries need no archive"))
    for name in tracks.queries():
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").columns
