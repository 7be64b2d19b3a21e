"""The driver's contract on its smallest tables, against the SQL."""

import os
import zipfile

import duckdb
import pytest

import __spark_entry__ as entry
from trailforge.plans import queries as tracks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(tracks.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = tracks.queries()[name](spark, SF)
    made = duck.sql(tracks.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(made.columns)
    order = [made.columns.index(c) for c in columns]
    want = sorted(repr(tuple(r[k] for k in order)) for r in made.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_the_archive_holds_the_modules(tmp_path):
    import subprocess
    import sys

    path = entry.package(str(tmp_path))
    code = "import trailforge.plans.queries as q; print(q.__file__, len(q.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": path})
    assert said.stdout.split() == [os.path.join(path, "trailforge/plans/queries.py"), str(len(tracks.queries()))], said.stderr


def test_every_reason_occurs(spark):
    reasons = {(r.reason or "passed").split(" (")[0] for r in tracks.full_chain(spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert reasons == {
        "passed", "satellite: grace period", "insufficient satellites", "quality: HDOP too high", "quality: insufficient usable satellites", "speed too high",
        "height: below minimum", "height: above maximum", "height: altitude jump", "coordinate jump detected", "jump_suppress: velocity jump", "jump_suppress: excessive acceleration",
    }


def test_rest_stands_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "spark-warehouse", "__pycache__", ".pytest_cache"))
    run = lambda *a: subprocess.run([sys.executable, *a], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    said = run("-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))")
    assert said.stdout.split() == [str(len(tracks.queries())), "False"], said.stderr
    said = run("-m", "pytest", "-x", "-q", "tests/test_functions.py", "tests/test_config_cli.py", "tests/test_entry.py::test_query_matches_sql[speed_filter]")
    assert said.returncode == 0, said.stdout[-2000:]


def test_the_archive_stays_for_executors_that_come_later():
    class Context:
        master, given = "spark://elsewhere:7077", ()

        def addPyFile(self, path):  # noqa: N802
            self.given = (*self.given, path)

    context = Context()
    entry._shipped(context)
    (path,) = context.given  # Spark serves it from there when an executor's first task asks for it
    with zipfile.ZipFile(path) as archive:
        assert "trailforge/plans/queries.py" in archive.namelist()


def test_a_module_loaded_again_gives_its_archive_another_name():
    import importlib.util

    class Context:
        master = "spark://elsewhere:7077"

        def __init__(self):
            self.given = {}

        def addPyFile(self, path):  # noqa: N802
            assert self.given.setdefault(os.path.basename(path), path) == path, "already registered with a different path"  # as Spark does
            assert path == os.path.realpath(path)

    context = Context()
    for _ in range(2):
        spec = importlib.util.spec_from_file_location("entry_again", entry.__file__)
        again = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(again)
        again._shipped(context)
    assert len(context.given) == 2


def test_the_archive_stays_when_temporary_folders_are_cleared(tmp_path, monkeypatch):
    import shutil
    import tempfile
    from types import SimpleNamespace

    (tmp_path / "spark").mkdir()
    (tmp_path / "temp").mkdir()
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path / "temp"))
    files = SimpleNamespace(getRootDirectory=lambda: str(tmp_path / "spark"))
    given = []

    class Context:
        master, addPyFile = "spark://elsewhere:7077", given.append  # noqa: N815
        _jvm = SimpleNamespace(org=SimpleNamespace(apache=SimpleNamespace(spark=SimpleNamespace(SparkFiles=files))))

    entry._shipped(Context())
    shutil.rmtree(tmp_path / "temp")
    with zipfile.ZipFile(*given) as archive:
        assert "trailforge/plans/queries.py" in archive.namelist()


def test_the_driver_imports_nothing_from_the_archive(tmp_path, monkeypatch):
    import sys

    class Context:
        master = "spark://elsewhere:7077"

        def addPyFile(self, path):  # noqa: N802
            sys.path.insert(1, str(tmp_path / os.path.basename(path)))  # as PySpark does; Spark deletes that file when the application ends

    before = [*sys.path]
    monkeypatch.setattr(sys, "path", [*before])
    entry._shipped(Context())
    assert sys.path == before
