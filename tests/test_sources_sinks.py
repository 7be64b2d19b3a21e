import io
import os
import struct

import pytest

from tests.tracks import F1, frame, gga, points, record, rmc, sentence
from trailforge import cli, config
from trailforge.plans.chain import run_chain, stages
from trailforge.sinks.logs import RotatingLog, to_console, to_rotating_log, to_table, to_text
from trailforge.sources import binary
from trailforge.sources.files import format_of, list_files, read_files, read_path, whole_lines, whole_records

EXPECTED = """[12:00:00] Coordinates: 55.75206°N, 37.65946°E
           Speed: 46.3 km/h, Course: 45.0°
           Altitude: 150.0 m, Satellites: 10, HDOP: 0.8
[12:00:01] Coordinates: 55.75206°N, 37.65946°E
           Speed: 2.2 km/h (stopped), Course: 45.0°
           Altitude: 150.0 m, Satellites: 10, HDOP: 0.8
[12:00:02] Point rejected: coordinate jump detected (1893.0 m > 500.0 m)
[12:00:03] Point rejected: insufficient satellites (3 < 4)
[12:00:04] No valid GPS fix
[12:00:05] Parse error: invalid checksum
"""


def written(spark, settings):
    out = io.StringIO()
    to_console(cli.process(spark, settings), out)
    return out.getvalue()


def of(spark, tmp_path, *files, kind="auto"):
    """Records of files with the given texts or bytes."""
    paths = []
    for k, content in enumerate(files):
        p = tmp_path / f"{k}.{'bin' if isinstance(content, bytes) else 'nmea'}"
        p.write_bytes(content if isinstance(content, bytes) else "\n".join(content).encode())
        paths.append(str(p))
    return read_files(spark, paths, kind).orderBy("file_idx", "rec_idx").collect()


def test_six_cases(spark, tmp_path):
    p = tmp_path / "f1.nmea"
    p.write_text(F1)
    assert written(spark, config.with_path(config.Config(), str(p))) == EXPECTED
    # without a file of settings, smoothing is on
    assert "Speed: 35.3 km/h (stopped)" in written(spark, cli.parse([str(p)]))
    assert "Speed: 46.4 km/h (stopped)" in written(spark, cli.parse([str(p), "-lpf", "fir", "-cf", "0.15"]))


def test_pairing(spark, tmp_path):
    t0, t1 = {"time": "120000"}, {"time": "120001"}
    cases = [
        ([rmc(), gga()], ["120000"]), ([gga(), rmc()], ["120000"]), ([rmc()], []), ([gga()], []), ([rmc(**t0), gga(**t1)], []),
        ([rmc(**t0), rmc(**t1), gga(**t0), gga(**t1)], ["120001"]), ([rmc(**t0), gga(**t1), rmc(**t1)], ["120001"]), ([rmc(), gga(), gga()], ["120000"]),
        ([rmc(), rmc(status="V"), gga()], [None, "120000"]), ([rmc(time="120000"), gga(time="120000.00")], []), ([rmc(status="X"), gga()], []),
        ([rmc().replace("GPRMC", "GNRMC"), gga()], [None]), ([sentence("GNRMC,1"), gga()], []), (["", "#x", "junk", "$"], [None]),
        ([rmc(speed="12abc"), gga()], ["120000"]), ([rmc(speed="abc"), gga()], []), ([rmc() + "\r", gga() + "\r"], ["120000"]), ([rmc(lat="45.1,N"), gga()], []),
    ]
    found = {}
    for r in of(spark, tmp_path, *(lines for lines, _ in cases)):
        found.setdefault(r.file_idx, []).append(r.time)
    assert [found.get(k, []) for k in range(len(cases))] == [want for _, want in cases]


def test_fields(spark, tmp_path):
    (r,) = of(spark, tmp_path, [rmc(speed="", course=""), gga(sats="", hdop="", alt="")])
    assert (r.speed_kmh, r.course, r.satellites, r.hdop, r.altitude, r.stopped) == (0.0, 0.0, 0, 0.0, 0.0, False)
    (r,) = of(spark, tmp_path, [rmc(lat="5545.1234,S", lon="03739.5678,W"), gga()])
    assert (round(r.lat, 6), round(r.lon, 6)) == (-55.752057, -37.659463)
    (r,) = of(spark, tmp_path, [rmc(lat="554,S"), gga()])
    assert r.lat == 0.0


def test_bytes_that_are_no_text(spark, tmp_path):
    body = b"GPRMC,120000,A,5545.1234,N,03739.5678,E,025.0,045.0,270124,\xff\xfe,,A"
    odd = b"$" + body + b"*%02X" % __import__("functools").reduce(int.__xor__, body)
    (tmp_path / "0.nmea").write_bytes(b"\xff\n# \xd0\n" + odd + b"\n" + gga().encode() + b"\n$GPRMC,\xff12345\xff,*00\n")
    rows = read_files(spark, [str(tmp_path / "0.nmea")]).orderBy("rec_idx").collect()
    assert [(r.rec_idx, r.time, r.error) for r in rows] == [(3, "120000", None), (4, None, "[?1:23:45] Parse error: invalid checksum")]


def test_satellites_in_view(spark, tmp_path):
    a = "$GPGSV,2,1,05,07,84,069,43,17,49,161,43,15,47,270,43,18,36,314,44*79"
    b = "$GPGSV,2,2,05,08,20,296,37*4F"
    view = lambda *lines: [[tuple(v) for v in r.satellites_in_view] for r in of(spark, tmp_path, [*lines])]
    got = view(a, b, rmc(), gga(), rmc(time="120001"), gga(time="120001"))
    assert len(got[0]) == 5 and got[0][0] == (7, 84, 69, 43) and got[0][4] == (8, 20, 296, 37) and got[1] == []
    cut = sentence("GPGSV,1,1,02,07,84,069,43,08,20,296,")
    assert view(cut, rmc(), gga()) == [[(7, 84, 69, 43)]]
    other = sentence("GPGSV,3,2,09,08,20,296,37")
    assert view(a, other, rmc(), gga())[0] == got[0][:4]
    odd = sentence("GPGSV,1,1,03,07,84,069,43,x,1,1,1,09,1,1,1")
    assert view(odd, rmc(), gga()) == [[(7, 84, 69, 43)]]
    assert view(sentence("GPGSV,1,1,03,07,,069,43,,1,1,1,09,1,1,1"), rmc(), gga()) == [[(7, 0, 69, 43)]]


def test_binary_records(spark, tmp_path):
    good = record(signal={0: 43 | 128, 1: 40, 64: 35, 95: 35, 2: 128})
    rows = of(spark, tmp_path, good + record(height=-15, lon=-37659463) + b"x" * 50, record(1) + record(2) + record(3) + record(255) + record(9), b"x" * 195, b"")
    a, b = rows[:2]
    assert (a.lat, a.lon, a.altitude, a.speed_kmh, a.course, a.hdop, a.satellites, a.time) == (55.752057, 37.659463, 150.0, 46.3, 45.0, 0.8, 10, "120000")
    assert [tuple(v) for v in a.satellites_in_view] == [(1, 0, 0, 43), (2, 0, 0, 40), (-1, 0, 0, 35), (-32, 0, 0, 35)]
    assert (b.altitude, b.lon, b.satellites_in_view) == (-15.0, -37.659463, [])
    assert [r.error for r in rows[2:]] == ["[12:00:00] " + x for x in ("Receiver error", "Cell-tower position (LBS)", "External location source (EL)", "Last-known position (boot state)", "No valid GPS fix")]
    assert all(r.lat is None for r in rows[2:]) and len(rows) == 7
    raw = bytearray(os.urandom(196))
    df = spark.createDataFrame([(bytes(raw),), (bytes(raw[:-1]),)], "rec binary")
    full, short = binary.decode_all(df).collect()
    codes = {"u8": "B", "u16": "H", "u32": "I", "u64": "Q", "i16": "h", "i32": "i", "f32": "f"}
    for name, at, kind in binary.LAYOUT:
        want = struct.unpack_from("<" + codes[kind], raw, at)[0]
        got = full[name]
        assert (got != got and want != want) or got == want, name
    assert short.latitude is None


def test_parts_of_any_size_give_the_same_rows(spark, tmp_path):
    import random

    rng = random.Random(3)
    lines = []
    for k in range(120):
        said = [rmc(time=f"{k:06d}"), gga(time=f"{k + (k % 7 == 0):06d}"), "$GPGSV,2,1,05,07,84,069,43,17,49,161,43,15,47,270,43,18,36,314,44*79", rmc(status="V"), "", "# " + "x" * rng.randint(0, 300), rmc() + "0", "\xe9" * 5]
        lines += rng.sample(said[:2], 2) + rng.sample(said[2:], rng.randint(0, 4))
    (tmp_path / "a.nmea").write_bytes("\n".join(lines).encode("latin-1"))
    (tmp_path / "b.nmea").write_bytes(("\n".join(lines[:50]) + "\n").encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"".join(record(k % 3, height=k) for k in range(50)) + b"x" * 99)
    (tmp_path / "d.bin").write_bytes(b"")
    (tmp_path / "_e.nmea").write_bytes(b"")
    paths = list_files(str(tmp_path))
    want = sorted(map(repr, read_files(spark, paths).collect()))
    assert len(want) > 150
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for size in (1, 400, 2000):
            assert sorted(map(repr, read_files(spark, paths, size=size).collect())) == want, size
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    store = [f"file:{p}" for p in paths]  # hidden names of a store too
    assert sorted(map(repr, read_files(spark, store, size=400).collect())) == want


def test_lines_read_together_are_lines_read_alone():
    import random

    import pyarrow as pa

    from trailforge.functions import lines as L
    from trailforge.functions import sentence as S

    rng = random.Random(1)
    some = [
        rmc(), gga(), rmc(speed="", course=""), gga(sats="", hdop="", alt=""), rmc(lat="5545.1234,S", lon="03739.5678,W"), rmc(lat="554,S"), rmc(speed="12abc"), rmc(status="V"), sentence("GNRMC,1"), "$GPRMC,1", "$", "$*00",
        "$GPGSV,2,1,05,07,84,069,43,17,49,161,43,15,47,270,43,18,36,314,44*79", sentence("GPGSV,1,1,03,07,84,069,43,x,1,1,1,09,1,1,1"), sentence("GPGSV,1,1,03,07,,069,43,,1,1,1,09,1,1,1"), sentence("GPGSV,1,1,02,07,84,069,43,08,20,296,"),
        sentence("GPGSV,1"), rmc() + "\r", sentence("GPRMCX,1,V,"), sentence("GPRMC,1,V"), "$GPRMC,é*00", sentence("GPGGA,120000,5545.1,N,03739.5,E,1,1e1,+5,-15.5,M"), "$GPGGA," + "1" * 300 + "*4E", sentence("GPTXT,01"),
    ]

    def changed(x):
        x = list(x)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(1, len(x)) if len(x) > 1 else 1
            x[k : k + rng.randint(0, 1)] = rng.choice(["", *"0123456789,.*AVNSWE+-eé "])
        x = "".join(x)
        star = x.find("*")
        return x[: star + 1] + f"{S.checksum(x):02X}" + x[star + 3 :] if star > 0 and rng.random() < 0.8 else x

    some += [changed(rng.choice(some)) for _ in range(8000)]
    at, columns = L.read(pa.array([x.encode() for x in some], pa.binary()))
    got = {k: {n: c[i].as_py() for n, c in zip(L.COLUMNS, columns, strict=True)} for i, k in enumerate(at.tolist())}
    for k, line in enumerate(some):
        e, r, g, v = S.read(line)
        want = {"error": e, "kind": L.ERROR} if e is not None else r | {"kind": L.RMC} if r else g | {"kind": L.GGA} if g else v | {"kind": L.GSV} if v else None
        assert repr(got.get(k)) == repr(want and {c: want.get(c) for c in L.COLUMNS}), line


def test_listing(tmp_path):
    for p in ("a.bin", "a/b.bin", "a/a.bin", "_h.bin", ".g.bin", "x.BIN", "260317/16/56.bin", "260317/15/01.bin"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"")
    at = str(tmp_path)
    rel = [os.path.relpath(p, at) for p in list_files(at, True)]
    assert rel == [".g.bin", "260317/15/01.bin", "260317/16/56.bin", "_h.bin", "a/a.bin", "a/b.bin", "a.bin", "x.BIN"]
    assert [os.path.relpath(p, at) for p in list_files(at)] == [".g.bin", "_h.bin", "a.bin", "x.BIN"]
    assert list_files(at + "/none") == [] and list_files(at + "/a.bin") == [at + "/a.bin"]
    assert [format_of(p) for p in ("a.bin", "a.BIN", "b")] == ["binary", "nmea", "nmea"] and format_of("a.bin", "nmea") == "nmea" and format_of("a", "odd") == "nmea"


def test_files_make_one_track(spark, tmp_path):
    (tmp_path / "_1.bin").write_bytes(record())
    (tmp_path / "b.nmea").write_text("\n".join([rmc(), gga(time="120009")]))
    (tmp_path / "c.nmea").write_text("\n".join([gga(), rmc(lat="5945.0,N", time="120009"), gga(time="120009"), "$x*00"]))
    got = read_path(spark, str(tmp_path))
    assert [(r.file_idx, r.rec_idx, r.error) for r in got.orderBy("file_idx", "rec_idx").collect()] == [(0, 0, None), (2, 2, None), (2, 3, "[??:??:??] Parse error: invalid checksum")]
    done = run_chain(got, stages(config.Filters())).orderBy("file_idx", "rec_idx").collect()
    assert done[1].reason.startswith("coordinate jump")  # compared with a point of another file
    assert read_path(spark, str(tmp_path / "none")).count() == 0 and written(spark, config.with_path(config.Config(), str(tmp_path / "none"))) == ""


def test_any_store_and_odd_names(spark, tmp_path):
    from pyspark.sql import functions as F

    for name in ("d1/a b.bin", "d1/[x]{1}.bin", "d2/q?.nmea", "d2/sub/z.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(record() if name.endswith("bin") else "\n".join([rmc(), gga()]).encode())
    local, store = read_path(spark, str(tmp_path), recursive=True), read_path(spark, f"file://{tmp_path}", recursive=True)
    key = lambda df: sorted((r.file_idx, r.rec_idx, r.time) for r in df.collect())
    assert key(local) == key(store) == [(0, 0, "120000"), (1, 0, "120000"), (2, 1, "120000"), (3, 0, "120000")]
    assert read_path(spark, f"file://{tmp_path}/none").count() == 0 and len(list_files(f"file://{tmp_path}/d2", False, spark)) == 1
    tracks = read_path(spark, str(tmp_path), recursive=True, track_id=F.regexp_extract("path", "/(d[0-9])/", 1))
    assert {(r.track_id, r["count"]) for r in tracks.groupBy("track_id").count().collect()} == {("d1", 2), ("d2", 2)}


def test_rotation(tmp_path):
    path = str(tmp_path / "x.log")
    log = RotatingLog(path, 1, 2)
    for k in range(60):
        log.write(f"{k:02d}" + "x" * 97)
    log.close()
    assert sorted(os.listdir(tmp_path)) == ["x.log", "x.log.1", "x.log.2"]
    assert all(os.path.getsize(f"{path}.{k}") == 1100 for k in (1, 2))
    assert open(path + ".1").read().startswith("44") and open(path).read().startswith("55")
    log = RotatingLog(path, 0, 5)  # appends, and never turns over
    for _ in range(40):
        log.write("y" * 99)
    log.close()
    assert os.path.getsize(path) == 500 + 4000 and not os.path.exists(path + ".3")
    for keep in (0, -1):
        p = str(tmp_path / f"all{keep}.log")
        log = RotatingLog(p, 1, keep)
        for _ in range(80):
            log.write("z" * 99)
        log.close()
        assert all(os.path.exists(f"{p}.{k}") for k in range(1, 8))
    gap = str(tmp_path / "gap.log")
    for k in (1, 3, 4, 5):
        (tmp_path / f"gap.log.{k}").write_text(str(k))
    for keep, want in ((4, {1: "n", 2: "1", 4: "3", 5: "5"}), (0, {1: "m", 2: "n", 3: "1", 5: "3", 6: "5"})):
        log = RotatingLog(gap, 1, keep)
        log.write("nm"[keep == 0] * 1100)
        log.close()
        assert {k: open(f"{gap}.{k}").read()[:1] for k in range(1, 9) if os.path.exists(f"{gap}.{k}")} == want
    with pytest.raises(OSError):
        RotatingLog(str(tmp_path / "no" / "x.log"))


def test_outputs(spark, tmp_path):
    rows = points("t", [5.0], lat=-33.8688, lon=-70.6693, time="12", satellites_in_view=[[(7, 84, 69, 43), (17, 49, 161, 43)]])
    done = run_chain(frame(spark, rows), [])
    out = io.StringIO()
    to_console(done, out)
    assert out.getvalue() == "[??:??:??] Coordinates: 33.86880°S, 70.66930°W\n           Speed: 5.0 km/h, Course: 1.0°\n           Altitude: 100.0 m, Satellites: 10, HDOP: 1.0\n           In view (2):  PRN7 el=84° az=69° snr=43  PRN17 el=49° az=161° snr=43\n"
    to_text(done, str(tmp_path / "text"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) + "\n" == out.getvalue()
    to_table(done, str(tmp_path / "table"), ["track_id"])
    assert spark.read.parquet(str(tmp_path / "table")).first().lat == -33.8688
    to_rotating_log(done, RotatingLog(str(tmp_path / "one.log")))
    assert (tmp_path / "one.log").read_text() == out.getvalue()


def test_command_line_runs(spark, tmp_path, capsys):
    p = tmp_path / "f1.nmea"
    p.write_text(F1)
    settings = tmp_path / "c.json"
    settings.write_text('{"output": {"type": "file", "path": "%s"}}' % (tmp_path / "o.log"))
    cli.run(spark, cli.parse([str(p), "--config", str(settings)]))
    assert (tmp_path / "o.log").read_text() == EXPECTED
    cli.run(spark, cli.parse([str(p), "-cf", "1"]))
    assert capsys.readouterr().out == EXPECTED


def peaks(mark):
    """MB that processes with mark in their environment had at most so far."""
    found = []
    for p in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{p}/environ", "rb") as f, open(f"/proc/{p}/status") as g:
                if mark.encode() in f.read():
                    found += [int(x.split()[1]) / 1024 for x in g if x.startswith("VmHWM:")]
        except OSError:  # it has ended, or is another's
            pass
    return found


def test_memory_does_not_follow_the_size_of_a_part(spark, tmp_path, monkeypatch):
    text = "\n".join(f"{rmc(time=f'{k:06d}')}\n{gga(time=f'{k:06d}')}" for k in range(5000)).encode() + b"\n"
    (tmp_path / "a.nmea").write_bytes(text * 32)  # some 22 MB, one part
    (tmp_path / "b.bin").write_bytes(record() * 110_000)
    monkeypatch.setitem(spark.sparkContext.environment, "MARK", tmp_path.name)  # workers that no other test used
    rows = read_path(spark, str(tmp_path)).groupBy("file_idx").count().collect()
    assert {(r.file_idx, r["count"]) for r in rows} == {(0, 160_000), (1, 110_000)}
    assert max(peaks(f"MARK={tmp_path.name}")) < 300


def test_pieces_are_whole_and_none_is_lost():
    import random

    rng = random.Random(5)
    for last in (b"", b"\n"):
        text = b"\n".join(bytes(rng.choices(b"ab", k=rng.choice((0, 1, 5, 40)))) for _ in range(60)) + last
        for part in (1, 7, 50, len(text)):
            for size in (1, 3, 30, len(text) + 1):
                made = [x for start in range(0, len(text), part) for x in whole_lines(io.BytesIO(text), start, min(len(text), start + part), size)]
                assert b"".join(c for _, c in made) == text and len({at for at, _ in made}) == len(made)
                assert all(text[at : at + len(c)] == c and (c.endswith(b"\n") or at + len(c) == len(text)) and (not at or text[at - 1 : at] == b"\n") for at, c in made)
                assert all(at < start + part and len(c) < size + 42 for start in range(0, len(text), part) for at, c in whole_lines(io.BytesIO(text), start, min(len(text), start + part), size))
    records = bytes(range(196)) * 25 + b"x" * 9
    made = [x for start in range(0, len(records), 196 * 4) for x in whole_records(io.BytesIO(records), start, min(len(records), start + 196 * 4), 196 * 3)]
    assert b"".join(c for _, c in made) == records and all(at % 196 == 0 for at, _ in made)
