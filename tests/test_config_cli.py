import json

import pytest

from trailforge import cli, config
from trailforge.operators import gates as g
from trailforge.operators import stages as s
from trailforge.plans.chain import stages


def test_defaults():
    c = config.loads("{}")
    assert c == config.Config() and c.filters.satellite == config.Satellite(True, 4, 4, 0) and not c.filters.lpf.enabled
    assert c.output.rotation == config.Rotation(1024, 5) and c.input == config.Input("auto", "", False)


def test_each_section_alone():
    given = {"satellite": {"min_satellites": 6}, "quality": {"enabled": True, "max_hdop": 3}, "speed": {"max_speed_kmh": 90}, "height": {"min_m": -5}, "jump": {"enabled": False}, "jump_suppress": {"max_wrong": 9}, "stop": {"threshold_kmh": 1}, "parking": {"speed_kmh": 7.5}, "lpf": {"type": "fir", "cutoff": 0.4}}
    for name, values in given.items():
        c = config.loads(json.dumps({"filters": {name: values}}))
        for k, v in values.items():
            assert getattr(getattr(c.filters, name), k) == v
        setattr(c.filters, name, getattr(config.Filters(), name))
        assert c == config.Config()
    assert config.loads('{"input": {"path": "x"}}').input == config.Input("auto", "x", False)


def test_nulls_and_unknown_keys():
    assert config.loads('{"filters": {"speed": {"max_speed_kmh": null}}, "more": 1}') == config.Config()
    for bad in ("{bad json}", "[1]", '{"output": {"rotation": {"max_files": null}}}', '{"filters": {"speed": {"enabled": 1}}}', '{"filters": {"satellite": {"min_satellites": 4.5}}}', '{"input": {"path": 3}}', '{"filters": 3}'):
        with pytest.raises(config.ConfigError):
            config.loads(bad)


def test_files(tmp_path):
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.json"))
    (tmp_path / "bom.json").write_bytes(b'\xef\xbb\xbf{"input": {"path": "p"}}')
    assert config.load(str(tmp_path / "bom.json")).input.path == "p"


def test_command_lines(tmp_path):
    c = cli.parse(["a.nmea"])
    assert c.filters.lpf == config.LowPass(True, "pif", 0.2) and c.input == config.Input("nmea", "a.nmea", False)
    assert cli.parse(["a.bin", "-cf", "1"]).filters.lpf.enabled is False and cli.parse(["a.bin"]).input.type == "binary"
    assert cli.parse(["-lpf", "fir", "-cf", "0.5", "x.BIN"]).input.type == "nmea"
    f = tmp_path / "c.json"
    f.write_text('{"input": {"type": "binary", "path": "there", "recursive": true}}')
    assert cli.parse(["--config", str(f)]).input == config.Input("binary", "there", True)
    # a path on the command line is never recursive, and overrides no type but auto
    assert cli.parse(["folder", "--config", str(f), "-cf", "0.3"]) == config.with_path(config.load(str(f)), "folder")
    assert cli.parse(["folder", "--config", str(f)]).input == config.Input("binary", "folder", False)
    for args, said in (([], ""), (["a", "b"], "unexpected argument 'b'"), (["--config"], "requires a file path"), (["a", "-lpf"], "pif or fir"), (["a", "-lpf", "x"], "got 'x'"), (["a", "-cf"], "numeric"), (["a", "-cf", "q"], "not a number"), (["a", "-cf", "0.001"], "[0.01, 1.0]"), (["a", "-z"], "unknown argument '-z'")):
        with pytest.raises(cli.UsageError) as e:
            cli.parse(args)
        assert said in str(e.value)
        assert cli.main(args) == 1
    assert cli.main(["--config", str(tmp_path / "none.json")]) == 1


def test_chain_order():
    f = config.Filters()
    for part in vars(f).values():
        part.enabled = True
    kinds = [type(x) for x in stages(f)]
    assert kinds == [s.SatelliteGate, s.QualityGate, s.SpeedGate, g.Gates, s.StopMark, s.ParkingFreeze, s.MovingAverage]
    assert [type(x) for x in stages(f)[3].gates] == [g.HeightGate, g.CoordinateJumpGate, g.JumpSuppressGate]
    f.lpf = config.LowPass(True, "fir", 0.2)
    assert stages(f)[-1] == s.LowPassFir(0.2)
    f.lpf = config.LowPass(True, "other", 0.25)
    assert stages(f)[-1] == s.MovingAverage(4)  # 3.544 rounds up
    f.lpf.cutoff = 1.0
    assert type(stages(f)[-1]) is s.ParkingFreeze
    f.lpf.cutoff = 0.0
    with pytest.raises(ValueError):
        stages(f)
