from tickloom import cli
from tickloom.sources import wire_v5


def test_commands(spark, workload, tmp_path, capsys):
    path, other = str(tmp_path / "p.out"), str(tmp_path / "q.out")
    with open(path, "wb") as f:
        f.write(wire_v5.encode(workload))
    assert cli.main(["verify", path]) == 0 and "complete: True" in capsys.readouterr().out
    assert cli.main(["report", path]) == 0 and "main::leaf  returns=15" in capsys.readouterr().out
    assert cli.main(["dump", path]) == 0 and capsys.readouterr().out.rstrip().endswith('"tag":"_END"}')
    assert cli.main(["query", path]) == 0 and "main::leaf returns=15" in capsys.readouterr().out
    assert cli.main(["query", path, "--json"]) == 0 and '"main::leaf": 15' in capsys.readouterr().out
    assert cli.main(["convert", path, "--to", "v6", "--out", other]) == 1  # fractional times
    assert cli.main(["convert", path, "--to", "v6", "--lossy", "--out", other]) == 0
    assert cli.main(["compare", path, other]) == 1
    assert cli.main(["merge", path, path, "--by-name", "--to", "v5", "--out", other]) == 0
    raw = wire_v5.encode(workload)
    with open(path, "wb") as f:
        f.write(raw[: len(raw) // 2])
    assert cli.main(["salvage", path, "--out", other]) == 0 and cli.main(["verify", other]) == 1
    capsys.readouterr()
    assert cli.main(["doctor"]) == 0 and "variant: ok" in capsys.readouterr().out
