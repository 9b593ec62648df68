"""The command line over one small archive."""

import random

import pytest

from peakforge.__main__ import main, settings


def mgf(path, names, seed):
    r = random.Random(seed)
    for name in names:
        blocks = []
        for k in range(30):
            peaks = "\n".join(f"{m:.3f} {r.uniform(10, 99):.1f}" for m in sorted(r.uniform(200, 1900) for _ in range(20)))
            blocks.append(f"BEGIN IONS\nTITLE=t{k}\nPEPMASS=500.5\nCHARGE=2+\n{peaks}\nEND IONS\n")
        (path / name).write_text("".join(blocks))


def test_life_of_an_archive(spark, tmp_path, capsys, monkeypatch):
    data, at = tmp_path / "data", str(tmp_path / "archive")
    data.mkdir()
    mgf(data, ["a.mgf", "B.MGF"], 1)
    assert main([at, "init", str(data)], spark) == 0  # a new archive looks for raw data only
    assert "0 spectra added" in capsys.readouterr().out
    assert main([at, "add", str(data)], spark) == 0
    assert "60 spectra added, 60 in all" in capsys.readouterr().out
    assert main([at, "train", "--set", "index_strings=IVF2,PQ16x4", "--set", "seeds=1", "--set", "training_spectra=60"], spark) == 0
    assert "1 indexes" in capsys.readouterr().out
    (data / "x.spectroscape.tsv").write_text("filename\tscan\tmodpep\tcharge\na.mgf\t1\tPEPTIDE\t2\n")
    assert main([at, "update", str(data)], spark) == 0 and main([at, "summary"], spark) == 0
    assert "charge" in capsys.readouterr().out
    assert main([at, "repair"], spark) == 0 and "0 encoded, 0 without peaks" in capsys.readouterr().out
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert main([at, "remove", "1"], spark) == 1
    assert main([at, "remove", "1", "--yes"], spark) == 0
    assert main([at, "compact"], spark) == 0
    with pytest.raises(SystemExit):
        main([at, "init", str(data)], spark)
    from peakforge.plans.archive import Archive

    assert Archive(spark, at).size() == 30


def test_settings(tmp_path):
    (tmp_path / "s").write_text("# settings\ntopn=5\nremove_precursor=false\nseeds=3;4\n")
    given, stored = settings(["topn=7"], str(tmp_path / "s"))
    assert given == {"topn": 7} and stored == {"topn": 5, "remove_precursor": False, "seeds": (3, 4)}
