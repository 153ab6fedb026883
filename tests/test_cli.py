import json
import zipfile

import pytest

from meadowlark import __main__ as cli

TITLE = "{} Elk Recreation Days for All Manners\n"


def text(year, *rows):
    return TITLE.format(year) + "\n".join(rows)


def test_reports_end_to_end(spark, tmp_path, capsys):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.txt").write_text(text(2020, "1 1 1 1 3 6 50 30"))
    cli.main(["--harvest-dir", str(tmp_path / "h"), "--population-dir", str(tmp_path / "none"), "-o", str(tmp_path / "out")])
    full = json.loads((tmp_path / "out/elk_combined.json").read_text())
    assert full["harvest"][0]["total_harvest"] == 3 and full["population"] == []
    assert json.loads((tmp_path / "out/elk_combined_pretty.json").read_text()) == full
    said = capsys.readouterr().out
    assert f"Wrote: {tmp_path}/out/elk_combined.json ({(tmp_path / 'out/elk_combined.json').stat().st_size / 1e3:.0f} KB)" in said
    assert "harvest: 1\n" in said and "Population years: 0" in said and "Latest harvest (2020): 3 (6 hunters)" in said
    with pytest.raises(SystemExit):
        cli.main(["--harvest-dir", str(tmp_path / "x"), "--population-dir", str(tmp_path / "y")])


def test_from_page_text_to_json_to_documents(spark, tmp_path, capsys):
    """The three commands in a row: files by name, in the order given, then combined from the JSON folders."""
    (tmp_path / "b 1.txt").write_text(text(2020, "7 1 1 1 3 6 50 30"))
    (tmp_path / "a.txt").write_text(text(2021, "1 1,000 1 1 1,002 6 50 30", '2 1 1 1 3 6 50 30'))
    (tmp_path / "bad.txt").write_text("no year\n1 2 3")
    (tmp_path / "p.txt").write_text("2021 POST HUNT\nBull/Cow\n2 Bears Ears 3, 4 1,000 30\n9 None 0 20\nTotal Statewide Estimate 1,000")
    h, p, out = (str(tmp_path / x) for x in ("out h", "p", "combined"))
    cli.main(["harvest", *(str(tmp_path / n) for n in ("b 1.txt", "notes.md", "a.txt", "bad.txt")), h])
    said = capsys.readouterr().out
    assert "bad.txt: no year" in said and "Done. Processed 2 file(s)." in said
    assert sorted(f.name for f in (tmp_path / "out h").iterdir()) == ["elk_harvest_2020.csv", "elk_harvest_2020.json", "elk_harvest_2021.csv", "elk_harvest_2021.json", "elk_harvest_combined.json"]
    assert (tmp_path / "out h/elk_harvest_2021.csv").read_bytes().split(b"\r\n")[1].startswith(b"2021,elk,1,all,all,,1000,1,1,1002,6,50,30,,")
    one = (tmp_path / "out h/elk_harvest_2021.json").read_text()
    assert one.startswith('{\n  "year": 2021,\n  "species": "elk",\n') and [r["gmu"] for r in json.loads(one)["harvest_records"]] == [1, 2]
    master = json.loads((tmp_path / "out h/elk_harvest_combined.json").read_text())
    assert master["years"] == [2020, 2021] and [r["gmu"] for r in master["harvest_records"]] == [7, 1, 2]  # in the order of the arguments
    cli.main(["population", str(tmp_path / "p.txt"), p])
    assert json.loads((tmp_path / "p/elk_population_combined.json").read_text())["dau_gmu_mappings"] == {"2021_E-2": {"year": 2021, "dau": "E-2", "gmus": [3, 4]}}
    assert (tmp_path / "p/dau_gmu_mapping_2021.csv").read_text() == "year,dau,gmu\n2021,E-2,3\n2021,E-2,4\n"
    cli.main(["combine", "--harvest-dir", h, "--population-dir", p, "-o", out])
    said = capsys.readouterr().out
    full = json.loads((tmp_path / "combined/elk_combined.json").read_text())
    assert full["metadata"]["record_counts"] == {"harvest": 3, "dau_harvest_summary": 0, "population": 2, "dau_definitions": 2}
    assert full["metadata"]["harvest_years"] == [2020, 2021] and full["gmu_to_dau"] == {"3": "E-2", "4": "E-2"}
    assert "gmu_history" not in full["dau_definitions"]["E-2"] and full["dau_definitions"]["E-9"]["gmu_history"] == {}
    assert "Years: 2020-2021" in said and "Latest population (2021): 1,000" in said
    with pytest.raises(SystemExit):
        cli.main(["combine", "--harvest-dir", out, "--population-dir", out, "-o", out])


def test_extract(spark, tmp_path, capsys):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/Elk Harvest.pdf", "one")
        z.writestr("deer.pdf", "d")
    (tmp_path / "b.zip").write_bytes(b"none")
    cli.main(["extract", str(tmp_path), "-o", str(tmp_path / "out")])
    said = capsys.readouterr().out
    assert "harvest_reports: 1" in said and "skipped: 1" in said and "b.zip" in said
    assert (tmp_path / "out/harvest_reports/Elk Harvest.pdf").read_text() == "one"


def test_arguments():
    assert cli.split_arguments(["a.txt", "b.TXT", "c.pdf", "out"]) == (["a.txt", "b.TXT"], "out")
    assert cli.split_arguments(["a.txt"]) == (["a.txt"], ".")
