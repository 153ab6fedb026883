"""Per-year JSON, master documents, pretty twins, and combining from the JSON files."""

import json
from pathlib import Path

from meadowlark import report_queries
from meadowlark.operators import harvest, population
from meadowlark.plans import reports
from meadowlark.sources import sinks

DATA = "/root/testdata/sf0.001"


def _text(made) -> dict:
    return json.loads(Path(made.path).read_text())


def test_json_files_masters_and_the_way_back(spark, tmp_path):
    keep = "page_no = 3 OR page_no = 4 OR page_no = 6"
    h = harvest.parse_reports(report_queries.harvest_pages(spark, DATA).where(keep).where("file_ord % 2 = 1"))
    p = population.parse_reports(report_queries.population_pages(spark, DATA))
    h, p = harvest.Report(*[df.persist() for df in h]), population.Report(*[df.persist() for df in p])
    sinks.year_json(sinks.harvest_files(h), f"{tmp_path}/h", "harvest")
    sinks.year_json(sinks.population_files(p), f"{tmp_path}/p", "population")
    year = h.files.agg({"year": "min"}).first()[0]
    one = json.loads(Path(tmp_path, "h", f"elk_harvest_{year}.json").read_text())
    assert one["year"] == year and one["sections_parsed"] == 3 and [s["records"] for s in one["sections_detail"]][1:] == [8, 0]
    assert len(one["harvest_records"]) == 8 and len(one["dau_records"]) == one["sections_detail"][0]["records"]
    master = _text(sinks.document(sinks.harvest_master(h), f"{tmp_path}/hm"))
    assert master["years"] == sorted(r["year"] for r in h.files.collect()) and len(master["harvest_records"]) == h.records.count()
    pretty = _text(sinks.document(sinks.population_master(p), f"{tmp_path}/pmp", pretty=True))
    master = _text(sinks.document(sinks.population_master(p), f"{tmp_path}/pm"))
    assert master == pretty and master["years"] == sorted({2010, 2011, 2022, 2013, 2014})
    assert set(master["dau_gmu_mappings"]) == {f"{r['year']}_{r['dau']}" for r in p.records.collect() if r["gmus"]}
    assert {int(k): v for k, v in master["statewide_totals"].items()} == {r["year"]: r["statewide_total"] for r in p.totals.collect()}
    sizes = sinks.file_sizes(spark, f"{tmp_path}/pm").collect()
    assert sizes[0]["size"].endswith(" KB")
    tables = reports.combined_files(spark, f"{tmp_path}/h/*.json", f"{tmp_path}/p/*.json")
    assert tables.harvest.count() == h.records.count() and tables.population.count() == p.records.count() and tables.unit_summary.count() == h.unit_records.count()
    assert sorted(map(tuple, tables.population_trend.collect())) == sorted((r["year"], r["statewide_total"]) for r in p.totals.collect())


def test_documents_are_read_by_lines(spark, tmp_path):
    """Items of a document that several tasks read, whatever its size, with their places; half a document is an error."""
    import pytest

    from meadowlark.sources import json_files

    h = harvest.parse_reports(report_queries.harvest_pages(spark, DATA).where("page_no = 3 OR page_no = 4"))
    path = sinks.document(sinks.harvest_master(h), f"{tmp_path}/h.json").path
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 1
        found = json_files.numbered(json_files.read_items(spark, path)).collect()
        Path(tmp_path, "half.json").write_text(Path(path).read_text()[:5000])
        with pytest.raises(Exception, match="not whole"):
            json_files.read_items(spark, f"{tmp_path}/half.json").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = json.loads(Path(path).read_text())
    for name in ("years", "harvest_records", "dau_records"):
        rows = sorted((r for r in found if r["path"] == name), key=lambda r: r["pos"])
        assert [r["pos"] for r in rows] == list(range(len(rows))) and [r["led"] for r in rows] == [k > 0 for k in range(len(rows))]
        assert [json.loads(r["value"]) for r in rows] == whole[name]


def test_year_files_are_written_and_read_by_items(spark, tmp_path):
    """No row holds a report's list: each item is a piece, several tasks read a file, and its bytes are those of one dump."""
    from meadowlark.sources import json_files

    h = harvest.parse_reports(report_queries.harvest_pages(spark, DATA))
    pieces = sinks.harvest_files(h).collect()
    assert len(pieces) > h.records.count() and max(len(r["piece"]) for r in pieces) < 1000
    sinks.year_json(sinks.harvest_files(h), f"{tmp_path}/h", "harvest")
    for path in Path(tmp_path, "h").iterdir():
        assert path.read_text() == json.dumps(json.loads(path.read_text()), indent=2)
    expected = [(f, k, r["gmu"]) for f, path in enumerate(sorted(Path(tmp_path, "h").iterdir())) for k, r in enumerate(json.loads(path.read_text())["harvest_records"])]
    first = sorted(Path(tmp_path, "h").iterdir())[0]
    first.write_text(json.dumps(json.loads(first.read_text())))  # not indented: read whole
    Path(tmp_path, "h", "x.json").write_text('{\n  "harvest_records": [\n    {\n      "year": 2000\n    }\n  ]\n}')  # no year
    Path(tmp_path, "h", "y.json").write_text('{\n  "year": 2031,\n  "a": {"b": [\n    {\n      "c": 1\n    }\n  ]}, "harvest_records": [{"gmu": 7},\n    {\n      "gmu": 8\n    }\n  ]\n}')  # indented in parts
    expected += [(7, 0, 7), (7, 1, 8)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = json_files.read_items_of(spark, f"{tmp_path}/h/*.json", json_files.HARVEST_FILE)
        rows = json_files.records_of(found, "harvest_records").orderBy("file_ord", "page_no", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["file_ord"], r["gmu"]) for r in rows] == [(f, gmu) for f, _, gmu in expected]
    assert len({r["page_no"] for r in rows}) > 1 and {r["sections_parsed"] for r in found.files.collect()} == {4, None}
