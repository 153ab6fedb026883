import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from meadowlark.operators import harvest, population, serving
from meadowlark.sources import archives, json_files, pages, sinks, writers
from meadowlark.streaming.reports import stream_harvest, stream_harvest_pages


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members:
            z.writestr(name, data)


def test_archives(spark, tmp_path):
    _zip(tmp_path / "a.zip", [("x/2020StatewideElkHarvest.pdf", "one"), ("Elk Harvest Estimate.PDF", "h"), ("elk.txt", "t"), ("deer.pdf", "d")])
    _zip(tmp_path / "b.zip", [("2019ElkPopulationEstimate.pdf", "p"), ("y/2020StatewideElkHarvest.pdf", "two"), ("elk_map.pdf", "m")])
    (tmp_path / "c.zip").write_bytes(b"no archive")
    members = archives.read_members(spark, str(tmp_path))
    assert members.where("error IS NOT NULL").count() == 1
    routed = archives.categorised(members)
    assert {r["category"]: r["members"] for r in archives.category_counts(routed).collect()} == {"harvest_reports": 3, "population_estimates": 1, "other_elk": 1, "skipped": 1}
    files = {(r["category"], r["name"]): bytes(r["data"]) for r in archives.newest_files(routed).collect()}
    assert files["harvest_reports", "2020StatewideElkHarvest.pdf"] == b"two" and len(files) == 4
    archives.save_files(archives.newest_files(routed), str(tmp_path / "out"))
    found = {(f.parent.name, f.name): f.read_bytes() for f in (tmp_path / "out").glob("*/*")}
    assert found == files and not list((tmp_path / "out").glob(".staging*"))


def test_page_text(spark, tmp_path):
    (tmp_path / "b.txt").write_text("second")
    (tmp_path / "a.txt").write_text("first\fpage two")
    rows = [(r["file_ord"], r["page_no"], r["text"]) for r in pages.read_page_text(spark, str(tmp_path)).orderBy("file_ord", "page_no").collect()]
    assert rows == [(0, 0, "first"), (0, 1, "page two"), (1, 0, "second")]


def test_json_files(spark, tmp_path):
    record = {"year": 2020, "species": "elk", "dau": "E-1", "dau_number": 1, "herd_name": None, "gmus": [1], "population_estimate": 5, "bull_cow_ratio": None}
    (tmp_path / "p_2020.json").write_text(json.dumps({"year": 2020, "species": "elk", "statewide_total": 5, "records": [record], "dau_gmu_mapping": {"E-1": [1]}}, indent=2))
    (tmp_path / "p_combined.json").write_text(json.dumps({"records": [record]}))
    (tmp_path / "h_2020.json").write_text(json.dumps({"year": 2020, "harvest_records": [{"year": 2020, "gmu": 4}], "sections_detail": []}))
    h, p = json_files.read_reports(spark, f"{tmp_path}/h_*.json", f"{tmp_path}/p_*.json")
    assert [r["dau_gmu_mapping"] for r in p.collect()] == [{"E-1": [1]}]
    assert [(r["dau"], r["gmus"]) for r in json_files.population_records(p).collect()] == [("E-1", [1])]
    assert [(r["gmu"], r["bulls"], r["antlered_harvest"]) for r in json_files.harvest_records(h).collect()] == [(4, 0, None)]
    assert json_files.unit_records(h).count() == 0
    none, _ = json_files.read_reports(spark, f"{tmp_path}/none_*.json", f"{tmp_path}/p_*.json")
    assert none.count() == 0
    with pytest.raises(FileNotFoundError):
        json_files.read_reports(spark, f"{tmp_path}/none_*.json", f"{tmp_path}/nil_*.json")


def test_variants(spark, tmp_path):
    """Absent, null, empty and filled fields are told apart, whatever else a file holds."""
    for name, body in (("a", {"year": 2020, "h": {}, "d": {"E-1": {"g": {}}, "E-2": {"g": None}, "E-3": {}, "E-4": {"g": {"2020": [1]}}}}), ("b", {"years": [1], "d": {}}), ("c", {"year": 2021})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
    files = json_files.read_variants(spark, f"{tmp_path}/*.json")
    assert sorted((r["file_ord"], r["year"]) for r in json_files.per_year(files).collect()) == [(0, 2020), (2, 2021)]
    units = json_files.exploded(files, "$.d")
    got = {r["key"]: r["state"] for r in units.select("key", json_files.presence(F.col("value"), "$.g").alias("state")).collect()}
    assert got == {"E-1": "empty", "E-2": "null", "E-3": "absent", "E-4": "filled"}
    assert json_files.read_variants(spark, f"{tmp_path}/none*.json").count() == 0


def test_csv(spark, tmp_path):
    text = '2023 POST HUNT\nBull/Cow\n10 Far "off" 7, 6 1,000 20\n2 Near 3, 4 100 30'
    page = "file string, file_ord long, page_no int, text string"
    older = "2023 POST HUNT\nBull/Cow\n5 Old 1 10 2"  # an earlier file of the same year gives way
    report = population.parse_reports(spark.createDataFrame([("o", 0, 0, older), ("p", 1, 0, text), ("q", 2, 0, "2024 POST HUNT\n9 None")], page))
    made = sinks.population_csv(report.records, str(tmp_path)) | sinks.mapping_csv(report.records, report.totals, str(tmp_path))
    read = lambda name: (tmp_path / name).read_bytes().decode()
    assert sorted(made) == [f"{tmp_path}/{n}" for n in ("dau_gmu_mapping_2023.csv", "dau_gmu_mapping_2024.csv", "elk_population_2023.csv")]
    assert all(len(read(name.rsplit("/")[-1])) == size for name, size in made.items())
    lines = read("elk_population_2023.csv").split("\r\n")
    assert lines == ["year,species,dau,dau_number,herd_name,gmus,population_estimate,bull_cow_ratio", '2023,elk,E-10,10,"Far ""off""",7; 6,1000,20', "2023,elk,E-2,2,Near,3; 4,100,30", ""]
    assert read("dau_gmu_mapping_2023.csv").split("\r\n") == ["year,dau,gmu", "2023,E-2,3", "2023,E-2,4", "2023,E-10,7", "2023,E-10,6", ""]
    assert read("dau_gmu_mapping_2024.csv") == "year,dau,gmu\r\n"
    empty = harvest.parse_reports(spark.createDataFrame([], page)).records
    assert sinks.harvest_csv(empty, str(tmp_path / "none")) == {} and not (tmp_path / "none").exists()


def test_large_document_is_written_in_parallel(spark, tmp_path):
    """Pieces from many partitions, characters of several bytes: one file, equal to the pieces in order."""
    text = F.concat(F.lit('{"é":'), F.col("id"), F.lit(',"t":"'), F.repeat(F.lit("ü"), (F.col("id") % 50).cast("int")), F.lit('"}'))
    pieces = serving.items(spark.range(0, 20_000, numPartitions=7), 0, [F.col("id")], text, '{"a":[', "]}").repartition(11)
    made = sinks.document(pieces, str(tmp_path / "d/doc.json"))
    whole = (tmp_path / "d/doc.json").read_text()
    assert json.loads(whole)["a"] == [{"é": k, "t": "ü" * (k % 50)} for k in range(20_000)]
    assert made.size == len(whole.encode()) and made.items[0] == 20_000 and [f.name for f in (tmp_path / "d").iterdir()] == ["doc.json"]
    sinks.document_parts(pieces, str(tmp_path / "parts"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "parts").glob("part-*"))) == whole


def test_failed_jobs_leave_nothing(spark, tmp_path):
    """A task that dies after some files, and sizes that don't add up, leave neither files nor staging folders."""
    fails = F.when(F.col("id") == 90, F.raise_error(F.lit("lost"))).otherwise(F.lit(b"x"))
    files = spark.range(100).select(F.lit("c").alias("category"), F.col("id").cast("string").alias("name"), fails.alias("data"))
    with pytest.raises(Exception, match="lost"):
        writers.write_routed(files, str(tmp_path / "r"))
    pieces = spark.range(2).select(F.lit("f").alias("name"), (F.col("id") * 3).alias("at"), F.lit(b"abc").alias("piece"))
    with pytest.raises(Exception, match="announced"):
        writers.write_placed(pieces, str(tmp_path / "p"), {"f": 7})
    assert [list((tmp_path / d).iterdir()) for d in "rp"] == [[], []]
    writers.write_placed(pieces, str(tmp_path / "p"), {"f": 6})
    assert (tmp_path / "p/f").read_bytes() == b"abcabc"
    with pytest.raises(ValueError, match="mounted"):
        writers.local_path("hdfs://host/a")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"file": "a", "file_ord": 0, "page_no": 0, "text": "2020 Elk Recreation Days All Manners\n1 1 1 1 3 6 50 30"}
    (tmp_path / "in/a.json").write_text(json.dumps(line) + "\n")
    for _ in range(2):
        stream_harvest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        (tmp_path / "in/b.json").write_text(json.dumps(line | {"file": "b", "text": line["text"].replace("2020", "2021")}) + "\n")
    rows = spark.read.parquet(str(tmp_path / "out/records")).collect()
    assert sorted(r["year"] for r in rows) == [2020, 2021]


def test_pages_that_arrive_apart(spark, tmp_path):
    """Pages of three reports in any order over several batches and runs, one twice: the rows of a batch over all at once."""
    title = "{} Elk Recreation Days All Manners"
    reports = {
        "a": [title.format(2020) + "\n1 1 1 1 3 6 50 30", "2 1 1 1 3 6 50 30", "Contents\n2021 Elk", title.format(2021) + "\n3 1 1 1 3 6 50 30", "4 1 1 1 3 6 50 30"],
        "b": [title.format(2019) + "\n5 1 1 1 3 6 50 30", "6 1 1 1 3 6 50 30"],
        "c": [title.format(2018) + "\n7 1 1 1 3 6 50 30", "not the last"],
    }
    rows = {(f, k): {"file": f, "file_ord": o, "page_no": k, "text": t, "pages": len(v)} for o, (f, v) in enumerate(reports.items()) for k, t in enumerate(v)}
    (tmp_path / "in").mkdir()
    run = lambda: stream_harvest_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), files_a_batch=1).awaitTermination(300)
    parts = [[("a", 3), ("b", 1)], [("a", 4), ("a", 3), ("c", 0)], [("a", 0), ("a", 2)], [("b", 0), ("a", 1)]]
    for n, part in enumerate(parts):
        (tmp_path / f"in/{n}.json").write_text("".join(json.dumps(rows[k]) + "\n" for k in part))
        if n in (1, 3):
            run()
    shown = ("file", "page_no", "line_no", "year", "gmu", "section_method")
    got = spark.read.parquet(str(tmp_path / "out/records")).select(*shown).collect()
    whole = spark.createDataFrame([(r["file"], r["file_ord"], r["page_no"], r["text"]) for r in rows.values() if r["file"] != "c"], "file string, file_ord long, page_no int, text string")
    assert sorted(map(tuple, got)) == sorted(map(tuple, harvest.parse_reports(whole).records.select(*shown).collect()))
    assert {r["gmu"] for r in got} == {3, 4, 5, 6}  # the contents page makes it a report of 2021


def test_broken_members_stand_alone(spark, tmp_path):
    """Each broken member is a row of its own; a reader that gives up there keeps what stands before it."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in "abcd":
            z.writestr(f"elk_{name}.pdf", name * 50, zipfile.ZIP_DEFLATED if name == "d" else zipfile.ZIP_STORED)
    data = bytearray(buffer.getvalue())
    data[data.rindex(b"b" * 50)] ^= 1
    (tmp_path / "x.zip").write_bytes(bytes(data))
    members = archives.read_members(spark, str(tmp_path))
    rows = members.collect()
    assert [(r["member"], r["error"] is None) for r in rows] == [("elk_a.pdf", True), ("elk_b.pdf", False), ("elk_c.pdf", True), ("elk_d.pdf", True)]
    assert bytes(rows[3]["data"]) == b"d" * 50
    assert [r["member"] for r in archives.before_breaks(members).where("error IS NULL").collect()] == ["elk_a.pdf"]


def test_archive_is_split_into_runs_of_members(spark, tmp_path):
    _zip(tmp_path / "big.zip", [("folder/", "")] + [(f"m{k}", "x" * 1000) for k in range(40)])
    _zip(tmp_path / "empty.zip", [])
    members = archives.read_members(spark, str(tmp_path), run_bytes=5000)
    assert members.rdd.getNumPartitions() == 8 and {len(r["data"]) for r in members.collect()} == {1000}
    slim = archives.read_members(spark, str(tmp_path), with_data=False, run_bytes=5000)
    assert slim.where("data IS NOT NULL").count() == 0 and slim.count() == 40
    read = archives.with_data(slim.where("member_ord % 2 = 0").withColumn("extra", F.lit(1)), run_bytes=5000).collect()
    assert len(read) == 20 and all(bytes(r["data"]) == b"x" * 1000 and r["extra"] == 1 for r in read)
    assert archives.read_members(spark, str(tmp_path / "none")).count() == 0


def test_extract(spark, tmp_path):
    """Routed files by name, the last of a repeated name in archive and member order, nothing after a broken member."""
    _zip(tmp_path / "a.zip", [("x/2020 Elk Harvest.pdf", "one"), ("y/2020 Elk Harvest.pdf", "two"), ("Elk Herd.pdf", "h"), ("deer.pdf", "d")])
    _zip(tmp_path / "b.zip", [("2020 Elk Harvest.pdf", "three"), ("elk.pdf", "e" * 60), ("Elk Status.pdf", "lost")])
    data = bytearray((tmp_path / "b.zip").read_bytes())
    data[data.rindex(b"e" * 60)] ^= 1
    (tmp_path / "b.zip").write_bytes(bytes(data))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    counts, broken = archives.extract(spark, str(tmp_path), str(tmp_path / "out"), run_bytes=60)
    assert {r["category"]: r["members"] for r in counts.collect()} == {"harvest_reports": 3, "population_estimates": 1, "skipped": 1}
    assert sorted((r["zip_path"].rsplit("/")[-1], r["member"]) for r in broken.collect()) == [("b.zip", "elk.pdf"), ("c.zip", None)]
    assert {f"{f.parent.name}/{f.name}": f.read_text() for f in (tmp_path / "out").glob("*/*")} == {"harvest_reports/2020 Elk Harvest.pdf": "three", "population_estimates/Elk Herd.pdf": "h"}
