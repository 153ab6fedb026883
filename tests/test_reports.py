"""Report text to records, dimensions and documents, on the worked examples of FIXTURES.md."""

import json

import pytest
from pyspark.sql import functions as F

from meadowlark.operators import dimensions, harvest, population, relational, sections, serving, trends
from meadowlark.plans import reports
from meadowlark.sources import sinks

PAGE = "file string, file_ord long, page_no int, text string"
HARVEST = """2019 Elk Harvest, Hunters and Recreation Days for All Manners of Take
Total Total Percent Total
Unit Bulls Cows Calves Harvest Hunters Success Rec. Days
1 20 5 1 26 60 43 300
2 1,132 10 0 1,142 2,000 57 9,500
3 - 1 0 1 5 20 12
Total 1,152 15 1 1,168 2,060 57 9,800
2019 Elk Harvest, Hunters and Percent Success for Limited Antlered 1 s t Season
Antlered Antlered Percent
1 10 40 25 3 12 25
Total 10 40 25 3 12 25
2019 Elk Harvest, Hunters and Recreation Days for 2 n d Rifle Season
1 4 1 0 5 20 25 80
2019 Elk Harvest by DAU with Confidence Intervals
E-1 386 5 376 397 222 9 204 241 57.5 1792 59 1681 1911 0.959 0.552
E-01 373 0 373 373 214 7 201 228 57% 1,652 33 1,589 1,718 0.97 0.64
2019 Elk Harvest, Hunters and Recreation Days for Bosque del Oso
Archery 10 5 0 15 30 50 90
1st Rifle 2 0 0 2 4 50 8
2 n d Rifle 1 0 0 1 2 50 4
851 4 11 0 15 75 20 245
Total 16 16 0 32 109 29 343
2019 Elk Harvest and Percent Success for Damage Hunts
1 2 4 50 1 4 25
2019 Elk Hunters Confidence Summary
9 1 1 1 3 6 50 30
2019 Elk Harvest, Hunters and Recreation Days for Late Seasons (Includes PLOs)
5 1 1 1 3 6 50 30"""


@pytest.fixture(scope="module")
def pages(spark):
    contents = "\n".join(["2019 Colorado Elk"] + ["Archery .... 3"] * 6)
    rows = [("a.txt", 0, 0, contents), ("a.txt", 0, 1, None), ("a.txt", 0, 2, HARVEST), ("b.txt", 1, 0, "1 2 3"), ("c.txt", 2, 0, "Contents\n2020 Elk")]
    huge = "2020 Elk Recreation Days All Manners\n1 2 3 4 99999999999999999999 6 7 8\n2 1 1 1 3 6 50 30"
    return spark.createDataFrame([*rows, ("d.txt", 3, 0, huge)], PAGE)


@pytest.fixture(scope="module")
def report(pages):
    return harvest.parse_reports(pages)


def test_harvest_records(report):
    rows = {(r["section_method"], r["section_season"], r["gmu"]): r.asDict() for r in report.records.collect()}
    assert set(rows) == {
        ("all", "all", 1), ("all", "all", 2), ("rifle", "1st", 1), ("rifle", "2nd", 1), ("bosque_archery", "all", 851), ("bosque_rifle", "1st", 851),
        ("bosque_all", "all", 851), ("late_incl_plo", "all", 5),
    }
    success = rows["rifle", "1st", 1]
    assert (success["bulls"], success["total_rec_days"], success["antlered_harvest"], success["antlerless_pct_success"]) == (0, 0, 10, 25)
    assert success["section_license_type"] == "antlered" and success["year"] == 2019
    whole = rows["all", "all", 2]
    assert (whole["bulls"], whole["total_harvest"], whole["total_rec_days"], whole["antlered_harvest"]) == (1132, 1142, 9500, None)


def test_unit_records(report):
    rows = report.unit_records.orderBy("line_no").collect()
    assert [(r["dau"], r["total_hunters"], r["pct_success"], r["total_rec_days"], r["response_rate"]) for r in rows] == [
        ("E-1", 386, 57.5, 1792, 0.552), ("E-1", 373, 57.0, 1652, 0.64)]


def test_sections_and_quarantine(report):
    detail = [(r["type"], r["method"], r["records"]) for r in report.sections.orderBy("section").collect()]
    assert detail == [
        ("harvest_rec_days", "all", 2), ("percent_success", "rifle", 1), ("harvest_rec_days", "rifle", 1), ("dau_summary", "all", 2), ("bosque", "bosque", 3),
        ("harvest_rec_days", "damage", 0), ("harvest_rec_days", "late_incl_plo", 1),
    ]
    assert {tuple(r) for r in report.quarantine.collect()} == {("b.txt", "no year"), ("d.txt", "bad number")}
    assert {(r["file"], r["year"]) for r in report.files.collect()} == {("a.txt", 2019), ("c.txt", 2020)}


def test_order_of_input_does_not_matter(pages, report):
    again = harvest.parse_reports(pages.repartition(5, F.rand(3)))
    assert sorted(map(str, again.records.collect())) == sorted(map(str, report.records.collect()))


def test_unparsed_lines(pages):
    rows = harvest.with_rows(sections.in_sections(pages))
    assert [r["line"] for r in sections.unparsed_lines(rows).collect()] == ["1 2 4 50 1 4 25"]


def test_statewide_harvest_slim_and_dashboard(report):
    trend = trends.statewide_harvest(report.records).first().asDict()
    assert trend == {"year": 2019, "total_harvest": 1168, "total_hunters": 2060, "total_bulls": 1152, "total_cows": 15, "total_calves": 1, "total_rec_days": 9800, "gmu_count": 2}
    assert sorted(r["gmu"] for r in serving.slim(report.records).collect()) == [1, 2]
    assert sorted((r["m"], r["s"], r["g"]) for r in serving.dashboard(report.records).collect()) == [("all", "all", 1), ("all", "all", 2), ("rifle", "2nd", 1)]
    assert len(harvest.app_tables(report.records).columns) == 20


@pytest.mark.parametrize(
    ("line", "with_ratio", "expected"),
    [
        ("02 Bears Ears 3, 4, 5, 14, 214 25,080 23", True, ("E-2", "Bears Ears", [3, 4, 5, 14, 214], 25080, 23)),
        ("99 Unassigned 0", True, ("E-99", "Unassigned", [], 0, None)),
        ("16 *** Frying Pan 44, 45 8,000 19", True, ("E-16", "Frying Pan", [44, 45], 8000, 19)),
        ("06 White River 11, 12 900", True, ("E-6", "White River 11,", [], 12, 900)),
        ("06 White River 11, 12 41,110", True, "fails"),
        ("7 Some ELK Herd 4 100 10", True, None),
        ("12 January 2020", False, ("E-12", "January", [], 2020, None)),
        ("2 3, 301, 4, 5 21,120", False, ("E-2", None, [3, 301, 4, 5], 21120, None)),
        ("10 21, 22,", False, ("E-10", "21,", [], 22, None)),
        ("44, 45 5,000", False, None),
        ("44 45 5,000", False, ("E-44", None, [45], 5000, None)),
    ],
)
def test_population_rows(spark, line, with_ratio, expected):
    text = "2024 POST HUNT\n" + ("Bull/Cow\n" if with_ratio else "") + line
    out = population.parse_reports(spark.createDataFrame([("p.txt", 0, 0, text)], PAGE))
    rows = [(r["dau"], r["herd_name"], r["gmus"], r["population_estimate"], r["bull_cow_ratio"]) for r in out.records.collect()]
    if expected == "fails":
        assert [tuple(r) for r in out.quarantine.collect()] == [("p.txt", "bad number")]
        assert out.totals.count() == 0
    else:
        assert rows == ([] if expected is None else [expected])


@pytest.mark.parametrize(("middle", "expected"), [("3, 4 5", ("3, 4", [5])), ("Herd7", ("Herd", [7])), ("3, 4,", ("3, 4,", [])), ("", (None, []))])
def test_split_middle(spark, middle, expected):
    assert tuple(spark.range(1).select(population.split_middle(F.lit(middle)).alias("m")).first()["m"]) == expected


def test_split_middle_of_a_long_list(spark):
    """Thousands of units in a row are one list, and one that a name ends is none."""
    many = ", ".join(map(str, range(1, 20_001)))
    texts = [f"Herd 7 {many}", f"{many} Herd", f"Herd5{many}", "A 1 2,3", "A 1,2 ,3", "1,  2,3 ", "12, x 3,"]
    found = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("k", population.split_middle(F.col("x")).alias("m")).orderBy("k").collect()
    numbers = list(range(1, 20_001))
    assert [tuple(r["m"]) for r in found] == [
        ("Herd 7", numbers), (f"{many} Herd", []), ("Herd", [51, *numbers[1:]]), ("A 1", [2, 3]), ("A 1,2 ,", [3]), (None, [1, 2, 3]), ("12, x 3,", []),
    ]


def test_population_totals_and_mismatches(spark):
    text = "2023 POST HUNT\n2 3, 4 100\nTotal Statewide Estimate 290\ntotal statewide estimate 150"
    named = spark.createDataFrame([("x/2019/p.txt", 0, 0, "2 3, 4 100"), ("q.txt", 1, 0, text), ("e.txt", 2, 0, None), ("n.txt", 3, 0, "2 3 4")], PAGE)
    out = population.parse_reports(named)
    assert {(r["file"], r["year"], r["statewide_total"]) for r in out.totals.collect()} == {("x/2019/p.txt", 2019, 0), ("q.txt", 2023, 150)}
    assert {tuple(r) for r in out.quarantine.collect()} == {("e.txt", "no text"), ("n.txt", "no year")}
    assert [(r["file"], r["record_total"]) for r in population.sum_mismatches(out.records, out.totals).collect()] == [("q.txt", 100)]
    assert sorted((r["year"], r["dau"], r["pos"], r["gmu"]) for r in population.mapping_rows(out.records).collect())[:2] == [(2019, "E-2", 0, 3), (2019, "E-2", 1, 4)]


@pytest.fixture(scope="module")
def units(spark):
    rows = [
        (0, 2019, "E-1", None, [2, 1]), (0, 2019, "E-2", None, [3]), (1, 2024, "E-1", "Cold Spring", [1, 2]), (1, 2024, "E-2", "Bears Ears", [4, 3]),
        (1, 2024, "E-3", "Empty", []), (1, 2024, "E-4", None, [3]),
    ]
    rows = [(f"f{o}", o, 0, k, y, d, int(d[2:]), h, g) for k, (o, y, d, h, g) in enumerate(rows)]
    return spark.createDataFrame(rows, "file string, file_ord long, page_no int, line_no int, year long, dau string, dau_number long, herd_name string, gmus array<bigint>")


def test_unit_definitions_and_lookup(units):
    found = dimensions.unit_definitions(units)
    rows = {r["dau"]: (r["herd_name"], r["gmus"], r["gmu_history"], r["history_state"], r["years_present"]) for r in found.collect()}
    assert rows["E-1"] == ("Cold Spring", [1, 2], None, "absent", [2019, 2024])
    assert rows["E-2"] == ("Bears Ears", [3, 4], {2019: [3], 2024: [3, 4]}, "populated", [2019, 2024])
    assert rows["E-3"] == ("Empty", [], None, "empty", [2024])
    assert rows["E-4"] == (None, [3], None, "absent", [2024])
    assert {(r["gmu"], r["dau"], r["claimed_by"]) for r in dimensions.unit_lookup(found).collect()} == {(1, "E-1", 1), (2, "E-1", 1), (4, "E-2", 1), (3, "E-4", 2)}


def test_documents(spark, pages, tmp_path):
    text = "2019 POST HUNT\nHerd Name\nBull/Cow\n1 Cold Spring 1, 2 1,000 30\n3 Empty 0\nTotal Statewide Estimate 1,000"
    tables = reports.combined_tables(pages, spark.createDataFrame([("p.txt", 0, 0, text)], PAGE))
    tables = serving.Combined(*[df.persist() for df in tables])
    docs = reports.documents(tables, "2024-01-02", "State", "Agency")
    loaded = {}
    for name in docs._fields:
        made = sinks.document(getattr(docs, name), str(tmp_path / name))
        loaded[name] = json.loads((tmp_path / name).read_text())
        assert made.size == (tmp_path / name).stat().st_size
        assert [made.items[k] for k in (3, 5, 7)] == [len(loaded[name][k]) for k in ("dau_definitions", "harvest", "population")]
    full = loaded["full"]
    assert full["metadata"]["record_counts"] == {"harvest": 8, "dau_harvest_summary": 2, "population": 2, "dau_definitions": 2}
    assert full["metadata"]["years"] == [2019, 2020] and full["metadata"]["generated"] == "2024-01-02"
    assert full["statewide_trends"]["population"] == {"2019": 1000} and full["statewide_trends"]["harvest"]["2019"]["gmu_count"] == 2
    assert list(full["dau_definitions"]) == ["E-1", "E-3"]
    assert "gmu_history" not in full["dau_definitions"]["E-1"] and full["dau_definitions"]["E-3"]["gmu_history"] == {}
    assert full["gmu_to_dau"] == {"1": "E-1", "2": "E-1"} and len(full["dau_harvest_summary"]) == 2
    assert full["harvest"][0]["section_license_type"] is None
    assert [r["gmu"] for r in loaded["slim"]["harvest"]] == [1, 2] and "dau_harvest_summary" not in loaded["slim"]
    assert loaded["dashboard"]["metadata"]["record_counts"]["harvest"] == 3 and loaded["dashboard"]["harvest"][0]["y"] == 2019


def test_trailing_mean_classes_and_equal_counts(spark):
    rows = spark.createDataFrame([("a", 2000, 1.0), ("a", 2001, 3.0), ("a", 2004, 9.0)], "g string, y int, v double")
    assert [r["v_mean"] for r in trends.trailing_mean(rows, ["g"], "y", "v", 3).orderBy("y").collect()] == [1.0, 2.0, 9.0]
    numbers = spark.range(0, 100).select(F.col("id").cast("double").alias("v"))
    classed = trends.in_classes(numbers, "v", trends.quantile_breaks(numbers, "v", 4)).groupBy("class").count().orderBy("class").collect()
    assert [r["count"] for r in classed] == [25, 25, 25, 25]
    sizes = trends.equal_count_classes(spark.range(0, 17), ["id"], 7).groupBy("class").count().orderBy("class").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3, 2, 2, 2, 2]


def test_padded_union_and_pairs(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(2, 3)], "k int, y int")
    both = relational.padded_union([a, b], zeros=["x"])
    assert sorted((r["k"], r["x"], r["y"]) for r in both.select("k", "x", "y").fillna(-1, ["y"]).collect()) == [(1, 2, -1), (2, 0, 3)]


def test_definitions_fold_in_any_order(spark, units):
    """States of single rows, merged in several orders and groupings, give the definitions of all rows at once."""
    shown = ("dau", "dau_number", "herd_name", "gmus", "gmu_history", "history_state", "years_present")
    rows = lambda df: sorted(map(str, df.select(*shown).collect()))
    whole = rows(dimensions.unit_definitions(units))
    first, second = units.where("file_ord = 0"), units.where("file_ord = 1")
    states = [dimensions.definition_state(df) for df in (first, second.where("dau = 'E-2'"), second.where("dau <> 'E-2'"))]
    a, b, c = states
    for order in ((a, b, c), (c, a, b), (b, dimensions.merged_states(c, a))):
        assert rows(dimensions.definitions_of(dimensions.merged_states(*order))) == whole


def test_keyed_breaks(spark):
    """Interpolated breaks per key, a null key and one with most rows among them, as percentile gives them."""
    rows = [("a", float(k % 37)) for k in range(500)] + [("b", 5.0), ("c", 1.0), ("c", 2.0), (None, 7.0), (None, 9.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["breaks"] for r in trends.quantile_breaks(df, "v", 4, ["k"]).collect()}
    want = df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("b")).where("b IS NOT NULL")
    assert got == {r["k"]: pytest.approx(r["b"]) for r in want.collect()}
    classes = trends.in_classes(df.where("k = 'c'"), "v", trends.quantile_breaks(df, "v", 4, ["k"]), ["k"]).collect()
    assert sorted(r["class"] for r in classes) == [1, 4]


def test_running_totals_equal_trailing_means(spark):
    rows = [(1, "all", "all", 2000, 4), (1, "all", "all", 2001, 8), (1, "all", "all", 2004, 3), (2, "all", "all", 2001, 6), (2, "archery", "all", 2003, None)]
    records = spark.createDataFrame(rows, "gmu long, section_method string, section_season string, year long, v long")
    totals = trends.running_totals(records, "v")
    got = {(r["gmu"], r["section_method"], r["year"]): r["mean"] for r in trends.means_over(totals, 3).collect()}
    assert got[1, "all", 2002] == 6 and got[1, "all", 2003] == 8 and got[1, "all", 2004] == 3 and got[None, "all", 2002] == 9
    assert (2, "archery", 2003) not in got and (2, "all", 2004) not in got


def test_section_totals(pages):
    """Stated totals beside sums: the first table adds up, the bosque's Total row doesn't, percentages are left out."""
    rows = {(r["section"]["line_no"], r["figure"]): (r["stated"], r["summed"]) for r in harvest.section_totals(sections.in_sections(pages)).where("file = 'a.txt'").collect()}
    assert rows[0, "bulls"] == (1152, 1152) and rows[0, "total_rec_days"] == (9800, 9800) and rows[0, "total_hunters"] == (2060, 2060)
    bosque = [v for (_, figure), v in rows.items() if figure == "cows" and v[0] == 16]
    assert bosque == [(16, 16)] and not any("pct" in figure for _, figure in rows)
    assert rows[7, "antlered_harvest"] == (10, 10)


def test_running_totals_broadcast_no_table_of_keys(spark):
    """Keys are as many as the units, so neither step joins by them, whatever size the files of the totals seem to have."""
    rows = spark.createDataFrame([(1, "a", 2001, 4), (1, "a", 2004, 6), (2, "b", 2002, 5), (3, "b", None, 7)], "gmu long, m string, year long, v long")
    totals = trends.running_totals(rows, "v", ["gmu", "m"])
    means = trends.means_over(totals, 3, ["gmu", "m"])
    for df in (totals, means):
        assert "LeftOuter" not in df._jdf.queryExecution().toString()
    assert {(r["gmu"], r["year"], r["mean"]) for r in means.where("gmu IS NOT NULL").collect()} == {
        (1, 2001, 4.0), (1, 2002, 4.0), (1, 2003, 4.0), (1, 2004, 6.0), (2, 2002, 5.0), (2, 2003, 5.0), (2, 2004, 5.0),
    }
    assert totals.where("gmu = 3").count() == 5


def test_rows_are_shaped_once(spark, monkeypatch):
    """Titles and shapes of a line are worked out once, and odd figures come out as they did field by field."""
    written, seen = harvest.written, []
    monkeypatch.setattr(harvest, "written", lambda df: seen.append(df) or written(df))
    lines = ["1 2 3 4 5 6 50 7", "2 , 3,000 ,, 5 6 50 7", "3  2 \t3 4 5 6 50 ,", "4 1,2 3 4 5 6 50 1,234,567"]
    units = ["E-01 1 , 3 4 5 6 7 8 12.5% 1 2 3 4 0.125 .5", "E-2  1 2 3 4 5 6 7 8 9 1 2 3 4 5 1."]
    season = ["1st Rifle 1 2 , 4 5 6 7", "Archery 1  2 3 4 5 6 7,000"]
    text = ["2020 Elk Harvest, Hunters and Recreation Days for Archery", *lines, "2020 Elk Harvest by DAU with Confidence Intervals", *units, "2020 Elk Recreation Days for Bosque del Oso", *season]
    bad = "2021 Elk Recreation Days for Archery\n1 2 3 4 5 6 50 " + "9" * 20
    page = "file string, file_ord long, page_no int, text string"
    report = harvest.parse_reports(spark.createDataFrame([("a", 0, 0, "\n".join(text)), ("b", 1, 0, bad), ("c", 2, 0, None)], page))
    rows = report.records.orderBy("line_no").select("gmu", "section_method", *harvest.COUNTS).collect()
    assert [tuple(r) for r in rows] == [
        (1, "archery", 2, 3, 4, 5, 6, 50, 7), (2, "archery", 0, 3000, 0, 5, 6, 50, 7), (3, "archery", 2, 3, 4, 5, 6, 50, 0), (4, "archery", 12, 3, 4, 5, 6, 50, 1234567),
        (851, "bosque_rifle", 1, 2, 0, 4, 5, 6, 7), (851, "bosque_archery", 1, 2, 3, 4, 5, 6, 7000),
    ]
    found = report.unit_records.orderBy("line_no").select("dau", *harvest.UNIT_COLUMNS[3:]).collect()
    assert [tuple(r) for r in found] == [("E-1", 1, 0, 3, 4, 5, 6, 7, 8, 12.5, 1, 2, 3, 4, 0.125, 0.5), ("E-2", 1, 2, 3, 4, 5, 6, 7, 8, 9.0, 1, 2, 3, 4, 5.0, 1.0)]
    assert [tuple(r) for r in report.quarantine.collect()] == [("c", "no year"), ("b", "bad number")]
    plan = seen[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 10 and plan.count("titles#") <= 8
