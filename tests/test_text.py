import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meadowlark.functions.text import parsed_float, parsed_int, repaired_ordinals, tokens, tried_int, trimmed, unit_id
from meadowlark.functions.titles import classified


def _one(spark, expression, value=None):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "value"), [("", 0), ("-", 0), ("1,132", 1132), (",", 0), ("7", 7), (" 9 ", 9), ("3,000,000,000", 3_000_000_000)])
def test_parsed_int(spark, text, value):
    assert _one(spark, parsed_int, text) == value


def test_parsed_float_and_errors(spark):
    assert _one(spark, parsed_float, "57.5") == 57.5
    assert _one(spark, tried_int, "x1") is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        _one(spark, parsed_int, "x1")


def test_trim_takes_unicode_spaces(spark):
    nbsp = chr(0xA0)
    assert _one(spark, trimmed, f"{nbsp}\t a b {nbsp}") == "a b"
    assert _one(spark, tokens, f" a{nbsp}b  c ") == ["a", "b", "c"]
    assert _one(spark, tokens, "  ") == []


@pytest.mark.parametrize(("text", "fixed"), [("1 s t Season", "1st Season"), ("2 n d 3 r d 4 t h", "2nd 3rd 4th"), ("11 s t", "11 s t"), ("2 s t", "2 s t")])
def test_ordinals(spark, text, fixed):
    assert _one(spark, repaired_ordinals, text) == fixed


def test_unit_id(spark):
    assert [_one(spark, unit_id, x) for x in ("E-1", "E-01", "E-10")] == ["E-1", "E-1", "E-10"]


@pytest.mark.parametrize(
    ("title", "meta"),
    [
        ("2019 Elk Harvest by DAU with Confidence", ("dau_summary", "all", "all", None)),
        ("2019 Elk Recreation Days for Bosque del Oso", ("bosque", "bosque", "all", None)),
        ("2019 Elk Percent Success for Damage Hunts", ("harvest_rec_days", "damage", "all", None)),
        ("2019 Elk Confidence Summary", None),
        ("2019 Elk Recreation Days Ranching for Wildlife", ("harvest_rec_days", "rfw", "all", None)),
        ("2019 Elk Recreation Days Early High Country", ("harvest_rec_days", "early_hc", "all", None)),
        ("2019 Elk Recreation Days PLO Seasons Only Early PLO", ("harvest_rec_days", "plo_early", "all", None)),
        ("2019 Elk Recreation Days Private Land Only", ("harvest_rec_days", "plo", "all", None)),
        ("2019 Elk Recreation Days Late Seasons", ("harvest_rec_days", "late", "all", None)),
        ("2019 Elk Percent Success Limited Antlerless Archery 5th Season", ("percent_success", "rifle", "5", "antlerless")),
        ("2019 Elk Percent Success Limited 7th Split", ("percent_success", "rifle", "7th_split", None)),
        ("2019 Elk Percent Success Limited", ("percent_success", "rifle", None, None)),
        ("2019 Elk Recreation Days Archery", ("harvest_rec_days", "archery", "all", None)),
        ("2019 Elk Recreation Days Muzzle", ("harvest_rec_days", "muzzleloader", "all", None)),
        ("2019 Elk Recreation Days Fourth Rifle", ("harvest_rec_days", "rifle", "4th", None)),
        ("2019 Elk Recreation Days Rifle", ("harvest_rec_days", "rifle", "all", None)),
        ("2019 Elk Recreation Days All Manners", ("harvest_rec_days", "all", "all", None)),
        ("2019 Elk Recreation Days", ("harvest_rec_days", "unknown", "all", None)),
    ],
)
def test_title_rules(spark, title, meta):
    found = _one(spark, classified, title)
    assert (None if found is None else tuple(found)[:4]) == meta


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**12))
def test_rendered_numbers_parse_back(spark, n):
    assert _one(spark, parsed_int, f"{n:,}") == n
