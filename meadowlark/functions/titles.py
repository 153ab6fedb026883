"""Section titles: which lines are titles, and what a title says about its table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meadowlark.functions.patterns import TITLE_WORDS
from meadowlark.functions.text import has_any

META = "struct<table_type:string,method:string,season:string,license_type:string,raw_title:string>"


def is_title(line: Column, year: Column) -> Column:
    """A line that starts with the report's year and names a harvest table; repairing its ordinals changes none of this."""
    return line.startswith(year.cast("string")) & line.contains("Elk") & has_any(line, *TITLE_WORDS)


def _season_of_limited(t: Column) -> Column:
    split = F.regexp_extract(t, r"(\d)(?:st|nd|rd|th)\s+Split", 1)
    plain = F.regexp_extract(t, r"(\d)(?:st|nd|rd|th)\s+Season", 1)
    ending = lambda d: F.when(d == "1", "st").when(d == "2", "nd").when(d == "3", "rd").otherwise("th")
    in_split = F.when(split != "", F.concat(split, ending(split), F.lit("_split")))
    in_season = F.when(plain.isin("1", "2", "3", "4"), F.concat(plain, ending(plain))).when(plain != "", plain)
    return F.when(t.contains("Split"), in_split).otherwise(in_season)


def classified(title: Column) -> Column:
    """A trimmed title's struct META, or null for a title of no known table. The first rule that fits decides."""
    t = title
    has = lambda *words: has_any(t, *words)

    def meta(table: Column | str, method: Column | str, season: Column | str | None = "all", licence: Column | None = None) -> Column:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
        parts = (("table_type", table), ("method", method), ("season", season), ("license_type", licence), ("raw_title", t))
        return F.struct(*[as_column(v).cast("string").alias(name) for name, v in parts])

    table = F.when(has("Percent Success"), "percent_success").when(has("Recreation Days"), "harvest_rec_days")
    private = F.when(has("Early PLO"), "plo_early").when(has("Late PLO"), "plo_late").otherwise("plo")
    late = has("Late Seasons") & ~F.substring_index(t, "Late Seasons", 1).contains("PLO")
    licence = (
        F.when(has("Antlered") & ~has("Antlerless"), "antlered").when(has("Antlerless"), "antlerless").when(has("Either-sex", "Either Sex"), "either_sex")
    )
    rifle = (
        F.when(has("First", "1st"), "1st").when(has("Second", "2nd"), "2nd").when(has("Third", "3rd"), "3rd").when(has("Fourth", "4th"), "4th").otherwise("all")
    )
    return (
        F.when(has("By DAU", "by DAU", "DAU with", "DAU w "), meta("dau_summary", "all"))
        .when(has("Bosque del Oso"), meta("bosque", "bosque"))
        .when(has("Damage", "AFA", "Auction"), meta("harvest_rec_days", "damage"))
        .when(table.isNull(), F.lit(None).cast(META))
        .when(has("Ranching for Wildlife"), meta(table, "rfw"))
        .when(has("Early High Country"), meta(table, "early_hc"))
        .when(has("PLO Seasons Only", "Private Land Only"), meta(table, private))
        .when(late, meta(table, F.when(has("Includes PLOs"), "late_incl_plo").otherwise("late")))
        .when(has("Limited"), meta(table, "rifle", _season_of_limited(t), licence))
        .when(has("Archery"), meta(table, "archery"))
        .when(has("Muzzle"), meta(table, "muzzleloader"))
        .when(has("Rifle"), meta(table, "rifle", rifle))
        .when(has("All Manners"), meta(table, "all"))
        .otherwise(meta(table, "unknown"))
    )
