"""Harvest reports: rows of titled sections to typed records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.functions.patterns import (
    BY_SEASON, BY_SEASON_UNIT, HARVEST_ROW, HARVEST_TOTAL, SEASON_ROW, SUCCESS_ROW, SUCCESS_TOTAL, UNIT_ROW,
)
from meadowlark.functions.text import _SPACES, WS, tried_int, unit_id
from meadowlark.operators.sections import in_sections, page_outlines, years_of
from meadowlark.tables import written

HARVEST_COLUMNS = (
    "year", "species", "gmu", "section_method", "section_season", "section_license_type", "bulls", "cows", "calves", "total_harvest", "total_hunters",
    "pct_success", "total_rec_days", "antlered_harvest", "antlered_hunters", "antlered_pct_success", "antlerless_harvest", "antlerless_hunters",
    "antlerless_pct_success", "table_type", "section_title",
)
COUNTS, SPLIT_COUNTS = HARVEST_COLUMNS[6:13], HARVEST_COLUMNS[13:19]
UNIT_COLUMNS = (
    "year", "species", "dau", "total_hunters", "hunters_se", "hunters_lcl", "hunters_ucl", "total_harvest", "harvest_se", "harvest_lcl", "harvest_ucl",
    "pct_success", "total_rec_days", "rec_days_se", "rec_days_lcl", "rec_days_ucl", "sample_rate", "response_rate",
)
_DOUBLES = {"pct_success", "sample_rate", "response_rate"}
ORDER = ("file", "file_ord", "page_no", "line_no")


class Report(NamedTuple):
    """What a set of harvest reports gives: ``files`` (with their years) that could be read, with or without records,
    and in ``quarantine`` those that failed and gave nothing."""

    files: DataFrame
    records: DataFrame
    unit_records: DataFrame
    sections: DataFrame
    quarantine: DataFrame


#: Only lines with such a part can hold a figure that has a row's shape and is no number: too long, or with odd points.
LONG = r"[\d,]{16}"
SUSPECT = rf"{LONG}|\.[\d%]*\.|(?:^|\s)\.%?(?:\s|$)"


def with_rows(sections: DataFrame) -> DataFrame:
    """Section lines with ``row`` (which shape of row, null if none), its ``label`` (the first field), its other fields as
    ``counts`` and, for herd units, ``rates``, ``is_record`` and ``is_bad`` (a figure that is no number)."""
    line, table = F.col("line"), F.col("meta.table_type")
    row = (
        F.when(F.col("is_title"), None)
        .when((table == "harvest_rec_days") & line.rlike(HARVEST_ROW), "harvest")
        .when((table == "percent_success") & line.rlike(SUCCESS_ROW), "success")
        .when((table == "dau_summary") & line.rlike(UNIT_ROW), "unit")
        .when((table == "bosque") & line.rlike(SEASON_ROW), "season")
        .when((table == "bosque") & line.rlike(HARVEST_ROW), "bosque")
    )
    season = F.col("row") == "season"
    # one pass brings all white space to plain spaces and drops the signs that the shapes let through in figures
    even = F.translate(line, _SPACES + ",%", " " * len(_SPACES))
    label = F.when(season, F.regexp_extract(line, f"^({'|'.join(BY_SEASON)}){WS}", 1)).otherwise(F.substring_index("even", " ", 1))
    label_words = F.when(season, F.size(F.split("label", " "))).otherwise(1)
    after = lambda words: F.slice(words, label_words + 1, F.greatest(F.size(words) - label_words, F.lit(0)))
    fields = after(F.split(line, f"{WS}+"))
    plain = lambda x: F.translate(x, ",%", "")
    count = lambda x: F.when(plain(x) == "", F.lit(0).cast("bigint")).otherwise(plain(x).try_cast("bigint"))
    no_number = lambda x: (plain(x) != "") & plain(x).try_cast("double").isNull() | (~x.rlike(r"[.%]") & count(x).isNull())
    # figures of signs alone leave gaps, as do runs of white space: only such lines are taken field by field
    gaps = F.col("even").contains("  ") | F.col("even").endswith(" ")
    rates = F.array(*[F.get("fields", F.lit(k)).try_cast("double") for k, c in enumerate(UNIT_COLUMNS[3:]) if c in _DOUBLES])
    suspect = (line.contains(".") & line.rlike(SUSPECT)) | line.rlike(LONG)
    return (
        sections.withColumn("row", row.cast("string"))
        .withColumn("is_record", F.col("row").isNotNull())
        .withColumn("even", F.when(F.col("is_record"), even))
        .withColumn("label", F.when(F.col("is_record"), label))
        .withColumn("words", F.when(~gaps, F.split("even", " ")))
        .withColumn("fields", F.when(gaps, F.transform(fields, plain)).otherwise(after(F.col("words"))))
        .withColumn("counts", F.when(gaps, F.transform(fields, count)).otherwise(F.col("fields").try_cast("array<bigint>")))
        .withColumn("rates", F.when(F.col("row") == "unit", rates))
        .withColumn("is_bad", F.when(F.col("is_record") & suspect, F.exists(fields, no_number)).otherwise(False))
        .drop("even", "words", "fields")
    )


def _count(k: int) -> Column:
    return F.get("counts", F.lit(k))


def harvest_rows(rows: DataFrame, species: str) -> DataFrame:
    """Harvest records in report order; a success row's counts are 0, other rows' split figures are null."""
    row, label = F.col("row"), F.col("label")
    success, season = row == "success", row == "season"
    names = F.create_map(*[F.lit(x) for k, v in BY_SEASON.items() for x in (k, v[0])])
    seasons = F.create_map(*[F.lit(x) for k, v in BY_SEASON.items() for x in (k, v[1])])
    in_bosque = row.isin("season", "bosque")
    out = {
        "year": F.col("year"),
        "species": F.lit(species),
        "gmu": F.when(season, F.lit(BY_SEASON_UNIT).cast("bigint")).otherwise(tried_int(label)),
        "section_method": F.when(season, F.concat(F.lit("bosque_"), names[label])).when(row == "bosque", "bosque_all").otherwise(F.col("meta.method")),
        "section_season": F.when(season, seasons[label]).when(row == "bosque", "all").otherwise(F.col("meta.season")),
        "section_license_type": F.when(~in_bosque, F.col("meta.license_type")),
        **{c: F.when(success, F.lit(0).cast("bigint")).otherwise(_count(k)) for k, c in enumerate(COUNTS)},
        **{c: F.when(success, _count(k)) for k, c in enumerate(SPLIT_COUNTS)},
        "table_type": F.col("meta.table_type"),
        "section_title": F.col("meta.raw_title"),
    }
    wanted = rows.where(row.isNotNull() & (row != "unit"))
    return wanted.select(*ORDER, "section", *[out[c].alias(c) for c in HARVEST_COLUMNS])


def unit_rows(rows: DataFrame, species: str) -> DataFrame:
    """Herd unit summaries with their confidence intervals."""
    rates = iter(range(len(_DOUBLES)))
    figures = [(F.get("rates", F.lit(next(rates))) if c in _DOUBLES else _count(k)).alias(c) for k, c in enumerate(UNIT_COLUMNS[3:])]
    return rows.where(F.col("row") == "unit").select(*ORDER, "section", "year", F.lit(species).alias("species"), unit_id(F.col("label")).alias("dau"), *figures)


def parse_reports(pages: DataFrame, species: str = "elk") -> Report:
    """Harvest reports from page text (file, file_ord, page_no, text).

    Texts are read twice, for the pages' outlines and for their rows; both are written once, and all of the report comes
    from what was written. A file without a year, or with a figure that is no number, fails as a whole. Repeated titles
    open sections of their own, sections without rows are listed with 0 records, null pages are skipped.
    """
    outlines = written(page_outlines(pages))
    parsed = with_rows(in_sections(pages, outlines))
    # all lines are written, as a filter before would work out titles and shapes of each line again and again
    all_rows = written(parsed.drop("line")).where("is_record OR is_title")
    years = years_of(outlines)
    bad = all_rows.where("is_bad").select("file").distinct().withColumn("reason", F.lit("bad number"))
    rows = all_rows.join(bad.select("file"), "file", "left_anti")
    no_year = years.where(F.col("year").isNull()).select("file", F.lit("no year").alias("reason"))
    sections = (
        rows.groupBy("file", "file_ord", "year", "section")
        .agg(F.max(F.when(F.col("is_title"), F.col("meta"))).alias("meta"), F.sum(F.col("is_record").cast("bigint")).alias("records"))
        .select(
            "file", "file_ord", "year", "section",
            F.substring("meta.raw_title", 1, 80).alias("title"),
            F.col("meta.table_type").alias("type"), "meta.method", "meta.season", "meta.license_type", "records",
        )
    )
    files = years.where(F.col("year").isNotNull()).join(bad.select("file"), "file", "left_anti")
    return Report(files, harvest_rows(rows, species), unit_rows(rows, species), sections, no_year.unionByName(bad))


def section_totals(sections: DataFrame) -> DataFrame:
    """(file, year, section, figure, stated, summed): what a section's last Total row states beside the sum of its rows.

    Percentages don't add up and are left out; a section without a Total row, or without rows, gives nothing. Reports are
    taken as they are: a difference is for reading, no row is dropped for it.
    """
    line, table = F.col("line"), F.col("meta.table_type")
    figures = {"percent_success": SPLIT_COUNTS, "harvest_rec_days": COUNTS, "bosque": COUNTS}
    is_total = F.when(table == "percent_success", line.rlike(SUCCESS_TOTAL)).otherwise(table.isin("harvest_rec_days", "bosque") & line.rlike(HARVEST_TOTAL))
    names = F.create_map(*[x for kind, cs in figures.items() for x in (F.lit(kind), F.array(*[F.lit(c) for c in cs]))])
    fields = F.transform(F.slice(F.split(line, f"{WS}+"), F.lit(2), F.lit(len(COUNTS))), tried_int)
    stated = sections.where(is_total).select("file", "section", F.struct("page_no", "line_no").alias("at"), F.posexplode(fields).alias("pos", "stated"), names[table].alias("names"))
    last = stated.groupBy("file", "section", F.get("names", F.col("pos")).alias("figure")).agg(F.max_by("stated", "at").alias("stated"))
    rows = with_rows(sections).where("is_record AND row <> 'unit'").select("file", "year", "section", F.posexplode("counts").alias("pos", "v"), names[table].alias("names"))
    summed = rows.groupBy("file", "year", "section", F.get("names", F.col("pos")).alias("figure")).agg(F.sum("v").alias("summed"))
    both = summed.join(last, ["file", "section", "figure"]).where(~F.col("figure").contains("pct"))
    return both.select("file", "year", "section", "figure", "stated", "summed")


def app_tables(records: DataFrame) -> DataFrame:
    """The flat table of the app: section columns by their short names, titles dropped."""
    short = {"section_method": "method", "section_season": "season", "section_license_type": "license_type"}
    first = ("year", "species", "gmu", "section_method", "section_season", "section_license_type", "table_type")
    return records.select(*[F.col(c).alias(short.get(c, c)) for c in (*first, *COUNTS, *SPLIT_COUNTS)])


def by_year(records: DataFrame) -> DataFrame:
    """Years with their record counts."""
    return records.groupBy("year").agg(F.count(F.lit(1)).alias("records"))
