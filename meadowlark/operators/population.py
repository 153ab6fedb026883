"""Population reports: herd units with their management units and estimates, parsed from the right."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.functions.patterns import POPULATION_SKIPS, STATEWIDE_TOTAL
from meadowlark.functions.text import has_any, tokens, tried_int, trimmed
from meadowlark.tables import written

COLUMNS = ("year", "species", "dau", "dau_number", "herd_name", "gmus", "population_estimate", "bull_cow_ratio")
_NUMERIC = r"^[\d,]+$"
#: A trailing list of numbers. Nothing in it can match in another way, so its parts never give back: a plain group would
#: recurse once a number and run out of stack on a list of thousands. A list is tried from its first number only.
_UNITS = r"(?<!\d)(?<!\d,\s?)((?:\d++,\s*+)*+\d++)\s*$"


class Report(NamedTuple):
    records: DataFrame
    totals: DataFrame
    quarantine: DataFrame


def raw_lines(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("text").isNotNull()).select(
        "file", "file_ord", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def report_flags(lines: DataFrame) -> DataFrame:
    """Per file: year (the last that a heading names, else the first in the path), has_ratio, has_herd_name, has_text, total.

    One aggregate over all lines; the last matching line wins for year and statewide total.
    """
    at = F.struct("page_no", "line_no")
    year = F.nullif(F.regexp_extract("line", r"(?i)(20\d{2})\s+POST\s+HUNT", 1), F.lit(""))
    total = F.nullif(F.regexp_extract(trimmed(F.col("line")), STATEWIDE_TOTAL, 1), F.lit(""))
    found = lines.groupBy("file", "file_ord").agg(
        F.max_by(year, F.when(year.isNotNull(), at)).alias("line_year"),
        F.bool_or(F.col("line").contains("Bull/Cow") | F.lower("line").contains("ratio")).alias("has_ratio"),
        F.bool_or(has_any(F.col("line"), "Herd Name", "Herd name")).alias("has_herd_name"),
        F.max_by(total, F.when(total.isNotNull(), at)).alias("total"),
        F.bool_or(trimmed(F.col("line")) != "").alias("has_text"),
    )
    from_path = F.nullif(F.regexp_extract("file", r"(20\d{2})", 1), F.lit(""))
    return found.select(
        "file", "file_ord", F.coalesce("line_year", from_path).cast("bigint").alias("year"), "has_ratio", "has_herd_name", "has_text",
        F.coalesce(tried_int(F.col("total")), F.lit(0).cast("bigint")).alias("statewide_total"),
    )


def split_middle(middle: Column) -> Column:
    """(herd_name, gmus): the trailing list of numbers, and what stands before it or, without a list, everything."""
    listed = F.regexp_extract(middle, _UNITS, 1)
    before = trimmed(F.regexp_replace(middle, _UNITS, ""))
    units = F.transform(F.split(listed, ","), lambda x: F.trim(x).try_cast("bigint"))
    none = F.array().cast("array<bigint>")
    name = F.when(listed == "", trimmed(middle)).otherwise(before)
    return F.struct(F.nullif(name, F.lit("")).alias("herd_name"), F.when(listed == "", none).otherwise(units).alias("gmus"))


def population_rows(lines: DataFrame, flags: DataFrame, species: str = "elk") -> DataFrame:
    """Population records, with ``bad`` for rows that fail their whole file.

    A row starts with a number of one or two digits. Its last figures are the estimate and, in reports with ratios, the
    ratio; the middle is the herd's name and its units. A report with ratios takes a row's single trailing figure as the
    estimate, so a row without its ratio takes a unit for it, as the reports' first reader did; ``suspect`` marks rows
    without a comma list that such cases give.
    """
    line = trimmed(F.col("line"))
    rows = (
        lines.withColumn("line", line)
        .where((F.col("line") != "") & ~F.col("line").rlike(STATEWIDE_TOTAL) & ~has_any(F.col("line"), *POPULATION_SKIPS) & ~F.col("line").startswith("*"))
        .where(F.col("line").rlike(r"^\d{1,2}\s+.+$"))
        .withColumn("dau_number", F.regexp_extract("line", r"^(\d{1,2})\s+(.+)$", 1).cast("bigint"))
        .withColumn("t", tokens(F.regexp_replace(F.regexp_extract("line", r"^(\d{1,2})\s+(.+)$", 2), r"\*+", "")))
        .where(F.size("t") > 0)
        .join(flags.select("file", "year", "has_ratio"), "file")
    )
    last, second = F.try_element_at("t", F.lit(-1)), F.try_element_at("t", F.lit(-2))
    is_number = lambda x: F.coalesce(x.rlike(_NUMERIC), F.lit(False))
    rows = rows.where(is_number(last)).withColumn("paired", F.col("has_ratio") & is_number(second))
    ratio = F.when(F.col("paired"), last.try_cast("bigint"))
    estimate = tried_int(F.when(F.col("paired"), second).otherwise(last))
    kept = F.size("t") - F.when(F.col("paired"), 2).otherwise(1)
    parts = rows.withColumn("m", split_middle(F.array_join(F.slice("t", F.lit(1), kept), " ")))
    bad = (F.col("paired") & ratio.isNull()) | estimate.isNull() | F.exists(F.col("m.gmus"), lambda x: x.isNull())
    return parts.select(
        "file", "file_ord", "page_no", "line_no", "year",
        F.lit(species).alias("species"),
        F.concat(F.lit("E-"), F.col("dau_number").cast("string")).alias("dau"),
        "dau_number",
        F.col("m.herd_name").alias("herd_name"),
        F.col("m.gmus").alias("gmus"),
        estimate.alias("population_estimate"),
        ratio.alias("bull_cow_ratio"),
        bad.alias("bad"),
        ((F.size("m.gmus") == 0) | F.coalesce(F.col("m.herd_name").endswith(","), F.lit(False))).alias("suspect"),
    )


def parse_reports(pages: DataFrame, species: str = "elk") -> Report:
    """Population reports from page text. A file without text or year, or with a figure that is no number, gives nothing.

    The files' flags and the rows are written once, and all of the report comes from what was written.
    """
    lines = raw_lines(pages)
    flags = written(report_flags(lines))
    rows = written(population_rows(lines, flags, species))
    no_text = pages.select("file").distinct().join(flags.where("has_text").select("file"), "file", "left_anti").withColumn("reason", F.lit("no text"))
    no_year = flags.where(F.col("year").isNull()).select("file").join(no_text, "file", "left_anti").withColumn("reason", F.lit("no year"))
    bad = rows.where("bad").select("file", "year").distinct().where("year IS NOT NULL").select("file").withColumn("reason", F.lit("bad number"))
    quarantine = no_text.unionByName(no_year).unionByName(bad)
    totals = flags.select("file", "file_ord", "year", F.lit(species).alias("species"), "statewide_total", "has_ratio", "has_herd_name")
    # no row of a failing file is kept, wherever it stands; the failing files are few
    records = rows.where("year IS NOT NULL").join(rows.where("bad").select("file").distinct(), "file", "left_anti").drop("bad")
    return Report(records, totals.join(quarantine.select("file"), "file", "left_anti"), quarantine)


def unit_mapping(records: DataFrame) -> DataFrame:
    """Each file's herd units with their management units (the last record with any wins)."""
    at = F.struct("page_no", "line_no")
    some = records.where(F.size("gmus") > 0)
    return some.groupBy("file", "file_ord", "year", "dau").agg(F.max_by("gmus", at).alias("gmus"), F.max_by("dau_number", at).alias("dau_number"))


def mapping_rows(records: DataFrame) -> DataFrame:
    """One row per year, herd unit and management unit, units in report order (``pos``)."""
    return unit_mapping(records).select("file_ord", "year", "dau", "dau_number", F.posexplode("gmus").alias("pos", "gmu"))


def sum_mismatches(records: DataFrame, totals: DataFrame) -> DataFrame:
    """Files whose records don't add up to the statewide total that they report, if they report one."""
    sums = records.groupBy("file").agg(F.sum("population_estimate").alias("record_total"))
    both = totals.join(sums, "file", "left").withColumn("record_total", F.coalesce("record_total", F.lit(0)))
    return both.where((F.col("statewide_total") != 0) & (F.col("record_total") != F.col("statewide_total")))
