"""Serving tables and documents: full, slim and dashboard."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.functions.patterns import DASHBOARD_PAIRS
from meadowlark.operators import dimensions, harvest, population, trends

#: Columns of the slim document and short names of the dashboard document.
SLIM_COLUMNS = ("year", "gmu", "bulls", "cows", "calves", "total_harvest", "total_hunters", "pct_success", "total_rec_days")
SHORT_NAMES = {
    "year": "y", "gmu": "g", "section_method": "m", "section_season": "s", "bulls": "b", "cows": "c", "calves": "v", "total_harvest": "h",
    "total_hunters": "n", "pct_success": "p", "total_rec_days": "r",
}
_ORDER = ("file_ord", "page_no", "line_no")


class Combined(NamedTuple):
    """The tables of the combined document; each has its order in file_ord, page_no, line_no or its key."""

    harvest: DataFrame
    unit_summary: DataFrame
    population: DataFrame
    definitions: DataFrame
    lookup: DataFrame
    population_trend: DataFrame
    harvest_trend: DataFrame
    years: DataFrame


def combine(harvest_report: harvest.Report, population_report: population.Report) -> Combined:
    """All reports' tables in one; species and titles go, nothing is de-duplicated.

    Harvest and population years count with every file that has them, herd unit summaries only with records.
    """
    harvest_years = harvest_report.files.select("year").distinct().withColumn("kind", F.lit("harvest"))
    population_years = population_report.totals.select("year").distinct().withColumn("kind", F.lit("population"))
    summary_years = harvest_report.unit_records.select("year").distinct().withColumn("kind", F.lit("unit_summary"))
    definitions = dimensions.unit_definitions(population_report.records)
    return Combined(
        harvest_report.records.drop("section", "section_title", "species"),
        harvest_report.unit_records.drop("section", "species"),
        population_report.records.select("file", *_ORDER, "year", "dau", "dau_number", "herd_name", "population_estimate", "bull_cow_ratio"),
        definitions,
        dimensions.unit_lookup(definitions),
        trends.statewide_population(population_report.totals),
        trends.statewide_harvest(harvest_report.records),
        harvest_years.unionByName(population_years).unionByName(summary_years),
    )


def slim(records: DataFrame) -> DataFrame:
    """Rows over all manners and seasons, core columns only."""
    return records.where(trends.is_overall(records)).select(*SLIM_COLUMNS, *[c for c in _ORDER if c in records.columns])


def dashboard(records: DataFrame) -> DataFrame:
    """Rows of the dashboard's method and season pairs without a licence type, by short names."""
    pairs = F.lit(False)
    for method, season in DASHBOARD_PAIRS:
        pairs = pairs | ((F.col("section_method") == method) & (F.col("section_season") == season))
    kept = records.where((F.col("table_type") == "harvest_rec_days") & F.col("section_license_type").isNull() & pairs)
    return kept.select(*[F.col(c).alias(s) for c, s in SHORT_NAMES.items()], *[c for c in _ORDER if c in records.columns])


def row_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def latest_year(trend: DataFrame, value: str) -> DataFrame:
    """The last year and its value."""
    return trend.agg(F.max("year").alias("year"), F.max_by(value, "year").alias(value))


# ---- documents -------------------------------------------------------------------------------------------------------


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def items(df: DataFrame, part: int, order: list[Column], text: Column, opening: str, closing: str) -> DataFrame:
    """Text pieces of one list or object: its opening, its items with commas between them, its closing."""
    spark = df.sparkSession
    zero = F.lit("").alias("at")
    head = spark.range(1).select(F.lit(part).alias("part"), F.lit(0).alias("step"), zero, F.lit(opening).alias("piece"))
    tail = spark.range(1).select(F.lit(part).alias("part"), F.lit(2).alias("step"), zero, F.lit(closing).alias("piece"))
    key = F.concat_ws("/", *[F.lpad(c.cast("string"), 20, "0") for c in order])
    rows = df.select(F.lit(part).alias("part"), F.lit(1).alias("step"), key.alias("at"), text.alias("piece"))
    return head.unionByName(rows).unionByName(tail)


def definition_json(definitions: DataFrame) -> Column:
    """A herd unit's JSON object; gmu_history is left out, empty or filled as history_state says."""
    core = F.struct("dau_number", "herd_name", "gmus", "years_present")
    plain = _json(core)
    history = F.when(F.col("history_state") == "empty", F.lit(',"gmu_history":{}}')).when(
        F.col("history_state") == "populated", F.concat(F.lit(',"gmu_history":'), F.to_json("gmu_history"), F.lit("}"))
    )
    return F.when(history.isNull(), plain).otherwise(F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), history))


def document_pieces(tables: Combined, harvest_rows: DataFrame, generated: str, state: str, source: str, note: str | None = None, species: str = "elk") -> DataFrame:
    """The serving document as ordered text pieces (part, step, at, piece); in order they are one JSON object.

    ``harvest_rows``: all, slim or dashboard rows. With a ``note``, the herd unit summaries and their count are left out,
    as in the slim and dashboard documents.
    """
    rows = [F.col("file_ord"), F.col("page_no"), F.col("line_no")]
    body = [c for c in harvest_rows.columns if c not in ("file", *_ORDER)]
    full = note is None
    counted = {"harvest": harvest_rows, **({"dau_harvest_summary": tables.unit_summary} if full else {}), "population": tables.population, "dau_definitions": tables.definitions}
    counts = row_counts(**counted).agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("counts"))
    kinds = tables.years.groupBy().agg(
        F.array_sort(F.collect_set("year")).alias("years"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "harvest", F.col("year")))).alias("harvest_years"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "population", F.col("year")))).alias("population_years"),
    )
    meta = kinds.crossJoin(counts).select(  # one row each
        F.struct(
            F.lit(species).alias("species"), F.lit(state).alias("state"), F.lit(source).alias("source"), "years", "harvest_years", "population_years",
            F.lit(generated).alias("generated"), F.struct(*[F.col("counts")[k].alias(k) for k in counted]).alias("record_counts"),
            *([] if full else [F.lit(note).alias("note")]),
        ).alias("m")
    )
    quoted = lambda key: F.concat(F.lit('"'), F.col(key).cast("string"), F.lit('":'))
    totals = [c for c in tables.harvest_trend.columns if c != "year"]
    parts = [
        items(meta, 0, [F.lit(0)], _json(F.col("m")), '{"metadata":', ',"statewide_trends":{"population":{'),
        items(tables.population_trend, 1, [F.col("year")], F.concat(quoted("year"), F.col("statewide_total").cast("string")), "", '},"harvest":{'),
        items(tables.harvest_trend, 2, [F.col("year")], F.concat(quoted("year"), _json(F.struct(*totals))), "", '}},"dau_definitions":{'),
        items(tables.definitions, 3, [F.col("first_seen")[c] for c in _ORDER], F.concat(quoted("dau"), definition_json(tables.definitions)), "", '},"gmu_to_dau":{'),
        items(tables.lookup, 4, [F.col("gmu")], F.concat(quoted("gmu"), F.lit('"'), F.col("dau"), F.lit('"')), "", '},"harvest":['),
        items(harvest_rows, 5, rows, _json(F.struct(*body)), "", "]," + ('"dau_harvest_summary":[' if full else '"population":[')),
    ]
    if full:
        own = [c for c in tables.unit_summary.columns if c not in ("file", *_ORDER)]
        parts.append(items(tables.unit_summary, 6, rows, _json(F.struct(*own)), "", '],"population":['))
    own = [c for c in tables.population.columns if c not in ("file", *_ORDER)]
    parts.append(items(tables.population, 7, rows, _json(F.struct(*own)), "", "]}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
