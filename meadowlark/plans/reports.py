"""From page text to the three serving documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark.operators import harvest, population, serving
from meadowlark.sources import json_files, sinks
from meadowlark.tables import written

#: The notes of the two smaller documents.
SLIM_NOTE = "Slim version: harvest limited to all-manners/all-seasons harvest_rec_days only"
DASHBOARD_NOTE = "Dashboard version: harvest by method/season, compact field names"


class Documents(NamedTuple):
    full: DataFrame
    slim: DataFrame
    dashboard: DataFrame


def combined_tables(harvest_pages: DataFrame, population_pages: DataFrame) -> serving.Combined:
    return serving.combine(harvest.parse_reports(harvest_pages), population.parse_reports(population_pages))


def combined_files(spark: SparkSession, harvest_glob: str, population_glob: str) -> serving.Combined:
    """The combined tables from per-year JSON files instead of page text; files without a year are left out."""
    if not json_files.exists(spark, harvest_glob) and not json_files.exists(spark, population_glob):
        raise FileNotFoundError(f"no reports at {harvest_glob} or {population_glob}")
    h, p = json_files.read_items_of(spark, harvest_glob, json_files.HARVEST_FILE), json_files.read_items_of(spark, population_glob, json_files.POPULATION_FILE)
    totals = p.files.select("file", "file_ord", "year", "species", F.coalesce("statewide_total", F.lit(0).cast("bigint")).alias("statewide_total"))
    none, no_section = spark.createDataFrame([], "file string"), F.lit(None)
    records, units = json_files.with_counts(json_files.records_of(h, "harvest_records")), json_files.records_of(h, "dau_records")
    harvest_report = harvest.Report(h.files.select("file", "file_ord", "year"), records.withColumn("section", no_section), units.withColumn("section", no_section), none, none)
    return serving.combine(harvest_report, population.Report(json_files.records_of(p, "records"), totals, none))


def documents(tables: serving.Combined, generated: str, state: str, source: str) -> Documents:
    """The three documents as text pieces; ``generated`` is the date to print."""
    made = (generated, state, source)
    return Documents(
        serving.document_pieces(tables, tables.harvest, *made),
        serving.document_pieces(tables, serving.slim(tables.harvest), *made, note=SLIM_NOTE),
        serving.document_pieces(tables, serving.dashboard(tables.harvest), *made, note=DASHBOARD_NOTE),
    )


class Summary(NamedTuple):
    """What a run has written: files with their bytes, record counts seen while writing, years and the latest figures."""

    files: dict[str, int]
    counts: dict[str, int]
    years: dict[str, list[int]]
    population: tuple[int, int] | None
    harvest: tuple[int, int, int] | None

    def lines(self) -> list[str]:
        """The console summary, files first."""
        out = [f"Wrote: {path} ({sinks.size_text(size)})" for path, size in self.files.items()]
        for kind in ("all", "harvest", "population"):
            if years := self.years[kind]:
                span = f"{years[0]}-{years[-1]}"
                out.append(f"Years: {span}" if kind == "all" else f"{kind.capitalize()} years: {len(years)} ({span})")
        if not self.years["population"]:
            out.append("Population years: 0 (no population data found)")
        out += [f"{name}: {n:,}" for name, n in self.counts.items()]
        if self.population:
            out.append("Latest population ({}): {:,}".format(*self.population))
        if self.harvest:
            out.append("Latest harvest ({}): {:,} ({:,} hunters)".format(*self.harvest))
        return out


#: Items of the full document's parts under the names of the summary.
COUNTED = {"harvest": 5, "dau_harvest_summary": 6, "population": 7, "dau_definitions": 3}


def write_documents(tables: serving.Combined, folder: str, generated: str, state: str, source: str, species: str = "elk") -> Summary:
    """The three serving documents and their indented twins; record counts are taken while the full one is written."""
    docs = documents(tables, generated, state, source)
    names = {"full": f"{species}_combined.json", "slim": f"{species}_combined_slim.json", "dashboard": f"{species}_dashboard.json"}
    full, slim, dashboard = (getattr(docs, kind).withColumn("name", F.lit(name)) for kind, name in names.items())
    made = sinks.documents(written(full.unionByName(slim).unionByName(dashboard)), folder, list(names.values()))
    kinds = tables.years.groupBy("kind").agg(F.array_sort(F.collect_set("year")).alias("years")).collect()  # years of three kinds
    years = {r["kind"]: r["years"] for r in kinds}
    shown = {k: years.get(k, []) for k in ("harvest", "population")}
    population_figures, harvest_figures = (df.first() for df in latest_figures(tables))
    hunters = serving.latest_year(tables.harvest_trend, "total_hunters").first()
    return Summary(
        {d.path: d.size for d in made.values()},
        {name: made[names["full"]].items[part] for name, part in COUNTED.items()},
        shown | {"all": sorted({*shown["harvest"], *shown["population"]})},
        None if population_figures["year"] is None else tuple(population_figures),
        None if harvest_figures["year"] is None else (*harvest_figures, hunters["total_hunters"]),
    )


def write_harvest(report: harvest.Report, folder: str, species: str = "elk") -> sinks.Files:
    """A harvest run's CSV and JSON files per year, and with more than one readable report the master document."""
    out = sinks.harvest_csv(report.records, folder, species) | sinks.unit_csv(report.unit_records, folder, species)
    sinks.year_json(sinks.harvest_files(report), folder, "harvest", species)
    if report.files.limit(2).count() > 1:
        made = sinks.document(sinks.harvest_master(report), f"{folder}/{species}_harvest_combined.json")
        out[made.path] = made.size
    return out


def write_population(report: population.Report, folder: str, species: str = "elk") -> sinks.Files:
    """A population run's CSV, mapping and JSON files per year, and with any readable report the master document."""
    out = sinks.population_csv(report.records, folder, species) | sinks.mapping_csv(report.records, report.totals, folder)
    sinks.year_json(sinks.population_files(report), folder, "population", species)
    if not report.totals.isEmpty():
        made = sinks.document(sinks.population_master(report), f"{folder}/{species}_population_combined.json")
        out[made.path] = made.size
    return out


def write_all(harvest_pages: DataFrame, population_pages: DataFrame, folder: str, generated: str, state: str, source: str) -> Summary:
    """From page text to all files: per-year CSV and JSON, masters and the serving documents, parsed once."""
    h, p = harvest.parse_reports(harvest_pages), population.parse_reports(population_pages)
    files = write_harvest(h, f"{folder}/harvest") | write_population(p, f"{folder}/population")
    done = write_documents(serving.combine(h, p), folder, generated, state, source)
    return done._replace(files=files | done.files)


def latest_figures(tables: serving.Combined) -> tuple[DataFrame, DataFrame]:
    return serving.latest_year(tables.population_trend, "statewide_total"), serving.latest_year(tables.harvest_trend, "total_harvest")
