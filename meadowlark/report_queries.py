"""Registered queries over rendered reports: every table, page and line kind of both report families, parsed back.

Harvest reports are rendered from line items, one per ship year: contents and methodology pages, success, herd unit, bosque
and empty tables. Population reports are rendered from suppliers by region. Equal DuckDB statements take the figures
straight from the tables. Rendered pages are written first, as the files that a source would read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark.functions.patterns import BY_SEASON, BY_SEASON_UNIT
from meadowlark.functions.text import parsed_float, trimmed
from meadowlark.operators import harvest, population, sections, serving, trends
from meadowlark.sources import archives, sinks
from meadowlark.tables import written

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        _QUERIES[f.__name__], _ORACLES[f.__name__] = f, sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ship year (moved into this century), supplier, line items, quantity.
_FIGURES = """(SELECT CAST(year(l_shipdate) + 10 AS BIGINT) AS y, CAST(l_suppkey AS BIGINT) AS u, count(*) AS n,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)"""
_YEARS = f"(SELECT y, CAST(sum(n) AS BIGINT) AS n FROM {_FIGURES} GROUP BY y)"


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy(
        (F.year("l_shipdate") + 10).cast("bigint").alias("y"), F.col("l_suppkey").cast("bigint").alias("u")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))


def _thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def _row(*cells) -> Column:
    return F.concat_ws(" ", *[c if isinstance(c, Column) else F.lit(c) for c in cells])


def harvest_pages(spark: SparkSession, sf_dir: str, bad_years: bool = False) -> DataFrame:
    """One report per year of seven pages; with ``bad_years``, years that 3 divides have a rate that is no number."""
    figures = written(_figures(spark, sf_dir))  # six kinds of pages come from them
    u, n, q, y = (F.col(c) for c in "unqy")
    year = y.cast("string")

    def paged(rows: DataFrame, page: int, row: Column, title: str, heading: str, total: Column | None = None) -> DataFrame:
        body = rows.select("y", row.alias("row")).groupBy("y").agg(F.array_join(F.sort_array(F.collect_list("row")), "\n").alias("rows"))
        ending = F.lit("") if total is None else F.concat(F.lit("\n"), total)
        return body.select("y", F.lit(page).alias("page_no"), F.concat(year, F.lit(f" Elk {title}\n {heading}\n\n"), F.col("rows"), ending).alias("text"))

    success = _row(u, n, _thousands(q * 1000), n % 100, _thousands(q), n + 1, q % 100)
    rate = F.when(F.lit(bad_years) & (y % 3 == 0), "0.1.2").otherwise("0.125")
    interval = _row(_thousands(q), n, "1", "2,345")
    unit = _row(F.concat(F.lit("E-0"), u), interval, interval, F.concat((n % 100).cast("string"), F.lit(".5%")), interval, rate, "0.5")
    years = figures.groupBy("y").agg(F.sum("n").alias("n"))
    labels = F.explode(F.array(*[F.lit(x) for x in BY_SEASON]))
    seasons = years.select("y", "n", labels.alias("label")).select("y", _row(F.col("label"), n, n + 1, "0", "3", _thousands(n * 1000), "7", n).alias("row"))
    whole = years.select("y", _row(str(BY_SEASON_UNIT), n, "0", "0", n, "9", "8", "7").alias("row"))
    dots = "\n".join(f"Table {k} ........ {k}" for k in range(8))
    contents = years.where("y % 2 = 0").select("y", F.lit(0).alias("page_no"), F.concat(year, F.lit(f" Colorado Elk Report\n{dots}")).alias("text"))
    method = years.select("y", F.lit(1).alias("page_no"), F.lit("Methodology\na stratified random sample of 2001 Elk hunters").alias("text"))
    empty = years.select("y", F.lit(6).alias("page_no"), F.concat(year, F.lit(" Elk Harvest, Hunters and Recreation Days for Archery Seasons that this title goes on about at length\nUnit Bulls Cows Calves\nno rows here\n12")).alias("text"))
    pages = (
        contents.unionByName(method.where("y % 2 = 0"))
        .unionByName(paged(figures, 2, success, "Harvest, Hunters and Percent Success for Limited Antlered 2 n d Season", "Antlered Antlered", _row("Total", "1", "2", "3", "4", "5", "6")))
        .unionByName(paged(figures, 3, unit, "Harvest by DAU with Confidence Intervals", "DAU estimate"))
        .unionByName(paged(seasons.unionByName(whole), 4, F.col("row"), "Harvest, Hunters and Recreation Days for Bosque del Oso", "Season"))
        .unionByName(empty)
    )
    return written(pages.select(F.concat(F.lit("report_"), F.col("y") % 100).alias("file"), F.col("y").alias("file_ord"), "page_no", "text"))


_SUCCESS = f"""SELECT y AS year, u AS gmu, 'rifle' AS method, '2nd' AS season, 'antlered' AS license_type, 'percent_success' AS table_type,
  CAST(0 AS BIGINT) AS bulls, CAST(0 AS BIGINT) AS total_harvest, n AS antlered_harvest, q * 1000 AS antlered_hunters, n % 100 AS antlered_pct_success,
  q AS antlerless_harvest, n + 1 AS antlerless_hunters, q % 100 AS antlerless_pct_success FROM {_FIGURES}"""


@_query(_SUCCESS)
def success_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success tables (their total row is no record) as the app's flat rows."""
    flat = harvest.app_tables(harvest.parse_reports(harvest_pages(spark, sf_dir)).records).where("table_type = 'percent_success'")
    return flat.select(
        "year", "gmu", "method", "season", "license_type", "table_type", "bulls", "total_harvest", "antlered_harvest", "antlered_hunters",
        "antlered_pct_success", "antlerless_harvest", "antlerless_hunters", "antlerless_pct_success",
    )


@_query(f"""SELECT y AS year, 'elk' AS species, 'E-' || u AS dau, q AS total_hunters, n AS hunters_se, CAST(1 AS BIGINT) AS hunters_lcl, CAST(2345 AS BIGINT) AS hunters_ucl,
  q AS total_harvest, n AS harvest_se, CAST(n % 100 + 0.5 AS DOUBLE) AS pct_success, q AS total_rec_days, CAST(2345 AS BIGINT) AS rec_days_ucl,
  CAST(0.125 AS DOUBLE) AS sample_rate, CAST(0.5 AS DOUBLE) AS response_rate FROM {_FIGURES}""")
def unit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = harvest.parse_reports(harvest_pages(spark, sf_dir)).unit_records
    return found.select(
        "year", "species", "dau", "total_hunters", "hunters_se", "hunters_lcl", "hunters_ucl", "total_harvest", "harvest_se", "pct_success", "total_rec_days",
        "rec_days_ucl", "sample_rate", "response_rate",
    )


_SEASONS = ", ".join(f"('bosque_{m}', '{s}')" for m, s in BY_SEASON.values())


@_query(f"""SELECT y AS year, CAST({BY_SEASON_UNIT} AS BIGINT) AS gmu, m AS section_method, s AS section_season, n AS bulls, n + 1 AS cows, CAST(0 AS BIGINT) AS calves,
  CAST(3 AS BIGINT) AS total_harvest, n * 1000 AS total_hunters, CAST(7 AS BIGINT) AS pct_success, n AS total_rec_days FROM {_YEARS}, (VALUES {_SEASONS}) t(m, s)
  UNION ALL SELECT y, {BY_SEASON_UNIT}, 'bosque_all', 'all', n, 0, 0, n, 9, 8, 7 FROM {_YEARS}""")
def bosque_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = harvest.parse_reports(harvest_pages(spark, sf_dir)).records.where("table_type = 'bosque'")
    return records.select("year", "gmu", "section_method", "section_season", *harvest.COUNTS)


_LONG = "Elk Harvest, Hunters and Recreation Days for Archery Seasons that this title goes on about at length"


@_query(f"""SELECT y AS year, t.title, t.type, t.method, t.season, t.licence AS license_type, CAST(CASE t.type WHEN 'bosque' THEN 8 WHEN 'harvest_rec_days' THEN 0 ELSE s.k END AS BIGINT) AS records
  FROM (SELECT y, count(*) AS k FROM {_FIGURES} GROUP BY y) s, LATERAL (VALUES
  (y || ' Elk Harvest, Hunters and Percent Success for Limited Antlered 2nd Season', 'percent_success', 'rifle', '2nd', 'antlered'),
  (y || ' Elk Harvest by DAU with Confidence Intervals', 'dau_summary', 'all', 'all', NULL),
  (y || ' Elk Harvest, Hunters and Recreation Days for Bosque del Oso', 'bosque', 'bosque', 'all', NULL),
  (left(y || ' {_LONG}', 80), 'harvest_rec_days', 'archery', 'all', NULL)) t(title, type, method, season, licence)""")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their record counts; contents and methodology pages open none, empty sections count 0."""
    found = harvest.parse_reports(harvest_pages(spark, sf_dir)).sections
    return found.select("year", "title", "type", "method", "season", "license_type", "records")


@_query(f"""SELECT 'report_' || (y % 100) AS file, y AS year FROM {_YEARS}""")
def report_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years from contents pages where there are any, else from the first titled line."""
    return sections.report_years(harvest_pages(spark, sf_dir)).select("file", "year")


@_query(f"""SELECT 'report_' || (y % 100) AS file, 'bad number' AS reason FROM {_YEARS} WHERE y % 3 = 0
  UNION ALL SELECT 'unnamed_' || u, 'no year' FROM (SELECT DISTINCT u FROM {_FIGURES})""")
def failing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that fail as a whole, beside those that don't."""
    unnamed = _figures(spark, sf_dir).select(F.concat(F.lit("unnamed_"), F.col("u")).alias("file"), F.col("u").alias("file_ord"), F.lit(0).alias("page_no"), F.lit("Elk\n1 2").alias("text")).distinct()
    return harvest.parse_reports(harvest_pages(spark, sf_dir, bad_years=True).unionByName(unnamed)).quarantine


@_query(f"""SELECT 'report_' || (y % 100) AS file, line, CAST(n AS BIGINT) AS n FROM {_YEARS.replace("n FROM", "m FROM")}, (VALUES ('no rows here', 1)) t(line, n)""")
def unparsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sections without records that are no headings."""
    rows = harvest.with_rows(sections.in_sections(harvest_pages(spark, sf_dir)))
    return sections.unparsed_lines(rows).groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH w AS (SELECT trim(unnest(string_split(comment, chr(10)))) AS line FROM (SELECT CASE l_linenumber WHEN 1 THEN 'Unit Bulls Cows Calves' WHEN 2 THEN 'Success' WHEN 3 THEN '* a note'
  WHEN 4 THEN 'Data Analysis Unit Map' WHEN 5 THEN 'Rate of it' ELSE CAST(l_suppkey AS VARCHAR) END AS comment FROM lineitem))
  SELECT line IN ('Unit Bulls Cows Calves', 'Success', '* a note', 'Data Analysis Unit Map') AS heading, count(*) AS n FROM w GROUP BY 1""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    line = F.when(k == 1, "Unit Bulls Cows Calves").when(k == 2, "Success").when(k == 3, "* a note").when(k == 4, "Data Analysis Unit Map").when(k == 5, "Rate of it").otherwise(F.col("l_suppkey").cast("string"))
    return _table(spark, sf_dir, "lineitem").select(sections.is_heading(trimmed(line)).alias("heading")).groupBy("heading").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 ELSE CAST(l_extendedprice AS DOUBLE) END AS value FROM lineitem""")
def float_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal figures with thousands separators and white space; a dash is 0."""
    text = F.when(F.col("l_linenumber") == 1, " - ").otherwise(F.concat(F.lit(" "), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), F.lit(" ")))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parsed_float(text).alias("value"))


# ---- population reports ----------------------------------------------------------------------------------------------

#: Region, nation, its suppliers and their count; regions 1 and 3 report ratios.
_HERDS = """(SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS k, n_name || CASE n_regionkey WHEN 0 THEN ' Herd' ELSE '' END AS name, count(s_suppkey) AS n,
  string_agg(CAST(s_suppkey AS VARCHAR), ';' ORDER BY s_suppkey) AS units FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def population_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A population report per region: skipped headings, footnote marks, rows with and without ratios and units."""
    suppliers, nations = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    herds = nations.join(suppliers, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey", "n_name")
    herds = herds.agg(F.array_sort(F.collect_list("s_suppkey")).alias("g"))
    r, k, n = F.col("n_regionkey"), F.col("n_nationkey"), F.size("g")
    paired = r % 2 == 1
    units = F.when(r == 0, "").otherwise(F.concat(F.array_join(F.col("g").cast("array<string>"), ", "), F.lit(" ")))
    line = F.concat(k, F.lit(" "), F.col("n_name"), F.when(r == 0, " Herd").otherwise(""), F.lit("** "), units, _thousands(n * 1000), F.when(paired, F.concat(F.lit(" "), n)).otherwise(""))
    rows = herds.select("n_regionkey", line.alias("line"), n.alias("n")).groupBy("n_regionkey")
    body = rows.agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("rows"), (F.sum("n") * 1000).alias("all"))
    heading = F.concat(F.lit("ELK\n"), F.when(r != 2, F.concat(r + 2010, F.lit(" POST HUNT\n"))).otherwise(""), F.when(paired, "Bull/Cow\nHerd Name\n").otherwise("Game Management Units\n"))
    text = F.concat(heading, F.lit("** DAU note\n99 Colorado Parks 5\n"), F.col("rows"), F.lit("\nTotal Statewide Estimate "), _thousands(F.col("all") + r))
    return written(body.select(F.concat(F.lit("2022 population "), r).alias("file"), r.alias("file_ord"), F.lit(0).alias("page_no"), text.alias("text")))


@_query(f"""SELECT CASE r WHEN 2 THEN 2022 ELSE r + 2010 END AS year, 'E-' || k AS dau, k AS dau_number, name AS herd_name, CASE r WHEN 0 THEN '' ELSE units END AS units,
  n * 1000 AS population_estimate, CASE WHEN r % 2 = 1 THEN n END AS bull_cow_ratio FROM {_HERDS}""")
def population_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = population.parse_reports(population_pages(spark, sf_dir)).records
    joined = F.array_join(F.col("gmus").cast("array<string>"), ";")
    return found.select("year", "dau", "dau_number", "herd_name", joined.alias("units"), "population_estimate", "bull_cow_ratio")


@_query(f"""SELECT r AS file_ord, CASE r WHEN 2 THEN 2022 ELSE r + 2010 END AS year, r % 2 = 1 AS has_ratio, r % 2 = 1 AS has_herd_name,
  CAST(sum(n) * 1000 + r AS BIGINT) AS statewide_total FROM {_HERDS} GROUP BY r""")
def population_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = population.parse_reports(population_pages(spark, sf_dir)).totals
    return totals.select(F.col("file_ord").cast("bigint").alias("file_ord"), "year", "has_ratio", "has_herd_name", "statewide_total")


@_query(f"""SELECT 'E-' || k AS dau, CAST(CASE r WHEN 2 THEN 2022 ELSE r + 2010 END AS BIGINT) AS year, CAST(n * 1000 AS BIGINT) AS population_estimate FROM {_HERDS}""")
def herd_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.herd_population(population.parse_reports(population_pages(spark, sf_dir)).records)


def _combined(spark: SparkSession, sf_dir: str) -> serving.Combined:
    return serving.combine(harvest.parse_reports(harvest_pages(spark, sf_dir)), population.parse_reports(population_pages(spark, sf_dir)))


@_query(f"""SELECT y AS year, kind FROM {_YEARS}, (VALUES ('harvest'), ('unit_summary')) t(kind)
  UNION SELECT CASE r WHEN 2 THEN 2022 ELSE r + 2010 END, 'population' FROM {_HERDS}""")
def combined_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir).years.select("year", "kind")


@_query(f"""SELECT 1 AS part, '"' || (CASE r WHEN 2 THEN 2022 ELSE r + 2010 END) || '":' || CAST(sum(n) * 1000 + r AS BIGINT) AS piece FROM {_HERDS} GROUP BY r
  UNION ALL SELECT 7, '{{"year":' || (CASE r WHEN 2 THEN 2022 ELSE r + 2010 END) || ',"dau":"E-' || k || '","dau_number":' || k || ',"herd_name":"' || name || '","population_estimate":' || n * 1000
  || ',"bull_cow_ratio":' || coalesce(CASE WHEN r % 2 = 1 THEN CAST(n AS VARCHAR) END, 'null') || '}}' FROM {_HERDS}
  UNION ALL SELECT 6, CAST(count(*) AS VARCHAR) FROM {_FIGURES}""")
def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full document's population trend and population records as JSON text, and how many herd unit summaries it has."""
    tables = _combined(spark, sf_dir)
    items = serving.document_pieces(tables, tables.harvest, "2024-01-01", "Colorado", "tables").where("step = 1")
    counted = items.where("part = 6").agg(F.count(F.lit(1)).cast("string").alias("piece")).select(F.lit(6).alias("part"), "piece")
    return items.where("part IN (1, 7)").select("part", "piece").unionByName(counted)


@_query(f"""SELECT 'E-' || k AS dau, CAST(r AS VARCHAR) || '_E-' || k AS key, n * 1000 AS population_estimate FROM (SELECT CASE r WHEN 2 THEN 2022 ELSE r + 2010 END AS r, k, n FROM {_HERDS} WHERE r <> 0)""")
def master_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of the population master document: herd units with management units, keyed by year and unit."""
    records = population.parse_reports(population_pages(spark, sf_dir)).records
    keyed = sinks.keyed_mapping(records).join(records.select("file", "dau", "population_estimate"), ["file", "dau"])
    return keyed.select("dau", "key", "population_estimate")


# ---- archives and the app --------------------------------------------------------------------------------------------


@_query("""WITH f AS (SELECT s_suppkey % 6 AS k FROM supplier)
  SELECT CASE k WHEN 0 THEN 'harvest_reports' WHEN 1 THEN 'population_estimates' WHEN 2 THEN 'other_elk' WHEN 3 THEN 'harvest_reports' ELSE 'skipped' END AS category, count(*) AS n
  FROM f WHERE k <> 5 GROUP BY 1""")
def archive_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives by name: harvest before population before other elk files; no PDF is no member."""
    names = ("a/2019 Elk Harvest Status.PDF", "b/Elk_Population.pdf", "elk map.pdf", "x/ELK hunting.pdf", "deer harvest.pdf", "elk harvest.txt")
    member = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    members = _table(spark, sf_dir, "supplier").select(
        F.lit("z").alias("zip_path"), F.col("s_suppkey").cast("int").alias("member_ord"), member.alias("member"), F.lit(b"").alias("data"), F.lit(None).cast("string").alias("error")
    )
    return archives.category_counts(archives.categorised(members)).select("category", F.col("members").alias("n"))


@_query("""SELECT CAST(year(l_shipdate) AS BIGINT) AS y, CASE l_returnflag WHEN 'A' THEN 'all' WHEN 'N' THEN 'archery' ELSE 'rifle' END AS m,
  CASE l_linestatus WHEN 'F' THEN 'all' ELSE '1st' END AS s, CAST(l_quantity AS BIGINT) AS b FROM lineitem WHERE l_suppkey = 7 AND l_linenumber <= 5
  AND NOT (l_linestatus <> 'F' AND l_returnflag <> 'R')""")
def unit_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One management unit's rows of the dashboard."""
    from meadowlark.queries import _as_records

    return trends.unit_detail(serving.dashboard(_as_records(_table(spark, sf_dir, "lineitem"))), 7).select("y", "m", "s", "b")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
