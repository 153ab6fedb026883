"""Registered queries that write files and read them back: archives, routed members, per-year files and documents.

Everything is derived from the given tables and goes to the shared folder of the session; the DuckDB statements take the
figures straight from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark.operators import dimensions, harvest, population, sections, serving, trends
from meadowlark.plans import reports
from meadowlark.report_queries import _FIGURES, _HERDS, _SUCCESS, _figures, harvest_pages, population_pages
from meadowlark.sources import archives, json_files, sinks
from meadowlark.sources.writers import local_path
from meadowlark.tables import shared_folder, written

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        _QUERIES[f.__name__], _ORACLES[f.__name__] = f, sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the session ends."""
    path = f"{local_path(shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def _packed(members: DataFrame, folder: str) -> str:
    archives.write_archives(members, folder).write.format("noop").mode("overwrite").save()
    return folder


# ---- archives --------------------------------------------------------------------------------------------------------


@_query("""SELECT doc_id, 'docs_' || doc_id // 500 AS archive, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents""")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts packed into archives of 500 members and read back by ranged reads, several tasks to an archive."""
    docs = _table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs_"), F.floor(F.col("doc_id") / 500)).alias("archive"), F.col("doc_id").alias("member_ord"),
        F.concat(F.lit("texts/"), F.col("doc_id"), F.lit(".txt")).alias("member"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"),
    )
    found = archives.read_members(spark, _packed(docs, _folder(spark, "archives")), run_bytes=1 << 18)
    name = F.regexp_extract("zip_path", r"([^/]+)\.zip$", 1)
    return found.select(F.regexp_extract("member", r"(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), name.alias("archive"), F.length("data").cast("bigint").alias("size"), F.md5("data").alias("digest"))


@_query("""WITH f AS (SELECT s_suppkey AS u, s_suppkey % 7 AS z, s_nationkey AS n FROM supplier)
  SELECT 'harvest_reports' AS category, 'Elk Harvest ' || n || '.pdf' AS name, CAST(arg_max(u, z * 1000000000 + u) AS VARCHAR) AS content, count(*) AS members FROM f GROUP BY n
  UNION ALL SELECT 'population_estimates', 'Elk Herd ' || u || '.PDF', 'herd ' || u, 1 FROM f WHERE u % 2 = 0
  UNION ALL SELECT 'other_elk', 'elk ' || u || '.pdf', 'map', 1 FROM f WHERE u % 3 = 0""")
def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives extracted into three folders; of a name that several archives have, the last member's bytes stand."""
    u = F.col("s_suppkey").cast("bigint")
    of = lambda name, data, step: F.struct(F.concat(*name).alias("member"), data.alias("data"), F.lit(step).alias("step"))
    files = F.array(
        of([F.lit("a/Elk Harvest "), F.col("s_nationkey"), F.lit(".pdf")], u.cast("string"), 0),
        of([F.lit("Elk Herd "), u, F.lit(".PDF")], F.concat(F.lit("herd "), u), 1),
        of([F.lit("b/c/elk "), u, F.lit(".pdf")], F.lit("map"), 2),
        of([F.lit("deer "), u, F.lit(".pdf")], F.lit("deer"), 3),
        of([F.lit("elk "), u, F.lit(".txt")], F.lit("no report"), 4),
    )
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(files).alias("f"))
    wanted = rows.where(((F.col("f.step") != 1) | (u % 2 == 0)) & ((F.col("f.step") != 2) | (u % 3 == 0)))
    members = wanted.select(
        F.concat(F.lit("z"), u % 7).alias("archive"), (u * 8 + F.col("f.step")).alias("member_ord"), "f.member", F.encode("f.data", "utf-8").alias("data")
    )
    zipped, out = _packed(members, _folder(spark, "zipped")), _folder(spark, "routed")
    counts, _ = archives.extract(spark, zipped, out, run_bytes=1 << 12)
    written(counts)
    per_name = archives.categorised(archives.read_members(spark, zipped, with_data=False)).groupBy("name").agg(F.count(F.lit(1)).alias("members"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out)
    part = lambda k: F.element_at(F.split(F.col("path"), "/"), k)
    return read.select(part(-2).alias("category"), part(-1).alias("name"), F.decode("content", "utf-8").alias("content")).join(per_name, "name").select("category", "name", "content", "members")


# ---- per-year files --------------------------------------------------------------------------------------------------


def _reports(spark: SparkSession, sf_dir: str) -> tuple[harvest.Report, population.Report]:
    return harvest.parse_reports(harvest_pages(spark, sf_dir)), population.parse_reports(population_pages(spark, sf_dir))


@_query(f"""SELECT s.year, s.gmu, s.method, s.antlered_harvest AS figure, CAST(NULL AS VARCHAR) AS herd FROM ({_SUCCESS}) s
  UNION ALL SELECT y, 851, 'bosque_all', NULL, NULL FROM (SELECT DISTINCT y FROM {_FIGURES})
  UNION ALL SELECT y, u, 'unit', q, 'E-' || u FROM {_FIGURES}
  UNION ALL SELECT CASE r WHEN 2 THEN 2022 ELSE r + 2010 END, k, 'population', n * 1000, 'E-' || k FROM {_HERDS}""")
def json_files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of per-year JSON files written by name, and combined from the folders; combined documents are left out."""
    h, p = _reports(spark, sf_dir)
    folder = _folder(spark, "json")
    sinks.year_json(sinks.harvest_files(h), f"{folder}/h", "harvest")
    sinks.year_json(sinks.population_files(p), f"{folder}/p", "population")
    sinks.document(sinks.population_master(p), f"{folder}/p/elk_population_combined.json")
    tables = reports.combined_files(spark, f"{folder}/h/*.json", f"{folder}/p/*.json")
    some = tables.harvest.where("table_type = 'percent_success' OR section_method = 'bosque_all'")
    none = F.lit(None).cast("string").alias("herd")
    return (
        some.select("year", "gmu", F.col("section_method").alias("method"), F.col("antlered_harvest").alias("figure"), none)
        .unionByName(tables.unit_summary.select("year", F.substring("dau", 3, 9).cast("bigint").alias("gmu"), F.lit("unit").alias("method"), F.col("total_hunters").alias("figure"), F.col("dau").alias("herd")))
        .unionByName(tables.population.select("year", F.col("dau_number").alias("gmu"), F.lit("population").alias("method"), F.col("population_estimate").alias("figure"), F.col("dau").alias("herd")))
    )


@_query(f"""SELECT 'elk_harvest_' || y || '.csv' AS file, count(*) + 8 AS lines, 9 * CAST(sum(n) AS BIGINT) AS figures FROM {_FIGURES} GROUP BY y
  UNION ALL SELECT 'elk_dau_summary_' || y || '.csv', count(*), CAST(sum(q) AS BIGINT) FROM {_FIGURES} GROUP BY y
  UNION ALL SELECT 'elk_population_' || CASE r WHEN 2 THEN 2022 ELSE r + 2010 END || '.csv', count(*), CAST(sum(n) * 1000 AS BIGINT) FROM {_HERDS} GROUP BY r
  UNION ALL SELECT 'dau_gmu_mapping_' || CASE r WHEN 2 THEN 2022 ELSE r + 2010 END || '.csv', CASE r WHEN 0 THEN 0 ELSE CAST(sum(n) AS BIGINT) END,
    CASE r WHEN 0 THEN 0 ELSE CAST(sum(list_sum(list_transform(string_split(units, ';'), lambda x: CAST(x AS BIGINT)))) AS BIGINT) END FROM {_HERDS} GROUP BY r""")
def csv_files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds of CSV files, one a year, with their data lines and a sum over each; a mapping without rows has its header."""
    h, p = _reports(spark, sf_dir)
    folder = _folder(spark, "csv")
    made = sinks.harvest_csv(h.records, folder) | sinks.unit_csv(h.unit_records, folder) | sinks.population_csv(p.records, folder) | sinks.mapping_csv(p.records, p.totals, folder)
    lines = spark.read.text(f"{folder}/*.csv", lineSep="\r\n").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), "value")
    value = F.from_csv("value", "a string, b string, c string, d string, e string, f string, g string, h string, n string", {"quote": '"'})
    # antlered harvests and the bosque's bulls; hunters; estimates; management units
    bulls, split = F.split("value", ",")[6], F.split("value", ",")[13]
    figure = (
        F.when(F.col("file").startswith("elk_harvest"), F.coalesce(F.nullif(split, F.lit("")), bulls))
        .when(F.col("file").startswith("elk_dau"), value["d"]).when(F.col("file").startswith("elk_population"), value["g"]).otherwise(value["c"])
    )
    data = lines.where(~F.col("value").startswith("year,"))
    named = spark.createDataFrame([(path.rsplit("/", 1)[-1],) for path in made], "file string")  # a row per written file
    sums = data.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(figure.cast("bigint")).alias("figures"))
    return named.join(sums, "file", "left").select("file", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("figures", F.lit(0)).alias("figures"))


# ---- documents -------------------------------------------------------------------------------------------------------


def _two_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population reports, and those of a later year in which even herd units have one unit less."""
    pages = population_pages(spark, sf_dir)
    year = F.when(F.col("file_ord") == 2, 2023).otherwise(F.col("file_ord") + 2030)
    first_unit = F.when(F.col("file_ord") == 0, F.col("text")).otherwise(F.regexp_replace("text", r"(?m)^(\d*[02468] [^\n*]+\*\* )\d+, ", "$1"))
    later = pages.select(
        F.concat(F.lit("later population "), year, F.lit(" "), F.col("file_ord")).alias("file"), (F.col("file_ord") + 10).alias("file_ord"), "page_no",
        F.regexp_replace(first_unit, r"^ELK\n(?:\d+ POST HUNT\n)?", "ELK\n").alias("text"),
    ).withColumn("text", F.concat(F.lit("x "), F.regexp_extract("file", r"(20\d\d)", 1), F.lit(" POST HUNT\n"), F.col("text")))
    return pages.unionByName(later)


_STATES = f"""SELECT 'E-' || k AS dau, CASE WHEN r = 0 THEN 'empty' WHEN k % 2 = 0 AND n > 1 THEN 'filled' ELSE 'absent' END AS history,
  CAST(CASE WHEN r = 0 THEN 0 WHEN k % 2 = 0 AND n > 1 THEN n - 1 ELSE n END AS BIGINT) AS units,
  CAST(CASE WHEN r <> 0 AND k % 2 = 0 AND n > 1 THEN 2 ELSE 0 END AS BIGINT) AS changes FROM {_HERDS}"""


@_query(_STATES)
def history_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Herd units of a written document, read back as variants: whether each history is absent, empty or filled."""
    none = spark.createDataFrame([], "file string, file_ord long, page_no int, text string")
    tables = serving.combine(harvest.parse_reports(none), population.parse_reports(_two_years(spark, sf_dir)))
    pieces = reports.documents(tables, "2024-01-01", "", "").full
    path = sinks.document(pieces, f"{_folder(spark, 'states')}/doc.json").path
    units = json_files.exploded(json_files.read_variants(spark, path), "$.dau_definitions")
    size = lambda at: F.coalesce(F.size(F.try_variant_get("value", at, "array<bigint>")), F.lit(0)).cast("bigint")
    changes = F.coalesce(F.size(F.map_keys(F.try_variant_get("value", "$.gmu_history", "map<string,variant>"))), F.lit(0)).cast("bigint")
    return units.select(F.col("key").alias("dau"), json_files.presence(F.col("value"), "$.gmu_history").alias("history"), size("$.gmus").alias("units"), changes.alias("changes"))


@_query(_STATES)
def definitions_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Herd unit definitions from states of single reports, stored and merged one after another, the last report first."""
    records = population.parse_reports(_two_years(spark, sf_dir)).records
    state = None
    for part in (F.col("file_ord") >= 12, F.col("file_ord") == 1, F.col("file_ord").isin(0, 2, 3, 4), F.col("file_ord").between(10, 11)):
        new = dimensions.definition_state(records.where(part))
        state = written(new if state is None else dimensions.merged_states(state, new))
    found = dimensions.definitions_of(state)
    shown = F.when(F.col("history_state") == "populated", "filled").otherwise(F.col("history_state"))
    changes = F.coalesce(F.size("gmu_history"), F.lit(0)).cast("bigint")
    return found.select("dau", shown.alias("history"), F.size("gmus").cast("bigint").alias("units"), changes.alias("changes"))


_ROWS_OF = f"""(SELECT count(*) + 8 * count(DISTINCT y) AS all_rows, count(*) AS figures FROM {_FIGURES}) f, (SELECT count(*) AS herds FROM {_HERDS}) h"""


@_query(f"""SELECT * FROM (SELECT unnest([
  {{'document': 'elk_combined', 'harvest': all_rows, 'dau_harvest_summary': figures, 'population': herds, 'dau_definitions': herds, 'note': NULL}},
  {{'document': 'elk_combined_slim', 'harvest': 0, 'dau_harvest_summary': NULL, 'population': herds, 'dau_definitions': herds,
    'note': 'Slim version: harvest limited to all-manners/all-seasons harvest_rec_days only'}},
  {{'document': 'elk_dashboard', 'harvest': 0, 'dau_harvest_summary': NULL, 'population': herds, 'dau_definitions': herds,
    'note': 'Dashboard version: harvest by method/season, compact field names'}}], recursive := true) FROM {_ROWS_OF})""")
def written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the three written documents, and a check that their twins, their lists and the observed counts agree."""
    h, p = _reports(spark, sf_dir)
    folder = _folder(spark, "documents")
    done = reports.write_documents(serving.combine(h, p), folder, "2024-01-01", "Colorado", "tables")
    found = json_files.read_items(spark, f"{folder}/*.json").withColumn("document", F.regexp_extract("file", r"([^/]+)\.json$", 1))
    meta = lambda name, kind="bigint": F.try_variant_get("meta", f"$.{name}", kind)
    names = ("harvest", "dau_harvest_summary", "population", "dau_definitions")
    whole_item = F.try_parse_json("value").isNotNull()
    size = lambda path: F.count(F.when((F.col("path") == path) & whole_item, 1)).alias(f"__{path}")
    files = found.groupBy("document").agg(F.max(F.when(F.col("path") == "metadata", F.col("value"))).alias("meta"), size("harvest"), size("population"))
    read = files.withColumn("meta", F.parse_json("meta")).select(
        F.regexp_replace("document", "_pretty$", "").alias("document"), *[meta(f"record_counts.{n}").alias(n) for n in names], meta("note", "string").alias("note"),
        "__harvest", "__population",
    )
    seen = F.create_map(*[F.lit(x) for pair in done.counts.items() for x in pair])
    right = (F.col("harvest") == F.col("__harvest")) & (F.col("population") == F.col("__population"))
    full = F.lit(True)
    for name in names:
        full = full & (F.col(name) == seen[F.lit(name)])
    whole = read.where(right & (full | (F.col("document") != "elk_combined")))
    return whole.groupBy("document", *names, "note").agg(F.count(F.lit(1)).alias("twins")).where("twins = 2").drop("twins")


@_query(f"""WITH herds AS (SELECT *, row_number() OVER (ORDER BY r, k || ' ' || name) - 1 AS pos FROM {_HERDS})
  SELECT 'population' AS document, 'E-' || k AS item, CAST(pos AS BIGINT) AS pos, CAST(CASE r WHEN 0 THEN 0 ELSE n END AS BIGINT) AS figure FROM herds
  UNION ALL SELECT 'totals', CAST(CASE r WHEN 2 THEN 2022 ELSE r + 2010 END AS VARCHAR), row_number() OVER (ORDER BY CASE r WHEN 2 THEN 2022 ELSE r + 2010 END) - 1, CAST(sum(n) * 1000 + r AS BIGINT) FROM herds GROUP BY r
  UNION ALL SELECT 'years', CAST(y AS VARCHAR), row_number() OVER (ORDER BY y) - 1, y FROM (SELECT DISTINCT y FROM {_FIGURES})
  UNION ALL SELECT 'harvest', 'records', 0, count(*) + 8 * count(DISTINCT y) FROM {_FIGURES} UNION ALL SELECT 'harvest', 'dau', 0, count(*) FROM {_FIGURES}""")
def master_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both master documents written and read back: order of records, mappings by key, totals and years in their order."""
    h, p = _reports(spark, sf_dir)
    folder = _folder(spark, "masters")
    paths = [sinks.document(pieces, f"{folder}/{name}.json").path for name, pieces in (("h", sinks.harvest_master(h)), ("p", sinks.population_master(p)))]
    first, second = (json_files.read_items(spark, path) for path in paths)
    body = F.parse_json("value")
    text = lambda path: F.try_variant_get(body, path, "string")
    ordered = json_files.numbered(second.where("path <> 'dau_gmu_mappings'"))
    records = ordered.where("path = 'population_records'").select(text("$.dau").alias("item"), "pos")
    mapped = second.where("path = 'dau_gmu_mappings'").select(text("$.dau").alias("item"), F.size(F.try_variant_get(body, "$.gmus", "array<bigint>")).cast("bigint").alias("figure"))
    whole = F.col("value").cast("bigint")
    years = json_files.numbered(first.where("path = 'years'"))
    count = lambda name, path: first.agg(F.count(F.when((F.col("path") == path) & F.try_parse_json("value").isNotNull(), 1)).alias("figure")).select(F.lit("harvest").alias("document"), F.lit(name).alias("item"), F.lit(0).cast("bigint").alias("pos"), "figure")
    return (
        records.join(mapped, "item", "left").select(F.lit("population").alias("document"), "item", "pos", F.coalesce("figure", F.lit(0)).alias("figure"))
        .unionByName(ordered.where("path = 'statewide_totals'").select(F.lit("totals").alias("document"), F.col("key").alias("item"), "pos", whole.alias("figure")))
        .unionByName(years.select(F.lit("years").alias("document"), F.col("value").alias("item"), "pos", whole.alias("figure")))
        .unionByName(count("records", "harvest_records")).unionByName(count("dau", "dau_records"))
    )


@_query(f"""SELECT y AS year, f.figure, CAST(f.stated AS BIGINT) AS stated, CAST(sum(CASE f.figure WHEN 'antlered_harvest' THEN n WHEN 'antlered_hunters' THEN q * 1000
  WHEN 'antlerless_harvest' THEN q ELSE n + 1 END) AS BIGINT) AS summed
  FROM {_FIGURES}, (VALUES ('antlered_harvest', 1), ('antlered_hunters', 2), ('antlerless_harvest', 4), ('antlerless_hunters', 5)) f(figure, stated) GROUP BY ALL""")
def total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Total rows of success tables beside the sums of their rows."""
    return harvest.section_totals(sections.in_sections(harvest_pages(spark, sf_dir))).select("year", "figure", "stated", "summed")


@_query(f"""SELECT y AS year, 'bosque_rifle' AS method, '2nd' AS season, count(*) AS records, CAST(sum(q) AS BIGINT) AS hunters FROM {_FIGURES} GROUP BY y
  UNION ALL SELECT y, 'rifle', '3rd', count(*), CAST(sum(n) AS BIGINT) FROM {_FIGURES} GROUP BY y""")
def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles are read with repaired ordinals, rows as they stand: a season row with a spaced-out ordinal is none."""
    u, n, q = (F.col(c).cast("string") for c in "unq")
    title = lambda words: F.concat(F.col("y"), F.lit(f" Elk Harvest, Hunters and Recreation Days for {words}\n"))
    row = lambda *cells: F.concat_ws(" ", *[c if isinstance(c, Column) else F.lit(c) for c in cells])
    spaced = F.concat(title("Bosque del Oso"), row("2 n d Rifle", n, n, "0", n, "9", "7", n), F.lit("\n"), row("2nd Rifle", n, n, "0", n, q, "7", n))
    text = F.concat(spaced, F.lit("\n"), title("3 r d Rifle Season"), row(u, n, "0", "0", n, n, "7", n))
    pages = _figures(spark, sf_dir).select(F.concat(F.lit("f"), "y").alias("file"), F.col("y").alias("file_ord"), F.col("u").cast("int").alias("page_no"), text.alias("text"))
    records = harvest.parse_reports(written(pages)).records
    return records.groupBy("year", F.col("section_method").alias("method"), F.col("section_season").alias("season")).agg(F.count(F.lit(1)).alias("records"), F.sum("total_hunters").alias("hunters"))


# ---- keyed quantiles and windows -------------------------------------------------------------------------------------


@_query("""SELECT l_returnflag AS flag, l_linestatus AS status, k AS class, round(q[k], 4) AS break FROM (
  SELECT l_returnflag, l_linestatus, quantile_cont(CAST(l_extendedprice AS DOUBLE), [1/7, 2/7, 3/7, 4/7, 5/7, 6/7]) AS q FROM lineitem GROUP BY ALL), range(1, 7) t(k)""")
def keyed_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact class breaks per pair of flags, from ranks over range partitions."""
    found = trends.quantile_breaks(_table(spark, sf_dir, "lineitem"), "l_extendedprice", 7, ["l_returnflag", "l_linestatus"])
    listed = found.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.posexplode("breaks").alias("k", "b"))
    return listed.select("flag", "status", (F.col("k") + 1).cast("bigint").alias("class"), F.round("b", 4).alias("break"))


@_query("""WITH r AS (SELECT CAST(l_suppkey AS BIGINT) AS g, l_returnflag AS m, l_linestatus AS s, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(l_quantity AS BIGINT) AS v FROM lineitem),
  p AS (SELECT g, m, s, y, sum(v) AS v FROM r GROUP BY ALL UNION ALL SELECT NULL, m, s, y, sum(v) FROM r GROUP BY ALL),
  ys AS (SELECT unnest(range(min(y), max(y) + 1)) AS y FROM r), k AS (SELECT DISTINCT g, m, s FROM p)
  SELECT k.g AS gmu, k.m AS method, k.s AS season, ys.y AS year, n AS years, round(avg(p.v), 6) AS mean FROM k, ys, (VALUES (1), (3), (5)) t(n), p
  WHERE p.g IS NOT DISTINCT FROM k.g AND p.m = k.m AND p.s = k.s AND p.y BETWEEN ys.y - n + 1 AND ys.y GROUP BY ALL""")
def filters_and_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over 1, 3 and 5 years under every filter, per unit and over all, each the difference of two running totals."""
    keys = ("gmu", "method", "season")
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("bigint").alias("gmu"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("season"),
        F.year("l_shipdate").cast("bigint").alias("year"), F.col("l_quantity").cast("bigint").alias("v"),
    )
    totals = written(trends.running_totals(rows, "v", keys))
    out = None
    for n in (1, 3, 5):
        one = trends.means_over(totals, n, keys).select(*keys, "year", F.lit(n).alias("years"), F.round("mean", 6).alias("mean"))
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
