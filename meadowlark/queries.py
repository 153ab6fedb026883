"""Registered queries: every report operator on the driver's tables, with an equal DuckDB statement.

The tables are no wildlife reports. Each query brings a table to the shape that an operator expects (or renders report
text from it) and applies the operator over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark import file_queries, report_queries
from meadowlark.functions.patterns import HARVEST_ROW
from meadowlark.functions.text import has_any, parsed_int, repaired_ordinals, tokens, unit_id
from meadowlark.functions.titles import classified
from meadowlark.operators import dimensions, harvest, population, relational, sections, serving, trends
from meadowlark.tables import written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(column: str) -> Column:
    return F.col(column).cast("bigint")


def _as_records(lineitem: DataFrame) -> DataFrame:
    """Line items as harvest records: flag and status stand for method and season, quantities for animals."""
    quantity = _whole("l_quantity")
    return lineitem.select(
        F.lit("one").alias("file"),
        F.lit(0).alias("file_ord"),
        F.year("l_shipdate").cast("bigint").alias("year"),
        _whole("l_suppkey").alias("gmu"),
        F.when(F.col("l_returnflag") == "A", "all").when(F.col("l_returnflag") == "N", "archery").otherwise("rifle").alias("section_method"),
        F.when(F.col("l_linestatus") == "F", "all").otherwise("1st").alias("section_season"),
        F.when(F.col("l_linenumber") > 5, "antlered").alias("section_license_type"),
        F.lit("harvest_rec_days").alias("table_type"),
        quantity.alias("bulls"),
        _whole("l_linenumber").alias("cows"),
        (quantity % 3).alias("calves"),
        (quantity + F.col("l_linenumber")).alias("total_harvest"),
        (quantity * 2).alias("total_hunters"),
        (quantity % 100).alias("pct_success"),
        (quantity * F.col("l_linenumber")).alias("total_rec_days"),
    )


_RECORDS = """(SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(l_suppkey AS BIGINT) AS gmu,
  CASE l_returnflag WHEN 'A' THEN 'all' WHEN 'N' THEN 'archery' ELSE 'rifle' END AS m,
  CASE l_linestatus WHEN 'F' THEN 'all' ELSE '1st' END AS s,
  CASE WHEN l_linenumber > 5 THEN 'antlered' END AS lic,
  CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem)"""


@_query(f"""SELECT year, CAST(sum(q + ln) AS BIGINT) AS total_harvest, CAST(sum(q * 2) AS BIGINT) AS total_hunters, CAST(sum(q) AS BIGINT) AS total_bulls,
  CAST(sum(ln) AS BIGINT) AS total_cows, CAST(sum(q % 3) AS BIGINT) AS total_calves, CAST(sum(q * ln) AS BIGINT) AS total_rec_days, count(*) AS gmu_count
  FROM {_RECORDS} WHERE m = 'all' AND s = 'all' GROUP BY year""")
def statewide_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.statewide_harvest(_as_records(_table(spark, sf_dir, "lineitem")))


def rendered_pages(lineitem: DataFrame) -> DataFrame:
    """A harvest report per ship year as page text: a title page, then one page of rows per supplier."""
    quantity = _whole("l_quantity")
    thousands = lambda c: F.format_number(c, 0)
    row = F.concat_ws(
        " ", _whole("l_suppkey"), thousands(quantity), F.col("l_linenumber"), quantity % 3, thousands(quantity * 1000), thousands(quantity * 2), quantity % 100, thousands(_whole("l_extendedprice"))
    )
    year = F.year("l_shipdate") + 10  # reports are of this century
    rows = lineitem.select(year.alias("year"), (_whole("l_suppkey") + 1).cast("int").alias("page_no"), row.alias("row"))
    pages = rows.groupBy("year", "page_no").agg(F.array_join(F.sort_array(F.collect_list("row")), "\n").alias("text"))
    title = F.concat(F.col("year"), F.lit(" Elk Harvest, Hunters and Recreation Days for All Manners of Take\n Total Total Percent Total\n12\n"))
    heads = rows.select("year").distinct().select("year", F.lit(0).alias("page_no"), title.alias("text"))
    return heads.unionByName(pages).select(
        F.concat(F.lit("report_"), F.col("year")).alias("file"), F.col("year").cast("bigint").alias("file_ord"), "page_no", "text"
    )


@_query("""SELECT CAST(year(l_shipdate) + 10 AS BIGINT) AS year, CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS total_harvest,
  CAST(sum(CAST(l_quantity AS BIGINT) * 2) AS BIGINT) AS total_hunters, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_bulls,
  CAST(sum(l_linenumber) AS BIGINT) AS total_cows, CAST(sum(CAST(l_quantity AS BIGINT) % 3) AS BIGINT) AS total_calves,
  CAST(sum(CAST(trunc(l_extendedprice) AS BIGINT)) AS BIGINT) AS total_rec_days, count(*) AS gmu_count FROM lineitem GROUP BY 1""")
def report_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report text, sections, rows and the statewide trend, end to end."""
    return trends.statewide_harvest(harvest.parse_reports(written(rendered_pages(_table(spark, sf_dir, "lineitem")))).records)


@_query("""SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS BIGINT) AS unit, CAST(floor(l_extendedprice) AS BIGINT) AS price,
  CAST(l_quantity AS BIGINT) AS quantity FROM lineitem""")
def line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat_ws(" ", _whole("l_suppkey"), _whole("l_quantity"), F.lit("0"), F.lit("1"), F.format_number(F.floor("l_extendedprice"), 0), F.lit("2"), F.lit("3"), F.lit("4 ")).alias("line"),
    )
    cells = lines.where(F.col("line").rlike(HARVEST_ROW)).withColumn("c", tokens(F.col("line")))
    return cells.select("l_orderkey", "l_linenumber", parsed_int(F.get("c", F.lit(0))).alias("unit"), parsed_int(F.get("c", F.lit(4))).alias("price"), parsed_int(F.get("c", F.lit(1))).alias("quantity"))


@_query("""SELECT CASE l_linenumber WHEN 1 THEN '1st Season' WHEN 2 THEN '2 s t Season' ELSE l_linenumber || ' s t Season' END AS title, count(*) AS n
  FROM lineitem GROUP BY 1""")
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat(F.col("l_linenumber").cast("string"), F.lit(" s t Season"))
    return _table(spark, sf_dir, "lineitem").select(repaired_ordinals(spaced).alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


_TITLES = (
    ("Recreation Days for All Manners of Take", "harvest_rec_days", "all", "all", None),
    ("Percent Success for Limited Antlered 2nd Season", "percent_success", "rifle", "2nd", "antlered"),
    ("Recreation Days for Third Rifle Season", "harvest_rec_days", "rifle", "3rd", None),
    ("by DAU with Confidence Intervals", "dau_summary", "all", "all", None),
    ("Recreation Days for Late Seasons (Includes PLOs)", "harvest_rec_days", "late_incl_plo", "all", None),
    ("Percent Success for Damage Hunts", "harvest_rec_days", "damage", "all", None),
    ("Percent Success for Limited Either-sex 4th Split", "percent_success", "rifle", "4th_split", "either_sex"),
    ("Recreation Days for Private Land Only Late PLO", "harvest_rec_days", "plo_late", "all", None),
    ("Confidence of Nothing", None, None, None, None),
)


def _sql(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


@_query(
    "SELECT p_partkey, "
    + ", ".join(f"CASE p_size % {len(_TITLES)} " + " ".join(f"WHEN {k} THEN {_sql(t[i])}" for k, t in enumerate(_TITLES)) + f" END AS {c}" for i, c in ((1, "table_type"), (2, "method"), (3, "season"), (4, "license_type")))
    + " FROM part"
)
def classify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.array(*[F.lit(f"2019 Elk Harvest, Hunters and {t[0]}") for t in _TITLES])
    meta = classified(F.element_at(titles, (F.col("p_size") % len(_TITLES) + 1).cast("int")))
    return _table(spark, sf_dir, "part").withColumn("m", meta).select("p_partkey", "m.table_type", "m.method", "m.season", "m.license_type")


@_query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations""")
def section_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = F.when(F.col("role") == "user", F.col("turn"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", relational.carried_forward(opened, ["conv_id"], ["turn"]).alias("section"))


@_query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
  SELECT doc_id, count(*) AS lines, CAST(max(pos) AS INTEGER) AS last_line FROM l
  WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' AND NOT regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^[0-9]{1,3}$') GROUP BY doc_id""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("doc_id").alias("file_ord"), F.lit(0).alias("page_no"), "text")
    return sections.page_lines(pages).groupBy(F.col("file").alias("doc_id")).agg(F.count(F.lit(1)).alias("lines"), F.max("line_no").alias("last_line"))


def _supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population records: nations as herd units, their suppliers with sales in a year as management units."""
    items = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("bigint").alias("year")).distinct()
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("dau_number"))
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("dau_number"), F.col("n_name").alias("herd_name"))
    units = items.join(suppliers, "l_suppkey").groupBy("year", "dau_number").agg(F.collect_set("l_suppkey").alias("gmus"))
    return units.join(nations, "dau_number").select(
        F.col("year").alias("file_ord"), F.lit(0).alias("page_no"), F.col("dau_number").alias("line_no"), "year", "dau_number", "herd_name", "gmus",
        F.concat(F.lit("E-"), F.col("dau_number").cast("string")).alias("dau"),
    )


@_query("""WITH u AS (SELECT DISTINCT s_nationkey AS k, CAST(year(l_shipdate) AS BIGINT) AS y, l_suppkey AS g FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
  h AS (SELECT k, y, string_agg(CAST(g AS VARCHAR), ';' ORDER BY g) AS units FROM u GROUP BY k, y)
  SELECT 'E-' || k AS dau, CAST(k AS BIGINT) AS dau_number, n_name AS herd_name, arg_max(units, y) AS units,
  CASE WHEN count(DISTINCT units) > 1 THEN 'populated' ELSE 'absent' END AS history_state, string_agg(CAST(y AS VARCHAR), ';' ORDER BY y) AS years
  FROM h JOIN nation ON n_nationkey = k GROUP BY k, n_name""")
def unit_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dimensions.unit_definitions(_supplied(spark, sf_dir))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ";")
    return found.select("dau", "dau_number", "herd_name", joined("gmus").alias("units"), "history_state", joined("years_present").alias("years"))


@_query("""SELECT s_suppkey AS gmu, 'E-' || s_nationkey AS dau, CAST(1 AS BIGINT) AS claimed_by FROM supplier
  JOIN (SELECT l_suppkey, max(year(l_shipdate)) AS y FROM lineitem GROUP BY 1) t ON l_suppkey = s_suppkey
  JOIN (SELECT s_nationkey AS k, max(year(l_shipdate)) AS top FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) n ON n.k = s_nationkey AND n.top = y""")
def unit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.unit_lookup(dimensions.unit_definitions(_supplied(spark, sf_dir)))


@_query("""SELECT l_partkey, arg_max(l_suppkey, row(l_orderkey, l_linenumber, l_suppkey)) AS l_suppkey FROM lineitem GROUP BY l_partkey""")
def last_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    return dimensions.latest(items, ["l_partkey"], F.struct("l_orderkey", "l_linenumber", "l_suppkey"), ["l_suppkey"])


@_query("""SELECT o_orderkey AS file, CAST(floor(o_totalprice) AS BIGINT) AS statewide_total, CAST(coalesce(s, 0) AS BIGINT) AS record_total FROM orders
  LEFT JOIN (SELECT l_orderkey, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE floor(o_totalprice) <> 0 AND coalesce(s, 0) <> floor(o_totalprice)""")
def sum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.floor("l_extendedprice").alias("population_estimate"))
    totals = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.floor("o_totalprice").alias("statewide_total"))
    return population.sum_mismatches(records, totals).select("file", "statewide_total", "record_total")


@_query(f"""SELECT year AS y, gmu AS g, m, s, q AS b, ln AS c, q % 3 AS v, q + ln AS h, q * 2 AS n, q % 100 AS p, q * ln AS r FROM {_RECORDS}
  WHERE lic IS NULL AND (m, s) IN (('all', 'all'), ('archery', 'all'), ('rifle', 'all'), ('rifle', '1st'))""")
def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.dashboard(_as_records(_table(spark, sf_dir, "lineitem"))).drop("file_ord")


@_query("""SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
  SEMI JOIN (VALUES ('A', 'F'), ('N', 'O')) t(f, s) ON l_returnflag = f AND l_linestatus = s""")
def dashboard_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return relational.in_pairs(items, [("A", "F"), ("N", "O")], "l_returnflag", "l_linestatus").select(*items.columns)


@_query("""SELECT DISTINCT CAST(y AS BIGINT) AS year FROM (SELECT year(o_orderdate) AS y FROM orders UNION SELECT year(l_shipdate) FROM lineitem)""")
def years_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = _table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"))
    shipped = _table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("year"))
    return ordered.distinct().unionByName(shipped.distinct()).distinct()


@_query("""WITH t AS (SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS year, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS animals FROM lineitem GROUP BY 1, 2)
  SELECT l_suppkey, year, animals, round(avg(animals) OVER (PARTITION BY l_suppkey ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS animals_mean FROM t""")
def rolling_3y(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_year = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("bigint").alias("year")).agg(F.sum(_whole("l_quantity")).alias("animals"))
    return trends.trailing_mean(per_year, ["l_suppkey"], "year", "animals", 3).withColumn("animals_mean", F.round("animals_mean", 6))


@_query("""WITH q AS (SELECT quantile_cont(l_extendedprice, [1/7, 2/7, 3/7, 4/7, 5/7, 6/7]) AS b FROM lineitem)
  SELECT CAST(i AS INTEGER) AS k, round(b[CAST(i AS BIGINT) + 1], 4) AS break_at FROM q, range(6) r(i)""")
def quantile_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    breaks = trends.quantile_breaks(_table(spark, sf_dir, "lineitem"), "l_extendedprice", 7)
    return breaks.select(F.posexplode("breaks").alias("k", "b")).select("k", F.round("b", 4).alias("break_at"))


@_query(f"""WITH y AS (SELECT gmu, year, sum(q + ln) AS v FROM {_RECORDS} WHERE m = 'all' AND s = 'all' GROUP BY 1, 2),
  g AS (SELECT gmu, avg(v) AS v FROM y GROUP BY 1), b AS (SELECT quantile_cont(v, [1/7, 2/7, 3/7, 4/7, 5/7, 6/7]) AS b FROM g)
  SELECT gmu, round(v, 6) AS total_harvest, CAST(len(list_filter(b, lambda x: x < v)) + 1 AS INTEGER) AS class FROM g, b""")
def choropleth_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.choropleth(_as_records(_table(spark, sf_dir, "lineitem")), "total_harvest").withColumn("total_harvest", F.round("total_harvest", 6))


@_query("""SELECT 'E-' || n_nationkey AS dau, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("E-"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))
    return _table(spark, sf_dir, "supplier").select(unit_id(padded).alias("dau")).groupBy("dau").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT l_orderkey, 'Herd Name' AS herd_name, string_agg(CAST(l_suppkey AS VARCHAR), '; ' ORDER BY l_suppkey) AS gmus
  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey""")
def middle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("g"))
    middle = F.concat(F.lit("Herd Name "), F.array_join(F.col("g").cast("array<string>"), ", "))
    return listed.select("l_orderkey", population.split_middle(middle).alias("m")).select(
        "l_orderkey", "m.herd_name", F.array_join(F.col("m.gmus").cast("array<string>"), "; ").alias("gmus")
    )


@_query("""SELECT CAST(k AS BIGINT) AS dau_number, n_name AS herd_name, units, CAST(n * 1000 AS BIGINT) AS population_estimate, CAST(n AS BIGINT) AS bull_cow_ratio
  FROM (SELECT s_nationkey AS k, count(*) AS n, string_agg(CAST(s_suppkey AS VARCHAR), ';' ORDER BY s_suppkey) AS units FROM supplier GROUP BY 1) JOIN nation ON n_nationkey = k""")
def population_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population report text of the nations' suppliers, parsed back."""
    units = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("g"))
    named = units.join(_table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    n = F.size("g")
    row = F.concat_ws(" ", "s_nationkey", "n_name", F.array_join(F.col("g").cast("array<string>"), ", "), F.format_number(n * 1000, 0), n)
    pages = named.select(F.lit("2024 report").alias("file"), F.lit(0).alias("file_ord"), F.col("s_nationkey").alias("page_no"), F.concat(F.lit("2024 POST HUNT\nBull/Cow\n"), row).alias("text"))
    return population.parse_reports(pages).records.select(
        "dau_number", "herd_name", F.array_join(F.col("gmus").cast("array<string>"), ";").alias("units"), "population_estimate", "bull_cow_ratio"
    )


@_query("""SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(ntile(7) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS INTEGER) AS class FROM lineitem""")
def ntile7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven classes of equal counts by an exact ranking: a range shuffle, counts per partition, then local numbers."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return trends.equal_count_classes(items, ["l_extendedprice", "l_orderkey", "l_linenumber"], 7)


@_query(f"""SELECT year, gmu, q AS bulls, ln AS cows, q % 3 AS calves, q + ln AS total_harvest, q * 2 AS total_hunters, q % 100 AS pct_success, q * ln AS total_rec_days
  FROM {_RECORDS} WHERE m = 'all' AND s = 'all'""")
def slim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.slim(_as_records(_table(spark, sf_dir, "lineitem"))).drop("file_ord")


@_query(f"""SELECT gmu, year, kind, CAST(animals AS BIGINT) AS animals FROM (SELECT gmu, year, sum(q) AS bulls, sum(ln) AS cows, sum(q % 3) AS calves FROM {_RECORDS}
  WHERE m = 'all' AND s = 'all' GROUP BY 1, 2) UNPIVOT (animals FOR kind IN (bulls, cows, calves))""")
def stacked_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.stacked(_as_records(_table(spark, sf_dir, "lineitem")))


@_query("""SELECT l_orderkey, l_linenumber, l_quantity, CAST(0 AS DOUBLE) AS l_tax, CAST(NULL AS DOUBLE) AS l_discount FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey, l_linenumber, 0, l_tax, l_discount FROM lineitem WHERE l_returnflag = 'R'""")
def harvest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    kept = items.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_quantity")
    returned = items.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return relational.padded_union([kept, returned], zeros=["l_quantity", "l_tax"])


@_query("""SELECT s_suppkey AS gmu, 'E-' || s_nationkey AS dau, CAST(n_regionkey + 2000 AS BIGINT) AS year, CAST(n_nationkey * 10 AS BIGINT) AS population_estimate
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def unit_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier")
    label = lambda c: F.concat(F.lit("E-"), F.col(c).cast("string"))
    lookup = suppliers.select(F.col("s_suppkey").alias("gmu"), label("s_nationkey").alias("dau"))
    estimates = _table(spark, sf_dir, "nation").select(
        label("n_nationkey").alias("dau"), (_whole("n_regionkey") + 2000).alias("year"), (_whole("n_nationkey") * 10).alias("population_estimate")
    )
    return trends.unit_population(lookup, estimates, suppliers.select(F.col("s_suppkey").alias("gmu"))).select("gmu", "dau", "year", "population_estimate")


@_query("""SELECT k AS dau_number, CAST(row_number() OVER (PARTITION BY k ORDER BY g) - 1 AS INTEGER) AS pos, g AS gmu
  FROM (SELECT CAST(s_nationkey AS BIGINT) AS k, s_suppkey AS g FROM supplier)""")
def mapping_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = (
        _table(spark, sf_dir, "supplier")
        .groupBy(F.col("s_nationkey").cast("bigint").alias("dau_number"))
        .agg(F.array_sort(F.collect_list("s_suppkey")).alias("gmus"))
        .select(F.lit("one").alias("file"), F.lit(0).alias("file_ord"), F.lit(0).alias("page_no"), F.lit(0).alias("line_no"), F.lit(2024).alias("year"), F.col("dau_number").cast("string").alias("dau"), "dau_number", "gmus")
    )
    return population.mapping_rows(records).select("dau_number", "pos", "gmu")


@_query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS year, arg_max(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS statewide_total FROM orders GROUP BY 1""")
def statewide_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_ord"), F.lit("f").alias("file"), F.year("o_orderdate").cast("bigint").alias("year"), F.floor("o_totalprice").alias("statewide_total")
    )
    return trends.statewide_population(totals)


@_query("""SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.row_counts(orders=_table(spark, sf_dir, "orders"), lineitem=_table(spark, sf_dir, "lineitem"))


@_query("""SELECT CASE WHEN lower(url) LIKE '%/en/%' AND (lower(url) LIKE '%page%' OR lower(url) LIKE '%ref%') THEN 'harvest'
  WHEN lower(url) LIKE '%/de/%' OR lower(url) LIKE '%#top%' THEN 'population' WHEN lower(url) LIKE '%blog%' THEN 'other' ELSE 'skipped' END AS category, count(*) AS n
  FROM pages GROUP BY 1""")
def route_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.lower("url")
    rules = [("harvest", url.contains("/en/") & has_any(url, "page", "ref")), ("population", has_any(url, "/de/", "#top")), ("other", url.contains("blog"))]
    return _table(spark, sf_dir, "pages").select(relational.routed(url, rules, "skipped").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT max(y) AS year, arg_max(n, y) AS n FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1)""")
def latest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_year = _table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return serving.latest_year(per_year, "n")


@_query(f"""SELECT year, count(*) AS records FROM {_RECORDS} GROUP BY year""")
def records_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.by_year(_as_records(_table(spark, sf_dir, "lineitem")))


def queries() -> dict[str, Query]:
    return _QUERIES | report_queries.queries() | file_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _ORACLES | report_queries.oracle_sql() | file_queries.oracle_sql()


__all__ = ["oracle_sql", "queries", "rendered_pages"]
