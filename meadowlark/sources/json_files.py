"""Per-year JSON files of harvest and population reports, read with fixed schemas."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark.operators.harvest import COUNTS, HARVEST_COLUMNS, UNIT_COLUMNS
from meadowlark.operators.trends import ranked
from meadowlark.sources.pages import with_file_order
from meadowlark.tables import written

_TEXT = {"species", "section_method", "section_season", "section_license_type", "table_type", "section_title", "dau"}
_DOUBLE = {"pct_success", "sample_rate", "response_rate"}


def _fields(columns: tuple[str, ...], doubles: set[str] = frozenset()) -> str:
    return ",".join(f"{c}:{'string' if c in _TEXT else 'double' if c in doubles else 'bigint'}" for c in columns)


HARVEST_FILE = (
    "year bigint, species string, source_file string, "
    f"harvest_records array<struct<{_fields(HARVEST_COLUMNS)}>>, dau_records array<struct<{_fields(UNIT_COLUMNS, _DOUBLE)}>>, "
    "sections_parsed bigint, sections_detail array<struct<title:string,type:string,method:string,season:string,license_type:string,records:bigint>>"
)
POPULATION_FILE = (
    "year bigint, species string, source_file string, statewide_total bigint, "
    "records array<struct<year:bigint,species:string,dau:string,dau_number:bigint,herd_name:string,gmus:array<bigint>,population_estimate:bigint,bull_cow_ratio:bigint>>, "
    "dau_gmu_mapping map<string,array<bigint>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, in whatever store it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Files with a year, each with ``file`` and ``file_ord`` (path order); an empty table if there are none."""
    if not exists(spark, glob):
        return spark.createDataFrame([], f"{schema}, file string, file_ord long")
    files = spark.read.schema(schema).json(glob, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    return with_file_order(files.where("year IS NOT NULL"))


def read_reports(spark: SparkSession, harvest_glob: str, population_glob: str) -> tuple[DataFrame, DataFrame]:
    """Both kinds of files; an error if neither glob names anything."""
    harvest, population = read_files(spark, harvest_glob, HARVEST_FILE), read_files(spark, population_glob, POPULATION_FILE)
    if not exists(spark, harvest_glob) and not exists(spark, population_glob):
        raise FileNotFoundError(f"no reports at {harvest_glob} or {population_glob}")
    return harvest, population


def _exploded(files: DataFrame, column: str) -> DataFrame:
    keys = files.select("file", "file_ord", F.posexplode(column).alias("line_no", "r"))
    return keys.select("file", "file_ord", F.lit(0).alias("page_no"), "line_no", "r.*")


def with_counts(records: DataFrame) -> DataFrame:
    return records.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS})


def harvest_records(files: DataFrame) -> DataFrame:
    """All files' harvest records in order; counts that a file leaves out are 0."""
    return with_counts(_exploded(files, "harvest_records"))


def unit_records(files: DataFrame) -> DataFrame:
    return _exploded(files, "dau_records")


def population_records(files: DataFrame) -> DataFrame:
    return _exploded(files, "records")


# ---- indented files of any length -----------------------------------------------------------------------------------

#: What stands before each item of a list in a file that is indented by two, and what closes an item.
_OPENS, _CLOSES = "\n    {\n", "\n    }"


class Reports(NamedTuple):
    """Per-year files, read: ``files`` (file, file_ord and their fields, no lists), ``items`` (file, page_no, line_no, list,
    value as text) of indented files and, in ``whole``, other files as rows with lists."""

    files: DataFrame
    items: DataFrame
    whole: DataFrame


def _paths(spark: SparkSession, glob: str) -> tuple[list[str], list[str]]:
    """The paths that ``glob`` names, in patterns' own spelling: those whose first bytes are indented by two, and the others."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(glob)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found: tuple[list[str], list[str]] = [], []
    for status in store.globStatus(hadoop) or ():
        stream = store.open(status.getPath()) if status.isFile() else None
        head = [stream.read() for _ in range(5)] if stream else []
        if stream:
            stream.close()
        found[bytes(max(b, 0) for b in head) != b'{\n  "'].append(re.sub(r"([\[\]{}*?\\])", r"\\\1", status.getPath().toString()))
    return found


def _whole(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Files with a year, each read by one task; those without one are told by it alone."""
    name = F.col("_metadata.file_path")
    if paths:
        dated = spark.read.schema("year bigint").json(paths, multiLine=True).where("year IS NOT NULL").select(name.alias("file"))
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["file"]) for r in dated.collect()]  # a row per file
    if not paths:
        return spark.createDataFrame([], f"{schema}, file string")
    return spark.read.schema(schema).json(paths, multiLine=True).withColumn("file", name)


def read_items_of(spark: SparkSession, glob: str, schema: str) -> Reports:
    """Files of the given schema by items, so no row holds a file's list, and many tasks read each file.

    Indented files (as :func:`~meadowlark.sources.sinks.year_json` writes them) are split before the items of their lists;
    in JSON such a line end stands in no string. What is left without the items is each file's own fields, its lists
    empty. A file that isn't laid out so all through is read whole; files without a year are left out. An item's place is
    the block of its file (page_no) and its number within it.
    """
    indented, others = _paths(spark, glob)
    fields = "file string, page_no long, line_no long, list string, value string"
    lists = [f.name for f in spark.createDataFrame([], schema).schema if f.dataType.typeName() == "array"]
    own = [c for c in spark.createDataFrame([], schema).columns if c not in lists]
    if not indented:
        whole = with_file_order(_whole(spark, others, schema))
        return Reports(whole.select("file", "file_ord", *own), spark.createDataFrame([], fields), whole)
    first = (F.col("_metadata.file_block_start") == 0) & F.col("value").startswith("{\n  \"")
    chunks = spark.read.text(indented, lineSep=_OPENS).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("page_no"), F.monotonically_increasing_id().alias("line_no"),
        first.alias("is_head"), F.substring_index("value", _CLOSES, 1).alias("body"), "value",
    )
    rest = F.when(F.col("is_head"), F.col("value")).otherwise(F.substring("value", F.length("body") + F.lit(len(_CLOSES) + 1), F.length("value")))
    item = F.when(~F.col("is_head"), F.concat(F.lit("{"), "body", F.lit("}")))
    chunks = written(chunks.select("file", "page_no", "line_no", "is_head", rest.alias("rest"), item.alias("value")))
    at = F.struct("page_no", "line_no")
    is_right = F.col("is_head") | (F.try_parse_json("value").isNotNull() & ((F.col("rest") == ",") | F.col("rest").startswith("\n  ]")))
    # a row per report: all of its text but items and the commas between them, with the places where lists open
    frame = chunks.groupBy("file").agg(F.bool_and(is_right).alias("right"), F.array_sort(F.collect_list(F.when(F.col("rest") != ",", F.struct(at.alias("at"), "rest")))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["rest"]), "")
    frame = written(frame.select("file", (F.col("right") & F.try_parse_json(text).isNotNull()).alias("right"), text.alias("text"), "s"))
    wrong = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["file"]) for r in frame.where("NOT coalesce(right, false)").select("file").collect()]
    whole = _whole(spark, others + wrong, schema)
    heads = frame.where("right").select("file", F.from_json("text", schema).alias("r")).select("file", *[f"r.{c}" for c in own]).where("year IS NOT NULL")
    files = with_file_order(heads.unionByName(whole.select("file", *own)))
    opened = F.transform("s", lambda x: F.struct(x["at"].alias("at"), F.regexp_extract(x["rest"], r'"([^"]*)": \[$', 1).alias("list")))
    places = frame.join(heads.select("file"), "file").select("file", opened.alias("s"))
    name = F.element_at(F.filter("s", lambda x: x["at"] < F.struct("page_no", "line_no")), -1)["list"]
    items = chunks.where("NOT is_head").join(F.broadcast(places), "file").select("file", "page_no", "line_no", name.alias("list"), "value")
    return Reports(files, items, whole.join(files.select("file", "file_ord"), "file"))


def records_of(found: Reports, name: str) -> DataFrame:
    """The records of all files' lists of that name, with file, file_ord, page_no and line_no."""
    kind = found.whole.schema[name].dataType.elementType
    parsed = found.items.where(F.col("list") == name).join(found.files.select("file", "file_ord"), "file")
    parsed = parsed.select("file", "file_ord", "page_no", "line_no", F.from_json("value", kind).alias("r")).select("file", "file_ord", "page_no", "line_no", "r.*")
    rows = _exploded(found.whole, name)
    return parsed.unionByName(rows.withColumns({c: F.col(c).cast("bigint") for c in ("page_no", "line_no")}))


# ---- files as variants: no fixed schema, absent and null kept apart --------------------------------------------------


def read_variants(spark: SparkSession, glob: str) -> DataFrame:
    """(file, file_ord, body): each JSON file as a VARIANT, whatever its fields; an empty table if there are no files."""
    if not exists(spark, glob):
        return spark.createDataFrame([], "file string, file_ord long, body variant")
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("body"))
    return with_file_order(files).select("file", "file_ord", "body")


#: Lines of the sinks that open or close lists and objects; every other line is one item.
_STRUCTURE = r"^$|[{\[:,]$|^[\]}]+$"
#: A closed list or object, with the commas that its items have left.
_CLOSED = r'"[^"]*":(?:\[,*\]|\{,*\})'


def read_items(spark: SparkSession, glob: str) -> DataFrame:
    """(file, path, at, led, key, value): each item of the documents that :mod:`~meadowlark.sources.sinks` writes, as text.

    The sinks put each item on a line of its own, so a document is read as lines, by many tasks, and none holds it whole.
    path: the keys of the list or object that an item stands in, with dots between them; an item without a key that is a
    value by itself has the path of its key. at: its order in the document. led: whether a comma stands before it. key: an
    object's key, else null. Lines are written once, as their order is that of the read. A document that doesn't close
    what it opens is an error, one without items gives no row.
    """
    if not exists(spark, glob):
        return spark.createDataFrame([], "file string, path string, at struct<block:long,line:long>, led boolean, key string, value string")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = written(spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.trim("value").alias("text")))
    is_item = ~F.col("text").rlike(_STRUCTURE)
    opened = lambda text: F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _CLOSED, ""), _CLOSED, ""), _CLOSED, "")
    # a document has a few such lines; what is open after each of them is the text so far without what is closed
    structure = lines.where(~is_item).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("s"))
    fold = lambda so_far, x: F.concat(so_far, F.array(F.struct(x["at"].alias("at"), opened(F.concat(F.coalesce(F.try_element_at(so_far, F.lit(-1))["open"], F.lit("")), x["text"])).alias("open"))))
    none = F.array().cast("array<struct<at:struct<block:bigint,line:bigint>,open:string>>")
    structure = structure.select("file", F.aggregate("s", none, fold).alias("s"))
    closed = F.element_at("s", -1)["open"].rlike(r'^(?:\{[^{}\[\]]*\}|\[,*\])$')
    structure = structure.select("file", F.when(closed, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("not whole: "), F.col("file")))).alias("s"))
    open_keys = lambda text: F.array_join(F.regexp_extract_all(text, F.lit(r'"([^"]*)":(?=[\[{]|$)'), 1), ".")
    structure = structure.select("file", F.transform("s", lambda x: F.struct(x["at"].alias("at"), open_keys(x["open"]).alias("path"), x["open"].endswith("{").alias("keyed"))).alias("s"))
    body = F.regexp_replace("text", "^,", "")
    pair = r'^"((?:[^"\\\\]|\\\\.)*)":'
    here = F.element_at(F.filter("s", lambda x: x["at"] < F.col("at")), -1)
    placed = lines.where(is_item).join(F.broadcast(structure), "file").select("file", "at", F.col("text").startswith(",").alias("led"), body.alias("body"), here.alias("h"))  # a row per document
    return placed.select(
        "file", F.col("h.path").alias("path"), "at", "led",
        F.when(F.col("h.keyed"), F.regexp_extract("body", pair, 1)).alias("key"),
        F.when(F.col("h.keyed"), F.regexp_replace("body", pair, "")).otherwise(F.col("body")).alias("value"),
    )


def numbered(items: DataFrame) -> DataFrame:
    """Items of one document with ``pos``, their place in their list or object from 0, ranked over range partitions."""
    order = ranked(items, ["path", "at"])
    first = order.groupBy("path").agg(F.min("__rank").alias("__first"))
    return order.join(F.broadcast(first), "path").withColumn("pos", F.col("__rank") - F.col("__first")).drop("__rank", "__first", "__all")  # a row per list


def per_year(files: DataFrame) -> DataFrame:
    """Variants that have a year, with it; others, such as combined documents, go."""
    year = F.try_variant_get("body", "$.year", "bigint")
    return files.withColumn("year", year).where(F.col("year").isNotNull())


def exploded(files: DataFrame, path: str) -> DataFrame:
    """``files`` with ``pos``, ``key`` and ``value`` of each item of the list or object at ``path``; files without it give none."""
    spark, names = files.sparkSession, files.columns
    at = F.try_variant_get("body", path, "variant")
    items = files.withColumn("__at", at).lateralJoin(spark.tvf.variant_explode(F.col("__at").outer()))
    return items.select(*names, "pos", "key", "value")


def presence(value: Column, path: str) -> Column:
    """``absent``, ``null``, ``empty`` (an object or list without items) or ``filled``: what stands at ``path`` of a variant."""
    found = F.try_variant_get(value, path, "variant")
    return (
        F.when(found.isNull(), "absent").when(F.is_variant_null(found), "null").when(F.to_json(found).isin("{}", "[]"), "empty").otherwise("filled")
    )
