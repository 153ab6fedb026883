"""CSV, JSON and document sinks."""

from __future__ import annotations

import json
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from meadowlark.operators import harvest, population
from meadowlark.operators.dimensions import latest
from meadowlark.operators.harvest import HARVEST_COLUMNS, UNIT_COLUMNS
from meadowlark.operators.population import COLUMNS, mapping_rows, unit_mapping
from meadowlark.operators.serving import items
from meadowlark.operators.trends import ranked
from meadowlark.sources.writers import write_placed
from meadowlark.tables import written

#: Paths of written files and their bytes.
Files = dict[str, int]


def _write(pieces: DataFrame, order: list[str], folder: str, seen: Observation | None = None, counts: dict[str, Column] | None = None) -> Files:
    """Pieces (name, piece, and ``order``) as one file per name, each piece at its byte offset.

    Offsets are prefix sums of byte lengths over range partitions, so every task writes its own pieces and none holds a
    file. ``seen`` observes ``counts`` on the way.
    """
    sized = pieces.withColumn("piece", F.encode("piece", "utf-8")).withColumn("__bytes", F.octet_length("piece").cast("bigint"))
    placed = ranked(sized, ["name", *order], "__bytes")
    if seen is not None:  # after the ranges are dealt, as their sample reads rows too
        placed = placed.observe(seen, *[c.alias(k) for k, c in counts.items()])
    placed = written(placed.select("name", F.col("__rank").alias("at"), "piece", "__bytes"))
    files = placed.groupBy("name").agg(F.min("at").alias("start"), F.sum("__bytes").alias("n")).collect()  # a row per file
    if not files:
        return {}
    starts = F.broadcast(pieces.sparkSession.createDataFrame([(r["name"], r["start"]) for r in files], "name string, start long"))
    sizes = {r["name"]: r["n"] for r in files}
    write_placed(placed.join(starts, "name").withColumn("at", F.col("at") - F.col("start")), folder, sizes)
    return {f"{folder}/{name}": size for name, size in sorted(sizes.items())}


def _last_files(rows: DataFrame) -> DataFrame:
    """Of several files of one year, the rows of the last."""
    last = latest(rows, ["year"], F.struct("file_ord", "file"), ["file"])
    return rows.join(last, ["year", "file"], "left_semi")


def _csv(df: DataFrame, folder: str, name: str, columns: tuple[str, ...], order: list[str], years: DataFrame | None = None) -> Files:
    """One CSV file per year, CRLF line ends, blank for null, quotes doubled; ``years`` get a header even without rows."""
    to = F.format_string(f"{name}_%d.csv", F.col("year"))
    line = F.to_csv(F.struct(*columns), {"emptyValue": "", "escape": '"'})
    keys = [F.lit(1).alias("step"), *order]
    rows = df.select(to.alias("name"), *keys, line.alias("piece"))
    none = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order]
    heads = (df.select("year") if years is None else years.select("year")).distinct().select(to.alias("name"), F.lit(0).alias("step"), *none, F.lit(",".join(columns)).alias("piece"))
    return _write(heads.unionByName(rows).withColumn("piece", F.concat("piece", F.lit("\r\n"))), ["step", *order], folder)


def harvest_csv(records: DataFrame, folder: str, species: str = "elk") -> Files:
    """Years without records get no file; of several files of one year, the last that has any stands."""
    return _csv(_last_files(records), folder, f"{species}_harvest", HARVEST_COLUMNS, ["page_no", "line_no"])


def unit_csv(records: DataFrame, folder: str, species: str = "elk") -> Files:
    return _csv(_last_files(records), folder, f"{species}_dau_summary", UNIT_COLUMNS, ["page_no", "line_no"])


def population_csv(records: DataFrame, folder: str, species: str = "elk") -> Files:
    """Management units are joined by ``; ``."""
    rows = _last_files(records).withColumn("gmus", F.array_join("gmus", "; "))
    return _csv(rows, folder, f"{species}_population", COLUMNS, ["page_no", "line_no"])


def mapping_csv(records: DataFrame, totals: DataFrame, folder: str) -> Files:
    """(year, dau, gmu) by herd unit number, then in report order; the years of ``totals`` get a file even without rows."""
    last = latest(totals, ["year"], F.struct("file_ord", "file"), ["file"])
    rows = mapping_rows(records.join(last, ["year", "file"], "left_semi"))
    return _csv(rows, folder, "dau_gmu_mapping", ("year", "dau", "gmu"), ["dau_number", "pos"], totals)


def keyed_mapping(records: DataFrame) -> DataFrame:
    """(file, file_ord, year, dau, gmus, key): each file's herd units with management units, keyed ``<year>_<dau>``."""
    return unit_mapping(records).withColumn("key", F.concat_ws("_", "year", "dau"))


def _indented(text: Column, by: int = 0, inner: bool = False) -> Column:
    """JSON text indented, ``by`` more spaces on every line but the first; ``inner``: an object without its braces."""
    line, cut = "\n" + " " * by, slice(1, -2) if inner else slice(None)

    @F.pandas_udf("string")
    def indent(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), indent=2)[cut].replace("\n", line))

    return indent(text)


def _fields(*columns: Column | str) -> Column:
    return _indented(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), inner=True)


def _report_pieces(files: DataFrame, lists: list[tuple[list[str], str, DataFrame]], ending: list[str]) -> DataFrame:
    """(file, file_ord, year, part, step, page_no, line_no, piece): the text of one indented JSON file a report, a piece an item.

    ``lists``: fields of ``files`` that stand before a list, its name, and its items (file, page_no, line_no, text);
    ``ending``: fields after all lists. No row holds a list, so a report may have any number of records.
    """
    keys, none = ("file", "file_ord", "year"), F.lit(None).cast("bigint")

    def piece(part: int, step: int, text: Column, of: DataFrame = files) -> DataFrame:
        return of.select(*keys, F.lit(part).alias("part"), F.lit(step).alias("step"), none.alias("page_no"), none.alias("line_no"), text.alias("piece"))

    out = piece(len(lists), 0, F.concat(F.lit(","), _fields(*ending), F.lit("\n}")) if ending else F.lit("\n}"))
    for part, (fields, name, rows) in enumerate(lists):
        start = [F.lit("," if part else "{"), _fields(*fields)] if fields else []
        items = rows.join(files.select(*keys), "file")
        firsts = items.groupBy("file").agg(F.min(F.struct("page_no", "line_no")).alias("first"))  # a row per report
        comma = F.when(F.struct("page_no", "line_no") == F.col("first"), "\n    ").otherwise(",\n    ")
        placed = items.join(firsts, "file").select(
            *keys, F.lit(part).alias("part"), F.lit(1).alias("step"), F.col("page_no").cast("bigint").alias("page_no"), F.col("line_no").cast("bigint").alias("line_no"),
            F.concat(comma, _indented(F.col("text"), by=4)).alias("piece"),
        )
        closing = F.when(F.col("first").isNull(), "]").otherwise("\n  ]")
        out = out.unionByName(piece(part, 0, F.concat(*start, F.lit(f',\n  "{name}": [')))).unionByName(placed).unionByName(piece(part, 2, closing, files.join(firsts, "file", "left")))
    return out


def harvest_files(report: harvest.Report) -> DataFrame:
    """The JSON files of the readable harvest reports as text pieces, see :func:`_report_pieces`."""
    listed = lambda rows, columns: rows.select("file", "page_no", "line_no", _json(columns).alias("text"))
    detail = report.sections.select("file", "section.page_no", "section.line_no", _json(("title", "type", "method", "season", "license_type", "records")).alias("text"))
    counts = report.sections.groupBy("file").agg(F.count(F.lit(1)).alias("sections_parsed"))
    files = report.files.select("file", "file_ord", "year", F.lit("elk").alias("species"), F.col("file").alias("source_file")).join(counts, "file", "left")
    files = written(files.withColumn("sections_parsed", F.coalesce("sections_parsed", F.lit(0).cast("bigint"))))
    lists = [
        (["year", "species", "source_file"], "harvest_records", listed(report.records, HARVEST_COLUMNS)),
        ([], "dau_records", listed(report.unit_records, UNIT_COLUMNS)),
        (["sections_parsed"], "sections_detail", detail),
    ]
    return _report_pieces(files, lists, [])


def population_files(report: population.Report) -> DataFrame:
    """The JSON files of the readable population reports as text pieces; a mapping has the units of one report's herds."""
    pair = F.sort_array(F.collect_list(F.struct("dau_number", F.struct("dau", "gmus").alias("e"))))
    mapping = unit_mapping(report.records).groupBy("file").agg(F.map_from_entries(F.transform(pair, lambda x: x["e"])).alias("dau_gmu_mapping"))
    files = written(report.totals.select("file", "file_ord", "year", "species", F.col("file").alias("source_file"), "statewide_total").join(mapping, "file", "left"))
    records = report.records.select("file", "page_no", "line_no", _json(COLUMNS).alias("text"))
    return _report_pieces(files, [(["year", "species", "source_file", "statewide_total"], "records", records)], ["dau_gmu_mapping"])


def year_json(files: DataFrame, folder: str, kind: str, species: str = "elk") -> Files:
    """One indented JSON file per report, ``<species>_<kind>_<year>.json``; of several of one year the last stands.

    Nulls are kept. ``files``: pieces of :func:`harvest_files` or :func:`population_files`; each task writes its own.
    """
    files = written(files)
    heads = files.where("part = 0 AND step = 0").select("year", "file_ord", "file")
    last = files.join(latest(heads, ["year"], F.struct("file_ord", "file"), ["file"]), ["year", "file"], "left_semi")
    return _write(last.withColumn("name", F.format_string(f"{species}_{kind}_%d.json", F.col("year"))), ["part", "step", "page_no", "line_no"], folder)


def _json(columns: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _years(rows: DataFrame, part: int, name: str, closing: str) -> DataFrame:
    return items(rows.select("year").distinct(), part, [F.col("year")], F.col("year").cast("string"), f'{{"species":"elk","{name}":[', closing)


def harvest_master(report: harvest.Report) -> DataFrame:
    """The master document of several harvest reports as text pieces: years, harvest_records, dau_records."""
    order = [F.col(c) for c in ("file_ord", "page_no", "line_no")]
    return (
        _years(report.files, 0, "years", '],"harvest_records":[')
        .unionByName(items(report.records, 1, order, _json(HARVEST_COLUMNS), "", '],"dau_records":['))
        .unionByName(items(report.unit_records, 2, order, _json(UNIT_COLUMNS), "", "]}"))
    )


def population_master(report: population.Report) -> DataFrame:
    """The master document of population reports: records, mappings keyed ``<year>_<dau>``, statewide totals by year.

    Of several files of one year the last one's mapping and total stand.
    """
    quoted = lambda key: F.concat(F.lit('"'), F.col(key).cast("string"), F.lit('":'))
    mapping = latest(keyed_mapping(report.records), ["key"], F.struct("file_ord", "file"), ["year", "dau", "gmus"])
    totals = latest(report.totals, ["year"], F.struct("file_ord", "file"), ["statewide_total"])
    return (
        _years(report.totals, 0, "years", '],"population_records":[')
        .unionByName(items(report.records, 1, [F.col(c) for c in ("file_ord", "page_no", "line_no")], _json(COLUMNS), "", '],"dau_gmu_mappings":{'))
        .unionByName(items(mapping, 2, [F.col("year"), F.col("dau")], F.concat(quoted("key"), F.to_json(F.struct("year", "dau", "gmus"))), "", '},"statewide_totals":{'))
        .unionByName(items(totals, 3, [F.col("year")], F.concat(quoted("year"), F.col("statewide_total").cast("string")), "", "}}"))
    )


class Document(NamedTuple):
    """A written document: its path, its bytes, and the items of each of its parts, counted while it was written."""

    path: str
    size: int
    items: dict[int, int]


def _ordered_text(pieces: DataFrame, pretty: bool) -> DataFrame:
    """Pieces with commas between items and line ends; ``pretty`` indents every opening, item and closing."""
    first = pieces.where("step = 1").groupBy("name", "part").agg(F.min("at").alias("first"))  # one row per part
    comma = F.when((F.col("step") == 1) & (F.col("at") != F.col("first")), ",").otherwise("")
    indent = F.when(F.col("step") == 1, "    ").otherwise("  ") if pretty else F.lit("")
    return pieces.join(first, ["name", "part"], "left").withColumn("piece", F.concat(indent, comma, "piece", F.lit("\n"))).drop("first")


#: The twin of a document that is indented is named so.
PRETTY = "_pretty.json"


def documents(pieces: DataFrame, folder: str, names: list[str], twins: bool = True) -> dict[str, Document]:
    """Text pieces (name, part, step, at, piece) as one file per name, all written together and in parallel, by name.

    With ``twins``, each ``x.json`` has an indented ``x_pretty.json``: the same JSON. The folder is on a file system that
    driver and executors share; see :func:`document_parts` for other stores.
    """
    text = _ordered_text(pieces, pretty=False)
    if twins:
        indented = _ordered_text(pieces, pretty=True).withColumn("name", F.regexp_replace("name", r"\.json$", PRETTY))
        text, names = text.unionByName(indented), [*names, *(n.removesuffix(".json") + PRETTY for n in names)]
    seen = Observation()
    item = lambda name, part: F.count(F.when((F.col("name") == name) & (F.col("part") == part) & (F.col("step") == 1), 1))
    counts = {f"{k}:{part}": item(name, part) for k, name in enumerate(names) for part in range(8)}
    files = _write(text, ["part", "step", "at"], folder, seen, counts)
    return {name: Document(f"{folder}/{name}", files[f"{folder}/{name}"], {part: seen.get[f"{k}:{part}"] for part in range(8)}) for k, name in enumerate(names)}


def document(pieces: DataFrame, path: str, pretty: bool = False) -> Document:
    """Text pieces (part, step, at, piece) as one file; ``pretty`` indents it."""
    folder, _, name = path.rpartition("/")
    if not pretty:
        return documents(pieces.withColumn("name", F.lit(name)), folder or ".", [name], twins=False)[name]
    files = _write(_ordered_text(pieces.withColumn("name", F.lit(name)), pretty), ["part", "step", "at"], folder or ".")
    return Document(path, sum(files.values()), {})


def document_parts(pieces: DataFrame, path: str, pretty: bool = False) -> str:
    """The document as a folder of text files that follow one another by name, for stores without random writes."""
    text = _ordered_text(pieces.withColumn("name", F.lit("")), pretty).repartitionByRange("part", "step", "at").sortWithinPartitions("part", "step", "at")
    text.select(F.regexp_replace("piece", "\n$", "").alias("piece")).write.mode("overwrite").text(path, lineSep="\n")
    return path


def size_text(n: int) -> str:
    """Bytes as MB beyond a million of them, else as KB."""
    return f"{n / 1e6:.1f} MB" if n > 1_000_000 else f"{n / 1e3:.0f} KB"


def file_sizes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, size): each document's bytes in words, of files or folders of parts."""
    files = None
    for path in paths:
        one = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).select(F.lit(path).alias("path"), "n")
        files = one if files is None else files.unionByName(one)
    size = F.when(F.col("n") > 1_000_000, F.format_string("%.1f MB", F.col("n") / 1e6)).otherwise(F.format_string("%.0f KB", F.col("n") / 1e3))
    return files.select("path", size.alias("size"))
