"""Page text: the boundary between files and the report operators."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark.operators.trends import ranked

PAGES = "file string, file_ord long, page_no int, text string"


def with_file_order(df: DataFrame, path: str = "file") -> DataFrame:
    """``df`` with ``file_ord``, the rank of its path among all, from range partitions of the paths."""
    names = ranked(df.select(path).distinct(), [path]).select(path, F.col("__rank").cast("long").alias("file_ord"))
    return df.drop("file_ord").join(names, path)


def _paged(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("value", "\f")).alias("page_no", "text"))


def read_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Pages from text files, one per report, with a form feed between pages; file order is path order."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return with_file_order(_paged(files)).select("file", "file_ord", "page_no", "text")


def read_page_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pages of the named text files; file order is the order of ``paths``. A file named twice counts once."""
    configuration, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    full = lambda p: hadoop(p).getFileSystem(configuration).makeQualified(hadoop(p)).toUri().toString().replace("file:///", "file:/")
    order = spark.createDataFrame([(name, k) for k, name in enumerate(dict.fromkeys(map(full, paths)))], "file string, file_ord long")
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    files = spark.read.text(paths, wholetext=True).select(name.alias("file"), "value")
    return _paged(files).join(F.broadcast(order), "file").select("file", "file_ord", "page_no", "text")  # a row per given name


def read_pdf_pages(files: DataFrame, path: str = "name", data: str = "data") -> DataFrame:
    """Pages of PDF files given as bytes. Needs pdfplumber on the executors; a file that it can't read gives one null page."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pdfplumber

        for rows in batches:
            for name, content in zip(rows["file"], rows["data"]):
                try:
                    with pdfplumber.open(io.BytesIO(content)) as pdf:
                        found = [(name, k, page.extract_text()) for k, page in enumerate(pdf.pages)]
                except Exception:  # noqa: BLE001  the parser raises many kinds; the file is then reported as without text
                    found = [(name, 0, None)]
                yield pd.DataFrame(found or [(name, 0, None)], columns=["file", "page_no", "text"])

    named = files.select(F.col(path).alias("file"), F.col(data).alias("data"))
    return with_file_order(named.mapInPandas(pages, "file string, page_no int, text string")).select("file", "file_ord", "page_no", "text")
