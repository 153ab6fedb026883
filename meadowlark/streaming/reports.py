"""A file stream of page text: reports are parsed as soon as all their pages have come, and appended to the record tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from meadowlark.operators import harvest

PAGES = "file string, file_ord long, page_no int, text string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Gathering(StatefulProcessor):
    """Holds a report's pages by number until there are as many as the report says it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page_no int", "file_ord long, text string")
        self.progress = handle.getValueState("progress", "come long, wanted long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        come, wanted = self.progress.get() if self.progress.exists() else (0, 0)
        for batch in rows:
            for page_no, file_ord, text, pages in zip(batch["page_no"], batch["file_ord"], batch["text"], batch["pages"]):
                come += not self.pages.containsKey((page_no,))
                self.pages.updateValue((page_no,), (file_ord, text))
                wanted = max(wanted, 0 if pd.isna(pages) else int(pages))
        if wanted and come >= wanted:
            held = [(key[0], file_ord, page_no, text) for (page_no,), (file_ord, text) in self.pages.iterator()]
            self.pages.clear()
            self.progress.clear()
            yield pd.DataFrame(held, columns=["file", "file_ord", "page_no", "text"])
        else:
            self.progress.update((come, wanted))
            yield pd.DataFrame({"file": pd.Series(dtype=str), "file_ord": pd.Series(dtype="int64"), "page_no": pd.Series(dtype="int32"), "text": pd.Series(dtype=str)})

    def close(self) -> None:
        pass


def complete_reports(pages: DataFrame) -> DataFrame:
    """The pages of reports of which all have come, from a stream of pages with their report's number of ``pages``.

    A report's pages may come in any order and over any number of batches; one that comes twice counts once, the later
    text standing. They wait in the state store: which year a report is of, and so which of its lines are titles, is known
    for sure only at its end. State is by file and on disk, and goes when the report is handed on.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return pages.groupBy("file").transformWithStateInPandas(_Gathering(), PAGES, "Append", "None")


def _appended(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        report = harvest.parse_reports(batch)
        for name, table in (("records", report.records), ("quarantine", report.quarantine)):
            table.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_harvest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parses the JSON page files (file, file_ord, page_no, text) of ``folder`` that are new, then stops.

    A report's pages must arrive in one file; see :func:`stream_harvest_pages` for pages that don't. Records go to
    ``out``/records, failed files to ``out``/quarantine; both carry the batch number, so a batch that is run again replaces
    what it wrote.
    """
    return _appended(spark.readStream.schema(PAGES).json(folder), out, checkpoint)


def stream_harvest_pages(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_batch: int | None = None) -> StreamingQuery:
    """Like :func:`stream_harvest` for pages that arrive apart: rows also tell how many ``pages`` their report has."""
    reader = spark.readStream.schema(f"{PAGES}, pages int")
    reader = reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)
    return _appended(complete_reports(reader.json(folder)), out, checkpoint)
