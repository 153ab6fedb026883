"""ZIP archives of report files: members, their routes, what can't be read, and the routed files."""

from __future__ import annotations

import os
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meadowlark.functions.text import basename, has_any
from meadowlark.operators.relational import routed
from meadowlark.sources.writers import local_path, write_routed
from meadowlark.tables import written

MEMBERS = "zip_path string, member_ord int, member string, at long, packed long, size long, crc long, method int, data binary, error string"
_FIELDS = tuple(f.split()[0] for f in MEMBERS.split(", "))
#: Packed bytes that one task reads; a larger member is a task of its own.
RUN_BYTES = 64 << 20


@dataclass
class Run(InputPartition):
    """Neighbouring members of one archive as (member_ord, member, at, packed, size, crc, method), or why it can't be read."""

    path: str
    entries: list[tuple]
    error: str | None = None
    first: int = 0


def _opened(path: str):
    """A seekable file in whatever store Arrow reaches."""
    if path.startswith(("file:/", "/")):
        return open(path.removeprefix("file:"), "rb")  # noqa: SIM115  callers close it
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def runs_of(path: str, run_bytes: int = RUN_BYTES) -> list[Run]:
    """An archive's members in runs of about ``run_bytes``, from its central directory alone."""
    try:
        with _opened(path) as raw, zipfile.ZipFile(raw) as archive:
            found = [(k, x.filename, x.header_offset, x.compress_size, x.file_size, x.CRC, -1 if x.flag_bits & 1 else x.compress_type) for k, x in enumerate(archive.infolist()) if not x.is_dir()]
    except (zipfile.BadZipFile, EOFError, OSError, ValueError, NotImplementedError) as why:
        return [Run(path, [], f"{type(why).__name__}: {why}")]
    runs, size = [], 0
    for entry in found:
        if not runs or size + entry[3] > run_bytes:
            runs.append(Run(path, []))
            size = 0
        runs[-1].entries.append(entry)
        size += entry[3]
    return runs


def read_member(raw, at: int, packed: int, size: int, crc: int, method: int) -> bytes:
    """One member by ranged reads: its local header tells where its bytes begin. Checks size and CRC-32."""
    raw.seek(at)
    head = raw.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member at its place")
    raw.seek(at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    data = raw.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif method == -1:
        raise zipfile.BadZipFile("encrypted")
    elif method != zipfile.ZIP_STORED:
        raise zipfile.BadZipFile(f"packed by method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("wrong size or checksum")
    return data


_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], run_bytes: int, with_data: bool):
        self.paths, self.run_bytes, self.with_data = paths, run_bytes, with_data

    def partitions(self) -> list[Run]:
        with ThreadPoolExecutor(16) as pool:
            return [run for runs in pool.map(lambda path: runs_of(path, self.run_bytes), self.paths) for run in runs] or [Run("", [])]

    def read(self, run: Run) -> Iterator[tuple]:
        if run.error:
            yield (run.path, 0, *[None] * 7, run.error)
        elif not self.with_data:
            yield from ((run.path, *entry, None, None) for entry in run.entries)
        elif run.entries:
            with _opened(run.path) as raw:
                for entry in run.entries:
                    try:
                        yield (run.path, *entry, read_member(raw, *entry[2:]), None)
                    except _BROKEN as why:
                        yield (run.path, *entry, None, str(why))


class ZipMembers(DataSource):
    """The members of archives. Options: ``paths`` (one a line), ``run_bytes``, ``with_data`` (else data is null).

    The driver reads central directories; each run of members is a partition whose task reads just their bytes, so an
    archive of many gigabytes is many tasks. A broken archive is one row with ``error``, a broken member a row of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in self.options.get("paths", "").split("\n") if p]
        return _Reader(paths, int(self.options.get("run_bytes", RUN_BYTES)), self.options.get("with_data", "true") == "true")


def archive_paths(spark: SparkSession, folder: str) -> list[str]:
    """The ``*.zip`` files of a folder (not of folders in it), sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.zip")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(status.getPath().toString() for status in found or [])


def read_members(spark: SparkSession, folder: str, with_data: bool = True, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The members of all archives of ``folder``; see :class:`ZipMembers`. Without data, only central directories are read."""
    spark.dataSource.register(ZipMembers)
    reader = spark.read.format("zip_members").option("run_bytes", str(run_bytes)).option("with_data", str(with_data).lower())
    return reader.option("paths", "\n".join(archive_paths(spark, folder))).load()


def with_data(members: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``members`` (rows of :func:`read_members` without data, and further columns) with their ``data`` and ``error``.

    Slim rows are dealt out by archive and place, and each task reads its members' bytes itself: no member's bytes are
    shuffled, and rows that were filtered out are never read.
    """
    names = [c for c in members.columns if c not in ("data", "error")]
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, raw = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["zip_path"] != path:
                    if raw:
                        raw.close()
                    path, raw = row["zip_path"], _opened(row["zip_path"])
                try:
                    data, error = read_member(raw, *(row[c] for c in ("at", "packed", "size", "crc", "method"))), None
                except _BROKEN as why:
                    data, error = None, str(why)
                kept = {c: pa.array([row[c]], batch.schema.field(c).type) for c in names}
                yield pa.RecordBatch.from_pydict({**kept, "data": pa.array([data], pa.binary()), "error": pa.array([error], pa.string())})

    dealt = members.select(*names).repartition("zip_path", F.floor(F.col("at") / run_bytes)).sortWithinPartitions("zip_path", "at")
    return dealt.mapInArrow(filled, ", ".join(f"{c} {kinds[c]}" for c in names) + ", data binary, error string")


def before_breaks(members: DataFrame) -> DataFrame:
    """Members up to their archive's first broken one, as a reader that gives up there leaves them; errors stay as rows."""
    first = members.where("error IS NOT NULL").groupBy("zip_path").agg(F.min("member_ord").alias("__broken"))
    return members.join(first, "zip_path", "left").where(F.col("__broken").isNull() | (F.col("member_ord") <= F.col("__broken"))).drop("__broken")


def write_archives(members: DataFrame, folder: str) -> DataFrame:
    """Packs rows (archive, member_ord, member, data) into ``folder``/archive.zip each, members in order.

    Written as the result is read: (archive, members, packed). An archive appears under its name once it is whole; its
    members stream through one task.
    """
    target = local_path(folder).rstrip("/")
    os.makedirs(target, exist_ok=True)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n, done = None, None, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                done.append((name, n, os.path.getsize(out.filename)))
                os.replace(out.filename, f"{target}/{name}.zip")

        for batch in batches:
            for archive, member, data in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if archive != name:
                    close()
                    name, n, out = archive, 0, zipfile.ZipFile(f"{target}/.{archive}-{TaskContext.get().taskAttemptId()}", "w", zipfile.ZIP_DEFLATED)
                out.writestr(zipfile.ZipInfo(member), data or b"", zipfile.ZIP_DEFLATED)
                n += 1
        close()
        columns = list(zip(*done)) if done else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["archive", "members", "packed"])

    rows = members.select("archive", "member_ord", "member", "data").repartition("archive").sortWithinPartitions("archive", "member_ord")
    return rows.mapInArrow(packed, "archive string, members long, packed long")


def is_harvest(name: Column) -> Column:
    low = F.lower(name)
    return low.contains("elk") & has_any(low, "harvest", "hunting") & low.endswith(".pdf")


def is_population(name: Column) -> Column:
    low = F.lower(name)
    return low.contains("elk") & has_any(low, "population", "estimate", "status", "herd") & low.endswith(".pdf")


def categorised(members: DataFrame) -> DataFrame:
    """PDF members with their file name and category; other members go, uncounted."""
    pdf = members.where("error IS NULL").withColumn("name", basename(F.col("member"))).where(F.lower("name").endswith(".pdf"))
    name = F.col("name")
    rules = [("harvest_reports", is_harvest(name)), ("population_estimates", is_population(name)), ("other_elk", F.lower(name).contains("elk"))]
    return pdf.withColumn("category", routed(name, rules, "skipped"))


def category_counts(categorised_members: DataFrame) -> DataFrame:
    """How many members went each way, repeated names counted each."""
    return categorised_members.groupBy("category").agg(F.count(F.lit(1)).alias("members"))


def newest_files(categorised_members: DataFrame) -> DataFrame:
    """One row per category and file name: of repeated names, the last in archive and member order."""
    names = [c for c in categorised_members.columns if c not in ("category", "name")]
    last = F.max_by(F.struct(*names), F.struct("zip_path", "member_ord"))
    kept = categorised_members.where("category <> 'skipped'").groupBy("category", "name").agg(last.alias("m"))
    return kept.select("category", "name", "m.*")


def save_files(files: DataFrame, folder: str) -> None:
    """Writes (category, name, data) as files, one folder per category; they all appear at the end or none does."""
    write_routed(files, folder)


def extract(spark: SparkSession, zip_folder: str, folder: str, run_bytes: int = RUN_BYTES) -> tuple[DataFrame, DataFrame]:
    """Routes the PDF members of all archives into ``folder``; their counts by category, and (zip_path, member, error).

    An archive is read up to its first broken member. Which member stands for a repeated name is decided on slim rows, so
    only members that are kept are read once more to be written; a member's bytes are never shuffled.
    """
    checked = written(read_members(spark, zip_folder, run_bytes=run_bytes).drop("data"))
    routed_members = categorised(before_breaks(checked))
    save_files(with_data(newest_files(routed_members), run_bytes), folder)
    return category_counts(routed_members), checked.where("error IS NOT NULL").select("zip_path", "member", "error")
