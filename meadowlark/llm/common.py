"""What several corpus operators share: durable cuts of lineage, exact global ranks and word hashing."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only on a local master (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="meadowlark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Narrow rows that one task writes to one file of a small durable table.
ROWS_A_FILE = 1 << 16


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    Cuts the lineage so that lost executors cost a read and not a recomputation. The files go when the session ends, or
    by :func:`release`. ``rows`` is an upper bound of the row count where one is known: a small table of narrow rows is
    then written by as few tasks as it needs, not as one tiny file per shuffle partition; a large one by all.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{checkpoint_dir(spark).rstrip('/')}/meadowlark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out, lambda _, key=id(out): _WRITTEN.pop(key, None)), lambda: files.delete(hadoop_path, True))
    return out


_WRITTEN: dict[int, tuple] = {}


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables from :func:`durable` that no later job reads."""
    for table in tables:
        _, delete = _WRITTEN.pop(id(table))
        delete()


def global_rank(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``rank`` (long, gapless from 0 in ``order``) and ``rank_total`` (long, the row count).

    One range shuffle; then each partition numbers its own rows and adds the count of the partitions before it. The
    broadcast table has one row per partition. ``order`` should end in a unique column: ties then never decide, and a
    value that very many rows share is split over partitions.
    """
    numbered = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftrightunsigned("__id", 33))
    )
    counts = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__part",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy()).alias("rank_total"),
    )
    in_part = F.col("__id").bitwiseAND((1 << 33) - 1)
    return (
        numbered.join(F.broadcast(offsets), "__part")
        .withColumn("rank", F.col("__before") + in_part)
        .drop("__id", "__part", "__before")
    )


#: The bytes of [\x20\x09-\x0D].
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = splitmix(np.arange(256))


def _powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    kept = _kept.get(base)
    if kept is None or len(kept) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            kept = np.full(size, base, np.uint64)
            kept[0] = 1
            kept = np.cumprod(kept, dtype=np.uint64)
        if size <= 1 << 20:
            _kept[base] = kept
    return kept[:n]


def _hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges: differences of prefix sums of byte values times powers of an odd base, modulo 2**64."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[raw] * _powers(_BASE, len(raw)), out=sums[1:])
        hashed = (sums[end] - sums[start]) * _powers(_BASE_INVERSE, len(raw))[start]
        hashed ^= (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return splitmix(hashed)


def word_hashes(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of ``data`` (runs of bytes that ``is_word`` marks): their 64-bit hashes, starts and ends."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.diff(is_word[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return _hashed(raw, start, end), start, end


def words_of_all(texts: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of many texts one after another, ASCII letters lower-cased, and where each text's words begin.

    A few numpy passes over all bytes at once; null texts count as empty. The offsets have one entry more than texts.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer((data.slice(at[0], at[-1] - at[0]).to_pybytes() if data is not None else b"").lower(), np.uint8)
    at = at - at[0]
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    bound = np.zeros(len(raw) + 1, bool)
    bound[at] = bound[-1] = True
    word = is_word[raw]
    gap = np.ones(len(raw) + 1, bool)
    np.logical_not(word, out=gap[1:])
    start = np.flatnonzero(word & (gap[:-1] | bound[:-1]))
    gap[:-1], gap[-1] = ~word, True
    end = np.flatnonzero(word & (gap[1:] | bound[1:])) + 1
    return _hashed(raw, start, end), np.searchsorted(start, at)


def in_chunks(texts: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, pa.Array]]:
    """Slices of ``texts`` of about ``size`` bytes each (one text at least), with their first positions."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < len(texts):
        before = ends[k - 1] if k else 0
        n = max(1, int(np.searchsorted(ends, before + size, "right")) - k)
        yield k, texts.slice(k, n)
        k += n


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words, in order; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n] * np.uint64(_BASE)
        for i in range(1, k):
            out += words[i : i + n] * np.uint64(pow(_BASE, 2 * i + 1, 1 << 64))
    return splitmix(out)


def run_sums(words: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`run_hashes` takes the hashes of runs of any length, one subtraction a run."""
    sums = np.zeros(len(words) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words * _powers(_BASE, len(words)), out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words; equal runs of any two texts have equal ones."""
    if len(sums) <= k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        return splitmix((sums[k:] - sums[:-k]) * _powers(_BASE_INVERSE, len(sums) - k))


#: True for the bytes outside [\x20\x09-\x0D].
PLAIN_WORD = np.ones(256, bool)
PLAIN_WORD[list(SPACE_BYTES)] = False
