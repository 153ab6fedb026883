"""Hilbert-curve sharding: rows near each other in several metadata dimensions land in the same shard."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from meadowlark.llm.common import global_rank


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of ``cells`` (rows of d coordinates, each below ``2**bits``; d * bits <= 62).

    Coordinates are brought to the curve's transposed form axis by axis from the top bit, Gray-decoded and interleaved.
    """
    axes = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    d = len(axes)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for k in range(d):
            is_set = (axes[k] & bit) != 0
            swap = np.where(is_set, 0, (axes[0] ^ axes[k]) & low)
            axes[0] = axes[0] ^ swap ^ np.where(is_set, low, 0)
            if k:
                axes[k] = axes[k] ^ swap
    for k in range(1, d):
        axes[k] = axes[k] ^ axes[k - 1]
    flips = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((axes[d - 1] >> level) & 1, (1 << level) - 1, 0)
    index = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            index = (index << 1) | (((axis ^ flips) >> level) & 1)
    return index


def _cells(df: DataFrame, dims: Sequence[str], bits: int) -> list[Column]:
    """Each dimension's cell: numbers by quantiles over all rows (one sketch aggregate), others by a hash; null is 0."""
    top = (1 << bits) - 1
    numeric = [c for c in dims if isinstance(df.schema[c].dataType, NumericType)]
    cuts: dict[str, list] = {}
    if numeric:
        at = F.array(*[F.lit(k / (top + 1)) for k in range(1, top + 1)])
        row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), at, 10000).alias(f"q{k}") for k, c in enumerate(numeric)]).first()
        cuts = {c: sorted(set(row[k] or [])) for k, c in enumerate(numeric)}
    cells = []
    for c in dims:
        value = F.col(f"`{c}`")
        if c in cuts:
            # width_bucket's order: the number of cut values at or below the value
            steps = F.array(*[F.lit(float(x)) for x in cuts[c]]) if cuts[c] else F.array().cast("array<double>")
            cell = F.size(F.filter(steps, lambda x, value=value: x <= value.cast("double")))
        else:
            cell = F.pmod(F.crc32(value.cast("string")), F.lit(top)) + 1
        cells.append(F.when(value.isNull(), 0).otherwise(cell).cast("int"))
    return cells


def hilbert_shards(df: DataFrame, dims: Sequence[str], unique: Sequence[str], shards: int = 16, bits: int = 5) -> DataFrame:
    """``df`` with ``curve`` (long), ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    All rows are ranked by the curve index of their quantised ``dims``, ties by ``unique``, and the ranking is cut into
    ``shards`` runs whose row counts differ by one at most. Only as wide as ``df``: pass the columns that are needed,
    without long texts. Nulls have a cell of their own, repeated rows keep a slot each, an empty table gives an empty
    result; an index that very many rows share is cut like any other run.
    """
    if len(dims) * bits > 62:
        raise ValueError("dims * bits must be at most 62")

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(curve_index(cells.to_numpy(), bits))

    cells = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(_cells(df, dims, bits))])
    ranked = global_rank(df.withColumn("curve", curve(cells)), F.col("curve"), *[F.col(f"`{c}`") for c in unique])
    shard = F.expr(f"(rank * {shards}) div rank_total")
    first = F.expr(f"(shard * rank_total + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("rank") - first).cast("long"))
        .drop("rank", "rank_total")
    )


def shard_manifest(sharded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Each shard's row count and its least and greatest value of each dimension, for pruning shards before a read."""
    bounds = [f(F.col(f"`{c}`")).alias(f"{name}_{c}") for c in dims for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *bounds)


def write_shards(docs: DataFrame, sharded: DataFrame, key: str, path: str) -> None:
    """Writes ``docs`` as one folder per shard, each sorted by the curve; rows of equal ``key`` must be one row."""
    placed = docs.join(sharded.select(key, "shard", "slot"), key)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All documents in ``shards`` shards by source, language, length and id, under the law of equal row counts.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32: of the UTF-8 bytes, null text as empty; grown_shard
    is null under this law. Equal texts are not kept together: a group of copies may be a third of all rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "source",
        "lang",
        "n_chars",
    )
    placed = hilbert_shards(slim, ["source", "lang", "n_chars", "doc_id"], ["doc_id", "text_crc32", "size"], shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
