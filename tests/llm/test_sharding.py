import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meadowlark.llm import sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = sharding.curve_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    walk = grid[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def _holds(rows, docs):
    assert len(rows) == len(docs)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min([counts.get(s, 0) for s in range(16)]) <= 1 and set(counts) <= set(range(16))
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    expected = Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_law_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sharding.document_shards(docs).collect()
    _holds(rows, docs.collect())
    curves = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert curves == sorted(curves)


def test_one_cell_is_cut_like_any_other(spark):
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    _holds(sharding.document_shards(same).collect(), same.collect())


def test_odd_and_empty_tables(odd_docs, no_docs):
    _holds(sharding.document_shards(odd_docs.withColumn("shard", F.lit(99)).withColumn("curve", F.lit("x"))).collect(), odd_docs.collect())
    assert sharding.document_shards(no_docs).collect() == []


def test_manifest_and_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    placed = sharding.hilbert_shards(docs.select("doc_id", "n_chars", "source"), ["n_chars", "doc_id"], ["doc_id"], shards=4)
    manifest = {r["shard"]: r for r in sharding.shard_manifest(placed, ["n_chars"]).collect()}
    sharding.write_shards(docs, placed, "doc_id", str(tmp_path / "out"))
    for r in spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(F.min("n_chars"), F.max("n_chars"), F.count("*")).collect():
        own = manifest[r[0]]
        assert (own["min_n_chars"], own["max_n_chars"], own["rows"]) == (r[1], r[2], r[3])
