"""The pipeline on a small copy of the tables, stage by stage against plain Python."""

import random

import pytest

import corpus_pipeline
from meadowlark.llm import queries, rules, secret_scan, tiling
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute
from tests.llm.test_packing import _check


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, a leak, a secret, junk, nulls and an extra column."""
    out = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(6)
    base, item = prose(r, 120), prose(r, 40)
    made = [base, base, base + " end", prose(r, 90) + "\n" + item, prose(r, 80) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(r, 20), None, ""]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(90_000 + k, t, None, None, None if t is None else len(t)) for k, t in enumerate(made)], docs.schema)
    docs.unionByName(more).selectExpr("*", "concat('x', doc_id) AS score").write.parquet(f"{out}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r["doc_id"]: r for r in docs.collect()} if k < 4 else docs.collect()
        if k < 4:
            assert docs.columns == before.columns and all(r["score"] == f"x{r['doc_id']}" for r in kept[name].values())
    quality, single, clean, masked, packed = kept.values()
    assert {90_000, 90_001, 90_002, 90_003, 90_004} <= set(quality)
    groups = brute([(i, r["text"]) for i, r in quality.items()], 5, 80)
    assert set(single) == {i for i, (_, top) in groups.items() if i == top} and 90_001 not in single
    item = tiling.index_items([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert set(clean) == {i for i, r in single.items() if not list(tiling.leaks_of(r["text"], item, tiling.COVERAGE))} and 90_003 not in clean
    assert set(masked) == set(clean) and not any(secret_scan.base_spans(r["text"] or "") for r in masked.values())
    assert all(masked[i]["text"] == clean[i]["text"] for i in clean if not secret_scan.base_spans(clean[i]["text"] or ""))
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values() if r["text"])
    _check(packed, list(masked.values()), 2048)


def test_run_equals_its_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 100 and rows.columns[:3] == ["doc_id", "piece", "start"]


def test_run_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stage_names_and_queries():
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14)) and rules.RULES
