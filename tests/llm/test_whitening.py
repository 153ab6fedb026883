import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meadowlark.llm import whitening

ROWS = "vec_id long, embedding array<float>, label int"


def brute_force(vectors, components=4):
    """Integers for the exact parts, numpy for the rest, on the whole matrix at once."""
    x = np.floor(256 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), [sum(int(v) for v in column) for column in fit.T]
    centred = fit - np.array(s) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    deviation = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
    return n, deviation, (x - np.array(s) / n) @ directions / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def vectors_of(r, rows, d):
    base = np.array([[r.gauss(0, 1 / (1 + k)) for k in range(d)] for _ in range(rows)])
    return (base @ np.array([[r.gauss(0, 1) for _ in range(d)] for _ in range(d)]) + 0.3).tolist()


@pytest.mark.parametrize("rows, d, block", [(300, 12, 50), (40, 3, 1 << 22), (7, 20, 1 << 22)])
def test_brute_force(spark, monkeypatch, rows, d, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    vectors = vectors_of(random.Random(rows), rows, d)
    vectors += [vectors[0]] * rows  # copies weigh nothing
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], ROWS).repartition(6)
    n, deviation, y, explained = brute_force(vectors)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(df).collect()}
    width = min(4, d)
    assert len(got) == len(vectors) * width
    sign = [np.sign(got[0, c + 1]["whitened"] * y[0, c]) for c in range(width)]
    for (k, c), r in got.items():
        assert (r["n"], r["deviation"]) == (n, deviation[k])
        assert r["whitened"] == pytest.approx(sign[c - 1] * y[k, c - 1], abs=1e-9)
        assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors_of(random.Random(2), 30, 5)
    rows = [(k, v, k) for k, v in enumerate(good)]
    rows += [(100, None, 0), (101, [nan, 0.0, 0.0, 0.0, 0.0], 0), (102, [inf, 0.0, 0.0, 0.0, 0.0], 0), (103, [-inf] * 5, 0), (104, [None, 0.0, 0.0, 0.0, 0.0], 0)]
    rows += [(105, [], 0), (106, [1.0, 2.0], 0), (None, good[0], None), (0, good[0], 0)]
    df = spark.createDataFrame(rows, ROWS).select("*", F.lit(1).alias("component"), F.lit("a").alias("x"), F.lit(2).alias("d"))
    out = whitening.whitened(df).collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert not set(range(100, 105)) & set(by_id)
    assert [(len(by_id[k]), by_id[k][0]["component"], by_id[k][0]["whitened"], by_id[k][0]["n"]) for k in (105, 106)] == [(1, 0, None, 30)] * 2
    assert len(by_id[0]) == 8 and len(by_id[None]) == 4 and all(len(by_id[k]) == 4 for k in range(1, 30))
    assert {r["component"]: r["whitened"] for r in by_id[None]} == {r["component"]: r["whitened"] for r in by_id[0]}


def test_nothing_to_whiten(spark):
    assert whitening.whitened(spark.createDataFrame([], ROWS)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None, 0)], ROWS)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(5)], ROWS)).collect() == []


def test_few_directions(spark):
    """Points on a line have one component, however many entries they have."""
    df = spark.createDataFrame([(k, [float(k), 2.0 * k, -float(k)], 0) for k in range(9)], ROWS)
    out = whitening.whitened(df).collect()
    assert {r["component"] for r in out} == {1} and len(out) == 9 and out[0]["explained"] == pytest.approx(1)


def test_large_entries_stay_exact(spark):
    """Sums and squares beyond 64 bits: deviations that a long can't hold are null, those it can are exact."""
    big = float(2**40)
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [-big, 2.0]), (2, [0.0, 3.5])], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r["deviation"] for r in whitening.whitened(df).collect()}
    x = [[256 * 2**40, 256], [-256 * 2**40, 512], [0, 896]]
    s = [sum(c) for c in zip(*x)]
    exact = [sum((3 * v - t) ** 2 for v, t in zip(row, s)) for row in x]
    assert out == {k: v if v < 2**63 else None for k, v in enumerate(exact)} and out[2] is not None and out[0] is None
    huge = spark.createDataFrame([(k, [1e300 * (k - 1), float(k)]) for k in range(3)], "vec_id long, embedding array<double>")
    assert len(whitening.whitened(huge).collect()) > 0
