import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meadowlark.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    rows = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(rows[x["doc_id"]]["predicted"], x["quality"]) for x in labels.collect() if rows[x["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.93
    kept = quality.accepted(docs.withColumn("score", F.lit("x")), model)
    assert kept.count() == sum(r["predicted"] for r in rows.values()) and kept.columns == [*docs.columns, "score"]


def test_labels_of_held_out_rows_are_not_read(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.levels, b.levels)


def test_fit_rows_bound(tables, monkeypatch):
    docs, labels = tables
    assert quality.fit(docs, labels, fit_rows=60).weights.shape == (quality.FEATURES + 1,)


def _naive_isotonic(x, y):
    """Levels by their min-max formula: the greatest over starts of the least over ends of the mean between."""
    order = np.argsort(x, kind="stable")
    x, y, n = x[order], y[order], len(x)
    sums = np.concatenate([[0.0], np.cumsum(y)])
    level = [max(min((sums[k + 1] - sums[j]) / (k + 1 - j) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
    pools = np.flatnonzero(np.concatenate([[True], np.diff(level) > 1e-12]))
    return np.array([p.mean() for p in np.split(x, pools[1:])]), np.array(level)[pools]


def test_scores_equal_one_plain_fit(tables):
    """The ridge as one least squares problem over all rows at once, and naive isotonic levels."""
    docs, labels = tables
    goal = {}
    for r in labels.where("quality is not null").collect():
        goal[r["doc_id"]] = max(r["quality"], goal.get(r["doc_id"], 0))
    part = lambda i: zlib.crc32(str(i).encode()) // 4 % 4
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    learnt = [i for i in texts if i in goal and zlib.crc32(str(i).encode()) % 4 != 2]
    assert 100 < len(learnt) < quality.FIT_ROWS and all(i is not None for i in learnt)
    stats = {i: quality.statistics(t) for i, t in texts.items()}
    seen = np.array([stats[i] for i in learnt])
    rng = np.random.default_rng(quality.SEED)
    waves = rng.standard_normal((seen.shape[1], quality.FEATURES)) / np.sqrt(seen.shape[1])
    phases = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    scale = np.maximum(seen.std(0), 1e-6)

    def features(ids):
        x = np.clip((np.array([stats[i] for i in ids]) - seen.mean(0)) / scale, -6, 6)
        return np.hstack([np.cos(x @ waves + phases) * np.sqrt(2 / quality.FEATURES), np.ones((len(x), 1))])

    fitted, calibrated = [i for i in learnt if part(i) != 3], [i for i in learnt if part(i) == 3]
    ridge = np.sqrt(quality.RIDGE * len(fitted) / quality.FEATURES) * np.eye(quality.FEATURES + 1)
    target = np.concatenate([[goal[i] for i in fitted], np.zeros(quality.FEATURES + 1)])
    weights = np.linalg.lstsq(np.vstack([features(fitted), ridge]), target, rcond=None)[0]
    knots, levels = _naive_isotonic(features(calibrated) @ weights, np.array([float(goal[i]) for i in calibrated]))
    expected = dict(zip(texts, np.clip(np.interp(features(texts) @ weights, knots, levels), 0, 1)))
    for r in quality.scored(docs, quality.fit(docs, labels)).collect():
        assert abs(r["score"] - expected[r["doc_id"]]) < 1e-5, r["doc_id"]


def test_isotonic_never_falls():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, 400)
    knots, levels = quality.isotonic(x, (rng.uniform(0, 1, 400) < x).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all() and abs(levels[0]) < 0.3 and levels[-1] > 0.7


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    waves = rng.standard_normal((d, 4000)) / np.sqrt(d)
    model = quality.Model(np.zeros(d), np.ones(d), waves, rng.uniform(0, 2 * np.pi, 4000), np.zeros(4001), np.array([0.0, 1]), np.array([0.0, 1]))
    x = rng.standard_normal((20, d))
    z = model.fourier(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * d))
    assert np.abs(z @ z.T - exact).max() < 0.08


def test_odd_empty_and_unlabelled(spark, odd_docs, no_docs, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    assert quality.scored(odd_docs, model).where("score is null").count() == 0 and quality.scored(no_docs, model).collect() == []
    for some in (labels.where("false"), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert quality.scored(odd_docs, quality.fit(docs, some)).where("score between 0 and 1").count() == odd_docs.count()
