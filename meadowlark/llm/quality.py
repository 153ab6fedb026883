"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Random Fourier features approximate a Gaussian kernel, so the ridge fit is linear in them and needs only sums: each
partition adds up its part of the normal equations, Spark adds the parts, the driver solves one system of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.llm.common import PLAIN_WORD, shingle_hashes, word_hashes

#: At most so many labelled rows are used for fitting, the first by a hash of doc_id; more change the fit little.
FIT_ROWS = 20_000
FEATURES, RIDGE, SEED = 256, 1e-3, 11
ACCEPT = 0.7

STATISTICS = (
    "log_words", "log_lines", "mean_word", "std_word", "upper", "digit", "symbol", "bang", "punctuation", "space", "other_bytes",
    "distinct_words", "top_word", "next_equal", "repeated_runs", "equal_lines", "short_line", "byte_entropy",
)

_CLASSES = np.zeros((6, 256), np.float64)
for _row, _bytes in zip(_CLASSES, (range(65, 91), range(48, 58), b"#*$%&|<>@^~_=+\\/{}[]", b"!", b".,;:?'\"()-", b" \t\n\x0b\x0c\r")):
    _row[list(_bytes)] = 1


def statistics(text: str | None) -> np.ndarray:
    """The STATISTICS of a whole text; all zeros for a null or empty one."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(len(STATISTICS))
    if not data:
        return out
    raw = np.frombuffer(data, np.uint8)
    count = np.bincount(raw, minlength=256)
    share = count / len(raw)
    words, start, end = word_hashes(data, PLAIN_WORD)
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[0], out[1] = np.log1p(n), np.log1p(len(lines))
    out[4:10] = _CLASSES @ share
    out[10] = share[128:].sum()
    if n:
        size = end - start
        out[2], out[3] = size.mean(), size.std()
        kinds, times = np.unique(words, return_counts=True)
        # the count of distinct words falls with length; its exponent hardly does
        out[11] = np.log(len(kinds)) / np.log(n) if n > 1 else 1.0
        out[12] = times.max() / n
        out[13] = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
        runs = shingle_hashes(words, 4)
        out[14] = 1 - len(np.unique(runs)) / len(runs) if len(runs) else 0.0
    if lines:
        out[15] = 1 - len(set(lines)) / len(lines)
        out[16] = np.mean([len(x) < 20 for x in lines])
    some = share[share > 0]
    out[17] = -(some * np.log2(some)).sum()
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of standardised statistics, and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.waves + self.phases) * np.sqrt(2 / self.waves.shape[1])
        return np.hstack([z, np.ones((len(stats), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.empty(0)
        return np.clip(np.interp(self.fourier(stats) @ self.weights, self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step fit of ``y`` by ``x`` (pool adjacent violators), as each pool's mean x and level."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, sum of x, count
    for a, b in zip(x[order], y[order]):
        pools.append([float(b), float(a), 1.0])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[1] / p[2] for p in pools]), np.array([p[0] / p[2] for p in pools])


def _bucket(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary"))


def held_out(key: Column) -> Column:
    """Rows from which no label is learnt: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(_bucket(key) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on a bounded sample of labelled rows outside the held-out part; one in four of them calibrates the scores.

    A null label or key is no label, and of several labels of a key the greatest counts; repeated documents count each.
    Without labels, or with one label only, the score is the same for all. Whole texts are measured, however long; only
    the key, the text and the label are taken, so further columns and their names don't matter.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    sample = (
        ids.groupBy(key).agg(F.max(label).cast("double").alias("__label"))
        .orderBy(F.xxhash64(key), key).limit(fit_rows)
        .withColumn("__part", (F.floor(_bucket(F.col(key)) / 4) % 4).cast("int"))
    )
    # at most fit_rows ids: the broadcast has a fixed bound
    rows = docs.select(key, "text").join(F.broadcast(sample), key).select("__label", "__part", F.col("text").cast("string"))
    width = len(STATISTICS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(stats, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "part", "stats"])

    measured = rows.mapInArrow(measure, "label double, part int, stats array<double>").persist()
    sums = measured.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("positive"),
        *[F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(width)],
        *[F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(width)],
    ).first()
    rng = np.random.default_rng(SEED)
    waves = rng.standard_normal((width, FEATURES)) / np.sqrt(width)
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    flat = np.array([0.0, 1.0])
    if not sums["n"] or sums["positive"] in (0, sums["n"]):
        measured.unpersist()
        level = 0.5 if not sums["n"] else float(sums["positive"] / sums["n"])
        return Model(np.zeros(width), np.ones(width), waves, phases, np.zeros(FEATURES + 1), flat, np.full(2, level))
    mean = np.array([sums[f"m{k}"] for k in range(width)])
    scale = np.maximum(np.array([sums[f"s{k}"] for k in range(width)]), 1e-6)
    model = Model(mean, scale, waves, phases, np.zeros(FEATURES + 1), flat, flat)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for rows in batches:
            if len(rows):
                z = model.fourier(np.stack(rows["stats"].to_numpy()))
                total += z.T @ np.hstack([z, rows[["label"]].to_numpy()])
        yield pd.DataFrame({"line": range(FEATURES + 1), "values": list(total)})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": [rows["line"].iloc[0]], "values": [np.sum(np.stack(rows["values"].to_numpy()), 0)]})

    shape = "line int, values array<double>"
    parts = measured.where("part <> 3").coalesce(16).mapInPandas(partial, shape)
    lines = sorted((r["line"], r["values"]) for r in parts.groupBy("line").applyInPandas(added, shape).collect())
    equations = np.array([v for _, v in lines])
    gram, target = equations[:, :-1], equations[:, -1]
    n_fit = max(gram[-1, -1], 1.0)
    model = model._replace(weights=np.linalg.solve(gram + RIDGE * n_fit * np.eye(FEATURES + 1) / FEATURES, target))

    held = measured.where("part = 3").select("label", "stats").collect()  # at most fit_rows small rows
    measured.unpersist()
    if held:
        raw = model.fourier(np.array([r["stats"] for r in held])) @ model.weights
        knots, levels = isotonic(raw, np.array([r["label"] for r in held]))
        model = model._replace(knots=knots, levels=levels)
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Per row: the key, held_out, score (0 to 1) and predicted; null and empty texts get a score like any other.

    A null key is not held out; repeated rows are scored each. Whole texts are measured, however long; only the key and
    the text are taken, so further columns and their names don't matter.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))))

    rows = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; each row is judged by its own text."""

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))) >= ACCEPT)

    return docs.where(keep(F.col("text").cast("string")))
