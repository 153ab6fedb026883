import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meadowlark.llm import jaccard
from meadowlark.llm.components import connected, follow
from tests.llm.conftest import DOCS, prose


def brute(rows, k, percent):
    """doc_id to (set size, smallest id of its component), by comparing all pairs."""
    sets, parent = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def mutated(r, words, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        choice = r.random()
        if choice < 0.4:
            words[at] = prose(r, 1)
        elif choice < 0.7:
            words.insert(at, prose(r, 1))
        elif len(words) > 1:
            del words[at]
    return words


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 50)])
def test_equals_brute_force(spark, seed, k, percent):
    r = random.Random(seed)
    shared = prose(r, 15)
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 12, 20, 40, 90, 200):
        base = prose(r, size).split()
        for edits in (0, 0, 1, 1, 1, 2, 2, 3, 4, 6, 9):
            words = mutated(r, base, min(edits, size))
            rows.append(" ".join(words) if r.random() < 0.7 else f"{shared}\n{' '.join(words).upper()}")
    rows = list(enumerate([*rows, None, "", " \n"]))
    r.shuffle(rows)
    found = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == brute(rows, k, percent)


def test_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = prose(r, 150).split()
    rows = [(i, " ".join(mutated(r, base, 1 + i % 4))) for i in range(300)] + [(1000 + i, prose(r, 60)) for i in range(50)]
    found = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == brute(rows, 4, 85)


def test_tree_finds_every_pair_that_counts_allow():
    rng = np.random.default_rng(4)
    points = rng.poisson(2, (300, 16)).astype(np.uint8)
    points[150:] = points[:150] + rng.integers(0, 2, (150, 16)).astype(np.uint8)
    extra = np.where(np.arange(300) % 7 == 0, 5, 0)
    sizes, rule = points.sum(1).astype(np.int64) + extra, jaccard.Rule(85)
    x, y, overlap = jaccard.CountTree(points, sizes, extra).pairs(rule)
    found = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    for a in range(300):
        for b in range(a):
            allowed = np.minimum(points[a], points[b]).sum(dtype=int) + min(extra[a], extra[b]) >= rule.overlap(sizes[a] + sizes[b])
            assert ((b, a) in found) == bool(allowed)


def test_linked_sets_share_a_signature():
    rng, rule = np.random.default_rng(1), jaccard.Rule(85)
    for n in (1, 2, 6, 7, 13, 20, 55, 130, 400):
        for _ in range(30):
            base = np.unique(rng.integers(0, 1 << 62, n + 200).astype(np.uint64))
            gone = rng.integers(0, max(1, n // 7))
            a, b = base[:n], base[gone : n + rng.integers(0, max(1, n // 7))]
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                number, sig = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), rule)
                assert set(sig[number == 0]) & set(sig[number == 1]), (n, len(a), len(b))


def test_short_and_blank_texts():
    values, at = jaccard.shingle_sets(pa.array(["a b", "A  B", "", None, " ", "a b c d", "a b c d e", "b a"]), 4)
    assert np.diff(at).tolist() == [1, 1, 0, 0, 0, 1, 2, 1]
    ids = jaccard.class_ids(values, at)
    assert ids[0] == ids[1] != ids[7]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {x["id"]: x["root"] for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: find(i) for i in {v for a, b in edges if a != b for v in (a, b)}}
    chain = follow(spark.createDataFrame([(i, i - 1) for i in range(1, 70)], "id long, parent long"))
    assert {x["parent"] for x in chain.collect()} == {0}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_and_empty_tables(odd_docs, no_docs):
    rows = jaccard.similar_groups(odd_docs.withColumn("cid", F.lit("x"))).collect()
    by_id = {(x["doc_id"], x["n_shingles"]): x["component_id"] for x in rows}
    assert len(rows) == odd_docs.count() and by_id[1, 0] == 1 and by_id[6, 4] == 6 and by_id[None, 4] == 6
    assert jaccard.similar_groups(no_docs).collect() == []


def test_one_of_each_group_stays(spark):
    r = random.Random(2)
    base = prose(r, 100)
    rows = [(3, base, "x"), (5, base + " end", "y"), (5, base + " end", "y"), (9, prose(r, 80), "z"), (9, None, "n"), (None, base, "q"), (11, "tiny", "t"), (11, "tiny", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    kept = jaccard.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"] or 0, x["more"]) for x in kept.collect()) == [(0, "q"), (3, "x"), (9, "n"), (9, "z"), (11, "t")]
    assert DOCS
