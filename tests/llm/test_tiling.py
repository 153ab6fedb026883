import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from meadowlark.llm import tiling
from tests.llm.conftest import prose


def naive(doc, item, least):
    """Greedy string tiling by the definition: the longest unmarked common runs, again and again."""
    used_d, used_i, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = least - 1, []
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not used_d[a + n] and not used_i[b + n]:
                    n += 1
                if n > best:
                    best, found = n, [(a, b)]
                elif n == best >= least:
                    found.append((a, b))
        if best < least:
            return sum(tiles)
        for a, b in sorted(found, key=lambda x: (x[1], x[0])):
            if not any(used_d[a : a + best]) and not any(used_i[b : b + best]):
                used_d[a : a + best] = used_i[b : b + best] = [True] * best
                tiles.append(best)


def test_tiles_equal_the_definition():
    r = random.Random(8)
    for _ in range(60):
        item = [r.choice("abcdef") for _ in range(r.randint(5, 25))] if r.random() < 0.5 else prose(r, 20).split()
        doc = prose(r, 5).split()
        for _ in range(r.randint(1, 4)):
            a, b = sorted(r.randrange(len(item) + 1) for _ in range(2))
            doc += item[a:b] + prose(r, r.randint(0, 2)).split()
        seeds = tiling.index_items([(1, " ".join(item))])
        got = [x for x in tiling.leaks_of(" ".join(doc), seeds, 0.0)]
        assert (round(got[0][1] * len(item)) if got else 0) == naive(doc, item, tiling.SEED)


def test_the_query_equals_brute_force(spark):
    r = random.Random(12)
    items = [(k, prose(r, r.choice([2, 4, 5, 9, 30]))) for k in range(12)] + [(None, prose(r, 12)), (-1, prose(r, 8))]
    docs = []
    for k in range(60):
        parts = [prose(r, r.randint(1, 20))]
        for _ in range(r.randint(0, 3)):
            words = r.choice(items)[1].split()
            cut = r.randint(0, len(words))
            parts += r.choice([[" ".join(words)], [" ".join(words[cut:]), " ".join(words[:cut])], [" ".join(words[: cut + 1])]])
        r.shuffle(parts)
        docs.append((k, " ".join(parts)))

    def share(doc, item):
        doc, item = doc.split(), item.split()
        if len(item) < tiling.SEED:
            return float(any(doc[k : k + len(item)] == item for k in range(len(doc))))
        return naive(doc, item, tiling.SEED) / len(item)

    wanted = sorted((d, -9 if i is None else i, share(text, item)) for d, text in docs for i, item in items if share(text, item) >= tiling.COVERAGE)
    found = tiling.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((x["doc_id"], -9 if x["item_id"] is None else x["item_id"], x["coverage"]) for x in found.collect()) == wanted and len(wanted) > 20


def test_memory_grows_with_the_texts_and_not_with_pairs_of_places():
    r = random.Random(4)
    stem = prose(r, 8)
    repeated = tiling.index_items([(1, " ".join(["again"] * 200))])
    stems = tiling.index_items([(k, f"{stem} {prose(r, 20)}") for k in range(20_000)])
    tracemalloc.start()
    assert list(tiling.leaks_of(" ".join(["again"] * 100_000), repeated, 0.6)) == [(0, 1.0, 1, 200)]
    assert list(tiling.leaks_of(f"{prose(r, 50)} {stem} {prose(r, 500)}", stems, 0.6)) == []
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_leaks(spark):
    r = random.Random(1)
    item = prose(r, 40)
    half = item.split()
    docs = [
        (1, prose(r, 200) + " " + item + " " + prose(r, 50)), (2, " ".join([*half[20:], "and", *half[:20]]).upper() + "!"), (3, prose(r, 300)),
        (4, " ".join(half[:10])), (5, item.replace(" ", ", ")), (6, None), (7, ""), (8, item), (8, item),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("mine"))
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (None, item)], "item_id long, text string")
    rows = tiling.find_leaks(df, bench).where("item_id = 7").collect()
    assert sorted(x["doc_id"] for x in rows) == [1, 2, 5, 8, 8]
    assert {x["doc_id"]: x["n_tiles"] for x in rows}[2] == 2
    kept = tiling.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == [3, 4, 6, 7]


def test_blocks_of_a_large_benchmark_give_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, tiling.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 1500)
    assert sorted(map(tuple, tiling.find_leaks(docs, bench).collect())) == whole
    assert tiling.decontaminate(docs, bench).count() == docs.count() - len({x[0] for x in whole})


def test_odd_and_empty_tables(odd_docs, no_docs, spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert tiling.find_leaks(odd_docs, bench).collect() == [] and tiling.find_leaks(no_docs, bench).collect() == []
    assert tiling.find_leaks(odd_docs, bench.where("false")).collect() == []
    assert tiling.decontaminate(odd_docs, bench).count() == odd_docs.count()
    assert len(tiling.words("Ä b")) == 2 and np.array_equal(tiling.words("Ä b"), tiling.words("ä, B"))
