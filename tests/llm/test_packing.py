import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meadowlark.llm import packing


def naive_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def _places(lengths, capacity):
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    plan = packing.best_fit_plan(counts, capacity)
    for rank, n in enumerate(sorted(lengths, reverse=True)):
        run = np.searchsorted(plan[:, 0], rank, "right") - 1
        yield int(plan[run, 1] + rank - plan[run, 0]), int(plan[run, 2]), n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    bins = defaultdict(list)
    for sequence, offset, n in _places(lengths, 40):
        bins[sequence].append((offset, n))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 40
    assert sorted(40 - sum(n for _, n in p) for p in bins.values()) == naive_best_fit(lengths, 40)
    assert sorted(bins) == list(range(len(bins)))


def test_room_tree():
    r, tree, open_rooms = random.Random(1), packing.RoomTree(50), set()
    for _ in range(500):
        room = r.randint(0, 50)
        (open_rooms.add if r.random() < 0.5 else open_rooms.discard)(room)
        tree.put(room, room in open_rooms)
        least = r.randint(0, 50)
        assert tree.tightest(least) == min((x for x in open_rooms if x >= least), default=None)


def _check(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    for d in docs:
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[d["doc_id"]]}
        at = 0
        for k, start, n, crc in sorted(pieces):
            assert start == at and crc == zlib.crc32(ids[start : start + n].tobytes()) and (k == 0 or n == capacity)
            at += n
        assert at == len(ids)
    return len(bins)


def test_packed_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    n = _check(rows, docs.collect(), 2048)
    assert n == len(naive_best_fit([r["length"] for r in rows], 2048))


def test_small_capacity_and_ids(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "<|endoftext|> x"), (3, None)], "doc_id long, text string")
    _check(packing.pack_documents(docs, 4).collect(), docs.collect(), 4)
    cut = packing.pieces(docs, 4, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in cut)
    same = packing.pieces(docs, 4, str(public_tokenizers.path("byte_bpe_50k.json")), with_ids=True).collect()
    assert sorted(map(str, cut)) == sorted(map(str, same))


def test_odd_and_empty_tables(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs.withColumn("rank", F.lit("x")).withColumn("length", F.lit("y"))).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["doc_id"] == 6 for r in rows) == 2 and packing.pack_documents(no_docs).collect() == []


@pytest.mark.parametrize("counts", [{}, {5: 7}, {10: 3, 1: 1000}])
def test_counts(counts):
    assert sum(1 for _ in _places([n for n, c in counts.items() for _ in range(c)], 10)) == sum(counts.values())
