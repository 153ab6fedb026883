"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as words. Runs of SEED words that both hold are the seeds, found by running
Karp-Rabin hashes of the whole text against the items' hashes. Where seeds could cover enough of an item, tiles are
marked: the longest common runs first, never overlapping in either text. Tiles may stand in any order, so passages that
were cut up and reordered still count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.llm.common import run_hashes, run_sums, word_hashes

SEED = 5
COVERAGE = 0.6
#: Bytes of benchmark text that are held in memory at once; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 8 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

LEAKS = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int"


def words(text: str | None) -> np.ndarray:
    """Hashes of a text's words: lower-cased runs of ASCII letters and digits and of any other non-ASCII characters."""
    return word_hashes((text or "").lower().encode("utf-8", "replace"), _WORD)[0]


class Seeds(NamedTuple):
    """A block of items: their words, and every seed's hash, item and place, sorted by hash.

    An item of fewer than SEED words is its own only seed; ``short`` has the hashes and items of these by word count.
    """

    ids: list[int | None]
    words: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def index_items(rows: list[tuple[int | None, str]]) -> Seeds:
    listed = [words(text) for _, text in rows]
    grams = [run_hashes(run_sums(w), SEED) for w in listed]
    hashes = np.concatenate([np.empty(0, np.uint64), *grams])
    item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])
    order = np.argsort(hashes, kind="stable")
    short = {}
    for n in range(1, SEED):
        mine = np.array([k for k, w in enumerate(listed) if len(w) == n], np.int64)
        if len(mine):
            short[n] = (np.concatenate([run_hashes(run_sums(listed[k]), n) for k in mine]), mine)
    return Seeds([i for i, _ in rows], listed, hashes[order], item[order], place[order], short)


class _Side:
    """One text's words for tiling: which places are left, and the hashes of the runs of free words of a length."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.sums, self.at = run_sums(words), at
        self.marked = np.zeros(len(words), bool)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of ``n`` words that are neighbours and free."""
        used = np.concatenate([[0], np.cumsum(self.marked)])
        where = np.flatnonzero((used[n:] == used[:-n]) & (self.at[n - 1 :] - self.at[: len(self.at) - n + 1] == n - 1))
        return where, run_hashes(self.sums, n)[where]


def tile(doc: np.ndarray, at: np.ndarray, item: np.ndarray) -> list[int]:
    """Lengths of the greedy tiles of an item and the words ``doc`` of a text, which stand at ``at``.

    Each round finds the greatest length of which free words have a common run (runs of a length contain shorter ones, so
    by halving), and marks its matches in the item's order, each at its first free place in the text. Common runs are
    found by hashes of all runs of one length, so memory grows with the texts and not with their pairs of places.
    """
    left, right = _Side(doc, at), _Side(item, np.arange(len(item)))
    most, tiles = min(len(doc), len(item)), []
    while most >= SEED:
        low, high = SEED - 1, most  # a common run of length low is known; none is longer than high
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(right.runs(middle)[1], left.runs(middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        most = low
        if most < SEED:
            break
        (here, mine), (there, its) = left.runs(most), right.runs(most)
        order = np.argsort(mine, kind="stable")
        first, end = np.searchsorted(mine[order], its, "left"), np.searchsorted(mine[order], its, "right")
        tried: dict[int, int] = {}  # places before this one are marked already
        for place, a, b in zip(there.tolist(), first.tolist(), end.tolist()):
            if a == b or right.marked[place : place + most].any():
                continue
            k = tried.get(a, a)
            while k < b and left.marked[here[order[k]] : here[order[k]] + most].any():
                k += 1
            tried[a] = k
            if k < b:
                start = here[order[k]]
                left.marked[start : start + most] = right.marked[place : place + most] = True
                tiles.append(most)
        most -= 1
    return tiles


def leaks_of(text: str | None, seeds: Seeds, coverage: float) -> Iterator[tuple[int, float, int, int]]:
    """The items of which a text's tiles cover at least ``coverage``: index, coverage, tiles, longest tile.

    Only items of which the text's seeds reach that much are tiled; that is counted over the item's distinct seeds, so a
    seed that stands very often in the text or in very many items costs its places in the items once.
    """
    mine = words(text)
    sums = run_sums(mine)
    for n, (hashes, items) in seeds.short.items():
        for k in items[np.isin(hashes, run_hashes(sums, n))].tolist():
            yield k, 1.0, 1, n
    grams = run_hashes(sums, SEED)
    if not len(grams) or not len(seeds.hashes):
        return
    low = np.searchsorted(seeds.hashes, grams)
    common = seeds.hashes[np.minimum(low, len(seeds.hashes) - 1)] == grams
    if not common.any():
        return
    kinds = np.unique(grams[common])
    first, end = np.searchsorted(seeds.hashes, kinds, "left"), np.searchsorted(seeds.hashes, kinds, "right")
    entries = np.repeat(first - np.concatenate([[0], np.cumsum(end - first)[:-1]]), end - first) + np.arange((end - first).sum())
    item, place = seeds.item[entries], seeds.place[entries]
    order = np.lexsort((place, item))
    item, place = item[order], place[order]
    step = np.full(len(item), SEED)
    same = item[1:] == item[:-1]
    step[:-1][same] = np.minimum(place[1:] - place[:-1], SEED)[same]
    starts = np.flatnonzero(np.diff(item, prepend=-1))
    for k, reach in zip(item[starts].tolist(), np.add.reduceat(step, starts).tolist()):
        size = len(seeds.words[k])
        if reach < coverage * size:  # tiles can't cover more than the seeds do
            continue
        own = run_hashes(run_sums(seeds.words[k]), SEED)
        found = np.flatnonzero(common)[np.isin(grams[common], own)]
        held = np.zeros(len(mine), bool)
        for i in range(SEED):
            held[found + i] = True
        at = np.flatnonzero(held)
        tiles = tile(mine[at], at, seeds.words[k])
        if sum(tiles) >= coverage * size:
            yield k, sum(tiles) / size, len(tiles), max(tiles)


def _blocks(benchmark: DataFrame) -> Iterator[Seeds]:
    """The benchmark's seeds, in blocks of about BLOCK_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(total // BLOCK_BYTES)
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield index_items(sorted(((r["item_id"], r["text"]) for r in mine.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and benchmark item that it leaks: doc_id, item_id, coverage, n_tiles, longest_tile.

    Every document is scanned whole, in one pass per benchmark block of BLOCK_BYTES, without a shuffle. Items of fewer
    than SEED words are found where all their words stand in a row; null texts and those without words match nothing.
    Repeated rows of either table are reported each; an item without an id keeps a null id. Very long texts and seeds
    that repeat in them or stand in very many items cost memory by their places, never by pairs of places.
    """
    names = ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for seeds in _blocks(benchmark):

        def scan(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc, seeds.ids[k], share, n, longest)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))
                    for k, share, n, longest in leaks_of(text.as_py(), seeds, coverage)
                ]
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        part = slim.mapInArrow(scan, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(seeds: Seeds, coverage: float):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([next(leaks_of(text, seeds, coverage), None) is None for text in texts], dtype=bool)

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows whose text leaks an item, judged row by row in place, without a join."""
    for seeds in _blocks(benchmark):
        docs = docs.where(_clean(seeds, coverage)(F.col("text").cast("string")))
    return docs
