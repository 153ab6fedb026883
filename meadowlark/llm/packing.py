"""Best-fit-decreasing packing of token pieces into sequences of a fixed length.

Pieces of one length are interchangeable, and so are open sequences with the same room. So the packing is decided on
the count of pieces of each length alone: at most ``capacity`` numbers reach the driver, however many documents there
are. The plan names runs: ranks ``lo..hi-1`` among all pieces (longest first) go to the sequences from ``bin`` on, one
each, at one offset. Every piece then finds its place from its exact global rank.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.llm.common import durable, global_rank

END_ID = 0


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to token ids for a vocabulary file: ranks (``.tiktoken``) or a ``tokenizers`` JSON file."""
    if not path.endswith(".tiktoken"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    end = "<|endoftext|>"
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end: len(ranks)})
    return lambda text: encoding.encode(text, allowed_special="all") if end in text else encoding.encode_ordinary(text)


def default_vocabulary() -> str:
    """The byte-level vocabulary as ranks; it gives the ids of byte_bpe_50k.json (tests compare the two)."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each document's token ids and a final 0, cut into pieces of ``capacity`` if longer (the first takes the rest).

    A null text counts as empty and so is one piece of one id; repeated rows are packed as often as they occur.
    Only doc_id and text are taken, so further columns and their names don't matter.
    ``with_ids`` adds the ids themselves.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids = np.array([*ids, END_ID], "<u4")
                first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    row = (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    rows.append((*row, ids[a:b].astype(np.int32)) if with_ids else row)
            columns = list(zip(*rows)) if rows else [()] * (5 + with_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names[: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


class RoomTree:
    """A segment tree over remaining capacities: which of them have open sequences, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length()
        self.any = [False] * (2 * self.leaves)

    def put(self, room: int, is_open: bool) -> None:
        node = room + self.leaves
        self.any[node] = is_open
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` with an open sequence."""
        node = least + self.leaves
        if self.any[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (lo, bin, offset), by lo: where the pieces of rank lo and up (longest first) go, one sequence each.

    The same packing as best-fit decreasing over the single pieces: a sequence with room r takes r // length pieces of
    one length before the next-tightest is looked for.
    """
    tree, runs = RoomTree(capacity), [deque() for _ in range(capacity + 1)]
    plan: list[tuple[int, int, int]] = []
    rank = bins = 0

    def give_back(room: int, first: int, n: int) -> None:
        if room and n:
            if not runs[room]:
                tree.put(room, True)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].popleft()
                if not runs[room]:
                    tree.put(room, False)
            each = room // length
            full = min(n, left // each)
            for layer in range(each if full else 0):
                plan.append((rank, first, capacity - room + layer * length))
                rank += full
            left -= full * each
            give_back(room - each * length, first, full)
            if full < n and left:
                for layer in range(left):
                    plan.append((rank, first + full, capacity - room + layer * length))
                    rank += 1
                give_back(room - left * length, first + full, 1)
                left, full = 0, full + 1
            give_back(room, first + full, n - full)
    return np.array(plan, np.int64).reshape(-1, 3)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` (from :func:`pieces`) with ``sequence_id`` and ``offset`` by best-fit decreasing over all pieces."""
    cut = durable(cut)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    ranked = global_rank(cut, F.col("length").desc(), "doc_id", "piece", "ids_crc32").drop("rank_total")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rank = rows.pop("rank").to_numpy()
            run = np.searchsorted(plan[:, 0], rank, "right") - 1
            yield rows.assign(sequence_id=plan[run, 1] + rank - plan[run, 0], offset=plan[run, 2])

    return ranked.select(*cut.columns, "rank").mapInPandas(place, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """All documents' pieces with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, capacity, vocabulary), capacity)
