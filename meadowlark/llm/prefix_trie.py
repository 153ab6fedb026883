"""A prefix trie of conversations with figures of whole subtrees, by digests and pointer jumping.

A node is a distinct sequence of first turns. Its key is a polynomial digest of the turns' hashes modulo a prime, taken at
two points, so the digest of each prefix is a running sum: rows are sorted once over all partitions, each partition sums
its own, and what a conversation brought from earlier partitions is added by one small table with a row per partition. No
task holds a conversation. The row of a prefix also has the key of the prefix one turn shorter, its parent edge.

Figures roll up by doubling: in round k a node points at its ancestor 2**k above and hands it the sums of the descendants
less than 2**k below itself. Then it points at that ancestor's own pointer. Only nodes at depth 2**k or more take part, so
the rounds are as many as the depth's binary digits, and the rows of each are fewer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.llm.common import durable, release

PRIME = (1 << 61) - 1
POINTS = (0x1D3A7F5B90C2E461 % PRIME, 0x0B54C3D2E1F60789 % PRIME)
#: Turns that a conversation can take from another one; its number is a hash modulo one more.
MOST_SHARED = 8
#: Conversation ids hashed together in one row where a node has very many ends.
IDS_A_ROW = 512

# ---- arithmetic modulo PRIME -----------------------------------------------------------------------------------------


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo PRIME for unsigned 64-bit arrays below it, by 32-bit halves."""
    low, half = np.uint64((1 << 32) - 1), np.uint64(32)
    xl, xh, yl, yh = x & low, x >> half, y & low, y >> half
    mid = xl * yh + xh * yl
    parts = (_reduced(xl * yl), _reduced((xh * yh) << np.uint64(3)), mid >> np.uint64(29), (mid & np.uint64((1 << 29) - 1)) << half)
    return _reduced(parts[0] + parts[1] + parts[2] + parts[3])


def running(x: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME; the 32-bit halves are summed apart, so 2**31 rows can't overflow."""
    low = np.cumsum(x & np.uint64((1 << 32) - 1), dtype=np.uint64)
    high = np.cumsum(x >> np.uint64(32), dtype=np.uint64)
    return _reduced(_reduced(low) + times(_reduced(high), np.full(len(x), 1 << 32, np.uint64)))


@lru_cache(maxsize=4)
def _table(point: int, step: int) -> np.ndarray:
    out, value, base = np.empty(1 << 12, np.uint64), 1, pow(point, step, PRIME)
    for k in range(len(out)):
        out[k], value = value, value * base % PRIME
    return out


def powers(point: int, n: np.ndarray) -> np.ndarray:
    """point ** n modulo PRIME for n below 2**36."""
    small, middle, large = (n >> s & 4095 for s in (0, 12, 24))
    return times(times(_table(point, 1)[small], _table(point, 1 << 12)[middle]), _table(point, 1 << 24)[large])


# ---- running figures over a sorted table -----------------------------------------------------------------------------

_DIGESTS = ("a", "b")


def _local(words: bool):
    """A function over sorted partitions: ``n`` counts a conversation's rows in this partition, digests cover those rows,
    ``last`` marks its last row here; ``row`` and ``part`` say where the row stands."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        open_id, open_n, open_sums = None, 0, [0, 0]
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            begins = np.append(True, ids[1:] != ids[:-1])
            goes_on = open_id is not None and ids[0] == open_id
            start, of = np.flatnonzero(begins), np.cumsum(begins) - 1
            n = np.arange(len(ids)) - start[of] + 1
            if goes_on:
                n[of == 0] += open_n
            new = {"n": n}
            for k, c in enumerate(_DIGESTS if words else ()):
                own = times(batch.column(1 + k).to_numpy(zero_copy_only=False).astype(np.uint64), powers(POINTS[k], n))
                before = np.append(np.uint64(0), running(own))
                s = _reduced(before[1:] + np.uint64(PRIME) - before[start][of])
                if goes_on:
                    s = np.where(of == 0, _reduced(s + np.uint64(open_sums[k])), s)
                new[c], new[f"parent_{c}"] = s.astype(np.int64), _reduced(s + np.uint64(PRIME) - own).astype(np.int64)
                open_sums[k] = int(s[-1])
            if words:
                new = {c: new[c] for c in ("n", "a", "b", "parent_a", "parent_b")} | {"last": np.append(begins[1:], True)}
            new |= {"row": np.arange(row, row + len(ids)), "part": np.full(len(ids), part, np.int32)}
            row, open_id, open_n = row + len(ids), ids[-1], int(n[-1])
            whole = dict(zip(batch.schema.names, batch.columns)) | {c: pa.array(v) for c, v in new.items()}
            out = pa.RecordBatch.from_arrays(list(whole.values()), list(whole))
            if held is not None:
                yield _unmarked(held) if words and goes_on else held
            held = out
        if held is not None:
            yield held

    return sums


def _unmarked(batch: pa.RecordBatch) -> pa.RecordBatch:
    k = batch.schema.get_field_index("last")
    last = batch.column(k).to_numpy(zero_copy_only=False).copy()
    last[-1] = False
    return pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(last), *batch.columns[k + 1 :]], batch.schema.names)


class Carried(NamedTuple):
    """Of a partition: its first conversation, the count and digests this brings from earlier partitions, its last row's
    number, and whether the last conversation goes on in the next partition."""

    first: int
    n: int
    sums: tuple[int, ...]
    end_row: int
    goes_on: bool


def _carried(local: DataFrame, words: bool) -> dict[int, Carried]:
    """What each partition is brought by those before it; one row a partition comes to the driver."""
    at_end = [F.max_by(c, "row").alias(c) for c in ("n", *(_DIGESTS if words else ()))]
    edges = local.groupBy("part").agg(F.min_by("conv_id", "row").alias("first"), F.max_by("conv_id", "row").alias("end"), F.max("row").alias("row"), *at_end)
    out: dict[int, Carried] = {}
    before, n, sums = None, 0, (0, 0)  # of the last conversation so far
    for e in edges.orderBy("part").collect():
        goes_on = before is not None and e["first"] == before["end"]
        if goes_on:
            out[before["part"]] = out[before["part"]]._replace(goes_on=True)
        else:
            n, sums = 0, (0, 0)
        out[e["part"]] = Carried(e["first"], n, sums, e["row"], False)
        if e["first"] != e["end"]:
            n, sums = 0, (0, 0)
        if words:
            sums = tuple((s + pow(p, n, PRIME) * e[c]) % PRIME for s, p, c in zip(sums, POINTS, _DIGESTS))
        before, n = e, n + e["n"]
    return out


def _mended(carried: dict[int, Carried], kept: list[str]):
    """A function over rows of :func:`_local` that adds what their partitions were brought, and leaves out row and part."""

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            new = {c: whole[c].to_numpy(zero_copy_only=False).copy() for c in ("n", *_DIGESTS, *(f"parent_{c}" for c in _DIGESTS), "last")}
            part, conv, row = (whole[c].to_numpy(zero_copy_only=False) for c in ("part", "conv_id", "row"))
            for k in np.unique(part):
                brought, here = carried[int(k)], part == k
                mine = here & (conv == brought.first)
                new["n"][mine] += brought.n
                for point, s, c in zip(POINTS, brought.sums, _DIGESTS):
                    factor = np.full(int(mine.sum()), pow(point, brought.n, PRIME), np.uint64)
                    for name in (c, f"parent_{c}") if brought.n else ():
                        new[name][mine] = _reduced(times(new[name][mine].astype(np.uint64), factor) + np.uint64(s)).astype(np.int64)
                if brought.goes_on:
                    new["last"][here & (row == brought.end_row)] = False
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else whole[c] for c in kept], kept)

    return mend


def numbered(rows: DataFrame, order: list[Column], words: bool = False) -> DataFrame:
    """``rows`` (conv_id first) with ``n``, their number within their conversation in ``order``, from 1.

    With ``words``, the two columns after conv_id are turn hashes: ``a`` and ``b`` become the digests of the conversation
    up to here, parent_a and parent_b those up to the row before, and ``last`` marks a conversation's last row. One range
    shuffle and one durable table; a conversation's rows may lie in any number of partitions.
    """
    names = rows.columns
    keyed = rows.withColumns({f"__o{k}": c for k, c in enumerate(order)}).withColumn("__u", F.monotonically_increasing_id())  # equal rows can part
    by = ["conv_id", *[f"__o{k}" for k in range(len(order))], "__u"]
    ordered = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(*names)
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields} | {"n": "bigint"}
    if words:
        kinds |= {c: "bigint" for c in (*_DIGESTS, *(f"parent_{c}" for c in _DIGESTS))} | {"last": "boolean"}
    schema = lambda fields: ", ".join(f"{name} {kind}" for name, kind in fields.items())
    local = durable(ordered.mapInArrow(_local(words), schema(kinds | {"row": "bigint", "part": "int"})))
    carried = _carried(local, words)
    if words:
        return local.mapInArrow(_mended(carried, list(kinds)), schema(kinds))
    brought = [(part, c.first, c.n) for part, c in carried.items() if c.n]
    table = F.broadcast(rows.sparkSession.createDataFrame(brought, "part int, __first long, __n long"))  # a row per partition at most
    carried_n = F.when(F.col("conv_id") == F.col("__first"), F.col("__n")).otherwise(0)
    return local.join(table, "part", "left").select(*names, (F.col("n") + carried_n).alias("n"))


# ---- rebuilt conversations -------------------------------------------------------------------------------------------


def turn_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, a, b, bytes, n): turns as two hashes below PRIME and the UTF-8 bytes of their texts, numbered by turn.

    A null turn number comes first; equal ones go by role, then text. Null roles and texts become empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("long")
    hashed = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), half(1).alias("a"), half(16).alias("b"), F.octet_length(text).cast("long").alias("bytes"),
        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
    )
    return numbered(hashed, [F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("text")]).select("conv_id", "a", "b", "bytes", "n")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its group's first one."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuilt(turns: DataFrame, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' prefixes, and all conversations: (conv_id, h) of those that have rows.

    Conversation c begins with the first h turns of c - c % ``group`` and goes on with its own after its first h. The join
    brings at most MOST_SHARED rows of one conversation to at most ``group`` others (twice as many around 0).
    """
    conversations = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).select("conv_id", shared_turns(F.col("conv_id")).alias("h"))
    first = turns.where(F.col("n") <= MOST_SHARED).select(F.col("conv_id").alias("base"), "a", "b", "bytes", "n")
    wanted = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    heads = wanted.join(first, "base").where("n <= h").select("conv_id", "a", "b", "bytes", F.lit(0).alias("own"), "n")
    tails = turns.where(F.col("n") > shared_turns(F.col("conv_id"))).select("conv_id", "a", "b", "bytes", F.lit(1).alias("own"), "n")
    both = heads.unionByName(tails).withColumnRenamed("n", "at")
    return numbered(both, [F.col("own"), F.col("at")], words=True).drop("own", "at"), conversations


# ---- nodes and their figures -----------------------------------------------------------------------------------------


def _key(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def _digest_of_ends(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, conv_id): ids ascending, comma-joined, hashed.

    Ids are sorted over all partitions and joined into rows of at most IDS_A_ROW; a node's rows are then hashed one after
    another as they stream by, so a node with very many ends costs time in one task but no memory.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def flush() -> None:
            if ids:
                out.append((key[0], key[1], ids[0], ",".join(map(str, ids))))
                ids.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["a", "b", "least", "ids"])

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != key or len(ids) >= IDS_A_ROW:
                    flush()
                    key = (a, b)
                ids.append(conv)
            if len(out) >= 64:
                yield made()
        flush()
        if out:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _hash_rows(out)
        if key is not None:
            yield _hash_rows([(*key, digest.hexdigest())])

    slim = ends.select("a", "b", "conv_id")
    chunks = slim.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(joined, "a long, b long, least long, ids string")
    by_node = chunks.repartition("a", "b").sortWithinPartitions("a", "b", "least")
    return by_node.mapInArrow(hashed, "a long, b long, ends_sha256 string").select(_key("a", "b").alias("key"), "ends_sha256")


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])


def rolled_up(nodes: DataFrame, figures: list[str]) -> DataFrame:
    """(key, and each of ``figures`` summed over the key's subtree), from (key, parent, depth, figures), the root at depth 0.

    Doubling rounds: what nodes hand to their pointers is kept, round by round, and summed at the end.
    """
    sums = [F.sum(c).alias(c) for c in figures]
    handed = [nodes.select("key", *figures)]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    active = nodes.where("depth >= 1").select("key", F.col("parent").alias("ptr"), "depth", *figures)
    reach, tables = 1, []
    while reach <= deepest:
        gained = durable(active.groupBy(F.col("ptr").alias("key")).agg(*sums))
        handed.append(gained)
        if 2 * reach > deepest:
            break
        more = gained.select("key", *[F.col(c).alias(f"__{c}") for c in figures])
        above = active.select(F.col("key").alias("ptr"), F.col("ptr").alias("__ptr"))
        further = active.where(F.col("depth") >= 2 * reach).join(more, "key", "left").join(above, "ptr")
        grown = [(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in figures]
        active = durable(further.select("key", F.col("__ptr").alias("ptr"), "depth", *grown))
        tables.append(active)
        if len(tables) > 1:
            release(tables.pop(0))
        reach *= 2
    out = handed[0]
    for gained in handed[1:]:
        out = out.unionByName(gained)
    return out.groupBy("key").agg(*sums)


def prefix_trie(rows: DataFrame, group: int = 5) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, from rows (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256; subtrees include their top. Rows without a conv_id belong to no conversation and go. Null turn numbers
    come first, equal ones go by role and text, repeated rows are turns each, null roles and texts are empty. A
    conversation that rebuilds to no turn is a member and an end of the root alone. An empty table gives no row. Texts of
    any length become digests in the first pass; only the four columns are taken, so further ones and their names don't
    matter. c - c % ``group`` rounds towards 0.
    """
    prefixes, conversations = rebuilt(turn_rows(rows), group)
    prefixes, conversations = durable(prefixes), durable(conversations)
    n_all = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not n_all["n"]:
        return rows.sparkSession.createDataFrame([], schema)
    by_node = prefixes.groupBy(_key("a", "b").alias("key"), _key("parent_a", "parent_b").alias("parent"), F.col("n").alias("depth"), "bytes")
    found = by_node.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    root = rows.sparkSession.range(1).select(
        zero.alias("key"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"),
        F.lit(n_all["least"]).cast("long").alias("conv_id"), F.lit(n_all["n"]).cast("long").alias("n_convs"),
    )
    nodes = durable(found.unionByName(root))
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")).where("key IS NOT NULL")
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    with_children = durable(
        nodes.join(children, "key", "left").select(
            *[c for c in nodes.columns if c != "bytes"], F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), saved,
        )
    )
    figures = rolled_up(with_children.select("key", "parent", "depth", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    ended = prefixes.where("last").select("conv_id", "a", "b")
    turnless = conversations.join(ended, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    ends = _digest_of_ends(ended.unionByName(turnless))
    above = with_children.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (
        with_children.drop("n_leaves", "saved_tokens")
        .join(figures, "key")
        .join(ends, "key", "left")
        .join(above, "parent", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )
