"""N-gram Jaccard join: texts whose shingle sets are alike, as connected components, by an R-tree over group counts.

Shingles are hashed into groups. Two sets that link differ in few shingles, so in at most as many groups; among a set's
first groups (one more than it may differ in) at least one is therefore the same in both. Equal groups bring candidates
together, exactly and without comparing frequent single shingles.

1. Equal sets form classes. Each class sends a hash of each of its first groups (its signatures). The classes that share
   one go to the smallest of them, their hub; a hub's classes are its neighbourhood, whichever signatures brought them.
   Counts over COORDINATES groups make each class a point.
2. Every class is paired with the hub that it shares most signatures with; where the sum of coordinate minima allows a
   link, whole sets are compared. These links join most of a large group of near copies, at a cost that grows with it.
3. In neighbourhoods that still hold several components, R-trees over the points find the pairs across components that
   may link: summed minima bound the overlap of two sets, and of all sets below two nodes. What such pairs join is a
   family.
4. Whole sets come to their family, each once. There an R-tree gives the pairs and the best are compared first; pairs
   whose ends are already joined are left out. Only links leave a task, fewer than classes.

Neighbourhoods and families are cut into tiles of bounded size, each pair of tiles being a task of its own, so none is gathered whole.
Whole sets are compared, so no link is missed and none is made up (but for 64-bit hash collisions).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.llm.common import PLAIN_WORD, durable, in_chunks, release, shingle_hashes, splitmix, words_of_all
from meadowlark.llm.components import connected, follow

#: Ratio of a size band's bounds: wider bands repeat fewer sets in two bands, narrower ones have larger groups.
BAND_RATIO = 1.6
#: Coordinates of a point and points of an R-tree's leaf. With as many coordinates as a usual text has shingles, the summed
#: minima come close to the overlap itself.
COORDINATES, LEAF = 512, 16
#: Members and shingles of a tile: two tiles are held in memory at once (8 bytes a shingle).
TILE, TILE_SHINGLES = 1024, 4 << 20
#: Bits of the filter for the texts whose sets are needed: 16 for each, between these powers of two. Beyond the upper
#: bound (128 MB) more sets than needed are sent; the joins drop them.
FILTER_BITS = (16, 30)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles, one text after another, and where each text's begin.

    A text of fewer words has its whole sequence as the only one; a text without words has none.
    """
    words, at = words_of_all(texts, PLAIN_WORD)
    n = np.diff(at)
    whole = shingle_hashes(words, k)
    inside = np.arange(len(whole)) + k <= np.repeat(at[1:], n)[: len(whole)]
    values, count = whole[inside], np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = [shingle_hashes(words[at[i] : at[i + 1]], n[i]) ^ np.uint64(n[i]) for i in short]
        values = np.insert(values, np.concatenate([[0], np.cumsum(count)])[short], splitmix(np.concatenate(own)))
        count[short] = 1
    ends = np.cumsum(count)
    for a, b in zip(ends - count, ends):
        values[a:b].sort()
    text = np.repeat(np.arange(len(n)), count)
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    count = np.bincount(text[fresh], minlength=len(n))
    return values[fresh], np.concatenate([[0], np.cumsum(count)])


def class_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; 0 for an empty one."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    if len(values):
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(splitmix(values), at[:-1][n > 0])
            out[n > 0] = splitmix(sums + n[n > 0].astype(np.uint64))
    return out.view(np.int64)


class Rule:
    """Links sets whose intersection is at least ``percent`` of their union."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]
        ratio = max(BAND_RATIO, 100 / percent)  # so that partners are one band further at most
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * ratio)))

    def differ(self, a: int, b: int) -> int:
        """In how many shingles linked sets of these sizes differ at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def overlap(self, total):
        """How many shingles linked sets have in common at least, from the sum of their sizes."""
        return -(-total * self.percent // (100 + self.percent))

    def band(self, n: np.ndarray, further: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whether sets of these sizes take part, band, groups, signatures) for their own size band or the next.

        A pair meets in the band of the larger set; a set takes part in the next band if its partners reach into it.
        """
        bounds, most = np.array(self.bounds), n * 100 // self.percent
        band = np.searchsorted(bounds, n, "right") - 1 + further
        low, high = bounds[band], bounds[band + 1] - 1
        return (most >= low) | (further == 0), band, self.differ(high, high) * 53 // 50 + 4, self.differ(n, np.minimum(most, high)) + 1


def signatures(values: np.ndarray, at: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(set number, hash) of the first non-empty groups of each set, in each of its bands.

    A set with too few of them also sends its band's own signature: a pair without an equal non-empty group consists of
    two such sets.
    """
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    mixed = splitmix(values ^ np.uint64(0x5851F42D4C957F2D))
    numbers, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for further in (0, 1):
        takes, band, groups, wanted = rule.band(size, further)
        takes &= size > 0
        some = takes[owner]
        own, mix = owner[some], mixed[some]
        if not len(own):
            continue
        key = (own << 32) + ((mix >> np.uint64(20)) % groups[own].astype(np.uint64)).astype(np.int64)
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        head = key[order][first]
        own, group = head >> 32, head & 0xFFFFFFFF
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        found = np.diff(starts, append=len(own))
        rank = np.arange(len(own)) - np.repeat(starts, found)
        keep = rank < wanted[own]
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mix[order], first)[keep]
            place = splitmix(((band[own] << 44) + group)[keep].astype(np.uint64))
            hashes.append(splitmix(content * np.uint64(0x9E3779B97F4A7C15) + place))
        numbers.append(own[keep])
        few = own[starts][found < wanted[own[starts]]]
        numbers.append(few)
        hashes.append(splitmix(((band[few] << 44) + (1 << 43)).astype(np.uint64)))
    return np.concatenate(numbers), np.concatenate(hashes)


def _by_batch(docs: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch)

    return docs.mapInArrow(run, schema)


def _counts(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, extra) of sets: one byte a coordinate, and what the counts have beyond 255, summed up."""
    size = np.diff(at)
    cell = np.repeat(np.arange(len(size)), size) * COORDINATES + (splitmix(values) % np.uint64(COORDINATES)).astype(np.int64)
    counts = np.bincount(cell, minlength=len(size) * COORDINATES).reshape(len(size), COORDINATES)
    return np.minimum(counts, 255).astype(np.uint8), np.maximum(counts - 255, 0).sum(1)


def _forgetful(seen: set[int], cids: np.ndarray, take: np.ndarray) -> None:
    """Takes the marks off classes that this task has seen lately."""
    for i in np.flatnonzero(take):
        take[i] = cids[i] not in seen
        seen.add(cids[i])
    if len(seen) > 50_000:
        seen.clear()


def _sized(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, cid, extra, point) per row; the point is null where the task has given the class's already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, texts in in_chunks(batch.column(1)):
                values, at = shingle_sets(texts, k)
                n, cids = np.diff(at), class_ids(values, at)
                take = n > 0
                _forgetful(seen, cids, take)
                points, extra = _counts(values, at)
                listed = [p.tobytes() if t else None for p, t in zip(points, take)]
                columns = [batch.column(0).slice(first, len(texts)), pa.array(n), pa.array(cids, mask=n == 0), pa.array(extra), pa.array(listed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "cid", "extra", "point"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cid long, extra long, point binary")


def _fresh_sets(batch: pa.RecordBatch, k: int, seen: set[int], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cids, values, offsets) of the batch's sets whose classes this task hasn't seen lately; ``wanted`` filters them."""
    for _, texts in in_chunks(batch.column(1)):
        values, at = shingle_sets(texts, k)
        cids = class_ids(values, at)
        take = np.diff(at) > 0
        if wanted is not None:
            low = cids & (8 * len(wanted) - 1)
            take &= ((wanted[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1).astype(bool)
        _forgetful(seen, cids, take)
        n = np.where(take, np.diff(at), 0)
        yield cids[take], values[np.repeat(take, np.diff(at))], np.concatenate([[0], np.cumsum(n[take])])


def _signed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, cid) of all classes; a task sends the signatures of a class that it sees again and again once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, seen = Rule(percent), set()
        for batch in batches:
            for cids, values, at in _fresh_sets(batch, k, seen):
                number, sig = signatures(values, at, rule)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cids[number])], ["sig", "cid"])

    return docs.mapInArrow(run, "sig long, cid long")


def _neighbours(signed: DataFrame) -> DataFrame:
    """(cid, hub, n): the classes that share signatures with a smaller class, the smallest that has one; n such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # the open signature, its hub and newest class
        for batch in batches:
            sig, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            goes_on = last is not None and sig[0] == last[0]
            if goes_on:
                sig, cid = np.append(last[0], sig), np.append(last[2], cid)
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            heads = cid[first].copy()
            if goes_on:
                heads[0] = last[1]
            hub = np.repeat(heads, np.diff(first, append=len(sig)))
            send = cid != hub
            send[1:] &= (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])
            if goes_on:
                send[0] = False
            last = (sig[-1], hub[-1], cid[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[send], pa.int64()) for x in (cid, hub)], ["cid", "hub"])

    met = signed.repartition("sig").sortWithinPartitions("sig", "cid").mapInArrow(run, "cid long, hub long")
    return met.groupBy("hub", "cid").agg(F.count(F.lit(1)).alias("n"))


def _wanted(ids: DataFrame) -> bytes:
    """A bit for the low bits of each id: 16 bits or more for each id, within the bounds of FILTER_BITS.

    Set bits are gathered as one byte string per slice of the filter, each built by a Spark aggregate over its bits.
    """
    bits = min(max(int(16 * ids.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    slices = 1 << max(bits - 17, 3)
    per = (1 << bits) // slices // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            low = np.unique(batch.column(0).to_numpy() & ((1 << bits) - 1))
            for i in np.unique(low // (8 * per)).tolist():
                mine = low[low // (8 * per) == i] - i * 8 * per
                np.bitwise_or.at(held.setdefault(i, np.zeros(per, np.uint8)), mine >> 3, (128 >> (mine & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["slice", "bits"])

    out = np.zeros((slices, per), np.uint8)
    # ids are sent to the task of their slice, so each slice is one row: 128 MB in all at most
    for row in ids.repartition(F.expr(f"({ids.columns[0]} & {(1 << bits) - 1}) div {8 * per}")).mapInArrow(fill, "slice int, bits binary").collect():
        out[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def _sets(docs: DataFrame, k: int, wanted: bytes) -> DataFrame:
    """(cid, shingles) of the classes that the filter may want, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(wanted, np.uint8), set()
        for batch in batches:
            for cids, values, at in _fresh_sets(batch, k, seen, bits):
                sets = [values[a:b].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return _once(docs.mapInArrow(run, "cid long, shingles binary"))


def _once(rows: DataFrame) -> DataFrame:
    """One row per cid."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            cid = batch.column(0).to_numpy()
            keep = np.ones(len(cid), bool)
            keep[1:] = cid[1:] != cid[:-1]
            if len(cid):
                keep[0] = cid[0] != last
                last = cid[-1]
            yield batch.filter(pa.array(keep))

    return rows.repartition("cid").sortWithinPartitions("cid").mapInArrow(once, rows.schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose whole sets link."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    return _by_batch(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), "a long, b long", work)


class CountTree:
    """An R-tree over group counts, packed bottom-up.

    A node holds its points' largest coordinates and their ranges of sizes and of components; pairs of nodes within one
    component are cut, like those whose sizes or summed minima don't allow a link. Points of one component, of nearly
    one size and with the same largest coordinate stand together.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, extra: np.ndarray, root: np.ndarray | None = None):
        _, root, times = np.unique(np.arange(len(points)) if root is None else root, return_inverse=True, return_counts=True)
        near = np.log(np.maximum(sizes, 1)) // 0.06
        self.order = np.lexsort((sizes, points.argmax(1), near, np.where(times[root] >= LEAF, root, -1)))
        sizes, root = sizes[self.order], root[self.order]
        self.levels = [(points[self.order], sizes, sizes, extra[self.order], root, root)]
        self.tried = 0  # pairs of nodes and of points whose minima were summed
        while len(self.levels[-1][0]) > 1:
            tops, low, high, more, first_root, last_root = self.levels[-1]
            first = np.arange(0, len(tops), LEAF)
            tops, high, more, last_root = (np.maximum.reduceat(v, first) for v in (tops, high, more, last_root))
            self.levels.append((tops, np.minimum.reduceat(low, first), high, more, np.minimum.reduceat(first_root, first), last_root))

    def pairs(self, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of points of different components whose summed coordinate minima allow a link, and the sums."""
        a = b = overlap = np.zeros(1, np.int64)
        for tops, low, high, more, first, last in self.levels[-2::-1]:
            parts = []
            for k in range(0, len(a), 64):
                step = np.arange(LEAF)
                x = np.repeat(a[k : k + 64, None] * LEAF + step, LEAF, 1).ravel()
                y = np.tile(b[k : k + 64, None] * LEAF + step, (1, LEAF)).ravel()
                fits = (x <= y) & (x < len(tops)) & (y < len(tops))
                x, y = x[fits], y[fits]
                near = (low[x] * rule.percent <= high[y] * 100) & (low[y] * rule.percent <= high[x] * 100)
                near &= (first[x] != last[y]) | (first[y] != last[x])
                x, y = x[near], y[near]
                self.tried += len(x)
                sums = np.minimum(tops[x], tops[y]).sum(1, dtype=np.int64) + np.minimum(more[x], more[y])
                fits = sums >= rule.overlap(low[x] + low[y])
                parts.append((x[fits], y[fits], sums[fits]))
            a, b, overlap = (np.concatenate(p) for p in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3
        differ = a < b
        return self.order[a[differ]], self.order[b[differ]], overlap[differ]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """The columns of whole units (runs of equal hub, low and high), several at a time, and where each begins."""
    rest: list[pa.RecordBatch] = []

    def columns(parts: list[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        table = pa.Table.from_batches(parts)
        out = {c: np.array(table.column(c).to_pylist(), object) if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy() for c in table.column_names}
        differ = (np.diff(np.stack([out[c] for c in _UNIT]), axis=1) != 0).any(0)
        return out, np.concatenate([[0], np.flatnonzero(differ) + 1, [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.flatnonzero(np.any([batch.column(c).to_numpy() != batch.column(c)[-1].as_py() for c in _UNIT], axis=0))
        cut = int(ends[-1]) + 1 if len(ends) else 0  # the last unit may go on
        if not cut and rest and any(rest[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in _UNIT):
            yield columns(rest)
            rest = []
        if cut:
            yield columns([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield columns(rest)


def _star_bounded(groups: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): the classes whose counts allow a link with a hub of theirs; hubs with many are cut into parts."""
    sizes = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("m")).withColumn("parts", F.ceil(F.col("m") / TILE))
    members = groups.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("cid"), "parts").cast("long").alias("part"), "cid", "n")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("cid"), F.lit(0).cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, held = Rule(percent), None
        for batch in batches:
            if not batch.num_rows:
                continue
            hub, cid, n, size, extra = (batch.column(c).to_numpy() for c in ("hub", "cid", "n", "size", "extra"))
            point = np.frombuffer(b"".join(batch.column("point").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            if held is not None:  # a hub's members may go on in this batch
                hub, cid, n, size, extra = (np.append(x, y) for x, y in zip(held[0], (hub, cid, n, size, extra)))
                point = np.concatenate([held[1], point])
            of = np.maximum.accumulate(np.where(hub == cid, np.arange(len(hub)), 0))
            most = np.minimum(point, point[of]).sum(1, dtype=np.int64) + np.minimum(extra, extra[of])
            fits = (most >= rule.overlap(size + size[of])) & (hub != cid)
            held = [x[of[-1:]] for x in (hub, cid, n, size, extra)], point[of[-1:]]
            yield pa.RecordBatch.from_arrays([pa.array(x[fits]) for x in (cid, hub, n)], ["a", "b", "n"])

    rows = members.unionByName(hubs).join(points, "cid").withColumn("first", F.col("cid") != F.col("hub"))
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "first")
    return rows.select("hub", "cid", "n", "size", "extra", "point").mapInArrow(run, "a long, b long, n long")


def _tiled(groups: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """(hub, low, high, tile, cid, root) of the neighbourhoods with several components, for each pair of tiles.

    ``groups`` has at most ``rows`` rows.
    Members of a component that fills tiles have tiles of their own, which are not paired with each other.
    """
    both = groups.select("hub", "cid").unionByName(groups.select("hub", F.col("hub").alias("cid")).distinct())
    rooted = durable(both.join(roots.withColumnRenamed("id", "cid"), "cid").select("hub", "cid", "root", "size"), 2 * rows)
    load = lambda count, size: F.ceil(F.greatest(F.col(count) / TILE, F.col(size) / TILE_SHINGLES)).cast("long")
    per = rooted.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s")).withColumn("own", load("c", "s"))
    own = F.col("own") > 1
    mixed = per.groupBy("hub").agg(
        F.count(F.lit(1)).alias("n_roots"), F.sum(F.when(~own, F.col("c"))).alias("c"), F.sum(F.when(~own, F.col("s"))).alias("s")
    )
    mixed = mixed.where("n_roots > 1").select("hub", F.coalesce(load("c", "s"), F.lit(0).cast("long")).alias("shared"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k")
    big = durable(per.where(own).join(mixed, "hub").select("hub", "root", "own"), 2 * rows)
    of_big = big.select("hub", "root", numbers(F.col("own"))).select("hub", F.xxhash64("root", "k").alias("tile"), "root")
    of_rest = mixed.where("shared > 0").select("hub", numbers(F.col("shared"))).select("hub", F.col("k").alias("tile"), F.lit(None).cast("long").alias("root"))
    tiles = of_big.unionByName(of_rest)
    low, high = tiles.toDF("hub", "low", "low_root"), tiles.toDF("hub", "high", "high_root")
    apart = (F.col("low") <= F.col("high")) & (F.col("low_root").isNull() | F.col("high_root").isNull() | (F.col("low_root") != F.col("high_root")))
    pairs = low.join(high, "hub").where(apart).select("hub", "low", "high")
    number = F.pmod(F.xxhash64("cid"), F.coalesce("own", "shared"))
    tile = F.when(F.col("own").isNull(), number).otherwise(F.xxhash64("root", number))
    placed = rooted.join(mixed, "hub").join(big, ["hub", "root"], "left").select("hub", tile.cast("long").alias("tile"), "cid", "root")
    sides = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("low", "high"))))
    return placed.join(sides, ["hub", "tile"]).select("hub", "low", "high", "tile", "cid", "root")


_UNIT = ["hub", "low", "high"]


def _candidates(cols: dict[str, np.ndarray], edges: np.ndarray, rule: Rule, points: np.ndarray, sizes: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of rows of one unit that the summed minima allow, and the sums: of different components and, where the unit
    is a pair of tiles, of different tiles. Units that fit into a leaf are compared all at once, the others by a tree."""
    found = []
    size = np.diff(edges)
    unit = np.repeat(np.arange(len(size)), size)
    small = np.repeat(size <= LEAF, size)
    for step in range(1, LEAF):
        x = np.flatnonzero(small[:-step] & (unit[:-step] == unit[step:]) & (cols["root"][:-step] != cols["root"][step:])) if len(unit) > step else small[:0]
        y = x + step
        near = (sizes[x] * rule.percent <= sizes[y] * 100) & (sizes[y] * rule.percent <= sizes[x] * 100)
        x, y = x[near], y[near]
        for k in range(0, len(x), 4096):
            a, b = x[k : k + 4096], y[k : k + 4096]
            sums = np.minimum(points[a], points[b]).sum(1, dtype=np.int64) + np.minimum(extra[a], extra[b])
            fits = sums >= rule.overlap(sizes[a] + sizes[b])
            found.append((a[fits], b[fits], sums[fits]))
    for i in np.flatnonzero(size > LEAF):
        mine = slice(edges[i], edges[i + 1])
        a, b, sums = CountTree(points[mine], sizes[mine], extra[mine], cols["root"][mine]).pairs(rule)
        found.append((a + edges[i], b + edges[i], sums))
    x, y, sums = (np.concatenate(v) for v in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    across = (cols["root"][x] != cols["root"][y]) & ((cols["low"][x] == cols["high"][x]) | (cols["tile"][x] != cols["tile"][y]))
    return x[across], y[across], sums[across]


def _joined(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows, the least row that pairs (x, y) join it with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, least)
        np.minimum.at(after, y, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _open_pairs(tiled: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of classes that join all those whose counts allow a link across components, fewer than classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Rule(percent)
        for cols, edges in _units(batches):
            counts = np.frombuffer(b"".join(cols["point"]), np.uint8).reshape(-1, COORDINATES)
            x, y, _ = _candidates(cols, edges, rule, counts, cols["size"], cols["extra"])
            least = _joined(len(counts), x, y)
            a = np.flatnonzero(least != np.arange(len(least)))
            yield pa.RecordBatch.from_arrays([pa.array(cols["cid"][a]), pa.array(cols["cid"][least[a]])], ["a", "b"])

    rows = tiled.join(points, "cid").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return rows.mapInArrow(run, "a long, b long")


def _spanning_links(tiled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that join the components of each unit as all its links do, the likeliest pairs compared first."""

    def links(cols: dict[str, np.ndarray], edges: np.ndarray, rule: Rule) -> tuple[list[int], list[int]]:
        listed = [np.frombuffer(v, np.uint64) for v in cols["shingles"]]
        sizes = np.array([len(v) for v in listed])
        counts, extra = _counts(np.concatenate(listed), np.concatenate([[0], np.cumsum(sizes)]))
        x, y, overlap = _candidates(cols, edges, rule, counts, sizes, extra)
        above: dict[int, int] = {}

        def top(r: int) -> int:
            while above.setdefault(r, r) != r:
                above[r] = r = above[above[r]]
            return r

        a, b = [], []
        for k in np.argsort(-overlap / (sizes[x] + sizes[y]), kind="stable"):
            i, j = x[k], y[k]
            left, right = top(int(cols["root"][i])), top(int(cols["root"][j]))
            if left != right:
                both = sizes[i] + sizes[j] - len(np.unique(np.concatenate([listed[i], listed[j]])))
                if 100 * both >= rule.percent * (sizes[i] + sizes[j] - both):
                    above[left] = right
                    a.append(int(cols["cid"][i]))
                    b.append(int(cols["cid"][j]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Rule(percent)
        for cols, edges in _units(batches):
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in links(cols, edges, rule)], ["a", "b"])

    rows = tiled.join(sets, "cid").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return rows.mapInArrow(run, "a long, b long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (id, root) with the components that ``links`` (a, b) join as one."""
    a, b = roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    across = links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    top = connected(across).select(F.col("id").alias("root"), F.col("root").alias("top"))
    return roots.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root"))


#: A component's name is sent to so many places, so that none holds all classes of a large one.
SPREAD = 8


def _named(sized: DataFrame, roots: DataFrame) -> DataFrame:
    """(cid, class_id, component_id): the least doc_id of each class and of its component."""
    classes = sized.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    topped = durable(classes.join(roots.select(F.col("id").alias("cid"), "root"), "cid", "left"))
    own = F.when(F.col("root").isNotNull(), F.pmod(F.xxhash64("cid"), F.lit(SPREAD)))
    named = topped.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    spread = named.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    met = topped.where("root is not null").withColumn("place", own.cast("long")).join(spread, ["root", "place"])
    alone = topped.where("root is null").select("cid", F.col("least").alias("class_id"), F.col("least").alias("component_id"))
    return met.select("cid", F.col("least").alias("class_id"), "component_id").unionByName(alone)


def similar_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id, component_id.

    class_id is the smallest doc_id among the rows with an equal set (null if empty), component_id the smallest among all
    rows that links reach. Rows without words have no shingles and form components of their own; repeated rows and equal
    texts are one class; a null doc_id never names a component unless all its members have none. Whole texts are taken,
    however long; only doc_id and text are, so further columns and their names don't matter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = durable(_sized(docs, k))
    groups = durable(_neighbours(_signed(docs, k, percent)))
    met = groups.count()
    members = groups.select("cid").unionByName(groups.select(F.col("hub").alias("cid"))).distinct()
    counted = sized.where("point is not null").select("cid", F.col("n_shingles").alias("size"), "extra", "point")
    points = durable(_once(counted.join(members, "cid", "left_semi")))

    def sets_of(ids: DataFrame) -> DataFrame:
        return durable(_sets(docs, k, _wanted(ids)))

    allowed = _star_bounded(groups, points, percent)
    stars = durable(allowed.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")), met)
    sets = sets_of(stars.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    linked = durable(_verified(stars, sets, percent))
    release(stars, sets)
    found = follow(linked.select(F.col("a").alias("id"), F.col("b").alias("parent")))
    sizes = points.select(F.col("cid").alias("id"), "size")
    roots = durable(sizes.join(found, "id", "left").select("id", F.coalesce("parent", "id").alias("root"), "size"), 2 * met)

    opened = durable(_open_pairs(_tiled(groups, roots, met), points, percent))
    release(points, groups)
    families = connected(opened)
    sets = sets_of(families.select(F.col("id").alias("cid")))
    left = families.where("id <> root").select(F.col("root").alias("hub"), F.col("id").alias("cid"))
    links = durable(_spanning_links(_tiled(left, roots, 2 * met), sets, percent))
    release(sets, opened, families)
    of_class = _named(sized, roots if links.isEmpty() else _merged(roots, links))
    # rows without shingles have no class; a key of their own keeps them from meeting in one task
    keyed = sized.select("doc_id", "n_shingles", F.coalesce("cid", F.xxhash64("doc_id")).alias("cid"))
    own = lambda c, none: F.when(F.col("n_shingles") > 0, F.col(c)).otherwise(none).alias(c)
    return keyed.join(of_class, "cid", "left").select("doc_id", "n_shingles", own("class_id", F.lit(None)), own("component_id", F.col("doc_id")))


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns stay.

    A row goes if its group is named by another id. Rows repeated with id and text are one document. Rows without an id
    can't be told apart and stay.
    """
    groups = durable(similar_groups(docs, k, percent).select("doc_id", "component_id"))
    own = F.max((F.col("doc_id") == F.col("component_id")).cast("int"))
    ids = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(own.alias("own"), F.count(F.lit(1)).alias("n"))
    kept = docs.join(ids.where("own = 0").select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = ids.where("own = 1 and n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
