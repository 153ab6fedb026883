"""Connected components of an edge table, by joins and aggregates that never gather a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.llm.common import durable, release


def follow(parents: DataFrame) -> DataFrame:
    """``(id, parent)``, one row per id and parents smaller than their ids: each id with its root, by pointer jumping."""
    before, rows = None, parents.count()
    while True:
        above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("__above"))
        jumped = durable(
            parents.join(above, "parent", "left").select("id", F.coalesce("__above", "parent").alias("parent"), F.col("__above").isNotNull().alias("__moved")),
            rows,
        )
        moved = jumped.where("__moved").limit(1).count()
        if before is not None:
            release(before)
        parents, before = jumped.drop("__moved"), jumped
        if not moved:
            return parents


def connected(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to ``(id, root)``: each end with the smallest id that it is connected with.

    Alternates two rounds until nothing changes: every end hands its larger, then its smaller neighbours to its smallest
    one. Ids with very many neighbours only enter a grouped minimum and a join.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before, rows = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = durable(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(),
            2 * rows,
        )
        release(edges)
        edges = after
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before, rows = state, state[0]
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
    out = durable(roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct()), 2 * rows)
    release(edges)
    return out
