"""Statewide trends and the dashboard's analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meadowlark.operators.dimensions import latest
from meadowlark.tables import written

SUMS = {
    "total_harvest": "total_harvest", "total_hunters": "total_hunters", "total_bulls": "bulls", "total_cows": "cows", "total_calves": "calves",
    "total_rec_days": "total_rec_days",
}


def is_overall(df: DataFrame) -> Column:
    """Rows of the table over all manners of take and all seasons."""
    return (F.col("section_method") == "all") & (F.col("section_season") == "all") & (F.col("table_type") == "harvest_rec_days")


def statewide_harvest(records: DataFrame) -> DataFrame:
    """Per year: sums over the overall rows of the last file that has any, and their count (gmu_count)."""
    per_file = (
        records.where(is_overall(records))
        .groupBy("file", "file_ord", "year")
        .agg(*[F.sum(c).alias(name) for name, c in SUMS.items()], F.count(F.lit(1)).alias("gmu_count"))
    )
    return latest(per_file, ["year"], F.struct("file_ord", "file"), [*SUMS, "gmu_count"])


def statewide_population(totals: DataFrame) -> DataFrame:
    """Per year: the statewide total that the last file reports; never a sum."""
    return latest(totals, ["year"], F.struct("file_ord", "file"), ["statewide_total"])


def running_totals(records: DataFrame, value: str, keys: Sequence[str] = ("gmu", "section_method", "section_season")) -> DataFrame:
    """(keys, year, total, years): sums of ``value`` and counts of years up to each year, per unit and over all units.

    The first key is null in the rows over all units. Each key has a row for every year from the one before the first of
    the data to the last, so what lies between any two years is the difference of two rows: a mean under any filter and
    over any years is two lookups and no scan. The figures come from one pass with grouping sets; windows are over a key's
    years alone.
    """
    unit, *rest = keys
    records = records.where(F.col(unit).isNotNull())
    per_year = records.groupingSets([[unit, *rest, "year"], [*rest, "year"]], *keys, "year").agg(F.sum(value).alias("__v"))
    summed = written(per_year)
    span = summed.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    # a key's years come together once, as one short map; nothing is joined by key, so no table of keys is ever broadcast
    entry = F.when(F.col("year").isNotNull(), F.struct("year", "__v"))
    by_key = summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("__by_year"))
    spine = by_key.join(F.broadcast(span)).select(*keys, "__by_year", F.explode(F.sequence(F.col("a") - 1, F.col("b"))).alias("year"))  # span is one row
    filled = spine.select(*keys, "year", F.try_element_at("__by_year", F.col("year")).alias("__v"))
    so_far = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*keys, "year", F.coalesce(F.sum("__v").over(so_far), F.lit(0)).alias("total"), F.count("__v").over(so_far).alias("years"))


def means_over(totals: DataFrame, years: int, keys: Sequence[str] = ("gmu", "section_method", "section_season")) -> DataFrame:
    """(keys, year, mean): means over the ``years`` up to each year, over the years that are there, from
    :func:`running_totals`; none where no year is there.

    A key has a row for every year, so the totals to take off stand ``years`` rows before, in a window over a key's years.
    """
    by_year = Window.partitionBy(*keys).orderBy("year")
    before = lambda c: F.coalesce(F.lag(c, years).over(by_year), F.lit(0))
    both = totals.select(*keys, "year", F.lag("year").over(by_year).isNull().alias("__first"), (F.col("total") - before("total")).alias("__v"), (F.col("years") - before("years")).alias("__n"))
    return both.where(~F.col("__first") & (F.col("__n") > 0)).select(*keys, "year", (F.col("__v") / F.col("__n")).alias("mean"))


def trailing_mean(df: DataFrame, keys: Sequence[str], year: str, value: str, years: int) -> DataFrame:
    """``df`` with ``<value>_mean``: the mean over the ``years`` up to each row's, over the years that are there."""
    window = Window.partitionBy(*keys).orderBy(year).rangeBetween(-(years - 1), 0)
    return df.withColumn(f"{value}_mean", F.avg(value).over(window))


def quantile_breaks(df: DataFrame, value: str, classes: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    """The inner breaks of ``classes`` equal-count classes, interpolated linearly: ``breaks`` per key, null without values.

    Equal values are counted first. The counts are then ranked over range partitions of keys and values, and only the
    values at the wanted ranks come together, so no task holds all values, of a key neither.
    """
    at = [k / classes for k in range(1, classes)]
    some = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    in_order = ranked(some, [*keys, "__v"], "__n")
    if keys:  # ranks within a key: those of all less the key's first
        names = [f"__k{k}" for k in range(len(keys))]
        each = written(in_order).withColumns(dict(zip(names, map(F.col, keys))))
        starts = each.groupBy(*names).agg(F.min("__rank").alias("__start"), F.sum("__n").alias("__all"))
        same = [F.col(f"e.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names]
        in_order = each.drop("__all").alias("e").join(starts.alias("s"), same).withColumn("__rank", F.col("__rank") - F.col("__start"))
    place = lambda p: F.lit(p) * (F.col("__all") - 1)
    # a value stands at the ranks from __rank on; each break lies between the values at two neighbouring ranks
    holds = lambda r: (F.col("__rank") <= r) & (r < F.col("__rank") + F.col("__n"))
    ends = [(F.max(F.when(holds(F.floor(place(p))), F.col("__v"))), F.max(F.when(holds(F.ceil(place(p))), F.col("__v"))), F.max(place(p) - F.floor(place(p)))) for p in at]
    breaks = F.array(*[low + (high - low) * share for low, high, share in ends])
    return in_order.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 0, breaks).alias("breaks"))


def ranked(df: DataFrame, order: Sequence[str], weight: str | None = None) -> DataFrame:
    """``df`` with ``__rank`` (from 0 in ``order``, counting rows or ``weight``) and ``__all`` (their total).

    Rows are range-partitioned and numbered within partitions, and moved by the sums of the partitions before. They are
    written in between: the ranges come from a sample, and rows must stand where they were counted even if an executor is
    lost. ``order`` must be unique.
    """
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    numbered = df.withColumn("__w", w).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    numbered = written(numbered)
    counts = numbered.groupBy("__part").agg(F.sum("__w").alias("__n_part"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n_part").over(before), F.lit(0)).alias("__before"), F.sum("__n_part").over(Window.partitionBy()).alias("__all"))
    inside = F.coalesce(F.sum("__w").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a partition is broadcast
    placed = numbered.withColumn("__inside", inside).join(F.broadcast(offsets), "__part")
    return placed.withColumn("__rank", F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside", "__w")


def in_classes(df: DataFrame, value: str, breaks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``class`` (1 and up): how many breaks lie under the value. Breaks have one row per key."""
    both = df.join(breaks, list(keys)) if keys else df.crossJoin(F.broadcast(breaks.limit(1)))
    return both.withColumn("class", F.size(F.filter("breaks", lambda b: b < F.col(value))) + 1).drop("breaks")


def choropleth(records: DataFrame, value: str, years: Sequence[int] | None = None, method: str = "all", season: str = "all", classes: int = 7) -> DataFrame:
    """Per management unit: the metric's mean over ``years`` (None: all) under a filter, with its quantile class."""
    some = records.where((F.col("section_method") == method) & (F.col("section_season") == season) & (F.col("table_type") == "harvest_rec_days"))
    some = some if years is None else some.where(F.col("year").isin(*years))
    means = some.groupBy("gmu", "year").agg(F.sum(value).alias("v")).groupBy("gmu").agg(F.avg("v").alias(value))
    return in_classes(means, value, quantile_breaks(means, value, classes))


def unit_detail(dashboard: DataFrame, unit: int) -> DataFrame:
    """A management unit's rows by year, method and season."""
    return dashboard.where(F.col("g") == unit).orderBy("y", "m", "s")


def stacked(records: DataFrame, keys: Sequence[str] = ("gmu", "year"), parts: Sequence[str] = ("bulls", "cows", "calves")) -> DataFrame:
    """Sums of the parts per key, in long form: kind, animals."""
    sums = records.where(is_overall(records)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts])
    return sums.unpivot(list(keys), list(parts), "kind", "animals")


def herd_population(records: DataFrame, dau: str | None = None) -> DataFrame:
    """Each herd unit's estimates over time (one unit's with ``dau``): dau, year, population_estimate."""
    some = records if dau is None else records.where(F.col("dau") == dau)
    return some.select("dau", "year", "population_estimate").orderBy("dau", "year")


def unit_population(definitions_lookup: DataFrame, population: DataFrame, units: DataFrame) -> DataFrame:
    """``units`` (gmu) with their herd unit and its estimates by year; units without a herd unit stay, with nulls."""
    return units.join(definitions_lookup.select("gmu", "dau"), "gmu", "left").join(population.select("dau", "year", "population_estimate"), "dau", "left")


def equal_count_classes(df: DataFrame, order: Sequence[str], classes: int = 7) -> DataFrame:
    """``df`` with ``class`` (1 and up): classes whose counts differ by one at most, the first ones larger.

    See :func:`ranked`; no task sees all rows. ``order`` must be unique.
    """
    rank = F.col("__rank")
    small, large = F.floor(F.col("__all") / classes), F.col("__all") % classes
    in_large = rank < large * (small + 1)
    cls = F.when(in_large, F.floor(rank / (small + 1))).otherwise(large + F.floor((rank - large * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    return ranked(df, order).withColumn("class", cls.cast("int")).select(*df.columns, "class")
