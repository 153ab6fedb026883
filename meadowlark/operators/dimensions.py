"""Dimensions over the years: herd unit definitions and the lookup from management units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_definitions(records: DataFrame, order: Sequence[str] = ("file_ord", "page_no", "line_no")) -> DataFrame:
    """One row per herd unit (dau) over all population records.

    dau_number: the first seen. herd_name: the last one that isn't blank, in load order. years_present: sorted, with
    repetitions. gmus: those of the latest year with any, sorted. gmu_history: sorted units by year; history_state says
    whether it is to be shown: ``absent`` where membership never changed, ``empty`` where there were never units, else
    ``populated``. first_seen: the order of first appearance.
    """
    seen = F.struct(*order)
    named = F.nullif(F.col("herd_name"), F.lit(""))
    overall = records.groupBy("dau").agg(
        F.min_by("dau_number", seen).alias("dau_number"),
        F.max_by(named, F.when(named.isNotNull(), seen)).alias("herd_name"),
        F.array_sort(F.collect_list("year")).alias("years_present"),
        F.min(seen).alias("first_seen"),
    )
    by_year = (
        records.where(F.size("gmus") > 0)
        .groupBy("dau", "year")
        .agg(F.max_by(F.array_sort("gmus"), seen).alias("units"))
    )
    history = by_year.groupBy("dau").agg(
        F.max_by("units", "year").alias("gmus"),
        F.countDistinct("units").alias("configurations"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "units")))).alias("all_years"),
    )
    state = F.when(F.col("configurations").isNull(), "empty").when(F.col("configurations") > 1, "populated").otherwise("absent")
    none = F.array().cast("array<bigint>")
    return (
        overall.join(history, "dau", "left")
        .withColumn("history_state", state)
        .select(
            "dau", "dau_number", "herd_name", F.coalesce("gmus", none).alias("gmus"),
            F.when(F.col("history_state") == "populated", F.col("all_years")).alias("gmu_history"),
            "history_state", "years_present", "first_seen",
        )
    )


def definition_state(records: DataFrame, order: Sequence[str] = ("file_ord", "page_no", "line_no")) -> DataFrame:
    """What :func:`unit_definitions` needs of some reports, one row per herd unit and year, to be stored and merged.

    records: how many. first_seen and dau_number: of the first one. named: the last name that isn't blank, with its order.
    units: the last sorted units, with their order.
    """
    seen = F.struct(*[F.col(c).cast("bigint").alias(c) for c in order])
    named = F.nullif(F.col("herd_name"), F.lit(""))
    some = F.size("gmus") > 0
    return records.groupBy("dau", "year").agg(
        F.count(F.lit(1)).alias("records"),
        F.min(seen).alias("first_seen"),
        F.min_by("dau_number", seen).alias("dau_number"),
        F.max(F.when(named.isNotNull(), F.struct(seen.alias("at"), named.alias("name")))).alias("named"),
        F.max(F.when(some, F.struct(seen.alias("at"), F.array_sort("gmus").alias("gmus")))).alias("units"),
    )


def merged_states(*states: DataFrame) -> DataFrame:
    """The state of all reports from the states of parts of them, in any order and grouping."""
    both = states[0]
    for state in states[1:]:
        both = both.unionByName(state)
    return both.groupBy("dau", "year").agg(
        F.sum("records").alias("records"), F.min("first_seen").alias("first_seen"), F.min_by("dau_number", "first_seen").alias("dau_number"),
        F.max("named").alias("named"), F.max("units").alias("units"),
    )


def definitions_of(state: DataFrame) -> DataFrame:
    """The rows of :func:`unit_definitions` from a state; adding a year costs the state's rows, not all reports."""
    found = state.groupBy("dau").agg(
        F.min_by("dau_number", "first_seen").alias("dau_number"),
        F.max("named").alias("named"),
        F.array_sort(F.flatten(F.collect_list(F.array_repeat("year", F.col("records").cast("int"))))).alias("years_present"),
        F.min("first_seen").alias("first_seen"),
        F.max_by("units.gmus", F.when(F.col("units").isNotNull(), F.col("year"))).alias("gmus"),
        F.count_distinct("units.gmus").alias("configurations"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("units").isNotNull(), F.struct("year", "units.gmus"))))).alias("all_years"),
    )
    state_of = F.when(F.col("configurations") == 0, "empty").when(F.col("configurations") > 1, "populated").otherwise("absent")
    return found.withColumn("history_state", state_of).select(
        "dau", "dau_number", F.col("named.name").alias("herd_name"), F.coalesce("gmus", F.array().cast("array<bigint>")).alias("gmus"),
        F.when(F.col("history_state") == "populated", F.col("all_years")).alias("gmu_history"), "history_state", "years_present", "first_seen",
    )


def unit_lookup(definitions: DataFrame) -> DataFrame:
    """(gmu, dau, claimed_by): the herd unit that holds a management unit now; of several, the last to appear first."""
    held = definitions.select("dau", "first_seen", F.explode("gmus").alias("gmu"))
    return held.groupBy("gmu").agg(F.max_by("dau", "first_seen").alias("dau"), F.countDistinct("dau").alias("claimed_by"))


def latest(df: DataFrame, keys: Sequence[str], order: Column | str, values: Sequence[str]) -> DataFrame:
    """The ``values`` of each key's last row in ``order``."""
    last = F.max_by(F.struct(*values), order)
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, *[F.col("__last")[v].alias(v) for v in values])
