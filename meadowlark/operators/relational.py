"""Small relational shapes that several reports need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def padded_union(parts: Sequence[DataFrame], zeros: Sequence[str] = ()) -> DataFrame:
    """UNION ALL by name; a column that a part lacks is 0 if it is one of ``zeros``, else null."""
    kinds = {f.name: f.dataType for p in parts for f in p.schema}
    full = [p.select(*[F.col(c) if c in p.columns else F.lit(0 if c in zeros else None).cast(t).alias(c) for c, t in kinds.items()]) for p in parts]
    out = full[0]
    for part in full[1:]:
        out = out.unionByName(part)
    return out


def carried_forward(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The last non-null ``value`` up to each row, within ``keys`` and in ``order``."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(window)


def in_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], left: str, right: str) -> DataFrame:
    """Left-semi join with a literal set of pairs; the broadcast side is as large as the list."""
    values = ", ".join("('{}', '{}')".format(*(v.replace("'", "\\'") for v in pair)) for pair in pairs)
    listed = df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({left}, {right})")
    return df.join(F.broadcast(listed), [left, right], "left_semi")


def routed(name: Column, rules: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The first rule that holds names the category."""
    out = None
    for category, holds in rules:
        out = F.when(holds, category) if out is None else out.when(holds, category)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)
