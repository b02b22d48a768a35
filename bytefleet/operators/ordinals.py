"""Running sums and ordinals of groups that may hold a large share of all rows.

A window over such a group is one task. Here each group is split into pieces by ranges of the order column: sums of pieces are
added up first (few rows), and a window then runs over one piece at a time. Rows are shuffled once, as for the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of a group, and order values (by hash, so evenly) from which their bounds are taken; any bounds give right sums.
PIECES, SAMPLE = 64, 2048


def running_sums(rows: DataFrame, group: str, order: str | Column, values: dict[str, Column], before: bool = False) -> DataFrame:
    """The rows with, for each name, the sum of its value over the rows of the group up to each row in order, or before it.

    Null orders come first; rows of equal order are added up in any order. A null group is a group.
    """
    order = F.col(order) if isinstance(order, str) else order
    known = F.concat(F.when(F.col(group).isNull(), "n").otherwise("v"), F.coalesce(F.col(group).cast("string"), F.lit("")))
    keyed = rows.withColumn("_order", order).withColumn("_group", known)
    kind = keyed.schema["_order"].dataType
    met = keyed.select("_order").filter("_order is not null").orderBy(F.xxhash64("_order")).limit(SAMPLE).collect()
    bounds = sorted({r["_order"] for r in met})
    bounds = bounds[:: max(1, len(bounds) // PIECES)]
    inside = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b < F.col("_order"))) if bounds else F.lit(0)
    keyed = keyed.withColumn("_piece", inside)
    for name, value in values.items():
        keyed = keyed.withColumn(f"_of_{name}", value)
    sums = keyed.groupBy("_group", "_piece").agg(*[F.sum(f"_of_{name}").alias(f"_all_{name}") for name in values])
    earlier = Window.partitionBy("_group").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_group", "_piece", *[F.coalesce(F.sum(f"_all_{name}").over(earlier), F.lit(0)).alias(f"_from_{name}") for name in values])
    here = Window.partitionBy("_group", "_piece").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    joined = keyed.join(starts, ["_group", "_piece"])
    done = joined.select("*", *[(F.col(f"_from_{name}") + F.coalesce(F.sum(f"_of_{name}").over(here), F.lit(0))).alias(name) for name in values])
    return done.select(*rows.columns, *values)


def row_numbers(rows: DataFrame, group: str, order: str | Column, name: str) -> DataFrame:
    """The rows with their place in their group, from 1."""
    return running_sums(rows, group, order, {name: F.lit(1).cast("bigint")})
