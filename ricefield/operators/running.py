"""Running sums and last values in an order, without a group in one task.

A window per group would put a group that holds a third of all rows into one task.  Here
the rows are range-partitioned on (group, order), so such a group is cut into several
ranges; inside a range a window runs as usual, and what came before it is carried in from
one small row per (range, group), as ``ranking.sequence_number`` does for positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ricefield.session import stored


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its column over the rows of the
    group before this one (0 for none), and for each name in ``lasts`` the last value that
    is not NULL among them.  (group, order) must be a total order."""
    sums, lasts = sums or {}, lasts or {}
    keys = [*group, *order]
    tagged = (
        df.select("*", *[c.alias(f"_rf_s_{n}") for n, c in sums.items()], *[c.alias(f"_rf_l_{n}") for n, c in lasts.items()])
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_rf_pid", F.spark_partition_id())
    )
    # one split for both uses below, and a lineage that later rounds don't repeat
    tagged = stored(tagged, "ranges")
    place = F.struct(*order)
    parts = tagged.groupBy("_rf_pid", *group).agg(
        *[F.sum(f"_rf_s_{n}").alias(f"_rf_s_{n}") for n in sums],
        *[F.max_by(f"_rf_l_{n}", F.when(F.col(f"_rf_l_{n}").isNotNull(), place)).alias(f"_rf_l_{n}") for n in lasts],
        F.count(F.lit(1)).alias("_rf_n"),
    )
    before = Window.partitionBy(*group).orderBy("_rf_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col("_rf_pid").alias("_rf_cpid"),
        *[F.col(g).alias(f"_rf_g_{i}") for i, g in enumerate(group)],
        *[F.sum(f"_rf_s_{n}").over(before).alias(f"_rf_cs_{n}") for n in sums],
        *[F.last(f"_rf_l_{n}", ignorenulls=True).over(before).alias(f"_rf_cl_{n}") for n in lasts],
    )
    on = [tagged["_rf_pid"] == carried["_rf_cpid"]] + [tagged[g].eqNullSafe(carried[f"_rf_g_{i}"]) for i, g in enumerate(group)]
    within = Window.partitionBy("_rf_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = tagged.select(
        "*",
        *[F.sum(f"_rf_s_{n}").over(within).alias(f"_rf_ws_{n}") for n in sums],
        *[F.last(f"_rf_l_{n}", ignorenulls=True).over(within).alias(f"_rf_wl_{n}") for n in lasts],
    )
    joined = rows.join(carried, reduce(lambda a, b: a & b, on))
    zero = F.lit(0)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(f"_rf_cs_{n}", zero) + F.coalesce(f"_rf_ws_{n}", zero)).alias(n) for n in sums],
        *[F.coalesce(f"_rf_wl_{n}", f"_rf_cl_{n}").alias(n) for n in lasts],
    )
