"""Positions and picks without funnelling rows through one task.

``sequence_number`` gives each row its 1-based position in a total order (optionally
restarting per group), the DataFrame form of ``zipWithIndex``:

1. range-partition on (group, order) and sort inside each partition; a hot group is
   split over several range partitions, so no task holds a whole group;
2. tag rows with ``spark_partition_id`` and ``monotonically_increasing_id``
   (partition index << 33 | row index);
3. count rows per (partition, group) -- at most #partitions + #groups rows -- and
   prefix-sum the counts per group in partition order;
4. join the offsets back: position = rows of the group in earlier partitions +
   index inside this partition + 1.

The order columns must form a total order (append a unique id as last tie-break) so
that positions are deterministic.  The tagged rows are checkpointed (written once to
``spark.checkpoint.dir``) so the counts and the positions come from one split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ricefield.session import checkpoint_dir


def sequence_number(
    df: DataFrame,
    order: list,
    partition_by: list[str] | tuple = (),
    name: str = "pos",
    start: int | Column = 1,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = 1-based (or ``start``-based) position of each row in
    (partition_by, order) order."""
    spark = df.sparkSession
    part = list(partition_by)
    keys = [F.col(p) for p in part] + [F.col(o) if isinstance(o, str) else o for o in order]
    # Without an explicit count AQE sizes the range partitions to the data (coalescing
    # merges neighbouring ranges, so partition order still follows the sort order).
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    tagged = (
        ranged
        .sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias("_rf_pid"), F.monotonically_increasing_id().alias("_rf_mid"))
    )
    # The range partitioner samples its bounds with a seed tied to the RDD id, so two
    # evaluations may split rows differently.  A reliable checkpoint of the tagged rows
    # pins one split for both uses below (and survives executor loss).
    checkpoint_dir(spark)
    tagged = tagged.checkpoint(eager=True)
    stats = tagged.groupBy("_rf_pid", *part).agg(
        F.min("_rf_mid").alias("_rf_first"), F.count(F.lit(1)).alias("_rf_cnt")
    )
    before = Window.partitionBy(*part).orderBy("_rf_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(
        F.col("_rf_pid").alias("_rf_opid"),
        *[F.col(p).alias(f"_rf_g_{i}") for i, p in enumerate(part)],
        "_rf_first",
        F.coalesce(F.sum("_rf_cnt").over(before), F.lit(0)).alias("_rf_before"),
    )
    if not part:
        # One row per range partition: the size bound is the partition count.
        offsets = F.broadcast(offsets)
    # With groups: at most #partitions + #groups rows; Spark broadcasts them when their size
    # in bytes allows it and shuffles both sides otherwise.
    cond = [tagged["_rf_pid"] == offsets["_rf_opid"]] + [
        tagged[p].eqNullSafe(offsets[f"_rf_g_{i}"]) for i, p in enumerate(part)
    ]
    joined = tagged.join(offsets, reduce(lambda a, b: a & b, cond), "inner")
    start_col = start if isinstance(start, Column) else F.lit(start)
    pos = F.col("_rf_before") + (F.col("_rf_mid") - F.col("_rf_first")) + start_col
    return joined.select(*[F.col(c) for c in df.columns], pos.cast("long").alias(name))


def first_by(df: DataFrame, group: list[str], rank: list[Column], value_cols: list[str], prefix: str = "") -> DataFrame:
    """For each group, the values of the row with the greatest ``rank`` struct.

    An aggregate (``max_by``) with map-side partial aggregation: a hot group is
    reduced inside every map task before the shuffle, never gathered in one task.
    """
    packed = F.struct(*[F.col(c) for c in value_cols])
    agg = df.groupBy(*group).agg(F.max_by(packed, F.struct(*rank)).alias("_rf_pick"))
    return agg.select(*group, *[F.col(f"_rf_pick.{c}").alias(prefix + c) for c in value_cols])
