"""Row numbers and carried values over tables sorted by range.

Rows are dealt by range and sorted within partitions; what a partition needs of
the earlier ones is one number, so one row a partition is all that a single
task ever orders. The sorted table is written before it is numbered, so that a
lost executor can't change the bounds between two reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.checkpoints import checkpointed

_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number


def numbered(rows: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """rows with their position from 0 in the given order; ties take any order,
    the same in every read. Order columns decide the partition as well, so many
    equal first keys are no hot key where later ones differ."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return offsets(ranged, name)


def offsets(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Positions of rows as their partitions hold them."""
    held = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    sizes = held.groupBy("_part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))  # one row a partition
    pos = F.col("_before") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return held.join(F.broadcast(before), "_part").select(*rows.columns, pos.cast("long").alias(name))


def ranks(rows: DataFrame, key: str, *order: Column | str, name: str = "rank") -> DataFrame:
    """rows with their rank from 1 within each key, for keys of any number of
    rows: positions over all rows less the first of the key."""
    placed = numbered(rows, key, *order, name="_pos")
    first = placed.groupBy(key).agg(F.min("_pos").alias("_first"))
    return placed.join(first, key).select(*rows.columns, (F.col("_pos") - F.col("_first") + 1).alias(name))
