"""Order-dependent values over range-sorted tables, without a task that sees all rows.

Rows are dealt by range and sorted within partitions. What a partition needs of
those before it is one number, so only one row a partition is ever put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number


def _before(parts: DataFrame, value: str, how) -> DataFrame:
    """part, before: value of all earlier partitions together; one row a partition."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", how(value).over(earlier).alias("before"))


def numbered(rows: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """rows with their position (from 0) in the given order, written as a table.

    Ties take any order, the same in every later read. stored_at is the folder
    of the table. An empty table stays empty.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _ROW_BITS).alias("part")
    before = _before(held.groupBy(part).agg(F.count("*").alias("n")), "n", F.sum)
    joined = held.withColumn("part", part).join(F.broadcast(before), "part")  # one row a partition
    pos = F.coalesce("before", F.lit(0)) + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    out = joined.select(*rows.columns, pos.cast("long").alias(name))
    out.stored_at = held.stored_at
    return out


def carried(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """rows with the column value (long, null or rising in the given order)
    filled forward: each row gets the last one at or before it, null if there
    is none. Equal first keys stay in one partition. Written as a table."""
    ranged = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    at = rows.columns.index(value)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1
        for b in batches:
            if b.num_rows:
                here = b.column(at).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                here = np.maximum.accumulate(np.maximum(here, last))
                last = int(here[-1])
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(here, mask=here < 0), *b.columns[at + 1 :]], schema=b.schema)

    held = materialize(ranged.mapInArrow(fill, rows.schema).withColumn("part", F.spark_partition_id()), "carried")
    before = _before(held.groupBy("part").agg(F.max(value).alias("m")), "m", F.max)
    joined = held.join(F.broadcast(before), "part")  # one row a partition
    out = joined.withColumn(value, F.greatest(value, "before")).select(*rows.columns)
    out.stored_at = held.stored_at
    return out

