"""Sequence numbers and running sums over a whole table, without a one-partition window.

Rows are range-partitioned and sorted once; each partition numbers or sums its own rows as they
lie, and the partitions' totals, one row each, shift them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources.shared import shared_folder

#: Bits of a row's place inside its partition, in monotonically_increasing_id().
_PLACE_BITS = 33


def stable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the session's shared folder, so that reading it twice gives the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _shifted(parts: DataFrame, totals: DataFrame, names: list[str]) -> DataFrame:
    """``parts`` with the totals of all partitions before a row's own added to its running values."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__o_{c}") for c in names])
    # Offsets have one row a partition.
    joined = parts.join(F.broadcast(offsets), "__part")
    rest = [c for c in parts.columns if c != "__part" and c not in names]
    return joined.select(*rest, *[(F.col(c) + F.col(f"__o_{c}")).alias(c) for c in names])


def _running(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(names, 0)
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for c in names:
                if len(columns[c]):
                    columns[c] = pc.add(pc.cumulative_sum(columns[c]), pa.scalar(so_far[c], columns[c].type))
                    so_far[c] = columns[c][-1].as_py()
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def prefix_sums(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """``df`` with running sums over ``order``, which must be unique, the current row included.

    Sums are of whole numbers or floats; nulls count as 0. One shuffle; a partition's rows are summed up in Arrow batches as they lie.
    """
    names = list(sums)
    sorted_rows = df.select(*[c for c in df.columns if c not in sums], *[v.alias(c) for c, v in sums.items()])
    kinds = {f.name: T.LongType() if isinstance(f.dataType, T.IntegralType) else T.DoubleType() for f in sorted_rows.schema.fields if f.name in sums}
    values = [F.coalesce(F.col(c).cast(kinds[c]), F.lit(0).cast(kinds[c])).alias(c) if c in kinds else F.col(c) for c in sorted_rows.columns]
    laid = sorted_rows.select(*values).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    parts = stable(laid.mapInArrow(_running(names), laid.schema))
    ends = [F.max_by(c, F.struct(*order)).alias(c) for c in names]
    return _shifted(parts, parts.groupBy("__part").agg(*ends), names)


def dense_sequence(df: DataFrame, order: list[str], to: str = "seq") -> DataFrame:
    """``df`` numbered from 1 by ``order``, which must be unique. One shuffle; a sorted partition's rows number themselves."""
    place = F.monotonically_increasing_id()
    laid = df.drop(to).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place)
    parts = stable(laid.select("*", F.shiftright("__at", _PLACE_BITS).alias("__part"), (F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1) + 1).alias(to)).drop("__at"))
    return _shifted(parts, parts.groupBy("__part").agg(F.max(to).alias(to)), [to])
