"""Ranks and running sums in two levels, for keys that may hold most of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.session import cut_lineage


def with_carries(rows: DataFrame, keys: list[str], block: str, sums: dict[str, Column]) -> DataFrame:
    """Add each sum over all earlier blocks of the row's key (null where they hold no value); null keys are a key of their own.

    Rows combine to one row per key and block before a window runs over the blocks of a key.
    """
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, block).agg(*[c.alias(name) for name, c in sums.items()])
    on = [*keys, block]
    carries = totals.select(*[F.col(c).alias(f"_of_{c}") for c in on], *[F.sum(name).over(before).alias(name) for name in sums])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    return rows.join(carries, condition).drop(*[f"_of_{c}" for c in on])


def with_rank(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add the row's number, from 1, within its key by ``order`` (nulls first).

    Rows are dealt out in ranges of (key, order), so that one key spreads over many tasks: numbers inside a range plus the counts of the
    key's earlier ranges. The ranges are stored, since other samples would cut them elsewhere. Rows equal in key and order stay together.
    """
    ranged = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    carried = with_carries(ranged, keys, "_range", {"_before": F.count(F.lit(1))})
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return carried.withColumn(name, F.coalesce("_before", F.lit(0)) + inside).drop("_range", "_before")
