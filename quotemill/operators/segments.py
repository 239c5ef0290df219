"""Running values along one key by segments of time, so that a key with many rows is work for many tasks.

A window over (key) puts all rows of a key into one task. Here each (key, segment) is a window of its own. What earlier segments leave behind, a row for
each segment, comes from one aggregate over the rows, combined before it is shuffled, and one window over those few; it enters the segment's window
as a row before all others. Rows are shuffled once, by key and segment; null keys are a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _entered(rows: DataFrame, carry: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], segment: Column) -> tuple[DataFrame, Window]:
    """Rows and the carries before them, and the window of a segment: the rows' order, carries first. carry has by, _segment and _value."""
    own = rows.select(*by, segment.alias("_segment"), F.lit(1).alias("_place"), *[F.col(c).alias(f"_order_{k}") for k, c in enumerate(order)], F.struct(*rows.columns).alias("_row"), value.alias("_value"))
    none = lambda c: F.lit(None).cast(own.schema[c].dataType).alias(c)
    first = carry.select(*by, "_segment", F.lit(0).alias("_place"), *[none(f"_order_{k}") for k in range(len(order))], none("_row"), "_value")
    return own.unionByName(first), Window.partitionBy(*by, "_segment").orderBy("_place", *[f"_order_{k}" for k in range(len(order))])


def _unpacked(found: DataFrame, columns: Sequence[str], by: Sequence[str], value: Column, name: str) -> DataFrame:
    """Key columns stay outside the packed row, so filters on them reach the scans."""
    return found.filter("_place = 1").select(*[F.col(c) if c in by else F.col(f"_row.`{c}`").alias(c) for c in columns], value.alias(name))


def previous(rows: DataFrame, value: Column, valid: Column, by: Sequence[str], order: Sequence[str], segment: Column, name: str) -> DataFrame:
    """rows with the last valid value strictly before the row. segment must rise with order; rows equal in by and order have no order among themselves."""
    held = F.when(valid, F.struct(value.alias("v")))  # a valid null is a value
    ends = rows.groupBy(*by, segment.alias("_segment")).agg(F.max_by(held, F.when(valid, F.struct(*order))).alias("_end"))
    carry = ends.select(*by, "_segment", F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)).alias("_value"))
    both, window = _entered(rows, carry.filter("_value is not null"), held, by, order, segment)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1)))
    return _unpacked(found, rows.columns, by, F.col("_found.v"), name)


def running_sum(rows: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], segment: Column, name: str) -> DataFrame:
    """rows with the sum of the value over all rows up to the row, those equal in order included; null if there is none yet. segment must rise with order."""
    sums = rows.groupBy(*by, segment.alias("_segment")).agg(F.sum(value).alias("_sum"))
    carry = sums.select(*by, "_segment", F.sum("_sum").over(Window.partitionBy(*by).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)).alias("_value"))
    both, window = _entered(rows, carry.filter("_value is not null"), value, by, order, segment)
    return _unpacked(both.withColumn("_found", F.sum("_value").over(window.rangeBetween(Window.unboundedPreceding, Window.currentRow))), rows.columns, by, F.col("_found"), name)
