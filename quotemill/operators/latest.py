"""One row per logical key: newest-version reads, first-wins dedup with issues, conflict guards, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, key: Sequence[str], version: str, keep_version: bool = False) -> DataFrame:
    """Per key the row of the highest version; rows without a version are older than any other.

    Key columns stay outside the aggregate, so filters on them reach the scan. Null keys are a key of their own.
    """
    others = [c for c in df.columns if c not in key and (keep_version or c != version)]
    if not others:
        return df.select(*key).distinct()
    place = F.struct(F.col(version).isNotNull(), F.col(version))  # never null, so that a key without versions keeps a row
    best = F.max_by(F.struct(*others), place).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_row.{c}").alias(c) for c in others])


def first_with_issues(df: DataFrame, key: Sequence[str], order: str, compare: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): per key its first row by order; one issue per later row.

    An issue is conflicting_logical_key if the later row differs from the first in any other column, else
    duplicate_logical_key; with compare off, always the latter. Both frames come from one shuffle on the key.
    """
    values = [c for c in df.columns if c not in key and c != order]
    window = Window.partitionBy(*key).orderBy(order)
    marked = df.withColumn("_n", F.row_number().over(window)).withColumn("_first", F.first(F.struct(*values) if values else F.lit(0)).over(window))
    same = F.col("_first").eqNullSafe(F.struct(*values)) if values and compare else F.lit(True)
    issues = marked.filter("_n > 1").select(*key, order, F.when(same, "duplicate_logical_key").otherwise("conflicting_logical_key").alias("issue_type"))
    return marked.filter("_n = 1").drop("_n", "_first"), issues


def conflicts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose rows are not all equal, with how many versions of them there are. Rows are compared by their own values."""
    return df.distinct().groupBy(*key).agg(F.count("*").alias("versions")).filter("versions > 1")


def without_conflicts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """df with equal rows collapsed; a key whose rows differ is an error of the plan, raised before any of its rows are written.

    One aggregate per key holds its least and greatest row; nothing is computed while the plan is built.
    """
    values = [c for c in df.columns if c not in key]
    if not values:
        return df.distinct()
    row = F.struct(*values)
    both = df.groupBy(*key).agg(F.min(row).alias("_least"), F.max(row).alias("_most"))
    named = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    checked = F.when(F.col("_least").eqNullSafe(F.col("_most")), F.col("_least")).otherwise(F.raise_error(F.concat(F.lit("conflicting rows for "), named)))
    return both.select(*key, checked.alias("_row")).select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """stored with the rows of incoming replacing those of equal key, null keys included. Whole rows, never single fields."""
    old, new = stored.alias("old"), incoming.select(*key).distinct().alias("new")
    kept = old.join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key], "left_anti")
    return kept.unionByName(incoming)


def merge_locked(stored: DataFrame, incoming: DataFrame, key: Sequence[str], lock: str, always: Sequence[str] = ()) -> DataFrame:
    """Upsert where a row with a true lock keeps its values, save those in always; the lock itself is never overwritten. Null keys are keys."""
    key = list(key)
    there = "_there"
    old, new = stored.withColumn(there, F.lit(True)).alias("old"), incoming.withColumn(there, F.lit(True)).alias("new")
    joined = old.join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key], "full_outer")
    has_old, has_new = F.col(f"old.{there}").isNotNull(), F.col(f"new.{there}").isNotNull()

    def merged(c: str) -> Column:
        was, now = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c in key:
            return F.coalesce(was, now)
        if c == lock:
            return F.when(has_old, was).otherwise(now)
        keep = ~has_new | (has_old & F.coalesce(F.col(f"old.{lock}"), F.lit(False)) & F.lit(c not in always))
        return F.when(keep, was).otherwise(now)

    return joined.select(*[merged(c).alias(c) for c in stored.columns])


def occupied(stored: DataFrame, incoming: DataFrame, column: str) -> DataFrame:
    """Values of the column for which stored has rows already, so that incoming must be refused."""
    return incoming.select(column).distinct().join(stored.select(column).distinct(), column, "left_semi")
