"""Merkle trees over snapshots of rows: two snapshots are compared from their roots, and only ranges that differ are read.

Rows are placed by the first DEPTH hexadecimal digits of the hash of their key, so ranges are even whatever the keys. A leaf's digest is that of its rows' sorted digests,
a node's that of its children's in order, so equal rows give equal digests in any order, and a difference shows on the path to its leaf only. Snapshots of one depth can be compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Digits of the leaves' names: 16 ** DEPTH leaves. A leaf's rows meet in one value, 65 bytes each.
DEPTH = 3
NODES = "level int, node string, digest string, n long"


def _digest(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, "\n").cast("binary"), 256)


def snapshot(rows: DataFrame, key: Sequence[str], path: str, depth: int = DEPTH) -> None:
    """Writes rows as a snapshot: `rows` in folders by the first digit, sorted by leaf, `nodes`, a row for each node that has rows, and an empty table of the rows' schema."""
    columns = rows.columns
    rows.sparkSession.createDataFrame([], rows.schema).write.parquet(f"{path}/schema")
    placed = rows.withColumn("_leaf", F.substring(_digest(*[F.col(k) for k in key]), 1, depth)).withColumn("_part", F.substring("_leaf", 1, 1))
    placed.hint("rebalance", "_part").sortWithinPartitions("_part", "_leaf").write.partitionBy("_part").parquet(f"{path}/rows")
    spark = rows.sparkSession
    own = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    nodes = own.groupBy(F.col("_leaf").alias("node")).agg(_joined(F.sort_array(F.collect_list(_digest(*[F.col(c) for c in columns])))).alias("digest"), F.count(F.lit(1)).alias("n"))
    nodes.select(F.lit(depth).alias("level"), "node", "digest", "n").repartitionByRange("node").sortWithinPartitions("node").write.parquet(f"{path}/nodes/leaves")
    leaves = spark.read.schema(NODES).parquet(f"{path}/nodes/leaves")  # the rows are hashed once; what lies above is read from here
    every, level = leaves.limit(0), leaves
    for k in range(depth - 1, -1, -1):  # a sixteenth of the nodes each time
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        level = level.groupBy(F.substring("node", 1, k).alias("node")).agg(_joined(F.transform(children, lambda c: F.concat(c["node"], F.lit(":"), c["digest"]))).alias("digest"), F.sum("n").alias("n")).select(F.lit(k).alias("level"), "node", "digest", "n")
        every = every.unionByName(level)
    every.coalesce(1).sortWithinPartitions("level", "node").write.parquet(f"{path}/nodes/above")  # a fifteenth of the leaves


def _nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(f"{path}/nodes/leaves", f"{path}/nodes/above")


def root(spark: SparkSession, path: str) -> str | None:
    """The digest of a whole snapshot; None if it has no rows."""
    found = _nodes(spark, path).filter("level = 0").first()
    return found.digest if found else None


def differing_leaves(spark: SparkSession, old: str, new: str) -> list[str]:
    """The leaves in which two snapshots differ, found from the roots down: of each level only the children of nodes that differ are read. At most 16 ** depth names."""
    both = [_nodes(spark, p) for p in (old, new)]
    depth = both[0].unionByName(both[1]).agg(F.max("level")).first()[0]
    if depth is None:
        return []
    differ = [""]
    for level in range(depth + 1):
        above = F.substring("node", 1, max(0, level - 1))
        a, b = (t.filter((F.col("level") == level) & (above.isin(differ) if len(differ) < 1000 else F.lit(True))).select("node", F.col("digest").alias(d)) for t, d in zip(both, ("a", "b"), strict=True))
        parents = set(differ)
        differ = [r.node for r in a.join(b, "node", "full_outer").filter("not a <=> b").select("node").collect() if r.node[: max(0, level - 1)] in parents]
        if not differ:
            return []
    return sorted(differ)


def ranges(spark: SparkSession, path: str, leaves: Sequence[str]) -> DataFrame:
    """The rows of some leaves: their folders, and in these the row groups that can hold them."""
    schema = StructType([*spark.read.parquet(f"{path}/schema").schema.fields, *(StructField(c, StringType()) for c in ("_leaf", "_part"))])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.filter(F.col("_part").isin(sorted({x[:1] for x in leaves})) & F.col("_leaf").isin(list(leaves))).drop("_leaf", "_part")


def difference(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Rows that a snapshot gained (added) or lost (removed) against an older one, repeated rows by their number."""
    leaves = differing_leaves(spark, old, new)
    before, after = ranges(spark, old, leaves), ranges(spark, new, leaves)
    after = after.select(*before.columns)
    return after.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))
