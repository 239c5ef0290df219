"""Search for literal substrings through an inverted index of trigrams.

The index is three tables below a folder. `postings` has a row for each text and each distinct trigram of it, in folders by a hash of the trigram and sorted by it, so
one trigram's postings are a few row groups of one folder. `counts` has how many texts hold each trigram. `rows` has the rows themselves, in folders by a
hash of their key. A search takes the keyword's trigrams, rarest first, intersects the postings of at most MOST of them, reads the rows' folders that these
point to, and verifies each row. Keywords of one or two characters have no trigram: they scan `rows`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3
#: Folders of postings and of rows.
BUCKETS, SLOTS = 64, 64
#: Trigrams of a keyword that are intersected; the rarest say most.
MOST = 3
#: Candidates up to which they are broadcast to the rows' folders; more are joined by a shuffle.
FEW = 100_000


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text; none of shorter ones."""
    places = F.when(F.length(text) >= SIZE, F.sequence(F.lit(1), F.length(text) - SIZE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.substr(text, k, F.lit(SIZE))))


def _hash(column: Column, n: int) -> Column:
    return F.pmod(F.crc32(column.cast("binary")), F.lit(n)).cast("int")


def _address(key: Sequence[str]) -> Column:
    """A row's address by its key; null and the empty text differ."""
    return F.md5(F.to_json(F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(key)]), {"ignoreNullFields": "false"}).cast("binary"))


def build(rows: DataFrame, key: Sequence[str], text: Column, path: str) -> None:
    """Writes the index of the texts of rows, which are unique by key. Null texts hold nothing and are found by no keyword."""
    placed = rows.withColumns({"_text": text, "_address": _address(key)}).withColumn("_slot", _hash(F.col("_address"), SLOTS))
    placed.hint("rebalance", "_slot").sortWithinPartitions("_slot", "_address").write.partitionBy("_slot").parquet(f"{path}/rows")
    spark = rows.sparkSession
    own = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    postings = own.select(F.explode(trigrams(F.col("_text"))).alias("trigram"), "_address", "_slot").withColumn("bucket", _hash(F.col("trigram"), BUCKETS))
    postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "trigram", "_address").write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = spark.read.schema(postings.schema).parquet(f"{path}/postings").groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(f"{path}/counts")


def _bucket(spark: SparkSession, parts: list[str]) -> dict[str, int]:
    rows = spark.createDataFrame([(p,) for p in parts], "trigram string").select("trigram", _hash(F.col("trigram"), BUCKETS).alias("bucket"))
    return {r.trigram: r.bucket for r in rows.collect()}


def candidates(spark: SparkSession, path: str, keyword: str) -> tuple[DataFrame, int] | None:
    """(_slot, _address) of the rows that hold the keyword's rarest trigrams, and a bound of their number; None if it has no trigram."""
    parts = sorted({keyword[k : k + SIZE] for k in range(len(keyword) - SIZE + 1)})
    if not parts:
        return None
    counts = {r.trigram: r.n for r in spark.read.parquet(f"{path}/counts").filter(F.col("trigram").isin(parts)).collect()}  # a row for each trigram of the keyword at most
    rare = sorted(parts, key=lambda p: (counts.get(p, 0), p))[:MOST]
    buckets = _bucket(spark, rare)
    postings = spark.read.parquet(f"{path}/postings")
    lists = [postings.filter((F.col("bucket") == buckets[p]) & (F.col("trigram") == p)).select("_slot", "_address") for p in rare]
    return reduce(lambda a, b: a.join(b, ["_slot", "_address"], "left_semi"), lists), counts.get(rare[0], 0)


def search(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """The rows whose indexed text contains the keyword, which must be in the index's own form (its case, its white space). An empty keyword finds all texts."""
    rows = spark.read.parquet(f"{path}/rows")
    found = candidates(spark, path, keyword)
    if found is not None:
        own, most = found
        rows = rows.join(F.broadcast(own) if most <= FEW else own, ["_slot", "_address"], "left_semi")
    return rows.filter(F.contains("_text", F.lit(keyword))).drop("_text", "_address", "_slot")
