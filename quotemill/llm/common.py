"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage so that a lost executor costs a reread, not a recomputation.

    Results are read lazily, so the table stays as long as the application; its end deletes it.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, taken: Iterable[str]) -> str:
    """name, or name with underscores before it, such that no column is called so, whatever the case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


#: A key with more rows than this and than one in HOT_SHARE of all is joined apart from the others.
HOT_ROWS, HOT_SHARE = 200, 1000


def spread_join(big: DataFrame, small: DataFrame, key: str, count: str, total: int, hottest: int | None = None) -> DataFrame:
    """Inner join of big with small, which has one row for each key and in column count how many of big's total rows have it.

    Rows of a hot key stay where they are: at most HOT_SHARE keys can have more than total / HOT_SHARE rows each, so small's rows
    of these are a broadcast of bounded size. The other keys are joined by a shuffle, in which none has more rows than that.
    small's columns must be of bounded width and both inputs cheap to read again; total may be more than big's rows, not less. hottest,
    if it is known, bounds the rows of any key.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    if hottest is None:
        hottest = small.agg(F.max(count)).first()[0] or 0
    if hottest <= limit:
        return big.join(small, key)
    hot = small.filter(F.col(count) > limit)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.filter(F.col(count) <= limit), key)
    return big.join(F.broadcast(hot), key).unionByName(rest)


def salt(by: str, total: int) -> F.Column:
    """A number below the square root of total from a hash of column by: deals a hot key's rows, so that its partner is copied at most so often."""
    return F.pmod(F.xxhash64(by), F.lit(max(1, math.isqrt(total)))).cast("int")


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text") -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def node_of(text: F.Column) -> F.Column:
    """A text's address by its content."""
    return F.unhex(F.md5(text.cast("binary")))
