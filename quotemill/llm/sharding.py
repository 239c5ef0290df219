"""Sharding by a lookup table that the shards' preference permutations fill, with DataFrame functions only on rows.

Each shard has a preference order over the slots of a table of prime size: it starts at an offset and goes on by a skip, both
hashes of its name, which visits every slot once as the size is prime. Shards take turns, each claiming its first slot not yet
taken, until all are. A key belongs to the shard in slot hash(key) mod size. Shards' shares differ by one slot at most, and
few keys move when a shard goes. The table has as many rows as its size, a parameter, and is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime over a hundred times the shards of the query.
TABLE_SIZE = 6553
SHARDS = 64


def lookup_table(names: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard in every slot. At least one name, all distinct; size is a prime no less than their number."""
    if not names or len(set(names)) < len(names) or size < len(names) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("distinct shard names and a prime table size no less than their number are needed")
    digests = [int.from_bytes(hashlib.sha256(n.encode()).digest()[:16]) for n in names]
    place = [d % size for d in digests]
    skip = [(d // size) % (size - 1) + 1 if size > 2 else 1 for d in digests]
    table = [-1] * size
    left = size
    while left:
        for shard in range(len(names)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % size
            table[place[shard]] = shard
            left -= 1
            if not left:
                break
    return table


def slot_of(key: F.Column, size: int) -> F.Column:
    """60 bits of the key's MD5, as text, modulo the table's size: the same in every SQL engine."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size))


def placed(rows: DataFrame, key: str, names: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """rows with the columns slot and shard (the name). A null key goes where the empty string goes.

    Columns of these names in rows are replaced; all others stay. Rows are not shuffled, so a hot source or repeated keys cost
    nothing; equal keys go to one shard. An empty table gives no rows.
    """
    spark = rows.sparkSession
    shards = F.split(F.lit("\n".join(names)), "\n")
    table = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, lookup_table(names, size)))), ",")).alias("_slot", "_shard"))
    table = table.select(F.col("_slot").cast("long").alias("slot"), F.element_at(shards, F.col("_shard").cast("int") + 1).alias("shard"))
    keyed = rows.drop("slot", "shard").withColumn("slot", slot_of(F.coalesce(F.col(key).cast("string"), F.lit("")), size))
    return keyed.join(F.broadcast(table), "slot").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")
