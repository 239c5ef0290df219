"""Packing of token pieces into fixed-length sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are encoded where they are read and cut into pieces of at most a sequence. The pieces are numbered and dealt into
randomised groups by a hash of that number, so a group is a random sample of lengths whatever the order, source or number of
copies of the input, and repeated rows spread like any others. The number of groups follows from the number of tokens: as no
piece is longer than a sequence, a group holds about TOKENS_PER_GROUP tokens, never whole texts. Each group is packed on its own;
the only waste is in a group's last bins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import text_or_empty, written
from quotemill.llm.wordbpe import encoder, id_width

#: A group takes 4 MB of ids, some hundred to a million pieces.
TOKENS_PER_GROUP = 1_000_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of every length, each at most capacity. Ties in length go in the order given.

    A tournament tree holds in each inner node the largest free capacity below it, so the first bin with room is found by
    walking down from the root, always to the left when the left half has room.
    """
    n = len(lengths)
    size = 1
    while size < n:
        size *= 2
    tree = [capacity] * (2 * size)
    bins, offsets = [0] * n, [0] * n
    for i in sorted(range(n), key=lambda k: -lengths[k]):
        need, node = lengths[i], 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            larger = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == larger:
                break
            tree[node] = larger
    return bins, offsets


def encoded_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, width: int) -> DataFrame:
    """(doc_id, start, ids, doc_tokens): every document's ids of so many bytes with the end's, cut at every capacity ids."""
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // width
                    rows += [(doc_id, start, ids[width * start : width * (start + capacity)], total) for start in range(0, total, capacity)]
                doc, start, ids, total = zip(*rows, strict=True)
                yield pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "ids": pa.array(ids, pa.binary()), "doc_tokens": pa.array(total, pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, ids binary, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, tokens_per_group: int = TOKENS_PER_GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Needs doc_id and text; other columns are ignored. A document's ids end with end_id, so an empty or null text is the
    piece [end_id]. Longer documents are cut at every capacity ids. Null ids and repeated rows are documents of their own.
    The pieces of a sequence are gapless from offset 0; an empty table gives no rows.
    """
    width = id_width(tokenizer)
    # numbered when written: rows that are equal in all columns get numbers of their own, which no later loss of an executor changes
    pieces = written(encoded_pieces(docs, tokenizer, capacity, end_id, width).withColumn("number", F.monotonically_increasing_id()), "pieces")
    tokens = pieces.agg(F.sum(F.octet_length("ids")) / width).first()[0] or 0
    groups = max(1, -(-int(tokens) // tokens_per_group))

    def pack(group: pa.Table) -> pa.Table:
        grp = group["grp"][0].as_py()
        group = group.append_column("length", pc.cast(pc.divide(pc.binary_length(group["ids"]), width), pa.int64()))
        group = group.sort_by([("length", "descending"), ("number", "ascending")])
        wide = pa.array([np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in group["ids"].to_pylist()], pa.binary())
        group = group.set_column(group.schema.get_field_index("ids"), "ids", wide)
        bins, offsets = first_fit_decreasing(group["length"].to_pylist(), capacity)
        group = group.append_column("sequence_id", pa.array([grp << 32 | b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        return group.select([c.split()[0] for c in PIECES.split(", ")])

    return pieces.withColumn("grp", F.pmod(F.xxhash64("number"), F.lit(groups))).groupBy("grp").applyInArrow(pack, PIECES)
