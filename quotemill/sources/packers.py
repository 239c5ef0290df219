"""Writers of the vendors' packed files and frames: what records and wire read, made from rows inside tasks.

Each takes rows with source_path (the file a row belongs to) and gives one row (source_path, content) per file, as records.files
would. A file is one value in one task, bounded as the vendors' files are; files spread over all tasks.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = "source_path string, content binary"


def date_number(day: Column) -> Column:
    """yyyymmdd."""
    return F.year(day) * 10_000 + F.month(day) * 100 + F.dayofmonth(day)


def packed_day(day: Column) -> Column:
    """The 16-bit date of minute files."""
    return (F.year(day) - 2004) * 2048 + F.month(day) * 100 + F.dayofmonth(day)


def hundredths(price: Column) -> Column:
    return F.round(price * 100).cast("long")


def filled(group: pd.DataFrame, layout: np.dtype) -> np.ndarray:
    """Records of a layout from columns named like its fields; absent fields are zero."""
    out = np.zeros(len(group), layout)
    for name in layout.names:
        if name in group:
            column = group[name]
            out[name] = [v.encode("gb18030") for v in column] if layout[name].kind == "S" else column.to_numpy()
    return out


def built(rows: DataFrame, key: str, order: list[str], build: Callable[[pd.DataFrame], bytes], schema: str = FILES) -> DataFrame:
    """One row (key, bytes) per value of the key, built from its rows in order. Partitions are sorted and read through once, a key's rows at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            open_key = batch[key].iloc[-1] if len(batch) else None
            rest = batch[batch[key] == open_key]
            done = [(k, build(g)) for k, g in batch[batch[key] != open_key].groupby(key, sort=False)]
            yield pd.DataFrame(done, columns=names)
        if rest is not None and len(rest):
            yield pd.DataFrame([(rest[key].iloc[0], build(rest))], columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def packed(rows: DataFrame, layout: np.dtype, order: list[str], head: Callable[[int], bytes] = lambda n: b"") -> DataFrame:
    """Files of records of one layout, in order, behind a head that may depend on their number."""
    return built(rows, "source_path", order, lambda group: head(len(group)) + filled(group, layout).tobytes())


def zipped(entries: DataFrame) -> DataFrame:
    """Archives (source_path, content) of entries (source_path of the archive, entry, content), in the order of their names."""

    def build(group: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content in zip(group["entry"], group["content"], strict=True):
                archive.writestr(name, content)
        return out.getvalue()

    return built(entries, "source_path", ["entry"], build)


def varint(value: int) -> bytes:
    """A signed number of 6, then 7 bits a byte, its sign in the first byte's second bit."""
    rest = abs(value) >> 6
    out = [abs(value) & 0x3F | (0x40 if value < 0 else 0) | (0x80 if rest else 0)]
    while rest:
        out.append(rest & 0x7F | (0x80 if rest >> 7 else 0))
        rest >>= 7
    return bytes(out)


def frame(body: bytes) -> bytes:
    """A frame around a body: 12 bytes, the packed and the plain size, the body packed if that is shorter."""
    inner = zlib.compress(body)
    inner = inner if len(inner) < len(body) else body
    return b"\0" * 12 + struct.pack("<HH", len(inner), len(body)) + inner


def framed(rows: DataFrame, order: list[str], record: Callable[[dict], bytes], head: Callable[[int], bytes]) -> DataFrame:
    """Frames (frame_id, frame) of rows with frame_id: a head, then each row's record, in order."""
    return built(rows, "frame_id", order, lambda group: frame(head(len(group)) + b"".join(map(record, group.to_dict("records")))), "frame_id long, frame binary")


def block_file(rows: DataFrame, header: int, name_bytes: int, area: int, code: int) -> DataFrame:
    """Block files of rows with source_path, block_no, block_name, block_type, member_order and symbol: a header, the number of blocks, the blocks."""

    def build(group: pd.DataFrame) -> bytes:
        blocks = []
        for _, own in group.groupby("block_no", sort=False):
            codes = b"".join(s.encode().ljust(code, b"\0") for s in own["symbol"])
            blocks.append(own["block_name"].iloc[0].encode("gb18030").ljust(name_bytes, b"\0") + struct.pack("<HH", len(own), int(own["block_type"].iloc[0])) + codes.ljust(area, b"\0"))
        return b"\0" * header + struct.pack("<H", len(blocks)) + b"".join(blocks)

    return built(rows, "source_path", ["block_no", "member_order"], build)


def report_file(rows: DataFrame) -> DataFrame:
    """Report files of rows with source_path, date (a number), symbol and items (an array): a header, an index by offset, the vectors."""

    def build(group: pd.DataFrame) -> bytes:
        size = 4 * len(group["items"].iloc[0])
        head = struct.pack("<HIHIII", 1, int(group["date"].iloc[0]), len(group), 0, size, 0)
        first = len(head) + 11 * len(group)
        index = b"".join(struct.pack("<6s1sI", s.encode(), b"1", first + k * size) for k, s in enumerate(group["symbol"]))
        return head + index + b"".join(np.asarray(x, "<f4").tobytes() for x in group["items"])

    return built(rows, "source_path", ["symbol"], build)


def custom_block_files(rows: DataFrame, name_bytes: int = 50, id_bytes: int = 70) -> DataFrame:
    """Files of custom blocks (source_path, content) from block_id, block_name, member_order, market, symbol: a catalogue and a list for each block.

    The name of a file is its path; block ids are file names, in whose order the catalogue is. records.custom_blocks reads them back.
    """
    digit = F.when(F.col("market") == "sz", "0").when(F.col("market") == "sh", "1").otherwise("2")
    lines = rows.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("member_order", F.concat(digit, "symbol").alias("line")))).alias("lines"))
    text = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\r\n"), F.lit("\r\n"))
    lists = lines.select(F.concat("block_id", F.lit(".blk")).alias("source_path"), text.cast("binary").alias("content"))

    def catalogue(group: pd.DataFrame) -> bytes:
        return b"".join(n.encode("gb18030").ljust(name_bytes, b"\0") + i.encode("gb18030").ljust(id_bytes, b"\0") for n, i in zip(group["block_name"], group["block_id"], strict=True))

    listed = rows.select(F.lit("blocknew.cfg").alias("source_path"), "block_id", "block_name").distinct()
    return lists.unionByName(built(listed, "source_path", ["block_id"], catalogue))
