"""ZIP archives by their members: tasks read directories by range, then each member on its own, so no archive is ever one value.

directory() reads only the ends of archives; names, sizes and counts are checked there. contents() and record_rows() then deal the members, not the archives,
to tasks; a task opens an archive at the places of its own members. Records are decoded while a member is inflated, some thousand at a time, so
a member needs no room of its own either; formats that are addressed by offset, and inner archives, are held one member at a time.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.sources import ranges, records, store

#: Bytes of members, when inflated, that a task is to read.
BYTES_PER_TASK = 64 << 20
MOST_BYTES = 64 << 20
#: Rows that a task gathers before it hands them on.
ROWS_HELD = 100_000
DIRECTORY = "source_path string, archive_bytes long, place int, entry string, size long, packed_size long, problem string"
#: Fixed limits of a day package: bytes of the archive, of an entry and of all entries, and records of a market.
PACKAGE_BYTES, ENTRY_BYTES, EXPANDED_BYTES, MARKET_RECORDS = 16 << 20, 64 << 20, 128 << 20, 100_000
MARKETS = ("sh", "sz", "bj")


def directory(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """A row for each member of the archives below the path: source_path, archive_bytes, place, entry, size, packed_size. A file that is no archive has one row, with a problem."""
    names = store.listed(path, pattern)
    tasks = max(1, min(len(names), spark.sparkContext.defaultParallelism * 4))
    rows = spark.createDataFrame(names, "source_path string, archive_bytes long").repartition(tasks, "source_path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source_path", "archive_bytes", "place", "entry", "size", "packed_size", "problem"]
        for batch in batches:
            found = []
            for path, size in batch.itertuples(index=False):
                try:
                    with store.opened(path) as file, zipfile.ZipFile(file) as archive:
                        found += [(path, size, k, i.filename, i.file_size, i.compress_size, None) for k, i in enumerate(archive.infolist()) if not i.is_dir()]
                except (zipfile.BadZipFile, pa.ArrowInvalid) as error:  # the latter for a place before the file
                    found.append((path, size, -1, None, 0, 0, str(error)))
                if len(found) >= ROWS_HELD:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
            yield pd.DataFrame(found, columns=columns)

    return rows.mapInPandas(run, DIRECTORY)


def _dealt(members: DataFrame, size: Column, *by: str) -> DataFrame:
    """Members dealt to as many tasks as their bytes ask for, whichever archive they are in."""
    total = members.agg(F.sum(size)).first()[0] or 0
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, -(-total // BYTES_PER_TASK))
    return members.repartition(int(tasks), *by)


def _opened(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, zipfile.ZipFile]]:
    """The rows of each archive, with the archive, opened once."""
    for path, own in batch.groupby("source_path", sort=False):
        with store.opened(path) as file, zipfile.ZipFile(file) as archive:
            yield own, archive


def _suffixed(suffixes: tuple[str, ...]) -> Column:
    found = F.lit(not suffixes)
    for s in suffixes:
        found |= F.lower("entry").endswith(s)
    return found


def contents(members: DataFrame, suffixes: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """source_path, entry and content of members of a directory that end in one of the suffixes, inner archives' members too; one beyond the bound raises."""
    inner = F.lower("entry").endswith(".zip")
    wanted = members.filter(F.col("entry").isNotNull() & (_suffixed(suffixes) | inner)).select("source_path", "entry", "place", "size")

    def inside(archive: zipfile.ZipFile, info: zipfile.ZipInfo, prefix: str) -> Iterator[tuple[str, bytes]]:
        if info.file_size > most_bytes:
            raise ValueError(f"{prefix}{info.filename} has {info.file_size} bytes")
        content = archive.read(info)
        if not info.filename.lower().endswith(".zip"):
            yield prefix + info.filename, content
            return
        with zipfile.ZipFile(io.BytesIO(content)) as nested:
            for i in sorted(nested.infolist(), key=lambda i: i.filename):
                if not i.is_dir() and (not suffixes or i.filename.lower().endswith((*suffixes, ".zip"))):
                    yield from inside(nested, i, f"{prefix}{info.filename}!")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source_path", "entry", "content"]
        found, held = [], 0
        for batch in batches:
            for own, archive in _opened(batch):
                infos = archive.infolist()
                for path, place in zip(own["source_path"], own["place"], strict=True):
                    for name, data in inside(archive, infos[place], ""):
                        found.append((path, name, data))
                        held += len(data)
                        if held >= records.BATCH_BYTES or len(found) >= records.BATCH_ROWS:
                            yield pd.DataFrame(found, columns=columns)
                            found, held = [], 0
        yield pd.DataFrame(found, columns=columns)

    return _dealt(wanted, F.col("size"), "source_path", "entry").mapInPandas(run, "source_path string, entry string, content binary")


def record_rows(members: DataFrame, kind: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """All whole records of members of record files, as ranges.record_rows has them; source_path is the archive's with the entry's behind it."""
    wanted = members.filter(F.col("entry").isNotNull() & _suffixed(suffixes)).select("source_path", "entry", "place", "size")
    schema = f"source_path string, row_offset long, market string, symbol string, trade_date date, {ranges.COLUMNS[kind]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ranges.RecordReader({"path": "", "kind": kind})
        for batch in batches:
            for own, archive in _opened(batch.to_pandas()):
                infos = archive.infolist()
                for path, entry, place in zip(own["source_path"], own["entry"], own["place"], strict=True):
                    layout, at = ranges.layout_of(kind, entry), 0
                    with archive.open(infos[place]) as member:
                        while block := member.read(ranges.BATCH_RECORDS * layout.itemsize):
                            r = np.frombuffer(block, layout, len(block) // layout.itemsize)
                            if len(r):
                                yield reader.batch(f"{path}!/{entry}", at, r)
                            at += len(r)

    return _dealt(wanted, F.col("size"), "source_path", "entry").mapInArrow(run, schema)


def file_rows(members: DataFrame, kind: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """source_path, records and trailing_bytes of members of record files, from the directory alone."""
    width = ranges.layout_of(kind, "").itemsize
    own = members.filter(F.col("entry").isNotNull() & _suffixed(suffixes))
    return own.select(F.concat_ws("!/", "source_path", "entry").alias("source_path"), F.floor(F.col("size") / width).alias("records"), (F.col("size") % width).alias("trailing_bytes"))


def checked_rows(members: DataFrame, kind: str, suffixes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of members of record files, as ranges.checked_rows has them."""
    found, issues = records.checked(record_rows(members, kind, suffixes), ranges.KEYS[kind], kind)
    return found, issues.unionByName(records.file_issues(file_rows(members, kind, suffixes), found))


# ---- day packages


def _entries(members: DataFrame) -> DataFrame:
    """The members of packages that are named like shYYMMDD.cod or .md1, with market, day, kind and records."""
    name = F.lower(F.element_at(F.split("entry", r"[/\\]"), -1))
    part = lambda k: F.regexp_extract(name, r"^(sh|sz|bj)([0-9]{6})\.(cod|md1)$", k)
    named = members.withColumns({"market": part(1), "day": part(2), "kind": part(3)}).filter("market <> ''")
    width = F.when(F.col("kind") == "cod", records.PACK_CODE).otherwise(records.PACK_BAR.itemsize)
    return named.withColumns({"records": F.floor(F.col("size") / width), "rest": F.col("size") % width, "trade_date": F.try_to_date(F.concat(F.lit("20"), "day"), "yyyyMMdd")})


def package_checks(members: DataFrame, expected: Column | None = None) -> DataFrame:
    """source_path, trade_date and problem, null if there is none, of day packages, from their directories alone.

    Each market's codes and bars must be there once, of one day, within the limits, with as many records of one as of the other. expected, of source_path, is
    the day a package is asked for.
    """
    own = _entries(members)
    by_market = own.groupBy("source_path", "market").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("cod", "md1")],
        *[F.max(F.when(F.col("kind") == k, F.col("records"))).alias(k) for k in ("cod", "md1")],
        F.max("rest").alias("rest"), F.max("size").alias("largest"), F.sum("size").alias("bytes"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count_if(F.col("trade_date").isNull()).alias("undated"),
    )
    sized = members.groupBy("source_path").agg(F.max("archive_bytes").alias("archive_bytes"), F.max("problem").alias("unread"))
    each = lambda condition: F.bool_or(condition)
    found = by_market.groupBy("source_path").agg(
        F.count("*").alias("markets"), F.min("first").alias("trade_date"), F.max("last").alias("last"), F.sum("undated").alias("undated"), F.max("largest").alias("largest"), F.sum("bytes").alias("bytes"),
        each((F.col("n_cod") > 1) | (F.col("n_md1") > 1)).alias("twice"), each((F.col("n_cod") == 0) | (F.col("n_md1") == 0)).alias("half"), each(F.col("rest") > 0).alias("cut"),
        each(F.col("cod") == 0).alias("none"), each(F.col("cod") != F.col("md1")).alias("unequal"), each(F.col("cod") > MARKET_RECORDS).alias("many"),
    )
    rows = sized.join(found, "source_path", "left")
    problem = (
        F.when(F.col("unread").isNotNull(), "not_an_archive")
        .when(F.col("archive_bytes") == 0, "empty_package")
        .when(F.col("archive_bytes") > PACKAGE_BYTES, "package_too_large")
        .when(F.col("markets").isNull(), "no_entries")
        .when(F.col("largest") > ENTRY_BYTES, "entry_too_large")
        .when(F.col("bytes") > EXPANDED_BYTES, "expanded_too_large")
        .when(F.col("undated") > 0, "invalid_date")
        .when(F.col("trade_date") != F.col("last"), "mixed_dates")
        .when(F.col("twice"), "duplicate_entry")
    )
    if expected is not None:
        problem = problem.when(F.col("trade_date") != expected, "unexpected_date")
    problem = problem.when((F.col("markets") < len(MARKETS)) | F.col("half"), "missing_pair").when(F.col("cut"), "partial_record").when(F.col("none"), "zero_records").when(F.col("unequal"), "record_count_mismatch").when(F.col("many"), "too_many_records")
    return rows.select("source_path", F.when(F.col("undated") == 0, F.col("trade_date")).alias("trade_date"), problem.alias("problem"))


PACKAGE_BARS = "source_path string, market string, day string, record long, symbol string, open double, high double, low double, close double, volume long, amount double"


def package_records(members: DataFrame, checks: DataFrame) -> DataFrame:
    """All records of the packages that passed the checks: codes and bars of a market paired by position, both read by one task from the archive.

    Volumes beyond a signed 64-bit number are null.
    """
    good = _entries(members).join(checks.filter("problem is null").select("source_path"), "source_path", "left_semi")
    pairs = good.groupBy("source_path", "market", "day").agg(*[F.max(F.when(F.col("kind") == k, F.col("place"))).alias(k) for k in ("cod", "md1")], F.sum("size").alias("size"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, held = [], 0
            for own, archive in _opened(batch):
                infos = archive.infolist()
                for row in own.itertuples():
                    codes, bars = archive.read(infos[row.cod]), np.frombuffer(archive.read(infos[row.md1]), records.PACK_BAR)
                    symbols = [codes[k : k + 6].decode("ascii", "replace") for k in range(0, len(codes), records.PACK_CODE)]
                    volume = pd.array([v if v < 1 << 63 else None for v in bars["volume"].tolist()], "Int64")
                    found.append(pd.DataFrame({"source_path": row.source_path, "market": row.market, "day": row.day, "record": range(len(symbols)), "symbol": symbols} | {p: bars[p] for p in records.PRICES} | {"volume": volume, "amount": bars["amount"]}))
                    held += len(symbols)
                if held >= ROWS_HELD:
                    yield pd.concat(found, ignore_index=True)
                    found, held = [], 0
            if found:
                yield pd.concat(found, ignore_index=True)

    return _dealt(pairs, F.col("size"), "source_path", "market").mapInPandas(run, PACKAGE_BARS)


def packages(members: DataFrame, expected: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, checks, counts) of day packages (a directory): bars of shares that traded, what is wrong with each package, and the counts of its records.

    A package is taken whole or not at all: besides its directory, an invalid or repeated symbol, or a share's bar that is not sound, refuses it. Counts are by
    package, market and class: share, other, and idle for shares without a trade; they cover the packages taken.
    """
    checks = package_checks(members, expected)
    rows = package_records(members, checks)
    share = records.is_share(F.col("market"), F.col("symbol"))
    idle = share & records.no_trade(rows)
    sound = (F.col("volume").isNull() | (F.col("volume") > 0)) & (F.col("amount") > 0) & (F.col("amount") < float("inf")) & records.consistent(rows)
    for p in records.PRICES:
        sound &= F.col(p) > 0
    kind = F.when(idle, "idle").when(share, "share").otherwise("other")
    marked = rows.withColumns({"class": kind, "bad_symbol": ~F.col("symbol").rlike("^[0-9]{6}$"), "bad_bar": share & ~idle & ~F.coalesce(sound, F.lit(False))})
    per_symbol = marked.groupBy("source_path", "market", "symbol").agg(F.count("*").alias("n"), F.bool_or("bad_symbol").alias("bad_symbol"), F.bool_or("bad_bar").alias("bad_bar"))
    inner = per_symbol.groupBy("source_path").agg(F.when(F.bool_or("bad_symbol"), "invalid_symbol").when(F.max("n") > 1, "duplicate_symbol").when(F.bool_or("bad_bar"), "invalid_bar").alias("inner"))
    judged = checks.join(inner, "source_path", "left").select("source_path", "trade_date", F.coalesce("problem", "inner").alias("problem"))
    taken = marked.join(judged.filter("problem is null").select("source_path", "trade_date"), "source_path")
    bars = taken.filter("class = 'share'").select("source_path", "market", "symbol", "trade_date", *records.PRICES, "volume", "amount")
    return bars, judged, taken.groupBy("source_path", "market", "class").agg(F.count("*").alias("records"))
