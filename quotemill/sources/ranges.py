"""Record files as a Spark data source whose partitions are ranges of records.

A file larger than a task's share is read by several tasks, each from its own offset; small files share a task. Market and symbol, which are in the
path, prune whole files; dates prune ranges by binary search where the option `ordered` promises records in the order of time, and are
compared record by record otherwise. Filters on these columns are taken over in full, so they show as pushed in the plan.

Options: path; kind (day, minute, ex_day, metric, capital); glob; records_per_task; ordered; rows (records or files). Rows of kind files tell of each
file, from its listing alone, how many whole records it has and how many bytes are left over.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from quotemill.session import ship
from quotemill.sources import records, store

RECORDS_PER_TASK, FILES_PER_TASK = 4_000_000, 50_000
#: Records decoded at once.
BATCH_RECORDS = 1 << 18
EPOCH = datetime.date(1970, 1, 1)

_BAR = "open double, high double, low double, close double, amount double, volume long"
#: Columns after source_path, row_offset, market, symbol and trade_date.
COLUMNS = {
    "day": _BAR,
    "minute": f"minute_of_day int, {_BAR}",
    "ex_day": "open double, high double, low double, close double, amount long, price double, position long, trade long, settlement double",
    "metric": "metric_type long, value1 double, value2 double",
    "capital": "category long, a double, b double, c double, d double",
}
#: What says a record twice.
KEYS = {"day": ["market", "symbol", "trade_date"], "minute": ["market", "symbol", "trade_date", "minute_of_day"], "ex_day": ["market", "symbol", "trade_date"], "metric": ["market", "symbol", "metric_type", "trade_date"], "capital": ["market", "symbol", "trade_date", "category"]}
#: Bytes before the first record.
HEADS = {"capital": 4}
FILES = "source_path string, records long, trailing_bytes long"


def layout_of(kind: str, path: str) -> np.dtype:
    if kind == "minute":
        return records.MINUTE_INT if re.search(r"\.[15]$", path.lower()) else records.MINUTE_FLOAT
    return {"day": records.DAY, "ex_day": records.EX_DAY, "metric": records.METRIC, "capital": records.CAPITAL}[kind]


def place_of(path: str) -> tuple[str, str]:
    """Market and symbol of a path such as .../sh600000.day, as functions.text.market_and_symbol has them."""
    name = re.split(r"[/\\]", path)[-1].lower()
    digits = re.search("[0-9]{6}", name)
    symbol = digits[0] if digits else ""
    named = re.match("(sh|sz|bj)[#_]?[0-9]{6}", name)
    return named[1] if named else market_of(symbol), symbol


def market_of(symbol: str) -> str:
    return "bj" if symbol.startswith("920") or symbol[:1] in ("8", "4") else "sh" if symbol[:1] in ("6", "9") else "sz"


def ex_place_of(path: str) -> tuple[str, str]:
    """Extension market and code of a path such as .../29#IFL0.day."""
    found = re.match(r"([0-9]+)#([^.]+)\.", re.split(r"[/\\]", path)[-1])
    return (found[1], found[2].upper()) if found else ("", "")


def days_of(year: np.ndarray, month: np.ndarray, day: np.ndarray, first_year: int = 1900) -> tuple[np.ndarray, np.ndarray]:
    """Days from 1970 of dates in parts, and which of them exist."""
    months = (year.astype(np.int64) - 1970) * 12 + (month - 1)
    start = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    good = (year >= first_year) & (year <= 9999) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= after - start)
    return start + day - 1, good


def dates_in(kind: str, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = r["date"].astype(np.int64)
    if kind == "minute":
        days, good = days_of(number // 2048 + 2004, number % 2048 // 100, number % 2048 % 100)
        return days, good & (r["minute"] < 24 * 60)
    return days_of(number // 10_000, number // 100 % 100, number % 100)


@dataclass
class Wanted:
    """What filters leave: markets, symbols, and days from 1970, both ends included."""

    sets: dict[str, set] = field(default_factory=dict)
    first: int | None = None
    last: int | None = None

    def take(self, f: Filter) -> bool:
        """Whether the filter is taken over."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
        if name in ("market", "symbol") and isinstance(f, EqualTo | In):
            values = set(f.value if isinstance(f, In) else [f.value])
            self.sets[name] = self.sets.get(name, values) & values
            return True
        if name == "trade_date" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, datetime.date):
            day = (f.value - EPOCH).days
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                first = day + isinstance(f, GreaterThan)
                self.first = first if self.first is None else max(self.first, first)
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                last = day - isinstance(f, LessThan)
                self.last = last if self.last is None else min(self.last, last)
            return True
        return False

    def place(self, market: str, symbol: str) -> bool:
        return all(value in self.sets.get(name, {value}) for name, value in (("market", market), ("symbol", symbol)))

    @property
    def dated(self) -> bool:
        return self.first is not None or self.last is not None

    def days(self, days: np.ndarray) -> np.ndarray:
        kept = np.ones(len(days), bool)
        if self.first is not None:
            kept &= days >= self.first
        if self.last is not None:
            kept &= days <= self.last
        return kept


@dataclass
class Ranges(InputPartition):
    """(file, first record, record after the last) of one task."""

    parts: list[tuple[str, int, int]]


class RecordFiles(DataSource):
    """spark.read.format("record_files")."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        if self.options.get("rows", "records") == "files":
            return FILES
        return f"source_path string, row_offset long, market string, symbol string, trade_date date, {COLUMNS[self.options['kind']]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FileReader if self.options.get("rows", "records") == "files" else RecordReader)(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.kind = self.options["kind"]
        self.share = int(self.options.get("records_per_task", RECORDS_PER_TASK))
        self.wanted = Wanted()

    def sizes(self) -> Iterator[tuple[str, int, int]]:
        """Path, whole records and bytes left over of every file."""
        for path, size in store.listed(self.options["path"], self.options.get("glob", "*")):
            width, head = layout_of(self.kind, path).itemsize, HEADS.get(self.kind, 0)
            if not head:
                yield path, size // width, size % width
                continue
            with store.opened(path) as file:  # the number of records leads the file
                count = int.from_bytes(file.read_at(head, 0), "little") if size >= head else 0
            there = min(count, max(0, size - head) // width)
            left = max(0, size - head) - there * width
            yield path, there, max(left, 1) if size < head or there < count else left  # a number that is not reached counts as a byte


class FileReader(_Reader):
    """A row for each file, from the listing."""

    def partitions(self) -> Sequence[InputPartition]:
        found = [*self.sizes()]
        return [Ranges(found[k : k + FILES_PER_TASK]) for k in range(0, max(1, len(found)), FILES_PER_TASK)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        columns = [list(c) for c in zip(*partition.parts, strict=True)] or [[], [], []]
        yield pa.record_batch({"source_path": pa.array(columns[0], pa.string()), "records": pa.array(columns[1], pa.int64()), "trailing_bytes": pa.array(columns[2], pa.int64())})


class RecordReader(_Reader):
    """Records of all files that the filters leave."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.kind == "capital" and getattr(f, "attribute", ("",))[0] in ("market", "symbol") or not self.wanted.take(f):
                yield f

    def place(self, path: str) -> tuple[str, str]:
        return ex_place_of(path) if self.kind == "ex_day" else place_of(path)

    def partitions(self) -> Sequence[InputPartition]:
        tasks, room = [], 0
        for path, n, _ in self.sizes():
            if self.kind != "capital" and not self.wanted.place(*self.place(path)):
                continue
            first = 0
            while first < n:
                if not room:
                    tasks.append(Ranges([]))
                    room = self.share
                last = min(n, first + room)
                tasks[-1].parts.append((path, first, last))
                room -= last - first
                first = last
        return tasks or [Ranges([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, first, last in partition.parts:
            with store.opened(path) as file:
                layout, head = layout_of(self.kind, path), HEADS.get(self.kind, 0)
                if self.options.get("ordered", "false") == "true" and self.wanted.dated:
                    first, last = self.searched(file, layout, head, first, last)
                for at in range(first, last, BATCH_RECORDS):
                    n = min(BATCH_RECORDS, last - at)
                    yield self.batch(path, at, np.frombuffer(file.read_at(n * layout.itemsize, head + at * layout.itemsize), layout))

    def searched(self, file: pa.NativeFile, layout: np.dtype, head: int, first: int, last: int) -> tuple[int, int]:
        """The range of the wanted days among records in the order of time, by some twenty reads of one record."""

        def bound(day: int, after: bool) -> int:
            low, high = first, last
            while low < high:
                middle = (low + high) // 2
                days, good = dates_in(self.kind, np.frombuffer(file.read_at(layout.itemsize, head + middle * layout.itemsize), layout))
                if not good[0]:
                    raise ValueError("a record without a date in a file whose records are said to be in order")
                low, high = (middle + 1, high) if days[0] < day + after else (low, middle)
            return low

        return (first if self.wanted.first is None else bound(self.wanted.first, False)), (last if self.wanted.last is None else bound(self.wanted.last, True))

    def batch(self, path: str, at: int, r: np.ndarray) -> pa.RecordBatch:
        days, good = dates_in(self.kind, r)
        offsets = np.arange(at, at + len(r), dtype=np.int64)
        if self.wanted.dated:
            kept = good & self.wanted.days(days)
            r, days, good, offsets = r[kept], days[kept], good[kept], offsets[kept]
        market, symbol = self.place(path)
        columns = {"source_path": pa.array([path] * len(r), pa.string()), "row_offset": pa.array(offsets)}
        if self.kind == "capital":
            columns |= {"market": pa.array([{0: "sz", 1: "sh", 2: "bj"}.get(m) for m in r["market"].tolist()], pa.string()), "symbol": pa.array([c.decode("ascii", "replace").rstrip("\0 ")[-6:] for c in r["code"].tolist()], pa.string())}
        else:
            columns |= {"market": pa.array([market] * len(r), pa.string()), "symbol": pa.array([symbol] * len(r), pa.string())}
        columns["trade_date"] = pa.array(np.where(good, days, 0).astype(np.int32), mask=~good).cast(pa.date32())
        return pa.record_batch(columns | self.values(path, r))

    def values(self, path: str, r: np.ndarray) -> dict[str, pa.Array]:
        if self.kind == "metric":
            return {"metric_type": pa.array(r["metric_type"].astype(np.int64)), **{c: pa.array(r[c].astype(float)) for c in ("value1", "value2")}}
        if self.kind == "capital":
            return {"category": pa.array(r["category"].astype(np.int64)), **{c: pa.array(r[c].astype(float)) for c in "abcd"}}
        unit = records.HUNDREDTHS if self.kind == "day" or layout_of(self.kind, path) is records.MINUTE_INT else 1.0
        out = {"minute_of_day": pa.array(r["minute"].astype(np.int32))} if self.kind == "minute" else {}
        out |= {p: pa.array(r[p].astype(float) / unit) for p in records.PRICES}
        volume = pa.array(r["volume"].astype(np.int64))
        if self.kind == "ex_day":
            return out | {"amount": pa.array(r["amount"].astype(np.int64)), "price": pa.array(r["amount"].copy().view("<f4").astype(float)), "position": volume, "trade": volume, "settlement": pa.array(r["settlement"].astype(float))}
        return out | {"amount": pa.array(r["amount"].astype(float)), "volume": volume}


def _load(spark: SparkSession, path: str, kind: str, rows: str, **options: object) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordFiles)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    return spark.read.format("record_files").options(path=path, kind=kind, rows=rows, **given).load()


def record_rows(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    """All whole records below the path: source_path, row_offset, market, symbol, trade_date (null if it is none) and the kind's columns."""
    return _load(spark, path, kind, "records", **options)


def file_rows(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    """source_path, records and trailing_bytes of every file below the path."""
    return _load(spark, path, kind, "files", **options)


def checked_rows(spark: SparkSession, path: str, kind: str, **options: object) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): valid rows, of repeated keys the first; and what is wrong with records and files, as the readers of whole files have it."""
    found, issues = records.checked(record_rows(spark, path, kind, **options), KEYS[kind], kind)
    return found, issues.unionByName(records.file_issues(file_rows(spark, path, kind, **options), found))
