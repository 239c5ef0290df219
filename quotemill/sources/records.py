"""Readers of the vendors' packed record files.

Files are read with Spark's binaryFile source, one row per file, and decoded with numpy inside tasks: one structured dtype per
format. Rows carry their file and their offset in it (source_path, row_offset), so that validation, range filters and the
first-wins rule for repeated keys are DataFrame operations over all files at once.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.dates import date_of_number, packed_minute
from quotemill.functions.text import market_and_symbol
from quotemill.operators.latest import first_with_issues

#: Fixed record layouts, little-endian.
DAY = np.dtype([("date", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<u4"), ("reserved", "<u4")])
MINUTE_FLOAT = np.dtype([("date", "<u2"), ("minute", "<u2"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("amount", "<f4"), ("volume", "<u4"), ("reserved", "<u4")])
MINUTE_INT = np.dtype([("date", "<u2"), ("minute", "<u2"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<u4"), ("reserved", "<u4")])
EX_DAY = np.dtype([("date", "<u4"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("amount", "<u4"), ("volume", "<u4"), ("settlement", "<f4")])
CAPITAL = np.dtype([("market", "u1"), ("code", "S7"), ("date", "<u4"), ("category", "u1"), ("a", "<f4"), ("b", "<f4"), ("c", "<f4"), ("d", "<f4")])
METRIC = np.dtype([("metric_type", "u1"), ("date", "<u4"), ("value1", "<f4"), ("value2", "<f4")])
#: Bytes and rows of archive members that a task holds before it hands them on.
BATCH_BYTES, BATCH_ROWS = 32 << 20, 1000
SIX_DIGITS = re.compile("[0-9]{6}")
#: Prices in integer formats are hundredths.
HUNDREDTHS = 100.0

Decoded = dict[str, np.ndarray | list]


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of every file below the path whose name matches."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.col("path").alias("source_path"), "content")


def entries(archives: DataFrame, suffixes: tuple[str, ...] = (), most_bytes: int = 64 << 20) -> DataFrame:
    """source_path, entry, content of every member of ZIP archives, inner archives included; members beyond the bound raise."""

    def members(data: bytes, prefix: str) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in sorted(archive.infolist(), key=lambda i: i.filename):
                if info.is_dir():
                    continue
                if info.file_size > most_bytes:
                    raise ValueError(f"{prefix}{info.filename} has {info.file_size} bytes")
                content = archive.read(info)
                if info.filename.lower().endswith(".zip"):
                    yield from members(content, f"{prefix}{info.filename}!")
                elif not suffixes or info.filename.lower().endswith(suffixes):
                    yield prefix + info.filename, content

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for batch in batches:
            for path, content in zip(batch["source_path"], batch["content"], strict=True):
                for name, data in members(content, ""):
                    found.append((path, name, data))
                    held += len(data)
                    if held >= BATCH_BYTES or len(found) >= BATCH_ROWS:
                        yield pd.DataFrame(found, columns=["source_path", "entry", "content"])
                        found, held = [], 0
        yield pd.DataFrame(found, columns=["source_path", "entry", "content"])

    return archives.select("source_path", "content").mapInPandas(run, "source_path string, entry string, content binary")


def as_files(members: DataFrame) -> DataFrame:
    """Archive members in the form of files, their path the archive's with the entry's behind it."""
    return members.select(F.concat_ws("!/", "source_path", "entry").alias("source_path"), "content")


def decoded(rows: DataFrame, decode: Callable[[bytes], Decoded], schema: str) -> DataFrame:
    """All records of the files in rows (source_path, content): source_path, row_offset and the schema's columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, held = [], 0
            for path, content in zip(batch["source_path"], batch["content"], strict=True):
                columns = pd.DataFrame(decode(content))
                if len(columns):
                    found.append(columns.assign(source_path=path, row_offset=range(len(columns)))[["source_path", "row_offset", *columns.columns]])
                    held += len(content)
                if held >= BATCH_BYTES:
                    yield pd.concat(found, ignore_index=True)
                    found, held = [], 0
            if found:
                yield pd.concat(found, ignore_index=True)

    return rows.select("source_path", "content").mapInPandas(run, f"source_path string, row_offset long, {schema}")


def whole(content: bytes, layout: np.dtype) -> np.ndarray:
    """The whole records of a file; bytes left over are an issue of the file."""
    return np.frombuffer(content, layout, len(content) // layout.itemsize)


def sizes(rows: DataFrame, width: int) -> DataFrame:
    """source_path, records and trailing_bytes of files (source_path, content) of records so many bytes wide."""
    n = F.octet_length("content").cast("long")
    return rows.select("source_path", F.floor(n / width).alias("records"), (n % width).alias("trailing_bytes"))


def file_issues(files: DataFrame, valid: DataFrame) -> DataFrame:
    """What is wrong with whole files (source_path, records, trailing_bytes): bytes after the last whole record, at whose place the issue is, and files without a valid row."""
    cut = files.filter("trailing_bytes > 0").select("source_path", F.col("records").alias("row_offset"), F.lit("incomplete_trailing_bytes").alias("issue_type"))
    empty = files.select("source_path").join(valid.select("source_path").distinct(), "source_path", "left_anti")
    return cut.unionByName(empty.select("source_path", F.lit(None).cast("long").alias("row_offset"), F.lit("zero_valid_rows").alias("issue_type")))


PRICES = ("open", "high", "low", "close")
_BAR = "open double, high double, low double, close double, amount double, volume long"


def _bar(r: np.ndarray, unit: float) -> Decoded:
    return {p: r[p].astype(float) / unit for p in PRICES} | {"amount": r["amount"].astype(float), "volume": r["volume"].astype(np.int64)}


def decode_day(content: bytes) -> Decoded:
    r = whole(content, DAY)
    return {"date": r["date"].astype(np.int64)} | _bar(r, HUNDREDTHS)


def decode_minute(content: bytes, integer_prices: bool) -> Decoded:
    r = whole(content, MINUTE_INT if integer_prices else MINUTE_FLOAT)
    return {"date": r["date"].astype(np.int64), "minute": r["minute"].astype(np.int64)} | _bar(r, HUNDREDTHS if integer_prices else 1.0)


def day_bars(rows: DataFrame, market: str = "", symbol: str = "") -> tuple[DataFrame, DataFrame]:
    """(bars, issues) of .day files: invalid dates, a high below the low, repeated keys, cut files and files without a bar become issues; of repeated keys the first row stays."""
    raw = decoded(rows, decode_day, f"date long, {_BAR}")
    keyed = raw.withColumn("_key", market_and_symbol(F.col("source_path"), market, symbol)).select("source_path", "row_offset", "_key.*", date_of_number(F.col("date")).alias("trade_date"), *PRICES, "amount", "volume")
    return _whole_files(rows, DAY, *checked(keyed, ["market", "symbol", "trade_date"], "day"))


def minute_bars(rows: DataFrame, market: str = "", symbol: str = "") -> tuple[DataFrame, DataFrame]:
    """(bars, issues) of minute files; the extension says whether prices are floats (lc1, lc5) or hundredths (1, 5)."""
    parts = []
    for integer in (False, True):
        own = rows.filter(F.lower("source_path").rlike(r"\.[15]$" if integer else r"\.lc[15]$"))
        parts.append(decoded(own, lambda c, i=integer: decode_minute(c, i), f"date long, minute long, {_BAR}"))
    raw = parts[0].unionByName(parts[1])
    at = packed_minute(F.col("date"), F.col("minute"))
    keyed = raw.withColumn("_key", market_and_symbol(F.col("source_path"), market, symbol)).withColumn("_at", at)
    keyed = keyed.select("source_path", "row_offset", "_key.*", F.when(F.col("_at.minute_of_day").isNotNull(), F.col("_at.trade_date")).alias("trade_date"), "_at.minute_of_day", *PRICES, "amount", "volume")
    named = rows.filter(F.lower("source_path").rlike(r"\.(lc)?[15]$"))
    return _whole_files(named, MINUTE_INT, *checked(keyed, ["market", "symbol", "trade_date", "minute_of_day"], "minute"))


def _whole_files(rows: DataFrame, layout: np.dtype, valid: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    return valid, issues.unionByName(file_issues(sizes(rows, layout.itemsize), valid))


def checked(rows: DataFrame, key: list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of records with source_path, row_offset and trade_date: those without a date, bars whose high is below the low, and repeats of a key go.

    Metrics are not compared: each repeat of a key is a duplicate, whatever its values.
    """
    wrong = F.when(F.col("trade_date").isNull(), "invalid_time" if kind == "minute" else "invalid_date")
    if kind == "capital":
        wrong = F.when(F.col("market").isNull(), "unsupported_market").when(~F.coalesce(F.col("symbol").rlike("^[0-9]{6}$"), F.lit(False)), "unsupported_symbol").when(F.col("trade_date").isNull(), "invalid_date")
    if kind in ("day", "minute", "ex_day"):
        wrong = wrong.when(~F.isnan("low") & (F.col("high") < F.col("low")), "high_less_than_low")
    marked = rows.withColumn("_wrong", wrong)
    invalid = marked.filter("_wrong is not null").select("source_path", "row_offset", F.col("_wrong").alias("issue_type"))
    values, compare = marked.filter("_wrong is null").drop("_wrong"), kind != "metric"
    order = values.withColumn("_order", F.struct("source_path", "row_offset")).drop("source_path", "row_offset")
    first, repeated = first_with_issues(order, key, "_order", compare)
    repeated = repeated.select("_order.source_path", "_order.row_offset", "issue_type")
    return first.select("*", "_order.*").drop("_order"), invalid.unionByName(repeated)


def ex_day_bars(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, issues) of extension-market day files named market#code.day. One field is read twice, as the amount and as a float
    price; position and trade both hold the volume."""

    def decode(content: bytes) -> Decoded:
        r = whole(content, EX_DAY)
        volume = r["volume"].astype(np.int64)
        prices = {p: r[p].astype(float) for p in PRICES}
        twice = r["amount"].copy().view("<f4").astype(float)
        return {"date": r["date"].astype(np.int64)} | prices | {"amount": r["amount"].astype(np.int64), "price": twice, "position": volume, "trade": volume, "settlement": r["settlement"].astype(float)}

    raw = decoded(rows, decode, "date long, open double, high double, low double, close double, amount long, price double, position long, trade long, settlement double")
    name = F.element_at(F.split("source_path", "/"), -1)
    keyed = raw.select("source_path", "row_offset", F.regexp_extract(name, r"^([0-9]+)#", 1).cast("int").alias("ex_market"), F.upper(F.regexp_extract(name, r"#([^.]+)\.", 1)).alias("code"), date_of_number(F.col("date")).alias("trade_date"), *PRICES, "amount", "price", "position", "trade", "settlement")
    return _whole_files(rows, EX_DAY, *checked(keyed, ["ex_market", "code", "trade_date"], "ex_day"))


def capital_changes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, issues) of capital-change files: a count, then records. Category 1 holds cash, price, bonus, allotment; others share counts."""

    def decode(content: bytes) -> Decoded:
        n = min(int.from_bytes(content[:4], "little"), max(0, len(content) - 4) // CAPITAL.itemsize)
        r = np.frombuffer(content[4:], CAPITAL, n)
        text = [c.decode("ascii", "replace").rstrip("\0 ")[-6:] for c in r["code"].tolist()]
        return {"market_no": r["market"].astype(np.int64), "symbol": text, "date": r["date"].astype(np.int64), "category": r["category"].astype(np.int64)} | {k: r[k].astype(float) for k in "abcd"}

    raw = decoded(rows, decode, "market_no long, symbol string, date long, category long, a double, b double, c double, d double")
    market = F.when(F.col("market_no") == 0, "sz").when(F.col("market_no") == 1, "sh").when(F.col("market_no") == 2, "bj")
    ex_rights = F.col("category") == 1
    value = lambda c, own: F.when(ex_rights if own else ~ex_rights, F.col(c))
    named = raw.select(
        "source_path",
        "row_offset",
        market.alias("market"),
        "symbol",
        date_of_number(F.col("date")).alias("trade_date"),
        "category",
        *[value(c, True).alias(n) for c, n in zip("abcd", ("fenhong", "peigujia", "songzhuangu", "peigu"), strict=True)],
        *[value(c, False).alias(n) for c, n in zip("abcd", ("panqianliutong", "qianzongguben", "panhouliutong", "houzongguben"), strict=True)],
    )
    events, issues = checked(named, ["market", "symbol", "trade_date", "category"], "capital")
    count = F.conv(F.hex(F.reverse(F.substring("content", 1, 4))), 16, 10).cast("long")
    size = F.octet_length("content").cast("long")
    there = F.floor((size - 4) / CAPITAL.itemsize)
    file = rows.select("source_path", size.alias("size"), F.least(count, there).alias("records"), (count > there).alias("short"))
    sized = file.filter("size >= 4").select("source_path", "records", "short", (F.col("size") - 4 - F.col("records") * CAPITAL.itemsize).alias("trailing_bytes"))
    short = file.filter("size < 4").select("source_path", F.lit(0).cast("long").alias("row_offset"), F.lit("file_too_short").alias("issue_type"))
    cut = sized.filter("short").select("source_path", F.col("records").alias("row_offset"), F.lit("incomplete_trailing_bytes").alias("issue_type"))
    empty = file_issues(sized, events)
    return events.withColumnRenamed("trade_date", "event_date"), issues.unionByName(short).unionByName(cut).unionByName(empty)


def metric_values(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, issues) of metric files; repeated keys are warnings whatever their values."""

    def decode(content: bytes) -> Decoded:
        r = whole(content, METRIC)
        return {"metric_type": r["metric_type"].astype(np.int64), "date": r["date"].astype(np.int64), "value1": r["value1"].astype(float), "value2": r["value2"].astype(float)}

    raw = decoded(rows, decode, "metric_type long, date long, value1 double, value2 double")
    keyed = raw.withColumn("_key", market_and_symbol(F.col("source_path"))).select("source_path", "row_offset", "_key.*", "metric_type", date_of_number(F.col("date")).alias("trade_date"), "value1", "value2")
    values, issues = _whole_files(rows, METRIC, *checked(keyed, ["market", "symbol", "metric_type", "trade_date"], "metric"))
    return values.withColumnRenamed("trade_date", "event_date"), issues


#: Header of a report file: date at 2, records at 6, bytes of a record's vector at 12; then an index of (code 6, flag 1, offset 4).
REPORT_HEADER, REPORT_INDEX = 20, np.dtype([("code", "S6"), ("flag", "S1"), ("offset", "<u4")])


def report_values(rows: DataFrame, known_items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, issues) of report files of offset-addressed vectors: long rows (source_path, report_date, market, symbol, item_id from 1, value).

    A file without a whole header or index, without records or with vectors of no whole number of floats gives an issue of the file and no rows; a vector
    outside the file, a symbol that is not six digits, a repeated symbol and, where item ids are given, an item that is not among them give one each.
    A file without a valid date keeps its rows, with an issue. Items not known stay too.
    """

    def decode(content: bytes) -> Decoded:
        def only(issue: str, date: int = -1) -> Decoded:
            return {"date": [date], "symbol": [""], "issue": [issue], "items": [[]]}

        if len(content) < REPORT_HEADER:
            return only("file_too_short")
        date, n, size = int.from_bytes(content[2:6], "little"), int.from_bytes(content[6:8], "little"), int.from_bytes(content[12:16], "little")
        end = REPORT_HEADER + n * REPORT_INDEX.itemsize
        wrong = "zero_valid_rows" if not n else "unsupported_record_size" if not size or size % 4 else "incomplete_trailing_bytes" if len(content) < end else ""
        if wrong:
            return only(wrong, date)
        index = np.frombuffer(content, REPORT_INDEX, n, REPORT_HEADER)
        symbols = [c.decode("ascii", "replace").rstrip("\0 ") for c in index["code"].tolist()]
        places = index["offset"].tolist()
        issues = ["unsupported_symbol" if not SIX_DIGITS.fullmatch(s) else "incomplete_trailing_bytes" if o < end or o + size > len(content) else "" for s, o in zip(symbols, places, strict=True)]
        vectors = [[] if i else np.frombuffer(content, "<f4", size // 4, o).astype(float).tolist() for i, o in zip(issues, places, strict=True)]
        return {"date": np.full(n, date, np.int64), "symbol": symbols, "issue": issues, "items": vectors}

    from quotemill.functions.text import infer_market

    raw = decoded(rows, decode, "date long, symbol string, issue string, items array<double>").withColumn("report_date", date_of_number(F.col("date")))
    wrong = raw.filter("issue <> ''").select("source_path", F.when(F.col("symbol") != "", F.col("row_offset")).alias("row_offset"), F.col("issue").alias("issue_type"))
    sound = raw.filter("issue = ''").select("source_path", "row_offset", "symbol", "report_date", "items")
    first, repeated = first_with_issues(sound, ["source_path", "symbol"], "row_offset", compare=False)
    undated = raw.filter("date >= 0 and report_date is null").select("source_path", F.lit(None).cast("long").alias("row_offset"), F.lit("invalid_date").alias("issue_type")).distinct()
    without = raw.groupBy("source_path").agg(F.max(F.size("items")).alias("most"), F.bool_or(F.col("issue") == "zero_valid_rows").alias("told"), F.bool_or(F.col("symbol") != "").alias("records"))
    nothing = without.filter("most = 0 and not told and records").select("source_path", F.lit(None).cast("long").alias("row_offset"), F.lit("zero_valid_rows").alias("issue_type"))
    issues = wrong.unionByName(repeated.select("source_path", "row_offset", "issue_type")).unionByName(undated).unionByName(nothing)
    if known_items is not None:
        ids = without.filter("most > 0").select("source_path", F.explode(F.sequence(F.lit(1), "most")).alias("item_id"))
        unknown = ids.join(known_items.select(F.col("item_id").cast("int").alias("item_id")).distinct(), "item_id", "left_anti")
        issues = issues.unionByName(unknown.select("source_path", F.col("item_id").cast("long").alias("row_offset"), F.lit("unknown_dictionary_id").alias("issue_type")))
    long = first.select("source_path", "symbol", "report_date", F.posexplode("items").alias("_at", "value"))
    items = long.select("source_path", "report_date", infer_market(F.col("symbol")).alias("market"), "symbol", (F.col("_at") + 1).alias("item_id"), "value")
    return items, issues


def report_items(rows: DataFrame) -> DataFrame:
    """The items of report files alone."""
    return report_values(rows)[0]


#: A block file: header, number of blocks, then per block name, members, type and a fixed area of member codes.
BLOCK_HEADER, BLOCK_NAME, BLOCK_AREA, BLOCK_CODE = 384, 9, 2800, 7


def vendor_text(raw: bytes) -> str:
    """Text up to the first zero byte in GB 18030; empty if that is not valid."""
    try:
        found = raw.split(b"\0")[0].decode("gb18030").strip()
    except UnicodeDecodeError:
        return ""
    return "" if "�" in found else found


def block_members(rows: DataFrame) -> DataFrame:
    """source_path, block_id, block_name, block_type, member_order, symbol of block files."""

    def decode(content: bytes) -> Decoded:
        at, out = BLOCK_HEADER, []
        number = int.from_bytes(content[at : at + 2], "little")
        at += 2
        for block in range(number):
            name = vendor_text(content[at : at + BLOCK_NAME])
            members = int.from_bytes(content[at + 9 : at + 11], "little")
            kind = int.from_bytes(content[at + 11 : at + 13], "little")
            area = content[at + 13 : at + 13 + BLOCK_AREA]
            if len(area) < BLOCK_AREA or members * BLOCK_CODE > BLOCK_AREA:
                raise ValueError(f"block {block} is cut off")
            out += [(block, name, kind, k, area[k * 7 : k * 7 + 7].decode("ascii", "replace").strip("\0 ")) for k in range(members)]
            at += 13 + BLOCK_AREA
        return dict(zip(("block_no", "block_name", "block_type", "member_order", "symbol"), (list(c) for c in zip(*out, strict=True)) if out else [[]] * 5, strict=True))

    raw = decoded(rows, decode, "block_no long, block_name string, block_type long, member_order long, symbol string")
    from quotemill.functions.text import slug

    return raw.select("source_path", "block_no", slug(F.col("block_name")).alias("block_id"), "block_name", "block_type", "member_order", "symbol").filter(F.col("symbol") != "")


#: A custom-block catalogue: records of a name and an id, whose members are the lines of a file named by the id.
CUSTOM_NAME, CUSTOM_ID = 50, 70


def custom_blocks(rows: DataFrame) -> DataFrame:
    """block_id, block_name, member_order, market, symbol of catalogue files (blocknew.cfg) and their .blk files of lines such as 1600000.

    The line's first digit is the market: 0 sz, 1 sh, 2 bj. A member counts once, where it comes first; files without a catalogue
    entry are left out.
    """

    def decode(content: bytes) -> Decoded:
        size = CUSTOM_NAME + CUSTOM_ID
        parts = [content[k : k + size] for k in range(0, len(content) - size + 1, size)]
        return {"block_name": [vendor_text(p[:CUSTOM_NAME]) for p in parts], "block_id": [vendor_text(p[CUSTOM_NAME:]) for p in parts]}

    name = F.lower(F.element_at(F.split("source_path", "/"), -1))
    listed = decoded(rows.filter(name == "blocknew.cfg"), decode, "block_name string, block_id string").filter("block_id <> ''")
    lines = rows.filter(name.endswith(".blk")).select(F.regexp_replace(name, r"\.blk$", "").alias("_id"), F.posexplode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("member_order", "line"))
    line = F.trim("line")
    market = F.when(line.startswith("0"), "sz").when(line.startswith("1"), "sh").when(line.startswith("2"), "bj")
    members = lines.filter(line.rlike("^[012][0-9]{6}$")).select("_id", "member_order", market.alias("market"), F.substring(line, 2, 6).alias("symbol"))
    first = members.groupBy("_id", "market", "symbol").agg(F.min("member_order").alias("member_order"))
    return listed.select("block_name", "block_id", F.lower("block_id").alias("_id")).join(first, "_id").drop("_id")


#: A day package: fixed-length codes and bars paired by position.
PACK_CODE, PACK_BAR = 150, np.dtype({"names": ["open", "high", "low", "close", "volume", "amount"], "formats": ["<f8"] * 4 + ["<u8", "<f8"], "offsets": [12, 20, 28, 36, 56, 72], "itemsize": 512})


def package_bars(members: DataFrame) -> DataFrame:
    """market, symbol, trade_date, prices, volume, amount of day packages' entries (entry, content) named like shYYMMDD.cod and .md1.

    Both entries of a pair must hold the same number of records. Volumes beyond a signed 64-bit number are null.
    """
    name = F.lower(F.element_at(F.split("entry", "/"), -1))
    parts = members.select("source_path", F.substring(name, 1, 2).alias("market"), F.regexp_extract(name, r"([0-9]{6})", 1).alias("day"), F.regexp_extract(name, r"\.([a-z0-9]+)$", 1).alias("kind"), "content")
    pairs = parts.groupBy("source_path", "market", "day").agg(F.max(F.when(F.col("kind") == "cod", F.col("content"))).alias("codes"), F.max(F.when(F.col("kind") == "md1", F.col("content"))).alias("bars"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples():
                codes = [row.codes[k : k + 6].decode("ascii", "replace") for k in range(0, len(row.codes), PACK_CODE)]
                bars = whole(row.bars, PACK_BAR)
                if len(codes) != len(bars):
                    raise ValueError(f"{row.market}{row.day}: {len(codes)} codes and {len(bars)} bars")
                volume = pd.array([v if v < 1 << 63 else None for v in bars["volume"].tolist()], "Int64")
                found.append(pd.DataFrame({"market": row.market, "day": row.day, "symbol": codes} | {p: bars[p] for p in PRICES} | {"volume": volume, "amount": bars["amount"]}))
            if found:
                yield pd.concat(found, ignore_index=True)

    raw = pairs.mapInPandas(run, "market string, day string, symbol string, open double, high double, low double, close double, volume long, amount double")
    return raw.select("market", "symbol", F.try_to_date(F.concat(F.lit("20"), "day"), "yyyyMMdd").alias("trade_date"), *PRICES, "volume", "amount")


def is_share(market: F.Column, symbol: F.Column) -> F.Column:
    """Whether an instrument of a day package is an A share, by market and the symbol's first digits."""
    main = F.substring(symbol, 1, 3).isin("000", "001", "002", "003", "300", "301")
    return F.when(market == "sh", symbol.startswith("6")).when(market == "sz", main).when(market == "bj", symbol.startswith("920")).otherwise(False)


def no_trade(rows: DataFrame) -> F.Column:
    """A bar of a day without trade: all zero but the close."""
    idle = (F.col("close") >= 0) & (F.col("close") < float("inf"))
    for c in ("open", "high", "low", "volume", "amount"):
        idle &= F.col(c) == 0
    return idle


def consistent(rows: DataFrame) -> F.Column:
    """Finite, non-negative prices with low at most and high at least all others."""
    found = F.lit(True)
    for p in PRICES:
        found &= ~F.isnan(p) & (F.abs(p) < float("inf")) & (F.col(p) >= 0)
    return found & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
