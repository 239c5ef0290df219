"""Landed frames of fixed records (extension markets, funds, finance, instruments) and of quotes, as rows.

A frame of fixed records is a head with the number of records at a place, then the records: one numpy layout each. Quotes mix
fixed and varying numbers, so a small loop splits them; what their numbers mean is left to columns.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.dates import date_of_number, minute_label, packed_minute, vendor_time
from quotemill.sources.records import PRICES, vendor_text
from quotemill.sources.wire import MINUTE_CATEGORIES, RECORDS_HELD, FrameError, _numbers, _take, frame_records, trade_nature, vendor_float

_OHLC = [(p, "<f4") for p in PRICES]
#: Fixed record layouts, little-endian. The time is a packed date and minute, or a date number in the same four bytes.
EX_BAR = np.dtype([("day", "<u2"), ("minute", "<u2"), *_OHLC, ("position", "<u4"), ("trade", "<u4"), ("price", "<f4")])
EX_RANGE_BAR = np.dtype([("day", "<u2"), ("minute", "<u2"), *_OHLC, ("position", "<u4"), ("trade", "<u4"), ("settlement", "<f4")])
FUND_BAR = np.dtype([("day", "<u2"), ("minute", "<u2"), *_OHLC, ("amount", "<f4"), ("volume", "<u4"), ("rest", "<u4")])
EX_POINT = np.dtype([("minute", "<u2"), ("price", "<f4"), ("average", "<f4"), ("volume", "<u4"), ("open_interest", "<u4")])
EX_TRADE = np.dtype([("minute", "<u2"), ("price", "<u4"), ("volume", "<u4"), ("change", "<i4"), ("nature", "<u2")])
INSTRUMENT = np.dtype([("category", "u1"), ("market", "u1"), ("rest", "S3"), ("code", "S9"), ("name", "S17"), ("description", "S9"), ("tail", "S24")])
FUND_ITEM = np.dtype([("item_id", "<u4"), ("values", "<u2", (6,))])
#: Where the number of records stands, and where they begin.
EX_POINT_HEAD, EX_OLD_POINT_HEAD, EX_TRADE_HEAD = (10, 12), (18, 20), (14, 16)
EX_BAR_HEAD, EX_RANGE_HEAD, FUND_BAR_HEAD, INSTRUMENT_HEAD, FUND_ITEM_HEAD = (18, 20), (12, 14), (40, 42), (4, 6), (36, 38)

#: A finance frame: market and symbol at 2, then from 9 these numbers. All floats but the last two and the holders count in ten thousands.
FINANCE_AT, FINANCE_BYTES, TEN_THOUSAND = 9, 145, 10_000.0
FINANCE_FLOATS = (
    "zongguben", "guojiagu", "faqirenfarengu", "farengu", "bgu", "hgu", "zhigonggu", "zongzichan", "liudongzichan", "gudingzichan", "wuxingzichan", "gudongrenshu", "liudongfuzhai", "changqifuzhai", "zibengongjijin", "jingzichan",
    "zhuyingshouru", "zhuyinglirun", "yingshouzhangkuan", "yingyelirun", "touzishouyi", "jingyingxianjin", "zongxianjin", "cunhuo", "lirunzonge", "shuihoulirun", "jinglirun", "weifenpeilirun", "meigujingzichan", "baoliu2",
)
PLAIN = ("gudongrenshu", "meigujingzichan", "baoliu2")
FINANCE = np.dtype([("liutongguben", "<f4"), ("province", "<u2"), ("industry", "<u2"), ("updated_date", "<u4"), ("ipo_date", "<u4"), *[(n, "<f4") for n in FINANCE_FLOATS]])

#: Fixed names and scale of the items of a fund's details.
FUND_ITEMS, FUND_SCALE = {7: "unit_net_value", 11: "accumulated_net_value"}, 10_000


def head_and_records(body: bytes, layout: np.dtype, head: tuple[int, int]) -> np.ndarray:
    count_at, first = head
    if len(body) < first:
        raise FrameError(f"{len(body)} bytes are less than the head")
    n = int.from_bytes(body[count_at : count_at + 2], "little")
    if len(body) < first + n * layout.itemsize:
        raise FrameError(f"{len(body)} bytes do not hold {n} records")
    return np.frombuffer(body, layout, n, first)


def fixed_records(frames: DataFrame, layout: np.dtype, head: tuple[int, int], fields: str) -> DataFrame:
    """frame_id, record_no and the fields, named as in the layout, of all records; texts are decoded."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, held = [], 0
            for frame, body in zip(batch["frame_id"], batch["body"], strict=True):
                r = head_and_records(body, layout, head)
                columns = {n: [vendor_text(x) for x in r[n].tolist()] if layout[n].kind == "S" else r[n].tolist() if layout[n].shape else r[n].astype(float if layout[n].kind == "f" else np.int64) for n in names}
                found.append(pd.DataFrame({"frame_id": frame, "record_no": range(len(r))} | columns))
                held += len(r)
                if held >= RECORDS_HELD:
                    yield pd.concat(found, ignore_index=True)
                    found, held = [], 0
            if found:
                yield pd.concat(found, ignore_index=True)

    return frames.select("frame_id", "body").mapInPandas(run, f"frame_id long, record_no long, {fields}")


_BAR = "day long, minute long, open double, high double, low double, close double"


def _placed(raw: DataFrame, minutes: bool, *columns: str | Column) -> DataFrame:
    number = F.col("minute") * 65_536 + F.col("day")
    at = packed_minute(F.col("day"), F.col("minute")) if minutes else F.struct(date_of_number(number).alias("trade_date"), F.lit(None).cast("long").alias("minute_of_day"))
    return raw.withColumn("_at", at).select("frame_id", "record_no", "_at.*", *PRICES, *columns)


def ex_bars(frames: DataFrame, category: int) -> DataFrame:
    """Extension-market bars: time, prices, position, trade, price, and amount, the position's bytes read as a float."""
    raw = fixed_records(frames, EX_BAR, EX_BAR_HEAD, f"{_BAR}, position long, trade long, price double")
    return _placed(raw, category in MINUTE_CATEGORIES, "position", "trade", "price", float_of_bits(F.col("position")).alias("amount"))


def ex_range_bars(frames: DataFrame) -> DataFrame:
    """Extension-market minute bars of a range of days: time, prices, position, trade, settlement."""
    return _placed(fixed_records(frames, EX_RANGE_BAR, EX_RANGE_HEAD, f"{_BAR}, position long, trade long, settlement double"), True, "position", "trade", "settlement")


def ex_points(frames: DataFrame, history: bool = False) -> DataFrame:
    """Extension-market minute points: minute_of_day, price, average, volume, open_interest; frames of past days have a longer head."""
    raw = fixed_records(frames, EX_POINT, EX_OLD_POINT_HEAD if history else EX_POINT_HEAD, "minute long, price double, average double, volume long, open_interest long")
    return raw.withColumnRenamed("minute", "minute_of_day")


def ex_trades(frames: DataFrame, market: int) -> DataFrame:
    """Extension-market trades of a market: minute_of_day, second, price, volume, change of open interest, the trade's name and direction."""
    raw = fixed_records(frames, EX_TRADE, EX_TRADE_HEAD, "minute long, price long, volume long, change long, nature long")
    named = raw.withColumn("n", trade_nature(F.lit(market), F.col("volume"), F.col("change"), F.col("nature")))
    return named.select("frame_id", "record_no", F.col("minute").alias("minute_of_day"), "n.second", "price", "volume", "change", "n.name", "n.direction")


def tick_chart(frames: DataFrame, start: int = 0) -> DataFrame:
    """Tick chart points: point_index, minute_of_day, price, average, volume.

    A price is relative to the first one before it that is not zero, an average likewise, in hundredths and ten thousandths.
    """

    def decode(body: bytes) -> Iterator[tuple]:
        (n,), at = _take("<H2x", body, 0)
        for _ in range(n):
            values, at = _numbers(body, at, 3)
            yield tuple(values)

    raw = frame_records(frames, decode, "price long, average long, volume long")
    before = Window.partitionBy("frame_id").orderBy("record_no").rowsBetween(Window.unboundedPreceding, -1)
    value = lambda c: F.col(c) + F.coalesce(F.first(F.nullif(F.col(c), F.lit(0)), True).over(before), F.lit(0))
    index = F.col("record_no") + start
    return raw.select("frame_id", index.alias("point_index"), minute_label(index, 121).alias("minute_of_day"), (value("price") / 100.0).alias("price"), (value("average") / 10_000.0).alias("average"), "volume")


def fund_bars(frames: DataFrame, minutes: bool) -> DataFrame:
    """Fund bars: time, prices, amount, volume."""
    return _placed(fixed_records(frames, FUND_BAR, FUND_BAR_HEAD, f"{_BAR}, amount double, volume long"), minutes, "amount", "volume")


def instruments(frames: DataFrame) -> DataFrame:
    """category, market, code, name, description of the extension markets' instruments."""
    return fixed_records(frames, INSTRUMENT, INSTRUMENT_HEAD, "category long, market long, code string, name string, description string")


def fund_details(frames: DataFrame) -> DataFrame:
    """item_id, its six raw values, and for the items of known meaning their name and value."""
    raw = fixed_records(frames, FUND_ITEM, FUND_ITEM_HEAD, "item_id long, values array<long>")
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in FUND_ITEMS.items() for x in kv]), F.col("item_id").cast("int"))
    return raw.withColumn("name", name).withColumn("value", F.when(F.col("name").isNotNull(), F.get("values", F.lit(0)) / FUND_SCALE))


def float_of_bits(bits: Column) -> Column:
    """The single-precision number of 32 bits: sign, exponent and fraction put together; null for infinities and what is no number."""
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(0xFF), bits.bitwiseAND(0x7FFFFF)
    size = F.when(exponent == 0, fraction * F.lit(2.0**-149)).when(exponent < 255, (1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), exponent - 127))
    return F.when(bits >= 1 << 31, -size).otherwise(size)


def finance(frames: DataFrame) -> DataFrame:
    """market, symbol and the fields of finance frames, one each: dates as dates, sums in units."""
    names = [n for n in FINANCE.names if n not in ("province", "industry", "updated_date", "ipo_date")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for frame, body in zip(batch["frame_id"], batch["body"], strict=True):
                if len(body) < FINANCE_BYTES:
                    raise FrameError(f"{len(body)} bytes")
                r = np.frombuffer(body, FINANCE, 1, FINANCE_AT)[0]
                rows.append((frame, body[2], vendor_text(body[3:9]), *(r[n].item() for n in FINANCE.names)))
            yield pd.DataFrame(rows, columns=["frame_id", "market_no", "symbol", *FINANCE.names])

    fields = ", ".join(f"{n} {'double' if n in names else 'long'}" for n in FINANCE.names)
    raw = frames.select("frame_id", "body").mapInPandas(run, f"frame_id long, market_no long, symbol string, {fields}")
    sums = [(F.col(n) if n in PLAIN else F.col(n) * TEN_THOUSAND).alias(n) for n in names]
    return raw.select("frame_id", market_name(F.col("market_no")).alias("market"), "symbol", "province", "industry", date_of_number(F.col("updated_date")).alias("updated_date"), date_of_number(F.col("ipo_date")).alias("ipo_date"), *sums)


def market_name(number: Column) -> Column:
    return F.when(number == 0, "sz").when(number == 1, "sh").when(number == 2, "bj")


#: What a quote holds, in order: names of varying numbers; a struct layout stands for fixed bytes. Names with a dash are not kept.
_TOP = ("price", "last_close", "open", "high", "low", "server_time", "-", "volume", "current_volume")
QUOTE = ("<B6sH", *_TOP, "<I", "sell_volume", "buy_volume", "-", "-", *[f"{side}{what}{k}" for k in range(1, 6) for what, side in (("", "bid"), ("", "ask"), ("_volume", "bid"), ("_volume", "ask"))], "<H", "-", "-", "-", "-", "<HH")
COMPACT = ("<B6sH", *_TOP, "<f", "sell_volume", "buy_volume", "-", "-", "bid1", "ask1", "bid_volume1", "ask_volume1", "<56s")


def quotes(frames: DataFrame, compact: bool = False) -> DataFrame:
    """market, symbol, prices, server_time, volumes, amount, bids and asks (arrays of price and volume) of quote frames.

    All prices but the first are differences from it, in hundredths. Compact quotes have one level and a plain amount, and in
    their last 56 bytes the speed of the rise, the turnover of some minutes, and ratios.
    """
    steps = COMPACT if compact else QUOTE
    levels = 1 if compact else 5
    kept = [n for n in steps if n[0] not in "<-"]

    def decode(body: bytes) -> Iterator[tuple]:
        (n,), at = _take("<H", body, 2)
        for _ in range(n):
            fixed, numbers = [], {}
            for step in steps:
                if step[0] == "<":
                    values, at = _take(step, body, at)
                    fixed.append(values)
                else:
                    (numbers[step],), at = _numbers(body, at, 1)
            (market, code, _), (amount,), tail = fixed[0], fixed[1], fixed[2]
            rest = struct.unpack_from("<2xhhf12xff", tail[0]) if compact else (None,) * 5
            yield market, vendor_text(code), float(amount) if compact else vendor_float(amount), *rest, *(numbers[k] for k in kept)

    extra = ("rise_speed", "short_turnover", "two_minute_amount", "volume_ratio", "depth")
    raw = frame_records(frames, decode, f"market_no long, symbol string, amount double, {', '.join(f'{x} double' for x in extra)}, {', '.join(f'{k} long' for k in kept)}")
    price = lambda c: ((F.col("price") + F.col(c)) / 100.0).alias(c)
    side = lambda s: F.array(*[F.struct(((F.col("price") + F.col(f"{s}{k}")) / 100.0).alias("price"), F.col(f"{s}_volume{k}").alias("volume")) for k in range(1, levels + 1)])
    shown = raw.select("frame_id", "record_no", market_name(F.col("market_no")).alias("market"), "symbol", (F.col("price") / 100.0).alias("price"), *map(price, ("last_close", "open", "high", "low")), vendor_time(F.col("server_time")).alias("server_time"), "volume", "current_volume", "amount", "sell_volume", "buy_volume", side("bid").alias("bids"), side("ask").alias("asks"), *([(F.col(x) / (100.0 if k < 2 else 1.0)).alias(x) for k, x in enumerate(extra)] if compact else []))
    return shown


def seat_records(texts: DataFrame) -> DataFrame:
    """Broker seats of texts (text_id, value): text_id, record_no, trade_date, info_type, change_pct, volume, amount, side, seat_no, name, buy, sell.

    Lines are rows: a heading opens a record, a caption a side; a seat whose amounts stand on the next line, without a name, gets
    them from there. What a line belongs to is the last heading or caption above it, by windows over the text's lines.
    """
    lines = texts.select("text_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    line = F.col("line")
    cell = r"│(.+)│\s*([-0-9.]+)│\s*([-0-9.]+)│"
    part = lambda pattern, k: F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))
    head, facts = r"●交易日期:([0-9]{4}-[0-9]{2}-[0-9]{2})\s+信息类型:(.+)", r"涨跌幅\(%\):([-0-9.]+)\s+成交量\(万股\):([0-9.]+)\s+成交额\(万元\):([0-9.]+)"
    above = Window.partitionBy("text_id").orderBy("line_no")
    of_record = Window.partitionBy("text_id", "record_no")
    within = of_record.orderBy("line_no")
    opens, caption = part(head, 1).isNotNull(), F.when(line.contains("买入前五"), "buy").when(line.contains("卖出前五"), "sell")
    rows = lines.withColumn("record_no", F.sum(opens.cast("int")).over(above)).filter("record_no > 0")
    rows = rows.select("text_id", "record_no", "line_no", line, F.last(caption, True).over(within).alias("side"), caption.isNotNull().alias("is_caption"), *[F.first(part(p, k), True).over(of_record).alias(n) for p, k, n in ((head, 1, "day"), (head, 2, "info"), (facts, 1, "change"), (facts, 2, "volume"), (facts, 3, "amount"))])
    title = line.contains("营业部名称") | line.contains("金额") | line.rlike("[┌└├]|────")
    seats = rows.filter(~F.col("is_caption") & ~title & line.rlike(cell) & F.col("side").isNotNull())
    number = lambda k: F.coalesce(F.regexp_extract(line, cell, k).try_cast("double"), F.lit(0.0))
    seats = seats.withColumns({"own": F.trim(F.regexp_extract(line, cell, 1)), "buy": number(2), "sell": number(3)})
    before = Window.partitionBy("text_id", "record_no", "side").orderBy("line_no")
    waits = (F.col("own") != "") & (F.col("buy") == 0) & (F.col("sell") == 0)
    name = F.when(F.col("own") != "", F.col("own")).when(F.lag(waits).over(before), F.lag("own").over(before))
    seats = seats.withColumn("name", name).filter(F.col("name").isNotNull() & ((F.col("buy") != 0) | (F.col("sell") != 0)))
    return seats.select("text_id", "record_no", F.col("day").cast("date").alias("trade_date"), F.trim("info").alias("info_type"), F.col("change").try_cast("double").alias("change_pct"), F.col("volume").try_cast("double").alias("volume"), F.col("amount").try_cast("double").alias("amount"), "side", F.row_number().over(before).alias("seat_no"), "name", "buy", "sell")
