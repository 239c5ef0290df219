"""Dates and times as vendors write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_of_number(c: Column) -> Column:
    """Date of a number yyyymmdd; null if there is none such, or before 1900."""
    found = F.try_to_date(F.lpad(c.cast("string"), 8, "0"), "yyyyMMdd")
    return F.when(F.year(found) >= 1900, found)


def date_of_text(c: Column) -> Column:
    """Date of yyyy-mm-dd or yyyymmdd."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "yyyyMMdd"))


def packed_minute(date: Column, minute: Column) -> Column:
    """Struct (trade_date, minute_of_day) of the two packed 16-bit numbers of minute files: years from 2004 in 2048ths, then mmdd."""
    day = date % 2048
    text = F.concat(F.lpad((F.floor(date / 2048) + 2004).cast("string"), 4, "0"), F.lpad(day.cast("string"), 4, "0"))
    return F.struct(F.try_to_date(text, "yyyyMMdd").alias("trade_date"), F.when(minute.between(0, 24 * 60 - 1), minute).alias("minute_of_day"))


def clock_of_text(c: Column) -> Column:
    """HH:MM of HH:MM, HH:MM:SS or HHMMSS; null for -, the empty text and anything else."""
    text = F.trim(c)
    hour = F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2})(?::[0-9]{2})?$", 1)
    minute = F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2})(?::[0-9]{2})?$", 2)
    packed = text.rlike("^[0-9]{6}$")
    h = F.when(packed, F.substring(text, 1, 2)).otherwise(F.nullif(hour, F.lit("")))
    m = F.when(packed, F.substring(text, 3, 2)).otherwise(F.nullif(minute, F.lit("")))
    return F.when((h.cast("int") < 24) & (m.cast("int") < 60), F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))


def clock_of_seconds(c: Column, day: Column) -> Column:
    """HH:MM in Shanghai of Unix seconds, null unless on the day."""
    at = F.from_utc_timestamp(F.timestamp_seconds(c), "Asia/Shanghai")
    return F.when(F.to_date(at) == day, F.date_format(at, "HH:mm"))


def minute_label(index: Column, afternoon: int = 120) -> Column:
    """Minute of the day of the index-th trading minute, from 9:30, the afternoon from 13:00. The tick chart's afternoon starts at 121."""
    return F.when(index < afternoon, 570 + index).otherwise(780 + index - afternoon)


def vendor_time(c: Column) -> Column:
    """H:MM:SS.mmm of the vendor's quote time: hours before the last six digits. Those are mm and a fraction of a minute, or, if mm
    is no minute, a fraction of the hour."""
    hour, rest = F.floor(c / 1_000_000), c % 1_000_000
    plain = rest < 600_000
    minute = F.when(plain, F.floor(rest / 10_000)).otherwise(F.floor(rest * 60 / 1_000_000))
    second = F.when(plain, (rest % 10_000) * 60 / 10_000).otherwise((rest * 60 % 1_000_000) * 60 / 1_000_000)
    return F.format_string("%d:%02d:%06.3f", hour, minute, second.cast("double"))


def calendar(since: Column, until: Column) -> Column:
    """All calendar days of a range, as an array."""
    return F.sequence(since, until)


def partition_year(c: Column) -> Column:
    return F.year(c)


def partition_month(c: Column) -> Column:
    return F.date_format(c, "yyyyMM")
