"""Text functions: normalisation, instrument codes, lists and status names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(c: Column) -> Column:
    """Without any Unicode white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def infer_market(symbol: Column) -> Column:
    """Market of a six-digit symbol: 920, 8 and 4 are bj, 6 and 9 sh, all others sz."""
    return F.when(symbol.startswith("920") | F.substring(symbol, 1, 1).isin("8", "4"), "bj").when(F.substring(symbol, 1, 1).isin("6", "9"), "sh").otherwise("sz")


def is_symbol(c: Column) -> Column:
    return c.rlike("^[0-9]{6}$")


def is_market(c: Column) -> Column:
    return c.isin("sh", "sz", "bj")


def market_and_symbol(path: Column, market: str = "", symbol: str = "") -> Column:
    """Struct of both from a path such as .../sh600000.day; given values win, else the market is inferred from the symbol."""
    name = F.lower(F.element_at(F.split(path, "[/\\\\]"), -1))
    found_market = F.nullif(F.regexp_extract(name, r"^(sh|sz|bj)[#_]?[0-9]{6}", 1), F.lit(""))
    found_symbol = F.nullif(F.regexp_extract(name, r"([0-9]{6})", 1), F.lit(""))
    s = F.lit(symbol) if symbol else found_symbol
    return F.struct((F.lit(market) if market else F.coalesce(found_market, infer_market(s))).alias("market"), s.alias("symbol"))


def alias_list(c: Column) -> Column:
    """Parts between |, ; and commas, trimmed, without empty ones, first of equal ones kept."""
    return ordered_unique(F.split(c, "[|;,]"))


def ordered_unique(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def symbol_market(c: Column) -> Column:
    """Struct of symbol and market of a code written symbol:market."""
    parts = F.split(F.trim(c), ":")
    return F.struct(F.trim(parts[0]).alias("symbol"), F.lower(F.trim(F.try_element_at(parts, F.lit(2)))).alias("market"))


def slug(c: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("-")), F.lit("/"), F.lit("-"))


def mapped(c: Column, names: dict[str, str], otherwise: Column | None = None) -> Column:
    """The name for a value, else otherwise (null)."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    found = F.try_element_at(table, c)
    return found if otherwise is None else F.coalesce(found, otherwise)


#: Fixed names of the relay status codes, as sources write them.
RELAY_STATUS = {
    "连板": "promoted",
    "promoted": "promoted",
    "平板": "sealed",
    "sealed": "sealed",
    "断板": "broken",
    "broken": "broken",
    "炸板": "open_limit",
    "open_limit": "open_limit",
    "跌停": "limit_down",
    "limit_down": "limit_down",
    "停牌": "suspended",
    "suspended": "suspended",
    "": "unknown",
    "未知": "unknown",
    "unknown": "unknown",
}


def relay_status(c: Column) -> Column:
    """One of seven codes; null for a name that is not known, which callers must reject."""
    return mapped(F.trim(F.coalesce(c, F.lit(""))), RELAY_STATUS)
