"""Text tables: manifests, dictionaries, the security master, provider payloads, and HTML board pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.dates import date_of_text
from quotemill.functions.text import alias_list, is_market, is_symbol, normalized

MANIFEST = "filename string, md5 string, size long"
METRICS = "metric_type int, name string, title string, value1_meaning string, value2_meaning string, status string, source_ref string"
ITEMS = "item_id int, name string, title string, category string, unit string, value_kind string, status string, source_ref string"


class DictionaryError(ValueError):
    """A dictionary file breaks its contract."""


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """filename, md5 (lower case), size of a comma-separated manifest."""
    return manifest_lines(spark.read.text(path))


def manifest_lines(lines: DataFrame) -> DataFrame:
    """As manifest, of its lines (value)."""
    rows = lines.filter(F.trim("value") != "").select(F.from_csv("value", MANIFEST).alias("r")).select("r.*")
    return rows.withColumn("md5", F.lower(F.trim("md5"))).filter("filename is not null")


def manifest_mismatches(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files (filename, content) that the manifest lacks, lists with another size or digest, or lists without their being there."""
    own = files.select("filename", F.md5("content").alias("found_md5"), F.octet_length("content").cast("long").alias("found_size"))
    both = own.join(listed, "filename", "full_outer")
    reason = (
        F.when(F.col("found_md5").isNull(), "file_missing")
        .when(F.col("md5").isNull(), "not_listed")
        .when(F.col("found_size") != F.col("size"), "size_mismatch")
        .when(F.col("found_md5") != F.col("md5"), "md5_mismatch")
    )
    return both.withColumn("reason", reason).filter("reason is not null").select("filename", "reason")


def unshadowed(entries: DataFrame) -> DataFrame:
    """Archive entries (entry) without inner archives that a plain .dat of the same name stands for."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(F.split("entry", "!")[0], "/"), -1), r"\.(zip|dat)$", ""))
    rows = entries.withColumn("_stem", stem).withColumn("_nested", F.col("entry").contains("!"))
    direct = rows.filter("not _nested").select("source_path", "_stem").distinct()
    nested = rows.filter("_nested").join(direct, ["source_path", "_stem"], "left_anti")
    return rows.filter("not _nested").unionByName(nested.select(rows.columns)).drop("_stem", "_nested")


def dictionary(spark: SparkSession, path: str, schema: str, key: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """A dictionary CSV with exactly the schema's header, unique keys, and only allowed values in the given columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    header = spark.read.text(path).first()
    if header is None or header[0].lstrip("﻿").strip().split(",") != names:
        raise DictionaryError(f"the header must be {','.join(names)}")
    rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").csv(path)
    bad = F.col(key).isNull()
    for column, values in allowed.items():
        bad |= ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    found = rows.agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"), F.count_distinct(key).alias("keys")).first()
    if found["bad"] or found["n"] != found["keys"]:
        raise DictionaryError(f"{found['bad']} invalid rows, {found['n'] - found['keys']} repeated keys")
    return rows


#: Fixed names of statuses in security lists.
STATUS = {"": "active", "active": "active", "listed": "active", "上市": "active", "suspended": "suspended", "停牌": "suspended", "delisted": "delisted", "退市": "delisted"}


def security_master(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(securities, aliases, rejected) of a CSV with a header; the name column is current_name or name, aliases are a list."""
    rows = spark.read.option("header", "true").csv(path)
    text = lambda c, other="": F.trim(F.coalesce(F.col(c) if c in rows.columns else F.lit(None), F.col(other) if other in rows.columns else F.lit(None), F.lit("")))
    symbol, market, name = text("symbol"), F.lower(text("market")), text("current_name", "name")
    status = F.lower(text("status"))
    full = rows.select(
        market.alias("market"),
        symbol.alias("symbol"),
        name.alias("current_name"),
        normalized(name).alias("current_name_norm"),
        text("exchange").alias("exchange"),
        text("board").alias("board"),
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), status), status).alias("status"),
        date_of_text(text("listing_date")).alias("listing_date"),
        date_of_text(text("delisting_date")).alias("delisting_date"),
        F.coalesce(text("lot_size").try_cast("int"), F.lit(100)).alias("lot_size"),
        F.coalesce(text("price_precision").try_cast("int"), F.lit(2)).alias("price_precision"),
        text("source").alias("source"),
        alias_list(text("aliases")).alias("aliases"),
    )
    valid = is_market(F.col("market")) & is_symbol(F.col("symbol")) & (F.col("current_name") != "")
    aliases = full.filter(valid).select("market", "symbol", F.explode("aliases").alias("alias"))
    return full.filter(valid).drop("aliases"), aliases.withColumn("alias_norm", normalized(F.col("alias"))), full.filter(~valid)


def best_aliases(aliases: DataFrame) -> DataFrame:
    """Per security, type and normalised alias the one of highest priority, the first by position on ties."""
    best = F.max_by(F.struct("alias", "priority", "position"), F.struct("priority", (-F.col("position")).alias("p"))).alias("best")
    return aliases.groupBy("market", "symbol", "alias_type", "alias_norm").agg(best).select("market", "symbol", "alias_type", "alias_norm", "best.*")


_KLINE = ("trade_date", "open", "close", "high", "low", "volume", "amount")


def kline_payloads(payloads: DataFrame) -> DataFrame:
    """Bars of payloads (value) whose data.klines are comma-joined texts in the order date, open, close, high, low, volume, amount."""
    lines = F.from_json(F.get_json_object("value", "$.data.klines"), "array<string>")
    rows = payloads.select(F.get_json_object("value", "$.data.code").alias("code"), F.explode(lines).alias("line")).withColumn("p", F.split("line", ","))
    number = lambda k: F.try_element_at("p", F.lit(k)).try_cast("double")
    return rows.select("code", F.try_to_date(F.try_element_at("p", F.lit(1)), "yyyy-MM-dd").alias("trade_date"), *[number(k).alias(n) for k, n in enumerate(_KLINE[1:], 2)])


def jsonp_years(payloads: DataFrame) -> DataFrame:
    """Bars of a year's payload (value): a call around an object whose data are ;-joined days of comma-joined values."""
    inner = F.regexp_extract("value", r"(?s)^[^(]*\((.*)\)\s*;?\s*$", 1)
    days = F.explode(F.filter(F.split(F.get_json_object(inner, "$.data"), ";"), lambda x: F.trim(x) != ""))
    rows = payloads.select(days.alias("day")).withColumn("p", F.split("day", ","))
    number = lambda k: F.try_element_at("p", F.lit(k)).try_cast("double")
    return rows.select(F.try_to_date(F.try_element_at("p", F.lit(1)), "yyyyMMdd").alias("trade_date"), *[number(k).alias(n) for k, n in enumerate(("open", "high", "low", "close", "volume", "amount"), 2)])


#: Fixed values that must match: the unit of a provider's volumes; amounts are in one currency, days those of one time zone.
VOLUME_UNITS = {"tdx": "hand", "eastmoney": "provider_native", "ths": "provider_native"}
AMOUNT_UNIT, TIMEZONE = "CNY", "Asia/Shanghai"


def labelled_bars(bars: DataFrame, provider: str) -> DataFrame:
    """Bars with the provider, its volume_unit, the amount_unit and the timezone; a provider whose unit is not known is an error."""
    if provider not in VOLUME_UNITS:
        raise ValueError(f"no volume unit for provider {provider}")
    return bars.withColumns({"provider": F.lit(provider), "volume_unit": F.lit(VOLUME_UNITS[provider]), "amount_unit": F.lit(AMOUNT_UNIT), "timezone": F.lit(TIMEZONE)})


def checked_bars(bars: DataFrame, key: list[str], keep: Column) -> DataFrame:
    """Provider bars, equal ones once, in the range; all rows are validated before the range is taken.

    A row with a null or impossible value, or two differing rows of a key, is an error of the plan: no bars come out.
    """
    from quotemill.operators.latest import without_conflicts
    from quotemill.sources.records import consistent

    good = F.col("trade_date").isNotNull() & F.coalesce(consistent(bars), F.lit(False))
    named = F.to_json(F.struct(*bars.columns))
    checked = bars.withColumn("close", F.when(good, F.col("close")).otherwise(F.raise_error(F.concat(F.lit("invalid bar "), named)).cast("double")))
    return without_conflicts(checked, key).withColumn("_keep", keep).filter("_keep").drop("_keep")


class _Links(HTMLParser):
    """Links inside the first element of a class."""

    def __init__(self, kind: str):
        super().__init__(convert_charrefs=True)
        self.kind, self.depth, self.link, self.found = kind, 0, None, []

    def handle_starttag(self, tag: str, attributes: list) -> None:
        a = dict(attributes)
        if self.depth or self.kind in (a.get("class") or "").split():
            self.depth += tag == "div" or not self.depth
            if self.depth and tag == "a":
                self.link = [a.get("href") or "", ""]

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.link:
            self.found.append((self.link[0], " ".join(self.link[1].split())))
            self.link = None
        if tag == "div" and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.link:
            self.link[1] += data


def page_links(pages: DataFrame, kind: str) -> DataFrame:
    """page_id, position, href, name of the links within the div of a class: the entries of a board catalogue page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                parser = _Links(kind)
                parser.feed(html or "")
                rows += [(page, k, href, name) for k, (href, name) in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["page_id", "position", "href", "name"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, position long, href string, name string")
