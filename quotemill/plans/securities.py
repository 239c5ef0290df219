"""Security lookup and scored search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.text import normalized

#: Scores of the four sources of a search.
SCORES = {"symbol": 100, "current_name": 90, "history_name": 80, "alias": 70}


def lookup(securities: DataFrame, market: str, symbol: str) -> DataFrame:
    return securities.filter((F.col("market") == market) & (F.col("symbol") == symbol))


def resolve(securities: DataFrame, history: DataFrame, aliases: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Candidates for a text: market, symbol, current_name, matched_by, matched, score; best first.

    A six-digit text matches symbols; any text matches names, former names and aliases that contain it once white space and
    case are dropped. Each source gives at most limit rows, exact matches first; a security keeps its best score.
    """
    text = query.strip()
    if not text:
        raise ValueError("a text to search for is needed")
    limit = 20 if limit <= 0 else min(limit, 100)
    norm = F.lit("".join(text.split()).lower())

    def source(rows: DataFrame, name: str, column: str, plain: str, order: list) -> DataFrame:
        best = rows.filter(F.contains(F.col(plain), norm)).orderBy((F.col(plain) == norm).desc(), *order).limit(limit)
        return best.select("market", "symbol", "current_name", F.lit(name).alias("matched_by"), F.col(column).alias("matched"), F.lit(SCORES[name]).alias("score"))

    names = securities.select("market", "symbol", "current_name")
    key = ["market", "symbol"]
    found = source(securities, "current_name", "current_name", "current_name_norm", ["current_name", *key])
    found = found.unionByName(source(history.join(names, key), "history_name", "name", "name_norm", [F.desc("valid_from"), "name", *key]))
    found = found.unionByName(source(aliases.join(names, key), "alias", "alias", "alias_norm", [F.desc("priority"), "alias", *key]))
    if len(text) == 6 and text.isascii() and text.isdigit():
        exact = names.filter(F.col("symbol") == text).orderBy("market").limit(limit)
        found = found.unionByName(exact.select("market", "symbol", "current_name", F.lit("symbol").alias("matched_by"), F.lit(text).alias("matched"), F.lit(SCORES["symbol"]).alias("score")))
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "matched")
    ranked = found.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return ranked.orderBy(F.desc("score"), *key).limit(limit)


def normalized_names(securities: DataFrame) -> DataFrame:
    """securities with current_name_norm from current_name."""
    return securities.withColumn("current_name_norm", normalized(F.col("current_name")))
