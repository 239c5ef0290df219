"""Queries over tables that are laid out for their reads: trigram index, Merkle snapshots, rank directory, bucketed bars with factor intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators import merkle, ranks, trigrams
from quotemill.plans import adapters as views
from quotemill.plans import intervals, securities
from quotemill.plans.registry import query, same_as
from quotemill.session import shared_path

KEYWORDS = ("ai+50%_", "reason", "n a", "0%", "x", "no such words")
_KEYWORDS = ", ".join(f"('{k}')" for k in KEYWORDS)


@query(f"select k as keyword, trade_date, event_type, market, symbol from limit_events, (values {_KEYWORDS}) v(k) where contains(lower(reason_text), k)")
def search_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose reason contains each of several keywords, some common, some rare, some too short for the index, by an inverted index of trigrams."""
    path, key = shared_path(spark, "trigrams"), list(views.EVENT_KEY)
    trigrams.build(views.limit_events(spark, sf_dir), key, F.lower("reason_text"), path)
    found = [trigrams.search(spark, path, k).select(F.lit(k).alias("keyword"), "trade_date", "event_type", "market", "symbol") for k in KEYWORDS]
    return reduce(DataFrame.unionByName, found)


@same_as("security_resolve")
def security_resolve_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored search for a text, of names, former names and aliases that an index of trigrams finds."""
    text = "Customer #0000"
    norm = "".join(text.split()).lower()

    def found(rows: DataFrame, key: list[str], column: str) -> DataFrame:
        path = shared_path(spark, f"trigrams-{column}")
        trigrams.build(rows, key, F.col(column), path)
        return trigrams.search(spark, path, norm)

    key = ["market", "symbol"]
    everything = views.securities(spark, sf_dir)
    history, aliases = views.security_name_history(spark, sf_dir), views.security_aliases(spark, sf_dir)
    names = found(everything, key, "current_name_norm")
    former, other = found(history, history.columns, "name_norm"), found(aliases, aliases.columns, "alias_norm")
    current = everything.join(former.select(*key).union(other.select(*key)).union(names.select(*key)).distinct(), key, "left_semi")
    return securities.resolve(current, former, other, text, 20)


_OLD = "select market, symbol, board, current_name from securities"
_NEW = "select market, symbol, board, case when cast(symbol as int) % 89 = 3 then current_name || '!' else current_name end as current_name from securities where cast(symbol as int) % 97 <> 5 union all select 'bj', '999999', 'x', 'new'"


@query(f"select *, 'added' as change from (({_NEW}) except all ({_OLD})) union all select *, 'removed' from (({_OLD}) except all ({_NEW}))")
def merkle_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot of securities gained and lost against an older one, from the ranges whose digests differ."""
    n = F.col("symbol").cast("int")
    rows = views.securities(spark, sf_dir).select("market", "symbol", "board", "current_name")
    renamed = F.when(n % 89 == 3, F.concat("current_name", F.lit("!"))).otherwise(F.col("current_name")).alias("current_name")
    new = rows.filter(n % 97 != 5).select("market", "symbol", "board", renamed).unionByName(spark.range(1).select(F.lit("bj").alias("market"), F.lit("999999").alias("symbol"), F.lit("x").alias("board"), F.lit("new").alias("current_name")))
    old_path, new_path = shared_path(spark, "merkle-old"), shared_path(spark, "merkle-new")
    merkle.snapshot(rows, ["market", "symbol"], old_path, 2)
    merkle.snapshot(new, ["market", "symbol"], new_path, 2)
    return merkle.difference(spark, old_path, new_path)


@query("select *, (select count(*) from bars_1d) as total from (select row_number() over (order by trade_date desc, market, symbol) - 1 as rank, market, symbol, trade_date, close from bars_1d) where rank between 0 and 99 or rank between (select count(*) // 2 from bars_1d) and (select count(*) // 2 + 1499 from bars_1d)")
def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the bars, newest first, and one deep in the middle, with the total, by a rank directory."""
    path = shared_path(spark, "ranks")
    ranks.build(views.bars_1d(spark, sf_dir).select("market", "symbol", "trade_date", "close"), [F.desc("trade_date"), "market", "symbol"], path, 1000)
    total = ranks.total(spark, path)
    pages = ranks.page(spark, path, 100, 0).unionByName(ranks.page(spark, path, 1500, total // 2)).distinct()
    return pages.withColumn("total", F.lit(total))


@same_as("bars_1m_qfq")
def bars_1m_qfq_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars adjusted by validity intervals; the bars, in buckets of instruments, are not moved."""
    found = intervals.factor_intervals(views.ebars_1d(spark, sf_dir), views.exdxr_events(spark, sf_dir))
    rows = intervals.bucketed(views.ebars_1m(spark, sf_dir), shared_path(spark, "bars-1m"), ["trade_date", "minute_of_day"])
    out = intervals.adjusted(rows, found, "qfq")
    return out.withColumns({c: F.round(c, 6) for c in intervals.PRICES} | {"factor": F.round("factor", 8)})
