"""Review snapshots (one JSON file a day) and corrections (JSON lines) as typed rows and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.dates import clock_of_text
from quotemill.functions.text import infer_market, is_symbol, ordered_unique, relay_status

_STOCK = "code string, board_count int, reason_type string, theme_primary string, theme_tags array<string>, order_amount double, amount double, pct_chg double, first_limit_up_time string, last_limit_up_time string, turnover_rate double, open_num int, status string, market_value double"
_RELAYED = "code string, prev_board_count int, prev_first_limit_up_time string, prev_theme_primary string, prev_reason string, today_status string, today_board_count int, today_pct_chg double"
_THEME = "theme_name string, limit_up_count long, ladder_count long, broken_count long, limit_down_count long, leader_code string, leader_board_count int, strength_rank int"
_SUMMARY = "limit_up_count long, limit_down_count long, open_limit_count long, seal_success_rate double, max_board_height int, first_board_count long, continuous_board_count long, prev_limit_up_promotion_rate double, prev_ladder_promotion_rate double, big_noodle_count long, high_level_break_count long, strong_theme_count long"


def _typed(fields: str) -> str:
    return "struct<" + fields.replace(" ", ":").replace(",:", ",") + ">"


SNAPSHOT = (
    f"warnings array<string>, trade_date string, prev_trade_date string, summary {_typed(_SUMMARY)}, limit_up_pool array<{_typed(_STOCK)}>, broken array<{_typed(_STOCK)}>, "
    f"limit_down array<{_typed(_STOCK)}>, relay struct<trade_date:string,prev_trade_date:string,height_groups:array<struct<height:int,stocks:array<{_typed(_RELAYED)}>>>>, theme_overview array<{_typed(_THEME)}>"
)
POOLS = {"limit_up": "limit_up_pool", "open_limit": "broken", "limit_down": "limit_down"}


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Parsed snapshot files below the path (YYYY/MM/DD.json), evidence folders left out, with source_path and a file issue if any.

    A file whose date is not its path's, that lacks a required part, or whose days or rates are impossible has a file_issue.
    """
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    return parsed_snapshots(files.select(F.col("_metadata.file_path").alias("source_path"), "value"))


def parsed_snapshots(files: DataFrame) -> DataFrame:
    """As snapshots, of files as rows (source_path, value). A text that is no JSON object lacks all required parts."""
    rows = files.filter(~F.col("source_path").contains("/evidence/")).select("source_path", F.from_json("value", SNAPSHOT).alias("r")).select("source_path", "r.*")
    day, prev = F.try_to_date("trade_date", "yyyy-MM-dd"), F.try_to_date(F.nullif("prev_trade_date", F.lit("")), "yyyy-MM-dd")
    from_path = F.concat_ws("-", *[F.regexp_extract("source_path", r"([0-9]{4})/([0-9]{2})/([0-9]{2})\.json$", k) for k in (1, 2, 3)])
    required = [F.col(c).isNull() for c in ("summary", *POOLS.values())]
    rate = lambda c: F.col(f"summary.{c}").isNotNull() & ~F.col(f"summary.{c}").between(0, 1)
    relay_prev = F.nullif(F.col("relay.prev_trade_date"), F.lit(""))
    grouped = F.coalesce(F.size("relay.height_groups"), F.lit(0)) > 0
    issue = (
        F.when(required[0] | required[1] | required[2] | required[3], "missing_required_field")
        .when(day.isNull() | (F.col("trade_date") != from_path), "trade_date_mismatch")
        .when((F.coalesce("prev_trade_date", F.lit("")) != "") & prev.isNull(), "invalid_prev_trade_date")
        .when(prev >= day, "prev_trade_date_not_before")
        .when(rate("seal_success_rate") | rate("prev_limit_up_promotion_rate") | rate("prev_ladder_promotion_rate"), "invalid_rate")
        .when((F.coalesce("relay.trade_date", F.lit("")) != "") & (F.col("relay.trade_date") != F.col("trade_date")), "relay_date_mismatch")
        .when(relay_prev.isNotNull() & prev.isNotNull() & (F.try_to_date(relay_prev, "yyyy-MM-dd") != prev), "relay_prev_date_mismatch")
        .when(grouped & F.coalesce(F.try_to_date(relay_prev, "yyyy-MM-dd"), prev).isNull(), "relay_prev_date_missing")
    )
    return rows.withColumns({"day": day, "prev_day": prev, "relay_prev_day": F.coalesce(F.try_to_date(relay_prev, "yyyy-MM-dd"), prev), "file_issue": issue})


def _zero(c: Column) -> Column:
    return F.when(c != 0, c)


def without_placeholders(stock: Column, profile: str, no_turnover: Column) -> dict[str, Column]:
    """A stock's nullable numbers, zeros that a known writer puts for unknown turned to null: "historical-replay", "ths" or "" (none)."""
    amount, order, turnover, opened, status = (stock[c] for c in ("amount", "order_amount", "turnover_rate", "open_num", "status"))
    if profile == "historical-replay":
        order, turnover, opened = _zero(order), _zero(turnover), _zero(opened)
    elif profile == "ths":
        amount, order = _zero(amount), _zero(order)
        turnover = F.when(no_turnover | status.isin("broken", "limit_down"), _zero(turnover)).otherwise(turnover)
        opened = F.when(status == "limit_down", _zero(opened)).otherwise(opened)
    return {"amount": amount, "seal_order_amount": order, "turnover_rate": turnover, "open_count": opened}


def _unknown_time(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return ~text.isin("", "-") & clock_of_text(text).isNull()


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def events(rows: DataFrame, profile: str = "") -> DataFrame:
    """One row per stock of every pool of snapshots without a file issue; issue says why a row must be skipped, else null."""
    parts = []
    for kind, pool in POOLS.items():
        parts.append(rows.filter("file_issue is null").select("source_path", F.col("day").alias("trade_date"), F.lit(kind).alias("event_type"), F.array_contains(F.coalesce("warnings", F.array().cast("array<string>")), "missing_field:turnover_rate").alias("no_turnover"), F.explode(pool).alias("s")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    s = F.col("s")
    usual = F.when(F.col("event_type") == "limit_up", "sealed").when(F.col("event_type") == "open_limit", "broken").otherwise("limit_down")
    status = F.coalesce(F.nullif(_text(s["status"]), F.lit("")), usual)
    symbol, first, last = _text(s["code"]), clock_of_text(s["first_limit_up_time"]), clock_of_text(s["last_limit_up_time"])
    numbers = without_placeholders(s, profile, F.col("no_turnover"))
    negative = F.lit(False)
    for c in (numbers["seal_order_amount"], numbers["amount"], numbers["turnover_rate"], s["market_value"]):
        negative |= F.coalesce((c < 0) | F.isnan(c) | (c == float("inf")), F.lit(False))
    kind = F.col("event_type")
    issue = (
        F.when(~is_symbol(symbol), "invalid_symbol")
        .when(~status.isin("sealed", "broken", "broken_reseal", "limit_down"), "unsupported_status")
        .when((kind == "limit_up") & ((F.coalesce(s["board_count"], F.lit(0)) == 0) | ~status.isin("sealed", "broken_reseal")), "limit_up_needs_boards_and_seal")
        .when((kind == "limit_down") & (status != "limit_down"), "limit_down_status")
        .when((kind == "open_limit") & ~status.isin("broken", "broken_reseal", "limit_down"), "open_limit_status")
        .when(_unknown_time(s["first_limit_up_time"]) | _unknown_time(s["last_limit_up_time"]), "invalid_time")
        .when(first > last, "first_after_last")
        .when(negative, "negative_number")
    )
    tags = ordered_unique(F.coalesce(s["theme_tags"], F.array().cast("array<string>")))
    return every.select(
        "source_path",
        "trade_date",
        infer_market(symbol).alias("market"),
        symbol.alias("symbol"),
        "event_type",
        status.alias("close_status"),
        F.coalesce(s["board_count"], F.lit(0)).alias("board_count"),
        _text(s["reason_type"]).alias("reason_text"),
        _text(s["theme_primary"]).alias("theme_primary"),
        tags.alias("theme_tags"),
        first.alias("first_limit_minute"),
        last.alias("last_limit_minute"),
        *[c.alias(n) for n, c in numbers.items()],
        s["market_value"].alias("market_value"),
        issue.alias("issue"),
    )


def summaries(rows: DataFrame, stocks: DataFrame) -> DataFrame:
    """One row per day: the declared summary, and the limit-ups of 2, 3, 4 and at least 5 boards among the valid stocks."""
    boards, up = F.col("board_count"), F.col("event_type") == "limit_up"
    heights = stocks.filter("issue is null").groupBy("trade_date").agg(*[F.count_if(up & (boards == k if k < 5 else boards >= 5)).alias(f"{n}_board_count") for k, n in ((2, "two"), (3, "three"), (4, "four"), (5, "five_plus"))])
    days = rows.filter("file_issue is null").select(F.col("day").alias("trade_date"), F.col("prev_day").alias("prev_trade_date"), "summary.*")
    return days.join(heights, "trade_date", "left").na.fill(0, [c for c in heights.columns if c != "trade_date"])


def declared_counts(rows: DataFrame) -> DataFrame:
    """trade_date, event_type, declared: what the summaries say of their pools' sizes."""
    names = {"limit_up": "limit_up_count", "limit_down": "limit_down_count", "open_limit": "open_limit_count"}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("event_type"), F.col(f"summary.{c}").alias("declared")) for k, c in names.items()])).alias("d")
    return rows.filter("file_issue is null").select(F.col("day").alias("trade_date"), pairs).select("trade_date", "d.*")


def relay(rows: DataFrame, percent_scale: float = 1.0) -> DataFrame:
    """Relay samples: prev_limit_up, and prev_ladder from two boards. percent_scale is 100 for writers of ratios, never guessed."""
    stocks = rows.filter("file_issue is null").select("source_path", F.col("day").alias("trade_date"), F.col("relay_prev_day").alias("prev_trade_date"), F.explode("relay.height_groups").alias("g"))
    stocks = stocks.select("source_path", "trade_date", "prev_trade_date", F.explode("g.stocks").alias("s"))
    s = F.col("s")
    symbol, status, pct = _text(s["code"]), relay_status(s["today_status"]), s["today_pct_chg"] * percent_scale
    issue = (
        F.when(~is_symbol(symbol), "invalid_symbol")
        .when(_unknown_time(s["prev_first_limit_up_time"]), "invalid_time")
        .when(status.isNull(), "unsupported_status")
        .when(F.isnan(pct) | (F.abs(pct) > 1000), "invalid_pct_chg")
    )
    groups = F.array_compact(F.array(F.lit("prev_limit_up"), F.when(s["prev_board_count"] >= 2, "prev_ladder")))
    return stocks.select(
        "source_path",
        "trade_date",
        "prev_trade_date",
        infer_market(symbol).alias("market"),
        symbol.alias("symbol"),
        F.explode(groups).alias("sample_group"),
        F.coalesce(s["prev_board_count"], F.lit(0)).alias("prev_board_count"),
        _text(s["prev_reason"]).alias("prev_reason_text"),
        _text(s["prev_theme_primary"]).alias("prev_theme_primary"),
        clock_of_text(s["prev_first_limit_up_time"]).alias("prev_first_limit_minute"),
        status.alias("today_status"),
        F.coalesce(s["today_board_count"], F.lit(0)).alias("today_board_count"),
        pct.alias("today_pct_chg"),
        issue.alias("issue"),
    )


def themes(rows: DataFrame) -> DataFrame:
    """Theme rows; a leader that is no symbol is left empty, a row without a name has an issue."""
    found = rows.filter("file_issue is null").select("source_path", F.col("day").alias("trade_date"), F.explode("theme_overview").alias("t"))
    t = F.col("t")
    leader = _text(t["leader_code"])
    valid = is_symbol(leader)
    count = lambda c: F.coalesce(t[c], F.lit(0)).alias(c)
    return found.select("source_path", "trade_date", _text(t["theme_name"]).alias("theme_name"), *[count(c) for c in ("limit_up_count", "ladder_count", "broken_count", "limit_down_count")], F.when(valid, infer_market(leader)).otherwise("").alias("leader_market"), F.when(valid, leader).otherwise("").alias("leader_symbol"), count("leader_board_count"), count("strength_rank"), F.when(_text(t["theme_name"]) == "", "missing_theme_name").alias("issue"))


_CORRECTED = "code string, event_type string, close_status string, board_count int, reason_text string, reason_type string, theme_primary string, theme_tags array<string>, first_limit_minute string, last_limit_minute string, open_count int, seal_order_amount double, amount double, turnover_rate double, market_value double"
CORRECTION = f"trade_date string, mode string, reason string, audit_ref string, events array<{_typed(_CORRECTED)}>"
_FIELDS = [f.split()[0] for f in CORRECTION.split(", ")[:4]] + ["events"]
_EVENT_FIELDS = [f.split()[0] for f in _CORRECTED.split(", ")]


def corrections(lines: DataFrame, replace_facts: bool = False) -> DataFrame:
    """Corrected events of JSON lines (value), with mode, reason and audit_ref, and issue where a line or an event must be refused.

    Unknown fields are refused. The mode is enrich_existing, or, if facts may be replaced, upsert. Blank lines are skipped.
    """
    text = lines.filter(F.trim("value") != "").select("value", F.from_json("value", CORRECTION).alias("c"))
    events_json = F.from_json(F.get_json_object("value", "$.events"), "array<string>")
    unknown = F.size(F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.array(*map(F.lit, _FIELDS)))) > 0
    inner = F.exists(F.coalesce(events_json, F.array().cast("array<string>")), lambda e: F.size(F.array_except(F.coalesce(F.json_object_keys(e), F.array().cast("array<string>")), F.array(*map(F.lit, _EVENT_FIELDS)))) > 0)
    day = F.try_to_date("c.trade_date", "yyyy-MM-dd")
    modes = ("enrich_existing", "upsert") if replace_facts else ("enrich_existing",)
    line_issue = (
        F.when(F.json_object_keys("value").isNull(), "invalid_json")
        .when(unknown | inner, "unknown_field")
        .when(~F.coalesce(F.col("c.mode").isin(*modes), F.lit(False)), "mode_not_allowed")
        .when((_text(F.col("c.reason")) == "") | (_text(F.col("c.audit_ref")) == ""), "reason_and_audit_ref_required")
        .when(day.isNull(), "invalid_trade_date")
    )
    # a select of its own: beside the explode, a line would be copied, and checked, for each of its events
    checked = text.select(day.alias("trade_date"), "c.mode", "c.reason", "c.audit_ref", line_issue.alias("line_issue"), F.col("c.events").alias("events"))
    rows = checked.select("trade_date", "mode", "reason", "audit_ref", "line_issue", F.explode_outer("events").alias("e"))
    e = F.col("e")
    symbol = _text(e["code"])
    reason = F.coalesce(F.nullif(_text(e["reason_text"]), F.lit("")), _text(e["reason_type"]))
    issue = F.coalesce("line_issue", F.when(e.isNull(), "no_events").when(~is_symbol(symbol), "invalid_symbol").when(~F.coalesce(e["event_type"].isin(*POOLS), F.lit(False)), "unsupported_event_type"))
    return rows.select(
        "trade_date",
        "mode",
        "reason",
        "audit_ref",
        infer_market(symbol).alias("market"),
        symbol.alias("symbol"),
        e["event_type"].alias("event_type"),
        e["close_status"].alias("close_status"),
        e["board_count"].alias("board_count"),
        reason.alias("reason_text"),
        _text(e["theme_primary"]).alias("theme_primary"),
        ordered_unique(F.coalesce(e["theme_tags"], F.array().cast("array<string>"))).alias("theme_tags"),
        clock_of_text(e["first_limit_minute"]).alias("first_limit_minute"),
        clock_of_text(e["last_limit_minute"]).alias("last_limit_minute"),
        *[e[c].alias(c) for c in ("open_count", "seal_order_amount", "amount", "turnover_rate", "market_value")],
        issue.alias("issue"),
    )


def normalized_rows(files: DataFrame, field: str, row_schema: str) -> DataFrame:
    """Rows of JSON texts (value) that are either an array of rows or an object holding that array under the field, with an issue.

    A text that is no JSON, or holds no such array, gives one row of nulls with the issue invalid_file; rows have the issue null.
    """
    array = f"array<{_typed(row_schema)}>"
    text = F.trim("value")
    inner = F.when(F.substring(text, 1, 1) == "[", text).otherwise(F.get_json_object(text, f"$.{field}"))
    rows = F.from_json(inner, array)
    bad = rows.isNull() | (F.json_array_length(inner).isNull())
    marked = files.select(F.when(bad, F.lit("invalid_file")).alias("issue"), F.explode_outer(F.when(~bad, rows)).alias("r"))
    return marked.filter("r is not null or issue is not null").select("r.*", "issue")
