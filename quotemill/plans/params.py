"""Checked parameters of the read queries; everything wrong raises before a Spark job starts."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, replace


class InvalidQueryError(ValueError):
    """A parameter is out of its range, or does not go with the others."""


MARKETS = ("sh", "sz", "bj")
PERIODS = ("1d", "1m", "5m")
ADJUSTMENTS = ("none", "qfq", "hfq")
EVENT_TYPES = ("limit_up", "open_limit", "limit_down")
SAMPLE_GROUPS = ("prev_limit_up", "prev_ladder", "prev_broken", "prev_limit_down")
INDEX_CODES = ("prev_limit_up_perf", "prev_non_st_limit_up_perf", "prev_ladder_perf", "prev_limit_down_perf")
#: Most calendar days of a query whose rows are rebuilt.
REBUILT_DAYS = 93
#: Which dataset kinds take which filter.
APPLIES = {
    "market": ("events", "relay", "matrix"),
    "symbol": ("events", "relay", "matrix"),
    "event_type": ("events", "matrix"),
    "sample_group": ("relay",),
    "index_code": ("indices",),
    "theme": ("events", "themes", "relay", "matrix"),
    "reason_keyword": ("events",),
}


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidQueryError(message)


def iso_date(text: str, layouts: tuple[str, ...] = ("%Y-%m-%d",)) -> dt.date:
    for layout in layouts:
        try:
            return dt.datetime.strptime(text, layout).date()
        except ValueError:
            continue
    raise InvalidQueryError(f"invalid date {text!r}")


def moment(text: str) -> tuple[dt.datetime, bool]:
    """(time, whether the text is a date only)."""
    for layout in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S%z"):
        try:
            return dt.datetime.strptime(text, layout), layout == "%Y-%m-%d"
        except ValueError:
            continue
    raise InvalidQueryError(f"invalid time {text!r}")


def until_bound(text: str) -> tuple[dt.datetime, str]:
    """Upper bound of a time column: a date only means before the next day, a time means up to and with it."""
    at, date_only = moment(text)
    return (at + dt.timedelta(days=1), "<") if date_only else (at, "<=")


def _instrument(market: str, symbol: str) -> None:
    _need(market in MARKETS, "market must be sh, sz or bj")
    _need(re.fullmatch("[0-9]{6}", symbol) is not None, "symbol must be six digits")


@dataclass(frozen=True)
class BarQuery:
    market: str
    symbol: str
    period: str = "1d"
    adjust: str = "none"
    since: str = ""
    until: str = ""
    limit: int = 0

    def checked(self) -> BarQuery:
        q = replace(self, market=self.market.strip().lower(), symbol=self.symbol.strip(), period=self.period.strip().lower() or "1d", adjust=self.adjust.strip().lower() or "none", since=self.since.strip(), until=self.until.strip())
        q = replace(q, limit=q.limit if q.limit > 0 else 1000)
        _need(q.limit <= 10_000, "limit must be at most 10000")
        _instrument(q.market, q.symbol)
        _need(q.period in PERIODS, "period must be 1d, 1m or 5m")
        _need(q.adjust in ADJUSTMENTS, "adjust must be none, qfq or hfq")
        return q

    @property
    def bounded(self) -> bool:
        return bool(self.since or self.until)


@dataclass(frozen=True)
class PointQuery:
    market: str
    symbol: str
    date: str = ""
    since: str = ""
    until: str = ""
    limit: int = 0

    def checked(self) -> PointQuery:
        q = replace(self, market=self.market.strip().lower(), symbol=self.symbol.strip(), date=self.date.strip(), since=self.since.strip(), until=self.until.strip())
        q = replace(q, limit=q.limit if q.limit > 0 else 1000)
        _need(q.limit <= 10_000, "limit must be at most 10000")
        _instrument(q.market, q.symbol)
        if q.date:
            _need(not (q.since or q.until), "date cannot be combined with since or until")
            return replace(q, date=iso_date(q.date, ("%Y-%m-%d", "%Y%m%d")).isoformat())
        _need(bool(q.since and q.until), "either date or both since and until are required")
        since, (until, _) = moment(q.since)[0], until_bound(q.until)
        _need(since.replace(tzinfo=None) <= until.replace(tzinfo=None), "since must not be after until")
        return q


@dataclass(frozen=True)
class LimitQuery:
    trade_date: str = ""
    since: str = ""
    until: str = ""
    prev_trade_date: str = ""
    market: str = ""
    symbol: str = ""
    event_type: str = ""
    theme: str = ""
    sample_group: str = ""
    index_code: str = ""
    reason_keyword: str = ""
    limit: int = 0
    offset: int = 0

    def checked(self, kind: str) -> LimitQuery:
        q = replace(self, **{k: v.strip() for k, v in vars(self).items() if isinstance(v, str)})
        q = replace(q, market=q.market.lower(), limit=q.limit or (100 if kind == "matrix" else 1000))
        for value in (q.trade_date, q.prev_trade_date, q.since, q.until):
            if value:
                iso_date(value)
        _need(not (q.trade_date and (q.since or q.until)), "trade_date cannot be combined with since and until")
        _need(bool(q.trade_date or (q.since and q.until)), "trade_date, or both since and until, are required")
        _need(q.since <= q.until, "since must not be after until")
        if kind in ("relay", "themes", "matrix") and not q.trade_date:
            _need((iso_date(q.until) - iso_date(q.since)).days < REBUILT_DAYS, f"rebuilt rows span at most {REBUILT_DAYS} days")
        if q.prev_trade_date:
            _need(kind == "relay" and bool(q.trade_date) and q.prev_trade_date < q.trade_date, "prev_trade_date needs a later trade_date, of a relay query")
        _need(1 <= q.limit <= (500 if kind == "matrix" else 20_000), "limit is out of range")
        _need(0 <= q.offset <= 1_000_000, "offset is out of range")
        _need(q.market in ("", *MARKETS), "market must be sh, sz or bj")
        _need(not q.symbol or (re.fullmatch("[0-9]{6}", q.symbol) is not None and bool(q.market)), "symbol needs six digits and a market")
        _need(q.event_type in ("", *EVENT_TYPES), "unknown event_type")
        _need(q.sample_group in ("", *SAMPLE_GROUPS), "unknown sample_group")
        _need(q.index_code in ("", *INDEX_CODES), "unknown index_code")
        for name, kinds in APPLIES.items():
            _need(not getattr(q, name) or kind in kinds, f"{name} does not apply to {kind}")
        return q

    @property
    def days(self) -> tuple[str, str]:
        return (self.trade_date, self.trade_date) if self.trade_date else (self.since, self.until)


#: First year that provider bars are asked for, and most years of one request.
PROVIDER_SINCE, PROVIDER_YEARS = 1990, 10


@dataclass(frozen=True)
class ProviderQuery:
    since: str
    until: str
    adjust: str = "none"

    def checked(self, today: dt.date) -> ProviderQuery:
        since, until = iso_date(self.since.strip()), iso_date(self.until.strip())
        _need((self.adjust.strip().lower() or "none") == "none", "provider bars are not adjusted")
        _need(since.year >= PROVIDER_SINCE, f"since must be {PROVIDER_SINCE} or later")
        _need(since <= until <= today, "since must not be after until, nor until after today")
        _need(until.year - since.year + 1 <= PROVIDER_YEARS, f"at most {PROVIDER_YEARS} calendar years")
        return ProviderQuery(since.isoformat(), until.isoformat())
