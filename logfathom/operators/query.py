"""Predicates, order and pages over stored events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER_COLUMNS = ("timestamp", "severity", "created_at", "abuse_score", "source_format")
DEFAULT_ORDER = ("timestamp", "DESC")
PAGE = 100


def same_text(column: str, value: str) -> Column:
    """Equality that ignores case."""
    return F.lower(F.col(column)) == value.lower()


def like_text(column: str, value: str) -> Column:
    """Substring search that ignores case; % and _ in the value are wildcards.

    A backslash has no special meaning.
    """
    return F.col(column).ilike("%" + value.replace("\\", "\\\\") + "%")


@dataclass(frozen=True)
class EventFilter:
    """Arguments of a stored-event query; empty ones do not filter."""

    severity: str | None = None
    source_format: str | None = None
    source_ip: str | None = None
    event_type: str | None = None
    event_action: str | None = None
    username: str | None = None
    geo_country: str | None = None
    is_malicious: bool | None = None
    session_id: str | None = None
    search: str | None = None
    from_time: str | None = None
    to_time: str | None = None

    def conditions(self) -> list[Column]:
        tests = [same_text(c, v) for c in ("severity", "source_format") if (v := getattr(self, c))]
        tests += [
            like_text(c, v)
            for c in ("source_ip", "event_type", "event_action", "username")
            if (v := getattr(self, c))
        ]
        if self.geo_country:
            tests.append(F.col("geo_country") == self.geo_country)
        if self.is_malicious is not None:
            tests.append(F.coalesce(F.col("is_malicious"), F.lit(False)) == self.is_malicious)
        if self.session_id:
            tests.append(F.col("session_id") == self.session_id)
        if self.search:
            tests.append(like_text("message", self.search))
        if self.from_time:
            tests.append(F.col("timestamp") >= self.from_time)
        if self.to_time:
            tests.append(F.col("timestamp") <= self.to_time)
        return tests

    def apply(self, events: DataFrame) -> DataFrame:
        tests = self.conditions()
        return events.filter(reduce(lambda a, b: a & b, tests)) if tests else events


def between_instants(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Time range on the real instant, where texts of several formats mix."""
    if start:
        events = events.filter(F.col("event_ts") >= F.lit(start).cast("timestamp"))
    if end:
        events = events.filter(F.col("event_ts") <= F.lit(end).cast("timestamp"))
    return events


def parse_order(text: str) -> tuple[str, str]:
    """``column [ASC|DESC]`` from a fixed list; one word means DESC, anything
    else the default."""
    words = text.split()
    if words and len(words) <= 2 and words[0].lower() in ORDER_COLUMNS:
        way = words[1].upper() if len(words) == 2 else "DESC"
        if way in ("ASC", "DESC"):
            return words[0].lower(), way
    return DEFAULT_ORDER


def ordered(events: DataFrame, order_by: str = "timestamp DESC") -> DataFrame:
    """Sort with NULLs as the smallest value; ``event_id`` breaks ties."""
    column, way = parse_order(order_by)
    c = F.col(column)
    first = c.asc_nulls_first() if way == "ASC" else c.desc_nulls_last()
    return events.orderBy(first, F.col("event_id"))


def page(
    events: DataFrame, limit: int = PAGE, offset: int = 0, order_by: str = "timestamp DESC"
) -> DataFrame:
    """One page of the sorted events."""
    rows = ordered(events, order_by)
    return (rows.offset(offset) if offset else rows).limit(limit)


def page_after(
    events: DataFrame, last: tuple | None, limit: int = PAGE, order_by: str = "timestamp DESC"
) -> DataFrame:
    """The page that follows the event with order value and id ``last``.

    It is a filter and a top-k, however deep the page: no rows are sorted and
    skipped. ``last`` None gives the first page.
    """
    if last is not None:
        column, way = parse_order(order_by)
        c, value, beyond = F.col(column), F.lit(last[0]), F.col("event_id") > last[1]
        if last[0] is None:
            rest = c.isNotNull() | beyond if way == "ASC" else c.isNull() & beyond
        elif way == "ASC":
            rest = (c > value) | ((c == value) & beyond)
        else:
            rest = (c < value) | c.isNull() | ((c == value) & beyond)
        events = events.filter(rest)
    return ordered(events, order_by).limit(limit)


def query_events(
    events: DataFrame,
    where: EventFilter | None = None,
    *,
    limit: int = PAGE,
    offset: int = 0,
    order_by: str = "timestamp DESC",
) -> tuple[DataFrame, DataFrame]:
    """(page, total): the page of the matching events and a one-row frame with
    their number. The count needs no sort and reads only filtered columns."""
    matching = (where or EventFilter()).apply(events)
    total = matching.agg(F.count(F.lit(1)).alias("total"))
    return page(matching, limit, offset, order_by), total


def with_message(events: DataFrame) -> DataFrame:
    """Events that have something to show."""
    return events.filter(F.col("message") != "")


def preview(events: DataFrame, limit: int = 50) -> DataFrame:
    """The first events in input order, by position where it is known."""
    spots = [c for c in ("source", "seq", "sub") if c in events.columns]
    return events.orderBy(*spots or ["event_id"]).limit(limit)


def recent_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), F.col("session_id")).limit(limit)
