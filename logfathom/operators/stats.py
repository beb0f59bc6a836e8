"""Counts over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("critical", "high", "medium", "low")


def total(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total"))


def malicious(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("is_malicious")).alias("malicious"))


def count_by(events: DataFrame, column: str) -> DataFrame:
    """Events per value; NULL is a group of its own."""
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top(events: DataFrame, column: str, k: int = 10, *, skip_empty: bool = False) -> DataFrame:
    """The ``k`` most frequent values, ties by value. Counts are combined per
    task before the shuffle, so one frequent value is no bottleneck."""
    c = F.col(column)
    rows = events.filter(c.isNotNull() & (c != "")) if skip_empty else events.filter(c.isNotNull())
    return count_by(rows, column).orderBy(F.desc("n"), c).limit(k)


def top_with_country(events: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent source addresses with a country they were seen with."""
    ip = F.col("source_ip")
    return (
        events.filter(ip.isNotNull() & (ip != ""))
        .groupBy("source_ip")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.nullif(F.col("geo_country"), F.lit(""))).alias("country"),
        )
        .orderBy(F.desc("n"), ip)
        .limit(k)
    )


def parse_summary(events: DataFrame) -> DataFrame:
    """One row: total, the four severities (none counts as low), enriched, malicious."""
    label = F.lower(F.coalesce(F.nullif(F.col("severity"), F.lit("")), F.lit("low")))
    country = F.col("geo_country")
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(label == name).alias(name) for name in LABELS],
        F.count_if(country.isNotNull() & (country != "")).alias("geo_enriched"),
        F.count_if(F.col("is_malicious")).alias("malicious"),
    )


def session_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"))


RANKED = (("ip", "source_ip"), ("user", "username"), ("country", "geo_country"))


def _cells(events: DataFrame) -> DataFrame:
    """(section, item, n) of the report's first four sections, of the few
    combinations of severity, format and flag."""
    flagged = events.select(
        "severity", "source_format", F.coalesce("is_malicious", F.lit(False)).alias("bad")
    )
    cube = flagged.groupBy("severity", "source_format", "bad").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")

    def cell(section: str, item: Column, n: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.alias("item"), n.alias("n"))

    n = F.col("n")
    cells = F.array(
        cell("total", none, n),
        cell("malicious", none, F.when(F.col("bad"), n).otherwise(F.lit(0).cast("bigint"))),
        cell("severity", F.col("severity"), n),
        cell("format", F.col("source_format"), n),
    )
    return cube.select(F.inline(cells)).groupBy("section", "item").agg(F.sum("n").alias("n"))


def _with_zeros(out: DataFrame) -> DataFrame:
    """An empty store still reports its two totals."""
    zero = out.sparkSession.createDataFrame([("total", None, 0), ("malicious", None, 0)], "section string, item string, n bigint")
    return out.unionByName(zero).groupBy("section", "item").agg(F.sum("n").alias("n"))


def report(events: DataFrame, k: int = 10) -> DataFrame:
    """The stored-event report as rows (section, item, n).

    Four aggregates, each reading only its own columns of the store: one for
    the first four sections, and one ranking each of addresses, users and
    countries.
    """
    out = _with_zeros(_cells(events))
    for section, column in RANKED:
        ranked = top(events, column, k).select(
            F.lit(section).alias("section"), F.col(column).alias("item"), "n"
        )
        out = out.unionByName(ranked)
    return out


def summary(events: DataFrame) -> DataFrame:
    """The counts a report is made of, all values with their numbers: summaries
    of parts add up to that of the whole."""
    pairs = F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("item")) for s, c in RANKED])
    values = events.select(F.inline(pairs)).filter("item IS NOT NULL").groupBy("section", "item").agg(F.count(F.lit(1)).alias("n"))
    return _cells(events).unionByName(values)


def report_of(summaries: DataFrame, k: int = 10) -> DataFrame:
    """The report, from summaries of all parts."""
    ranked = [s for s, _ in RANKED]
    rows = summaries.groupBy("section", "item").agg(F.sum("n").alias("n"))
    out = _with_zeros(rows.filter(~F.col("section").isin(ranked)))
    for section in ranked:
        out = out.unionByName(rows.filter(F.col("section") == section).orderBy(F.desc("n"), "item").limit(k))
    return out
