"""Format detection and routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.text import strip
from logfathom.operators.lookup import lookup_join
from logfathom.sources.lines import present

HEAD = 2000
# What an event XML text contains anywhere, how a Zeek log starts.
XML_SIGNS = ("<Event ", "<Events>", "schemas.microsoft.com/win/2004/08/events")
ZEEK_STARTS = ("#separator", "#path", "#fields")
_ACCESS = r"(?U)^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+-\s+"


def any_of(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def has_xml_sign(text: Column) -> Column:
    return any_of([text.contains(s) for s in XML_SIGNS])


def detect_format(text: Column, xml_sign: Column | None = None) -> Column:
    """Format of a text by ordered rules; the first that holds decides.

    ``xml_sign`` replaces the one rule that looks at more than the head, for
    callers that only hold the head of a source.
    """
    body = strip(text)
    peek = F.substring(body, 1, HEAD)
    trail = (peek.contains('"eventName"') | peek.contains('"eventSource"')) & peek.contains(
        '"Records"'
    )
    bracket = body.startswith("<") & F.substring(body, 1, 6).contains(">")
    return (
        F.when(trail, "aws_cloudtrail")
        .when(body.startswith("{") | body.startswith("["), "json")
        .when(F.substring(body, 1, 200).contains("CEF:"), "cef")
        .when(F.upper(F.substring(body, 1, 5)) == "LEEF:", "leef")
        .when(has_xml_sign(body) if xml_sign is None else xml_sign, "evtx")
        .when(bracket, "syslog")
        .when(body.rlike(_ACCESS), "nginx")
        .when(any_of([body.startswith(s) for s in ZEEK_STARTS]), "zeek")
        .otherwise("syslog")
    )


def known_format(name: Column, known: Sequence[str]) -> Column:
    """A name no parser has is read as syslog."""
    return F.when(name.isin(*known), name).otherwise("syslog")


def detect_sources(
    lines: DataFrame, line_col: str = "value", rule: Callable[..., Column] = detect_format
) -> DataFrame:
    """(source, format) of every source of a line scan.

    The head is put together from the first lines of a source, at most one
    per character it may hold and each cut to the head's length; the XML sign
    is looked for in all lines. Both are partial aggregates.
    """
    line = F.col(line_col)
    spot = F.struct(F.col("seq"), F.col("sub") if "sub" in lines.columns else F.lit(0).alias("sub"))
    scan = lines.select("source", spot.alias("at"), line.alias("line"), has_xml_sign(line).alias("x"))
    first = scan.groupBy("source").agg(
        F.min(F.when(present(F.col("line")), F.col("at"))).alias("first"),
        F.max("x").alias("xml"),
    ).withColumnRenamed("source", "__source")
    near = lookup_join(scan, first, {"source": "__source"}, salt_by=["at"], prefix="__f_")
    heads = (
        near.filter(
            (F.col("at") >= F.col("__f_first"))
            & (F.col("at.seq") < F.col("__f_first.seq") + HEAD)
            & (F.col("at.sub") < F.col("__f_first.sub") + HEAD)
        )
        .groupBy("source")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(
                        F.collect_list(F.struct("at", F.substring("line", 1, HEAD).alias("t")))
                    ),
                    lambda s: s["t"],
                ),
                "\n",
            ).alias("head"),
            F.first("__f_xml").alias("xml"),
        )
    )
    return heads.select("source", rule(F.col("head"), F.col("xml")).alias("format"))


def format_histogram(detected: DataFrame) -> DataFrame:
    """How many sources (or lines) have each format."""
    return detected.groupBy("format").agg(F.count(F.lit(1)).alias("n"))
