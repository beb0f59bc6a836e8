"""Clustered files, and which of them a stored-event filter has to read.

Files are cut along a space-filling curve over time, severity and address, so
each covers a small range of all three. What filters ask for is kept per file:
least and greatest times, the severities and formats, and for every searched
text a signature: a bit for each run of three characters that occurs. A file
whose signature lacks a bit of the needle cannot match.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.net import ipv4_number
from logfathom.operators.query import EventFilter
from logfathom.session import ROWS_PER_TASK

SEARCHED = ("message", "source_ip", "event_type", "event_action", "username")
CURVE_BITS = 16  # per dimension
FILE_BYTES = 256 << 20  # of a file's rows, which one task sorts
SIGN_BITS = 32_768  # of a bitmap of the built-in aggregate
RUN = 3
FILES_DDL = (
    "file string, rows bigint, low_time string, high_time string, severities array<string>, formats array<string>, "
    "countries array<string>, flags array<boolean>, "
    + ", ".join(f"sign_{c} binary" for c in SEARCHED)
    + ", part string"
)
# Distinct countries a file lists; beyond them it counts as one that may match.
MOST_VALUES = 1000


def interleaved(values: list[Column]) -> Column:
    """Bits of whole numbers below 2 ** CURVE_BITS, one of each in turn."""
    out = F.lit(0).cast("bigint")
    for i in range(CURVE_BITS):
        for k, value in enumerate(values):
            bit = F.shiftright(value, i).bitwiseAND(F.lit(1)).cast("bigint")
            out = out.bitwiseOR(F.shiftleft(bit, len(values) * i + k))
    return out


def clustered(rows: DataFrame, sized_by: DataFrame, rows_per_file: int) -> DataFrame:
    """Rows in files of about ``rows_per_file``, or fewer if their texts are long or
    cores would be idle, cut along the curve.

    ``sized_by`` is a stored frame with the same values, of which one row of
    bounds, the number of rows and the bytes of their texts is taken.
    """
    dims = {
        "time": F.unix_seconds("event_ts").cast("double"),
        "level": F.coalesce("severity_code", F.lit(0)).cast("double"),
        "address": ipv4_number(F.col("source_ip")).cast("double"),
    }
    bounds = [f(c).alias(f"{n}_{name}") for name, c in dims.items() for n, f in (("low", F.min), ("high", F.max))]
    texts = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("bigint") for c, t in sized_by.dtypes if t == "string"]
    if "extensions" in sized_by.columns:
        pairs = F.concat(F.map_keys("extensions"), F.map_values("extensions"))
        texts.append(F.coalesce(F.octet_length(F.array_join(pairs, "")), F.lit(0)).cast("bigint"))
    size = F.sum(reduce(lambda a, b: a + b, texts)).alias("bytes")
    found = sized_by.agg(F.count(F.lit(1)).alias("n"), size, *bounds).first()
    size = (found["bytes"] or 0) + 8 * len(sized_by.columns) * found["n"]
    places = []
    for name, c in dims.items():
        low, high = found[f"low_{name}"] or 0.0, found[f"high_{name}"] or 0.0
        share = (c - low) / (high - low) if high > low else F.lit(0.0)
        places.append(F.coalesce(F.floor(share * ((1 << CURVE_BITS) - 1)), F.lit(0)).cast("bigint"))
    # a core sorts and writes a file, and later reads it for its table
    busy = min(rows.sparkSession.sparkContext.defaultParallelism, found["n"] // ROWS_PER_TASK)
    files = max(1, -(-found["n"] // rows_per_file), -(-size // FILE_BYTES), busy)
    out = rows.withColumn("__curve", interleaved(places))
    return out.repartitionByRange(files, "__curve", "event_id").sortWithinPartitions("__curve").drop("__curve")


def runs_of_three(text: Column) -> Column:
    low = F.lower(text)
    count = F.greatest(F.length(low) - (RUN - 1), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(low, i, F.lit(RUN)))


def spot(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(SIGN_BITS))


def file_table(events: DataFrame, base: str) -> DataFrame:
    """One row per file of stored events; ``file`` is its path below ``base``."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/(session_id=[^/]*/part=[^/]*/[^/]+)$", 1)
    # the name as it is stored: paths in metadata have their signs encoded
    rows = events.withColumn("file", F.replace(name, F.lit("%25"), F.lit("%")))
    few = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, MOST_VALUES + 1)
    table = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("low_time"), F.max("timestamp").alias("high_time"),
        F.array_sort(F.collect_set(F.lower("severity"))).alias("severities"), F.array_sort(F.collect_set(F.lower("source_format"))).alias("formats"),
        few("geo_country").alias("countries"), F.collect_set(F.coalesce("is_malicious", F.lit(False))).alias("flags"),
    )
    # each searched text's runs, distinct per task before they meet
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in SEARCHED])
    texts = rows.select("file", F.explode(cells).alias("c")).select("file", "c.field", "c.text").filter(F.length("text") >= RUN)
    bits = texts.distinct().select("file", "field", F.explode(runs_of_three(F.col("text"))).alias("run")).select("file", "field", spot(F.col("run")).alias("bit"))
    signs = bits.distinct().groupBy("file").agg(
        *[F.bitmap_construct_agg(F.when(F.col("field") == c, F.col("bit"))).alias(f"sign_{c}") for c in SEARCHED]
    )
    return table.join(signs, "file", "left")


def needed_runs(value: str) -> list[str]:
    """The runs of three that every match of a search has: those of the parts
    between wildcards. Needles with shorter parts only ask for none."""
    parts = re.split("[%_]", value.lower())
    return sorted({p[i : i + RUN] for p in parts for i in range(len(p) - RUN + 1)})


def has_runs(sign: str, value: str) -> Column:
    """Whether a signature has all bits of a needle."""
    tests = []
    for run in needed_runs(value):
        at = spot(F.lit(run))
        octet = F.conv(F.hex(F.substring(F.col(sign), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.getbit(octet, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def may_match(files: DataFrame, where: EventFilter) -> DataFrame:
    """The files that can hold an event that a filter takes."""
    tests = []
    if where.severity:
        tests.append(F.array_contains("severities", where.severity.lower()))
    if where.source_format:
        tests.append(F.array_contains("formats", where.source_format.lower()))
    if where.geo_country:
        tests.append(F.array_contains("countries", where.geo_country) | (F.size("countries") > MOST_VALUES))
    if where.is_malicious is not None:
        tests.append(F.array_contains("flags", where.is_malicious))
    if where.from_time:
        tests.append(F.col("high_time") >= where.from_time)
    if where.to_time:
        tests.append(F.col("low_time") <= where.to_time)
    for column, value in [("message", where.search), *[(c, getattr(where, c)) for c in SEARCHED[1:]]]:
        if value and needed_runs(value):
            tests.append(has_runs(f"sign_{column}", value))
    return files.filter(reduce(lambda a, b: a & b, tests)) if tests else files
