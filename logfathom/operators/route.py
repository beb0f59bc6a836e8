"""Mixed input to events: the format decides the parser, per line or per source."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.functions.text import strip
from logfathom.model import EVENT_FIELDS, emit, stage
from logfathom.operators.detect import detect_sources, known_format
from logfathom.operators.lookup import lookup_join
from logfathom.operators.registry import PARSERS, format_of
from logfathom.session import cut_lineage
from logfathom.sources.documents import (
    RECORD_KEYS,
    TRAIL_KEYS,
    read_json_lines,
    strict_json,
)
from logfathom.sources.json_splits import json_documents
from logfathom.sources.lines import present, read_lines
from logfathom.sources.windows_xml import read_windows_xml


def union_events(frames: list[DataFrame]) -> DataFrame:
    """Per-format results as one frame of one schema."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def _projected(
    lines: DataFrame, line_col: str, fmt_col: str, reference_date: Column | None, key, keep
) -> DataFrame:
    """All projection-only formats in one pass: their shapes are staged side by
    side, each behind its format, and every field picks its format's value."""
    line, fmt = F.col(line_col), F.col(fmt_col)
    shapes = {n: p for n, p in PARSERS.items() if p.shape is not None}
    commented = [n for n, p in shapes.items() if p.comments]
    rows = lines.filter(fmt.isin(*shapes) & ~(fmt.isin(*commented) & line.startswith("#")))
    made = {}
    for name, parser in shapes.items():
        extra = {"reference_date": reference_date} if name == "syslog" else {}
        made[name] = parser.shape(line, when=fmt == name, **extra)
    depth = max(len(s.stages) for s in made.values())
    for i in range(depth):
        columns: dict[str, Column] = {}
        for s in made.values():
            columns |= s.stages[i] if i < len(s.stages) else {}
        rows = stage(rows, [columns])
    # each format's fields first, so that the choice below is between columns
    rows = stage(
        rows,
        [
            {
                f"__{name}_{field}": value
                for name, s in made.items()
                for field, value in s.fields.items()
            }
        ],
    )
    fields: dict[str, Column] = {"raw": line, "source_format": fmt}
    for field in EVENT_FIELDS:
        if field in ("event_id", "raw", "source_format"):
            continue
        value = None
        for name, s in made.items():
            if field in s.fields:
                test = fmt == name
                mine = F.col(f"__{name}_{field}")
                value = F.when(test, mine) if value is None else value.when(test, mine)
        if value is not None:
            fields[field] = value
    return emit(rows, fields, key, keep)


def route_lines(
    df: DataFrame,
    line_col: str = "value",
    *,
    fmt_col: str | None = None,
    reference_date: Column | None = None,
    key: list[str] | None = None,
    keep: list[str] = (),
) -> DataFrame:
    """Each row by its own format (a topic or table of mixed lines).

    ``fmt_col`` names a column that already holds the format. Rows of the
    document formats hold whole documents. Zeek rows need the header of their
    source, so without one only header lines are met here, which give nothing.
    """
    text = strip(F.col(line_col))
    named = format_of(F.col(line_col)) if fmt_col is None else F.col(fmt_col)
    lines = (
        df.filter(present(F.col(line_col)))
        .withColumn("__fmt", known_format(named, list(PARSERS)))
        .withColumn(line_col, text)
    )
    parts = [_projected(lines, line_col, "__fmt", reference_date, key, keep)]
    for name, parser in PARSERS.items():
        if parser.shape is None and name != "zeek":
            rows = lines.filter(F.col("__fmt") == name)
            parts.append(parser.normalize(rows, line_col, key=key, keep=keep))
    return union_events(parts)


def plain_path(uri: str) -> str:
    """A file's URI as a path to read: decoded, and its signs of patterns taken
    literally."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(uri))


def normalize_files(
    spark: SparkSession, path: str | list[str], *, reference_date: Column | None = None
) -> DataFrame:
    """Files of any mix of formats to events; each file's format is detected once.

    Line formats are read by one scan and one projection. Document formats
    are read again in their own unit, only the files that need it.
    """
    lines = read_lines(spark, path)
    formats = cut_lineage(detect_sources(lines, rule=format_of), "formats")
    # file names, of which the file listing already holds the full set
    by_format: dict[str, list[str]] = {}
    for row in formats.toLocalIterator():
        by_format.setdefault(row["format"], []).append(plain_path(row["source"]))
    parts = []
    shaped = [n for n, p in PARSERS.items() if p.shape is not None]
    if set(by_format) & set(shaped):
        tagged = lookup_join(
            lines, formats.withColumnRenamed("source", "__source"), {"source": "__source"},
            salt_by=["seq"], prefix="",
        ).withColumn("value", strip(F.col("value")))
        parts.append(
            _projected(
                tagged.filter(F.col("value") != ""), "value", "format", reference_date, None, ()
            )
        )
    if "zeek" in by_format:
        parts.append(PARSERS["zeek"].normalize(read_lines(spark, by_format["zeek"])))
    if "evtx" in by_format:
        parts.append(PARSERS["evtx"].normalize(read_windows_xml(spark, by_format["evtx"])))
    if "aws_cloudtrail" in by_format:
        # a file that is no JSON document gives no event
        records, _ = json_documents(spark, by_format["aws_cloudtrail"], TRAIL_KEYS, first_key_only=True)
        parts.append(PARSERS["aws_cloudtrail"].normalize(records, elements=True))
    if "json" in by_format:
        lines, records = _json_rows(spark, by_format["json"])
        parts += [PARSERS["json"].normalize(x) for x in lines] + [PARSERS["json"].normalize(x, elements=True) for x in records]
    return union_events(parts)


def _json_rows(spark: SparkSession, paths: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """(lines, records): the lines of NDJSON files, and the records of files that
    are one document each. Both are read in splits.

    A file that begins like a document which its first line does not end is
    taken for one; if it is none after all, its lines are read. A cut first line, as rotation leaves it, is no such beginning: it does not
    start with a bracket, or the line after it is a value of its own, as no line
    of an object that goes over several lines is.
    """
    lines = read_json_lines(spark, paths)
    filled = lines.filter(strip(F.col("value")) != "")
    spot = F.struct("block", "seq", "sub")
    heads = filled.groupBy("source").agg(F.min_by("value", spot).alias("first"), F.min(spot).alias("__at"))
    heads = cut_lineage(heads.withColumnRenamed("source", "__source"), "json-heads")
    later = lookup_join(filled, heads, {"source": "__source"}, salt_by=["seq"], prefix="__h_").filter(spot > F.col("__h___at"))
    seconds = later.groupBy("source").agg(F.min_by("value", spot).alias("second"))
    text = F.substr(strip(F.col("first")), F.lit(1), F.lit(1))
    opened = text.isin("{", "[") & strict_json(F.col("first")).isNull()
    alone = (text == "{") & F.coalesce(F.substr(strip(F.col("second")), F.lit(1), F.lit(1)) == "{", F.lit(False)) & strict_json(F.col("second")).isNotNull()
    heads = heads.join(seconds, F.col("__source") == F.col("source"), "left")
    whole = [plain_path(r["__source"]) for r in heads.filter(opened & ~alone).select("__source").toLocalIterator()]
    records = []
    if whole:
        found, others = json_documents(spark, whole, RECORD_KEYS)
        records.append(found)
        broken = {plain_path(r["path"]) for r in others.toLocalIterator()}
        whole = [p for p in whole if _same_file(p) not in {_same_file(b) for b in broken}]
    split = [p for p in paths if p not in set(whole)]
    lines = [read_json_lines(spark, split).select("source", "block", "seq", "value")] if split else []
    return lines, records


def _same_file(path: str) -> str:
    """A path to compare: the same with one or three slashes after its scheme."""
    return re.sub(r"^file:/+", "file:/", path)
