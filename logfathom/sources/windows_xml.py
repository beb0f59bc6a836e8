"""Windows event XML: records out of files and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.functions.text import lines_of, strip
from logfathom.model import keep_filters_above
from logfathom.sources.lines import number_lines

END = "</Event>"


def read_windows_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """XML files cut at the end tag of a record, so that large files split.

    Gives ``value`` (one record, or what stands around records) and its position.
    """
    scan = spark.read.text(path, lineSep=END).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return number_lines(scan).withColumn("value", F.concat("value", F.lit(END)))


def cut_records(df: DataFrame, col: str = "value") -> DataFrame:
    """Texts with any number of records to one row per record or stray line.

    ``value`` holds either one ``<Event …>…</Event>`` or a line that belongs
    to none; wrapper tags, declarations and white space are dropped.
    """
    rest = [c for c in df.columns if c not in (col, "sub")]
    pieces = F.split(F.col(col), END)
    last = F.size(pieces)
    marked = F.transform(
        pieces, lambda p, i: F.when(i < last - 1, F.concat(p, F.lit(END))).otherwise(p)
    )
    records = F.flatten(F.transform(marked, _piece))
    made = keep_filters_above(df.select(*rest, records.alias("__records")))
    return made.select(*rest, F.posexplode("__records").alias("sub", "value"))


def _piece(piece: Column) -> Column:
    at = F.regexp_instr(piece, F.lit(r"<Event[\s>/]"))
    whole = (at > 0) & piece.endswith(END)
    stray = F.regexp_replace(
        F.regexp_replace(piece, END, ""),
        r"(?s)</?Events\b[^>]*>|<\?.*?\?>|<!--.*?-->",
        "",
    )
    lines = F.filter(
        F.transform(lines_of(stray), strip), lambda line: line != ""
    )
    return F.when(whole, F.array(F.substr(piece, at))).otherwise(lines)
