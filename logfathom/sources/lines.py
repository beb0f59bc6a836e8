"""Line scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.functions.text import lines_of, rare_lines_of, strip
from logfathom.operators.lookup import fits_broadcast
from logfathom.session import cut_lineage, gathered


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text files as ``value`` with the position of every line.

    ``source`` is the file, ``seq`` the number of the line in it (from 0) and
    ``sub`` its order where one stored line holds rarer line breaks; ``block``
    is the byte offset of the file split it was read from. Bytes that are no
    UTF-8 become U+FFFD. A line's number says nothing about how files are split
    or what else is read, so ids made of it stay.
    """
    scan = spark.read.text(path).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return break_lines(number_lines(gathered(scan)))


def number_lines(scan: DataFrame) -> DataFrame:
    """Add ``seq``, the number of a line in its source.

    The lines of each split are counted first: a table of one row per split,
    whose running sums per source give the number of the split's first line.
    It is broadcast while it is within the measured bound, so no text is
    shuffled; a source is never gathered in one task.
    """
    numbered = scan.withColumn("__row", F.monotonically_increasing_id())
    counts = numbered.groupBy("source", "block").agg(
        F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut_lineage(
        counts.select(
            F.col("source").alias("__source"), F.col("block").alias("__block"), "__first",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        ),
        "splits",
    )
    firsts = F.broadcast(firsts) if fits_broadcast(firsts) else firsts
    same = (F.col("source") == F.col("__source")) & (F.col("block") == F.col("__block"))
    return (
        numbered.join(firsts, same)
        .withColumn("seq", F.col("__row") - F.col("__first") + F.col("__before"))
        .drop("__row", "__first", "__before", "__source", "__block")
    )


def break_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Cut lines at the breaks a line file scan does not know (VT, FF, NEL, …)."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(rare_lines_of(F.col(col))).alias("sub", col))


def explode_lines(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """Whole texts in a column to one row per line: ``value`` and its order ``sub``."""
    return df.select(*keep, F.posexplode(lines_of(F.col(col))).alias("sub", "value"))


def present(line: Column) -> Column:
    """Lines that are not blank."""
    return strip(line) != ""


def present_uncommented(line: Column) -> Column:
    """Lines that are neither blank nor '#' comments."""
    text = strip(line)
    return (text != "") & ~text.startswith("#")


def clean_lines(df: DataFrame, col: str = "value", comments: bool = False) -> DataFrame:
    """Trim every line and drop blank ones (and comments where the format has them)."""
    keep = present_uncommented if comments else present
    return df.filter(keep(F.col(col))).withColumn(col, strip(F.col(col)))
