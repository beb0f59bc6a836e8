"""Zeek TSV scans: the header lines apply to the rows below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.functions.text import rstrip, strip
from logfathom.session import cut_lineage

DEFAULT_PATH = "conn"
# Limits up to which header states are broadcast; beyond them a window is used.
MAX_STATES = 100_000
MAX_PER_SOURCE = 64

_SPOT = ["source", "block"]


def _marks(df: DataFrame, col: str) -> DataFrame:
    """``__path`` / ``__fields`` on the header lines, NULL elsewhere."""
    line = F.col(col)
    path = F.when(
        line.startswith("#path"),
        strip(F.when(line.contains("\t"), F.substr(line, F.instr(line, "\t") + F.lit(1))).otherwise(line)),
    )
    names = F.split(line, "\t")
    fields = F.when(
        line.startswith("#fields"), F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0)))
    )
    return df.withColumns({"__path": path, "__fields": fields})


def with_headers(df: DataFrame, col: str = "value") -> DataFrame:
    """Data rows with the log type and column names in force at their position.

    Input rows carry ``source``, ``block`` (a file split, ordered within the
    source) and ``seq`` (order within the split). Header lines are rare, so
    they are written out once, counted, and broadcast as one short array per
    source. With many headers the carry-forward runs as a window over each
    split, which is of bounded size; a source is never gathered in one task.
    """
    lines = _marks(
        df.withColumn(col, rstrip(F.col(col))).filter(F.col(col) != ""), col
    )
    headers = cut_lineage(
        lines.filter(
            F.col(col).startswith("#") & (F.col("__path").isNotNull() | F.col("__fields").isNotNull())
        ).select(*_SPOT, "seq", "__path", "__fields"),
        "zeek-headers",
    )
    sizes = headers.groupBy("source").count().agg(
        F.sum("count").alias("n"), F.max("count").alias("most")
    ).first()
    if (sizes.n or 0) <= MAX_STATES and (sizes.most or 0) <= MAX_PER_SOURCE:
        staged = _by_join(lines, headers)
    else:
        staged = _by_window(lines, headers)
    rows = staged.filter(~F.col(col).startswith("#") & (F.size("fields") > 0))
    return rows.withColumn("path", F.coalesce("path", F.lit(DEFAULT_PATH)))


def last_headers(df: DataFrame, col: str = "value") -> DataFrame:
    """The header lines in force after the last row of each source, placed
    before all rows: what a later part of the source has to be read with."""
    line = F.col(col)
    headers = df.filter(line.startswith("#path") | line.startswith("#fields"))
    spot = F.struct("block", "seq")
    found = headers.groupBy("source", line.startswith("#path").alias("__is_path")).agg(F.max_by(line, spot).alias(col))
    return found.select(
        "source", F.lit(-1).cast("bigint").alias("block"), F.when(F.col("__is_path"), 0).otherwise(1).cast("bigint").alias("seq"), col
    )


def _entering(headers: DataFrame) -> DataFrame:
    """Last path and field list of every split that has a header."""
    return headers.groupBy(*_SPOT).agg(
        F.max_by("__path", F.when(F.col("__path").isNotNull(), F.col("seq"))).alias("path"),
        F.max_by("__fields", F.when(F.col("__fields").isNotNull(), F.col("seq"))).alias("fields"),
    )


def _by_join(df: DataFrame, headers: DataFrame) -> DataFrame:
    """Every source's header states as one sorted array, broadcast.

    The arrays hold header lines only; their number was checked.
    """

    def states(mark: str) -> Column:
        return F.array_sort(
            F.collect_list(
                F.when(
                    F.col(mark).isNotNull(),
                    F.struct("block", "seq", F.col(mark).alias("mark")),
                )
            )
        )

    by_source = headers.groupBy(F.col("source").alias("__source")).agg(
        states("__path").alias("__paths"), states("__fields").alias("__names")
    )

    def latest(array: str) -> Column:
        here = F.struct(F.col("block"), F.col("seq"))
        before = F.filter(F.col(array), lambda s: F.struct(s["block"], s["seq"]) < here)
        one = F.get(F.col(array), F.lit(0))
        alone = F.when(F.struct(one["block"], one["seq"]) < here, one["mark"])
        return F.when(F.size(array) == 1, alone).otherwise(
            F.try_element_at(before, F.lit(-1))["mark"]
        )

    joined = df.join(F.broadcast(by_source), F.col("source") == F.col("__source"), "left")
    return joined.withColumns({"path": latest("__paths"), "fields": latest("__names")}).drop(
        "__source", "__paths", "__names", "__path", "__fields"
    )


def _by_window(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Two-level carry-forward: over the splits of a source, then inside a split."""
    splits = lines.groupBy(*_SPOT).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy("source").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    entering = (
        splits.join(_entering(headers), _SPOT, "left")
        .select(
            *_SPOT,
            F.last("path", ignorenulls=True).over(over).alias("__in_path"),
            F.last("fields", ignorenulls=True).over(over).alias("__in_fields"),
        )
    )
    inside = Window.partitionBy(*_SPOT).orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    carried = lines.withColumns(
        {
            "path": F.last("__path", ignorenulls=True).over(inside),
            "fields": F.last("__fields", ignorenulls=True).over(inside),
        }
    )
    return (
        carried.join(entering, _SPOT, "left")
        .withColumns(
            {
                "path": F.coalesce("path", "__in_path"),
                "fields": F.coalesce("fields", "__in_fields"),
            }
        )
        .drop("__path", "__fields", "__in_path", "__in_fields")
    )


def zip_row(names: Column, cells: Column) -> Column:
    """Names and cells to a map; the longer side is cut, unset cells are NULL."""
    n = F.least(F.size(names), F.size(cells))
    clean = F.transform(
        F.slice(cells, F.lit(1), n), lambda c: F.when(~c.isin("-", "(empty)", ""), c)
    )
    return F.map_from_arrays(F.slice(names, F.lit(1), n), clean)
