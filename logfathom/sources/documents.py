"""JSON scans: whole documents, records inside them, one value per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.functions.text import lines_of, strip
from logfathom.model import keep_filters_above
from logfathom.sources.lines import present, read_lines

# Keys that may hold the list of records, first list wins.
RECORD_KEYS = ("Records", "events", "logs", "items", "hits", "data", "results")
TRAIL_KEYS = ("Records", "events")


def strict_json(text: Column) -> Column:
    """Parse text that is exactly one JSON value, NULL otherwise.

    The built-in parser stops after the first value. The text is put in an
    array before a hash of itself; only where that hash is found right after
    the value was the whole text read.
    """
    mark = F.xxhash64(text)
    both = F.try_parse_json(
        F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]"))
    )
    return F.when(
        F.try_variant_get(both, "$[1]", "bigint") == mark, F.try_variant_get(both, "$[0]", "variant")
    )


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def as_list(v: Column, path: str = "$") -> Column:
    """The list at ``path``, NULL when there is none or it is no list."""
    return F.try_variant_get(v, path, "array<variant>")


def objects(items: Column) -> Column:
    return F.filter(items, is_object)


def _none() -> Column:
    return F.array().cast("array<variant>")


def record_list(v: Column) -> tuple[Column, Column]:
    """Records of a JSON value and whether the value is its own record.

    The objects of a list, or of the first list under a known key, or the
    object itself; none for a scalar.
    """
    nested = F.coalesce(*[as_list(v, f"$.{k}") for k in RECORD_KEYS])
    items = F.when(is_object(v), F.coalesce(nested, F.array(v))).otherwise(
        F.coalesce(as_list(v), _none())
    )
    return objects(items), is_object(v) & nested.isNull()


def trail_list(v: Column) -> tuple[Column, Column]:
    """The same for a CloudTrail document: a list, ``Records``, ``events`` or itself.

    A ``Records`` key that holds no list hides ``events`` and gives nothing.
    """
    first, second = (F.try_variant_get(v, f"$.{k}", "variant").isNotNull() for k in ("Records", "events"))
    inner = (
        F.when(first, F.coalesce(as_list(v, "$.Records"), _none()))
        .when(second, F.coalesce(as_list(v, "$.events"), _none()))
        .otherwise(F.array(v))
    )
    items = F.when(is_object(v), inner).otherwise(F.coalesce(as_list(v), _none()))
    return objects(items), is_object(v) & ~first & ~second


def element_list(v: Column) -> tuple[Column, Column]:
    """A value that was cut out of its document: an object is a record, whatever
    it holds; anything else is none."""
    return F.when(is_object(v), F.array(v)).otherwise(_none()), is_object(v)


def explode_records(df: DataFrame, text_col: str, records) -> DataFrame:
    """One row per record: ``record`` (variant), ``sub`` its order, ``text`` of it.

    A text that is one object is its own record and keeps its own spelling.
    Texts that are no JSON come out with a NULL record. The condition that an
    explode sets on its list stays above the parse, which would run twice.
    """
    value = F.col("__value")
    rest = [c for c in df.columns if c not in (text_col, "sub")]
    items, own = records(value)
    lists = df.withColumn("__value", strict_json(F.col(text_col))).withColumns(
        {
            "__records": F.when(value.isNotNull(), items).otherwise(
                F.array(F.lit(None).cast("variant"))
            ),
            "__own": F.coalesce(own, F.lit(True)),
        }
    )
    flat = keep_filters_above(lists).select(
        *rest, text_col, "__own", F.posexplode("__records").alias("sub", "record")
    )
    text = F.when(F.col("__own"), F.col(text_col)).otherwise(F.to_json(F.col("record")))
    return flat.withColumn("text", text).drop("__own", text_col)


def document_lines(df: DataFrame, col: str) -> DataFrame:
    """Whole JSON texts: those that parse stay whole, the rest is cut into lines."""
    whole = strict_json(strip(F.col(col))).isNotNull()
    rest = [c for c in df.columns if c != col]
    parts = F.when(whole, F.array(strip(F.col(col)))).otherwise(lines_of(F.col(col)))
    made = keep_filters_above(df.select(*rest, parts.alias("__parts")))
    cut = made.select(*rest, F.posexplode("__parts").alias("seq", col))
    return cut.filter(present(F.col(col))).withColumn(col, strip(F.col(col)))


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """NDJSON files: splittable, one row per line."""
    lines = read_lines(spark, path)
    return lines.filter(present(F.col("value"))).withColumn("value", strip(F.col("value")))
