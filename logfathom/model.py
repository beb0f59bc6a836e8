"""The normalised event row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.ids import event_uuid
from logfathom.functions.times import event_instant

# name -> Spark type, in output order
BASE_FIELDS: dict[str, str] = {
    "event_id": "string",
    "timestamp": "string",
    "source_format": "string",
    "source_host": "string",
    "source_ip": "string",
    "source_port": "int",
    "dest_ip": "string",
    "dest_port": "int",
    "event_type": "string",
    "event_action": "string",
    "severity": "string",
    "severity_code": "int",
    "category": "string",
    "username": "string",
    "user_id": "string",
    "process_name": "string",
    "process_id": "bigint",
    "protocol": "string",
    "bytes_in": "bigint",
    "bytes_out": "bigint",
    "message": "string",
    "raw": "string",
    "extensions": "map<string,string>",
}
ENRICHED_FIELDS: dict[str, str] = {
    "geo_country": "string",
    "geo_country_code": "string",
    "geo_city": "string",
    "geo_lat": "double",
    "geo_lon": "double",
    "geo_isp": "string",
    "geo_asn": "string",
    "rdns": "string",
    "abuse_score": "int",
    "is_malicious": "boolean",
}
EVENT_FIELDS = BASE_FIELDS | ENRICHED_FIELDS

EVENT_DDL = ", ".join(f"`{n}` {t}" for n, t in EVENT_FIELDS.items()) + ", event_ts timestamp"

# Columns that say where a line came from; they make ids repeatable.
POSITION = ("source", "seq", "sub")


@dataclass
class Shape:
    """A normaliser as data.

    ``stages`` are columns computed one after the other (a regex is run once
    and its groups are referenced many times), ``fields`` the event columns
    built from them. A format router can so put several normalisers into one
    projection over one scan.
    """

    fields: dict[str, Column]
    stages: Sequence[dict[str, Column]] = field(default_factory=tuple)


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def text_map(*pairs: tuple[str, Column]) -> Column:
    """A map literal; keys are fixed, values text."""
    cells: list[Column] = []
    for key, value in pairs:
        cells += [F.lit(key), value.cast("string")]
    return F.create_map(*cells)


def fallback_fields(fmt: str, line: Column) -> dict[str, Column]:
    """The event of a line that cannot be parsed: the text is kept, nothing else."""
    return {"source_format": F.lit(fmt), "message": line, "raw": line}


def guarded(ok: Column, fields: dict[str, Column], fmt: str, line: Column) -> dict[str, Column]:
    """``fields`` where the line was understood, the fallback event elsewhere."""
    rest = fallback_fields(fmt, line)
    out = {}
    for name, value in fields.items():
        if name in ("source_format", "raw"):
            out[name] = value
        elif name in rest:
            out[name] = F.when(ok, value).otherwise(rest[name])
        else:
            out[name] = F.when(ok, value)
    return out


def stage(df: DataFrame, stages: Sequence[dict[str, Column]]) -> DataFrame:
    """Compute columns step by step."""
    for columns in stages:
        df = df.withColumns(columns)
    return df


def keep_filters_above(df: DataFrame) -> DataFrame:
    """Stop later filters from moving below the parsing steps.

    Pushed down, a condition on a parsed column would be rewritten into the
    text's terms step by step and run the same regexes again for each use.
    Filters do not pass a column the optimizer may not compute twice, so one
    such column, tested once and dropped, keeps them here. Columns are still
    pruned.
    """
    return df.withColumn("__once", F.rand(0)).filter(F.col("__once") >= 0).drop("__once")


def emit(
    df: DataFrame,
    fields: dict[str, Column],
    key: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Select the full event row (plus ``keep``) from staged columns.

    ``event_id`` is a hash of the ``key`` columns and the raw text, so a task
    that runs twice gives the same id. Without a key the position columns of
    a file scan are used; without those, equal lines share one id.
    """
    key = [c for c in POSITION if c in df.columns] if key is None else list(key)
    # what several output columns are made of is computed in a step of its own
    stamp, raw = F.col("__stamp"), F.col("__raw")
    df = df.withColumns(
        {"__stamp": fields.get("timestamp", F.lit(None)).cast("string"), "__raw": fields["raw"]}
    )
    fields = fields | {"timestamp": stamp, "raw": raw}
    columns = []
    for name, ddl in EVENT_FIELDS.items():
        if name == "event_id":
            value = event_uuid([F.col(c) for c in key] + [raw])
        elif name == "extensions":
            value = F.coalesce(fields.get(name, empty_map()), empty_map())
        else:
            value = fields.get(name, F.lit(None))
        columns.append(value.cast(ddl).alias(name))
    when = event_instant(stamp).alias("event_ts")
    return keep_filters_above(df.select(*columns, when, *[F.col(c) for c in keep]))


def align(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Bring any frame with some event columns to the full event row."""
    have = set(df.columns)
    columns = [
        (F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in EVENT_FIELDS.items()
    ]
    when = F.col("event_ts") if "event_ts" in have else event_instant(
        F.col("timestamp") if "timestamp" in have else F.lit(None).cast("string")
    )
    return df.select(*columns, when.alias("event_ts"), *keep)
