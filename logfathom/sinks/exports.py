"""Text exports. Each is a frame with one text column, written by Spark's sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.times import epoch_seconds
from logfathom.model import EVENT_FIELDS
from logfathom.sinks.document import write_document
from logfathom.sinks.stix import stix_objects

# CSV columns, default index name and default source name.
CSV_COLUMNS = (
    "event_id", "timestamp", "source_format", "source_host", "source_ip", "source_port",
    "dest_ip", "dest_port", "event_type", "event_action", "severity", "severity_code",
    "category", "username", "user_id", "process_name", "process_id", "protocol",
    "bytes_in", "bytes_out", "message",
)
DEFAULT_INDEX = "siem-logs"
DEFAULT_SOURCE = "siem-parser"
HEC_INDEX = "main"

_ALL_FIELDS = {"ignoreNullFields": "false"}


def event_struct() -> Column:
    """All event fields, as the JSON exports show them."""
    return F.struct(*[F.col(f) for f in EVENT_FIELDS])


def csv_rows(events: DataFrame) -> DataFrame:
    """The fixed CSV columns."""
    return events.select(*CSV_COLUMNS)


def ndjson_rows(events: DataFrame) -> DataFrame:
    """One JSON object per event, NULL fields written."""
    return events.select(F.to_json(event_struct(), _ALL_FIELDS).alias("value"))


def _quoted(text: Column) -> Column:
    """JSON string literal of a text, ``null`` for NULL."""
    boxed = F.to_json(F.array(text), _ALL_FIELDS)
    return F.substr(boxed, F.lit(2), F.length(boxed) - 2)


def merged_document() -> Column:
    """The event as JSON with its extensions merged over the fields of the same name.

    Nearly all events have no such name: their two objects are joined as text.
    The others drop the overridden fields first.
    """
    names = [f for f in EVENT_FIELDS if f != "extensions"]
    extra = F.coalesce(F.col("extensions"), F.create_map().cast("map<string,string>"))
    base = F.to_json(F.struct(*[F.col(f) for f in names]), _ALL_FIELDS)
    tail = F.to_json(extra, _ALL_FIELDS)
    plain = F.when(F.size(extra) == 0, base).otherwise(
        F.concat(F.substr(base, F.lit(1), F.length(base) - 1), F.lit(","), F.substr(tail, F.lit(2)))
    )
    cells = []
    for f in names:
        value = F.col(f)
        shown = _quoted(value) if EVENT_FIELDS[f] == "string" else F.coalesce(
            value.cast("string"), F.lit("null")
        )
        cells.append(
            F.when(
                ~F.map_contains_key(extra, F.lit(f)), F.concat(F.lit(f'"{f}":'), shown)
            )
        )
    kept = F.concat_ws(",", *cells)
    overridden = F.concat(F.lit("{"), kept, F.lit(","), F.substr(tail, F.lit(2)))
    clash = F.arrays_overlap(F.map_keys(extra), F.array(*[F.lit(n) for n in names]))
    return F.when(clash, overridden).otherwise(plain)


def bulk_rows(events: DataFrame, index: str = DEFAULT_INDEX) -> DataFrame:
    """Search-engine bulk format: action line and document line, kept together
    in one row so that no split of the output parts them."""
    action = F.to_json(
        F.struct(
            F.struct(F.lit(index).alias("_index"), F.col("event_id").alias("_id")).alias("index")
        )
    )
    return events.select(F.concat(action, F.lit("\n"), merged_document()).alias("value"))


def hec_rows(
    events: DataFrame, source: str = DEFAULT_SOURCE, host: str = DEFAULT_SOURCE
) -> DataFrame:
    """Event-collector envelopes; ``time`` is NULL where the text is no ISO time."""
    envelope = F.struct(
        epoch_seconds(F.col("timestamp")).alias("time"),
        F.coalesce(F.nullif(F.col("source_host"), F.lit("")), F.lit(host)).alias("host"),
        F.lit(source).alias("source"),
        F.concat(F.lit("siem:"), F.col("source_format")).alias("sourcetype"),
        F.lit(HEC_INDEX).alias("index"),
        event_struct().alias("event"),
    )
    return events.select(F.to_json(envelope, _ALL_FIELDS).alias("value"))


# --- writers --------------------------------------------------------------------


def write_csv(events: DataFrame, path: str, **_) -> None:
    csv_rows(events).write.options(
        header=True, escape='"', emptyValue="", nullValue="", lineSep="\r\n"
    ).csv(path)


def _text(df: DataFrame, path: str) -> None:
    df.select("value").write.text(path)


def write_ndjson(events: DataFrame, path: str, **_) -> None:
    _text(ndjson_rows(events), path)


def write_array(events: DataFrame, path: str, order: list[str] | None = None, **_) -> None:
    """One JSON array as one file, written in parallel."""
    keys = list(order or [])
    write_document(events.select(F.to_json(event_struct(), _ALL_FIELDS).alias("value"), *keys), path, order=keys)


def write_bulk(events: DataFrame, path: str, index: str = DEFAULT_INDEX, **_) -> None:
    _text(bulk_rows(events, index), path)


def write_hec(
    events: DataFrame, path: str, source: str = DEFAULT_SOURCE, host: str = DEFAULT_SOURCE, **_
) -> None:
    _text(hec_rows(events, source, host), path)


def write_stix(events: DataFrame, path: str, **options) -> None:
    _text(stix_objects(events, **options).select(F.col("json").alias("value")), path)


Writer = Callable[..., None]
WRITERS: dict[str, Writer] = {
    "csv": write_csv,
    "json": write_array,
    "ndjson": write_ndjson,
    "elasticsearch": write_bulk,
    "es": write_bulk,
    "splunk": write_hec,
    "hec": write_hec,
    "stix": write_stix,
}


def register_writer(name: str, writer: Writer) -> None:
    WRITERS[name.lower()] = writer


def export(events: DataFrame, fmt: str, path: str, **options) -> None:
    """Write events in a named format; the name ignores case."""
    writer = WRITERS.get(fmt.lower())
    if writer is None:
        raise ValueError(f"Unknown export format: {fmt}")
    writer(events, path, **options)
