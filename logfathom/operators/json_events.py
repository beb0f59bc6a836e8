"""Generic JSON records (flat, ECS-like nesting, wrapped lists)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions import severity as sev
from logfathom.model import emit, guarded, stage
from logfathom.sources.documents import element_list, explode_records, is_object, record_list
from logfathom.sources.lines import clean_lines

# Key aliases per event column; of those present the LAST one wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "timestamp": ("timestamp", "@timestamp", "time", "ts", "event_time"),
    "source_ip": ("src_ip", "sourceIPAddress", "client_ip", "source.ip"),
    "source_host": ("host", "hostname", "source.host"),
    "source_port": ("src_port", "source.port"),
    "dest_ip": ("dst_ip", "destination.ip"),
    "dest_port": ("dst_port", "destination.port"),
    "username": ("user", "userName", "user.name", "actor.login"),
    "user_id": ("uid", "userId", "user.id"),
    "event_type": ("event_type", "event.type", "eventType", "type"),
    "event_action": ("action", "event.action", "eventName"),
    "severity": ("severity", "level", "log.level", "logLevel"),
    "category": ("category", "event.category"),
    "process_name": ("process", "process.name", "processName"),
    "process_id": ("pid", "process.pid"),
    "protocol": ("protocol", "network.protocol"),
    "bytes_in": ("bytes_in", "source.bytes"),
    "bytes_out": ("bytes_out", "destination.bytes"),
    "message": ("msg", "log", "message", "body"),
}
NUMBERS = {
    "source_port": "int", "dest_port": "int", "bytes_in": "bigint", "bytes_out": "bigint",
    "process_id": "bigint",
}


def _leaf(record: Column, path: str, kind: str) -> Column:
    """Value at ``path`` when it is no object. Only a text that looks like an
    object needs the second, dearer look at its type."""
    text = F.try_variant_get(record, path, "string")
    value = text if kind == "string" else F.try_variant_get(record, path, kind)
    nested = text.startswith("{") & is_object(F.try_variant_get(record, path, "variant"))
    return F.when(~nested, value)


def pick(record: Column, column: str, kind: str = "string") -> Column:
    """The winning alias of a column, from the last alias to the first."""
    found = []
    for alias in reversed(ALIASES[column]):
        if "." in alias:
            found.append(_leaf(record, f"$['{alias}']", kind))
        found.append(_leaf(record, "$." + alias if alias[0] != "@" else f"$['{alias}']", kind))
    return F.coalesce(*found)


def leftovers(record: Column) -> Column:
    """Top-level members that no column took; nested ones stay whole, as JSON text.

    A number column that could not be read keeps its member here.
    """
    top = F.try_variant_get(record, "$", "map<string,variant>")
    text_keys = [a for c, names in ALIASES.items() if c not in NUMBERS for a in names]
    number_keys = {
        kind: [a for c in NUMBERS if NUMBERS[c] == kind for a in ALIASES[c]]
        for kind in ("int", "bigint")
    }

    def free(k: Column, v: Column) -> Column:
        taken = k.isin(*text_keys)
        for kind, names in number_keys.items():
            taken = taken | (k.isin(*names) & F.try_variant_get(v, "$", kind).isNotNull())
        return ~taken | F.is_variant_null(v) | is_object(v)

    return F.transform_values(
        F.map_filter(top, free), lambda _, v: F.try_variant_get(v, "$", "string")
    )


def fields(record: Column, text: Column) -> dict[str, Column]:
    out: dict[str, Column] = {"source_format": F.lit("json"), "raw": text}
    for column in ALIASES:
        if column != "severity":
            out[column] = pick(record, column, NUMBERS.get(column, "string"))
    word = F.col("__json_sev")
    level = sev.normalize(word)
    out["severity"] = F.when(word.isNotNull(), level.label)
    out["severity_code"] = F.when(word.isNotNull(), level.code)
    out["extensions"] = leftovers(record)
    return guarded(record.isNotNull(), out, "json", text)


def normalize_json(
    df: DataFrame, line_col: str = "value", *, elements: bool = False, key: list[str] | None = None, keep: list[str] = ()
) -> DataFrame:
    """One JSON value per row: an object, a list of objects or a wrapper object;
    with ``elements`` a record that was cut out of its document.

    A row that is no JSON becomes a fallback event, a scalar gives nothing.
    """
    flat = explode_records(clean_lines(df, line_col), line_col, element_list if elements else record_list)
    record, text = F.col("record"), F.col("text")
    staged = stage(flat, [{"__json_sev": pick(record, "severity")}])
    if key is not None:
        key = [*key, "sub"]
    return emit(staged, fields(record, text), key, keep)
