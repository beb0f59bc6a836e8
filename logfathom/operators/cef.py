"""Common Event Format lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions import severity as sev
from logfathom.functions.text import (
    filled,
    key_values,
    marked_map,
    regex_stages,
    spaced_marks,
    split_before_keys,
    strip,
    to_int,
)
from logfathom.model import Shape, emit, guarded, stage, text_map
from logfathom.sources.lines import clean_lines

# The header and the extension keys with a column of their own.
HEADER = r"(?U)(?i)CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(\d+)\|?(.*)$"
KEY_COLUMNS: dict[str, str] = {
    "src": "source_ip",
    "spt": "source_port",
    "dst": "dest_ip",
    "dpt": "dest_port",
    "suser": "username",
    "sproc": "process_name",
    "spid": "process_id",
    "proto": "protocol",
    "in": "bytes_in",
    "out": "bytes_out",
    "act": "event_action",
    "cat": "category",
    "msg": "message",
    "rt": "timestamp",
    "start": "timestamp",
    "dvchost": "source_host",
}
NUMBERS = {"spt": "int", "dpt": "int", "in": "bigint", "out": "bigint", "spid": "bigint"}


def shape(line: Column, when: Column | None = None) -> Shape:
    on = F.lit(True) if when is None else when
    at = F.instr(line, "CEF:")
    body = F.when(at > 1, F.substr(line, at)).otherwise(line)
    head, pairs = F.col("__cef_head"), F.col("__cef_kv")
    ok = head.isNotNull()
    level = sev.normalize(head[6])
    fields: dict[str, Column] = {"source_format": F.lit("cef"), "raw": line}
    for key, column in KEY_COLUMNS.items():
        value = F.col(f"__cef_{key}")
        if key in NUMBERS:
            value = to_int(value, NUMBERS[key])
        # of two keys for one column the later one wins
        fields[column] = F.coalesce(value, fields[column]) if column in fields else value
    name = head[5]
    fields |= {
        "event_type": F.concat(head[1], F.lit("/"), head[2]),
        "event_action": F.coalesce(filled(fields["event_action"]), name),
        "severity": level.label,
        "severity_code": level.code,
        "message": F.coalesce(
            filled(fields["message"]),
            F.concat(
                name, F.lit(" from "), F.coalesce(filled(fields["source_ip"]), F.lit("unknown"))
            ),
        ),
    }
    # a number that is none stays readable under its own key
    rest = F.map_filter(
        pairs,
        lambda k, v: ~k.isin(*[c for c in KEY_COLUMNS if c not in NUMBERS])
        & ~(k.isin("spt", "dpt") & to_int(v, "int").isNotNull())
        & ~(k.isin("in", "out", "spid") & to_int(v, "bigint").isNotNull()),
    )
    fields["extensions"] = F.map_concat(
        text_map(
            ("cef_version", head[0]), ("vendor", head[1]), ("product", head[2]),
            ("device_version", head[3]), ("signature_id", head[4]), ("name", name),
        ),
        rest,
    )
    stages = [
        {"__cef_body": body},
        *regex_stages("__cef_head", F.col("__cef_body"), HEADER, 8, on),
        {"__cef_ext": F.when(ok, strip(head[7]))},
        {"__cef_marks": spaced_marks(F.col("__cef_ext"))},
        {
            "__cef_kv": F.when(F.col("__cef_marks").isNotNull(), marked_map(F.col("__cef_marks")))
            .otherwise(key_values(split_before_keys(F.col("__cef_ext"))))
        },
        {f"__cef_{k}": F.try_element_at(pairs, F.lit(k)) for k in KEY_COLUMNS},
    ]
    return Shape(guarded(ok, fields, "cef", line), stages)


def normalize_cef(
    df: DataFrame, line_col: str = "value", *, key: list[str] | None = None, keep: list[str] = ()
) -> DataFrame:
    plan = shape(F.col(line_col))
    return emit(stage(clean_lines(df, line_col), plan.stages), plan.fields, key, keep)
