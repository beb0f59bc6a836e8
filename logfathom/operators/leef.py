"""Log Event Extended Format lines, versions 1.0 and 2.0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions import severity as sev
from logfathom.functions.text import (
    JOINT,
    cut_marks,
    filled,
    key_values,
    marked_map,
    regex_stages,
    spaced_marks,
    split_before_keys,
    to_int,
)
from logfathom.model import Shape, emit, guarded, stage, text_map
from logfathom.sources.lines import clean_lines

# The headers and the attribute keys with a column of their own.
HEADER = r"(?i)LEEF:([12]\.0)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)"
KEY_COLUMNS: dict[str, str] = {
    "src": "source_ip",
    "srcPort": "source_port",
    "dst": "dest_ip",
    "dstPort": "dest_port",
    "usrName": "username",
    "proto": "protocol",
    "cat": "category",
    "sev": "severity",
    "devTime": "timestamp",
    "srcBytes": "bytes_in",
    "dstBytes": "bytes_out",
}
NUMBERS = {"srcPort": "int", "dstPort": "int", "srcBytes": "bigint", "dstBytes": "bigint"}
TAB = "\t"


def delimiter(rest: Column) -> tuple[Column, Column]:
    """Delimiter named at the start of a 2.0 body, and the text after it.

    '^' always means TAB; 0xHH is that character; xHH without the zero is TAB;
    any other sign that is neither letter, digit nor quote stands for itself;
    otherwise TAB and nothing is cut off.
    """
    hex_form = rest.rlike("^0?x[0-9a-fA-F]{2}")
    named = rest.rlike("^0x")
    own = rest.rlike(r"""^[^\p{L}\p{N}"']""")
    code = F.conv(F.substring(rest, 3, 2), 16, 10).try_cast("bigint")
    sign = (
        F.when(rest.startswith("^"), F.lit(TAB))
        .when(hex_form & named, F.char(code))
        .when(hex_form, F.lit(TAB))
        .when(own, F.substring(rest, 1, 1))
        .otherwise(F.lit(TAB))
    )
    cut = (
        F.when(rest.startswith("^"), F.lit(2))
        .when(hex_form & named, F.lit(5))
        .when(hex_form, F.lit(4))
        .when(own, F.lit(2))
        .otherwise(F.lit(1))
    )
    return sign, F.substr(rest, cut)


def attribute_marks(text: Column, sign: Column) -> Column:
    """Marked attributes, NULL where they must be read part by part. Signs other
    than TAB are replaced by one character, so that every regex is constant."""
    return (
        F.when(~F.contains(text, sign), spaced_marks(text))
        .when(sign == TAB, cut_marks(text, TAB))
        .when(~text.contains(JOINT), cut_marks(F.replace(text, sign, F.lit(JOINT)), JOINT))
    )


def attribute_parts(text: Column, sign: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), sign, F.lit("\\E"))
    return (
        F.when(~F.contains(text, sign), split_before_keys(text))
        .when(sign == TAB, F.split(text, TAB))
        .otherwise(F.split(text, quoted))
    )


def shape(line: Column, when: Column | None = None) -> Shape:
    on = F.lit(True) if when is None else when
    head, body, sign, pairs = (F.col(f"__leef_{n}") for n in ("head", "body", "sign", "kv"))
    ok = head.isNotNull()
    own_sign, own_rest = delimiter(head[5])
    second = head[0] == "2.0"
    level = sev.normalize(
        F.coalesce(
            F.col("__leef_sev"),
            F.try_element_at(pairs, F.lit("severity")),
            F.lit("5"),
        )
    )
    fields: dict[str, Column] = {"source_format": F.lit("leef"), "raw": line}
    for key, column in KEY_COLUMNS.items():
        value = F.col(f"__leef_{key}")
        fields[column] = to_int(value, NUMBERS[key]) if key in NUMBERS else value
    said = F.concat_ws(
        " | ",
        filled(head[4]),
        F.concat(F.lit("from "), filled(fields["source_ip"])),
        F.concat(F.lit("user "), filled(fields["username"])),
    )
    fields |= {
        "event_type": F.concat(head[1], F.lit("/"), head[2]),
        "event_action": head[4],
        "severity": level.label,
        "severity_code": level.code,
        "message": F.coalesce(
            filled(said), F.concat(F.lit("LEEF event "), head[1], F.lit("/"), head[2])
        ),
    }
    rest = F.map_filter(
        pairs,
        lambda k, v: v.isNotNull()
        & ~k.isin(*[c for c in KEY_COLUMNS if c not in NUMBERS])
        & ~(k.isin("srcPort", "dstPort") & to_int(v, "int").isNotNull())
        & ~(k.isin("srcBytes", "dstBytes") & to_int(v, "bigint").isNotNull()),
    )
    fields["extensions"] = F.map_concat(
        text_map(
            ("vendor", head[1]), ("product", head[2]), ("version", head[3]), ("event_id", head[4])
        ),
        rest,
    )
    stages = [
        *regex_stages("__leef_head", line, HEADER, 6, on),
        {
            "__leef_sign": F.when(second, own_sign).when(ok, F.lit(TAB)),
            "__leef_body": F.when(second, own_rest).otherwise(head[5]),
        },
        {"__leef_marks": F.when(ok, attribute_marks(body, sign))},
        {
            "__leef_kv": F.when(F.col("__leef_marks").isNotNull(), marked_map(F.col("__leef_marks")))
            .when(ok, key_values(attribute_parts(body, sign)))
        },
        {f"__leef_{k}": F.try_element_at(pairs, F.lit(k)) for k in KEY_COLUMNS},
    ]
    return Shape(guarded(ok, fields, "leef", line), stages)


def normalize_leef(
    df: DataFrame, line_col: str = "value", *, key: list[str] | None = None, keep: list[str] = ()
) -> DataFrame:
    plan = shape(F.col(line_col))
    return emit(stage(clean_lines(df, line_col), plan.stages), plan.fields, key, keep)
