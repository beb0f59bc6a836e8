"""Zeek rows: conn, http, dns, notice and weird logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions import severity as sev
from logfathom.functions.text import to_int
from logfathom.functions.times import epoch_iso
from logfathom.model import emit, stage
from logfathom.sources.zeek import with_headers, zip_row

# Connection state and notice name -> (label, code).
CONN_STATES = {
    "S0": ("medium", 5), "REJ": ("high", 7), "RSTO": ("medium", 4), "RSTR": ("medium", 4),
    "SF": ("low", 1), "S1": ("low", 2), "S2": ("low", 2), "S3": ("low", 2), "OTH": ("low", 2),
}
NOTICES = {
    "Scan::Port_Scan": ("high", 8),
    "Scan::Address_Scan": ("high", 8),
    "SSH::Password_Guessing": ("critical", 9),
    "SSH::Bruteforcing": ("critical", 10),
    "Heartbleed::SSL_Heartbeat_Attack": ("critical", 10),
    "DNS::External_Name": ("medium", 4),
}
SUSPECT_NAMES = (".onion", ".bit", "dyndns", ".ru", ".cn")
CONN_COLUMNS = (
    "ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "orig_bytes", "resp_bytes",
)
# how an unset cell reads inside a message
UNSET = "None"


class Row:
    """Access to one zipped row (a map column)."""

    def __init__(self, cells: Column):
        self.cells = cells

    def __getitem__(self, name: str) -> Column:
        return F.try_element_at(self.cells, F.lit(name))

    def said(self, name: str, missing: str) -> Column:
        """Text for a message: ``missing`` without the column, 'None' when unset."""
        return F.when(
            F.map_contains_key(self.cells, F.lit(name)), F.coalesce(self[name], F.lit(UNSET))
        ).otherwise(F.lit(missing))

    def given(self, name: str) -> Column:
        """The cell, '' without the column, NULL when unset."""
        return F.when(F.map_contains_key(self.cells, F.lit(name)), self[name]).otherwise(F.lit(""))

    def set_cells(self, but: tuple[str, ...] = ()) -> Column:
        def wanted(k: Column, v: Column) -> Column:
            return v.isNotNull() & ~k.isin(*but) if but else v.isNotNull()

        return F.map_filter(self.cells, wanted)

    def ends(self, ports: bool) -> dict[str, Column]:
        out = {"source_ip": self["id.orig_h"], "dest_ip": self["id.resp_h"]}
        if ports:
            out |= {
                "source_port": to_int(self["id.orig_p"]),
                "dest_port": to_int(self["id.resp_p"]),
            }
        return out


def conn(row: Row) -> dict[str, Column]:
    state = row["conn_state"]
    level = sev.lookup(state, CONN_STATES, ("low", 2))
    a, b = row.said, "?"
    return row.ends(ports=True) | {
        "protocol": row["proto"],
        "event_type": F.lit("Network/Connection"),
        "event_action": F.coalesce(state, F.lit("connection")),
        "severity": level.label,
        "severity_code": level.code,
        "bytes_in": to_int(row["orig_bytes"], "bigint"),
        "bytes_out": to_int(row["resp_bytes"], "bigint"),
        "message": F.concat(
            F.lit("Zeek conn "), a("conn_state", ""), F.lit(": "),
            a("id.orig_h", b), F.lit(":"), a("id.orig_p", b), F.lit(" → "),
            a("id.resp_h", b), F.lit(":"), a("id.resp_p", b),
            F.lit(" ("), a("proto", b), F.lit(")"),
        ),
        "extensions": row.set_cells(CONN_COLUMNS),
    }


def http(row: Row) -> dict[str, Column]:
    status = row["status_code"]
    bad = F.coalesce(F.substring(status, 1, 1).isin("4", "5"), F.lit(False))
    level = sev.choose((bad, sev.word("high")), otherwise=sev.word("low"))
    method, shown = row.said("method", ""), row.said("status_code", "")
    return row.ends(ports=True) | {
        "event_type": F.lit("Network/HTTP"),
        "event_action": F.trim(F.concat(method, F.lit(" "), shown)),
        "severity": level.label,
        "severity_code": level.code,
        "username": row["username"],
        "message": F.concat(
            F.lit("HTTP "), method, F.lit(" "), row.said("host", ""), row.said("uri", ""),
            F.lit(" → "), shown,
        ),
        "extensions": row.set_cells(),
    }


def dns(row: Row) -> dict[str, Column]:
    query, kind = row.given("query"), row.said("qtype_name", "")
    odd = (row["qtype_name"] == "TXT") & (F.length(query) > 30)
    hit = F.coalesce(odd, F.lit(False))
    for part in SUSPECT_NAMES:
        hit = hit | query.contains(part)
    level = sev.choose((hit, sev.word("medium")), otherwise=sev.word("low"))
    action = F.concat(F.lit("DNS "), kind, F.lit(" query"))
    return row.ends(ports=False) | {
        "event_type": F.lit("Network/DNS"),
        "event_action": action,
        "severity": level.label,
        "severity_code": level.code,
        "message": F.concat(action, F.lit(": "), query),
        "extensions": row.set_cells(),
    }


def notice(row: Row) -> dict[str, Column]:
    level = sev.lookup(row["note"], NOTICES, sev.DEFAULT)
    return {
        "source_ip": F.coalesce(row["src"], row["id.orig_h"]),
        "dest_ip": F.coalesce(row["dst"], row["id.resp_h"]),
        "event_type": F.lit("Network/Notice"),
        "event_action": row.given("note"),
        "severity": level.label,
        "severity_code": level.code,
        "message": F.coalesce(
            row["msg"], F.concat(F.lit("Zeek notice: "), row.said("note", ""))
        ),
        "extensions": row.set_cells(),
    }


Maker = Callable[[Row], dict[str, Column]]
# log type -> field maker; an unknown type is read as conn
LOG_TYPES: dict[str, Maker] = {
    "conn": conn, "http": http, "dns": dns, "notice": notice, "weird": notice,
}


def register_log_type(path: str, maker: Maker) -> None:
    LOG_TYPES[path] = maker


def normalize_zeek_rows(
    rows: DataFrame, line_col: str = "value", *, key: list[str] | None = None, keep: list[str] = ()
) -> DataFrame:
    """Rows that already have ``path`` (log type) and ``fields`` (column names)."""
    line, path = F.col(line_col), F.col("path")
    cells = F.col("__cells")
    row = Row(cells)
    made = {name: maker(row) for name, maker in LOG_TYPES.items() if name != "conn"}
    default = LOG_TYPES["conn"](row)
    stamp = row["ts"]
    # years outside 1-9999 and unset DNS names make a row unreadable
    seconds = stamp.try_cast("decimal(30,9)")
    lost = F.coalesce(
        (seconds >= F.lit(253402300800)) | (seconds < F.lit(-62135596800)), F.lit(False)
    ) | ((path == "dns") & F.map_contains_key(cells, F.lit("query")) & row["query"].isNull())
    names = set(default).union(*made.values())
    fields: dict[str, Column] = {}
    for name in names:
        value = F.when(F.col("__lost"), line if name == "message" else F.lit(None))
        for kind, columns in made.items():
            value = value.when(path == kind, columns.get(name, F.lit(None)))
        fields[name] = value.otherwise(default.get(name, F.lit(None)))
    fields |= {
        "timestamp": F.when(~F.col("__lost"), epoch_iso(stamp)),
        "source_format": F.lit("zeek"),
        "raw": line,
    }
    staged = stage(
        rows.withColumn(line_col, line),
        [{"__cells": zip_row(F.col("fields"), F.split(line, "\t"))}, {"__lost": lost}],
    )
    return emit(staged, fields, key, keep)


def normalize_zeek(
    df: DataFrame,
    line_col: str = "value",
    *,
    fields: list[str] | None = None,
    path: str = "conn",
    key: list[str] | None = None,
    keep: list[str] = (),
) -> DataFrame:
    """Lines with ``source``, ``block`` and ``seq`` to events.

    With ``fields`` (and ``path``) the header is given and no position is
    needed, as for a stream of bare rows.
    """
    if fields is None:
        rows = with_headers(df, line_col)
    else:
        line = F.col(line_col)
        rows = (
            df.filter((F.rtrim(line) != "") & ~line.startswith("#"))
            .withColumn("path", F.lit(path))
            .withColumn("fields", F.array(*[F.lit(f) for f in fields]))
        )
    return normalize_zeek_rows(rows, line_col, key=key, keep=keep)
