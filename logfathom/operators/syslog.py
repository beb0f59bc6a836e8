"""Syslog: RFC 5424 and RFC 3164."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions import severity as sev
from logfathom.functions.text import regex_stages, strip, to_int
from logfathom.functions.times import yearless
from logfathom.model import Shape, emit, fallback_fields, stage, text_map
from logfathom.sources.lines import clean_lines

# The two line layouts.
RFC5424 = (
    r"(?U)<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.*?\]|-)\s*(.*)"
)
RFC3164 = r"(?U)<(\d+)>(([A-Za-z]{3})\s+(\d+)\s+(\d{2}:\d{2}:\d{2}))\s+(\S+)\s+(\S+?):\s*(.*)"


def shape(line: Column, when: Column | None = None, reference_date: Column | None = None) -> Shape:
    reference = F.current_date() if reference_date is None else reference_date
    on = F.lit(True) if when is None else when
    new, old = F.col("__sl_new"), F.col("__sl_old")
    pri, facility = F.col("__sl_pri"), F.col("__sl_fac")
    is_new, is_old = new.isNotNull(), old.isNotNull()

    def dash(i: int) -> Column:
        return F.nullif(new[i], F.lit("-"))

    def pick(a: Column | None, b: Column | None) -> Column:
        out = F.when(is_new, a) if a is not None else F.when(F.lit(False), b)
        return out.when(is_old, b) if b is not None else out

    level = sev.of_priority(pri)
    known = is_new | is_old
    fields = {
        "timestamp": pick(dash(2), F.col("__sl_time")),
        "source_host": pick(dash(3), old[5]),
        "event_type": F.when(known, F.concat(F.lit("syslog/"), facility)),
        "event_action": pick(dash(4), old[6]),
        "severity": F.when(known, level.label),
        "severity_code": F.when(known, level.code),
        "process_name": pick(dash(4), old[6]),
        "process_id": pick(to_int(dash(5), "bigint"), None),
        "message": pick(strip(new[8]), strip(old[7])).otherwise(line),
        "extensions": F.when(
            is_new,
            text_map(("facility", facility), ("msgid", new[6]), ("structured_data", new[7])),
        ).when(is_old, text_map(("facility", facility))),
    }
    stages = [
        *regex_stages("__sl_new", line, RFC5424, 9, on),
        *regex_stages("__sl_old", line, RFC3164, 8, on & new.isNull()),
        {"__sl_pri": to_int(F.coalesce(new, old)[0], "bigint")},
        {
            "__sl_fac": F.when(is_new | is_old, sev.facility(pri)),
            "__sl_time": F.when(is_old, yearless(old[1], old[2], old[3], old[4], reference)),
        },
    ]
    return Shape(fallback_fields("syslog", line) | fields, stages)


def normalize_syslog(
    df: DataFrame,
    line_col: str = "value",
    *,
    reference_date: Column | None = None,
    key: list[str] | None = None,
    keep: list[str] = (),
) -> DataFrame:
    """Lines to events. ``reference_date`` fixes the year of RFC 3164 dates."""
    plan = shape(F.col(line_col), reference_date=reference_date)
    return emit(stage(clean_lines(df, line_col, comments=True), plan.stages), plan.fields, key, keep)
