"""Timestamp texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logfathom.functions.text import regex_groups

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_ISO = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
    r"(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def month_number(name: Column) -> Column:
    """Three letters to 1-12, NULL for anything else."""
    at = F.instr(F.lit(MONTHS), F.lower(name))
    return F.when((F.length(name) == 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _valid(year: Column, month: Column, day: Column, h: Column, m: Column, s: Column) -> Column:
    made = F.try_make_timestamp(
        _int(year), _int(month), _int(day), _int(h), _int(m), s.try_cast("decimal(16,6)")
    )
    return made.isNotNull() & (_int(s) < 60)


def yearless(
    raw: Column, month_name: Column, day_text: Column, clock: Column, reference: Column
) -> Column:
    """``Mon d HH:MM:SS`` to ISO text with an inferred year.

    The year is the reference year, or the one before when the date lies
    ahead of the reference date by more than a day of the same month.
    A date that does not exist keeps its raw text.
    """
    month, day = month_number(month_name), _int(day_text)
    h, m, s = (F.substring(clock, i, 2) for i in (1, 4, 7))
    this_year = F.year(reference)
    ahead = (month > F.month(reference)) | (
        (month == F.month(reference)) & (day > F.dayofmonth(reference) + 1)
    )
    year = F.when(ahead, this_year - 1).otherwise(this_year)
    ok = _valid(this_year, month, day, h, m, s) & _valid(year, month, day, h, m, s)
    text = F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"), two(month), F.lit("-"), two(day),
        F.lit("T"), clock,
    )
    return F.when(ok, text).otherwise(raw)


_CLF = r"(\d{1,2})/([A-Za-z]{3})/(\d{4}):(\d{1,2}):(\d{1,2}):(\d{1,2})"


def _clf_text(g: Column) -> tuple[Column, Column]:
    day, name, year, h, m, s = (g[i] for i in range(6))
    month = month_number(name)
    text = F.concat(
        year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit("T"),
        two(h), F.lit(":"), two(m), F.lit(":"), two(s),
    )
    return _valid(year, month, day, h, m, s), text


_ANY, _LONG, _MOST = (
    "(?:" + "|".join(names) + ")"
    for names in (
        ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
        ("Jan", "Mar", "May", "Jul", "Aug", "Oct", "Dec"),
        ("Jan", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
    )
)
# the usual layout with a date that exists in every year
_USUAL_CLF = (
    rf"^(?:(?:0[1-9]|1\d|2[0-8])/{_ANY}|(?:29|30)/{_MOST}|31/{_LONG})/[1-9]\d\d\d:"
    r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d [+-](?:[01]\d|2[0-3])[0-5]\d$"
)


def access_log_stages(name: str, text: Column) -> list[dict[str, Column]]:
    """``10/Oct/2024:13:55:36 +0530`` (trimmed) to ISO text with the offset kept;
    without an offset 'Z'; else the raw text. Stages that end in column ``name``.

    One regex proves the usual layout, which is then rearranged by position.
    """
    usual, full, short = (F.col(f"{name}_{n}") for n in ("usual", "full", "short"))

    def at(start: int, n: int) -> Column:
        return F.substring(text, start, n)

    dash, colon = F.lit("-"), F.lit(":")
    zone = F.when(at(23, 4) == "0000", F.lit("+00:00")).otherwise(
        F.concat(at(22, 3), colon, at(25, 2))
    )
    iso = F.concat(
        at(8, 4), dash, two(month_number(at(4, 3))), dash, at(1, 2), F.lit("T"), at(13, 8), zone
    )
    layout = r"\s+(?:([+-])(\d{2}):?([0-5]\d)|(Z))"
    return [
        {f"{name}_usual": F.when(text.rlike(_USUAL_CLF), iso)},
        {
            f"{name}_full": F.when(
                usual.isNull(), regex_groups(text, _CLF + f"(?:{layout})?(.*)", 11)
            ),
            f"{name}_short": F.when(
                usual.isNull(), regex_groups(F.substring(text, 1, 20), _CLF + "$", 6)
            ),
        },
        {name: F.coalesce(usual, _unusual_clf(text, full, short))},
    ]


def _unusual_clf(text: Column, g: Column, short: Column) -> Column:
    ok, iso = _clf_text(g)
    sign, oh, om, zulu, rest = (g[i] for i in range(6, 11))
    zero = (zulu == "Z") | ((oh == "00") & (om == "00"))
    offset = F.when(zero, F.lit("+00:00")).otherwise(F.concat(sign, oh, F.lit(":"), om))
    has_zone = ((zulu == "Z") | ((sign != "") & (_int(oh) < 24))) & (rest == "")
    short_ok, short_iso = _clf_text(short)
    return (
        F.when(ok & has_zone, F.concat(iso, offset))
        .when(short.isNotNull() & short_ok, F.concat(short_iso, F.lit("Z")))
        .otherwise(text)
    )


SLASH_TIME = r"(?U)(\d{4})/(\d{2})/(\d{2})\s+(\d{2}):(\d{2}):(\d{2})$"


def slash_time(raw: Column, g: Column) -> Column:
    """``YYYY/MM/DD HH:MM:SS`` (error logs) to ISO 'Z' text, raw when invalid.
    ``g`` are the groups of :data:`SLASH_TIME`."""
    y, mo, d, h, m, s = (g[i] for i in range(6))
    iso = F.concat(
        y, F.lit("-"), mo, F.lit("-"), d, F.lit("T"), h, F.lit(":"), m, F.lit(":"), s, F.lit("Z")
    )
    return F.when(g.isNotNull() & _valid(y, mo, d, h, m, s), iso).otherwise(raw)


def epoch_micros(seconds_text: Column) -> Column:
    """Decimal seconds text to whole microseconds; NULL for zero or no number."""
    seconds = seconds_text.try_cast("decimal(30,9)")
    micros = F.bround(seconds * F.lit(1000000).cast("decimal(7,0)"), 0).try_cast("bigint")
    return F.nullif(micros, F.lit(0).cast("bigint"))


def epoch_iso(seconds_text: Column) -> Column:
    """Epoch seconds to ISO UTC text, microseconds only when there are any."""
    micros = epoch_micros(seconds_text)
    part = F.pmod(micros, F.lit(1000000))
    fraction = F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0")))
    return F.concat(
        F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss"),
        F.coalesce(fraction, F.lit("")),
        F.lit("+00:00"),
    )


def iso_instant(text: Column) -> Column:
    """ISO text to an instant; no zone means UTC; NULL when it is not ISO."""
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


def event_instant(text: Column) -> Column:
    """Instant of any of the timestamp texts the sources use."""
    named = F.try_to_timestamp(
        F.when(text.rlike("^[A-Za-z]{3} "), F.regexp_replace(text, " +", " ")),
        F.lit("MMM d yyyy HH:mm:ss"),
    )
    return F.coalesce(iso_instant(text), named)


def epoch_seconds(text: Column) -> Column:
    """Epoch seconds of an ISO text, NULL when it is none."""
    return (F.unix_micros(iso_instant(text)) / F.lit(1000000)).cast("decimal(18,6)")
