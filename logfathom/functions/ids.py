"""Repeatable identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: name space of STIX object ids.
STIX_SPACE = "00abedb4-aa42-466c-9c01-fed23315a9b7"
# Name space of event ids.
EVENT_SPACE = "6f0d3c1e-58a7-4c55-9d0b-2a7c4e8f9b13"


def uuid5(space: str, name: Column) -> Column:
    """Name-based UUID (version 5) as text."""
    return uuid_text(name_digest(space, name))


def name_digest(space: str, name: Column) -> Column:
    return F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), F.encode(name, "UTF-8")))


def uuid_text(digest: Column) -> Column:
    """The UUID of a digest, which it names several times."""
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def event_uuid(parts: Sequence[Column]) -> Column:
    """Event id of a position and its text; a missing part differs from an empty one."""
    cells = [F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]
    return uuid5(EVENT_SPACE, F.concat_ws("\x1f", *cells))


def stix_id(kind: Column, value: Column) -> Column:
    """``kind--uuid`` that is the same for the same value in every export."""
    return F.concat(kind, F.lit("--"), uuid_text(stix_digest(kind, value)))


def stix_digest(kind: Column, value: Column) -> Column:
    return name_digest(STIX_SPACE, F.concat(kind, F.lit(":"), value))
