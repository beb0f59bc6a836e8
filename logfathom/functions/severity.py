"""Severity scales."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from logfathom.functions.text import strip


class Severity(NamedTuple):
    label: Column
    code: Column


# Severity words and numbers -> (label, code); anything else is medium 5.
SCALE: dict[str, tuple[str, int]] = {
    "0": ("low", 1),
    "1": ("low", 2),
    "2": ("low", 3),
    "3": ("medium", 4),
    "4": ("medium", 5),
    "5": ("medium", 6),
    "6": ("high", 7),
    "7": ("high", 8),
    "8": ("critical", 9),
    "9": ("critical", 10),
    "10": ("critical", 10),
    "low": ("low", 2),
    "medium": ("medium", 5),
    "high": ("high", 7),
    "critical": ("critical", 10),
    "info": ("low", 1),
    "warning": ("medium", 5),
    "error": ("high", 7),
    "alert": ("critical", 9),
    "emergency": ("critical", 10),
    "notice": ("low", 2),
    "debug": ("low", 1),
}
DEFAULT = ("medium", 5)

# Syslog levels 0-7 and facility names; a facility past the list keeps its number.
LEVELS = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron",
    "authpriv", "ftp", "local0", "local1", "local2", "local3", "local4", "local5", "local6",
    "local7",
)

# HTTP status -> (label, code), exact codes before first digits.
STATUS_EXACT = {
    "401": ("medium", 5),
    "403": ("high", 7),
    "404": ("low", 2),
    "429": ("medium", 4),
    "499": ("medium", 4),
}
STATUS_CLASS = {"1": ("low", 1), "2": ("low", 1), "3": ("low", 2), "5": ("high", 7)}
STATUS_OTHER = ("low", 2)

# Request paths that raise the severity.
SENSITIVE_PATHS = ("/admin", "/wp-admin", "/.env", "/etc/passwd", "/shell", "/../")

# API calls that are always high, then the name prefixes in order.
HIGH_VALUE_CALLS = (
    "ConsoleLogin", "AssumeRole", "CreateUser", "DeleteUser", "AttachUserPolicy",
    "AttachRolePolicy", "CreateAccessKey", "DeleteAccessKey", "UpdateAccountPasswordPolicy",
    "StopLogging", "DeleteTrail", "PutBucketPolicy", "PutBucketAcl",
)
CALL_PREFIXES = {
    "Delete": "high", "Remove": "high", "Terminate": "high", "Detach": "medium",
    "Disable": "high", "Deactivate": "high", "Create": "low", "Put": "low", "Update": "low",
    "Describe": "low", "List": "low", "Get": "low", "Failed": "critical",
    "Unauthorized": "critical", "Console": "medium",
}


def lookup(key: Column, table: dict[str, tuple[str, int]], default: tuple[str, int]) -> Severity:
    """A (label, code) table as two foldable map literals."""

    def side(i: int) -> Column:
        cells = [F.lit(x) for k, v in table.items() for x in (k, v[i])]
        return F.coalesce(F.try_element_at(F.create_map(*cells), key), F.lit(default[i]))

    return Severity(side(0), side(1))


def normalize(value: Column) -> Severity:
    return lookup(strip(F.lower(value.cast("string"))), SCALE, DEFAULT)


def word(label: str) -> Severity:
    """The severity of a fixed word."""
    name, code = SCALE.get(label, DEFAULT)
    return Severity(F.lit(name), F.lit(code))


def choose(*branches: tuple[Column, Severity], otherwise: Severity) -> Severity:
    def side(i: int) -> Column:
        out = None
        for test, sev in branches:
            out = F.when(test, sev[i]) if out is None else out.when(test, sev[i])
        return out.otherwise(otherwise[i]) if out is not None else otherwise[i]

    return Severity(side(0), side(1))


def pair(value: tuple[str, int]) -> Severity:
    return Severity(F.lit(value[0]), F.lit(value[1]))


# --- syslog priority -------------------------------------------------------


def _in_range(pri: Column) -> Column:
    return F.coalesce(pri.between(0, 191), F.lit(False))


def facility(pri: Column) -> Column:
    number = F.shiftright(pri, 3)
    names = F.array(*[F.lit(n) for n in FACILITIES])
    named = F.when(number < len(FACILITIES), F.get(names, number.cast("int")))
    return F.when(_in_range(pri), F.coalesce(named, number.cast("string"))).otherwise("unknown")


def level(pri: Column) -> Column:
    names = F.array(*[F.lit(n) for n in LEVELS])
    return F.when(_in_range(pri), F.get(names, pri.bitwiseAND(F.lit(7)).cast("int"))).otherwise(
        "unknown"
    )


def of_priority(pri: Column) -> Severity:
    """Level number to severity, composed from the two fixed tables."""
    table = {str(i): SCALE.get(name, DEFAULT) for i, name in enumerate(LEVELS)}
    number = F.when(_in_range(pri), pri.bitwiseAND(F.lit(7)).cast("string"))
    return lookup(number, table, DEFAULT)


# --- web and cloud ----------------------------------------------------------


def of_status(status: Column) -> Severity:
    """Status code alone."""
    exact = lookup(status, STATUS_EXACT, STATUS_OTHER)
    by_class = lookup(F.substring(status, 1, 1), STATUS_CLASS, STATUS_OTHER)
    return choose((status.isin(*STATUS_EXACT), exact), otherwise=by_class)


def of_request(status: Column, path: Column | None) -> Severity:
    """Status code, raised for sensitive paths and for refused access."""
    high = word("high")
    branches = [(status.isin("401", "403"), high)]
    if path is not None:
        low = F.lower(path)
        hit = F.lit(False)
        for p in SENSITIVE_PATHS:
            hit = hit | low.contains(p)
        branches.append((hit, high))
    return choose(*branches, otherwise=of_status(status))


def of_api_call(name: Column, error: Column) -> Severity:
    branches = [
        ((error != "") & (error != "-"), word("high")),
        (name.isin(*HIGH_VALUE_CALLS), word("high")),
    ]
    branches += [(name.startswith(p), word(s)) for p, s in CALL_PREFIXES.items()]
    return choose(*branches, otherwise=word("low"))


def confidence(code: Column) -> Column:
    """0-100 from the severity code; a missing or zero code counts as 5."""
    return F.least(F.lit(100), F.coalesce(F.nullif(code, F.lit(0)), F.lit(5)) * 10)
