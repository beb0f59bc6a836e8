"""Formats by name, and the hooks to add more."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.model import Shape
from logfathom.operators import cef, detect, leef, syslog, web
from logfathom.operators.cloudtrail import normalize_cloudtrail
from logfathom.operators.json_events import normalize_json
from logfathom.operators.windows import normalize_windows_xml
from logfathom.operators.zeek import normalize_zeek

DEFAULT = "syslog"


@dataclass(frozen=True)
class Parser:
    """``normalize`` turns rows of text into events. ``shape`` is given for
    formats that need nothing but a projection; ``comments`` says that lines
    starting with '#' are none."""

    normalize: Callable[..., DataFrame]
    shape: Callable[..., Shape] | None = None
    comments: bool = False


PARSERS: dict[str, Parser] = {
    "syslog": Parser(syslog.normalize_syslog, syslog.shape, comments=True),
    "cef": Parser(cef.normalize_cef, cef.shape),
    "leef": Parser(leef.normalize_leef, leef.shape),
    "json": Parser(normalize_json),
    "evtx": Parser(normalize_windows_xml),
    "aws_cloudtrail": Parser(normalize_cloudtrail),
    "nginx": Parser(web.normalize_web, web.shape, comments=True),
    "zeek": Parser(normalize_zeek),
}
_RULES: list[tuple[str, Callable[[Column], Column]]] = []


def register_parser(
    name: str,
    normalize: Callable[..., DataFrame],
    *,
    shape: Callable[..., Shape] | None = None,
    detect_rule: Callable[[Column], Column] | None = None,
) -> None:
    """Add a format. ``detect_rule`` maps a text column to a condition; rules
    of added formats are asked before the built-in ones."""
    PARSERS[name] = Parser(normalize, shape)
    if detect_rule is not None:
        _RULES.append((name, detect_rule))


def unregister_parser(name: str) -> None:
    PARSERS.pop(name, None)
    _RULES[:] = [r for r in _RULES if r[0] != name]


def parser_of(name: str) -> Parser:
    """The parser of a name; an unknown name is read as syslog."""
    return PARSERS.get(name, PARSERS[DEFAULT])


def format_of(text: Column, xml_sign: Column | None = None) -> Column:
    """Detected format, added rules first."""
    built_in = detect.detect_format(text, xml_sign)
    out = None
    for name, rule in _RULES:
        test = rule(text)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return built_in if out is None else out.otherwise(built_in)
