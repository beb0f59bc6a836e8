"""Web server access logs (combined and common) and error logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions import severity as sev
from logfathom.functions.text import filled, regex_stages, strip, to_int
from logfathom.functions.text import words as words_of
from logfathom.functions.times import SLASH_TIME, access_log_stages, slash_time
from logfathom.model import Shape, emit, fallback_fields, stage, text_map
from logfathom.sources.lines import clean_lines

# The three line layouts.
_CLIENT = r"(?U)(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"
_STATUS = r'\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
REQUEST = _CLIENT + r'"(\S+)\s+(\S+)\s+(\S+)"' + _STATUS
ODD_REQUEST = _CLIENT + r'"([^"]*)"' + _STATUS
ERROR = r"(?U)(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+[\d#]+:\s+(?:\*\d+\s+)?(.*)"


def shape(line: Column, when: Column | None = None) -> Shape:
    on = F.lit(True) if when is None else when
    req, odd, err = F.col("__web_req"), F.col("__web_odd"), F.col("__web_err")
    words, hit = F.col("__web_words"), F.col("__web_hit")
    is_req, is_odd, is_err = req.isNotNull(), odd.isNotNull(), err.isNotNull()
    is_hit = is_req | is_odd

    def word(i: int) -> Column:
        return F.coalesce(filled(F.get(words, F.lit(i))), F.lit("-"))

    # both request layouts brought to one array:
    # ip, user, time, status, size, referer, agent, method, path
    common = F.when(
        is_req, F.array(*[req[i] for i in (0, 1, 2, 6, 7, 8, 9, 3, 4)])
    ).when(is_odd, F.array(*[odd[i] for i in (0, 1, 2, 4, 5, 6, 7)], word(0), word(1)))
    ip, user, at, status, size, referer, agent, method, path = (hit[i] for i in range(9))
    version = req[5]
    plain = sev.of_request(status, None)
    raised = sev.of_request(status, path)
    logged = sev.normalize(err[1])
    exts = [
        ("http_method", method), ("http_path", path), ("http_status", status),
        ("referer", referer), ("user_agent", agent), ("response_bytes", size),
    ]

    def side(i: int) -> Column:
        return F.when(is_req, raised[i]).when(is_odd, plain[i]).when(is_err, logged[i])

    fields = fallback_fields("nginx", line) | {
        "timestamp": F.when(is_hit, F.col("__web_time")).when(is_err, F.col("__web_errtime")),
        "source_ip": F.nullif(ip, F.lit("-")),
        "event_type": F.when(is_hit, "HTTP/Access").when(is_err, "HTTP/Error"),
        "event_action": F.when(is_hit, F.concat(method, F.lit(" "), status)).when(is_err, "error"),
        "severity": side(0),
        "severity_code": side(1),
        "username": F.nullif(user, F.lit("-")),
        "protocol": F.when(is_req, F.substring_index(version, "/", 1)),
        "bytes_out": to_int(size, "bigint"),
        "message": F.when(
            is_hit,
            F.concat(
                method, F.lit(" "), path, F.lit(" → "), status, F.lit(" from "), ip
            ),
        )
        .when(is_err, strip(err[2]))
        .otherwise(line),
        "extensions": F.when(is_req, text_map(*exts, ("http_version", version)))
        .when(is_odd, text_map(*exts, ("request_line", odd[3])))
        .when(is_err, text_map(("log_level", err[1]))),
    }
    stages = [
        *regex_stages("__web_req", line, REQUEST, 10, on),
        *regex_stages("__web_odd", line, ODD_REQUEST, 8, on & req.isNull()),
        *regex_stages("__web_err", line, ERROR, 3, on & req.isNull() & odd.isNull()),
        *regex_stages("__web_slash", err[0], SLASH_TIME, 6, is_err),
        {
            "__web_errtime": F.when(is_err, slash_time(err[0], F.col("__web_slash"))),
            "__web_words": F.when(is_odd, words_of(odd[3])),
        },
        {"__web_hit": common},
        {"__web_at": F.when(is_hit, strip(at))},
        *access_log_stages("__web_time", F.col("__web_at")),
    ]
    return Shape(fields, stages)


def normalize_web(
    df: DataFrame, line_col: str = "value", *, key: list[str] | None = None, keep: list[str] = ()
) -> DataFrame:
    plan = shape(F.col(line_col))
    return emit(stage(clean_lines(df, line_col, comments=True), plan.stages), plan.fields, key, keep)
