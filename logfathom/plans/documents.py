"""Queries: line scans, detection, routing, JSON, CloudTrail and Windows XML."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfathom.operators.cloudtrail import normalize_cloudtrail
from logfathom.operators.detect import detect_format, format_histogram
from logfathom.operators.json_events import normalize_json
from logfathom.operators.route import route_lines
from logfathom.operators.syslog import normalize_syslog
from logfathom.operators.windows import normalize_windows_xml
from logfathom.plans.facts import (
    COMMON,
    FACTS_SQL,
    ORDERS_SQL,
    expected,
    facts,
    order_facts,
    register,
    shown,
    table,
)
from logfathom.plans.lines import ACCESS, CEF, LEEF, SYSLOG_NEW, SYSLOG_OLD
from logfathom.session import cut_lineage
from logfathom.sources.documents import document_lines
from logfathom.sources.lines import clean_lines, explode_lines

# --- line scan ----------------------------------------------------------------

_CODES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
          0x202F, 0x205F, 0x3000]
_SPACES = " || ".join(f"chr({c})" for c in _CODES)
_BREAK = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"
_LINES = f"""SELECT doc_id, trim(line, {_SPACES}) AS value
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, {_BREAK})) AS line FROM documents)
    WHERE trim(line, {_SPACES}) <> ''"""


@register("line_scan", _LINES)
def line_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return clean_lines(explode_lines(docs, "text", ["doc_id"])).select("doc_id", "value")


@register(
    "fallback_lines",
    f"""WITH t AS ({_LINES}) SELECT doc_id, 'syslog' AS source_format, value AS message,
        value AS raw, CAST(NULL AS VARCHAR) AS severity FROM t WHERE NOT starts_with(value, '#')""",
)
def fallback_lines(spark, sf_dir):
    """Prose is no syslog: every line is kept as a bare event."""
    docs = table(spark, sf_dir, "documents")
    events = normalize_syslog(explode_lines(docs, "text", ["doc_id"]), keep=["doc_id"])
    return events.select("doc_id", "source_format", "message", "raw", "severity")


# --- detection -----------------------------------------------------------------

_VARIANTS = [
    ("'  {\"Records\":[{\"eventName\":\"x\"}]}'", "aws_cloudtrail"),
    ("'{\"a\":' || k || '}'", "json"),
    ("' [1]'", "json"),
    ("'Jan 1 gw CEF:0|a|b'", "cef"),
    ("repeat('x', 300) || ' CEF:0|a'", "syslog"),
    ("'leef:1.0|a'", "leef"),
    ("'text <Event xmlns=1>'", "evtx"),
    ("'<Event><System/></Event>'", "syslog"),
    ("'<34>1 x'", "syslog"),
    ("ip || ' -  ' || usr", None),
    ("'10.1.2.3 - - [x]'", "nginx"),
    ("'#separator x'", "zeek"),
    ("'#fields' || chr(9) || 'a'", "zeek"),
    ("'Nov 15 10:00:00 h a: b'", "syslog"),
    ("'2024/01/01 10:00:00 [error] 1#1: x'", "syslog"),
    ("'{\"eventSource\":1}' || repeat(' ', 2100) || '\"Records\"'", "json"),
]
_N = len(_VARIANTS)
_DETECT_TEXT = "CASE " + " ".join(f"WHEN id % {_N} = {i} THEN {t}" for i, (t, _) in enumerate(_VARIANTS)) + " END"
_DETECT_OUT = "CASE " + " ".join(
    f"WHEN id % {_N} = {i} THEN "
    + (f"'{f}'" if f else "CASE WHEN contains(ip, ':') THEN 'syslog' ELSE 'nginx' END")
    for i, (_, f) in enumerate(_VARIANTS)
) + " END"


@register("detect_lines", f"WITH {FACTS_SQL} SELECT id, {_DETECT_OUT} AS format FROM f")
def detect_lines(spark, sf_dir):
    rows = facts(spark, sf_dir).selectExpr("id", f"{_DETECT_TEXT} AS value")
    return rows.select("id", detect_format(F.col("value")).alias("format"))


@register(
    "format_histogram",
    f"""WITH {FACTS_SQL}, t AS (SELECT {_DETECT_OUT} AS format FROM f
        UNION ALL SELECT CASE
            WHEN (contains(b[:2000], '"eventName"') OR contains(b[:2000], '"eventSource"')) AND contains(b[:2000], '"Records"') THEN 'aws_cloudtrail'
            WHEN b[1] IN ('{{', '[') THEN 'json'
            WHEN contains(b[:200], 'CEF:') THEN 'cef' WHEN upper(b[:5]) = 'LEEF:' THEN 'leef'
            WHEN contains(b, '<Event ') OR contains(b, '<Events>') OR contains(b, 'schemas.microsoft.com/win/2004/08/events') THEN 'evtx'
            WHEN b[1] = '<' AND contains(b[:6], '>') THEN 'syslog'
            WHEN regexp_matches(b, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\s+-\\s+') THEN 'nginx'
            WHEN starts_with(b, '#separator') OR starts_with(b, '#path') OR starts_with(b, '#fields') THEN 'zeek'
            ELSE 'syslog' END
        FROM (SELECT trim(text, {_SPACES}) AS b FROM documents UNION ALL
              SELECT trim(html, {_SPACES}) FROM pages))
    SELECT format, count(*) AS n FROM t GROUP BY format""",
)
def histogram(spark, sf_dir):
    rows = facts(spark, sf_dir).selectExpr(f"{_DETECT_TEXT} AS value")
    texts = table(spark, sf_dir, "documents").selectExpr("text AS value")
    pages = table(spark, sf_dir, "pages").selectExpr("html AS value")
    every = rows.unionByName(texts).unionByName(pages)
    return format_histogram(every.select(detect_format(F.col("value")).alias("format")))


# --- routing -------------------------------------------------------------------

_MIX = {0: SYSLOG_NEW, 1: CEF, 2: LEEF, 3: ACCESS, 4: SYSLOG_OLD}
_MIX_NAMES = {0: "syslog", 1: "cef", 2: "leef", 3: "nginx", 4: "syslog"}


def _routed_sql() -> str:
    parts = []
    for i, spec in _MIX.items():
        parts.append(
            f"SELECT *, '{_MIX_NAMES[i]}' AS source_format FROM ({spec.select(f'id % 6 = {i}', with_extra=False)})"
        )
    parts.append(
        "SELECT *, 'json' AS source_format FROM ("
        + expected({"username": "usr", "severity": "'high'", "severity_code": "7"}, where="id % 6 = 5")
        + ")"
    )
    return f"WITH {FACTS_SQL} " + " UNION ALL ".join(parts)


@register("route_lines", _routed_sql())
def route(spark, sf_dir):
    text = "CASE " + " ".join(f"WHEN id % 6 = {i} THEN {s.render}" for i, s in _MIX.items())
    text += " ELSE '{\"user\":\"' || usr || '\",\"level\":\"error\"}' END"
    names = "CASE " + " ".join(f"WHEN id % 6 = {i} THEN '{n}'" for i, n in _MIX_NAMES.items()) + " ELSE 'json' END"
    # the rendered lines as a table of their own, as a topic or landing table is
    rows = cut_lineage(
        facts(spark, sf_dir).selectExpr("id", f"{text} AS value", f"{names} AS fmt"), "mixed-lines"
    )
    events = route_lines(
        rows, fmt_col="fmt", reference_date=F.lit("2024-01-20").cast("date"), key=["id"], keep=["id"]
    )
    return events.select("id", "source_format", *COMMON)


@register(
    "route_detected",
    f"""WITH {FACTS_SQL} SELECT id,
        CASE id % 5 WHEN 0 THEN 'cef' WHEN 1 THEN 'json' WHEN 2 THEN 'nginx' WHEN 3 THEN 'evtx' ELSE 'syslog' END AS source_format,
        CASE id % 5 WHEN 0 THEN 'a/b' WHEN 1 THEN et WHEN 2 THEN 'HTTP/Access' WHEN 3 THEN 'Authentication' END AS event_type,
        CASE id % 5 WHEN 0 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN 'low' END AS severity
        FROM f""",
)
def route_detected(spark, sf_dir):
    """Formats detected per line, among them whole XML documents."""
    text = """CASE id % 5 WHEN 0 THEN 'CEF:0|a|b|1|2|n|7|src=1.2.3.4' WHEN 1 THEN '{"type":"' || et || '"}'
        WHEN 2 THEN '1.2.3.4 - - [x] "GET / HTTP/1.0" 200 1'
        WHEN 3 THEN '<Events><Event xmlns="n"><System><EventID>4624</EventID></System></Event></Events>'
        ELSE 'words ' || id END"""
    rows = facts(spark, sf_dir).selectExpr("id", f"{text} AS value")
    events = route_lines(rows, key=["id"], keep=["id"])
    return events.select("id", "source_format", "event_type", "severity")


# --- JSON ----------------------------------------------------------------------

_JSON = """CASE WHEN id % 12 = 0 THEN '{"a":' || id || '} tail' WHEN id % 12 = 1 THEN '{"a":' || id
    WHEN id % 12 = 2 THEN CAST(id AS STRING)
    WHEN id % 12 = 3 THEN '{"timestamp":"' || iso || '","@timestamp":"' || iso || 'Z","src_ip":"9.9.9.9","client_ip":"' || ip || '","user":"u","userName":"' || usr || '","severity":"low","level":"error","x":1}'
    WHEN id % 12 = 4 THEN '{"source":{"ip":"' || ip || '","port":' || sport || '},"destination":{"ip":"' || dst || '","port":"' || dport || '"},"user":{"name":"' || usr || '","id":' || u || '},"event":{"type":"' || et || '","action":"act' || k || '","category":"c"},"process":{"name":"p","pid":1.9},"log":{"level":"critical"},"message":"m ' || k || '"}'
    WHEN id % 12 = 5 THEN '{"src_port":"abc","dst_port":443.7,"pid":" 12 ","bytes_in":null,"bytes_out":true,"type":"t","eventType":null,"msg":"first","body":"last"}'
    WHEN id % 12 = 6 THEN '[{"action":"a' || k || '"},5,{"action":"b' || k || '"}]'
    WHEN id % 12 = 7 THEN '{"events":[{"msg":"in"}],"hits":[]}'
    WHEN id % 12 = 8 THEN '{"hits":{"x":1},"data":[{"msg":"d' || k || '"},"s"]}'
    WHEN id % 12 = 9 THEN '{"source.ip":"' || ip || '","msg":"{braces","a":1,"a":2,"severity":' || (k % 12) || '}'
    WHEN id % 12 = 10 THEN '{"host":["h1","h2"],"actor":{"login":"' || usr || '"},"user":{"deep":{"x":1}},"network":{"protocol":"udp"}}'
    ELSE '{"Records":"none","logs":[{"log":"line"}],"items":[{"log":"no"}]}' END"""


def _when(values: dict[int, str]) -> str:
    return "CASE " + " ".join(f"WHEN id % 12 = {i} THEN {v}" for i, v in values.items()) + " END"


_JSON_OUT = {
    "timestamp": _when({3: "iso || 'Z'"}),
    "source_host": _when({10: "'[\"h1\",\"h2\"]'"}),
    "source_ip": _when({3: "ip", 4: "ip", 9: "ip"}),
    "source_port": _when({4: "sport"}),
    "dest_ip": _when({4: "dst"}),
    "dest_port": _when({4: "dport", 5: "443"}),
    "event_type": _when({4: "et", 5: "'t'"}),
    "event_action": _when({4: "'act' || k", 6: "letter || k"}),
    "severity": _when({3: "'high'", 4: "'critical'", 9: "(['low','low','low','medium','medium','medium','high','high','critical','critical','critical','medium'])[k % 12 + 1]"}),
    "severity_code": _when({3: "7", 4: "10", 9: "([1,2,3,4,5,6,7,8,9,10,10,5])[k % 12 + 1]"}),
    "category": _when({4: "'c'"}),
    "username": _when({3: "usr", 4: "usr", 10: "usr"}),
    "user_id": _when({4: "CAST(u AS VARCHAR)"}),
    "process_name": _when({4: "'p'"}),
    "process_id": _when({4: "1", 5: "12"}),
    "protocol": _when({10: "'udp'"}),
    "bytes_out": _when({5: "1"}),
    "message": _when({4: "'m ' || k", 5: "'last'", 7: "'in'", 8: "'d' || k", 9: "'{braces'", 11: "'line'",
                      0: "'{\"a\":' || id || '} tail'", 1: "'{\"a\":' || id"}),
}
_JSON_EXTRA = {
    "x": ("x", _when({3: "'1'"})),
    "port_text": ("src_port", _when({5: "'abc'"})),
    "user_text": ("user", _when({4: "'{\"id\":' || u || ',\"name\":\"' || usr || '\"}'", 10: "'{\"deep\":{\"x\":1}}'"})),
    "a": ("a", _when({9: "'2'"})),
}


@register(
    "json_records",
    f"""WITH {FACTS_SQL}, r AS (SELECT *, unnest(CASE WHEN id % 12 = 2 THEN []
            WHEN id % 12 = 6 THEN ['a', 'b'] ELSE ['a'] END) AS letter FROM f)
        {expected(_JSON_OUT, "r", extra={n: v for n, (_, v) in _JSON_EXTRA.items()})}""",
)
def json_records(spark, sf_dir):
    """Aliases, nesting, wrappers, lists, duplicates, corrupt lines and scalars."""
    rows = facts(spark, sf_dir).selectExpr("id", f"{_JSON} AS value")
    events = normalize_json(rows, key=["id"], keep=["id"])
    return shown(events, {n: k for n, (k, _) in _JSON_EXTRA.items()})


_DOC = """CASE WHEN id % 4 = 0 THEN '[{"msg":"a' || k || '"},' || chr(10) || '{"msg":"b"}]'
    WHEN id % 4 = 1 THEN '{"msg":"l1"}' || chr(10) || 'broken ' || k || chr(10) || '  ' || chr(10) || '{"msg":"l2"}'
    WHEN id % 4 = 2 THEN '{' || chr(10) || '"msg":"m' || k || '"' || chr(10) || '}' ELSE '"scalar"' END"""


@register(
    "json_documents",
    f"""WITH {FACTS_SQL} SELECT id, unnest(CASE WHEN id % 4 = 0 THEN ['a' || k, 'b']
        WHEN id % 4 = 1 THEN ['l1', 'broken ' || k, 'l2'] WHEN id % 4 = 2 THEN ['m' || k] ELSE [] END) AS message
        FROM f""",
)
def json_documents(spark, sf_dir):
    """Whole documents first, then line by line where a text is no document."""
    rows = facts(spark, sf_dir).selectExpr("id", f"{_DOC} AS value")
    events = normalize_json(document_lines(rows, "value"), key=["id", "seq"], keep=["id"])
    return events.select("id", "message")


# --- CloudTrail ------------------------------------------------------------------

_CALLS = ("ConsoleLogin", "DeleteBucket", "RemoveX", "TerminateInstances", "DetachVolume", "DisableKey",
          "CreateUser", "CreateX", "PutObject", "DescribeX", "FailedY", "UnauthorizedZ", "ConsoleX", "Other", "StopLogging")
_CALL_LIST = ", ".join(f"'{c}'" for c in _CALLS)
_S_CALL = f"element_at(array({_CALL_LIST}), CAST(id % 15 + 1 AS INT))"
_D_CALL = f"([{_CALL_LIST}])[id % 15 + 1]"
_S_ERR = "CASE WHEN id % 7 = 0 THEN ',\"errorCode\":\"AccessDenied\"' WHEN id % 7 = 1 THEN ',\"errorCode\":\"-\",\"errorMessage\":\"odd\"' ELSE '' END"
_REC = f"""'{{"eventName":"' || {_S_CALL} || '","eventTime":"' || day || 'T00:00:00Z"'
    || CASE WHEN id % 5 = 0 THEN '' ELSE ',"eventSource":"' || CASE WHEN id % 5 = 1 THEN 'iam.amazonaws.com' ELSE 's3' END || '"' END
    || ',"sourceIPAddress":"' || CASE WHEN id % 6 = 0 THEN 'cloud.amazonaws.com' ELSE '10.1.1.' || (c % 250) END || '"'
    || CASE WHEN id % 4 = 0 THEN ',"userIdentity":{{"type":"Root"}}'
            WHEN id % 4 = 1 THEN ',"userIdentity":{{"userName":"u' || c || '","accountId":"' || c || '"}}'
            WHEN id % 4 = 2 THEN ',"userIdentity":{{"principalId":"A:B:p' || c || '","type":"T"}}'
            ELSE ',"userIdentity":{{"sessionContext":{{"sessionIssuer":{{"userName":"iss' || c || '"}}}}}}' END
    || {_S_ERR} || ',"requestParameters":{{"b":' || c || '}}}}'"""
_TRAIL = f"""CASE WHEN id % 9 = 0 THEN 'not json ' || id WHEN id % 9 = 1 THEN '[' || {_REC} || ',7]'
    WHEN id % 9 = 2 THEN '{{"Records":[' || {_REC} || ',' || {_REC} || ']}}'
    WHEN id % 9 = 3 THEN '{{"events":[' || {_REC} || ']}}' WHEN id % 9 = 4 THEN '{{"Records":{{}},"events":[' || {_REC} || ']}}'
    ELSE {_REC} END"""
_CT_USER = "CASE WHEN id % 4 = 0 THEN 'Root' WHEN id % 4 = 1 THEN 'u' || c WHEN id % 4 = 2 THEN 'p' || c ELSE 'iss' || c END"
_CT_IP = "CASE WHEN id % 6 = 0 THEN 'cloud.amazonaws.com' ELSE '10.1.1.' || (c % 250) END"
_CT_SEV = f"""CASE WHEN id % 7 = 0 THEN 'high' ELSE
    (['high','high','high','high','medium','high','high','low','low','low','critical','critical','medium','low','high'])[id % 15 + 1] END"""


@register(
    "cloudtrail",
    f"""WITH {ORDERS_SQL}, r AS (SELECT *, unnest(CASE WHEN id % 9 IN (0, 4) THEN []
        WHEN id % 9 = 2 THEN [1, 2] ELSE [1] END) AS part FROM o)
        {expected({
            "timestamp": "day || 'T00:00:00Z'",
            "source_ip": "CASE WHEN id % 6 <> 0 THEN '10.1.1.' || (c % 250) END",
            "event_type": "'AWS/' || CASE WHEN id % 5 = 0 THEN 'CloudTrail' WHEN id % 5 = 1 THEN 'IAM' ELSE 'S3' END",
            "event_action": _D_CALL,
            "severity": _CT_SEV,
            "severity_code": f"CASE {_CT_SEV} WHEN 'high' THEN 7 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 10 END",
            "username": _CT_USER,
            "message": f"CASE WHEN id % 7 = 0 THEN 'AWS ' || {_D_CALL} || ' FAILED (AccessDenied): no details' "
                       f"WHEN id % 7 = 1 THEN 'AWS ' || {_D_CALL} || ' FAILED (-): odd' "
                       f"ELSE 'AWS ' || {_D_CALL} || ' by ' || {_CT_USER} || ' from ' || {_CT_IP} END",
        }, "r", extra={
            "account": "CASE WHEN id % 4 = 1 THEN c END",
            "kind": "'AwsApiCall'",
            "params": "'{\"b\":' || c || '}'",
            "error_code": "CASE WHEN id % 7 = 0 THEN 'AccessDenied' WHEN id % 7 = 1 THEN '-' ELSE '' END",
        })}""",
)
def cloudtrail(spark, sf_dir):
    rows = order_facts(spark, sf_dir).selectExpr("id", f"{_TRAIL} AS value")
    events = normalize_cloudtrail(rows, key=["id"], keep=["id"])
    return shown(events, {"account": "account_id", "kind": "event_type", "params": "request_params",
                          "error_code": "error_code"})


# --- Windows XML -------------------------------------------------------------------

_IDS = "'4624','4625','4688','7045','1102','999'"
_S_WID = f"element_at(array({_IDS}), CAST(id % 6 + 1 AS INT))"
_D_WID = f"([{_IDS}])[id % 6 + 1]"
_XML = f"""'<Event xmlns="n"><System><EventID Qualifiers="1">' || {_S_WID} || '</EventID>'
    || CASE WHEN id % 7 = 6 THEN '' ELSE '<Level>' || (id % 7) || '</Level>' END
    || '<TimeCreated SystemTime="' || day || 'T01:02:03.000000000Z"/>'
    || CASE WHEN id % 4 = 0 THEN '' ELSE '<Computer>PC' || (c % 9) || '</Computer>' END
    || CASE WHEN id % 3 = 0 THEN '' ELSE '<Channel>Security</Channel>' END
    || '<Provider Name="Prov"/></System><EventData>'
    || '<Data Name="SubjectUserName">' || CASE WHEN id % 5 = 0 THEN '' ELSE ' su' || c || ' ' END || '</Data>'
    || '<Data Name="TargetUserName">tu' || c || '</Data><Data>loose</Data>'
    || CASE WHEN id % 8 = 0 THEN '' ELSE '<Data Name="IpAddress">10.9.8.' || (c % 250) || '</Data>' END
    || '<Data Name="IpPort">' || CASE WHEN id % 10 = 0 THEN '-' WHEN id % 10 = 1 THEN '0' ELSE CAST(1000 + c % 60000 AS STRING) END || '</Data>'
    || '<Data Name="ProcessId">' || CASE WHEN id % 11 = 0 THEN 'zz' WHEN id % 2 = 0 THEN '0x1F' ELSE CAST(c AS STRING) END || '</Data>'
    || '<Data Name="ProcessName">C:\\\\p&amp;q.exe</Data></EventData></Event>'"""
_XML_DOC = f"""CASE WHEN id % 13 = 0 THEN '<Event><System></System></Event>' WHEN id % 13 = 1 THEN '<Event><System><EventID>1</System></Event>'
    WHEN id % 13 = 2 THEN 'plain ' || id WHEN id % 13 = 3 THEN '<?xml version="1.0"?><Events>' || {_XML} || chr(10) || {_XML} || '</Events>'
    ELSE {_XML} END"""
_W_TEXT = "CASE WHEN id % 13 = 0 THEN '<Event><System></System></Event>' WHEN id % 13 = 1 THEN '<Event><System><EventID>1</System></Event>' ELSE 'plain ' || id END"
_W_USER = "CASE WHEN id % 5 = 0 THEN 'tu' || c ELSE 'su' || c END"
_W_ACTION = "(['logon_success','logon_failure','process_created','new_service_installed','audit_log_cleared','EventID-999'])[id % 6 + 1]"
_W_SEV = "CASE WHEN id % 7 = 1 THEN 'critical' WHEN id % 7 = 2 THEN 'high' WHEN id % 7 = 3 THEN 'medium' ELSE 'low' END"


@register(
    "windows_xml",
    f"""WITH {ORDERS_SQL}, r AS (SELECT *, unnest(CASE WHEN id % 13 = 3 THEN [1, 2] ELSE [1] END) AS part FROM o)
        {expected({
            "timestamp": "day || 'T01:02:03.000000000Z'",
            "source_host": "CASE WHEN id % 4 <> 0 THEN 'PC' || (c % 9) END",
            "source_ip": "CASE WHEN id % 8 <> 0 THEN '10.9.8.' || (c % 250) END",
            "source_port": "CASE WHEN id % 10 > 1 THEN 1000 + c % 60000 END",
            "event_type": "(['Authentication','Authentication','Process','Service','Audit',"
                          "CASE WHEN id % 3 = 0 THEN 'Windows' ELSE 'Security' END])[id % 6 + 1]",
            "event_action": _W_ACTION,
            "severity": _W_SEV,
            "severity_code": f"CASE {_W_SEV} WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 5 ELSE 2 END",
            "username": _W_USER,
            "process_name": "'C:\\p&q.exe'",
            "process_id": "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 2 = 0 THEN 31 ELSE c END",
            "message": f"'Windows Event ' || {_D_WID} || ': ' || {_W_ACTION} || ' | user=' || {_W_USER} "
                       "|| CASE WHEN id % 4 <> 0 THEN ' | host=PC' || (c % 9) ELSE '' END "
                       "|| CASE WHEN id % 8 <> 0 THEN ' | src=10.9.8.' || (c % 250) ELSE '' END",
        }, "r", fallback="id % 13 <= 2", text=_W_TEXT, extra={
            "level": "CASE WHEN id % 7 = 6 THEN '4' ELSE CAST(id % 7 AS VARCHAR) END",
            "provider": "'Prov'",
            "subject": "CASE WHEN id % 5 = 0 THEN '' ELSE 'su' || c END",
        })}""",
)
def windows_xml(spark, sf_dir):
    rows = order_facts(spark, sf_dir).selectExpr("id", f"{_XML_DOC} AS value")
    events = normalize_windows_xml(rows, key=["id"], keep=["id"])
    return shown(events, {"level": "level", "provider": "provider", "subject": "SubjectUserName"})


