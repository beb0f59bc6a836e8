"""Queries: line formats."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.operators.cef import normalize_cef
from logfathom.operators.leef import normalize_leef
from logfathom.operators.syslog import normalize_syslog
from logfathom.operators.web import normalize_web
from logfathom.operators.zeek import normalize_zeek
from logfathom.plans.facts import FACTS_SQL, expected, facts, register, shown

REFERENCE_DAY = "2024-01-20"


@dataclass
class Format:
    """Rendered text of a format and what must come out of it."""

    render: str
    columns: dict[str, str]
    fallback: str = "FALSE"
    text: str = "NULL"
    where: str = "TRUE"
    extra: dict[str, tuple[str, str]] = field(default_factory=dict)

    def lines(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return facts(spark, sf_dir).selectExpr("id", f"{self.render} AS value")

    def keys(self) -> dict[str, str]:
        return {n: key for n, (key, _) in self.extra.items()}

    def select(self, where: str = "TRUE", with_extra: bool = True) -> str:
        return expected(
            self.columns, fallback=self.fallback, text=self.text,
            extra={n: v for n, (_, v) in self.extra.items()} if with_extra else {},
            where=f"({self.where}) AND ({where})",
        )

    def oracle(self) -> str:
        return f"WITH {FACTS_SQL} {self.select()}"


# --- syslog --------------------------------------------------------------------

_P = "(CASE WHEN id % 31 = 0 THEN 9999999 ELSE id % 200 END)"
_LEVEL = "(['critical','critical','critical','high','medium','low','low','low'])"
_CODE = "([10,9,10,7,5,2,1,1])"
_FAC = (
    "(['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp',"
    "'local0','local1','local2','local3','local4','local5','local6','local7'])"
)
_FACILITY = (
    f"CASE WHEN {_P} > 191 THEN 'unknown' "
    f"ELSE coalesce({_FAC}[{_P} // 8 + 1], CAST({_P} // 8 AS VARCHAR)) END"
)
_SYSLOG_SEV = {
    "severity": f"CASE WHEN {_P} > 191 THEN 'medium' ELSE {_LEVEL}[{_P} % 8 + 1] END",
    "severity_code": f"CASE WHEN {_P} > 191 THEN 5 ELSE {_CODE}[{_P} % 8 + 1] END",
    "event_type": f"'syslog/' || {_FACILITY}",
}
_MSG = "'login ' || et || ' [x] k=' || k"

SYSLOG_NEW = Format(
    render=f"""CASE WHEN id % 23 = 0 THEN '# note ' || id WHEN id % 23 = 1 THEN '   '
        WHEN id % 9 = 6 THEN '  plain text ' || id || ' '
        ELSE CASE WHEN id % 9 = 7 THEN '  ' ELSE '' END || '<' || {_P} || '>1 '
          || CASE WHEN id % 9 = 0 THEN '-' ELSE iso || 'Z' END || ' '
          || CASE WHEN id % 9 = 1 THEN '-' ELSE host END || ' '
          || CASE WHEN id % 9 = 2 THEN '-' ELSE 'app' || (k % 5) END || ' '
          || CASE WHEN id % 9 = 3 THEN '-' WHEN id % 9 = 4 THEN 'abc' ELSE CAST(id AS STRING) END
          || ' ID' || k || ' '
          || CASE WHEN id % 9 = 5 THEN '[a@1 b="c"][second] ' ELSE '-  ' END
          || {_MSG} || CASE WHEN id % 9 = 7 THEN '  ' ELSE '' END END""",
    columns=_SYSLOG_SEV
    | {
        "timestamp": "CASE WHEN id % 9 <> 0 THEN iso || 'Z' END",
        "source_host": "CASE WHEN id % 9 <> 1 THEN host END",
        "event_action": "CASE WHEN id % 9 <> 2 THEN 'app' || (k % 5) END",
        "process_name": "CASE WHEN id % 9 <> 2 THEN 'app' || (k % 5) END",
        "process_id": "CASE WHEN id % 9 NOT IN (3, 4) THEN id END",
        "message": f"CASE WHEN id % 9 = 5 THEN '[second] ' ELSE '' END || {_MSG}",
    },
    fallback="id % 9 = 6",
    text="'plain text ' || id",
    where="id % 23 NOT IN (0, 1)",
    extra={
        "facility": ("facility", _FACILITY),
        "msgid": ("msgid", "'ID' || k"),
        "sd": ("structured_data", "CASE WHEN id % 9 = 5 THEN '[a@1 b=\"c\"]' ELSE '-' END"),
    },
)
_TAG = "'sshd[' || (id % 999) || ']'"
SYSLOG_OLD = Format(
    render=f"""CASE WHEN id % 9 = 4 THEN '<' || {_P} || '>Jan only ' || id
        ELSE '<' || {_P} || '>'
          || CASE WHEN id % 9 = 1 THEN 'Feb 30 ' WHEN id % 9 = 2 THEN 'Jan  5 '
                  WHEN id % 9 = 3 THEN 'Dec 31 ' WHEN id % 9 = 5 THEN 'Feb 29 '
                  WHEN id % 9 = 6 THEN 'Foo 11 ' ELSE mon || ' ' || dd || ' ' END
          || hms || ' ' || host || ' ' || {_TAG} || ': ' || {_MSG} END""",
    columns=_SYSLOG_SEV
    | {
        "timestamp": """CASE WHEN id % 9 = 1 THEN 'Feb 30 ' || hms WHEN id % 9 = 2 THEN '2024-01-05T' || hms
            WHEN id % 9 = 3 THEN '2023-12-31T' || hms WHEN id % 9 = 5 THEN 'Feb 29 ' || hms
            WHEN id % 9 = 6 THEN 'Foo 11 ' || hms
            ELSE (CASE WHEN CAST(dd AS INTEGER) > 21 THEN '2023' ELSE '2024' END) || '-01-' || dd || 'T' || hms END""",
        "source_host": "host",
        "event_action": _TAG,
        "process_name": _TAG,
        "message": _MSG,
    },
    fallback="id % 9 = 4",
    text=f"'<' || {_P} || '>Jan only ' || id",
    extra={"facility": ("facility", _FACILITY)},
)


@register("syslog5424", SYSLOG_NEW.oracle())
def syslog5424(spark, sf_dir):
    return shown(normalize_syslog(SYSLOG_NEW.lines(spark, sf_dir), keep=["id"]), SYSLOG_NEW.keys())


@register("syslog3164", SYSLOG_OLD.oracle())
def syslog3164(spark, sf_dir):
    events = normalize_syslog(
        SYSLOG_OLD.lines(spark, sf_dir),
        reference_date=F.lit(REFERENCE_DAY).cast("date"),
        keep=["id"],
    )
    return shown(events, SYSLOG_OLD.keys())


# --- CEF --------------------------------------------------------------------------

_CEF_NAME = "'Rule ' || (k % 7)"
CEF = Format(
    render=f"""CASE WHEN id % 5 = 0 THEN 'Jan 1 10:00:00 gw ' ELSE '' END
        || 'CEF:0|Acme|Wall|1.' || (k % 3) || '|' || k || '|' || {_CEF_NAME} || '|'
        || CASE WHEN id % 29 = 0 THEN 'High' ELSE CAST(id % 12 AS STRING) END || '|'
        || 'rt=' || iso || ' src=' || ip || ' spt=' || sport || ' dst=' || dst
        || ' dpt=' || CASE WHEN id % 7 = 0 THEN 'abc' ELSE CAST(dport AS STRING) END
        || CASE WHEN id % 3 = 0 THEN ' start=S' || iso ELSE '' END
        || CASE WHEN id % 4 = 0 THEN '' ELSE ' act=' || et END
        || '  proto=TCP in=' || id || ' out=' || (id * 3) || ' cat=c' || (k % 4)
        || ' suser=' || usr || ' suser=' || usr || 'x spid=' || k || ' sproc=p ' || k
        || ' duser=root dvchost=' || host || ' cs1Label=a=b  c'
        || CASE WHEN id % 6 = 0 THEN '' ELSE ' msg=Found ' || et || ' at ' || k END""",
    columns={
        "timestamp": "CASE WHEN id % 3 = 0 THEN 'S' ELSE '' END || iso",
        "source_host": "host",
        "source_ip": "ip",
        "source_port": "sport",
        "dest_ip": "dst",
        "dest_port": "CASE WHEN id % 7 <> 0 THEN dport END",
        "event_type": "'Acme/Wall'",
        "event_action": f"CASE WHEN id % 4 = 0 THEN {_CEF_NAME} ELSE et END",
        "severity": """CASE WHEN id % 12 <= 2 THEN 'low' WHEN id % 12 <= 5 THEN 'medium'
            WHEN id % 12 <= 7 THEN 'high' WHEN id % 12 <= 10 THEN 'critical' ELSE 'medium' END""",
        "severity_code": "([1,2,3,4,5,6,7,8,9,10,10,5])[id % 12 + 1]",
        "category": "'c' || (k % 4)",
        "username": "usr || 'x'",
        "process_name": "'p ' || k",
        "process_id": "k",
        "protocol": "'TCP'",
        "bytes_in": "id",
        "bytes_out": "id * 3",
        "message": f"CASE WHEN id % 6 = 0 THEN {_CEF_NAME} || ' from ' || ip "
        "ELSE 'Found ' || et || ' at ' || k END",
    },
    fallback="id % 29 = 0",
    text=f"""CASE WHEN id % 5 = 0 THEN 'Jan 1 10:00:00 gw ' ELSE '' END
        || 'CEF:0|Acme|Wall|1.' || (k % 3) || '|' || k || '|' || {_CEF_NAME} || '|High|'
        || 'rt=' || iso || ' src=' || ip || ' spt=' || sport || ' dst=' || dst
        || ' dpt=' || CASE WHEN id % 7 = 0 THEN 'abc' ELSE CAST(dport AS VARCHAR) END
        || CASE WHEN id % 3 = 0 THEN ' start=S' || iso ELSE '' END
        || CASE WHEN id % 4 = 0 THEN '' ELSE ' act=' || et END
        || '  proto=TCP in=' || id || ' out=' || (id * 3) || ' cat=c' || (k % 4)
        || ' suser=' || usr || ' suser=' || usr || 'x spid=' || k || ' sproc=p ' || k
        || ' duser=root dvchost=' || host || ' cs1Label=a=b  c'
        || CASE WHEN id % 6 = 0 THEN '' ELSE ' msg=Found ' || et || ' at ' || k END""",
    extra={
        "duser": ("duser", "'root'"),
        "label": ("cs1Label", "'a=b  c'"),
        "dpt_text": ("dpt", "CASE WHEN id % 7 = 0 THEN 'abc' END"),
        "spt_text": ("spt", "NULL"),
        "version": ("device_version", "'1.' || (k % 3)"),
    },
)


@register("cef", CEF.oracle())
def cef(spark, sf_dir):
    return shown(normalize_cef(CEF.lines(spark, sf_dir), keep=["id"]), CEF.keys())


# --- LEEF -------------------------------------------------------------------------


def _attrs(sep: str) -> str:
    return sep.join(
        [
            "'src=' || ip", "'srcPort=' || sport", "'dst=' || dst",
            "'dstPort=' || CASE WHEN id % 9 = 0 THEN 'n/a' ELSE CAST(dport AS STRING) END",
            "'usrName=' || usr", "'proto=UDP'", "'srcBytes=' || id", "'devTimeFormat=x'",
            "CASE WHEN id % 5 = 0 THEN 'severity=' || (k % 9) WHEN id % 5 = 1 THEN 'none' "
            "ELSE 'sev=' || (k % 11) END",
        ]
    ).replace(sep, f" || {sep} || ")


_HEAD = "'|Acme|Trap|3|E' || (k % 6) || '|'"
# rest of the header per id % 9: how the delimiter is named
_LEEF_FIRST_LOST = "id % 8 = 7"
_LEEF_ALL_LOST = "id % 8 = 4"


def _leef(value: str) -> str:
    return f"CASE WHEN {_LEEF_ALL_LOST} THEN NULL ELSE {value} END"


_LEEF_SEV = (
    f"CASE WHEN {_LEEF_ALL_LOST} OR id % 5 = 1 THEN '5' "
    "WHEN id % 5 = 0 THEN CAST(k % 9 AS VARCHAR) ELSE CAST(k % 11 AS VARCHAR) END"
)
_LEEF_IP = f"CASE WHEN {_LEEF_ALL_LOST} OR {_LEEF_FIRST_LOST} THEN NULL ELSE ip END"
LEEF = Format(
    render=f"""CASE WHEN id % 37 = 0 THEN 'LEEF:3.0|odd ' || id
        WHEN id % 8 = 0 THEN 'LEEF:1.0' || {_HEAD} || chr(9) || {_attrs("chr(9)")}
        WHEN id % 8 = 1 THEN 'leef:2.0' || {_HEAD} || '^' || chr(9) || {_attrs("chr(9)")}
        WHEN id % 8 = 2 THEN 'LEEF:2.0' || {_HEAD} || '0x7C|' || {_attrs("'|'")}
        WHEN id % 8 = 3 THEN 'LEEF:2.0' || {_HEAD} || '0x5e' || {_attrs("'^'")}
        WHEN id % 8 = 4 THEN 'LEEF:2.0' || {_HEAD} || 'x7C|' || {_attrs("'|'")}
        WHEN id % 8 = 5 THEN 'LEEF:2.0' || {_HEAD} || ';' || {_attrs("';'")}
        WHEN id % 8 = 6 THEN 'LEEF:2.0' || {_HEAD} || {_attrs("'  '")}
        ELSE 'LEEF:2.0' || {_HEAD} || '^|' || {_attrs("chr(9)")} END""",
    columns={
        "source_ip": _LEEF_IP,
        "source_port": _leef("sport"),
        "dest_ip": _leef("dst"),
        "dest_port": _leef("CASE WHEN id % 9 <> 0 THEN dport END"),
        "event_type": "'Acme/Trap'",
        "event_action": "'E' || (k % 6)",
        "severity": f"""CASE WHEN CAST({_LEEF_SEV} AS INTEGER) <= 2 THEN 'low'
            WHEN CAST({_LEEF_SEV} AS INTEGER) <= 5 THEN 'medium'
            WHEN CAST({_LEEF_SEV} AS INTEGER) <= 7 THEN 'high' ELSE 'critical' END""",
        "severity_code": f"([1,2,3,4,5,6,7,8,9,10,10])[CAST({_LEEF_SEV} AS INTEGER) + 1]",
        "username": _leef("usr"),
        "protocol": _leef("'UDP'"),
        "bytes_in": _leef("id"),
        "message": f"""'E' || (k % 6) || coalesce(' | from ' || ({_LEEF_IP}), '')
            || coalesce(' | user ' || ({_leef("usr")}), '')""",
    },
    fallback="id % 37 = 0",
    text="'LEEF:3.0|odd ' || id",
    extra={
        # a word without '=' belongs to the value before it when white space separates
        "time_format": ("devTimeFormat", _leef("CASE WHEN id % 8 = 6 AND id % 5 = 1 THEN 'x  none' ELSE 'x' END")),
        "first_text": ("|src", f"CASE WHEN {_LEEF_FIRST_LOST} THEN ip END"),
        "dst_text": ("dstPort", _leef("CASE WHEN id % 9 = 0 THEN 'n/a' END")),
        "sev_text": ("severity", _leef("CASE WHEN id % 5 = 0 THEN k % 9 END")),
    },
)
# where the delimiter is misread, everything is one value of one key
LEEF.extra["first_text"] = (
    "|src",
    f"""CASE WHEN {_LEEF_FIRST_LOST} THEN ip WHEN {_LEEF_ALL_LOST} THEN {_attrs("'|'").replace("STRING", "VARCHAR").replace("'src=' || ip", "ip", 1)} END""",
)


@register("leef_delimiters", LEEF.oracle())
def leef_delimiters(spark, sf_dir):
    return shown(normalize_leef(LEEF.lines(spark, sf_dir), keep=["id"]), LEEF.keys())


# --- web logs -----------------------------------------------------------------------

_STATUS = "([200,301,401,403,404,429,499,500,503,101,418,206])[id % 12 + 1]"
_S_STATUS = "element_at(array(200,301,401,403,404,429,499,500,503,101,418,206), CAST(id % 12 + 1 AS INT))"
_D_PATH = "(['/index.html','/a?b=1','/Admin/x','/wp-admin','/x/.env','/../etc'])[k % 6 + 1]"
_S_PATH = "element_at(array('/index.html','/a?b=1','/Admin/x','/wp-admin','/x/.env','/../etc'), k % 6 + 1)"
_S_METHOD = "CASE WHEN id % 3 = 0 THEN 'POST' ELSE 'GET' END"
_BASE_LABEL = f"""CASE WHEN {_STATUS} IN (401, 429, 499) THEN 'medium' WHEN {_STATUS} = 403 THEN 'high'
    WHEN {_STATUS} >= 500 THEN 'high' ELSE 'low' END"""
_BASE_CODE = f"""CASE WHEN {_STATUS} = 401 THEN 5 WHEN {_STATUS} IN (429, 499) THEN 4
    WHEN {_STATUS} = 403 OR {_STATUS} >= 500 THEN 7 WHEN {_STATUS} < 300 THEN 1 ELSE 2 END"""
_RAISED = f"({_STATUS} IN (401, 403) OR k % 6 >= 2)"
_TS = """CASE WHEN id % 10 = 0 THEN dmy || ':' || hms WHEN id % 10 = 1 THEN dmy || ':' || hms || ' -0700'
    WHEN id % 10 = 2 THEN '31/Feb/2024:' || hms || ' +0000' WHEN id % 10 = 3 THEN dmy || ':' || hms || ' EST'
    ELSE dmy || ':' || hms || ' +0530' END"""
_TS_OUT = """CASE WHEN id % 10 IN (0, 3) THEN iso || 'Z' WHEN id % 10 = 1 THEN iso || '-07:00'
    WHEN id % 10 = 2 THEN '31/Feb/2024:' || hms || ' +0000' ELSE iso || '+05:30' END"""
_CLIENT = f"""CASE WHEN id % 13 = 0 THEN '-' ELSE ip END || ' - '
    || CASE WHEN id % 4 = 0 THEN usr ELSE '-' END || ' [' || {_TS} || '] '"""
_TAIL = f"""' ' || {_S_STATUS} || ' ' || CASE WHEN id % 8 = 0 THEN '-' ELSE CAST(id * 7 AS STRING) END
    || CASE WHEN id % 5 = 0 THEN '' ELSE ' "http://r/' || k || '" "Agent ' || (u % 5) || '"' END"""
_ACCESS_OUT = {
    "timestamp": _TS_OUT,
    "source_ip": "CASE WHEN id % 13 <> 0 THEN ip END",
    "event_type": "'HTTP/Access'",
    "username": "CASE WHEN id % 4 = 0 THEN usr END",
    "bytes_out": "CASE WHEN id % 8 <> 0 THEN id * 7 END",
}
_SHOWN_IP = "CASE WHEN id % 13 = 0 THEN '-' ELSE ip END"
_REF = "CASE WHEN id % 5 = 0 THEN '' ELSE 'http://r/' || k END"
_UA = "CASE WHEN id % 5 = 0 THEN '' ELSE 'Agent ' || (u % 5) END"
_SIZE = "CASE WHEN id % 8 = 0 THEN '-' ELSE CAST(id * 7 AS VARCHAR) END"
ACCESS = Format(
    render=f"""CASE WHEN id % 41 = 0 THEN '# comment' WHEN id % 41 = 1 THEN ip || ' nonsense ' || id
        ELSE {_CLIENT} || '"' || {_S_METHOD} || ' ' || {_S_PATH} || ' '
          || CASE WHEN id % 7 = 0 THEN 'h2' ELSE 'HTTP/1.1' END || '"' || {_TAIL} END""",
    columns=_ACCESS_OUT
    | {
        "event_action": f"{_S_METHOD} || ' ' || {_STATUS}",
        "severity": f"CASE WHEN {_RAISED} THEN 'high' ELSE {_BASE_LABEL} END",
        "severity_code": f"CASE WHEN {_RAISED} THEN 7 ELSE {_BASE_CODE} END",
        "protocol": "CASE WHEN id % 7 = 0 THEN 'h2' ELSE 'HTTP' END",
        "message": f"{_S_METHOD} || ' ' || {_D_PATH} || ' → ' || {_STATUS} || ' from ' || {_SHOWN_IP}",
    },
    fallback="id % 41 = 1",
    text="ip || ' nonsense ' || id",
    where="id % 41 <> 0",
    extra={
        "path": ("http_path", _D_PATH),
        "version": ("http_version", "CASE WHEN id % 7 = 0 THEN 'h2' ELSE 'HTTP/1.1' END"),
        "referer": ("referer", _REF),
        "agent": ("user_agent", _UA),
        "size": ("response_bytes", _SIZE),
    },
)
_REQ = "(['','-','GET','GET /etc/passwd','  GET  /x   HTTP/1.1 more','\\x16\\x03'])[k % 6 + 1]"
_S_REQ = "element_at(array('','-','GET','GET /etc/passwd','  GET  /x   HTTP/1.1 more','\\\\x16\\\\x03'), k % 6 + 1)"
_M = "(['-','-','GET','GET','GET','\\x16\\x03'])[k % 6 + 1]"
_PTH = "(['-','-','-','/etc/passwd','/x','-'])[k % 6 + 1]"
ODD_ACCESS = Format(
    render=f"""{_CLIENT} || '"' || {_S_REQ} || '"' || {_TAIL}""",
    columns=_ACCESS_OUT
    | {
        "event_action": f"{_M} || ' ' || {_STATUS}",
        "severity": f"CASE WHEN {_STATUS} IN (401, 403) THEN 'high' ELSE {_BASE_LABEL} END",
        "severity_code": f"CASE WHEN {_STATUS} IN (401, 403) THEN 7 ELSE {_BASE_CODE} END",
        "message": f"{_M} || ' ' || {_PTH} || ' → ' || {_STATUS} || ' from ' || {_SHOWN_IP}",
    },
    extra={"request": ("request_line", _REQ), "version": ("http_version", "NULL"), "agent": ("user_agent", _UA)},
)
_WORD = "(['error','warn','crit','info','emerg','ALERT','notice'])[id % 7 + 1]"
_S_WORD = "element_at(array('error','warn','crit','info','emerg','ALERT','notice'), CAST(id % 7 + 1 AS INT))"
ERROR_LOG = Format(
    render=f"""CASE WHEN id % 17 = 0 THEN '2024/02/31' ELSE ymd END || ' ' || hms || ' [' || {_S_WORD} || '] '
        || id || '#' || k || ': ' || CASE WHEN id % 2 = 0 THEN '*' || u || ' ' ELSE '' END
        || 'open() failed ' || et || '  '""",
    columns={
        "timestamp": "CASE WHEN id % 17 = 0 THEN '2024/02/31 ' || hms ELSE iso || 'Z' END",
        "event_type": "'HTTP/Error'",
        "event_action": "'error'",
        "severity": "(['high','medium','medium','low','medium','critical','low'])[id % 7 + 1]",
        "severity_code": "([7,5,5,1,5,9,2])[id % 7 + 1]",
        "message": "'open() failed ' || et",
    },
    extra={"log_level": ("log_level", _WORD)},
)


def _web(spec: Format):
    def run(spark, sf_dir):
        return shown(normalize_web(spec.lines(spark, sf_dir), keep=["id"]), spec.keys())

    return run


for _name, _spec in (
    ("access_log", ACCESS),
    ("access_malformed", ODD_ACCESS),
    ("web_error_log", ERROR_LOG),
):
    register(_name, _spec.oracle())(_web(_spec))


# --- Zeek ----------------------------------------------------------------------------


def _tsv(cells: list[str]) -> str:
    return " || chr(9) || ".join(cells)


def _cell(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN '-' ELSE CAST({value} AS STRING) END"


_STATES = "['S0','REJ','RSTO','RSTR','SF','S1','S2','S3','OTH','XX']"
_D_STATE = f"({_STATES})[id % 10 + 1]"
_S_STATE = f"element_at(array({_STATES[1:-1]}), CAST(id % 10 + 1 AS INT))"
_EPOCH = "epoch || '.' || CASE WHEN id % 3 = 0 THEN '000000' ELSE CAST(100000 + id % 1000 AS STRING) END"
_ZEEK_TS = "iso || CASE WHEN id % 3 = 0 THEN '' ELSE '.' || CAST(100000 + id % 1000 AS VARCHAR) END || '+00:00'"
CONN_FIELDS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "orig_bytes",
    "resp_bytes", "conn_state", "history",
]
ZEEK_CONN = Format(
    # rows of id % 7 = 0 end after the protocol; every tenth row has a cell too many
    render=f"""CASE WHEN id % 19 = 0 THEN '# a remark' ELSE
        {_tsv([_cell("id % 21 = 1", _EPOCH), "'C' || id", _cell("id % 21 = 2", "ip"), "CAST(sport AS STRING)",
               "dst", _cell("id % 21 = 3", "dport"), _cell("id % 21 = 4", "'tcp'")])}
        || CASE WHEN id % 7 = 0 THEN '' ELSE chr(9) ||
           {_tsv([_cell("id % 21 = 5", "id"), "'x' || k", _cell("id % 21 = 6", _S_STATE),
                  "CASE WHEN id % 2 = 0 THEN '(empty)' ELSE 'Sh' END"])}
           || CASE WHEN id % 10 = 9 THEN chr(9) || 'surplus' ELSE '' END END END""",
    columns={
        "timestamp": f"CASE WHEN id % 21 <> 1 THEN {_ZEEK_TS} END",
        "source_ip": "CASE WHEN id % 21 <> 2 THEN ip END",
        "source_port": "sport",
        "dest_ip": "dst",
        "dest_port": "CASE WHEN id % 21 <> 3 THEN dport END",
        "protocol": "CASE WHEN id % 21 <> 4 THEN 'tcp' END",
        "event_type": "'Network/Connection'",
        "event_action": f"CASE WHEN id % 7 = 0 OR id % 21 = 6 THEN 'connection' ELSE {_D_STATE} END",
        "severity": f"""CASE WHEN id % 7 = 0 OR id % 21 = 6 THEN 'low'
            ELSE (['medium','high','medium','medium','low','low','low','low','low','low'])[id % 10 + 1] END""",
        "severity_code": "CASE WHEN id % 7 = 0 OR id % 21 = 6 THEN 2 ELSE ([5,7,4,4,1,2,2,2,2,2])[id % 10 + 1] END",
        "bytes_in": "CASE WHEN id % 7 <> 0 AND id % 21 <> 5 THEN id END",
        "message": f"""'Zeek conn ' || CASE WHEN id % 7 = 0 THEN '' WHEN id % 21 = 6 THEN 'None' ELSE {_D_STATE} END
            || ': ' || CASE WHEN id % 21 = 2 THEN 'None' ELSE ip END || ':' || sport || ' → ' || dst || ':'
            || CASE WHEN id % 21 = 3 THEN 'None' ELSE CAST(dport AS VARCHAR) END || ' ('
            || CASE WHEN id % 21 = 4 THEN 'None' ELSE 'tcp' END || ')'""",
    },
    where="id % 19 <> 0",
    extra={
        "uid": ("uid", "'C' || id"),
        "history": ("history", "CASE WHEN id % 7 <> 0 AND id % 2 = 1 THEN 'Sh' END"),
        "bytes_text": ("resp_bytes", "NULL"),
    },
)


@register("zeek_conn", ZEEK_CONN.oracle())
def zeek_conn(spark, sf_dir):
    events = normalize_zeek(
        ZEEK_CONN.lines(spark, sf_dir), fields=CONN_FIELDS, path="ssl", keep=["id"]
    )
    return shown(events, ZEEK_CONN.keys())


_ST = "(['200','404','503','401','-'])[id % 5 + 1]"
_S_ST = "element_at(array('200','404','503','401','-'), CAST(id % 5 + 1 AS INT))"
HTTP_FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "method", "host", "uri",
               "status_code", "username"]
ZEEK_HTTP = Format(
    render=_tsv([_EPOCH, "'C' || id", "ip", "CAST(sport AS STRING)", "dst", "CAST(dport AS STRING)",
                 _cell("id % 6 = 0", "'GET'"), "host", _cell("id % 6 = 1", "'/u/' || k"), _S_ST, "usr"]),
    columns={
        "timestamp": _ZEEK_TS, "source_ip": "ip", "source_port": "sport", "dest_ip": "dst",
        "dest_port": "dport", "event_type": "'Network/HTTP'", "username": "usr",
        "event_action": f"CASE WHEN id % 6 = 0 THEN 'None' ELSE 'GET' END || ' ' || replace({_ST}, '-', 'None')",
        "severity": f"CASE WHEN {_ST} IN ('404', '503', '401') THEN 'high' ELSE 'low' END",
        "severity_code": f"CASE WHEN {_ST} IN ('404', '503', '401') THEN 7 ELSE 2 END",
        "message": f"""'HTTP ' || CASE WHEN id % 6 = 0 THEN 'None' ELSE 'GET' END || ' ' || host
            || CASE WHEN id % 6 = 1 THEN 'None' ELSE '/u/' || k END || ' → ' || replace({_ST}, '-', 'None')""",
    },
    extra={"ts": ("ts", _EPOCH.replace("STRING", "VARCHAR")), "status": ("status_code", f"nullif({_ST}, '-')")},
)


@register("zeek_http", ZEEK_HTTP.oracle())
def zeek_http(spark, sf_dir):
    events = normalize_zeek(ZEEK_HTTP.lines(spark, sf_dir), fields=HTTP_FIELDS, path="http", keep=["id"])
    return shown(events, ZEEK_HTTP.keys())


_Q = "CASE WHEN id % 8 = 0 THEN 'a' || k || '.onion' WHEN id % 8 = 1 THEN 'mail.example.cn' " \
     "WHEN id % 8 = 2 THEN 'host' || id || '.very.long.name.example.org' WHEN id % 8 = 3 THEN '-' ELSE 'w' || k || '.example.org' END"
_QT = "CASE WHEN id % 3 = 0 THEN 'A' WHEN id % 3 = 1 THEN 'TXT' ELSE '-' END"
_QT_SAID = f"replace({_QT}, '-', 'None')"
_DNS_HIT = f"(id % 8 IN (0, 1) OR (id % 3 = 1 AND length({_Q}) > 30))"
DNS_FIELDS = ["ts", "id.orig_h", "id.resp_h", "query", "qtype_name"]
_DNS_TEXT = f"""{_EPOCH.replace("STRING", "VARCHAR")} || chr(9) || ip || chr(9) || dst || chr(9) || ({_Q}) || chr(9) || ({_QT})"""
ZEEK_DNS = Format(
    render=_tsv([_EPOCH, "ip", "dst", f"({_Q})", f"({_QT})"]),
    columns={
        "timestamp": _ZEEK_TS, "source_ip": "ip", "dest_ip": "dst", "event_type": "'Network/DNS'",
        "event_action": f"'DNS ' || {_QT_SAID} || ' query'",
        "severity": f"CASE WHEN {_DNS_HIT} THEN 'medium' ELSE 'low' END",
        "severity_code": f"CASE WHEN {_DNS_HIT} THEN 5 ELSE 2 END",
        "message": f"'DNS ' || {_QT_SAID} || ' query: ' || ({_Q})",
    },
    fallback="id % 8 = 3",
    text=_DNS_TEXT,
    extra={"query": ("query", _Q), "qtype": ("qtype_name", f"nullif({_QT}, '-')")},
)


@register("zeek_dns", ZEEK_DNS.oracle())
def zeek_dns(spark, sf_dir):
    events = normalize_zeek(ZEEK_DNS.lines(spark, sf_dir), fields=DNS_FIELDS, path="dns", keep=["id"])
    return shown(events, ZEEK_DNS.keys())


_NOTES = "'Scan::Port_Scan','Scan::Address_Scan','SSH::Password_Guessing','SSH::Bruteforcing'," \
         "'Heartbleed::SSL_Heartbeat_Attack','DNS::External_Name','Odd::Thing','-'"
_D_NOTE = f"([{_NOTES}])[id % 8 + 1]"
_S_NOTE = f"element_at(array({_NOTES}), CAST(id % 8 + 1 AS INT))"
NOTICE_FIELDS = ["ts", "id.orig_h", "id.resp_h", "note", "msg", "src", "dst"]
ZEEK_NOTICE = Format(
    render=_tsv([_EPOCH, "ip", "dst", _S_NOTE, _cell("id % 5 = 0", "'Seen ' || et"),
                 _cell("id % 3 = 0", "'1.2.3.' || (k % 9)"), _cell("id % 4 = 0", "'5.6.7.' || (k % 9)")]),
    columns={
        "timestamp": _ZEEK_TS,
        "source_ip": "CASE WHEN id % 3 = 0 THEN ip ELSE '1.2.3.' || (k % 9) END",
        "dest_ip": "CASE WHEN id % 4 = 0 THEN dst ELSE '5.6.7.' || (k % 9) END",
        "event_type": "'Network/Notice'",
        "event_action": f"nullif({_D_NOTE}, '-')",
        "severity": "(['high','high','critical','critical','critical','medium','medium','medium'])[id % 8 + 1]",
        "severity_code": "([8,8,9,10,10,4,5,5])[id % 8 + 1]",
        "message": f"CASE WHEN id % 5 = 0 THEN 'Zeek notice: ' || CASE WHEN id % 8 = 7 THEN 'None' ELSE {_D_NOTE} END "
        "ELSE 'Seen ' || et END",
    },
    extra={"src": ("src", "CASE WHEN id % 3 <> 0 THEN '1.2.3.' || (k % 9) END")},
)


@register("zeek_notice", ZEEK_NOTICE.oracle())
def zeek_notice(spark, sf_dir):
    events = normalize_zeek(ZEEK_NOTICE.lines(spark, sf_dir), fields=NOTICE_FIELDS, path="notice", keep=["id"])
    return shown(events, ZEEK_NOTICE.keys())


# headers in the data: a source per user, its rows in blocks of 512 ids; every
# ninth row is a header that names another column order and another log type
_OWNER = "u"
_HEADER_KIND = "CASE WHEN id % 9 = 0 AND id % 2 = 0 THEN 'p' WHEN id % 9 = 0 THEN 'f' END"


@register(
    "zeek_header_state",
    f"""WITH {FACTS_SQL},
    h AS (SELECT *, {_HEADER_KIND} AS kind FROM f),
    s AS (SELECT *,
        last_value(CASE WHEN kind = 'p' THEN id END IGNORE NULLS) OVER w AS p,
        last_value(CASE WHEN kind = 'f' THEN id END IGNORE NULLS) OVER w AS g
        FROM h WINDOW w AS (PARTITION BY u ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT id,
        CASE WHEN p % 4 = 0 THEN 'Network/HTTP' ELSE 'Network/Connection' END AS event_type,
        CASE WHEN g % 4 = 1 THEN ip ELSE dst END AS source_ip,
        CASE WHEN g % 4 = 1 THEN dst ELSE ip END AS dest_ip
    FROM s WHERE kind IS NULL AND g IS NOT NULL""",
)
def zeek_header_state(spark, sf_dir):
    lines = facts(spark, sf_dir).selectExpr(
        "id",
        f"CAST({_OWNER} AS STRING) AS source",
        "id - id % 512 AS block",
        "id AS seq",
        f"""CASE WHEN ({_HEADER_KIND}) = 'p' THEN '#path' || chr(9) || CASE WHEN id % 4 = 0 THEN 'http' ELSE 'ssl' END
            WHEN ({_HEADER_KIND}) = 'f' THEN '#fields' || chr(9) || CASE WHEN id % 4 = 1
                THEN 'id.orig_h' || chr(9) || 'id.resp_h' ELSE 'id.resp_h' || chr(9) || 'id.orig_h' END
            ELSE ip || chr(9) || dst END AS value""",
    )
    return normalize_zeek(lines, keep=["id"]).select("id", "event_type", "source_ip", "dest_ip")
