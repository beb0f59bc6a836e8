"""Windows event XML records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions import severity as sev
from logfathom.functions.text import filled, lines_of, strip, to_int
from logfathom.model import emit, keep_filters_above, stage, text_map
from logfathom.sources.windows_xml import cut_records

# Event id -> (type, action).
EVENT_IDS: dict[str, tuple[str, str]] = {
    "4624": ("Authentication", "logon_success"),
    "4625": ("Authentication", "logon_failure"),
    "4634": ("Authentication", "logoff"),
    "4648": ("Authentication", "explicit_credential_logon"),
    "4672": ("Authentication", "special_privilege_logon"),
    "4688": ("Process", "process_created"),
    "4689": ("Process", "process_terminated"),
    "4698": ("Scheduled Task", "task_created"),
    "4702": ("Scheduled Task", "task_modified"),
    "4720": ("Account Management", "user_account_created"),
    "4726": ("Account Management", "user_account_deleted"),
    "4732": ("Account Management", "member_added_to_group"),
    "4740": ("Account Management", "account_locked_out"),
    "5140": ("Network", "network_share_accessed"),
    "7036": ("Service", "service_state_changed"),
    "7045": ("Service", "new_service_installed"),
    "1102": ("Audit", "audit_log_cleared"),
    "4663": ("File System", "object_access"),
    "4771": ("Authentication", "kerberos_pre_auth_failed"),
    "4776": ("Authentication", "ntlm_auth_attempt"),
}
# Level -> severity word; any other level is low.
LEVELS = {"1": "critical", "2": "high", "3": "medium", "4": "low", "5": "low"}

_SCHEMA = """
    System struct<
        EventID: struct<_VALUE: string, _Qualifiers: string>,
        Level: string,
        TimeCreated: struct<_SystemTime: string>,
        Computer: string,
        Channel: string,
        Provider: struct<_Name: string>>,
    EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>,
    __broken string
"""
_FOREIGN_ENTITY = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)"
_CHILDLESS = r"(?s)<System(?:\s[^>]*)?(?:/>|>\s*</System>)"


def _pick(table: dict[str, tuple[str, str]], key: Column, i: int) -> Column:
    return F.try_element_at(
        F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])]), key
    )


def process_number(text: Column) -> Column:
    """Decimal or 0x-hex process id, NULL when it is neither."""
    digits = F.when(text.rlike("^0x[0-9a-fA-F]{1,15}$"), F.conv(F.substr(text, F.lit(3)), 16, 10))
    return F.when(text.startswith("0x"), to_int(digits, "bigint")).otherwise(to_int(text, "bigint"))


def normalize_windows_xml(
    df: DataFrame, doc_col: str = "value", *, key: list[str] | None = None, keep: list[str] = ()
) -> DataFrame:
    """Texts with event records to one event per record.

    Text outside records, and records that are no well-formed XML, become one
    fallback event per line. Entities are never resolved.
    """
    records = cut_records(df, doc_col)
    text = F.col("value")
    options = {"columnNameOfCorruptRecord": "__broken", "ignoreSurroundingSpaces": "true"}
    xml, system = F.col("__xml"), F.col("__xml.System")
    good = F.col("__good")
    staged = stage(
        records,
        [
            {"__xml": F.when(text.startswith("<Event"), F.from_xml(text, _SCHEMA, options))},
            {
                "__good": xml.isNotNull()
                & F.col("__xml.__broken").isNull()
                & ~text.rlike(_FOREIGN_ENTITY)
            },
        ],
    )
    # a broken record falls apart into its lines
    pieces = F.when(good, F.array(text)).otherwise(
        F.filter(F.transform(lines_of(text), strip), lambda x: x != "")
    )
    others = [c for c in staged.columns if c != "value"]
    staged = keep_filters_above(staged.select(*others, pieces.alias("__pieces")))
    staged = staged.select(*others, F.posexplode("__pieces").alias("part", "value"))
    data = F.map_from_entries(
        F.transform(
            F.filter(F.col("__xml.EventData.Data"), lambda d: filled(d["_Name"]).isNotNull()),
            lambda d: F.struct(
                d["_Name"].alias("k"), F.coalesce(strip(d["_VALUE"]), F.lit("")).alias("v")
            ),
        )
    )
    staged = stage(
        staged,
        [
            {
                "__has": good & system.isNotNull() & ~text.rlike(_CHILDLESS),
                "__id": F.coalesce(strip(system["EventID"]["_VALUE"]), F.lit("")),
                "__level": strip(
                    F.coalesce(filled(system["Level"]), F.lit("4"))
                ),
                "__chan": F.coalesce(strip(system["Channel"]), F.lit("")),
                "__host": strip(system["Computer"]),
                "__data": F.coalesce(data, F.create_map().cast("map<string,string>")),
            }
        ],
    )
    has, number, chan = F.col("__has"), F.col("__id"), F.col("__chan")
    named = F.col("__data")

    def first(*names: str) -> Column:
        return F.coalesce(*[filled(F.try_element_at(named, F.lit(n))) for n in names])

    words = {k: sev.SCALE[w] for k, w in LEVELS.items()}
    level = sev.lookup(F.col("__level"), words, sev.SCALE["low"])
    action = F.coalesce(_pick(EVENT_IDS, number, 1), F.concat(F.lit("EventID-"), number))
    user = first("SubjectUserName", "TargetUserName", "AccountName")
    ip = first("IpAddress", "SourceAddress", "CallerIpAddress")
    port = first("IpPort", "SourcePort")
    told = F.concat(
        F.lit("Windows Event "), number, F.lit(": "), action,
        F.coalesce(F.concat(F.lit(" | user="), user), F.lit("")),
        F.coalesce(F.concat(F.lit(" | host="), filled(F.col("__host"))), F.lit("")),
        F.coalesce(F.concat(F.lit(" | src="), ip), F.lit("")),
    )
    found = {
        "timestamp": system["TimeCreated"]["_SystemTime"],
        "source_host": F.col("__host"),
        "source_ip": ip,
        "source_port": to_int(F.when(~port.isin("-", "0"), port)),
        "event_type": F.coalesce(
            _pick(EVENT_IDS, number, 0), filled(chan), F.lit("Windows")
        ),
        "event_action": action,
        "severity": level.label,
        "severity_code": level.code,
        "username": user,
        "process_name": first("NewProcessName", "ProcessName", "Application"),
        "process_id": process_number(first("NewProcessId", "ProcessId")),
        "extensions": F.map_concat(
            text_map(
                ("event_id", number), ("channel", chan),
                ("provider", system["Provider"]["_Name"]), ("level", F.col("__level")),
            ),
            named,
        ),
    }
    fields = {name: F.when(has, value) for name, value in found.items()} | {
        "source_format": F.lit("evtx"),
        "message": F.when(has, told).otherwise(text),
        "raw": text,
    }
    if key is None:
        key = [c for c in ("source", "seq") if c in staged.columns]
    return emit(staged, fields, [*key, "sub", "part"], keep)
