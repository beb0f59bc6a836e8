"""Queries: exports and STIX objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfathom.functions.ids import STIX_SPACE
from logfathom.model import EVENT_FIELDS
from logfathom.operators.query import EventFilter
from logfathom.plans.analytics import EVENTS_SQL, event_rows, uuid5_sql
from logfathom.plans.facts import register
from logfathom.session import scratch_dir
from logfathom.sinks import exports, stix

NOW = "2024-02-01T00:00:00.000Z"
IDENTITY = "identity--00000000-0000-4000-8000-000000000001"


def _rows(spark, sf_dir):
    """Events with extensions, of which one name clashes with a field at times."""
    return event_rows(spark, sf_dir).withColumn(
        "extensions",
        F.expr(
            """CASE WHEN id % 3 = 0 THEN map() WHEN id % 3 = 1 THEN map('vendor', 'A "b"')
            ELSE map('event_id', 'x' || id, 'event_type', 'own', 'extra', CAST(NULL AS STRING)) END"""
        ).cast("map<string,string>"),
    )


_CSV = ", ".join(
    c if c not in ("category", "bytes_in", "bytes_out")
    else f"CAST(NULL AS {'VARCHAR' if c == 'category' else 'BIGINT'}) AS {c}"
    for c in exports.CSV_COLUMNS
)


@register("csv_rows", f"WITH {EVENTS_SQL} SELECT {_CSV} FROM ev")
def csv_rows(spark, sf_dir):
    return exports.csv_rows(event_rows(spark, sf_dir))


@register(
    "csv_round_trip",
    f"""WITH {EVENTS_SQL} SELECT event_id, nullif(message, '') AS message, username, CAST(source_port AS VARCHAR) AS source_port FROM ev""",
)
def csv_round_trip(spark, sf_dir):
    """Written as CSV files and read again by header."""
    path = scratch_dir(spark, "csv")
    exports.export(event_rows(spark, sf_dir), "CSV", path)
    read = spark.read.options(header=True, escape='"').csv(path)
    return read.select("event_id", "message", "username", "source_port")


_JSON_CELLS = {
    "event_id": "$.event_id", "severity": "$.severity", "port": "$.source_port", "message": "$.message",
    "country": "$.geo_country", "bad": "$.is_malicious",
}


def _read(frame, cells, col="value"):
    return frame.select(*[F.get_json_object(col, path).alias(n) for n, path in cells.items()])


@register(
    "ndjson_rows",
    f"""WITH {EVENTS_SQL} SELECT event_id, severity, CAST(source_port AS VARCHAR) AS port, message, geo_country AS country,
        CAST(is_malicious AS VARCHAR) AS bad, {len(EVENT_FIELDS)} AS n_fields FROM ev""",
)
def ndjson_rows(spark, sf_dir):
    rows = exports.ndjson_rows(_rows(spark, sf_dir))
    return rows.select(
        *[F.get_json_object("value", p).alias(n) for n, p in _JSON_CELLS.items()],
        F.size(F.json_object_keys("value")).alias("n_fields"),
    )


@register(
    "es_bulk",
    f"""WITH {EVENTS_SQL} SELECT event_id AS meta_id, 'logs' AS meta_index,
        CASE WHEN id % 3 = 2 THEN 'x' || id ELSE event_id END AS doc_id,
        CASE WHEN id % 3 = 2 THEN 'own' ELSE event_type END AS doc_type,
        CASE WHEN id % 3 = 1 THEN 'A "b"' END AS vendor, message, CAST(dest_port AS VARCHAR) AS port,
        {len(EVENT_FIELDS) - 1} + CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS n_keys FROM ev""",
)
def es_bulk(spark, sf_dir):
    rows = exports.bulk_rows(_rows(spark, sf_dir), "logs").select(
        F.substring_index("value", "\n", 1).alias("meta"), F.substring_index("value", "\n", -1).alias("doc")
    )

    def cell(col, path, name):
        return F.get_json_object(col, path).alias(name)

    return rows.select(
        cell("meta", "$.index._id", "meta_id"), cell("meta", "$.index._index", "meta_index"),
        cell("doc", "$.event_id", "doc_id"), cell("doc", "$.event_type", "doc_type"),
        cell("doc", "$.vendor", "vendor"), cell("doc", "$.message", "message"), cell("doc", "$.dest_port", "port"),
        F.size(F.json_object_keys("doc")).alias("n_keys"),
    )


@register(
    "splunk_hec",
    f"""WITH {EVENTS_SQL} SELECT CASE WHEN id % 16 > 1 THEN CAST(f_epoch AS DOUBLE) END AS time,
        coalesce(source_host, 'siem-parser') AS host, 'siem-parser' AS source, 'siem:' || source_format AS sourcetype,
        'main' AS index, event_id
        FROM (SELECT ev.*, epoch AS f_epoch FROM ev JOIN (SELECT id AS fid, epoch FROM f) ON id = fid)""",
)
def splunk_hec(spark, sf_dir):
    rows = exports.hec_rows(_rows(spark, sf_dir))
    cells = {n: f"$.{n}" for n in ("time", "host", "source", "sourcetype", "index")} | {"event_id": "$.event.event_id"}
    return _read(rows, cells).withColumn("time", F.col("time").cast("double"))


@register(
    "query_export",
    f"""WITH {EVENTS_SQL} SELECT event_id, message FROM ev WHERE lower(severity) = 'high' AND is_malicious""",
)
def query_export(spark, sf_dir):
    """A filter's result written as JSON lines and read again."""
    path = scratch_dir(spark, "export")
    where = EventFilter(severity="high", is_malicious=True)
    exports.export(where.apply(event_rows(spark, sf_dir)), "ndjson", path)
    return _read(spark.read.text(path), {"event_id": "$.event_id", "message": "$.message"})


# --- STIX ------------------------------------------------------------------------------


def _kind_sql(ip: str) -> str:
    return f"CASE WHEN contains({ip}, ':') THEN 'ipv6-addr' ELSE 'ipv4-addr' END"


def _ip_id(ip: str) -> str:
    kind = _kind_sql(ip)
    name = f"({kind} || ':' || {ip})"
    return f"CASE WHEN {ip} IS NOT NULL THEN {kind} || '--' || {uuid5_sql(STIX_SPACE, name)} END"


_USER_NAME = "('user-account:' || username)"
_USER_ID = f"CASE WHEN username IS NOT NULL THEN 'user-account--' || {uuid5_sql(STIX_SPACE, _USER_NAME)} END"
_HAS_IP = "(source_ip IS NOT NULL OR dest_ip IS NOT NULL)"
_BARE = f"(NOT {_HAS_IP} AND username IS NULL AND process_name IS NULL)"
_AT = f"coalesce(timestamp, '{NOW}')"


@register(
    "stix_ip_sco",
    f"""WITH {EVENTS_SQL}, a AS (SELECT source_ip AS ip FROM ev UNION SELECT dest_ip FROM ev)
        SELECT {_ip_id('ip')} AS id, {_kind_sql('ip')} AS type, ip AS value FROM a WHERE ip IS NOT NULL""",
)
def stix_ip_sco(spark, sf_dir):
    rows = stix.addresses(event_rows(spark, sf_dir))
    return rows.select("id", "type", F.get_json_object("json", "$.value").alias("value"))


@register(
    "stix_network",
    f"""WITH {EVENTS_SQL} SELECT 'network-traffic--' || event_id AS id, {_AT} AS start, CASE WHEN protocol IS NULL THEN 'tcp' ELSE lower(protocol) END AS protocol,
        {_ip_id('source_ip')} AS src, CASE WHEN source_ip IS NOT NULL AND source_port <> 0 THEN CAST(source_port AS VARCHAR) END AS src_port,
        {_ip_id('dest_ip')} AS dst, CASE WHEN dest_ip IS NOT NULL THEN CAST(dest_port AS VARCHAR) END AS dst_port
        FROM ev WHERE {_HAS_IP}""",
)
def stix_network(spark, sf_dir):
    rows = stix.traffic(event_rows(spark, sf_dir), F.lit(NOW))
    cells = {"id": "$.id", "start": "$.start", "protocol": "$.protocols[0]", "src": "$.src_ref",
             "src_port": "$.src_port", "dst": "$.dst_ref", "dst_port": "$.dst_port"}
    return _read(rows, cells, "json")


@register(
    "stix_user",
    f"""WITH {EVENTS_SQL}, x AS (SELECT username, arg_min(coalesce(user_id, username), id) AS user_id FROM ev
            WHERE username IS NOT NULL GROUP BY username)
        SELECT {_USER_ID} AS id, user_id, username AS login FROM x""",
)
def stix_user(spark, sf_dir):
    rows = stix.users(event_rows(spark, sf_dir), ["id"])
    return _read(rows, {"id": "$.id", "user_id": "$.user_id", "login": "$.account_login"}, "json")


@register(
    "stix_process",
    f"""WITH {EVENTS_SQL} SELECT 'process--' || event_id AS id, process_name AS command,
        CASE WHEN process_id <> 0 THEN CAST(process_id AS VARCHAR) END AS pid FROM ev WHERE process_name IS NOT NULL""",
)
def stix_process(spark, sf_dir):
    rows = stix.processes(event_rows(spark, sf_dir))
    return _read(rows, {"id": "$.id", "command": "$.command_line", "pid": "$.pid"}, "json")


@register(
    "stix_fallback",
    f"""WITH {EVENTS_SQL} SELECT 'x-siem-log--' || event_id AS id, message, source_format, raw[1:500] AS raw FROM ev WHERE {_BARE}""",
)
def stix_fallback(spark, sf_dir):
    rows = stix.bare_logs(event_rows(spark, sf_dir))
    return _read(rows, {"id": "$.id", "message": "$.x_message", "source_format": "$.x_source_format", "raw": "$.x_raw"}, "json")


_REFS = f"""concat_ws(',', {_ip_id('source_ip')}, {_ip_id('dest_ip')},
    CASE WHEN {_HAS_IP} THEN 'network-traffic--' || event_id END, {_USER_ID},
    CASE WHEN process_name IS NOT NULL THEN 'process--' || event_id END,
    CASE WHEN {_BARE} THEN 'x-siem-log--' || event_id END)"""


@register(
    "stix_observed",
    f"""WITH {EVENTS_SQL} SELECT 'observed-data--' || event_id AS id, '{IDENTITY}' AS creator, {_AT} AS created,
        CAST(least(100, coalesce(nullif(severity_code, 0), 5) * 10) AS VARCHAR) AS confidence, {_REFS} AS refs,
        severity, event_action AS action FROM ev""",
)
def stix_observed(spark, sf_dir):
    rows = stix.observations(event_rows(spark, sf_dir), IDENTITY, F.lit(NOW))
    cells = {"id": "$.id", "creator": "$.created_by_ref", "created": "$.created", "confidence": "$.confidence",
             "severity": "$.x_siem_severity", "action": "$.x_siem_event_action"}
    refs = F.array_join(F.from_json(F.get_json_object("json", "$.object_refs"), "array<string>"), ",")
    return rows.select(*[F.get_json_object("json", p).alias(n) for n, p in cells.items()], refs.alias("refs"))


STIX_COUNTS_SQL = f"""WITH {EVENTS_SQL}, a AS (SELECT source_ip AS ip FROM ev UNION SELECT dest_ip FROM ev)
        SELECT 'identity' AS type, 1 AS n UNION ALL SELECT {_kind_sql('ip')}, count(*) FROM a WHERE ip IS NOT NULL GROUP BY 1
        UNION ALL SELECT 'network-traffic', count(*) FROM ev WHERE {_HAS_IP}
        UNION ALL SELECT 'user-account', count(DISTINCT username) FROM ev
        UNION ALL SELECT 'process', count(process_name) FROM ev
        UNION ALL SELECT 'x-siem-log', count(*) FROM ev WHERE {_BARE} HAVING count(*) > 0
        UNION ALL SELECT 'observed-data', count(*) FROM ev"""


@register("stix_object_counts", STIX_COUNTS_SQL)
def stix_object_counts(spark, sf_dir):
    rows = stix.stix_objects(event_rows(spark, sf_dir), identity_id=IDENTITY, now=NOW, order=["id"])
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
