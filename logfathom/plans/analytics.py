"""Queries: scalar functions, enrichment, filters, order, counts, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfathom.functions import net, severity, times
from logfathom.functions.ids import STIX_SPACE, event_uuid, stix_id
from logfathom.functions.severity import facility, level, of_priority
from logfathom.model import align
from logfathom.operators import enrich, query, stats, store
from logfathom.operators.query import EventFilter
from logfathom.plans.facts import (
    FACTS_SQL,
    GEO_SQL,
    RDNS_SQL,
    REPUTATION_SQL,
    duck,
    facts,
    geo_table,
    rdns_table,
    register,
    reputation_table,
    table,
)

# --- stored events: facts in the shape of event rows ---------------------------------

EVENTS = {
    "id": "id",
    "event_id": "'e' || id",
    "timestamp": "CASE WHEN id % 16 = 0 THEN NULL WHEN id % 16 = 1 THEN 'Nov 15 ' || k ELSE iso || 'Z' END",
    "source_format": "CASE WHEN id % 3 = 0 THEN 'cef' WHEN id % 3 = 1 THEN 'json' ELSE 'Syslog' END",
    "source_host": "CASE WHEN id % 10 = 0 THEN NULL ELSE host END",
    "source_ip": "CASE WHEN id % 13 = 0 THEN NULL ELSE ip END",
    "source_port": "CAST(CASE WHEN id % 6 = 0 THEN 0 ELSE sport END AS INT)",
    "dest_ip": "CASE WHEN id % 13 IN (0, 1) THEN NULL ELSE dst END",
    "dest_port": "CAST(dport AS INT)",
    "event_type": "'Type/' || et",
    "event_action": "et || '_' || (k % 3)",
    "severity": "label",
    "severity_code": "CAST(CASE WHEN id % 6 = 5 THEN NULL ELSE id % 12 END AS INT)",
    "username": "CASE WHEN id % 13 IN (0, 5) THEN NULL ELSE usr END",
    "user_id": "CASE WHEN id % 7 = 0 THEN NULL ELSE 'uid' || (id % 50) END",
    "process_name": "CASE WHEN id % 4 = 0 THEN 'proc' || k END",
    "process_id": "CAST(CASE WHEN id % 8 = 0 THEN 0 ELSE id END AS BIGINT)",
    "protocol": "CASE WHEN id % 5 = 0 THEN NULL ELSE 'TCP' END",
    "message": "CASE WHEN id % 19 = 0 THEN '' ELSE 'User 100%' || et || ' \"q\" k=' || k END",
    "raw": "'raw ' || id || ' ' || repeat('x', 600)",
    "geo_country": "CASE WHEN u % 4 = 0 THEN NULL ELSE 'Land' || (u % 9) END",
    "abuse_score": "CAST(CASE WHEN id % 3 = 0 THEN NULL ELSE k END AS INT)",
    "is_malicious": "CASE WHEN id % 5 = 0 THEN TRUE WHEN id % 5 = 1 THEN FALSE END",
    "session_id": "'s' || (u % 27)",
    "created": "iso",
}
EVENTS_SQL = FACTS_SQL + ", ev AS (SELECT " + ", ".join(
    f"{sql} AS {name}" for name, sql in EVENTS.items()
) + " FROM f)"
KEEP = ["id", "session_id", "created"]


def event_rows(spark, sf_dir):
    rows = facts(spark, sf_dir).selectExpr(*[f"{sql} AS {name}" for name, sql in EVENTS.items()])
    return align(rows, keep=KEEP).withColumn("created_at", F.col("created").cast("timestamp"))


# --- scalar functions ------------------------------------------------------------------

_WORDS = "'0','1','2','3','4','5','6','7','8','9','10','low','Medium',' HIGH ','critical','info','warning','error'," \
         "'alert','emergency','notice','debug','warn','11',''"
_LABELS = "'low','low','low','medium','medium','medium','high','high','critical','critical','critical','low','medium'," \
          "'high','critical','low','medium','high','critical','critical','low','low','medium','medium','medium'"
_CODES = "1,2,3,4,5,6,7,8,9,10,10,2,5,7,10,1,5,7,9,10,2,1,5,5,5"


@register(
    "normalize_severity",
    f"WITH {FACTS_SQL} SELECT id, ([{_LABELS}])[id % 25 + 1] AS label, ([{_CODES}])[id % 25 + 1] AS code FROM f",
)
def normalize_severity(spark, sf_dir):
    rows = facts(spark, sf_dir).selectExpr("id", f"element_at(array({_WORDS}), CAST(id % 25 + 1 AS INT)) AS w")
    sev = severity.normalize(F.col("w"))
    return rows.select("id", sev.label.alias("label"), sev.code.alias("code"))


_P = "(id % 210 - 5)"
_FAC = "['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp'," \
       "'local0','local1','local2','local3','local4','local5','local6','local7']"
_LEV = "['emergency','alert','critical','error','warning','notice','info','debug']"


@register(
    "priority_decode",
    f"""WITH {FACTS_SQL} SELECT id,
        CASE WHEN {_P} < 0 OR {_P} > 191 THEN 'unknown' ELSE coalesce(({_FAC})[{_P} // 8 + 1], CAST({_P} // 8 AS VARCHAR)) END AS facility,
        CASE WHEN {_P} < 0 OR {_P} > 191 THEN 'unknown' ELSE ({_LEV})[{_P} % 8 + 1] END AS level,
        CASE WHEN {_P} < 0 OR {_P} > 191 THEN 'medium' ELSE (['critical','critical','critical','high','medium','low','low','low'])[{_P} % 8 + 1] END AS label
        FROM f""",
)
def priority_decode(spark, sf_dir):
    pri = F.expr(f"CAST({_P} AS BIGINT)")
    return facts(spark, sf_dir).select(
        "id", facility(pri).alias("facility"), level(pri).alias("level"), of_priority(pri).label.alias("label")
    )


_IPS = "'10.0.0.1','172.16.5.5','172.32.0.1','192.168.1.1','127.9.9.9','169.254.1.1','8.8.8.8','::1','fc00::1','fdff::','fe80::1'," \
       "'2001:db8::1','0:0:0:0:0:0:0:1','1::2::3','256.1.1.1','01.2.3.4','nope','','::ffff:10.0.0.1','1:2:3:4:5:6:7:8','1:2:3','::1.2.3.4'"
_PRIV = "true,true,false,true,true,true,false,true,true,true,false,false,true,true,true,true,true,true,false,false,true,false"
_KIND = "4,4,4,4,4,4,4,6,6,6,6,6,6,4,4,4,4,4,6,6,4,6"


@register(
    "ip_functions",
    f"""WITH {FACTS_SQL}, t AS (SELECT id, CASE WHEN id % 2 = 0 THEN ip END AS addr, id % 22 AS n, ip, k FROM f)
        SELECT id, CASE WHEN addr IS NULL THEN ([{_PRIV}])[n + 1]
            ELSE starts_with(addr, '10.') OR (starts_with(addr, '172.') AND k % 40 BETWEEN 16 AND 31) END AS private,
        CASE WHEN addr IS NULL THEN 'ipv' || ([{_KIND}])[n + 1] || '-addr'
            ELSE CASE WHEN contains(addr, ':') THEN 'ipv6-addr' ELSE 'ipv4-addr' END END AS kind FROM t""",
)
def ip_functions(spark, sf_dir):
    ip = F.expr(f"CASE WHEN id % 2 = 0 THEN ip ELSE element_at(array({_IPS}), CAST(id % 22 + 1 AS INT)) END")
    return facts(spark, sf_dir).select("id", ip.alias("a")).select(
        "id", net.is_private(F.col("a")).alias("private"), net.address_type(F.col("a")).alias("kind")
    )


def uuid5_sql(space: str, name: str) -> str:
    h = f"sha1(unhex('{space.replace('-', '')}') || encode({name}))"
    return (
        f"({h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || "
        f"translate({h}[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || {h}[18:20] || '-' || {h}[21:32])"
    )


@register("uuid5_ids", f"WITH {FACTS_SQL} SELECT id, 'ipv4-addr--' || {uuid5_sql(STIX_SPACE, chr(39) + 'ipv4-addr:' + chr(39) + ' || ip')} AS stix FROM f")
def uuid5_ids(spark, sf_dir):
    return facts(spark, sf_dir).select("id", stix_id(F.lit("ipv4-addr"), F.col("ip")).alias("stix"))


@register(
    "event_ids",
    f"WITH {FACTS_SQL} SELECT id, {uuid5_sql('6f0d3c1e-58a7-4c55-9d0b-2a7c4e8f9b13', 'CAST(id AS VARCHAR) || chr(31) || ip')} AS event_id FROM f",
)
def event_ids(spark, sf_dir):
    return facts(spark, sf_dir).select("id", event_uuid([F.col("id"), F.col("ip")]).alias("event_id"))


@register(
    "timestamp_instants",
    f"""WITH {FACTS_SQL} SELECT id, CASE WHEN id % 5 = 4 THEN NULL
        WHEN id % 5 = 2 THEN strftime(CAST(iso AS TIMESTAMP) - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S')
        ELSE strftime(CAST(iso AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS at,
        CASE WHEN id % 5 IN (3, 4) THEN NULL WHEN id % 5 = 2 THEN epoch - 19800
        WHEN id % 5 = 1 THEN epoch + 0.25 ELSE epoch END AS seconds FROM f""",
)
def timestamp_instants(spark, sf_dir):
    text = F.expr(
        """CASE WHEN id % 5 = 0 THEN iso || 'Z' WHEN id % 5 = 1 THEN iso || '.250' WHEN id % 5 = 2 THEN iso || '+05:30'
        WHEN id % 5 = 3 THEN mon || '  ' || CAST(dd AS INT) || ' 2024 ' || hms ELSE 'at ' || hms END"""
    )
    t = F.col("t")
    return facts(spark, sf_dir).select("id", text.alias("t")).select(
        "id",
        F.date_format(times.event_instant(t), "yyyy-MM-dd HH:mm:ss").alias("at"),
        times.epoch_seconds(t).cast("double").alias("seconds"),
    )


# --- enrichment --------------------------------------------------------------------------

_NUM = "(CASE WHEN contains(source_ip, ':') THEN NULL ELSE list_reduce([CAST(x AS BIGINT) FOR x IN string_split(source_ip, '.')], lambda a, b: a * 256 + b) END)"
_PRIVATE = "(starts_with(source_ip, '10.') OR regexp_matches(source_ip, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
_GEO_CTE = f"""geo AS ({duck(GEO_SQL)}),
    ips AS (SELECT DISTINCT source_ip, {_NUM} AS num FROM ev WHERE source_ip IS NOT NULL AND NOT contains(source_ip, ':') AND NOT {_PRIVATE}),
    hit AS (SELECT source_ip, geo.*, row_number() OVER (PARTITION BY source_ip ORDER BY ip_hi - ip_lo, ip_lo) AS rn
            FROM ips JOIN geo ON num BETWEEN ip_lo AND ip_hi),
    g AS (SELECT ev.*, hit.country AS g_country, hit.country_code, hit.city, hit.lat, hit.lon, hit.isp, hit.asn
          FROM ev LEFT JOIN hit ON ev.source_ip = hit.source_ip AND rn = 1)"""


def _clean(spark, sf_dir):
    """Event rows before enrichment."""
    return event_rows(spark, sf_dir).withColumns(
        {
            "geo_country": F.lit(None).cast("string"),
            "is_malicious": F.lit(None).cast("boolean"),
            "abuse_score": F.lit(None).cast("int"),
            "extensions": F.create_map().cast("map<string,string>"),
        }
    )


@register(
    "geo_range_join",
    f"""WITH {EVENTS_SQL}, {_GEO_CTE} SELECT id, g_country AS geo_country, country_code AS geo_country_code, city AS geo_city,
        CAST(lat AS DOUBLE) AS geo_lat, CAST(lon AS DOUBLE) AS geo_lon, isp AS geo_isp, asn AS geo_asn FROM g""",
)
def geo_range_join(spark, sf_dir):
    out = enrich.enrich_geo(_clean(spark, sf_dir), geo_table(spark, sf_dir))
    return out.select("id", *enrich.GEO_COLUMNS.values())


@register(
    "lookup_keys",
    f"WITH {EVENTS_SQL} SELECT DISTINCT source_ip FROM ev WHERE source_ip IS NOT NULL AND NOT {_PRIVATE}",
)
def lookup_keys(spark, sf_dir):
    return enrich.lookup_addresses(event_rows(spark, sf_dir), public_only=True)


@register(
    "rdns_join",
    f"""WITH {EVENTS_SQL}, r AS ({duck(RDNS_SQL)}) SELECT id, nullif(hostname, source_ip) AS rdns
        FROM ev LEFT JOIN r ON source_ip = r.ip""",
)
def rdns_join(spark, sf_dir):
    return enrich.enrich_rdns(_clean(spark, sf_dir), rdns_table(spark, sf_dir)).select("id", "rdns")


_BLOCKED = "(starts_with(source_ip, '185.220.101.') OR source_ip IN ('45.227.255.0', '45.227.255.1'))"
_SERIOUS = "coalesce(severity IN ('critical', 'high'), FALSE)"


@register(
    "blocklist",
    f"""WITH {EVENTS_SQL}, b AS (SELECT *, coalesce({_BLOCKED}, FALSE) AS hit FROM ev)
        SELECT id, CASE WHEN hit THEN 100 END AS abuse_score, CASE WHEN hit THEN TRUE END AS is_malicious,
        CASE WHEN hit AND NOT {_SERIOUS} THEN 'high' ELSE severity END AS severity,
        CASE WHEN hit AND NOT {_SERIOUS} THEN 8 ELSE severity_code END AS severity_code,
        CASE WHEN hit THEN 'local_blocklist' END AS ti_source FROM b""",
)
def blocklist(spark, sf_dir):
    out = enrich.enrich_threat(_clean(spark, sf_dir))
    return out.selectExpr("id", "abuse_score", "is_malicious", "severity", "severity_code",
                          "extensions['ti_source'] AS ti_source")


_REP_SQL = f"""WITH {EVENTS_SQL}, r AS ({duck(REPUTATION_SQL)}),
    b AS (SELECT ev.id, ev.severity, ev.severity_code, r.*, r.abuse_score AS score, coalesce(r.abuse_score >= 50, FALSE) AS bad
          FROM ev LEFT JOIN r ON source_ip = r.ip)
    SELECT id, score AS abuse_score, CASE WHEN score IS NOT NULL THEN bad END AS is_malicious,
        CASE WHEN bad AND NOT {_SERIOUS} THEN 'high' ELSE severity END AS severity,
        CASE WHEN bad AND NOT {_SERIOUS} THEN 8 ELSE severity_code END AS severity_code,
        CASE WHEN score IS NOT NULL THEN 'abuseipdb' END AS ti_source,
        CAST(total_reports AS VARCHAR) AS reports, last_reported AS last, usage_type AS usage FROM b"""


@register("reputation", _REP_SQL)
def reputation(spark, sf_dir):
    out = enrich.enrich_threat(_clean(spark, sf_dir), reputation_table(spark, sf_dir))
    return out.selectExpr(
        "id", "abuse_score", "is_malicious", "severity", "severity_code",
        "extensions['ti_source'] AS ti_source", "extensions['ti_total_reports'] AS reports",
        "extensions['ti_last_reported'] AS last", "extensions['ti_usage_type'] AS usage",
    )


@register(
    "enriched_summary",
    f"""WITH {EVENTS_SQL}, {_GEO_CTE}, b AS (SELECT *, coalesce({_BLOCKED}, FALSE) AS hit FROM g),
        c AS (SELECT *, CASE WHEN hit AND NOT {_SERIOUS} THEN 'high' ELSE coalesce(lower(severity), 'low') END AS sev FROM b)
        SELECT count(*) AS total, count(*) FILTER (sev = 'critical') AS critical, count(*) FILTER (sev = 'high') AS high,
        count(*) FILTER (sev = 'medium') AS medium, count(*) FILTER (sev = 'low') AS low,
        count(g_country) AS geo_enriched, count(*) FILTER (hit) AS malicious FROM c""",
)
def enriched_summary(spark, sf_dir):
    """Geography, reverse DNS and the block list over all events, then the summary."""
    out = enrich.enrich(
        _clean(spark, sf_dir), geo=geo_table(spark, sf_dir), rdns=rdns_table(spark, sf_dir), threat=True
    )
    return stats.parse_summary(out)


@register(
    "enrich_all",
    f"""WITH {EVENTS_SQL}, {_GEO_CTE}, r AS ({duck(RDNS_SQL)})
        SELECT id, g_country AS geo_country, nullif(hostname, g.source_ip) AS rdns, coalesce({_BLOCKED.replace("source_ip", "g.source_ip")}, FALSE) AS bad
        FROM g LEFT JOIN r ON g.source_ip = r.ip""",
)
def enrich_all(spark, sf_dir):
    out = enrich.enrich(
        _clean(spark, sf_dir), geo=geo_table(spark, sf_dir), rdns=rdns_table(spark, sf_dir), threat=True
    )
    return out.selectExpr("id", "geo_country", "rdns", "coalesce(is_malicious, false) AS bad")


# --- filters --------------------------------------------------------------------------------

_FILTERS = {
    "severity": (EventFilter(severity="HIGH"), "lower(severity) = 'high'"),
    "source_format": (EventFilter(source_format="SYSLOG"), "lower(source_format) = 'syslog'"),
    "source_ip": (EventFilter(source_ip="0.1"), "source_ip ILIKE '%0.1%'"),
    "event_type": (EventFilter(event_type="type/CL"), "event_type ILIKE '%type/CL%'"),
    "event_action": (EventFilter(event_action="click_1"), "event_action ILIKE '%click_1%'"),
    "username": (EventFilter(username="USER1"), "username ILIKE '%USER1%'"),
    "geo_country": (EventFilter(geo_country="Land3"), "geo_country = 'Land3'"),
    "malicious": (EventFilter(is_malicious=True), "is_malicious"),
    "not_malicious": (EventFilter(is_malicious=False), "NOT coalesce(is_malicious, FALSE)"),
    "session": (EventFilter(session_id="s3"), "session_id = 's3'"),
    "search": (EventFilter(search="100%VIEW"), "message ILIKE '%100%VIEW%'"),
    "time_text": (
        EventFilter(from_time="2024-01-05", to_time="2024-01-20T12:00:00Z"),
        "timestamp >= '2024-01-05' AND timestamp <= '2024-01-20T12:00:00Z'",
    ),
    "all": (
        EventFilter(severity="low", source_format="cef", username="user", search="k=", is_malicious=False),
        "lower(severity) = 'low' AND lower(source_format) = 'cef' AND username ILIKE '%user%' "
        "AND message ILIKE '%k=%' AND NOT coalesce(is_malicious, FALSE)",
    ),
    "none": (EventFilter(), "TRUE"),
}


def _filter(where: EventFilter):
    def run(spark, sf_dir):
        return where.apply(event_rows(spark, sf_dir)).select("event_id")

    return run


for _name, (_where, _sql) in _FILTERS.items():
    register(f"filter_{_name}", f"WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE {_sql}")(_filter(_where))


@register(
    "filter_time_instant",
    f"""WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE id % 16 > 1 AND created >= '2024-01-05T00:00:00'
        AND created <= '2024-01-20T12:00:00'""",
)
def filter_time_instant(spark, sf_dir):
    rows = query.between_instants(event_rows(spark, sf_dir), "2024-01-05", "2024-01-20 12:00:00")
    return rows.select("event_id")


@register("filter_message", f"WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE message <> ''")
def filter_message(spark, sf_dir):
    return query.with_message(event_rows(spark, sf_dir)).select("event_id")


@register("search_documents", "SELECT doc_id FROM documents WHERE text ILIKE '%The on%'")
def search_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "message")
    return EventFilter(search="The on").apply(docs).select("doc_id")


# --- order and pages ----------------------------------------------------------------------------

_ORDERS = {
    "timestamp_desc": ("nonsense; DROP", "timestamp DESC NULLS LAST"),
    "severity_asc": ("severity ASC", "severity ASC NULLS FIRST"),
    "abuse_desc": ("abuse_score", "abuse_score DESC NULLS LAST"),
    "created_asc": ("created_at asc", "created ASC NULLS FIRST"),
    "format_desc": ("Source_Format desc", "source_format DESC NULLS LAST"),
}


def _page(order_by: str):
    def run(spark, sf_dir):
        return query.page(event_rows(spark, sf_dir), 50, 25, order_by).select("event_id")

    return run


for _name, (_by, _sql) in _ORDERS.items():
    register(
        f"page_{_name}",
        f"WITH {EVENTS_SQL} SELECT event_id FROM ev ORDER BY {_sql}, event_id LIMIT 50 OFFSET 25",
    )(_page(_by))


@register("page_total", f"WITH {EVENTS_SQL} SELECT count(*) AS total FROM ev WHERE lower(severity) = 'high'")
def page_total(spark, sf_dir):
    return query.query_events(event_rows(spark, sf_dir), EventFilter(severity="high"))[1]


@register("preview", f"WITH {EVENTS_SQL} SELECT id, message FROM ev ORDER BY event_id LIMIT 100")
def preview(spark, sf_dir):
    return query.preview(event_rows(spark, sf_dir), 100).select("id", "message")


# --- counts ------------------------------------------------------------------------------------------


@register("total_events", f"WITH {EVENTS_SQL} SELECT count(*) AS total FROM ev")
def total_events(spark, sf_dir):
    return stats.total(event_rows(spark, sf_dir))


@register("malicious_count", f"WITH {EVENTS_SQL} SELECT count(*) AS malicious FROM ev WHERE is_malicious")
def malicious_count(spark, sf_dir):
    return stats.malicious(event_rows(spark, sf_dir))


for _name, _col in (("severity", "severity"), ("format", "source_format")):
    register(f"count_by_{_name}", f"WITH {EVENTS_SQL} SELECT {_col}, count(*) AS n FROM ev GROUP BY {_col}")(
        lambda spark, sf_dir, c=_col: stats.count_by(event_rows(spark, sf_dir), c)
    )
for _name, _col, _k in (
    ("ips", "source_ip", 10), ("users", "username", 10), ("countries", "geo_country", 10), ("actions", "event_action", 5),
):
    register(
        f"top_{_name}",
        f"WITH {EVENTS_SQL} SELECT {_col}, count(*) AS n FROM ev WHERE {_col} IS NOT NULL "
        f"GROUP BY {_col} ORDER BY n DESC, {_col} LIMIT {_k}",
    )(lambda spark, sf_dir, c=_col, k=_k: stats.top(event_rows(spark, sf_dir), c, k))


@register(
    "top_ips_country",
    f"""WITH {EVENTS_SQL} SELECT source_ip, count(*) AS n, min(geo_country) AS country FROM ev
        WHERE source_ip IS NOT NULL GROUP BY source_ip ORDER BY n DESC, source_ip LIMIT 5""",
)
def top_ips_country(spark, sf_dir):
    return stats.top_with_country(event_rows(spark, sf_dir))


@register(
    "parse_summary",
    f"""WITH {EVENTS_SQL}, s AS (SELECT *, coalesce(lower(severity), 'low') AS sev FROM ev)
        SELECT count(*) AS total, count(*) FILTER (sev = 'critical') AS critical, count(*) FILTER (sev = 'high') AS high,
        count(*) FILTER (sev = 'medium') AS medium, count(*) FILTER (sev = 'low') AS low,
        count(geo_country) AS geo_enriched, count(*) FILTER (is_malicious) AS malicious FROM s""",
)
def parse_summary(spark, sf_dir):
    return stats.parse_summary(event_rows(spark, sf_dir))


def _top_sql(section: str, column: str) -> str:
    return (
        f"(SELECT '{section}' AS section, {column} AS item, count(*) AS n FROM ev WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY n DESC, item LIMIT 10)"
    )


@register(
    "stats_report",
    f"""WITH {EVENTS_SQL} SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS item, count(*) AS n FROM ev
        UNION ALL SELECT 'malicious', NULL, count(*) FILTER (is_malicious) FROM ev
        UNION ALL SELECT 'severity', severity, count(*) FROM ev GROUP BY severity
        UNION ALL SELECT 'format', source_format, count(*) FROM ev GROUP BY source_format
        UNION ALL {_top_sql("ip", "source_ip")} UNION ALL {_top_sql("user", "username")}
        UNION ALL {_top_sql("country", "geo_country")}""",
)
def stats_report(spark, sf_dir):
    return stats.report(event_rows(spark, sf_dir))


@register("session_counts", f"WITH {EVENTS_SQL} SELECT session_id, count(*) AS event_count FROM ev GROUP BY session_id")
def session_counts(spark, sf_dir):
    return stats.session_counts(event_rows(spark, sf_dir))


_SESSIONS = "SELECT session_id, 'f-' || session_id AS filename, count(*) AS event_count, max(created) AS created_at FROM ev GROUP BY session_id"


def _sessions(spark, sf_dir):
    return event_rows(spark, sf_dir).groupBy("session_id").agg(
        F.concat(F.lit("f-"), F.col("session_id")).alias("filename"),
        F.count(F.lit(1)).alias("event_count"),
        F.max("created").alias("created_at"),
    )


@register("recent_sessions", f"WITH {EVENTS_SQL} SELECT * FROM ({_SESSIONS}) ORDER BY created_at DESC, session_id LIMIT 20")
def recent_sessions(spark, sf_dir):
    return query.recent_sessions(_sessions(spark, sf_dir))


@register(
    "session_events",
    f"""WITH {EVENTS_SQL}, s AS ({_SESSIONS}) SELECT filename, severity, count(*) AS n
        FROM ev JOIN s USING (session_id) GROUP BY filename, severity""",
)
def session_events(spark, sf_dir):
    joined = event_rows(spark, sf_dir).select("session_id", "severity").join(
        _sessions(spark, sf_dir).select("session_id", "filename"), "session_id"
    )
    return joined.groupBy("filename", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- sets -----------------------------------------------------------------------------------------------


@register(
    "insert_ignore",
    f"""WITH {EVENTS_SQL}, b AS (SELECT 'e' || (id % 700) AS event_id, min(id) AS first FROM ev GROUP BY 1)
        SELECT event_id, first AS id FROM b WHERE event_id NOT IN (SELECT 'e' || id FROM f WHERE u % 3 = 0)""",
)
def insert_ignore(spark, sf_dir):
    """A batch with repeated ids against stored ids; the first copy is kept."""
    ids = facts(spark, sf_dir).selectExpr("'e' || id AS event_id", "u")
    stored = ids.filter("u % 3 = 0").select("event_id")
    batch = event_rows(spark, sf_dir).withColumn("event_id", F.expr("'e' || (id % 700)"))
    return store.insert_new(batch, stored, order=["id"]).select("event_id", "id")


@register(
    "session_upsert",
    f"""WITH {EVENTS_SQL}, s AS ({_SESSIONS}) SELECT session_id,
        CASE WHEN session_id IN ('s1', 's5', 's9') THEN 'new' ELSE filename END AS filename FROM s""",
)
def session_upsert(spark, sf_dir):
    old = _sessions(spark, sf_dir)
    new = old.filter(F.col("session_id").isin("s1", "s5", "s9")).withColumn("filename", F.lit("new"))
    return store.upsert_sessions(old, new).select("session_id", "filename")


@register("delete_session", f"WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE session_id <> 's4'")
def delete_session(spark, sf_dir):
    return store.without_session(event_rows(spark, sf_dir), "s4").select("event_id")
