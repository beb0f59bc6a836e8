"""Queries: IPv6 geography, whole documents, and the hooks for own formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfathom.model import emit
from logfathom.operators import enrich, registry, zeek
from logfathom.operators.cloudtrail import normalize_cloudtrail
from logfathom.operators.json_events import normalize_json
from logfathom.operators.route import route_lines
from logfathom.operators.store import EventStore
from logfathom.plans.analytics import EVENTS_SQL, _clean, event_rows
from logfathom.plans.facts import FACTS_SQL, facts, register, table
from logfathom.plans.outputs import IDENTITY, NOW, STIX_COUNTS_SQL
from logfathom.session import scratch_dir
from logfathom.sinks import exports, stix
from logfathom.sinks.document import write_document
from logfathom.sources.documents import TRAIL_KEYS
from logfathom.sources.json_splits import document_plan, envelopes, json_documents, numbered, records_of
from logfathom.sources.lines import read_lines


@register(
    "geo_ipv6",
    f"""WITH {EVENTS_SQL}, x AS (SELECT id, CASE WHEN starts_with(source_ip, '2001:db8::') THEN CAST(right(source_ip, 1) AS INT) END AS n FROM ev)
        SELECT id, CASE WHEN n = 2 THEN 'Exact' ELSE n_name END AS geo_country, CASE WHEN n = 2 THEN 'E' ELSE 'C' || n_nationkey END AS geo_country_code FROM x
        LEFT JOIN nation ON n_nationkey = CASE WHEN n % 2 = 1 THEN n WHEN n IN (4, 6) THEN 10 WHEN n IS NOT NULL THEN 0 END""",
)
def geo_ipv6(spark, sf_dir):
    """IPv6 ranges, nested and of any bounds, and single addresses before them."""
    ranges = table(spark, sf_dir, "nation").selectExpr(
        "CASE WHEN n_nationkey = 0 THEN '2001:db8::' WHEN n_nationkey = 10 THEN '2001:0DB8:0:0::4' ELSE concat('2001:db8::', n_nationkey) END AS ip_lo",
        "CASE WHEN n_nationkey = 0 THEN '2001:db8:ffff:3::1' WHEN n_nationkey = 10 THEN '2001:db8::7' ELSE concat('2001:db8::', n_nationkey) END AS ip_hi",
        "n_name AS country", "concat('C', n_nationkey) AS country_code", "'Town' AS city", "1.5D AS lat", "2.5D AS lon", "'I' AS isp", "'A' AS asn", "n_nationkey AS k",
    ).filter("k IN (0, 10) OR (k < 10 AND k % 2 = 1)")
    one = spark.range(1).selectExpr("'2001:db8::2' AS ip", "'Exact' AS country", "'E' AS country_code", "'' AS city", "0D AS lat", "0D AS lon", "'' AS isp", "'' AS asn")
    out = enrich.enrich(_clean(spark, sf_dir), geo6=ranges.drop("k"), geo_ips=one)
    return out.select("id", "geo_country", "geo_country_code")


@register(
    "json_document",
    f"WITH {EVENTS_SQL} SELECT row_number() OVER (ORDER BY id) - 1 AS pos, event_id, username, CAST(source_port AS BIGINT) AS source_port FROM ev",
)
def json_document(spark, sf_dir):
    """The events as one JSON array in one file, in order, read back over splits
    with the place of every element."""
    path = scratch_dir(spark, "events.json")
    exports.export(event_rows(spark, sf_dir), "JSON", path, order=["id"])
    records, _ = json_documents(spark, [path], ())
    cells = F.from_json("value", "event_id string, username string, source_port bigint")
    return numbered(records.select("source", "seq", cells.alias("e"))).select("pos", "e.*")


@register("stix_bundle", STIX_COUNTS_SQL)
def stix_bundle(spark, sf_dir):
    """The envelope with all objects as one file, read back over splits: the objects
    of the list, and the envelope around it."""
    path = scratch_dir(spark, "bundle.json")
    rows = stix.stix_objects(event_rows(spark, sf_dir), identity_id=IDENTITY, now=NOW, order=["id"])
    stix.write_bundle(rows, path, "bundle--1")
    plan = document_plan(spark, [path], ("objects",))
    bundles = envelopes(plan).filter(F.get_json_object("value", "$.id") == "bundle--1").select("source")
    found = records_of(plan).join(bundles, "source", "left_semi").select(F.from_json("value", "type string, id string").alias("o"))
    return found.groupBy("o.type").agg(F.count_distinct("o.id").alias("n"))


@register(
    "json_splits",
    f"""WITH {FACTS_SQL} SELECT kind, CAST(id AS VARCHAR) AS sig, usr AS username, et AS event_action, ip AS source_ip
        FROM f, (SELECT unnest(['list', 'wrapped', 'trail']) AS kind) WHERE kind <> 'trail'
        UNION ALL SELECT 'trail', CAST(id AS VARCHAR), usr, et, ip FROM f""",
)
def json_splits(spark, sf_dir):
    """Documents of one file each, cut into records over splits of 16 KB: a list,
    an object with a list among other members, and a CloudTrail document."""
    base = facts(spark, sf_dir)
    plain = F.to_json(F.struct(F.col("id").cast("string").alias("sig"), F.lit('q"]},\\ {[').alias("note"), F.col("usr").alias("user"), F.col("et").alias("action"), F.col("ip").alias("src_ip")))
    trail = F.to_json(
        F.struct(F.col("et").alias("eventName"), F.lit("s3.amazonaws.com").alias("eventSource"), F.col("ip").alias("sourceIPAddress"),
                 F.col("id").cast("string").alias("requestID"), F.struct(F.col("usr").alias("userName")).alias("userIdentity"))
    )
    paths = {kind: scratch_dir(spark, kind) for kind in ("list", "wrapped", "trail")}
    write_document(base.select(plain.alias("value")), paths["list"])
    write_document(base.select(plain.alias("value")), paths["wrapped"], '{"meta": {"events": ["}", 1]}, "note": "\\"items\\": [", "items" :\n[', '], "data": [{"no": 1}]}')
    write_document(base.select(trail.alias("value")), paths["trail"], '{"Records": [', "]}")
    out = []
    for kind, path in paths.items():
        keys = TRAIL_KEYS if kind == "trail" else ("events", "items", "data")
        records, others = json_documents(spark, [path], keys, first_key_only=kind == "trail", split_bytes=16_000)
        parser = normalize_cloudtrail if kind == "trail" else normalize_json
        sig = "extensions['request_id']" if kind == "trail" else "extensions['sig']"
        events = parser(records, elements=True).unionByName(parser(others.select(F.lit("lost").alias("value"), F.col("path").alias("source")), elements=True))
        out.append(events.selectExpr(f"'{kind}' AS kind", f"{sig} AS sig", "username", "event_action", "source_ip"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("unknown_format", f"WITH {FACTS_SQL} SELECT id, 'syslog' AS source_format, et AS message FROM f")
def unknown_format(spark, sf_dir):
    """A format nobody knows is read as syslog, by name and by column."""
    lines = facts(spark, sf_dir).selectExpr("id", "et AS value", "'nope' AS fmt")
    by_name = registry.parser_of("nope").normalize(lines.filter("id % 2 = 0"), key=["id"], keep=["id"])
    by_column = route_lines(lines.filter("id % 2 = 1"), fmt_col="fmt", key=["id"], keep=["id"])
    return by_name.unionByName(by_column).select("id", "source_format", "message")


@register("default_session", f"WITH {EVENTS_SQL} SELECT TRUE AS well_formed, count(*) AS n FROM ev GROUP BY 1")
def default_session(spark, sf_dir):
    """Events stored without a session id get one of the batch's start."""
    store = EventStore(spark, scratch_dir(spark, "store"))
    store.insert(event_rows(spark, sf_dir).drop("session_id"))
    named = F.col("session_id").rlike("^[0-9]{8}_[0-9]{6}_[0-9]{6}$")
    return store.events().groupBy(named.alias("well_formed")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(df, line_col="value", *, key=None, keep=()):
    """A format of our own: ``KV user=… act=…``."""
    cell = lambda name: F.regexp_extract(line_col, f"{name}=(\\S+)", 1)
    fields = {"source_format": F.lit("kv"), "raw": F.col(line_col), "message": F.col(line_col), "username": cell("user"), "event_action": cell("act")}
    return emit(df, fields, key, keep)


@register("added_format", f"WITH {FACTS_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'kv' ELSE 'cef' END AS source_format, usr AS username, et AS event_action FROM f")
def added_format(spark, sf_dir):
    """A registered parser with its detection rule, among the built-in ones."""
    from logfathom.plans.streams import _LINE

    lines = facts(spark, sf_dir).selectExpr("id", f"CASE WHEN id % 2 = 0 THEN 'KV user=' || usr || ' act=' || et ELSE {_LINE} END AS value")
    registry.register_parser("kv", _pairs, detect_rule=lambda text: text.startswith("KV "))
    try:
        return route_lines(lines, key=["id"], keep=["id"]).select("id", "source_format", "username", "event_action")
    finally:
        registry.unregister_parser("kv")


@register("added_export", f"WITH {EVENTS_SQL} SELECT 'id ' || event_id AS value FROM ev")
def added_export(spark, sf_dir):
    """A registered writer, found by its name in any case."""
    exports.register_writer("Ids", lambda events, path, **_: events.select(F.concat(F.lit("id "), "event_id")).write.text(path))
    path = scratch_dir(spark, "ids")
    try:
        exports.export(event_rows(spark, sf_dir), "IDS", path)
    finally:
        exports.WRITERS.pop("ids")
    return spark.read.text(path)


@register("zeek_added_type", f"WITH {FACTS_SQL} SELECT 'VPN' AS event_type, usr AS username, count(*) AS n FROM f GROUP BY usr")
def zeek_added_type(spark, sf_dir):
    """A registered Zeek log type; its files are like those of the built-in ones."""
    path = scratch_dir(spark, "zeek")
    rows = facts(spark, sf_dir).selectExpr("u % 4 AS part", "1 AS pos", "epoch || chr(9) || usr AS value")
    heads = rows.select("part").distinct().selectExpr("part", "0 AS pos", "'#path\tvpn' || chr(10) || '#fields\tts\tpeer' AS value")
    files = heads.unionByName(rows).repartition("part").sortWithinPartitions("part", "pos")
    files.select("part", "value").write.partitionBy("part").text(path)
    zeek.register_log_type("vpn", lambda row: {"event_type": F.lit("VPN"), "username": row["peer"], "message": row["peer"]})
    try:
        events = zeek.normalize_zeek(read_lines(spark, path))
    finally:
        zeek.LOG_TYPES.pop("vpn")
    return events.groupBy("event_type", "username").agg(F.count(F.lit(1)).alias("n"))
