"""Queries: streams and the event store, over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfathom.operators.cef import normalize_cef
from logfathom.operators.enrich import enrich_geo, enrich_threat
from logfathom.operators.route import normalize_files
from logfathom.operators.store import EventStore
from logfathom.operators.zeek import normalize_zeek
from logfathom.plans.analytics import event_rows
from logfathom.plans.facts import FACTS_SQL, facts, geo_table, register
from logfathom.session import scratch_dir
from logfathom.sources.lines import read_lines
from logfathom.streaming import watch

_LINE = """'CEF:0|Acme|Wall|1|' || id || '|Seen|' || (k % 11) || '|src=' || ip || ' suser=' || usr || ' act=' || et"""


def _files(spark, sf_dir, sql: str, label: str) -> str:
    """Log lines of every event as text files."""
    path = scratch_dir(spark, label)
    facts(spark, sf_dir, grow=False).selectExpr(f"{sql} AS value").write.text(path)
    return path


def _drain(query) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


_SEV = "(['low','low','low','medium','medium','medium','high','high','critical','critical','critical'])[k % 11 + 1]"


@register(
    "stream_normalize",
    f"WITH {FACTS_SQL} SELECT CAST(id AS VARCHAR) AS sig, ip AS source_ip, usr AS username, et AS event_action, {_SEV} AS severity FROM f",
)
def stream_normalize(spark, sf_dir):
    src, out, mark = _files(spark, sf_dir, _LINE, "in"), scratch_dir(spark, "out"), scratch_dir(spark, "mark")
    fmt = watch.sample_format(spark, src)
    _drain(watch.start_rows(watch.stream_lines(spark, src, 4), fmt, out, mark, once=True))
    return spark.read.parquet(out).selectExpr(
        "extensions['signature_id'] AS sig", "source_ip", "username", "event_action", "severity"
    )


@register(
    "stream_enrich",
    f"""WITH {FACTS_SQL} SELECT CAST(id AS VARCHAR) AS sig,
        starts_with(ip, '185.220.101.') OR ip IN ('45.227.255.0', '45.227.255.1') AS bad,
        id % 11 > 4 AND NOT (k % 20 = 0 AND id % 8 = 0 AND u < 5) AS located FROM f""",
)
def stream_enrich(spark, sf_dir):
    src, out, mark = _files(spark, sf_dir, _LINE, "in"), scratch_dir(spark, "out"), scratch_dir(spark, "mark")
    geo = geo_table(spark, sf_dir)
    _drain(
        watch.start_rows(
            watch.stream_lines(spark, src), "cef", out, mark,
            enrich_with=lambda e: enrich_threat(enrich_geo(e, geo)), once=True,
        )
    )
    return spark.read.parquet(out).selectExpr(
        "extensions['signature_id'] AS sig", "coalesce(is_malicious, false) AS bad", "geo_country IS NOT NULL AS located"
    )


@register("stream_ingest", f"WITH {FACTS_SQL} SELECT CAST(id AS VARCHAR) AS sig, {_SEV} AS severity FROM f")
def stream_ingest(spark, sf_dir):
    """The same files are ingested twice; the second run adds nothing."""
    src = _files(spark, sf_dir, _LINE, "in")
    store = EventStore(spark, scratch_dir(spark, "store"))
    for run in ("one", "two"):
        query = watch.start_ingest(
            watch.stream_lines(spark, src, 2), "cef", store, run, scratch_dir(spark, "mark"), once=True
        )
        _drain(query)
    # all micro-batches of a stream are one session
    return store.events().filter("session_id = 'one'").selectExpr("extensions['signature_id'] AS sig", "severity")


@register("stream_severity", f"WITH {FACTS_SQL} SELECT {_SEV} AS severity, count(*) AS n FROM f GROUP BY 1")
def stream_severity(spark, sf_dir):
    src, out, mark = _files(spark, sf_dir, _LINE, "in"), scratch_dir(spark, "out"), scratch_dir(spark, "mark")
    _drain(watch.start_tally(watch.stream_lines(spark, src, 4), "cef", out, mark, once=True))
    return watch.read_tally(spark, out)


@register(
    "store_ingest",
    f"""WITH {FACTS_SQL} SELECT 's' || (u % 3) AS session_id, count(*) AS n, count(*) FILTER (id % 5 = 0) AS bad
        FROM f WHERE u % 3 <> 1 GROUP BY 1""",
)
def store_ingest(spark, sf_dir):
    """Three sessions inserted, one of them twice, one deleted again."""
    store = EventStore(spark, scratch_dir(spark, "store"))
    owner = facts(spark, sf_dir).selectExpr("id", "'s' || (u % 3) AS owner")
    owned = event_rows(spark, sf_dir).drop("session_id").join(owner, "id")
    for session in ("s0", "s1", "s2", "s2"):
        store.insert(owned.filter(F.col("owner") == session), session, filename="f", fmt="cef", order=["id"])
    store.delete("s1")
    return store.events().groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_malicious").alias("bad")
    )


@register(
    "reingest_files",
    f"""WITH {FACTS_SQL} SELECT CAST(id AS VARCHAR) AS sig, copies FROM (
        SELECT id, 1 AS copies FROM f UNION ALL SELECT id, 2 AS copies FROM f WHERE id % 3 = 0)""",
)
def reingest_files(spark, sf_dir):
    """One folder inserted, then it with a second one, then both again with
    smaller splits: each line is stored once for each file it stands in."""
    first = _files(spark, sf_dir, _LINE, "first")
    second = scratch_dir(spark, "second")
    facts(spark, sf_dir).filter("id % 3 = 0").selectExpr(f"{_LINE} AS value").write.text(second)
    store = EventStore(spark, scratch_dir(spark, "store"))
    sizes = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(sizes)
    store.insert(normalize_cef(read_lines(spark, first)), "a")
    store.insert(normalize_cef(read_lines(spark, [first, second])), "b")
    spark.conf.set(sizes, "40000")
    try:
        store.insert(normalize_cef(read_lines(spark, [first, second])), "c")
    finally:
        spark.conf.set(sizes, before)
    return store.events().selectExpr("extensions['signature_id'] AS sig", "CASE session_id WHEN 'a' THEN 1 WHEN 'b' THEN 2 ELSE 3 END AS copies")


_NAMES = ["a b", "2024:01", "x/y", "p%q", "plain"]


@register(
    "delete_named_session",
    f"WITH {FACTS_SQL} SELECT ['a b', '2024:01', 'x/y', 'p%q', 'plain'][u % 5 + 1] AS session_id, count(*) AS n FROM f "
    "WHERE u % 5 IN (0, 4) GROUP BY 1",
)
def delete_named_session(spark, sf_dir):
    """Sessions whose names hold signs that folder names encode; three go."""
    store = EventStore(spark, scratch_dir(spark, "store"))
    owner = facts(spark, sf_dir).selectExpr("id", "u % 5 AS owner")
    owned = event_rows(spark, sf_dir).drop("session_id").join(owner, "id")
    for place, name in enumerate(_NAMES):
        store.insert(owned.filter(F.col("owner") == place), name, order=["id"])
    for name in _NAMES[1:4]:
        store.delete(name)
    return store.events().groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@register("file_scan", f"WITH {FACTS_SQL} SELECT count(*) AS lines, count(DISTINCT id) AS spots FROM f")
def file_scan(spark, sf_dir):
    """Lines of files; every line has a position of its own."""
    lines = read_lines(spark, _files(spark, sf_dir, "'  line ' || id", "in"))
    spots = F.count_distinct("source", "block", "seq", "sub")
    return lines.agg(F.count(F.lit(1)).alias("lines"), spots.alias("spots"))


@register(
    "file_routing",
    f"""WITH {FACTS_SQL} SELECT fmt AS source_format, count(*) AS n FROM (
        SELECT unnest(['cef', 'json', 'nginx']) AS fmt FROM f) GROUP BY fmt""",
)
def file_routing(spark, sf_dir):
    """Files of three formats; each file's format is detected once."""
    paths = [
        _files(spark, sf_dir, _LINE, "cef"),
        _files(spark, sf_dir, "'{\"type\":\"' || et || '\",\"src_ip\":\"' || ip || '\"}'", "json"),
        _files(spark, sf_dir, "'1.2.3.4 - - [x] \"GET / HTTP/1.0\" 200 ' || id", "web"),
    ]
    return normalize_files(spark, paths).groupBy("source_format").agg(F.count(F.lit(1)).alias("n"))


@register(
    "zeek_files",
    f"WITH {FACTS_SQL} SELECT 'Network/DNS' AS event_type, 'w' || k AS query, count(*) AS n FROM f GROUP BY k",
)
def zeek_files(spark, sf_dir):
    """Zeek files, each with its header in front of its rows."""
    path = scratch_dir(spark, "zeek")
    rows = facts(spark, sf_dir).selectExpr("u % 8 AS part", "1 AS pos", "ip || chr(9) || 'w' || k AS value")
    heads = rows.select("part").distinct().selectExpr(
        "part", "0 AS pos",
        "'#path' || chr(9) || 'dns' || chr(10) || '#fields' || chr(9) || 'id.orig_h' || chr(9) || 'query' AS value",
    )
    files = heads.unionByName(rows).repartition("part").sortWithinPartitions("part", "pos")
    files.select("part", "value").write.partitionBy("part").text(path)
    events = normalize_zeek(read_lines(spark, path))
    return events.groupBy("event_type", F.try_element_at("extensions", F.lit("query")).alias("query")).agg(
        F.count(F.lit(1)).alias("n")
    )
