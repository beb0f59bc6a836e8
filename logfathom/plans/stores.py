"""Queries: what the event store answers without reading all its events."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logfathom.operators import query
from logfathom.operators.cef import normalize_cef
from logfathom.operators.query import EventFilter
from logfathom.operators.store import EventStore, ingest
from logfathom.plans.analytics import EVENTS_SQL, event_rows
from logfathom.plans.facts import FACTS_SQL, facts, register
from logfathom.plans.streams import _LINE, _files
from logfathom.session import scratch_dir
from logfathom.sources.lines import read_lines


def filled(spark: SparkSession, sf_dir: str) -> EventStore:
    """Three sessions of events; one of them twice."""
    store = EventStore(spark, scratch_dir(spark, "store"))
    owner = facts(spark, sf_dir).selectExpr("id", "'s' || (u % 3) AS owner")
    owned = event_rows(spark, sf_dir).drop("session_id").join(owner, "id")
    for session in ("s0", "s1", "s2", "s2"):
        store.insert(owned.filter(F.col("owner") == session), session, filename="f", fmt="cef", order=["id"])
    return store


def _ranked(section: str, column: str) -> str:
    return f"""SELECT * FROM (SELECT '{section}' AS section, {column} AS item, count(*) AS n FROM kept
        WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY n DESC, item LIMIT 10)"""


@register(
    "store_report",
    f"""WITH {EVENTS_SQL}, kept AS (SELECT ev.* FROM ev JOIN f USING (id) WHERE f.u % 3 <> 1)
        SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS item, count(*) AS n FROM kept
        UNION ALL SELECT 'malicious', NULL, count(*) FILTER (is_malicious) FROM kept
        UNION ALL SELECT 'severity', severity, count(*) FROM kept GROUP BY severity
        UNION ALL SELECT 'format', source_format, count(*) FROM kept GROUP BY source_format
        UNION ALL {_ranked("ip", "source_ip")} UNION ALL {_ranked("user", "username")} UNION ALL {_ranked("country", "geo_country")}""",
)
def store_report(spark, sf_dir):
    """The report from the summaries of the parts, after a repeat and a delete."""
    store = filled(spark, sf_dir)
    store.delete("s1")
    return store.report()


@register(
    "store_search",
    f"""WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE message ILIKE '%purchase%q" k=1%' AND lower(source_format) = 'syslog'
        AND source_ip ILIKE '%.1%' AND timestamp >= '2024' AND timestamp <= '2024-01-20'""",
)
def store_search(spark, sf_dir):
    """A search that reads the files whose signatures and bounds allow a match."""
    where = EventFilter(search='purchase%q" k=1', source_format="SYSLOG", source_ip=".1", from_time="2024", to_time="2024-01-20")
    return filled(spark, sf_dir).events(where=where).select("event_id")


@register("delete_all", f"WITH {EVENTS_SQL} SELECT count(*) AS gone, 0 AS left_over, count(*) AS at_version FROM ev")
def delete_all(spark, sf_dir):
    """Everything goes at once; the version before still has it."""
    store = filled(spark, sf_dir)
    before = store.version()
    gone = store.delete()
    counts = [store.events().agg(F.count(F.lit(1)).alias("left_over")), store.events(before).agg(F.count(F.lit(1)).alias("at_version"))]
    return counts[0].crossJoin(counts[1]).select(F.lit(gone).alias("gone"), F.col("left_over").cast("int"), "at_version")


@register(
    "page_after",
    f"WITH {EVENTS_SQL} SELECT event_id FROM ev ORDER BY timestamp DESC NULLS LAST, event_id LIMIT 50 OFFSET 75",
)
def page_after(spark, sf_dir):
    """The page behind the last event of the page before, by its key."""
    events = event_rows(spark, sf_dir)
    last = None
    for _ in range(3):
        # the last row of a page, which is the one at its end
        last = tuple(query.page_after(events, last, 25).select("timestamp", "event_id").tail(1)[0])
    return query.page_after(events, last, 50).select("event_id")


@register("store_writers", f"WITH {EVENTS_SQL} SELECT event_id, 1 AS n FROM ev")
def store_writers(spark, sf_dir):
    """Two writers at once, whose events overlap: each event is stored once."""
    path = scratch_dir(spark, "store")
    rows = event_rows(spark, sf_dir).drop("session_id")

    def write(name: str, keep: str) -> int:
        return EventStore(spark, path).insert(rows.filter(keep), name, order=["id"])

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, ("a", "b"), ("id % 3 <> 0", "id % 3 <> 1")))
    return EventStore(spark, path).events().groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@register(
    "reingest_ledger",
    f"""WITH {FACTS_SQL} SELECT CAST(id AS VARCHAR) AS sig, copies FROM (
        SELECT id, 1 AS copies FROM f UNION ALL SELECT id, 2 AS copies FROM f WHERE id % 3 = 0)""",
)
def reingest_ledger(spark, sf_dir):
    """As reingest_files, with a ledger of lines: a folder of new files is
    compared with nothing, files met again only with the part made of them."""
    first, second = _files(spark, sf_dir, _LINE, "first"), scratch_dir(spark, "second")
    facts(spark, sf_dir).filter("id % 3 = 0").selectExpr(f"{_LINE} AS value").write.text(second)
    store = EventStore(spark, scratch_dir(spark, "store"))
    for name, paths in (("a", [first]), ("b", [first, second]), ("c", [second, first])):
        ingest(read_lines(spark, paths), normalize_cef, store, session_id=name)
    store.compact("b")
    return store.events().selectExpr("extensions['signature_id'] AS sig", "CASE session_id WHEN 'a' THEN 1 WHEN 'b' THEN 2 ELSE 3 END AS copies")
