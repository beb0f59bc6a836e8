"""What the registered queries read: facts of the given tables.

Log text is rendered from table columns, parsed by the library, and checked
by SQL that computes the expected columns from the same facts without
looking at the text. Expressions here are in the SQL both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logfathom.model import keep_filters_above
from logfathom.session import prepare, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- events as facts ---------------------------------------------------------

_SPARK_BASE = {
    "id": "event_id",
    "u": "user_id",
    "et": "event_type",
    "k": "CAST(get_json_object(props, '$.k') AS INT)",
    "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "mon": "date_format(ts, 'MMM')",
    "dd": "date_format(ts, 'dd')",
    "hms": "date_format(ts, 'HH:mm:ss')",
    "ymd": "date_format(ts, 'yyyy/MM/dd')",
    "dmy": "date_format(ts, 'dd/MMM/yyyy')",
    "epoch": "unix_seconds(CAST(ts AS TIMESTAMP))",
}
_DUCK_BASE = {
    "id": "event_id",
    "u": "user_id",
    "et": "event_type",
    "k": "CAST(json_extract_string(props, '$.k') AS INTEGER)",
    "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    "mon": "strftime(ts, '%b')",
    "dd": "strftime(ts, '%d')",
    "hms": "strftime(ts, '%H:%M:%S')",
    "ymd": "strftime(ts, '%Y/%m/%d')",
    "dmy": "strftime(ts, '%d/%b/%Y')",
    "epoch": "CAST(floor(epoch(ts)) AS BIGINT)",
}
SHARED = {
    "ip": """CASE WHEN id % 11 = 0 THEN '10.0.' || (u % 256) || '.' || (k % 256)
        WHEN id % 11 = 1 THEN '185.220.101.' || (k % 256)
        WHEN id % 11 = 2 THEN '45.227.255.' || (k % 4)
        WHEN id % 11 = 3 THEN '2001:db8::' || (u % 10)
        WHEN id % 11 = 4 THEN '172.' || (k % 40) || '.0.' || (u % 256)
        ELSE (20 + u % 25) || '.' || (k % 20) || '.' || (id % 8) || '.' || (u % 256) END""",
    "dst": "'192.168.' || (k % 256) || '.' || (id % 250)",
    "sport": "1024 + id % 60000",
    "dport": "CASE WHEN id % 4 = 0 THEN 443 WHEN id % 4 = 1 THEN 22 ELSE 8000 + k END",
    "usr": "'user' || u",
    "host": "'host-' || (u % 10)",
    "label": "CASE WHEN id % 6 = 0 THEN 'critical' WHEN id % 6 = 1 THEN 'high' "
    "WHEN id % 6 = 2 THEN 'medium' WHEN id % 6 = 3 THEN 'low' WHEN id % 6 = 4 THEN 'High' END",
}


def facts(spark: SparkSession, sf_dir: str, grow: bool = True) -> DataFrame:
    """Facts of all events. Filters stay above the spread: below it, a condition on
    a rendered text would be worked out in the few tasks of the scan."""
    rows = keep_filters_above(spread(table(spark, sf_dir, "events"), grow))
    base = rows.selectExpr(*[f"{sql} AS {name}" for name, sql in _SPARK_BASE.items()])
    return base.selectExpr("*", *[f"{sql} AS {name}" for name, sql in SHARED.items()])


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


FACTS_SQL = (
    f"base AS (SELECT {_list(_DUCK_BASE)} FROM events), "
    f"f AS (SELECT *, {_list(SHARED)} FROM base)"
)

# --- orders as facts -----------------------------------------------------------

_SPARK_ORDERS = {
    "id": "o_orderkey",
    "c": "o_custkey",
    "st": "o_orderstatus",
    "pr": "o_orderpriority",
    "day": "date_format(o_orderdate, 'yyyy-MM-dd')",
}
_DUCK_ORDERS = _SPARK_ORDERS | {"day": "strftime(o_orderdate, '%Y-%m-%d')"}


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep_filters_above(spread(table(spark, sf_dir, "orders")))
    return rows.selectExpr(*[f"{sql} AS {name}" for name, sql in _SPARK_ORDERS.items()])


ORDERS_SQL = f"o AS (SELECT {_list(_DUCK_ORDERS)} FROM orders)"

# --- dimension tables out of the given ones --------------------------------------

# a wide range per nation and a narrower one inside it
GEO_SQL = """
SELECT (20 + n_nationkey) * 16777216 + 5 AS ip_lo, (21 + n_nationkey) * 16777216 - 7 AS ip_hi,
       n_name AS country, 'C' || n_nationkey AS country_code, 'Town ' || n_nationkey AS city,
       n_nationkey * 1.5 AS lat, n_nationkey * -0.25 AS lon,
       'ISP ' || n_regionkey AS isp, 'AS' || (1000 + n_nationkey) AS asn
FROM {nation}
UNION ALL
SELECT (20 + n_nationkey) * 16777216 + 655360, (20 + n_nationkey) * 16777216 + 655360 + 1279,
       n_name, 'C' || n_nationkey, 'Quarter ' || n_nationkey,
       n_nationkey * 2.5, n_nationkey * -0.5,
       'Local ISP', 'AS' || (2000 + n_nationkey)
FROM {nation}
"""
RDNS_SQL = """
SELECT ip, min(CASE WHEN c % 7 = 0 THEN ip ELSE 'pc' || (c % 300) || '.corp' END) AS hostname
FROM (SELECT c_custkey AS c, '10.0.' || (c_custkey % 150) || '.' || (c_custkey % 100) AS ip
      FROM {customer}) t
GROUP BY ip
"""
REPUTATION_SQL = """
SELECT ip, max(score) AS abuse_score, max(score * 2) AS total_reports,
       max('2024-01-' || (10 + score % 20)) AS last_reported, max('type' || (score % 3)) AS usage_type
FROM (SELECT '172.' || (s_suppkey % 40) || '.0.' || (s_suppkey % 150) AS ip,
             s_suppkey * 7 % 101 AS score FROM {supplier}) t
GROUP BY ip
"""


def dimension(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf_dir, name)})


def geo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension(spark, sf_dir, GEO_SQL, "nation").selectExpr(
        "CAST(ip_lo AS BIGINT) ip_lo", "CAST(ip_hi AS BIGINT) ip_hi", "country", "country_code",
        "city", "CAST(lat AS DOUBLE) lat", "CAST(lon AS DOUBLE) lon", "isp", "asn",
    )


def rdns_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension(spark, sf_dir, RDNS_SQL, "customer")


def reputation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension(spark, sf_dir, REPUTATION_SQL, "supplier")


def duck(sql: str) -> str:
    return sql.format(nation="nation", customer="customer", supplier="supplier")


# --- expected event columns --------------------------------------------------------

TYPES = {
    "timestamp": "VARCHAR", "source_host": "VARCHAR", "source_ip": "VARCHAR",
    "source_port": "INTEGER", "dest_ip": "VARCHAR", "dest_port": "INTEGER",
    "event_type": "VARCHAR", "event_action": "VARCHAR", "severity": "VARCHAR",
    "severity_code": "INTEGER", "category": "VARCHAR", "username": "VARCHAR",
    "user_id": "VARCHAR", "process_name": "VARCHAR", "process_id": "BIGINT",
    "protocol": "VARCHAR", "bytes_in": "BIGINT", "bytes_out": "BIGINT", "message": "VARCHAR",
}
COMMON = list(TYPES)


def expected(
    columns: dict[str, str],
    source: str = "f",
    *,
    fallback: str = "FALSE",
    text: str = "NULL",
    extra: dict[str, str] | None = None,
    where: str = "TRUE",
) -> str:
    """SELECT of the expected events: ``columns`` per field, or only the text
    as message where ``fallback`` holds."""
    cells = ["id"]
    for name, kind in TYPES.items():
        value = columns.get(name, "NULL")
        rest = f"({text})" if name == "message" else "NULL"
        cells.append(f"CAST(CASE WHEN {fallback} THEN {rest} ELSE ({value}) END AS {kind}) AS {name}")
    for name, value in (extra or {}).items():
        cells.append(
            f"CAST(CASE WHEN {fallback} THEN NULL ELSE ({value}) END AS VARCHAR) AS {name}"
        )
    return f"SELECT {', '.join(cells)} FROM {source} WHERE {where}"


def shown(events: DataFrame, extra: dict[str, str] | None = None, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The columns the checks look at; ``extra`` maps a name to an extension key."""
    return events.selectExpr(
        *keys, *COMMON, *[f"try_element_at(extensions, '{k}') AS {n}" for n, k in (extra or {}).items()]
    )
