"""Enrichment of events by source address: geography, reverse DNS, threat data.

All tables come in as frames; nothing is looked up over the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.net import ipv4_number, ipv6_hex, is_private
from logfathom.functions.text import filled
from logfathom.model import text_map
from logfathom.operators.lookup import fits_broadcast, lookup_join
from logfathom.session import cut_lineage

GEO_COLUMNS = {
    "country": "geo_country",
    "country_code": "geo_country_code",
    "city": "geo_city",
    "lat": "geo_lat",
    "lon": "geo_lon",
    "isp": "geo_isp",
    "asn": "geo_asn",
}
# Addresses and one address prefix that count as malicious.
BLOCKED_IPS = (
    "185.220.101.0", "185.220.101.1", "185.220.101.2", "45.227.255.0", "45.227.255.1",
    "198.235.24.0", "192.241.236.0",
)
BLOCKED_PREFIX = "185.220.101."
MALICIOUS_FROM = 50
SOURCE_FEED = "abuseipdb"
SOURCE_LIST = "local_blocklist"

_WIDE = 1 << 16
_NARROW = 1 << 8


def lookup_addresses(events: DataFrame, public_only: bool = False) -> DataFrame:
    """Distinct non-empty source addresses. Repeats collapse before the shuffle."""
    ips = events.select("source_ip").filter(filled(F.col("source_ip")).isNotNull())
    if public_only:
        ips = ips.filter(~is_private(F.col("source_ip")))
    return ips.distinct()


# --- geography ----------------------------------------------------------------


def _geo_record() -> Column:
    width = F.col("ip_hi") - F.col("ip_lo")
    return F.struct(
        width.alias("width"), F.col("ip_lo").alias("lo"), F.col("ip_hi").alias("hi"),
        *[F.col(c) for c in GEO_COLUMNS],
    )


def geo_blocks(geo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut address ranges so that a lookup is an equality.

    A range gives the whole /16 blocks inside it (any address of such a block
    is covered; the narrowest range per block is kept) and at most two rests,
    cut into /24 blocks with the ranges that touch the block. A range of any
    width gives at most 65,536 + 512 pieces.
    """
    lo, hi = F.col("ip_lo"), F.col("ip_hi")
    first = F.floor((lo + (_WIDE - 1)) / _WIDE).cast("bigint")
    end = F.floor((hi + 1) / _WIDE).cast("bigint")
    base = geo.filter(lo <= hi).select(
        lo.alias("lo"), hi.alias("hi"), first.alias("first"), end.alias("end"),
        _geo_record().alias("geo"),
    )
    has_whole = F.col("first") < F.col("end")
    wide = (
        base.filter(has_whole)
        .select(F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("block"), "geo")
        .groupBy("block")
        .agg(F.min("geo").alias("wide"))
    )
    rests = F.when(
        has_whole,
        F.filter(
            F.array(
                F.struct(F.col("lo").alias("a"), (F.col("first") * _WIDE - 1).alias("b")),
                F.struct((F.col("end") * _WIDE).alias("a"), F.col("hi").alias("b")),
            ),
            lambda r: r["a"] <= r["b"],
        ),
    ).otherwise(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"))))
    narrow = (
        base.select(F.explode(rests).alias("rest"), "geo")
        .select(
            F.explode(
                F.sequence(
                    F.floor(F.col("rest.a") / _NARROW).cast("bigint"),
                    F.floor(F.col("rest.b") / _NARROW).cast("bigint"),
                )
            ).alias("block"),
            "geo",
        )
        .groupBy("block")
        .agg(F.array_sort(F.collect_set("geo")).alias("narrow"))
    )
    return wide, narrow


def _with_geo(rows: DataFrame, wide: DataFrame, narrow: DataFrame, small: bool) -> DataFrame:
    """Add ``__geo``: the narrowest range that holds the row's address."""
    number = F.when(~is_private(F.col("source_ip")), ipv4_number(F.col("source_ip")))
    keyed = rows.withColumn("__ip", number).withColumns(
        {
            "__wide": F.shiftright(F.col("__ip"), 16),
            "__narrow": F.shiftright(F.col("__ip"), 8),
        }
    )
    salt_by = ["source_ip"]
    found = lookup_join(keyed, wide, {"__wide": "block"}, salt_by=salt_by, prefix="__g_", small=small)
    found = lookup_join(found, narrow, {"__narrow": "block"}, salt_by=salt_by, prefix="__g_", small=small)
    ip = F.col("__ip")
    # sorted by width, so the first that holds the address is the narrowest
    inside = F.get(
        F.filter(F.col("__g_narrow"), lambda g: (g["lo"] <= ip) & (ip <= g["hi"])), F.lit(0)
    )
    return found.withColumn("__geo", F.least(inside, F.col("__g_wide"))).drop(
        "__ip", "__wide", "__narrow", "__g_wide", "__g_narrow"
    )


_SIGNS = 32  # hexadecimal, of an IPv6 address


def _digit(text: Column, i: Column) -> Column:
    return F.conv(F.substring(text, i + 1, F.lit(1)), 16, 10).cast("int")


def _below(prefix: Column, first: Column, last: Column) -> Column:
    """The prefixes one digit longer, with digits from ``first`` to ``last``."""
    digits = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(digits, lambda d: F.concat(prefix, F.lower(F.hex(d.cast("bigint")))))


def prefixes(lo: Column, hi: Column) -> Column:
    """The digit prefixes that make up a range of addresses in hexadecimal.

    Below the first digit that differs, the range holds whole digits between
    the two bounds, and on each side those beyond a bound's digits. Zeros at the
    end of the lower bound, and f at that of the upper one, end a side early, so
    a network gives few prefixes, and no range more than a thousand.
    """
    both = F.sequence(F.lit(0), F.lit(_SIGNS - 1))
    same = F.coalesce(F.get(F.filter(both, lambda i: F.substring(lo, i + 1, F.lit(1)) != F.substring(hi, i + 1, F.lit(1))), F.lit(0)), F.lit(_SIGNS))
    low_end = F.greatest(F.length(F.rtrim(lo, F.lit("0"))), same + 1)
    high_end = F.greatest(F.length(F.rtrim(hi, F.lit("f"))), same + 1)

    def side(text: Column, end: Column, part) -> Column:
        levels = F.when(same + 1 <= end - 1, F.sequence(same + 1, end - 1)).otherwise(F.array().cast("array<int>"))
        inner = F.flatten(F.transform(levels, lambda j: part(F.substring(text, F.lit(1), j), _digit(text, j))))
        return F.concat(F.array(F.substring(text, F.lit(1), end)), inner)

    low = side(lo, low_end, lambda prefix, d: _below(prefix, d + 1, F.lit(15)))
    high = side(hi, high_end, lambda prefix, d: _below(prefix, F.lit(0), d - 1))
    middle = _below(F.substring(lo, F.lit(1), same), _digit(lo, same) + 1, _digit(hi, same) - 1)
    whole = (F.rtrim(F.substr(lo, same + 1), F.lit("0")) == "") & (F.rtrim(F.substr(hi, same + 1), F.lit("f")) == "")
    return F.when(whole, F.array(F.substring(lo, F.lit(1), same))).otherwise(F.concat(low, middle, high))


def _width6(lo: Column, hi: Column) -> Column:
    """Upper minus lower bound as two halves of 64 bits, which compare in order."""

    def half(text: Column, at: int) -> Column:
        return F.conv(F.substring(text, at, 16), 16, 10).cast("decimal(20,0)")

    upper, lower = half(hi, 1) - half(lo, 1), half(hi, 17) - half(lo, 17)
    borrow = lower < 0
    return F.struct(
        F.when(borrow, upper - 1).otherwise(upper).cast("decimal(21,0)").alias("upper"),
        F.when(borrow, lower + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(lower).cast("decimal(21,0)").alias("lower"),
    )


def geo_of_ipv6(events: DataFrame, geo6: DataFrame) -> DataFrame:
    """(source_ip, geo) of the distinct public IPv6 addresses that are in a range.

    Ranges are cut into prefixes, addresses into the prefixes of the lengths
    that occur (33 at most), and both meet by equality; of the ranges that hold
    an address the narrowest stays.
    """
    bounds = geo6.select(ipv6_hex(F.col("ip_lo")).alias("lo"), ipv6_hex(F.col("ip_hi")).alias("hi"), F.struct(*GEO_COLUMNS).alias("geo"))
    pieces = bounds.filter(F.col("lo") <= F.col("hi")).select(
        F.explode(prefixes(F.col("lo"), F.col("hi"))).alias("prefix"), F.struct(_width6(F.col("lo"), F.col("hi")).alias("width"), "lo", "geo").alias("range")
    )
    table = cut_lineage(pieces.groupBy("prefix").agg(F.min("range").alias("range")), "geo6")
    lengths = sorted(r[0] for r in table.select(F.length("prefix")).distinct().collect())
    ips = lookup_addresses(events, public_only=True).withColumn("hex", ipv6_hex(F.col("source_ip"))).filter("hex IS NOT NULL")
    cuts = F.array(*[F.substring("hex", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")
    met = ips.select("source_ip", F.explode(cuts).alias("prefix")).join(table, "prefix")
    return met.groupBy("source_ip").agg(F.min("range")["geo"].alias("geo"))


def enrich_geo(
    events: DataFrame, geo: DataFrame, geo_ips: DataFrame | None = None, *, geo6: DataFrame | None = None, id_col: str = "event_id"
) -> DataFrame:
    """Left lookup of the geo columns of public source addresses.

    ``geo`` holds IPv4 ranges (``ip_lo``, ``ip_hi`` and the geo columns),
    nested ones allowed: the narrowest wins. ``geo6`` holds IPv6 ranges, whose
    bounds are text. ``geo_ips`` holds single addresses of any family (``ip``
    and the geo columns) and goes first.

    Range pieces within the broadcast bound are looked up per event. Larger
    ones are looked up once per distinct address, and the addresses are then
    joined to the events with salted keys.
    """
    wide, narrow = geo_blocks(geo)
    if fits_broadcast(wide) and fits_broadcast(narrow):
        rows = _with_geo(events, wide, narrow, small=True)
    else:
        ips = _with_geo(lookup_addresses(events, public_only=True), wide, narrow, small=False)
        rows = lookup_join(
            events, ips, {"source_ip": "source_ip"}, salt_by=[id_col], small=False
        )
    picked = {new: F.col("__geo")[old] for old, new in GEO_COLUMNS.items()}
    if geo_ips is not None:
        rows = lookup_join(rows, geo_ips, {"source_ip": "ip"}, salt_by=[id_col], prefix="__x_")
        exact = ~is_private(F.col("source_ip"))
        picked = {
            new: F.coalesce(F.when(exact, F.col(f"__x_{old}")), picked[new])
            for old, new in GEO_COLUMNS.items()
        }
    if geo6 is not None:
        table = cut_lineage(geo_of_ipv6(events, geo6), "geo6-addresses")
        rows = lookup_join(rows, table, {"source_ip": "source_ip"}, salt_by=[id_col], prefix="__6_")
        picked = {new: F.coalesce(picked[new], F.col("__6_geo")[old]) for old, new in GEO_COLUMNS.items()}
    found = F.col("__geo").isNotNull() if geo_ips is None and geo6 is None else F.lit(True)
    out = rows.withColumns(
        {new: F.when(found & c.isNotNull(), c).otherwise(F.col(new)) for new, c in picked.items()}
    )
    return out.drop("__geo", "__6_geo", *[f"__x_{c}" for c in GEO_COLUMNS])


# --- reverse DNS --------------------------------------------------------------


def enrich_rdns(events: DataFrame, rdns: DataFrame, *, id_col: str = "event_id") -> DataFrame:
    """Left lookup ``ip`` -> ``hostname``; a name equal to the address is none."""
    rows = lookup_join(events, rdns, {"source_ip": "ip"}, salt_by=[id_col], prefix="__r_")
    name = F.nullif(F.col("__r_hostname"), F.col("source_ip"))
    return rows.withColumn("rdns", F.coalesce(name, F.col("rdns"))).drop("__r_hostname")


# --- threat data --------------------------------------------------------------


def blocked(ip: Column) -> Column:
    """On the fixed list, or below its prefix. No table is needed for this."""
    return F.coalesce(ip.isin(*BLOCKED_IPS) | ip.startswith(BLOCKED_PREFIX), F.lit(False))


def _apply_threat(
    rows: DataFrame, hit: Column, score: Column, bad: Column, notes: dict[str, Column]
) -> DataFrame:
    """Score, flag, raised severity and the ``ti_*`` notes on matched events."""
    raise_it = hit & bad & ~F.coalesce(F.col("severity").isin("critical", "high"), F.lit(False))
    extra = text_map(*notes.items())
    return rows.withColumns(
        {
            "abuse_score": F.when(hit, score).otherwise(F.col("abuse_score")).cast("int"),
            "is_malicious": F.when(hit, bad).otherwise(F.col("is_malicious")),
            "severity": F.when(raise_it, F.lit("high")).otherwise(F.col("severity")),
            "severity_code": F.when(raise_it, F.lit(8)).otherwise(F.col("severity_code")),
            "extensions": F.when(hit, F.map_concat(F.col("extensions"), extra)).otherwise(
                F.col("extensions")
            ),
        }
    )


def enrich_threat(
    events: DataFrame, reputation: DataFrame | None = None, *, id_col: str = "event_id"
) -> DataFrame:
    """With a reputation table: its score, malicious from 50 on. Without: the
    fixed block list, score 100. A malicious event that is neither critical
    nor high becomes high (8)."""
    none = F.lit(None).cast("string")
    if reputation is None:
        return _apply_threat(
            events,
            blocked(F.col("source_ip")),
            F.lit(100),
            F.lit(True),
            {
                "ti_total_reports": none,
                "ti_last_reported": none,
                "ti_usage_type": none,
                "ti_source": F.lit(SOURCE_LIST),
            },
        )
    feed = reputation.select(
        "ip",
        F.coalesce("abuse_score", F.lit(0)).alias("score"),
        F.coalesce("total_reports", F.lit(0)).alias("reports"),
        F.col("last_reported").alias("last"),
        F.col("usage_type").alias("usage"),
    )
    rows = lookup_join(events, feed, {"source_ip": "ip"}, salt_by=[id_col], prefix="__t_")
    score = F.col("__t_score")
    out = _apply_threat(
        rows,
        score.isNotNull(),
        score,
        score >= MALICIOUS_FROM,
        {
            "ti_total_reports": F.col("__t_reports"),
            "ti_last_reported": F.col("__t_last"),
            "ti_usage_type": F.col("__t_usage"),
            "ti_source": F.lit(SOURCE_FEED),
        },
    )
    return out.drop("__t_score", "__t_reports", "__t_last", "__t_usage")


def enrich(
    events: DataFrame,
    *,
    geo: DataFrame | None = None,
    geo_ips: DataFrame | None = None,
    geo6: DataFrame | None = None,
    rdns: DataFrame | None = None,
    threat: bool = False,
    reputation: DataFrame | None = None,
    id_col: str = "event_id",
) -> DataFrame:
    """Geography, then reverse DNS, then threat data, each where it is asked for."""
    out = events
    if geo is None and (geo_ips is not None or geo6 is not None):
        none = ", ".join(f"{c} {'double' if c in ('lat', 'lon') else 'string'}" for c in GEO_COLUMNS)
        geo = events.sparkSession.createDataFrame([], f"ip_lo bigint, ip_hi bigint, {none}")
    if geo is not None:
        out = enrich_geo(out, geo, geo_ips, geo6=geo6, id_col=id_col)
    if rdns is not None:
        out = enrich_rdns(out, rdns, id_col=id_col)
    if threat:
        out = enrich_threat(out, reputation, id_col=id_col)
    return out
