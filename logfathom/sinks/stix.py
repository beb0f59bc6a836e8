"""STIX 2.1 objects of events, as rows (id, type, json)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.ids import stix_digest, stix_id, uuid_text
from logfathom.functions.net import address_type
from logfathom.functions.severity import confidence
from logfathom.functions.text import filled
from logfathom.model import stage
from logfathom.sinks.document import write_document

VERSION = "2.1"
RAW_LIMIT = 500
DEFAULT_IDENTITY = "SIEM Parser"


def _of(kind: str | Column) -> Column:
    return F.lit(kind) if isinstance(kind, str) else kind


def _own_id(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}--"), F.col("event_id"))


def address_id(ip: Column) -> Column:
    """NULL without an address."""
    return F.when(filled(ip).isNotNull(), stix_id(address_type(ip), ip))


def user_ref(name: Column) -> Column:
    return F.when(filled(name).isNotNull(), stix_id(F.lit("user-account"), name))


def with_refs(events: DataFrame) -> DataFrame:
    """Add the ids of an event's addresses and user as ``__ref_…``, for its objects
    to name. In a condition a digest would be worked out for each use, so kinds
    and digests are columns before."""
    kinds = {c: address_type(F.col(c)) for c in ("source_ip", "dest_ip")} | {"username": F.lit("user-account")}
    return stage(events, [
        {f"__kind_{c}": kind for c, kind in kinds.items()},
        {f"__digest_{c}": stix_digest(F.col(f"__kind_{c}"), F.col(c)) for c in kinds},
        {f"__ref_{c}": F.when(filled(F.col(c)).isNotNull(), F.concat(f"__kind_{c}", F.lit("--"), uuid_text(F.col(f"__digest_{c}")))) for c in kinds},
    ])


def _object(kind: str | Column, ident: Column, parts: list[Column], nulls: bool = False) -> Column:
    """(id, type, json) of one object."""
    body = F.struct(
        _of(kind).alias("type"), F.lit(VERSION).alias("spec_version"), ident.alias("id"), *parts
    )
    options = {"ignoreNullFields": "false"} if nulls else {}
    return F.struct(ident.alias("id"), _of(kind).alias("type"), F.to_json(body, options).alias("json"))


def _rows(df: DataFrame, made: Column) -> DataFrame:
    return df.select(made.alias("__made")).select("__made.*")


def addresses(events: DataFrame) -> DataFrame:
    """One object per distinct source or destination address."""
    both = events.select(F.explode(F.array("source_ip", "dest_ip")).alias("ip"))
    ips = both.filter(filled(F.col("ip")).isNotNull()).distinct()
    ip = F.col("ip")
    return _rows(ips, _object(address_type(ip), address_id(ip), [ip.alias("value")]))


def has_address() -> Column:
    return filled(F.col("source_ip")).isNotNull() | filled(F.col("dest_ip")).isNotNull()


def _traffic(now: Column) -> Column:
    protocol = F.lower(filled(F.col("protocol")))
    src, dst = F.col("__ref_source_ip"), F.col("__ref_dest_ip")
    zero = F.lit(0)
    return _object(
        "network-traffic",
        _own_id("network-traffic"),
        [
            F.coalesce(filled(F.col("timestamp")), now).alias("start"),
            F.array(F.coalesce(protocol, F.lit("tcp"))).alias("protocols"),
            src.alias("src_ref"),
            F.when(src.isNotNull(), F.nullif(F.col("source_port"), zero)).alias("src_port"),
            dst.alias("dst_ref"),
            F.when(dst.isNotNull(), F.nullif(F.col("dest_port"), zero)).alias("dst_port"),
        ],
    )


def traffic(events: DataFrame, now: Column) -> DataFrame:
    """One network-traffic object per event with an address."""
    return _rows(with_refs(events.filter(has_address())), _traffic(now))


def users(events: DataFrame, order: list[str]) -> DataFrame:
    """One object per user name; its id is that of the first event by ``order``."""
    named = events.filter(filled(F.col("username")).isNotNull())
    first = named.groupBy("username").agg(
        F.min_by(
            F.coalesce(filled(F.col("user_id")), F.col("username")), F.struct(*order)
        ).alias("account")
    )
    name = F.col("username")
    cells = [F.col("account").alias("user_id"), name.alias("account_login")]
    return _rows(first, _object("user-account", user_ref(name), cells))


def _process() -> Column:
    return _object(
        "process",
        _own_id("process"),
        [
            F.col("process_name").alias("command_line"),
            F.nullif(F.col("process_id"), F.lit(0).cast("bigint")).alias("pid"),
        ],
    )


def has_process() -> Column:
    return filled(F.col("process_name")).isNotNull()


def processes(events: DataFrame) -> DataFrame:
    """One object per event with a process name."""
    return _rows(events.filter(has_process()), _process())


def is_bare() -> Column:
    """No address, user or process to refer to."""
    return (
        ~has_address()
        & filled(F.col("username")).isNull()
        & filled(F.col("process_name")).isNull()
    )


def _bare_log() -> Column:
    return _object(
        "x-siem-log",
        _own_id("x-siem-log"),
        [
            F.coalesce("message", F.lit("")).alias("x_message"),
            F.col("source_format").alias("x_source_format"),
            F.substring(F.coalesce("raw", F.lit("")), 1, RAW_LIMIT).alias("x_raw"),
        ],
    )


def bare_logs(events: DataFrame) -> DataFrame:
    """A custom object for events that have nothing else to refer to."""
    return _rows(events.filter(is_bare()), _bare_log())


def object_refs() -> Column:
    """Distinct references of an event (``with_refs``) in order: source, destination,
    traffic, user, process, or the custom object alone."""
    refs = F.array(
        F.col("__ref_source_ip"),
        F.col("__ref_dest_ip"),
        F.when(has_address(), _own_id("network-traffic")),
        F.col("__ref_username"),
        F.when(filled(F.col("process_name")).isNotNull(), _own_id("process")),
        F.when(is_bare(), _own_id("x-siem-log")),
    )
    return F.array_distinct(F.array_compact(refs))


def _observation(identity_id: str, now: Column) -> Column:
    when = F.coalesce(filled(F.col("timestamp")), now)
    return _object(
        "observed-data",
        _own_id("observed-data"),
        [
            F.lit(identity_id).alias("created_by_ref"),
            when.alias("created"),
            when.alias("modified"),
            when.alias("first_observed"),
            when.alias("last_observed"),
            F.lit(1).alias("number_observed"),
            confidence(F.col("severity_code")).alias("confidence"),
            object_refs().alias("object_refs"),
            F.col("source_format").alias("x_siem_source_format"),
            F.col("event_type").alias("x_siem_event_type"),
            F.col("event_action").alias("x_siem_event_action"),
            F.col("severity").alias("x_siem_severity"),
            F.col("message").alias("x_siem_message"),
        ],
        nulls=True,
    )


def observations(events: DataFrame, identity_id: str, now: Column) -> DataFrame:
    """One observed-data object per event."""
    return _rows(with_refs(events), _observation(identity_id, now))


def new_identity_id() -> str:
    """A fresh identity id for one export."""
    return f"identity--{uuid.uuid4()}"


def identity(events: DataFrame, identity_id: str, now: Column, name: str) -> DataFrame:
    cells = [
        now.alias("created"),
        now.alias("modified"),
        F.lit(name).alias("name"),
        F.lit("system").alias("identity_class"),
    ]
    return _rows(events.sparkSession.range(1), _object("identity", F.lit(identity_id), cells))


def event_objects(events: DataFrame, identity_id: str, now: Column) -> DataFrame:
    """The objects that each event has of its own, in one pass."""
    made = F.array(
        F.when(has_address(), _traffic(now)), F.when(has_process(), _process()),
        F.when(is_bare(), _bare_log()), _observation(identity_id, now),
    )
    return with_refs(events).select(F.inline(F.array_compact(made)))


def shared_objects(events: DataFrame, order: list[str]) -> DataFrame:
    """Addresses and users, one object per value: one pass over four columns,
    one aggregate by value."""
    account = F.coalesce(filled(F.col("user_id")), F.col("username"))
    spot = F.struct(*order)
    none = F.lit(None)
    cells = [
        F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"), (account if kind == "user" else none.cast("string")).alias("account"), spot.alias("spot"))
        for kind, c in (("ip", "source_ip"), ("ip", "dest_ip"), ("user", "username"))
    ]
    rows = events.select(F.inline(F.array(*cells))).filter(filled(F.col("value")).isNotNull())
    found = rows.groupBy("kind", "value").agg(F.min_by("account", "spot").alias("account"))
    value = F.col("value")
    ip = _object(address_type(value), address_id(value), [value.alias("value")])
    user = _object("user-account", user_ref(value), [F.col("account").alias("user_id"), value.alias("account_login")])
    return _rows(found, F.when(F.col("kind") == "ip", ip).otherwise(user))


def stix_objects(
    events: DataFrame,
    *,
    identity_id: str | None = None,
    identity_name: str = DEFAULT_IDENTITY,
    now: str | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """All objects of an export as rows.

    The run's time and identity id are arguments, so that a repeated export
    is equal. ``order`` names the columns that put events in input order.
    """
    ident = identity_id or new_identity_id()
    at = (
        F.lit(now)
        if now is not None
        else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.'000Z'")
    )
    spots = order or [c for c in ("source", "seq", "sub") if c in events.columns]
    if not spots:
        raise ValueError("name the columns that put events in input order: order=[…]")
    parts = [identity(events, ident, at, identity_name), shared_objects(events, spots), event_objects(events, ident, at)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_bundle(objects: DataFrame, path: str, bundle_id: str | None = None) -> None:
    """The one-document envelope as one file, whose parts are written in parallel."""
    ident = bundle_id or f"bundle--{uuid.uuid4()}"
    head = f'{{"type":"bundle","id":"{ident}","spec_version":"{VERSION}","objects":['
    write_document(objects.select(F.col("json").alias("value")), path, head, "]}")
