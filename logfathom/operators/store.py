"""The event store: parts of Parquet files, and versions that name the live ones.

An insert writes one part: its events, clustered, and beside them small tables
that later jobs read instead of the events:

* ``ledger``: per source, the range of line numbers that the part was made of;
* ``files``: per file, the least and greatest of what filters ask for, and
  signatures of the texts that are searched (``operators/prune.py``);
* ``summary``: the counts that the report is made of.

A version is one small file that lists the live parts and the sessions. It is
put in place by one rename that fails if the version exists, so a store changes
as a whole or not at all: what a broken insert leaves behind is in no version,
and a writer that comes second reads the new version and tries again. Versions
grow by a line per insert; ``compact`` makes one part of a session's.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
import uuid
from collections.abc import Callable, Iterable, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.model import EVENT_DDL, align
from logfathom.operators import prune, stats
from logfathom.operators.lookup import BROADCAST_ROWS, fits_broadcast
from logfathom.operators.query import EventFilter
from logfathom.session import ROWS_PER_TASK, cut_lineage, folder_names, gathered, remove_path, scratch_dir

STORE_DDL = f"{EVENT_DDL}, created_at timestamp, session_id string"
LEDGER_DDL = "source string, low bigint, high bigint, blind boolean"
SUMMARY_DDL = "section string, item string, n bigint, part string"
KINDS = ("events", "ledger", "files", "summary")
ROWS_PER_FILE = 2_000_000
TRIES = 20

# One process writes one version at a time; between processes the rename decides.
_COMMITS = threading.Lock()
SESSION_DDL = (
    "filename string, format string, event_count bigint, created_at timestamp, session_id string"
)


def default_session_id(now: dt.datetime | None = None) -> str:
    """UTC start time of the batch, to the microsecond."""
    return (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d_%H%M%S_%f")


def first_per_id(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per ``event_id``: the first by ``order``, or any of the equal
    copies. Copies are combined per task before the shuffle, so an event that
    makes up a third of the batch does not load one task.

    Ids are counted first. Whole rows are sorted to be combined, so only those
    whose id is repeated are, in tasks of a bounded number of rows; the others
    pass as they are.
    """
    ids = events.groupBy(F.col("event_id").alias("__id")).agg(F.count(F.lit(1)).alias("n"))
    repeated = cut_lineage(ids.filter("n > 1"), "repeated-ids")
    copies = repeated.agg(F.sum("n")).first()[0]
    if not copies:
        return events
    repeated, same = repeated.select("__id"), F.col("event_id").eqNullSafe(F.col("__id"))
    many, once = events, None
    if fits_broadcast(repeated):
        many, once = (events.join(F.broadcast(repeated), same, how) for how in ("left_semi", "left_anti"))
    many = many.repartition(max(1, -(-copies // ROWS_PER_TASK)))
    if not order:
        first = many.dropDuplicates(["event_id"])
    else:
        rest = [c for c in events.columns if c != "event_id"]
        packed = many.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        first = packed.select(*[F.col("event_id") if c == "event_id" else F.col(f"__row.{c}").alias(c) for c in events.columns])
    return first if once is None else first.unionByName(once)


def insert_new(batch: DataFrame, stored: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows of the batch whose id is neither stored nor repeated in the batch."""
    fresh = first_per_id(batch, order)
    return new_rows(fresh, batch, stored) or fresh.limit(0)


def new_rows(fresh: DataFrame, batch: DataFrame, stored: DataFrame) -> DataFrame | None:
    """Rows of ``fresh`` whose id is not stored; None if all are. ``fresh`` has the
    ids of ``batch``, each once.

    The stored ids that the batch meets are found first, by ids alone, which are
    hashes and so shuffled evenly; a batch with few ids is sent to the store's
    scan. Where few are met, or few are not, these are sent to the batch, whose
    rows then stay where they are.
    """
    spark = batch.sparkSession
    own = scratch_dir(spark, "batch-ids")
    try:
        ids = cut_lineage(batch.select(F.col("event_id").alias("__id")).distinct(), "batch-ids", own)
        n = ids.count()
        known = stored.select(F.col("event_id").alias("__id"))
        known = known.join(sendable(ids, n), "__id", "left_semi").distinct()
        known = cut_lineage(known, "known-ids")
        met, same = known.count(), F.col("event_id").eqNullSafe(F.col("__id"))
        if met == n:
            return None
        if met > BROADCAST_ROWS and n - met <= BROADCAST_ROWS:
            left = cut_lineage(ids.join(known, "__id", "left_anti"), "new-ids")
            if fits_broadcast(left):
                return fresh.join(F.broadcast(left), same, "left_semi")
    finally:  # the ids met are a table of their own
        remove_path(spark, own)
    return fresh.join(sendable(known, met), F.col("event_id") == F.col("__id"), "left_anti")


def sendable(ids: DataFrame, n: int) -> DataFrame:
    """A stored table of ``n`` ids, marked for broadcast if it is within the bound."""
    return F.broadcast(ids) if n <= BROADCAST_ROWS and fits_broadcast(ids) else ids


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace rows by ``session_id``: new rows win over old ones."""
    return old.join(new.select("session_id"), "session_id", "left_anti").unionByName(new)


def without_session(rows: DataFrame, session_id: str) -> DataFrame:
    return rows.filter(F.coalesce(F.col("session_id") != session_id, F.lit(True)))


class VersionTaken(Exception):
    """Another writer put this version in place first."""


def line_ranges(batch: DataFrame) -> DataFrame:
    """(source, low, high, blind): the lines of a batch, one row per source;
    ``blind`` says that some rows do not tell theirs."""
    blind = F.max(F.col("source").isNull() | F.col("seq").isNull())
    return batch.groupBy("source").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), blind.alias("blind"))


class EventStore:
    """Events and sessions below one path. Readers see one version; writers may
    run side by side."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- versions ---

    def version(self) -> int:
        """The number of the latest version; 0 before the first insert."""
        names = folder_names(self.spark, f"{self.path}/versions")
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"parts": [{"part", "session", "rows", "ledger"}], "sessions": {id: […]}}"""
        number = self.version() if version is None else version
        if number == 0:
            return {"parts": [], "sessions": {}}
        lines = self.spark.read.text(f"{self.path}/versions/{number:012d}.json", wholetext=True)
        return json.loads(lines.first()["value"])

    def _commit(self, base: int, manifest: dict) -> None:
        """Put version ``base + 1`` in place."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        made, target = (
            jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{name}") for name in (f".{uuid.uuid4().hex}", f"{base + 1:012d}.json")
        )
        fs = made.getFileSystem(conf)
        out = fs.create(made, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        with _COMMITS:
            if fs.exists(target):
                fs.delete(made, False)
                raise VersionTaken(base + 1)
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(fs.makeQualified(made), fs.makeQualified(target), none)
            except Exception as e:
                if fs.exists(target):
                    raise VersionTaken(base + 1) from e
                raise

    def _change(self, change: Callable[[dict], dict]) -> dict:
        """Commit a change of the latest version, again and again if others
        commit first."""
        for _ in range(TRIES):
            base = self.version()
            manifest = change(self.manifest(base))
            try:
                self._commit(base, manifest)
                return manifest
            except VersionTaken:
                continue
        raise VersionTaken(f"gave up after {TRIES} tries")

    # --- read ---

    def events(self, version: int | None = None, where: EventFilter | None = None) -> DataFrame:
        """The events of a version; a filter on ``session_id`` prunes folders.

        With ``where``, only the files that can hold matching events are read,
        as their statistics say, and the matching ones returned.
        """
        parts = self.manifest(version)["parts"]
        if where is not None and where.session_id:
            parts = [p for p in parts if p["session"] == where.session_id]
        folders = [self._folder("events", p) for p in parts if p["rows"]]
        if where is not None and folders:
            kept = prune.may_match(self._read("files", parts, prune.FILES_DDL), where)
            folders = [f"{self.path}/events/{r['file']}" for r in kept.select("file").toLocalIterator()]
        if not folders:
            rows = self.spark.createDataFrame([], STORE_DDL)
        else:
            reader = self.spark.read.option("basePath", f"{self.path}/events")
            rows = reader.schema(f"{STORE_DDL}, part string").parquet(*folders).drop("part")
        return rows if where is None else where.apply(rows)

    def sessions(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)["sessions"]
        rows = [(f, k, n, dt.datetime.fromisoformat(at), name) for name, (f, k, n, at) in found.items()]
        return self.spark.createDataFrame(rows, SESSION_DDL)

    def report(self, k: int = 10, version: int | None = None) -> DataFrame:
        """The rows of ``stats.report``, from the summaries alone."""
        return stats.report_of(self._read("summary", self.manifest(version)["parts"], SUMMARY_DDL), k)

    def _folder(self, kind: str, part: dict) -> str:
        return f"{self.path}/{kind}/session_id={quote(part['session'], safe='')}/part={part['part']}"

    def _read(self, kind: str, parts: Iterable[dict], ddl: str) -> DataFrame:
        folders = [self._folder(kind, p) for p in parts if p["rows"] or kind == "ledger" and p["ledger"]]
        if not folders:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.option("basePath", f"{self.path}/{kind}").schema(f"{ddl}, session_id string").parquet(*folders).drop("session_id")

    # --- write ---

    def insert(
        self,
        events: DataFrame,
        session_id: str | None = None,
        *,
        filename: str = "",
        fmt: str = "",
        order: list[str] | None = None,
        more: bool = False,
        ledger: bool = False,
    ) -> int:
        """Insert or ignore by ``event_id`` under one session; returns the
        number of rows handed in, as the session row records it.

        The batch is written out once before it is compared, so the parse
        runs once; the copy is removed. Running it again inserts nothing. With
        ``more`` the batch adds to a session (a stream's), whose row then
        counts the events stored.

        ``ledger`` says that the ids are those of positions, which the rows
        carry (``source``, ``seq``): then only parts made of the same lines are
        looked into, and none for sources that are new.
        """
        session = session_id or default_session_id()
        spots = list(dict.fromkeys([*(order or []), *(["source", "seq"] if ledger else [])]))
        scratch = scratch_dir(self.spark, "batch")
        aligned = align(events, keep=spots)
        aligned.write.parquet(scratch)
        try:
            batch = gathered(self.spark.read.schema(aligned.schema).parquet(scratch))
            handed = batch.count()
            for _ in range(TRIES):
                base = self.version()
                manifest = self.manifest(base)
                part = self._write_part(batch, manifest["parts"], session, order, spots, ledger)
                stored = part["rows"] + sum(p["rows"] for p in manifest["parts"] if p["session"] == session)
                row = [filename, fmt, stored if more else handed, dt.datetime.now(dt.timezone.utc).isoformat()]
                try:
                    self._commit(base, {"parts": [*manifest["parts"], part], "sessions": manifest["sessions"] | {session: row}})
                    return handed
                except VersionTaken:  # someone's events may be the same: compare again
                    self._drop([part])
            raise VersionTaken(f"gave up after {TRIES} tries")
        finally:
            remove_path(self.spark, scratch)

    def _write_part(self, batch: DataFrame, parts: list[dict], session: str, order, spots: Sequence[str], ledger: bool) -> dict:
        part = {"part": uuid.uuid4().hex, "session": session, "rows": 0, "ledger": ledger}
        ranges = None
        if ledger:
            ranges = line_ranges(batch)
            ranges.write.parquet(self._folder("ledger", part))
            ranges = self.spark.read.schema(LEDGER_DDL).parquet(self._folder("ledger", part))
        fresh = self._fresh(batch, parts, ranges, order)
        if fresh is None:  # nothing to write: the part is its ledger
            return part
        fresh = fresh.drop(*spots).withColumn("is_malicious", F.coalesce("is_malicious", F.lit(False))).withColumn(
            "created_at", F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp")
        )
        return self._write_events(fresh, part, batch)

    def _fresh(self, batch: DataFrame, parts: list[dict], ranges: DataFrame | None, order) -> DataFrame | None:
        """The rows of a batch to be stored, None if there are none. Rows of sources
        that no stored part was made of are compared with nothing."""
        met, sources = self._overlapping([p for p in parts if p["rows"]], ranges)
        fresh = first_per_id(batch, order)
        if not met:
            return fresh
        if sources is None:
            return new_rows(fresh, batch, self._ids(met))
        sources, same = F.broadcast(sources), F.col("source") == F.col("__source")
        old = batch.join(sources, same, "left_semi")
        kept = new_rows(fresh.join(sources, same, "left_semi"), old, self._ids(met))
        rest = fresh.join(sources, same, "left_anti")
        if kept is not None:
            return kept.unionByName(rest)
        return rest if ranges.count() > sources.count() else None

    def _write_events(self, fresh: DataFrame, part: dict, sized_by: DataFrame) -> dict:
        """Write the events of a part, and the tables made of them."""
        folder = self._folder("events", part)
        prune.clustered(fresh, sized_by, ROWS_PER_FILE).write.parquet(folder)
        written = gathered(self.spark.read.option("basePath", f"{self.path}/events").schema(f"{STORE_DDL}, part string").parquet(folder))
        files = prune.file_table(written, f"{self.path}/events")
        files.coalesce(1).write.parquet(self._folder("files", part))
        stats.summary(written).write.parquet(self._folder("summary", part))
        rows = self.spark.read.parquet(self._folder("files", part)).agg(F.sum("rows")).first()[0]
        return part | {"rows": rows or 0}

    def _overlapping(self, parts: list[dict], ranges: DataFrame | None) -> tuple[list[dict], DataFrame | None]:
        """The parts that may hold events of the batch: all without a ledger, and of
        the others those made of some of the same lines. If only some sources of
        the batch are met, these come second, as ``__source``."""
        if not parts or ranges is None or ranges.filter("blind").take(1):
            return parts, None
        known = self._read("ledger", [p for p in parts if p["ledger"]], f"{LEDGER_DDL}, part string")
        mine = ranges.select("source", F.col("low").alias("__low"), F.col("high").alias("__high"))
        met = (F.col("low") <= F.col("__high")) & (F.col("__low") <= F.col("high"))
        met = cut_lineage(known.join(mine, "source").filter(met).select("part", F.col("source").alias("__source")), "met-lines")
        blind = known.filter("blind").select("part")
        names = {r["part"] for r in met.select("part").union(blind).distinct().toLocalIterator()}
        found = [p for p in parts if not p["ledger"] or p["part"] in names]
        if not found:
            return [], None
        sources = met.select("__source").distinct()
        open_parts = any(not p["ledger"] for p in parts) or blind.take(1)
        return found, None if open_parts or not fits_broadcast(sources) else cut_lineage(sources, "met-sources")

    def _ids(self, parts: list[dict]) -> DataFrame:
        folders = [self._folder("events", p) for p in parts]
        return gathered(self.spark.read.schema("event_id string").parquet(*folders))

    def delete(self, session_id: str | None = None) -> int:
        """Drop one session, or everything; returns the number of events that
        went. Their files stay for readers of older versions until ``vacuum``."""
        gone: list[dict] = []

        def change(manifest: dict) -> dict:
            gone[:] = [p for p in manifest["parts"] if session_id is None or p["session"] == session_id]
            sessions = {} if session_id is None else {k: v for k, v in manifest["sessions"].items() if k != session_id}
            return {"parts": [p for p in manifest["parts"] if p not in gone], "sessions": sessions}

        self._change(change)
        return sum(p["rows"] for p in gone)

    def compact(self, session_id: str) -> None:
        """Make one part of all parts of a session."""
        parts = [p for p in self.manifest()["parts"] if p["session"] == session_id]
        if len(parts) < 2:
            return
        part = {"part": uuid.uuid4().hex, "session": session_id, "rows": 0, "ledger": all(p["ledger"] for p in parts)}
        if part["ledger"]:
            ranges = self._read("ledger", parts, f"{LEDGER_DDL}, part string").groupBy("source")
            ranges = ranges.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("blind").alias("blind"))
            ranges.write.parquet(self._folder("ledger", part))
        reader = self.spark.read.option("basePath", f"{self.path}/events").schema(f"{STORE_DDL}, part string")
        folders = [self._folder("events", p) for p in parts if p["rows"]]
        if folders:
            rows = reader.parquet(*folders).drop("part", "session_id")
            part = self._write_events(rows, part, rows)
        names = {p["part"] for p in parts}

        def change(manifest: dict) -> dict:
            if not names <= {p["part"] for p in manifest["parts"]}:
                self._drop([part])
                raise RuntimeError(f"session {session_id!r} was deleted or compacted by another writer")
            return manifest | {"parts": [p for p in manifest["parts"] if p["part"] not in names] + [part]}

        self._change(change)

    def vacuum(self) -> None:
        """Remove what the latest version does not name. No writer, and no
        reader of an older version, may be at work."""
        live = {self._folder(kind, p) for p in self.manifest()["parts"] for kind in KINDS}
        for kind in KINDS:
            for session in folder_names(self.spark, f"{self.path}/{kind}"):
                for name in folder_names(self.spark, f"{self.path}/{kind}/{session}"):
                    folder = f"{self.path}/{kind}/{session}/{name}"
                    if folder not in live:
                        remove_path(self.spark, folder)

    def _drop(self, parts: list[dict]) -> None:
        for part in parts:
            for kind in KINDS:
                remove_path(self.spark, self._folder(kind, part))


def has_lines(events: DataFrame, placed: bool) -> bool:
    """Whether events whose ids are those of positions still carry these."""
    return placed and {"source", "seq"} <= set(events.columns)


def ingest(
    rows: DataFrame,
    normalize: Callable[..., DataFrame],
    store: EventStore,
    *,
    session_id: str | None = None,
    filename: str = "",
    fmt: str = "",
    enrich_with: Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> int:
    """Parse, enrich, store: one chain up to the write. Rows with positions are
    kept in the store's ledger."""
    placed = {"source", "seq"} <= set(rows.columns) and "key" not in options and "keep" not in options
    events = normalize(rows, **options, **({"keep": ("source", "seq")} if placed else {}))
    if enrich_with is not None:
        events = enrich_with(events)
    return store.insert(events, session_id, filename=filename, fmt=fmt, ledger=has_lines(events, placed))
