"""Structured Streaming jobs over newly arriving lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logfathom.model import EVENT_DDL
from logfathom.operators.query import with_message
from logfathom.operators.registry import format_of, parser_of
from logfathom.operators.store import EventStore, has_lines
from logfathom.session import folder_names, remove_path
from logfathom.sources.lines import break_lines, number_lines, read_lines
from logfathom.sources.zeek import last_headers

POLL = "2 seconds"
SAMPLE_CHARS = 8192  # of the head that tells a source's format

Transform = Callable[[DataFrame], DataFrame]


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as lines with their file and split.

    A rotated or rolled file is a new file. Text appended to a file that was
    already read is not read again: ``sources.tail.tail_lines`` follows files
    that grow.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def sample_format(spark: SparkSession, path: str) -> str:
    """Format of a source from the head of its first file, once before the start.

    The head is the first ``SAMPLE_CHARS`` characters in order of lines: no more
    lines than characters are gathered, each cut to that length.
    """
    lines = read_lines(spark, path)
    first = lines.agg(F.min("source").alias("source")).first()["source"]
    place = F.struct("seq", "sub", F.substring("value", 1, SAMPLE_CHARS).alias("text"))
    head = lines.filter((F.col("source") == first) & (F.col("seq") < SAMPLE_CHARS) & (F.col("sub") < SAMPLE_CHARS))
    texts = F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"])
    text = F.substring(F.array_join(texts, "\n"), 1, SAMPLE_CHARS)
    return head.agg(text.alias("head")).select(format_of(F.col("head")).alias("format")).first()["format"]


def normalize_batch(
    batch: DataFrame, fmt: str, *, enrich_with: Transform | None = None, **options
) -> DataFrame:
    """A micro-batch through the batch parser of the format.

    Parsers are stateless, so a micro-batch needs nothing but its own lines
    (and the headers that ``carry_headers`` adds). They run on the batch frame,
    whose planner keeps the parsing steps apart (a streaming plan writes them
    into one expression). A file of ``stream_lines`` comes whole in one batch
    and its lines are numbered there, so ids are those of a batch read; lines
    of ``tail_lines`` have the byte at which they start.
    """
    spotted = batch
    if {"source", "block"} <= set(batch.columns) and "key" not in options:
        spotted = break_lines(batch if "seq" in batch.columns else number_lines(batch))
    events = parser_of(fmt).normalize(spotted, **options)
    return events if enrich_with is None else enrich_with(events)


def carry_headers(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The lines of a micro-batch, and before them the header lines that were
    in force in their sources when the batch before it ended.

    ``path`` keeps a small table per micro-batch: two lines for each source
    followed. A batch that runs again reads the table of the batch before it
    and writes its own anew, so headers and rows are in step after a restart.
    """
    spark, rows = batch.sparkSession, batch.select("value", "source", "block", "seq")
    past = sorted(int(m[1]) for m in map(re.compile(r"batch=(\d+)$").match, folder_names(spark, path)) if m)
    earlier = [n for n in past if n < batch_id]
    if earlier:
        before = spark.read.schema("source string, block bigint, seq bigint, value string").parquet(f"{path}/batch={earlier[-1]}")
        rows = rows.unionByName(before)
    last_headers(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    for n in earlier[:-1]:  # the one before is kept: this batch may run again
        remove_path(spark, f"{path}/batch={n}")
    return rows


@contextmanager
def _events(
    batch: DataFrame, batch_id: int, fmt: str, checkpoint: str, enrich_with: Transform | None, options: dict
) -> Iterator[DataFrame]:
    """The events of a micro-batch, whose lines are read once and held while
    they are numbered, looked through for headers and parsed."""
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lines = batch
        if "turn" in batch.columns:
            lines = batch.withColumn("source", F.concat_ws("#", "source", "turn")).drop("turn")
            if fmt == "zeek":
                lines = carry_headers(lines, f"{checkpoint.rstrip('/')}/headers", batch_id)
        yield normalize_batch(lines, fmt, enrich_with=enrich_with, **options)
    finally:
        batch.unpersist()


def _start(lines: DataFrame, put: Callable, checkpoint: str, once: bool) -> StreamingQuery:
    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=POLL).start()


def start_rows(
    lines: DataFrame,
    fmt: str,
    path: str,
    checkpoint: str,
    *,
    enrich_with: Transform | None = None,
    once: bool = False,
    **options,
) -> StreamingQuery:
    """Write the events that have a message, one ``batch=N`` folder per
    micro-batch; a batch that runs again replaces its folder."""

    def put(batch: DataFrame, batch_id: int) -> None:
        with _events(batch, batch_id, fmt, checkpoint, enrich_with, options) as events:
            with_message(events).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(lines, put, checkpoint, once)


def start_ingest(
    lines: DataFrame,
    fmt: str,
    store: EventStore,
    session_id: str,
    checkpoint: str,
    *,
    enrich_with: Transform | None = None,
    once: bool = False,
    **options,
) -> StreamingQuery:
    """Insert or ignore every micro-batch into one session of a store; a repeated
    batch inserts nothing. Lines of new files are compared with nothing stored."""

    def put(batch: DataFrame, batch_id: int) -> None:
        placed = {"source", "block"} <= set(batch.columns) and not {"key", "keep"} & set(options)
        kept = options | ({"keep": ("source", "seq")} if placed else {})
        with _events(batch, batch_id, fmt, checkpoint, enrich_with, kept) as events:
            store.insert(events, session_id, fmt=fmt, more=True, ledger=has_lines(events, placed))

    return _start(lines, put, checkpoint, once)


def severity_tally(events: DataFrame) -> DataFrame:
    """Count per severity; none counts as low."""
    label = F.lower(F.coalesce(F.nullif(F.col("severity"), F.lit("")), F.lit("low")))
    return events.groupBy(label.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def start_tally(
    lines: DataFrame, fmt: str, path: str, checkpoint: str, *, once: bool = False, **options
) -> StreamingQuery:
    """Keep the severity counts of each micro-batch; :func:`read_tally` adds them
    up. A batch that runs again replaces its own counts."""

    def put(batch: DataFrame, batch_id: int) -> None:
        with _events(batch, batch_id, fmt, checkpoint, None, options) as events:
            counts = severity_tally(events)
            counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(lines, put, checkpoint, once)


def read_tally(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("severity").agg(F.sum("n").alias("n"))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """The events that ``start_rows`` writes, as a stream."""
    return spark.readStream.schema(EVENT_DDL).parquet(f"{path}/batch=*")


def unique_within(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated ids that arrive within ``delay`` of each other's time,
    with state that is bounded by the watermark.

    An event older than the watermark is late and dropped. Events without a
    time cannot be late and have no bound: they are passed on as they are.
    """
    timed = events.filter(F.col("event_ts").isNotNull()).withWatermark("event_ts", delay)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).unionByName(events.filter(F.col("event_ts").isNull()))


def window_tally(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count per window of event time and severity; windows that the watermark
    has passed leave the state. Events without a time are not counted."""
    timed = events.filter(F.col("event_ts").isNotNull()).withWatermark("event_ts", delay)
    label = F.lower(F.coalesce(F.nullif(F.col("severity"), F.lit("")), F.lit("low")))
    return timed.groupBy(F.window("event_ts", width).alias("window"), label.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def start_windows(counts: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Write the counts that a micro-batch changed (update mode); ``read_windows``
    takes the last one of each window. A batch that runs again replaces its own."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "severity", "n")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=POLL).start()


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("start", "end", "severity").agg(F.max_by("n", "batch").alias("n"))
