"""Queries: streams over files that grow, shrink and are replaced, and streams
with state that a watermark bounds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.plans.facts import FACTS_SQL, facts, register
from logfathom.plans.streams import _LINE, _SEV, _drain, _files
from logfathom.session import scratch_dir, shared_uri
from logfathom.sources.tail import tail_lines
from logfathom.streaming import watch


def feed(spark: SparkSession, folder: str, rows: DataFrame, append: bool) -> None:
    """Write or append ``text`` of (file, pos, text) to files, one task a file.

    It plays the log writer; nothing in the library writes files like this. The
    texts of a file that follow each other in a batch are written at once.
    """
    uri = shared_uri(spark, folder)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        files: dict = {}
        for batch in batches:
            runs, at = pc.run_end_encode(batch.column(0)), 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if name not in files:
                    target = f"{path}/{name}.log"
                    files[name] = store.open_append_stream(target) if append else store.open_output_stream(target)
                texts = batch.column(1).slice(at, end - at).cast(pa.large_string())
                if texts.null_count:
                    raise ValueError("a text is null")
                both = pa.LargeListArray.from_arrays(pa.array([0, end - at], pa.int64()), texts)
                files[name].write(pc.binary_join(both, pa.scalar("", pa.large_string()))[0].as_buffer())
                at = end
        for file in files.values():
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(files), pa.string())], names=["file"])

    dealt = rows.repartition("file").sortWithinPartitions("file", "pos").select("file", "text")
    dealt.mapInArrow(run, "file string").count()


@register(
    "stream_tail",
    f"WITH {FACTS_SQL} SELECT CAST(id AS VARCHAR) AS sig, ip AS source_ip, usr AS username, et AS event_action, {_SEV} AS severity FROM f",
)
def stream_tail(spark, sf_dir):
    """Four files that are followed. After the first run two are appended to,
    one of them in the middle of a line; then one shrinks and one is replaced
    by a longer one. Every run starts anew from the checkpoint."""
    src, out, mark = (scratch_dir(spark, x) for x in ("tail", "out", "mark"))
    lines = facts(spark, sf_dir).selectExpr("id", "id % 4 AS n", f"{_LINE} AS line").withColumn(
        "step",
        F.expr("CASE n WHEN 1 THEN IF(id % 3 = 2, 2, 0) WHEN 2 THEN IF(id % 3 = 0, 0, 2) ELSE IF(id % 3 = 0, 0, 1) END"),
    )
    last = lines.filter("n = 0 AND step = 0").agg(F.max("id").alias("last"))
    halves = lines.crossJoin(F.broadcast(last)).select(
        F.concat(F.lit("f"), "n").alias("file"), "step", F.col("id").alias("pos"),
        F.when(F.col("id") == F.col("last"), F.substring("line", 1, 9)).otherwise(F.concat("line", F.lit("\n"))).alias("text"),
    )
    rest = lines.crossJoin(F.broadcast(last)).filter("id = last").select(
        F.concat(F.lit("f"), "n").alias("file"), F.lit(1).alias("step"), F.lit(-1).cast("bigint").alias("pos"), F.expr("substring(line, 10) || '\n'").alias("text")
    )
    pieces = halves.unionByName(rest)
    for step in range(3):
        feed(spark, src, pieces.filter(F.col("step") == step), append=step == 1)
        _drain(watch.start_rows(tail_lines(spark, src, split_bytes=100_000), "cef", out, mark, once=True))
    return spark.read.parquet(out).selectExpr(
        "extensions['signature_id'] AS sig", "source_ip", "username", "event_action", "severity"
    )


@register(
    "stream_zeek",
    f"WITH {FACTS_SQL} SELECT 'Network/DNS' AS event_type, ip AS source_ip, 'w' || k AS query, count(*) AS n FROM f GROUP BY ip, k",
)
def stream_zeek(spark, sf_dir):
    """Zeek files whose rows come in later micro-batches than their header. In
    the last step two files get a second header, two are replaced."""
    src, out, mark = (scratch_dir(spark, x) for x in ("zeek", "out", "mark"))
    rows = facts(spark, sf_dir).selectExpr(
        "concat('z', u % 4) AS file", "id AS pos", "id % 3 AS step", "IF(id % 3 = 2, 'w' || k || chr(9) || ip, ip || chr(9) || 'w' || k) || chr(10) AS text"
    )
    names = {0: "id.orig_h\tquery", 2: "query\tid.orig_h"}
    for step in range(3):
        part = rows.filter(F.col("step") == step).drop("step")
        if step in names:
            head = part.select("file").distinct().withColumns({"pos": F.lit(-1).cast("bigint"), "text": F.lit(f"#path\tdns\n#fields\t{names[step]}\n")})
            part = part.unionByName(head)
        if step == 2:
            feed(spark, src, part.filter("file IN ('z0', 'z1')"), append=True)
            feed(spark, src, part.filter("file IN ('z2', 'z3')"), append=False)
        else:
            feed(spark, src, part, append=step == 1)
        _drain(watch.start_rows(tail_lines(spark, src, split_bytes=50_000), "zeek", out, mark, once=True))
    events = spark.read.parquet(out).select("event_type", "source_ip", F.try_element_at("extensions", F.lit("query")).alias("query"))
    return events.groupBy("event_type", "source_ip", "query").agg(F.count(F.lit(1)).alias("n"))


_TIMED = f"""{_LINE} || ' rt=' || date_format(timestamp_seconds(1700000000 + id), "yyyy-MM-dd'T'HH:mm:ss")"""


def _event_stream(spark, sf_dir, copies: int):
    """Events of timed lines as a stream: some files are normalised in several
    micro-batches, and read with an id that copies of a line share."""
    src = scratch_dir(spark, "in")
    lines = facts(spark, sf_dir).selectExpr("id", f"CASE WHEN id % 7 = 0 THEN {_LINE} ELSE {_TIMED} END AS value")
    for _ in range(copies):
        lines.repartitionByRange(4, "id").sortWithinPartitions("id").select("value").write.mode("append").text(src)
    out = scratch_dir(spark, "events")
    _drain(watch.start_rows(watch.stream_lines(spark, src, 3), "cef", out, scratch_dir(spark, "mark"), once=True, key=[]))
    return watch.stream_events(spark, out)


@register(
    "stream_dedupe",
    f"""WITH {FACTS_SQL} SELECT CAST(id AS VARCHAR) AS sig, CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END AS n FROM f""",
)
def stream_dedupe(spark, sf_dir):
    """Two copies of every event, of which one stays; events without a time
    cannot expire and are passed on. The watermark's delay covers the input."""
    out = scratch_dir(spark, "unique")
    events = watch.unique_within(_event_stream(spark, sf_dir, 2), "400 days")
    writer = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_dir(spark, "mark"))
    _drain(writer.trigger(availableNow=True).start())
    return spark.read.parquet(out).groupBy(F.expr("extensions['signature_id']").alias("sig")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@register(
    "stream_windows",
    f"""WITH {FACTS_SQL} SELECT CAST(1700000000 + id AS BIGINT) // 3600 AS hour, {_SEV} AS severity, count(*) AS n
        FROM f WHERE id % 7 <> 0 GROUP BY 1, 2""",
)
def stream_windows(spark, sf_dir):
    """Counts per hour and severity by a streaming aggregate in update mode."""
    out = scratch_dir(spark, "windows")
    counts = watch.window_tally(_event_stream(spark, sf_dir, 1), "1 hour", "400 days")
    _drain(watch.start_windows(counts, out, scratch_dir(spark, "mark"), once=True))
    return watch.read_windows(spark, out).selectExpr("unix_seconds(start) DIV 3600 AS hour", "severity", "n")
