"""Work that grows with the input is spread over tasks, and done once."""

from pyspark.sql import functions as F

from logfathom import session
from logfathom.operators.cloudtrail import normalize_cloudtrail
from logfathom.operators.json_events import normalize_json
from logfathom.operators.windows import normalize_windows_xml
from logfathom.sources.documents import document_lines


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    spark.range(0, 5000, 1, 1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(table).rdd.getNumPartitions() == 50
    assert session.spread(table, grow=False).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_records_are_parsed_once(spark):
    """The condition that an explode sets on its list does not run the parse again."""
    lines = spark.range(3).select(F.concat(F.lit('{"a":'), "id", F.lit("}")).alias("value"), "id")
    whole = normalize_json(document_lines(lines, "value"), key=["id", "seq"], keep=["id"])
    for events, parses in ((normalize_json(lines, key=["id"], keep=["id"]), 2), (normalize_cloudtrail(lines, key=["id"], keep=["id"]), 2), (whole, 6)):
        assert optimized(events.select("id", "message")).count("parseJson(") <= parses
    xml = spark.range(3).select(F.lit("<Event><System/></Event>").alias("value"), "id")
    events = normalize_windows_xml(xml, key=["id"], keep=["id"]).select("id", "message")
    assert optimized(events).count("</?Events") <= 1 and events.count() == 3
