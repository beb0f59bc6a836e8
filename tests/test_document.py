"""One document of many rows: its text, and what the disk holds beside it."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from logfathom import session
from logfathom.sinks import document
from logfathom.sources import json_splits


def bytes_below(root):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(root) for f in files)


def shuffles_of(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in dirs for _, _, files in os.walk(top.getPath()) for f in files if f.startswith("shuffle_")}


@pytest.fixture
def kept(tmp_path, monkeypatch):
    """The folder that scratch tables go to."""
    root = str(tmp_path / "kept")
    for module in (session, document):
        monkeypatch.setattr(module, "scratch_dir", lambda _, label: f"{root}/{label}-{uuid.uuid4().hex}")
    return root


@pytest.mark.parametrize("order", [None, ["id"]])
def test_the_disk_holds_one_document(spark, tmp_path, kept, monkeypatch, order):
    """What lies beside the document when its parts are joined is small, and gone after."""
    join, beside = document.join_files, []
    monkeypatch.setattr(document, "join_files", lambda *a: (beside.append(bytes_below(kept)), join(*a)))
    rows = spark.range(20_000).select("id", F.to_json(F.struct("id", F.lit("some text " * 20).alias("text"))).alias("value"))
    before = shuffles_of(spark)
    document.write_document(rows, str(tmp_path / "a.json"), order=order)
    assert beside[0] < os.path.getsize(tmp_path / "a.json") / 4
    assert bytes_below(kept) == 0 and not shuffles_of(spark) - before
    assert [r["id"] for r in json.loads((tmp_path / "a.json").read_text())] == list(range(20_000))


def test_records_are_not_stored_again(spark, tmp_path, kept):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"items": [{"n": i, "text": os.urandom(300).hex()} for i in range(3000)]}))
    plan = json_splits.document_plan(spark, [str(path)], ("items",), split_bytes=100_000)
    records = json_splits.numbered(json_splits.records_of(plan).select("source", "seq", F.get_json_object("value", "$.n").cast("int").alias("n")))
    assert {(r.pos, r.n) for r in records.collect()} == {(i, i) for i in range(3000)}
    assert bytes_below(kept) < path.stat().st_size / 4


@pytest.mark.parametrize("concats", [False, True])
def test_commas_between_parts(spark, tmp_path, monkeypatch, concats):
    """Empty partitions, ties, nulls in the order, and no row at all; a file system
    that says it can concatenate and then does not."""
    monkeypatch.setattr(document, "can_concat", lambda *_: concats)
    path = str(tmp_path / "a.json")
    rows = spark.range(0, 40, 1, 9).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.to_json(F.struct("id")).alias("value"))
    some = rows.filter("id % 7 = 2 OR id > 30")
    document.write_document(some, path, '{"items": [', "]}")
    assert [r["id"] for r in json.load(open(path))["items"]] == [2, 9, 16, 23, 30, *range(31, 40)]
    document.write_document(rows, path, order=["k"])
    assert [r["id"] for r in json.load(open(path))] == [*range(0, 40, 3), *range(1, 40, 3), *range(2, 40, 3)]
    document.write_document(rows.filter("id < 0"), path, order=["k"])
    assert open(path).read() == "[\n]\n"
    document.write_document(rows.filter("id < 0"), path)
    assert open(path).read() == "[\n]\n"
    document.write_document(rows.withColumn("value", F.when(F.col("id") % 2 == 0, F.col("value"))), path)
    assert [r["id"] for r in json.load(open(path))] == [*range(0, 40, 2)]


def test_records_are_read_once_to_be_numbered(spark):
    """Over several stretches of several files; the reading of records is not repeated."""
    reads = spark.sparkContext.accumulator(0)

    def read(seq):
        reads.add(1)
        return seq

    rows = spark.range(0, 3000, 1, 5).selectExpr("concat('f', id % 3) AS source", f"id * {json_splits.BLOCK} AS seq")
    found = json_splits.numbered(rows.select("source", F.udf(read, "bigint")("seq").alias("seq"))).collect()
    assert {(r.source, r.seq // json_splits.BLOCK, r.pos) for r in found} == {(f"f{i % 3}", i, i // 3) for i in range(3000)}
    assert reads.value == 3000


def test_references_are_worked_out_once(spark):
    """The digest of an address or user is made once per event, not per use."""
    from logfathom.model import align
    from logfathom.sinks import stix

    events = align(spark.range(3).selectExpr("concat('e', id) AS event_id", "concat('10.0.0.', id) AS source_ip", "concat('2001:db8::', id) AS dest_ip", "if(id = 1, '', 'u') AS username"))
    made = stix.event_objects(events, "identity--1", F.lit("2024-01-01T00:00:00.000Z"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 3
    refs = {r.id: json.loads(r.json)["object_refs"] for r in made.filter("type = 'observed-data'").collect()}
    row = events.select(stix.address_id(F.col("source_ip")), stix.address_id(F.col("dest_ip")), stix.user_ref(F.col("username")), "event_id").collect()
    assert refs == {f"observed-data--{r[3]}": [x for x in (r[0], r[1], f"network-traffic--{r[3]}", r[2]) if x] for r in row}
    assert sorted(len(x) for x in refs.values()) == [3, 4, 4]
