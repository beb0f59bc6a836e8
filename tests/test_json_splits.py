"""JSON documents cut into records, for any content and any splits."""

import json
import os
import random

import pytest
from check_oracles import compare, duck

from __spark_entry__ import oracle_sql, queries
from logfathom.operators.route import normalize_files
from logfathom.sources import json_splits

KEYS = ("Records", "events", "items")
TEXTS = [1, "a", "x\\", '"q"', "{[", "]},", "é", None, True, "", '\\\\"', '"Records": [']


def value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice(TEXTS)
    if kind < 0.65:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["a", "Records", 'b"', "events"]): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def document(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [value(rng, 3) for _ in range(rng.randint(0, 8))]
    if kind == 1:
        return {"x": value(rng, 2), rng.choice(KEYS): [value(rng, 3) for _ in range(rng.randint(0, 8))], "y": value(rng, 2)}
    return {"x": value(rng, 3), "q": value(rng, 3)} if kind == 2 else {"Records": value(rng, 1), "events": [value(rng, 2)]}


def wanted(doc, first_only=False):
    if isinstance(doc, list):
        return doc
    names = [k for k in KEYS if k in doc and (first_only or isinstance(doc[k], list))]
    found = doc[names[0]] if names else [doc]
    return found if isinstance(found, list) else []


@pytest.mark.parametrize("split_bytes", [7, 64, 10_000])
@pytest.mark.parametrize("first_only", [False, True])
def test_records_of_any_document(spark, tmp_path, split_bytes, first_only):
    rng = random.Random(split_bytes)
    want = {}
    for i in range(60):
        doc = document(rng)
        text = rng.choice(["", " \n"]) + json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n\n"])
        (tmp_path / f"{i}.json").write_text(text)
        want[f"{i}.json"] = wanted(doc, first_only)
    no_document = {"lines.json": '{"a": 1}\n{"a": 2}\n', "cut.json": '[{"a": 1}, {"a"', "more.json": '[1] x', "scalar.json": "12", "empty.json": "", "wrong.json": "]["}
    for name, text in no_document.items():
        (tmp_path / name).write_text(text)
    records, others = json_splits.json_documents(spark, [str(tmp_path)], KEYS, first_key_only=first_only, split_bytes=split_bytes)
    got = {name: [] for name in want}
    for r in sorted(records.collect(), key=lambda r: (r.source, r.seq)):
        got[os.path.basename(r.source)].append(json.loads(r.value))
    assert got == want
    # an empty file has nothing to read and is in neither
    assert {os.path.basename(r.path) for r in others.collect()} == set(no_document) - {"empty.json"}


def test_a_task_reads_a_split(spark, tmp_path):
    """One array in one line: the rows of no task are more than a split's."""
    rows = [{"n": i, "text": "x" * 50} for i in range(5000)]
    path = tmp_path / "one.json"
    path.write_text(json.dumps(rows))
    records, _ = json_splits.json_documents(spark, [str(path)], KEYS, split_bytes=20_000)
    assert sorted(json.loads(r.value)["n"] for r in records.collect()) == list(range(5000))
    splits = json_splits.splits_of(spark, [str(path)], 20_000)
    assert splits.count() == -(-path.stat().st_size // 20_000)
    assert json_splits._spread(splits).rdd.getNumPartitions() > 1


def test_files_of_all_kinds(spark, tmp_path):
    """Documents, lines, and lines whose first one is cut, side by side."""
    line = json.dumps({"user": "u", "action": "a"})
    (tmp_path / "doc.json").write_text(json.dumps([{"user": "d", "events": [{"user": "inner"}]}] * 3, indent=1))
    (tmp_path / "lines.json").write_text(f"{line}\n" * 4)
    (tmp_path / "cut.json").write_text(f'{{"ion":"x"}}, "z"}}\n' + f"{line}\n" * 5)
    (tmp_path / "bad.json").write_text('[\n{"user": "b"},\n{"user"\n')
    trail = {"Records": [{"eventName": "ListX", "eventSource": "s3.amazonaws.com"}] * 2}
    (tmp_path / "trail.json").write_text(json.dumps(trail, indent=1))
    rows = normalize_files(spark, str(tmp_path)).collect()
    users = sorted(r.username or "-" for r in rows if r.source_format == "json")
    # a record is not unwrapped again; lines that are no JSON are kept as they are
    assert users == sorted(["d"] * 3 + ["u"] * 4 + ["-"] + ["u"] * 5 + ["-"] * 3)
    assert sum(r.source_format == "aws_cloudtrail" for r in rows) == 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    ok, text = compare(queries()["json_splits"](spark, sf), duck(sf), oracle_sql()["json_splits"])
    assert ok, text


def test_many_splits_of_a_file(spark, tmp_path, monkeypatch):
    """Runs of splits are composed one after the other; small splits share a task."""
    monkeypatch.setattr(json_splits, "RUN", 5)
    rows = [{"n": i, "text": 'x"]},\\ {[' * (i % 5)} for i in range(300)]
    (tmp_path / "one.json").write_text(json.dumps({"id": "b", "items": rows, "tail": [1, {"items": 2}]}))
    plan = json_splits.document_plan(spark, [str(tmp_path)], KEYS, split_bytes=40)
    assert plan.count() > 200 and plan.select("run").distinct().count() > 40
    assert json_splits._spread(plan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    records = json_splits.records_of(plan)
    found = json_splits.numbered(records).collect()
    assert [json.loads(r.value) for r in sorted(found, key=lambda r: r.pos)] == rows
    assert sorted(r.pos for r in found) == list(range(300))
    (around,) = json_splits.envelopes(plan).collect()
    assert json.loads(around.value) == {"id": "b", "items": [], "tail": [1, {"items": 2}]}


@pytest.mark.parametrize("name", ["json_document", "stix_bundle"])
def test_one_file_is_never_one_row(spark, monkeypatch, name):
    """The document is read back over splits, not as one text."""
    from pyspark.sql.readwriter import DataFrameReader

    read = DataFrameReader.text
    monkeypatch.setattr(DataFrameReader, "text", lambda self, paths, wholetext=False, **kw: read(self, paths, wholetext=wholetext and 1 / 0, **kw))
    sf = "/root/testdata/sf0.001"
    ok, text = compare(queries()[name](spark, sf), duck(sf), oracle_sql()[name])
    assert ok, text


@pytest.mark.parametrize("block", [1, 5, 1 << 16])
def test_marks_tell_what_single_bytes_tell(monkeypatch, block):
    """Strings, runs of backslashes and brackets over blocks of any size."""
    monkeypatch.setattr(json_splits, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(300):
        text = b"".join(rng.choices([b'"', b"\\", b"[", b"]", b"{", b"}", b",", b" ", b"a"], k=rng.randint(1, 40)))
        for i, begin in enumerate((json_splits.OUTSIDE, json_splits.INSIDE, json_splits.ESCAPED)):
            inside, escaped, depth = begin != json_splits.OUTSIDE, begin == json_splits.ESCAPED, 0
            valid = True
            for c in text.decode():
                valid &= inside or c != "\\"  # outside of strings it is no JSON
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    inside = not inside
                elif not inside:
                    depth += (c in "[{") - (c in "]}")
            ends, deeper = json_splits.ways(json_splits.Bytes(text), 0, len(text))
            if valid:
                assert (ends[i], deeper[i]) == ((json_splits.ESCAPED if escaped else json_splits.INSIDE) if inside else json_splits.OUTSIDE, depth)
