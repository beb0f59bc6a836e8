"""The tailing source: offsets, splits, rotation, and streams made of it."""

import io
import json
import random

import pytest
from check_oracles import compare, duck

from __spark_entry__ import oracle_sql, queries
from logfathom.sources import tail
from logfathom.streaming import watch

SF = "/root/testdata/sf0.001"


def entry(data):
    return tail.file_entry(io.BytesIO(data), len(data))


def lines_between(start, end, data, size):
    first = tail.read_from(start, end)
    parts = tail.cut("f", 0, first, end["end"], size)
    return [line for p in parts for line in tail.lines_of_range(io.BytesIO(data), p)]


@pytest.mark.parametrize("seed", range(30))
def test_any_growth_and_any_splits_give_each_line_once(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(tail, "CHUNK", rng.choice([1, 7, 64, 1 << 20]))
    data = b"".join(bytes(rng.choices(b"ab\r \xff", k=rng.choice([0, 1, 5, 40]))) + b"\n" for _ in range(rng.randint(0, 60)))
    data += rng.choice([b"", b"half"])
    start, got = None, []
    for size in sorted(rng.randint(0, len(data)) for _ in range(4)) + [len(data)]:
        end = entry(data[:size])
        got += lines_between(start, end, data[:size], rng.choice([1, 3, 50, 10_000]))
        start = json.loads(json.dumps(end))  # offsets are stored as JSON
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line[:-1] if line.endswith(b"\r") else line))
        at += len(line) + 1
    assert got == want


def test_shrunk_and_replaced_files_start_again():
    old = entry(b"one\ntwo\nthree\n")
    assert tail.read_from(None, old) == 0 and tail.read_from(old, old) == 14
    assert tail.read_from(old, entry(b"one\ntwo\n")) == 0
    assert tail.read_from(old, entry(b"other\ntwo\nthree\nfour\n")) == 0
    assert tail.read_from(old, entry(b"one\ntwo\nthree\nfour\n")) == 14
    assert tail.read_from(entry(b""), entry(b"x\n")) == 0
    # half a line only: nothing is read, and nothing is lost when it ends
    half = entry(b"hal")
    assert half["end"] == 0 and tail.read_from(half, entry(b"half\n")) == 0
    assert entry(b"one\ntwo\n")["turn"] == old["turn"] != entry(b"other\n")["turn"]


def test_offsets_follow_files_that_come_and_go(tmp_path):
    reader = tail.TailReader(tmp_path.as_uri(), 10)
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    (tmp_path / "a.log").write_bytes(b"1\n2\n3")
    (tmp_path / ".hidden").write_bytes(b"x\n")
    first = reader.latestOffset()
    again = tail.TailReader(tmp_path.as_uri(), 10).latestOffset()  # nothing is remembered
    assert first == again and [x["end"] for x in first["files"].values()] == [4]
    (tmp_path / "a.log").unlink()
    gone = reader.latestOffset()
    assert gone["files"] == {} and reader.partitions(first, gone) == []
    (tmp_path / "a.log").write_bytes(b"1\n2\n3\n")
    assert [(p.first, p.last) for p in reader.partitions(gone, reader.latestOffset())] == [(0, 6)]
    assert [(p.first, p.last) for p in reader.partitions(first, reader.latestOffset())] == [(4, 6)]


def test_a_single_file_and_odd_bytes(spark, tmp_path):
    path = tmp_path / "x y%20.log"
    path.write_bytes(b"ok\r\n\xff\xfe\n\nlast\n")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for more in (b"", b"next\nhalf"):
        with open(path, "ab") as file:
            file.write(more)
        lines = tail.tail_lines(spark, str(path), split_bytes=4).select("value", "seq")
        query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("seq", "value").collect())) == [
        (0, "ok"), (4, "��"), (7, ""), (8, "last"), (13, "next")
    ]


def test_headers_of_a_batch_that_runs_again(spark, tmp_path):
    def batch(rows):
        return spark.createDataFrame(rows, "value string, source string, block bigint, seq bigint")

    path = str(tmp_path / "headers")
    watch.carry_headers(batch([("#path\tdns", "a", 0, 0), ("#fields\tx", "a", 0, 10), ("1", "a", 0, 20)]), path, 0)
    for _ in range(2):  # the second time as after a crash
        rows = watch.carry_headers(batch([("2", "a", 0, 30), ("#fields\ty", "a", 0, 40), ("#fields\tz", "b", 0, 0)]), path, 1)
        assert sorted(r.value for r in rows.filter("block < 0").collect()) == ["#fields\tx", "#path\tdns"]
    rows = watch.carry_headers(batch([("3", "a", 0, 50)]), path, 2)
    assert sorted((r.source, r.value) for r in rows.filter("block < 0").collect()) == [
        ("a", "#fields\ty"), ("a", "#path\tdns"), ("b", "#fields\tz")
    ]


@pytest.mark.parametrize("name", ["stream_tail", "stream_zeek", "stream_dedupe", "stream_windows"])
def test_query(spark, name):
    ok, text = compare(queries()[name](spark, SF), duck(SF), oracle_sql()[name])
    assert ok, text


def test_small_splits_share_tasks(tmp_path):
    data = b"".join(b"line %d\n" % i for i in range(500))
    (tmp_path / "a.log").write_bytes(data)

    def read(tasks):
        reader = tail.TailReader(tmp_path.as_uri(), 50, tasks)
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        return len(parts), [row for p in parts for batch in reader.read(p) for row in zip(*batch.to_pydict().values())]

    alone, want = read(10_000)
    few, got = read(4)
    assert alone == -(-len(data) // 50) and few <= 5 and got == want
    # source, turn, split, byte, line: the split is the one that a line starts in
    assert all(at - at % 50 == split for _, _, split, at, _ in got) and len(got) == 500
    assert tail.splits_together([(0, 10 << 30)], 100_000, 4) * 100_000 <= tail.TASK_BYTES
