"""A streaming source of lines that files gain, with offsets in bytes.

Each file below a path is followed: what was appended since the last
micro-batch is read, up to the last line end. A line without one waits until
the writer ends it. Offsets hold, per file, the byte up to which it was read
and check sums of its head:

* a file that is shorter than before, or whose head is another one, was
  rotated or replaced and is read from its start;
* a file that is gone is forgotten, so one that comes back under its name is
  read from its start;
* what an offset says follows from the files alone. Where a batch begins is
  told by comparing two offsets, so a batch that runs again after a restart
  reads the same ranges.

A range is cut into splits; lines belong to the split they start in. Where
splits are small, a task reads several that follow each other, so what a file
gains at once is read by tasks of a bounded size, of which there are few.

Not noticed: a file that is rewritten with the same head and at least its old
length between two micro-batches. A range that is rewritten after a batch was
planned and before it is read is lost, as for any reader of growing files.

The offset has an entry per file, which the driver holds: follow folders of
live files, and let writers move finished ones out of them.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logfathom.session import TASK_BYTES, shared_uri

NAME = "logfathom_tail"
SCHEMA = "source string, turn bigint, split bigint, at bigint, line binary"
SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20  # read in one go
BATCH_BYTES = 4 << 20  # of lines handed over in one go
# Lengths of the heads whose check sums an offset holds.
HEADS = tuple(1 << i for i in range(13))

# the source travels with the job, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Range(InputPartition):
    """The lines of ``path`` that start in ``begin:stop`` of ``first:last``; these
    bytes are one split, or splits of ``size`` bytes."""

    path: str
    turn: int
    begin: int
    stop: int
    first: int
    last: int
    size: int = 0

    def split_of(self, at: int) -> int:
        """The byte at which the split begins that holds byte ``at``."""
        return at - (at - self.begin) % self.size if self.size else self.begin


def file_entry(file, size: int) -> dict:
    """Offset of an open file: the end of its last whole line, and its heads."""
    end, at = 0, size
    while at > 0 and not end:
        begin = max(0, at - CHUNK)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        end, at = (begin + found + 1 if found >= 0 else 0), begin
    file.seek(0)
    head = file.read(min(end, HEADS[-1]))
    sums = ",".join(str(zlib.crc32(head[:n])) for n in HEADS if n <= len(head))
    # lines of different turns of one name are told apart by the first line
    return {"end": end, "heads": sums, "turn": zlib.crc32(head.split(b"\n", 1)[0])}


def read_from(start: dict | None, end: dict) -> int:
    """The byte from which a file is read between two of its offsets."""
    if start is None or start["end"] > end["end"]:
        return 0
    before, after = (x["heads"].split(",") if x["heads"] else [] for x in (start, end))
    return start["end"] if before == after[: len(before)] else 0


def cut(path: str, turn: int, first: int, last: int, size: int) -> list[Range]:
    return [Range(path, turn, at, min(at + size, last), first, last) for at in range(first, last, size)]


def splits_together(ranges: Iterable[tuple[int, int]], split: int, tasks: int, most: int = TASK_BYTES) -> int:
    """How many splits a task reads: as many as leave ``tasks`` tasks, with no
    more than ``most`` bytes in one."""
    splits = sum(-(-(last - first) // split) for first, last in ranges)
    return max(1, min(splits // max(1, tasks), most // split))


def lines_of_range(file, part: Range) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of a range; line ends are cut off."""
    at, skip = part.begin, part.begin > part.first
    if skip:
        at -= 1  # a line starts here if the byte before ends one
    held, base = b"", at
    file.seek(at)
    while base < part.stop and at < part.last:
        chunk = file.read(min(CHUNK, part.last - at))
        if not chunk:
            return
        at += len(chunk)
        held += chunk
        rows = held.split(b"\n")
        held = rows.pop()
        for row in rows:
            if skip:
                skip = False
            elif base < part.stop:
                yield base, row[:-1] if row.endswith(b"\r") else row
            else:
                return
            base += len(row) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, uri: str, split_bytes: int, tasks: int = 1) -> None:
        self.uri, self.split_bytes, self.tasks = uri, split_bytes, tasks
        self.known: dict[str, tuple] = {}  # entries of files that did not change

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        info = store.get_file_info(path)
        if info.type == fs.FileType.Directory:
            infos = store.get_file_info(fs.FileSelector(path, recursive=True))
        else:
            infos = [info]
        known, files = {}, {}
        for info in infos:
            inner = info.path[len(path) :]
            if info.type != fs.FileType.File or any(p[:1] in ("_", ".") for p in inner.split("/")):
                continue
            stamp = (info.size, info.mtime_ns)
            old = self.known.get(info.path)
            if old is None or old[0] != stamp:
                with store.open_input_file(info.path) as file:
                    old = (stamp, file_entry(file, file.size()))
            known[info.path] = old
            files[info.path] = old[1]
        self.known = known
        return {"files": dict(sorted(files.items()))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        firsts = {path: read_from(start["files"].get(path), entry) for path, entry in end["files"].items()}
        size = self.split_bytes
        together = splits_together([(first, end["files"][path]["end"]) for path, first in firsts.items()], size, self.tasks)
        out: list[Range] = []
        for path, first in firsts.items():
            entry = end["files"][path]
            out += [replace(p, size=size) for p in cut(path, entry["turn"], first, entry["end"], together * size)]
        return out

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.uri)
        scheme = self.uri.split("://", 1)[0]
        source = f"{scheme}://{partition.path}"

        def rows(at: list[int], lines: list[bytes]) -> pa.RecordBatch:
            n = len(at)
            splits = [partition.split_of(x) for x in at]
            fixed = [pa.array([partition.turn] * n, pa.int64()), pa.array(splits, pa.int64())]
            columns = [pa.array([source] * n), *fixed, pa.array(at, pa.int64()), pa.array(lines, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["source", "turn", "split", "at", "line"])

        with store.open_input_file(partition.path) as file:
            spots, lines, size = [], [], 0
            for at, line in lines_of_range(file, partition):
                spots.append(at)
                lines.append(line)
                size += len(line) + 32
                if size >= BATCH_BYTES:
                    yield rows(spots, lines)
                    spots, lines, size = [], [], 0
            if spots:
                yield rows(spots, lines)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)), int(self.options.get("tasks", 1)))


def tail_lines(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of the lines that the files below ``path`` have and gain.

    ``value`` is the line, ``source`` its file, ``turn`` tells what a file was
    replaced by from what it was, ``seq`` the byte at which the line starts and
    ``block`` that of its split. Bytes that are no UTF-8 become U+FFFD.
    """
    spark.dataSource.register(TailSource)
    rows = spark.readStream.format(NAME).option("splitBytes", str(split_bytes)).option(
        "tasks", str(spark.sparkContext.defaultParallelism)
    ).load(shared_uri(spark, path))
    return rows.select(
        F.make_valid_utf8(F.col("line").cast("string")).alias("value"), "source", F.col("turn").cast("string").alias("turn"),
        F.col("split").alias("block"), F.col("at").alias("seq"),
    )
