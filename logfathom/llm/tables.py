"""Helpers the operators share: skewed joins, text batches, shared files."""

from __future__ import annotations

import struct
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import logfathom.llm
from logfathom.session import cut_lineage, scratch_dir

# functions travel with the job, so executors need not have the package
cloudpickle.register_pickle_by_value(logfathom.llm)

# A key with more than this part of all rows is hot. At most so many keys can
# be hot, whatever the input: the bound of the broadcast in ``join_hot``.
HOT_PARTS = 1000
# Below this weight no key is hot: one task takes so many rows with ease.
HOT_LEAST = 10_000
# Ids (16 bytes each) that may be broadcast.
BROADCAST_IDS = 1_000_000


class Layout:
    """A binary layout that can travel with a task."""

    def __init__(self, text: str) -> None:
        self.text, self.size = text, struct.calcsize(text)

    def pack(self, *values) -> bytes:
        return struct.pack(self.text, *values)

    def unpack(self, data: bytes) -> tuple:
        return struct.unpack(self.text, data)

    def unpack_from(self, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.text, data, at)


def spare_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in df.columns:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_hot(
    rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str, total: int, how: str = "left"
) -> DataFrame:
    """Join ``rows`` to ``table``, which has one row per key and the number of
    rows of that key in ``weight``.

    Rows of hot keys never shuffle: the table's rows for them (``HOT_PARTS``
    at most, since each key stands for a thousandth of ``total``) are
    broadcast. All other rows meet in a shuffle join, where no key is large.
    ``rows`` and ``table`` are read twice, so both should be stored. Rows
    whose key is null match nothing.
    """
    least = max(HOT_LEAST, -(-total // HOT_PARTS))
    hot = F.broadcast(table.filter(F.col(weight) >= least))
    cold = table.filter(F.col(weight) < least)
    on = list(on)
    first = rows.join(hot, on, "inner")
    rest = rows.join(hot.select(*on), on, "left_anti").join(cold, on, how)
    return first.unionByName(rest)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the cluster's shared folder and read back."""
    return cut_lineage(df, label)


def within_bound(ids: DataFrame) -> DataFrame:
    """A table of ids, stored; marked for broadcast if it has no more than
    ``BROADCAST_IDS`` rows, to be shuffled otherwise."""
    ids = stored(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 of each text of a column; null is empty."""
    for cell in column:
        buffer = cell.as_buffer() if cell.is_valid else None
        yield buffer.to_pybytes() if buffer is not None else b""


def worker_memory(key: str, make: Callable):
    """An object that a Python worker keeps from task to task: models and
    memories of words are not made anew for each. Only a matter of speed."""
    home = sys.modules.setdefault("_logfathom_worker", types.ModuleType("_logfathom_worker"))
    if key not in vars(home):
        setattr(home, key, make())
    return getattr(home, key)


def text_runs(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in runs of about so many characters: what is made of the words of
    a run is bounded, however many texts a batch has. Null is empty."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for files that tasks write themselves, as a full URI: a
    path without scheme is one of the cluster's default store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark, label))
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = store.makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def open_store(uri: str):
    """(file system, path) of a URI, for tasks that write or range-read files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def fresh_name(prefix: str, suffix: str) -> str:
    """A name no other attempt of the same task uses. Only files named in the
    table that the committed attempts return are read."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
