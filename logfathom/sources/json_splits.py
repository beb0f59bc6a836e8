"""JSON documents cut into their records by many tasks.

A file is read in splits of bytes. Whether a split begins inside a string, after
a backslash, and how deep in brackets, depends on all that is before it. So
each split first gives a function: for the three ways it may begin, how it ends
and how much deeper. These are small; composed over the splits of a file they
tell how each begins. A second pass then finds what the file is (a list, an
object with a list under a known key, or one object), a third cuts the list at
the commas of its own depth. A record is read by the split it begins in, past the
split's end where it has to be, so records are rows of the file itself: their
texts are neither stored again nor shuffled. No task holds more than a block of
a split, a batch of rows and one record.

Files that are no single document (lines of JSON, text after the end, brackets
that do not match) are left to the line scan.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.session import cut_lineage

SPLIT_BYTES = 64 << 20
BLOCK = 1 << 16  # the arrays over it stay in a core's cache
BATCH = 4 << 20  # bytes of rows handed on at once
NEAR = 4096  # bytes looked at around a key
STRETCH = 4 << 20  # bytes of a file whose records are numbered together
RUN = 256  # splits of a file that are composed at once, and again as one
OUTSIDE, INSIDE, ESCAPED = range(3)
SPACE = b" \t\r\n"

# what tasks run travels with the job, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# marks are quotes, backslashes, brackets and commas; all other bytes are 0
MARKS = bytes(b if b in b'"\\[]{},' else 0 for b in range(256))
STEPS = np.zeros(256, np.int8)
STEPS[[0x5B, 0x7B]], STEPS[[0x5D, 0x7D]] = 1, -1


def marks_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, bytes) of the marks of a block."""
    kinds = np.frombuffer(data.translate(MARKS), np.uint8)
    places = np.flatnonzero(kinds != 0)
    return places, kinds[places]


class Scanner:
    """Follows strings and brackets over the blocks of a text, by its marks."""

    def __init__(self, state: int, depth: int) -> None:
        self.state, self.depth = state, depth

    def feed(self, places: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, bytes, depth after it) of the brackets and commas outside of
        strings, in a block of ``size`` bytes."""
        if self.state == ESCAPED:  # as if the backslash stood before
            places, kinds = np.concatenate(([-1], places)), np.concatenate((np.array([0x5C], np.uint8), kinds))
        quote, slash = kinds == 0x22, kinds == 0x5C
        inside, trailing = quote, 0  # backslashes that the block ends with
        if slash.any():
            follows = np.concatenate(([False], slash[:-1] & (np.diff(places) == 1)))
            begun = np.maximum.accumulate(np.where(slash & ~follows, places, -2))
            run = places[1:] - begun[:-1]
            inside = quote.copy()
            inside[1:] &= ~follows[1:] | (run & 1 == 0)
            if slash[-1] and places[-1] == size - 1:
                trailing = size - int(begun[-1])
        inside = ((np.cumsum(inside, dtype=np.int32) + (self.state != OUTSIDE)) & 1).astype(bool)
        ends_inside = bool(inside[-1]) if len(inside) else self.state != OUTSIDE
        self.state = OUTSIDE if not ends_inside else ESCAPED if trailing % 2 else INSIDE
        own = ~(inside | quote | slash)
        places, kinds = places[own], kinds[own]
        deep = self.depth + np.cumsum(STEPS[kinds], dtype=np.int64)
        if len(deep):
            self.depth = int(deep[-1])
        return places, kinds, deep


def blocks(file, begin: int, stop: int) -> Iterator[tuple[int, bytes]]:
    for at in range(begin, stop, BLOCK):
        data = file.read_at(min(BLOCK, stop - at), at)
        if data:
            yield at, data


def ways(file, begin: int, stop: int) -> tuple[list[int], list[int]]:
    """For the three ways a split may begin: how it ends, and how much deeper."""
    states, depths = [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0]
    for _, data in blocks(file, begin, stop):
        places, kinds = marks_of(data)
        fed = {}  # ways that have met go on as one
        for state in set(states):
            fed[state] = scanner = Scanner(state, 0)
            scanner.feed(places, kinds, len(data))
        depths = [d + fed[s].depth for d, s in zip(depths, states)]
        states = [fed[s].state for s in states]
    return states, depths


def shape(file, begin: int, stop: int, size: int, state: int, depth: int, keys: list[str]) -> dict:
    """What a split tells about its file: the documents that begin in it, bytes
    outside of them, the known keys of the outer object and where their values
    begin and end, and the last commas of the two outer depths."""
    scanner = Scanner(state, depth)
    out = {"roots": 0, "root_at": None, "root": None, "junk": 0, "low": 0, "root_end": None, "comma1": None, "comma2": None, "close1": None, "keys": []}
    names = [(k, f'"{k}"'.encode()) for k in keys]
    for at, data in blocks(file, begin, stop):
        was = scanner.depth
        places, kinds, deep = scanner.feed(*marks_of(data), len(data))
        step = STEPS[kinds]
        roots = places[(step == 1) & (deep == 1)]
        if len(roots) and out["root_at"] is None:
            out |= {"root_at": at + int(roots[0]), "root": chr(data[roots[0]])}
        out["roots"] += len(roots)
        ends = places[(step == -1) & (deep == 0)]
        if len(ends):
            out["root_end"] = at + int(ends[-1])
        out["junk"] += junk(data, was, places[step != 0], deep[step != 0])
        out["low"] = min(out["low"], was, int(deep.min()) if len(deep) else was)
        for d in (1, 2):
            commas = places[(step == 0) & (deep == d)]
            if len(commas):
                out[f"comma{d}"] = at + int(commas[-1])
        closes = places[(step == -1) & (deep == 1)]
        for key in out["keys"]:
            later = closes[at + closes > key["value_at"]]
            if key["end"] is None and len(later):
                key["end"] = at + int(later[0])
        if len(closes) and out["close1"] is None:
            out["close1"] = at + int(closes[0])
        # a key may begin before the block, so one is looked for where it ends
        near = file.read_at(min(NEAR, at), at - min(NEAR, at)) if names else b""
        text = near + data
        for name, quoted in names:
            for found in re.finditer(re.escape(quoted), text):
                end = found.end() - 1 - len(near)  # the closing quote, in this block
                if end < 0:
                    continue
                before = int(np.searchsorted(places, end))
                if (int(deep[before - 1]) if before else was) != 1:
                    continue
                rest = file.read_at(min(NEAR, size - at - end - 1), at + end + 1)
                value = re.match(rb"[ \t\r\n]*:[ \t\r\n]*(.)", rest, re.S)
                starts = re.search(rb"[{,][ \t\r\n]*$", text[: found.start()])
                if value and starts:
                    value_at = at + end + 1 + value.start(1)
                    ends = closes[at + closes > value_at]
                    out["keys"].append(
                        {"name": name, "value_at": value_at, "list": value[1] == b"[", "end": at + int(ends[0]) if len(ends) else None}
                    )
    return out


def junk(data: bytes, was: int, places: np.ndarray, deep: np.ndarray) -> int:
    """The bytes of a block outside of all brackets that are not blank."""
    if was != 0 and not (deep == 0).any():
        return 0
    low = np.concatenate(([0], places + 1))[np.concatenate(([was], deep)) == 0]
    high = np.concatenate((places, [len(data)]))[np.concatenate(([was], deep)) == 0]
    # a bracket that closes none is no junk, but makes the depth negative
    seen = np.concatenate(([0], np.cumsum(~np.isin(np.frombuffer(data, np.uint8), np.frombuffer(SPACE, np.uint8)))))
    return int((seen[high] - seen[low]).sum())


def cut(file, begin: int, stop: int, state: int, depth: int, level: int, first: int, last: int, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records that begin in a split and are not blank; the
    last one is read past its end."""
    here = first if begin <= first else begin if start == begin else None
    if level == 0:  # one record; its inside is not looked at
        if here is not None:
            yield here, file.read_at(last - here, here)
        return
    scanner = Scanner(state, depth)
    for at, data in chain(blocks(file, begin, min(stop, last)), blocks(file, stop, last)):
        places, kinds, deep = scanner.feed(*marks_of(data), len(data))
        ends = at + places[(kinds == 0x2C) & (deep == level)]
        for end in ends[ends >= first].tolist():
            if here is not None:
                text = (data[here - at : end - at] if here >= at else file.read_at(end - here, here)).strip(SPACE)
                if text:
                    yield here, text
            here = end + 1
            if here >= stop:
                return
        if here is None and at + len(data) >= stop:
            return
    if here is not None:
        text = file.read_at(last - here, here).strip(SPACE)
        if text:
            yield here, text


class Bytes:
    """``read_at`` over bytes that are held anyway."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


def over_splits(splits: DataFrame, run, fields: dict[str, str]) -> DataFrame:
    """Rows that ``run(file, split)`` gives as tuples, of all splits."""
    names = list(fields)
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        kinds = {
            "string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
            KEYS: pa.list_(pa.struct([("name", pa.string()), ("value_at", pa.int64()), ("list", pa.bool_()), ("end", pa.int64())])),
        }

        def batch_of(rows: list[tuple]):
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, fields.values())], names=names)

        rows, size, opened, file = [], 0, None, None
        try:
            for batch in batches:
                for split in batch.to_pylist():
                    if split["path"] != opened:
                        if file is not None:
                            file.close()
                        store, path = fs.FileSystem.from_uri(split["path"])
                        opened, file = split["path"], store.open_input_file(path)
                    for row in run(file, split):
                        rows.append(row)
                        size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
                        if size > BATCH:
                            yield batch_of(rows)
                            rows, size = [], 0
            yield batch_of(rows)
        finally:
            if file is not None:
                file.close()

    return splits.mapInArrow(task, schema)


KEYS = "array<struct<name:string,value_at:bigint,list:boolean,end:bigint>>"
SHAPE = {
    "roots": "bigint", "root_at": "bigint", "root": "string", "root_end": "bigint", "junk": "bigint", "low": "bigint",
    "comma1": "bigint", "comma2": "bigint", "close1": "bigint", "keys": KEYS,
}


def splits_of(spark: SparkSession, paths: list[str], split_bytes: int) -> DataFrame:
    """(path, size, run, begin, stop) of the splits of files; contents are not
    read. ``run`` numbers stretches of ``RUN`` splits."""
    files = spark.read.format("binaryFile").load(paths).select(
        F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"), F.col("length").alias("size")
    )
    last = F.floor((F.greatest("size", F.lit(1)) - 1) / split_bytes)
    begin = F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("n")
    cuts = files.select("path", "size", begin).select(
        "path", "size", F.floor(F.col("n") / RUN).alias("run"), (F.col("n") * split_bytes).alias("begin"), F.least("size", (F.col("n") + 1) * split_bytes).alias("stop")
    )
    return cut_lineage(cuts, "json-splits")


def _spread(splits: DataFrame) -> DataFrame:
    """Tasks by the bytes that splits stand for: a row is small, so the number is
    given and not left to be merged. Small splits share a task, of all cores."""
    size = splits.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("begin")).alias("bytes")).first()
    tasks = max(splits.sparkSession.sparkContext.defaultParallelism, -(-(size["bytes"] or 0) // SPLIT_BYTES))
    return splits.repartition(max(1, min(size["n"], tasks)), "path", "begin")


def beginnings(splits: DataFrame) -> DataFrame:
    """Splits with ``state`` and ``depth`` where they begin, and ``closed``:
    whether their file ends outside of all strings and brackets.

    The functions of a run of splits are composed to one, those of the runs of
    a file then tell how each run begins, and so each of its splits: the work
    grows with the number of splits, and no row holds all of a file.
    """

    def run(file, split):
        ends, deeper = ways(file, split["begin"], split["stop"])
        yield split["path"], split["run"], split["begin"], ends, deeper

    fields = {"path": "string", "run": "bigint", "begin": "bigint", "ends": "array<bigint>", "deeper": "array<bigint>"}
    found = over_splits(_spread(splits), run, fields)
    steps = F.array_sort(F.collect_list(F.struct("begin", "ends", "deeper"))).alias("steps")
    runs = cut_lineage(found.groupBy("path", "run").agg(steps), "json-runs")

    # a run as one function: how it ends for the three ways it may begin
    same = F.struct(F.array(*[F.lit(i).cast("bigint") for i in range(3)]).alias("ends"), F.array(*[F.lit(0).cast("bigint")] * 3).alias("deeper"))

    def then(acc: Column, x: Column) -> Column:
        at = [acc["ends"][i].cast("int") for i in range(3)]
        return F.struct(
            F.array(*[F.get(x["ends"], i) for i in at]).alias("ends"),
            F.array(*[acc["deeper"][k] + F.get(x["deeper"], i) for k, i in enumerate(at)]).alias("deeper"),
        )

    whole = runs.select("path", F.col("run").alias("begin"), F.aggregate("steps", same, then).alias("f")).select("path", "begin", "f.*")
    files = whole.groupBy("path").agg(steps).withColumns({"state": F.lit(OUTSIDE).cast("bigint"), "depth": F.lit(0).cast("bigint")})
    files = files.select("path", _walked("steps").alias("r")).select(
        "path", ((F.col("r.state") == OUTSIDE) & (F.col("r.depth") == 0)).alias("closed"), F.explode("r.out").alias("s")
    )
    begun = files.select("path", "closed", F.col("s.begin").alias("run"), "s.state", "s.depth")
    known = runs.join(begun, ["path", "run"]).select("path", "closed", _walked("steps").alias("r"))
    known = known.select("path", "closed", F.explode("r.out").alias("s"))
    return splits.join(known.select("path", "closed", "s.*"), ["path", "begin"])


def _walked(steps: str) -> Column:
    """From ``state`` and ``depth`` on, over a run's steps: ``out``, how each of
    them begins, and how the last one ends."""
    start = F.struct(F.col("state"), F.col("depth"), F.array().cast("array<struct<begin:bigint,state:bigint,depth:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["state"].cast("int")
        here = F.struct(x["begin"].alias("begin"), acc["state"].alias("state"), acc["depth"].alias("depth"))
        return F.struct(
            F.get(x["ends"], at).alias("state"), (acc["depth"] + F.get(x["deeper"], at)).alias("depth"),
            F.concat(acc["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(steps, start, step)


def planned(splits: DataFrame, keys: list[str], first_key_only: bool) -> DataFrame:
    """Splits with what their file is: ``level`` of its records (-1: no record,
    null: no single document), their bytes ``first`` to ``last``, and ``start``,
    where the record began that a split begins in."""

    def run(file, split):
        found = shape(file, split["begin"], split["stop"], split["size"], split["state"], split["depth"], keys)
        yield (split["path"], split["run"], split["begin"], *(found[name] for name in SHAPE))

    parts = cut_lineage(over_splits(_spread(splits), run, {"path": "string", "run": "bigint", "begin": "bigint"} | SHAPE), "json-shapes")
    closed = splits.groupBy("path").agg(F.first("closed").alias("closed"))
    one = parts.groupBy("path").agg(
        F.sum("roots").alias("roots"), F.sum("junk").alias("junk"), F.min("low").alias("low"), F.min("root_at").alias("root_at"),
        F.min_by("root", "root_at").alias("root"), F.max("root_end").alias("root_end"), F.flatten(F.collect_list("keys")).alias("keys"),
    ).join(closed, "path")
    chosen = None

    def last_of(name: str) -> Column:
        """Of a key that comes twice the last one counts."""
        own = F.filter("keys", lambda k: k["name"] == name)
        return F.array_max(F.transform(own, lambda k: F.struct(k["value_at"].alias("at"), k["list"].alias("list"), k["end"].alias("end"))))

    for name in keys:
        last = last_of(name)
        fits = last.isNotNull() if first_key_only else last.isNotNull() & last["list"]
        chosen = F.when(fits, last) if chosen is None else chosen.when(fits, last)
    none = F.lit(None).cast("struct<at:bigint,list:boolean,end:bigint>")
    one = one.withColumn("key", none if chosen is None else F.when(F.col("root") == "{", chosen))
    single = (F.col("roots") == 1) & (F.col("junk") == 0) & (F.col("low") >= 0) & F.col("closed")
    level = F.when(F.col("root") == "[", 1).when(F.col("key").isNull(), 0).when(F.col("key.list"), 2).otherwise(-1)
    ends = parts.join(one.select("path", F.col("key.at").alias("__at")), "path").filter(F.col("close1") > F.col("__at"))
    one = one.join(ends.groupBy("path").agg(F.min("close1").alias("later")), "path", "left")
    one = one.withColumn("level", F.when(single, level).cast("bigint")).withColumns(
        {
            "first": F.when(F.col("level") == 1, F.col("root_at") + 1).when(F.col("level") == 2, F.col("key.at") + 1).otherwise(F.col("root_at")),
            "last": F.when(F.col("level") == 1, F.col("root_end")).when(F.col("level") == 2, F.coalesce("key.end", "later")).otherwise(F.col("root_end") + 1),
        }
    )
    one = cut_lineage(one.select("path", "level", "first", "last"), "json-files")
    # the last comma before a split, of its run and of the runs before
    comma = F.when(F.col("level") == 1, F.col("comma1")).when(F.col("level") == 2, F.col("comma2"))
    commas = parts.select("path", "run", "begin", "comma1", "comma2").join(one, "path").withColumn("after", comma + 1)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = commas.groupBy("path", "run").agg(F.max("after").alias("after"))
    runs = runs.select("path", "run", F.max("after").over(before(Window.partitionBy("path").orderBy("run"))).alias("__runs"))
    here = F.max("after").over(before(Window.partitionBy("path", "run").orderBy("begin")))
    starts = commas.withColumn("__here", here).join(runs, ["path", "run"])
    starts = starts.select("path", "level", "first", "last", "begin", F.greatest("first", "__here", "__runs").alias("start"))
    return splits.drop("closed").join(starts, ["path", "begin"])


def document_plan(
    spark: SparkSession, paths: list[str], keys: tuple[str, ...], *, first_key_only: bool = False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """The splits of files with what ``planned`` tells about them."""
    splits = cut_lineage(beginnings(splits_of(spark, paths, split_bytes)), "json-states")
    return cut_lineage(planned(splits, list(keys), first_key_only), "json-plan")


def json_documents(
    spark: SparkSession, paths: list[str], keys: tuple[str, ...], *, first_key_only: bool = False, split_bytes: int = SPLIT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(records, others): the records of files that are one document each, as
    (source, block, seq, value), and the paths of the files that are not.

    The records of an object are those of the list under the first of ``keys``
    that has one (with ``first_key_only``: under the first that is there, and
    none if it holds no list); without one the object is the record. ``seq`` is
    the byte at which a record begins.
    """
    plan = document_plan(spark, paths, keys, first_key_only=first_key_only, split_bytes=split_bytes)
    return records_of(plan), plan.filter("level IS NULL").select("path").distinct()


def records_of(plan: DataFrame) -> DataFrame:
    """The records of planned splits as (source, block, seq, value), read from the
    files whenever they are asked for."""

    def run(file, split):
        for at, text in cut(
            file, split["begin"], split["stop"], split["state"], split["depth"], split["level"], split["first"], split["last"], split["start"]
        ):
            yield split["path"], at, text

    wanted = plan.filter((F.col("level") >= 0) & (F.col("begin") < F.col("last")) & (F.col("stop") > F.col("first")))
    rows = over_splits(_spread(wanted), run, {"source": "string", "seq": "bigint", "piece": "binary"})
    text = F.make_valid_utf8(F.col("piece").cast("string"))
    return rows.select("source", F.lit(0).cast("bigint").alias("block"), "seq", text.alias("value"))


def envelopes(plan: DataFrame) -> DataFrame:
    """(source, value): the object around the list of each file that has one,
    without what is in the list."""

    def run(file, split):
        for low, high in ((split["begin"], min(split["stop"], split["first"])), (max(split["begin"], split["last"]), split["stop"])):
            if low < high:
                yield split["path"], low, file.read_at(high - low, low)

    around = plan.filter((F.col("level") == 2) & ((F.col("begin") < F.col("first")) | (F.col("stop") > F.col("last"))))
    rows = over_splits(_spread(around), run, {"source": "string", "at": "bigint", "piece": "binary"})
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "piece"))), F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    return rows.groupBy("source").agg(F.make_valid_utf8(joined.cast("string")).alias("value"))


def numbered(records: DataFrame) -> DataFrame:
    """Add ``pos``, the number of a record in its source by ``seq``, from 0. Records
    are counted by stretches of bytes, in which they are then numbered; a source
    is in no single task."""
    there = cut_lineage(records.withColumn("__part", F.floor(F.col("seq") / STRETCH)), "numbered")
    counts = there.groupBy("source", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("source", "__part").orderBy("seq")) - 1
    return there.withColumn("__own", own).join(counts, ["source", "__part"]).withColumn(
        "pos", F.col("__before") + F.col("__own")
    ).drop("__part", "__own", "__before")
