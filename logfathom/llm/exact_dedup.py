"""Exact duplicates by mergeable counting quotient filters.

Each task folds the fingerprints of its rows into filters, one per range of
quotients. A filter keeps sorted remainders in slots, two bits per slot or
quotient (occupied, end of run) and the counts above one. Filters of the same
range merge without loss, since sorted remainders merge like sorted lists.
Fingerprints whose merged count is above one route their rows to a byte
comparison; all other rows are known to be single.

Defined cases: null text counts as empty and equals empty text. The largest
id of a group stays; null ids sort below all others. Rows that repeat the kept
id and its text are all marked kept, since an id names a row (``drop_copies``
keeps one of them; rows without id or with equal ids stay if their texts
differ). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.llm.tables import Layout, documents, join_hot, spare_name, stored, text_bytes, within_bound

# Rows per range of quotients; bounds the memory of a merge.
RANGE_ROWS = 1_000_000
# Fingerprints a task holds before it emits its filters and starts new ones.
TASK_ROWS = 500_000

HEAD = Layout("<BBQQ")


def build_filter(fingerprints: np.ndarray, counts: np.ndarray, drop_bits: int) -> bytes:
    """A counting quotient filter of sorted distinct fingerprints.

    The leading ``drop_bits`` bits are the same in all of them (the range) and
    are not stored. Of the rest, about log2(n) bits are the quotient.
    """
    n = len(fingerprints)
    q = max(1, int(n - 1).bit_length()) if n else 1
    r = 64 - drop_bits - q
    low = fingerprints & np.uint64((1 << (64 - drop_bits)) - 1) if drop_bits else fingerprints
    quotients = low >> np.uint64(r)
    remainders = low & np.uint64((1 << r) - 1)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotients.astype(np.int64)] = True
    ends = np.ones(n, dtype=bool)
    ends[:-1] = quotients[1:] != quotients[:-1]
    above = np.flatnonzero(counts > 1)
    octets = np.ascontiguousarray(remainders.astype("<u8")).view(np.uint8).reshape(n, 8)[:, : (r + 7) // 8]
    return b"".join(
        (
            HEAD.pack(q, drop_bits, n, len(above)),
            np.packbits(occupied).tobytes(),
            np.packbits(ends).tobytes(),
            octets.tobytes(),
            above.astype("<u4").tobytes(),
            counts[above].astype("<u8").tobytes(),
        )
    )


def read_filter(data: bytes, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints and their counts; ``prefix`` is the range's number."""
    q, drop_bits, n, above = HEAD.unpack_from(data)
    r, at = 64 - drop_bits - q, HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, np.uint8, size, at)
        at += size
        return part

    occupied = np.unpackbits(take(((1 << q) + 7) // 8))[: 1 << q]
    ends = np.unpackbits(take((n + 7) // 8))[:n]
    width = (r + 7) // 8
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = take(n * width).reshape(n, width)
    remainders = wide.view("<u8").ravel()
    run = np.concatenate(([0], np.cumsum(ends)[:-1])) if n else np.zeros(0, np.int64)
    quotients = np.flatnonzero(occupied)[run.astype(np.int64)].astype(np.uint64) if n else np.zeros(0, np.uint64)
    counts = np.ones(n, np.uint64)
    index = take(4 * above).view("<u4")
    counts[index] = take(8 * above).view("<u8")
    high = np.uint64(prefix << (64 - drop_bits)) if drop_bits else np.uint64(0)
    return high | (quotients << np.uint64(r)) | remainders, counts


def merge_counts(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal fingerprints; input in any order."""
    order = np.argsort(fingerprints, kind="stable")
    f, c = fingerprints[order], counts[order]
    first = np.ones(len(f), dtype=bool)
    first[1:] = f[1:] != f[:-1]
    starts = np.flatnonzero(first)
    return f[starts], np.add.reduceat(c, starts) if len(f) else c


def digests(docs: DataFrame, id_col: str, text_col: str, with_text: bool = False) -> DataFrame:
    """(id, text_sha256, fingerprint), and the normalised bytes if asked for.

    The fingerprint is the head of the SHA-256; the filter stores all of its
    64 bits, so it counts the fingerprints themselves without error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.lower() for b in text_bytes(batch.column(1))]
            hashes = [hashlib.sha256(b).digest() for b in texts]
            columns = [
                batch.column(0),
                pa.array([h.hex() for h in hashes], pa.string()),
                pa.array(np.array([int.from_bytes(h[:8], "big") for h in hashes], np.uint64).view(np.int64)),
            ]
            names = ["id", "text_sha256", "fingerprint"]
            if with_text:
                columns.append(pa.array(texts, pa.binary()))
                names.append("body")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id bigint, text_sha256 string, fingerprint bigint" + (", body binary" if with_text else "")
    return narrow.mapInArrow(run, schema)


def repeated_fingerprints(rows: DataFrame, total: int) -> DataFrame:
    """(fingerprint, n) of those that occur more than once."""
    bits = max(0, (total // RANGE_ROWS).bit_length())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[np.ndarray]) -> pa.RecordBatch:
            f, c = np.unique(np.concatenate(held), return_counts=True)
            ranges = (f >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(f), np.int64)
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            parts = zip(np.split(f, cuts), np.split(c.astype(np.uint64), cuts))
            filters = [build_filter(a, b, bits) for a, b in parts]
            keys = ranges[np.concatenate(([0], cuts)).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(filters, pa.binary())], names=["part", "filter"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= TASK_ROWS:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        pairs = [read_filter(x.as_py(), part) for x in table.column("filter")]
        f, c = merge_counts(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        many = c > 1
        return pa.table({"fingerprint": f[many].view(np.int64), "n": c[many].astype(np.int64)})

    filters = rows.select("fingerprint").mapInArrow(fold, "part bigint, filter binary")
    return filters.groupBy("part").applyInArrow(merge, "fingerprint bigint, n bigint")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = stored(digests(docs, id_col, text_col), "digests")
    total = rows.count()
    repeated = stored(repeated_fingerprints(rows, total), "fingerprints")
    routed = join_hot(rows.select("id", "fingerprint"), repeated, ["fingerprint"], "n", total, "inner").select(F.col("id").alias("__routed"))
    # byte comparison: grouping by the text itself; copies meet in each task
    # before the shuffle, so a large group is a few rows per task
    ids = within_bound(routed.distinct())
    candidates = docs.join(ids, F.col(id_col).cast("bigint").eqNullSafe(F.col("__routed")), "left_semi")
    groups = (
        digests(candidates, id_col, text_col, with_text=True)
        .groupBy("body").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.first("text_sha256").alias("text_sha256"))
        .filter("group_size > 1").drop("body")
    )
    groups = stored(groups, "groups")
    found = join_hot(rows.select("id", "text_sha256"), groups, ["text_sha256"], "group_size", total)
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def with_key(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """Add the digest of the normalised text and the id, as one string."""
    narrow = docs.withColumn(name, F.col(text_col).cast("string"))
    schema = narrow.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [hashlib.sha256(b.lower()).hexdigest() for b in text_bytes(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hashes, pa.string())], names=batch.schema.names)

    return narrow.mapInArrow(run, schema).withColumn(name, F.concat_ws(":", name, F.col(id_col).cast("bigint").cast("string")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose own verdict is kept, with all their columns; of rows equal
    in id and normalised text, one."""
    name = spare_name(docs, "__key")
    key = F.concat_ws(":", "text_sha256", F.col(id_col).cast("string"))
    kept = exact_groups(docs.select(id_col, text_col), id_col, text_col).filter("kept").select(key.alias(name)).distinct()
    rows = with_key(docs, id_col, text_col, name)
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {
    "op10_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {LOWER} AS t FROM documents) WINDOW g AS (PARTITION BY t)
    """
}
