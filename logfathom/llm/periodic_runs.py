"""Periodic runs of words by multi-scale minimizers, and their collapse.

A run is a stretch of words with smallest period q and at least three periods
long that no neighbouring word extends. Periods below ``2 * FIRST`` are found
by direct lag scans: stretches where each word equals the one q places on.
Every other period belongs to the scale w with 2w <= q < 4w:

* Every place has the hash of the w words that begin there (its gram). Grams
  that lie in a known run of a period up to w / 3 are left out.
* The minima of all windows of w grams are marked. Windows with equal words
  have equal minima, so inside a run minima repeat at the distance of the
  period. Pairs of equal minima at a distance of the scale are seeds.
* A seed is extended to both sides by comparing words at its distance; what
  comes out at least three periods long is a run.

No run is missed. The windows inside a run of three periods cover a whole
period twice, and not all grams of a period can be left out: two neighbours
with periods up to w / 3 have a common one (Fine and Wilf), which then were the
period of the whole run. A gram that is not left out does not repeat within
w / 3, so a mark has at most a dozen partners at a scale's distances, and a text
of n words takes O(n log n) steps. A distance that is a multiple of the
smallest period gives the same stretch again and is dropped. Hashes only
propose; words are compared by number.

Texts are worked on in bounded bundles, since most are short; a unique mark
ends each. Defined cases: null and empty texts and texts of fewer words than a
run has no runs; ids are only handed on, so null or repeated ids and repeated
rows are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.llm.tables import documents, text_bytes

LEAST_LENGTH = 24  # words of a run
LEAST_PERIODS = 3
FIRST = 8  # words of a gram at the first scale
BUNDLE = 250_000  # words worked on in one go, or one longer text
BLANK = r"[\x20\x09-\x0D]"

U = np.uint64
LAST = U(0xFFFFFFFFFFFFFFFF)


def scrambled(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def doubled(grams: np.ndarray, w: int) -> np.ndarray:
    """Hashes of 2w words from those of w. Past the end stands an end mark, so
    what is taken for it does not matter."""
    after = np.zeros_like(grams)
    after[: len(grams) - w] = grams[w:]
    return scrambled(grams * U(0x9E3779B97F4A7C15) + after + U(w))


def sliding(values: np.ndarray, w: int, best: np.ufunc, spare: np.uint64) -> np.ndarray:
    """The best of values[i : i + w] for every i; ``spare`` is past the end."""
    n = len(values)
    padded = np.full(-(-(n + w) // w) * w, spare, U)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[w - 1 : w - 1 + n])


def minimizers(grams: np.ndarray, w: int) -> np.ndarray:
    """Places whose gram is the least of some window of w grams."""
    least = sliding(grams, w, np.minimum, LAST)
    # the greatest minimum of the windows that hold a place
    held = sliding(np.concatenate((np.zeros(w - 1, U), least)), w, np.maximum, U(0))[: len(grams)]
    return np.flatnonzero((held == grams) & (grams != LAST))


def seeds(grams: np.ndarray, places: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal minimizers 2w to 4w apart whose neighbouring
    gram, before or after, is equal too; ordered by distance, then place."""
    order = np.argsort(grams[places], kind="stable")
    place = places[order]
    value = grams[place]
    starts, gaps, step = [], [], 1
    while step < len(place):
        gap = place[step:] - place[:-step]
        near = (value[step:] == value[:-step]) & (gap < 4 * w)
        if not near.any():
            break
        far = near & (gap >= 2 * w)
        starts.append(place[:-step][far])
        gaps.append(gap[far])
        step += 1
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, gap = np.concatenate(starts), np.concatenate(gaps)
    top = len(grams) - 1
    after, before = np.minimum(start + w, top), np.maximum(start - w, 0)
    equal = (grams[after] == grams[np.minimum(after + gap, top)]) | (grams[before] == grams[before + gap])
    start, gap = start[equal], gap[equal]
    order = np.lexsort((start, gap))
    return start[order], gap[order]


def agreement(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and from b on (``step`` 1) or back (-1) are equal."""
    n, size = 0, 64
    while True:
        if step > 0:
            size = min(size, len(x) - b - n)
            unequal = x[a + n : a + n + size] != x[b + n : b + n + size]
        else:
            size = min(size, a + 1 - n)
            unequal = x[a - n - size + 1 : a - n + 1][::-1] != x[b - n - size + 1 : b - n + 1][::-1]
        if size <= 0:
            return n
        at = int(unequal.argmax())
        if unequal[at]:
            return n + at
        n, size = n + size, size * 2


def extended(x: np.ndarray, start: np.ndarray, gap: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the stretches around seeds that are long enough."""
    out, last, end = [], -1, -1
    for m, q in zip(start.tolist(), gap.tolist()):
        if q == last and m < end:
            continue  # in the stretch extended before
        begin = m - agreement(x, m - 1, m + q - 1, -1) if m else m
        last, end = q, m + agreement(x, m, m + q, 1)
        if end - begin >= (LEAST_PERIODS - 1) * q:
            out.append((begin, end - begin + q, q))
    return out


def lag_scan(x: np.ndarray, q: int) -> np.ndarray:
    """Rows (start, length, period) of the stretches that have period q."""
    edge = np.zeros(len(x) - q + 2, np.int8)
    edge[1:-1] = x[q:] == x[:-q]
    cuts = np.flatnonzero(np.diff(edge))
    begin, size = cuts[::2], cuts[1::2] - cuts[::2]
    long = size >= (LEAST_PERIODS - 1) * q
    return np.stack((begin[long], size[long] + q, np.full(long.sum(), q)), axis=1)


def distinct_runs(rows: np.ndarray) -> np.ndarray:
    """By start and length, the row with the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, given as numbers of its words, the rows (start, length,
    period) of all its runs, in order of start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    kept = np.flatnonzero(sizes >= LEAST_LENGTH)
    none = np.zeros((0, 3), np.int64)
    found = [none] * len(texts)
    if not len(kept):
        return found
    x = np.concatenate([part for i in kept for part in (texts[i], [-i - 1])]).astype(np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes[kept] + 1)))
    rows = distinct_runs(np.concatenate([lag_scan(x, q) for q in range(1, min(2 * FIRST, len(x)))]))

    def owned(rows: np.ndarray, begins: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Rows with the text's number, and starts within it."""
        text = np.searchsorted(begins, rows[:, 0], "right") - 1
        return np.column_stack((kept[text], rows[:, 0] - begins[text], rows[:, 1:]))

    known = owned(rows, begins, kept)
    w, grams = 1, scrambled(x.view(U) + U(1))
    while w < FIRST:
        grams, w = doubled(grams, w), 2 * w
    while True:
        stay = sizes[kept] >= LEAST_PERIODS * 2 * w
        if not stay.any():
            break
        if not stay.all():
            mask = np.repeat(stay, sizes[kept] + 1)
            x, grams, kept = x[mask], grams[mask], kept[stay]
            begins = np.concatenate(([0], np.cumsum(sizes[kept] + 1)))
        place = np.full(len(texts), -1, np.int64)
        place[kept] = begins[:-1]
        inner = known[(known[:, 3] * 3 <= w) & (known[:, 2] >= w) & (place[known[:, 0]] >= 0)]
        marks = np.zeros(len(x) + 1, np.int64)
        at = place[inner[:, 0]] + inner[:, 1]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + inner[:, 2] - w + 1, -1)
        free = np.where(np.cumsum(marks[:-1]) > 0, LAST, np.minimum(grams, LAST - U(1)))
        new = extended(x, *seeds(free, minimizers(free, w), w))
        if new:
            known = np.concatenate((known, owned(np.array(new, np.int64), begins, kept)))
        grams, w = doubled(grams, w), 2 * w
    known = known[known[:, 2] >= LEAST_LENGTH]
    order = np.lexsort((known[:, 3], known[:, 2], known[:, 1], known[:, 0]))
    known = known[order]
    first = np.ones(len(known), bool)
    first[1:] = (known[1:, :3] != known[:-1, :3]).any(axis=1)
    known = known[first]
    known = known[np.lexsort((known[:, 3], known[:, 1], known[:, 0]))]
    cuts = np.searchsorted(known[:, 0], np.arange(len(texts) + 1))
    for i in np.unique(known[:, 0]).tolist():
        found[i] = known[cuts[i] : cuts[i + 1], 1:]
    return found


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run repeats, joined by one blank."""
    if not len(runs):
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0))


def bundles(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of the texts of a column, in bundles of bounded size."""
    held, size = [], 0
    for text in text_bytes(column):
        held.append(text.split())
        size += len(held[-1])
        if size >= BUNDLE:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, runs (start, length, period; in order of
    start and period) and the collapsed text. Other columns are not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            sizes, runs, texts = [], [], []
            for words in bundles(batch.column(1)):
                numbers = Numbers()
                codes = [np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws)) for ws in words]
                for ws, rows in zip(words, runs_of(codes)):
                    sizes.append(len(ws))
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in rows.tolist()])
                    texts.append(collapsed(ws, rows).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = narrow.select(
        "id", F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"), F.lit("").alias("collapsed"),
    ).schema
    for field in schema.fields:
        field.nullable = True
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def strongest(runs: str) -> Column:
    """The run with the most periods; of equal ones the first."""
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(F.col(runs), F.lit(0)),
        lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a),
    )


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): of one text in ten, by a hash of its id, the words from a
    place on are replaced by repetitions of the first ones there."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    df = docs.select(
        F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(h % 10 == 0, F.lit(False)).alias("hit"), F.floor(h / 10).alias("g"),
    )
    df = df.withColumn("words", F.when(F.col("hit"), F.array_remove(F.split("text", BLANK + "+"), "")))
    n = F.size("words")
    a = F.col("g") % n
    df = df.withColumns({"a": a, "p": 1 + F.floor((n - a) / (3 + F.col("g") % 8))})
    take = lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    )
    return df.select(id_col, F.when(F.col("hit") & (n > 0), F.array_join(F.transform("words", take), " ")).otherwise(F.col("text")).alias("text"))


def digested(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the output of ``with_runs``."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    rows = rows.withColumn("best", strongest("runs"))
    return rows.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(with_runs(planted(documents(spark, sf_dir))))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
