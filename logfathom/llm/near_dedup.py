"""Near duplicates by fast similarity sketches, banding and exact checks.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in each of the first T rounds
every shingle is hashed to one of T bins, in round T + i every shingle goes to
bin i; a bin keeps the smallest (round, hash). So all T bins are filled, after
about one round for sets much larger than T, and the share of equal bins is
concentrated around the similarity like T independent samples. Bands of bins
give candidate buckets.

Documents with the same word sequence form a class with one representative, so
copies meet in a groupBy and are never paired. In a bucket, the smallest
id is compared with all others, and the components of the links found are
taken. Where a bucket still holds more than one component, its members outside
the largest one are collected in blocks, and every member of the bucket is
compared with the blocks it shares a bucket with, by an index of the block's
shingles. So each pair of a bucket is compared or known to be connected: there
is no cap, and pairs are never rows. The comparison uses full shingle sets.

Missed links: T = 128 in 32 bands of 4 miss a pair of similarity s with
probability (1 - s^4)^32: 5e-6 at 0.75, 2e-8 at 0.8.

Defined cases: null or empty text, and text without words: no shingles, linked
with nothing. Fewer than five words: the sequence is the only shingle. Rows
without an id are kept with a null component. Rows that repeat id and text
share their component. The classes are the nodes of the graph, not the ids, so
different texts under one id have their own components and verdicts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.llm.components import components
from logfathom.llm.tables import documents, join_hot, stored, text_bytes, within_bound

WORDS = 5
PERCENT = 75
BINS = 128
BAND = 4
# Texts compared with one leader, or with one block, in one go.
MEMBERS = 500
# Texts in a block, on average.
BLOCK = 400
# Distinct words a task remembers the hash of.
REMEMBERED = 400_000

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
FULL = U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(words: Sequence[bytes], hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a word sequence."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, n)
    size = min(n, k)
    out = np.full(n - size + 1, size, U)
    for i in range(size):
        out *= ODD
        out += h[i : n - size + 1 + i]
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketch(sets: Sequence[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` filled coordinates for each non-empty set."""
    table = np.full(len(sets) * bins, FULL, U)
    values = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn in range(2 * bins):
        h = mix(values + U((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if turn < bins:
            place = ((h >> U(32)) * U(bins)) >> U(32)
        else:
            place = np.full(len(h), turn - bins, U)
        rank = (U(turn) << U(55)) | (mix(h) >> U(9))
        np.minimum.at(table, owner * bins + place.astype(np.int64), rank)
        open_rows = (table.reshape(-1, bins) == FULL).any(axis=1)
        if not open_rows.any():
            break
        active = open_rows[owner]
        if not active.all():
            values, owner = values[active], owner[active]
    return table.reshape(-1, bins)


def band_keys(table: np.ndarray, band: int = BAND) -> np.ndarray:
    """One hash per band; the band's number is part of it."""
    parts = table.reshape(len(table), -1, band)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=U), parts.shape[:2]).copy()
    for i in range(band):
        keys = mix(keys ^ parts[:, :, i])
    return keys


def sketches(docs: DataFrame, id_col: str, text_col: str, bins: int = BINS, band: int = BAND) -> DataFrame:
    """(id, n_shingles, words_key, bands); key and bands are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, sets = [], []
            for text in text_bytes(batch.column(1)):
                words = text.lower().split()
                keys.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
                sets.append(shingles(words, hashes))
            filled = [s for s in sets if len(s)]
            flat = band_keys(sketch(filled, bins), band).view(np.int64)
            sizes = np.array([0, *(flat.shape[1] if len(s) else 0 for s in sets)], np.int32)
            bands = pa.ListArray.from_arrays(
                pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat.ravel()), mask=pa.array([not len(s) for s in sets])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), bands],
                names=["id", "n_shingles", "words_key", "bands"],
            )

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id bigint, n_shingles bigint, words_key binary, bands array<bigint>")


def close_in_size(a, b):
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * PERCENT)


def check_pairs(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough.

    ``u`` is a leader with many partners. Its text goes once to every group of
    ``MEMBERS`` partners, where it is held while they stream past it, so
    neither a task nor a leader ever has to hold its partners.
    """
    sized = pairs.join(pairs.groupBy("u").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "u")
    members = sized.select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"))
    leaders = (
        sized.select("u", "parts").distinct()
        .select("u", F.col("u").alias("v"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    )
    texts = members.unionByName(leaders).join(pool, F.col("v") == pool["id"]).drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, leader, own = WordHashes(), None, None
        for batch in batches:
            us, vs, sides = (batch.column(i).to_pylist() for i in (0, 1, 2))
            found = []
            for u, v, side, text in zip(us, vs, sides, text_bytes(batch.column(3))):
                other = shingles(text.lower().split(), hashes)
                if side == 0:
                    leader, own = u, other
                elif leader == u:
                    both = len(own) + len(other) - len(np.union1d(own, other))
                    if both * 100 >= PERCENT * (len(own) + len(other) - both) and both:
                        found.append((u, v))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"]
            )

    dealt = texts.repartition("u", "part").sortWithinPartitions("u", "part", "side")
    return dealt.select("u", "v", "side", "text").mapInArrow(run, "u bigint, v bigint")


def first_pairs(members: DataFrame, rows: int) -> DataFrame:
    """Each member of a bucket with the bucket's smallest id."""
    leaders = stored(
        members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("size")), "leaders"
    )
    found = join_hot(members, leaders, ["bucket"], "size", rows, "inner").filter(F.col("id") != F.col("lead.id"))
    found = found.filter(close_in_size(F.col("n"), F.col("lead.n")))
    return found.select(F.col("lead.id").alias("u"), F.col("id").alias("v")).distinct()


def left_over(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that hold more than one component, and of these
    the ones outside the bucket's largest component (``id``, ``bucket``)."""
    known = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = known.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    buckets = parts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
    mixed = buckets.filter("parts > 1").select("bucket", F.col("main.component").alias("main"))
    rest = stored(known.join(mixed, "bucket"), "open")
    return rest, rest.filter("component <> main").select("id", "bucket")


def check_blocks(rest: DataFrame, outer: DataFrame, pool: DataFrame) -> DataFrame:
    """The links between left-over members and the members of their buckets.

    A left-over id has a home, the smallest id it shares a bucket with, and
    belongs to one block of it. Whoever shares a bucket with one of a home
    meets all blocks of the home, each once, however many buckets they share.
    """
    homes = rest.groupBy("bucket").agg(F.min("id").alias("lead"))
    own = outer.join(homes, "bucket").groupBy("id").agg(F.min("lead").alias("home"))
    sizes = own.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    own = own.join(sizes, "home").select("id", "home", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("block"))
    own = stored(own, "blocks")
    # who meets a home at all; then every block of the home
    near = outer.join(own, "id").select("bucket", "home").distinct()
    meets = rest.select("id", "bucket").join(near, "bucket").select("home", "id").distinct().join(sizes, "home")
    every = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
    meets = stored(meets.select("home", every.alias("block"), "id"), "meets")
    parts = meets.groupBy("home", "block").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = meets.join(parts, ["home", "block"]).select(
        "home", "block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "id"
    )
    heads = own.join(parts, ["home", "block"]).select(
        "home", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "id"
    )
    texts = members.unionByName(heads).join(pool, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, block = WordHashes(), None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))))
            sides, ids = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            us, vs = [], []
            for now, side, one, text in zip(keys, sides, ids, text_bytes(batch.column(5))):
                if now != key:
                    key, block = now, Block()
                own = shingles(text.lower().split(), hashes)
                if side == 0:
                    block.add(one, own)
                else:
                    found = block.links(one, own)
                    us += found
                    vs += [one] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    dealt = texts.repartition("home", "block", "part").sortWithinPartitions("home", "block", "part", "side")
    return dealt.select("home", "block", "part", "side", "id", "text").mapInArrow(run, "u bigint, v bigint")


class Block:
    """Shingle sets with an index from shingle to the sets that hold it."""

    def __init__(self) -> None:
        self.ids, self.sets, self.values = [], [], None

    def add(self, one: int, own: np.ndarray) -> None:
        self.ids.append(one)
        self.sets.append(own)

    def links(self, one: int, other: np.ndarray) -> list[int]:
        if self.values is None:
            self.sizes = np.array([len(s) for s in self.sets])
            values = np.concatenate(self.sets) if self.sets else np.zeros(0, U)
            order = np.argsort(values, kind="stable")
            self.values, self.owner = values[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        start = np.searchsorted(self.values, other, "left")
        n = np.searchsorted(self.values, other, "right") - start
        places = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        both = np.bincount(self.owner[places], minlength=len(self.ids))
        close = np.flatnonzero((both * 100 >= PERCENT * (self.sizes + len(other) - both)) & (both > 0))
        return [self.ids[i] for i in close if self.ids[i] != one]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_shingles, component_id, kept, words_key."""
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    total = rows.count()
    classes = stored(
        rows.filter("words_key IS NOT NULL AND id IS NOT NULL").groupBy("words_key")
        .agg(F.min(F.struct("id", "n_shingles", "bands")).alias("head"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    heads = classes.select(F.col("node").alias("id"), F.col("head.n_shingles").alias("n"), F.explode("head.bands").alias("bucket"))
    shared = heads.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(heads.join(shared.select("bucket"), "bucket", "left_semi"), "buckets")
    slots = members.count()
    merged = classes.select("words_key", "copies", F.col("head.id").alias("component"))
    if slots:
        labels = stored(bucket_components(docs, id_col, text_col, members, classes, slots), "labels")
        linked = classes.join(labels.withColumnRenamed("id", "node"), "node")
        least = linked.groupBy("component").agg(F.min("head.id").alias("__least"))
        by_node = labels.join(least, "component").select(F.col("id").alias("node"), "__least")
        merged = classes.join(by_node, "node", "left").select(
            "words_key", "copies", F.coalesce("__least", F.col("head.id")).alias("component")
        )
    merged = stored(merged, "merged")
    found = join_hot(rows.select("id", "n_shingles", "words_key"), merged, ["words_key"], "copies", total)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "words_key"
    )


def words_digest(text: Column) -> Column:
    """The ``words_key`` of a text, as ``sketches`` makes it."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.array_remove(F.split(F.translate(text, upper, upper.lower()), r"[\x20\x09-\x0D]+"), "")
    return F.unhex(F.sha2(F.array_join(words, " ").cast("binary"), 256))


def bucket_components(
    docs: DataFrame, id_col: str, text_col: str, members: DataFrame, classes: DataFrame, slots: int
) -> DataFrame:
    """(id, component) of the linked members of shared buckets."""
    heads = classes.select("node", F.col("head.id").alias("id"), "words_key").join(members.select(F.col("id").alias("node")).distinct(), "node")
    wanted = within_bound(heads)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # an id may have several texts; the class has one of them
    pool = texts.join(wanted, "id").filter(words_digest(F.col("text")) == F.col("words_key"))
    pool = stored(pool.select(F.col("node").alias("id"), "text"), "pool")
    pairs = stored(first_pairs(members, slots), "pairs")
    links = stored(check_pairs(pairs, pool), "links")
    labels = stored(components(links), "labels")
    rest, outer = left_over(members, labels)
    more = stored(check_blocks(rest, outer, pool), "links")
    return stored(components(links.unionByName(more)), "labels") if more.take(1) else labels


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of each group with the smallest id, with all its columns.
    Each row follows the verdict of its own id and text."""
    drop = near_groups(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("id"), "words_key").distinct()
    drop = within_bound(drop.withColumnsRenamed({"id": "__drop", "words_key": "__drop_key"}))
    rows = docs.select(F.struct(*docs.columns).alias("__row"))
    own = F.col("__row").getField(id_col).cast("bigint")
    same = (own == F.col("__drop")) & (words_digest(F.col("__row").getField(text_col).cast("string")) == F.col("__drop_key"))
    return rows.join(drop, same, "left_anti").select("__row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir).select("doc_id", "text")).drop("words_key")


SETS = f"""
    words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
              FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s
             FROM words),
    items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
    reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
"""

QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLES = {
    "op6_near_dedup": f"""
        WITH RECURSIVE {SETS}
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
        FROM sets JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) ON doc_id = u
    """
}
