"""A Merkle manifest of a table, with proofs from checkpointed levels.

Every row is a leaf: the SHA-256 of its values, each with its length. Leaves of
a group, in order of a key, are the first level of a tree in which every
``FAN`` consecutive nodes become the hash of their digests. The tops of all
groups, in order of the group's name, are the leaves of one more tree, whose
top is the root.

Only every ``STEP``-th level is stored. The nodes of a stored level are cut
into aligned subtrees of FAN ** STEP nodes; a subtree is one small group of
rows, whose inner nodes are computed there. A proof is extracted from the top
down: each subtree gets the path above it once, computes its inner nodes anew
from the stored ones, hands the longer paths to the subtrees below, and keeps
nothing. So what is stored beside the leaves is a 1/80 of them, and no proof is
written out: at the leaves only its digest and the root it folds to are.

Places of leaves come from a sort by ranges of (group, key, leaf), a count per
range, and running sums of these counts; a group of any size is spread over
many tasks. A subtree holds 81 rows at most.

Defined cases: a null value is '-', so null and empty differ. Rows with equal
keys are ordered by their leaf; equal rows are leaves of their own, whose
places are interchangeable. A null key comes before all others, a null group
is a group of its own, the first. An empty table has no root and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.llm.tables import documents, stored

FAN = 3
STEP = 4  # levels from one stored level to the next
WIDTH = FAN**STEP

PATH = "array<struct<left:string,right:string>>"


def leaf(values: Sequence[Column]) -> Column:
    """The digest of values: '-' for null, else bytes in UTF-8, ':' and the value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)).cast("binary"), 256)


def placed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``place``, the number of a row in its ``tree`` in order of ``keys``
    and ``digest``, and ``n``, the size of the tree. ``rows`` must be stored:
    what tells equal rows apart has to stay when a task is run again."""
    order = ["tree", *keys, "digest", "__tie"]
    spread = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    spread = stored(
        spread.drop("__tie").withColumns({"__at": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}), "merkle-order"
    )
    parts = spread.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("__rows").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored(
        parts.select("tree", "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(tree).alias("n")),
        "merkle-parts",
    )
    found = spread.join(parts, ["tree", "__part"])
    return found.withColumn("place", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__first", "__before")


def hashed(texts: Sequence[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def inner_levels(nodes: list[str], alone: bool) -> list[list[str]]:
    """The levels of an aligned subtree, from its stored nodes to its top. The
    only subtree of a tree ends where one node is left."""
    levels = [nodes]
    while len(levels[-1]) > 1 if alone else len(levels) <= STEP:
        last = levels[-1]
        levels.append([hashed(last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def siblings(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """By level, the digests left and right of a node in its run."""
    out = []
    for level in levels[:-1]:
        start = place // FAN * FAN
        out.append(("".join(level[start:place]), "".join(level[place + 1 : start + FAN])))
        place //= FAN
    return out


def folded(digest: str, path: Sequence[tuple[str, str]]) -> str:
    for left, right in path:
        digest = hashed((left, digest, right))
    return digest


def subtrees(level: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """(tree, n, part, nodes): the nodes of each aligned subtree, in order."""
    rows = F.array_sort(F.collect_list(F.struct("place", "digest", *payload)))
    return level.withColumn("part", F.floor(F.col("place") / WIDTH)).groupBy("tree", "part").agg(F.first("n").alias("n"), rows.alias("nodes"))


def climbed(level: DataFrame) -> DataFrame:
    """The next stored level: (tree, n, place, digest), one row per subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for n, nodes in zip(batch.column("n").to_pylist(), batch.column("nodes")):
                tops.append(inner_levels(nodes.values.field("digest").to_pylist(), n <= WIDTH)[-1][0])
            sizes = [-(-n // WIDTH) for n in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), pa.array(sizes, pa.int64()), batch.column("part"), pa.array(tops, pa.string())],
                names=["tree", "n", "place", "digest"],
            )

    nodes = subtrees(level.select("tree", "n", "place", "digest"))
    return nodes.mapInArrow(run, "tree string, n bigint, place bigint, digest string")


class Manifest:
    """The stored levels of a forest: ``levels[0]`` has the leaves and their
    key, the last level only tops. ``n`` is the number of nodes that the tree of
    a node has on its level, so 1 marks a top."""

    def __init__(self, leaves: DataFrame, key: str) -> None:
        self.levels = [stored(placed(leaves, [key]), "merkle-leaves")]
        size = self.levels[0].agg(F.max("n")).first()[0] or 0
        while size > 1:
            self.levels.append(stored(climbed(self.levels[-1].filter("n > 1")), "merkle-level"))
            size = -(-size // WIDTH)

    def tops(self) -> DataFrame:
        """(tree, digest), one row per tree."""
        return reduce(DataFrame.unionByName, [x.filter("n = 1").select("tree", "digest") for x in self.levels])

    def paths(self, level: int, tops: DataFrame) -> DataFrame:
        """(tree, place, path, subroot, root) of all nodes of a stored level.
        ``tops`` has the path from each tree's top on."""
        found = None
        for k in range(len(self.levels) - 1, level - 1, -1):
            here = self.levels[k].filter("n = 1").select("tree", "place").join(tops, "tree")
            if found is not None:
                here = here.unionByName(lengthened(with_path(subtrees(self.levels[k].filter("n > 1")), found)))
            found = stored(here, "merkle-paths")
        return found

    def proofs(self, tops: DataFrame) -> DataFrame:
        """One row per leaf: its key, digest, subroot and root, the digest of its
        proof, and the root that ``held`` folds to."""
        leaves = self.levels[0]
        payload = [c for c in leaves.columns if c not in ("tree", "n", "place", "digest")]
        alone = leaves.filter("n = 1").join(tops, "tree")
        groups = alone.select("n", F.array(F.struct("place", "digest", *payload)).alias("nodes"), "path", "subroot", "root")
        if len(self.levels) > 1:
            others = with_path(subtrees(leaves.filter("n > 1"), payload), self.paths(1, tops))
            groups = groups.unionByName(others.select(*groups.columns))
        return proved(groups)


def with_path(groups: DataFrame, above: DataFrame) -> DataFrame:
    """Subtrees with the path from their top on, which is a node of ``above``."""
    above = above.withColumnRenamed("place", "part")
    return groups.join(above, ["tree", "part"])


def path_rows(column: pa.Array) -> list[list[tuple[str, str]]]:
    return [[(x["left"], x["right"]) for x in path] for path in column.to_pylist()]


def lengthened(groups: DataFrame) -> DataFrame:
    """(tree, place, path, subroot, root) of the nodes of each subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            trees, ns, subroots, roots = (batch.column(c).to_pylist() for c in ("tree", "n", "subroot", "root"))
            for tree, n, nodes, path, subroot, root in zip(trees, ns, batch.column("nodes"), path_rows(batch.column("path")), subroots, roots):
                levels = inner_levels(nodes.values.field("digest").to_pylist(), n <= WIDTH)
                for i, place in enumerate(nodes.values.field("place").to_pylist()):
                    own = [{"left": a, "right": b} for a, b in siblings(levels, i) + path]
                    out.append((tree, place, own, subroot, root))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])), pa.string(), pa.string()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["tree", "place", "path", "subroot", "root"]
            )

    return groups.mapInArrow(run, f"tree string, place bigint, path {PATH}, subroot string, root string")


def proved(groups: DataFrame) -> DataFrame:
    """One row per leaf: key, leaf, subroot, root, proof_sha256, folded_root."""
    key = groups.schema["nodes"].dataType.elementType["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, tops, proofs, folds, lengths = [], [], [], [], []
            for n, nodes, path in zip(batch.column("n").to_pylist(), batch.column("nodes"), path_rows(batch.column("path"))):
                digests = nodes.values.field("digest").to_pylist()
                levels = inner_levels(digests, n <= WIDTH)
                rest = "".join(a + b for a, b in path)
                for i, held in enumerate(nodes.values.field("held").to_pylist()):
                    own = siblings(levels, i)
                    proofs.append(hashed([a + b for a, b in own] + [rest]))
                    folds.append(folded(folded(held, own), path))
                leaves += digests
                lengths.append(len(digests))
            flat = batch.column("nodes").flatten()
            again = pa.array([i for i, k in enumerate(lengths) for _ in range(k)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("key"), pa.array(leaves, pa.string()),
                    batch.column("subroot").take(again), batch.column("root").take(again),
                    pa.array(proofs, pa.string()), pa.array(folds, pa.string()),
                ],
                names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
            )

    schema = f"key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return groups.mapInArrow(run, schema)


def manifest_proofs(
    docs: DataFrame, values: Sequence[str], group_col: str, key_col: str, held: Column | None = None
) -> DataFrame:
    """One row per row of ``docs``: its key, leaf, the tops of its group and of
    all, and what its proof comes to.

    ``held`` is the leaf that the holder of a row computes, which is checked by
    the proof (by default the row's own).
    """
    own = leaf([F.col(c) for c in values])
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(group.alias("tree"), F.col(key_col).alias("key"), own.alias("digest"), (own if held is None else held).alias("held"))
    groups = Manifest(stored(leaves, "merkle-input"), "key")
    # the tops of the groups are the leaves of the tree above
    tops = groups.tops().select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")
    whole = Manifest(stored(tops, "merkle-subroots"), "key")
    start = whole.tops().select("tree", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    above = whole.paths(0, start).select("place", "path", "root")
    tops = stored(
        whole.levels[0].select("place", F.col("key").alias("tree"), F.col("digest").alias("subroot")).join(above, "place").drop("place"), "merkle-tops"
    )
    found = groups.proofs(tops).withColumn("verified", F.col("folded_root") == F.col("root"))
    return found.withColumnRenamed("key", key_col)


VALUES = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proofs of all documents, half of them checked after line ends went."""
    docs = documents(spark, sf_dir)
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    values = [F.when(hit, cut).otherwise(F.col("text")) if c == "text" else F.col(c) for c in VALUES]
    return manifest_proofs(docs, VALUES, "source", "doc_id", leaf(values))


def crc32_sql(text: str) -> str:
    """The CRC-32 of a short ASCII text: eight shifts per character."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    shifts = f"list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, i: {step}, xor(a, b))"
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT), lambda a, b: {shifts}, 4294967295::BIGINT))"


def leaf_sql(text: str) -> str:
    part = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return f"sha256({' || '.join(part.format(v) for v in values)})"


ORACLE = f"""
    WITH RECURSIVE d AS (SELECT *, {leaf_sql('text')} AS leaf,
            {leaf_sql("CASE WHEN " + crc32_sql('doc_id::VARCHAR') + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS held FROM documents),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                   count(*) OVER (PARTITION BY source) AS n FROM d),
        nodes(source, lvl, i, n, digest) AS (SELECT source, 0::BIGINT, i::BIGINT, n::BIGINT, leaf FROM leaves
            UNION ALL SELECT source, lvl + 1, i // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY i))
            FROM nodes WHERE n > 1 GROUP BY source, lvl, i // {FAN}),
        subroots AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
        upper(lvl, i, n, digest) AS (SELECT 0::BIGINT, i::BIGINT, n::BIGINT, digest FROM subroots
            UNION ALL SELECT lvl + 1, i // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY i))
            FROM upper WHERE n > 1 GROUP BY lvl, i // {FAN}),
        steps AS (
            SELECT l.source, l.i AS place, k.lvl, coalesce(string_agg(k.digest, '' ORDER BY k.i) FILTER (k.i < l.i // pow), '') AS a,
                   coalesce(string_agg(k.digest, '' ORDER BY k.i) FILTER (k.i > l.i // pow), '') AS b
            FROM (SELECT *, CAST({FAN} ** lvl AS BIGINT) AS pow FROM leaves, (SELECT unnest(range(0, 25)) AS lvl)) l
            JOIN nodes k ON k.source IS NOT DISTINCT FROM l.source AND k.lvl = l.lvl AND k.n > 1 AND k.i // {FAN} = l.i // pow // {FAN}
            GROUP BY l.source, l.i, k.lvl),
        steps2 AS (
            SELECT l.source, k.lvl, coalesce(string_agg(k.digest, '' ORDER BY k.i) FILTER (k.i < l.i // pow), '') AS a,
                   coalesce(string_agg(k.digest, '' ORDER BY k.i) FILTER (k.i > l.i // pow), '') AS b
            FROM (SELECT *, CAST({FAN} ** lvl AS BIGINT) AS pow FROM subroots, (SELECT unnest(range(0, 25)) AS lvl)) l
            JOIN upper k ON k.lvl = l.lvl AND k.n > 1 AND k.i // {FAN} = l.i // pow // {FAN}
            GROUP BY l.source, k.lvl),
        low AS (SELECT source, place, list(a || '|' || b ORDER BY lvl) AS path FROM steps GROUP BY ALL),
        high AS (SELECT source, list(a || '|' || b ORDER BY lvl) AS path FROM steps2 GROUP BY ALL),
        every AS (SELECT l.doc_id, l.leaf, l.held, s.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root,
                         list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
                  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
                  LEFT JOIN low ON low.source IS NOT DISTINCT FROM l.source AND low.place = l.i
                  LEFT JOIN high ON high.source IS NOT DISTINCT FROM l.source)
    SELECT *, folded_root = root AS verified FROM (
        SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
               list_reduce(path, lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2)), held) AS folded_root FROM every)
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {"op11_merkle_manifest": ORACLE}
