"""Mix sources to target weights, in DataFrame functions only.

The words of a source, its documents one after the other, are packed into
blocks of fixed length. The number of slots of a source in the mix follows from
its target; the slots fall on the output shards at random, so the source counts
of a shard are a multinomial draw given the totals, and the totals come out as
planned. Slot number i of a source takes block ``permute(i)`` of that source,
where the permutation is a keyed Feistel network on the block numbers: it needs
no table, any slot can be computed alone, and reruns agree. Slots and blocks
meet in a join by block number. ``mixed_pieces`` is the mix itself, with the
shard of each piece; ``shard_counts`` says how many slots of each source a
shard got.

Order inside a source is (chunk, id), with chunks by hash of the id, so the
running word count of a hot source is taken in ``CHUNKS`` independent parts.

Defined cases: null or empty texts have no words, take no part and get 0. Rows
with a null source are one source, the last one. Rows with a null id count like
others; their chunk is that of their text. Rows with equal ids are ordered by
their size and by a hash of their values, so a table whose rows come in another
order or number of partitions gives the same mix. Repeated rows are separate
documents. An empty table, or one without any word, gives taken 0 everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.llm.tables import documents, stored

BLANK = r"[\x20\x09-\x0D]"
CHUNKS = 1024
# Slots are made from rows that stand for so many, so that a hot source is not
# made in one task.
SPAN = 4096
TASK_SPANS = 8  # of them in a task, on average
# Rounds of the Feistel network, and walks back into the range. The network's
# range exceeds n by less than a = sqrt(n) + 1 values, each met once at most: up
# to n = 1024 a walk cannot fail, beyond it fails with (1/32)^32 at most.
ROUNDS = 4
WALK = 32


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)  # by place of the source, repeating
    share_percent: int = 150  # of all words
    most_times: int = 2  # of a source's words
    block: int = 64  # words
    shard_slots: int = 4096
    seed: int = 20240601


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) by filling up to the limits.

    With limits L_i and weights w_i the targets are min(L_i, w_i * t), where t
    makes their sum the share wanted (all limits, if they hold less). Sources
    reach their limit in the order of L_i / w_i, so t follows from running sums
    in that order. One row per source; sources are few next to documents.
    """
    rank = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.get(F.array(*[F.lit(float(x)) for x in mix.weights]), F.pmod(F.row_number().over(rank) - 1, F.lit(len(mix.weights))))
    df = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * float(mix.most_times))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns(
        {
            "want": F.sum("source_size").over(every) * F.lit(mix.share_percent) / 100.0,
            "level": F.col("limit") / F.col("w"),
            "fill": before, "rest": rest,
        }
    )
    # the first source that stays below its limit fixes the level for the rest
    df = df.withColumn("t", (F.col("want") - F.col("fill")) / F.col("rest"))
    t = F.min(F.when(F.col("t") < F.col("level"), F.struct("fill", "t"))).over(every)["t"]
    target = F.when(t.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("w") * t))
    return df.select("source", F.col("source_size").cast("bigint").alias("source_size"), target.cast("double").alias("target"))


def permute(i: Column, n: Column, key: Column) -> Column:
    """Where ``i`` of 0..n-1 goes: a Feistel network on pairs of two numbers
    below a and b, a * b >= n, walked on until the value is below n."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = F.ceil(n / a).cast("bigint")

    def network(x: Column) -> Column:
        def turn(p: Column, k: Column) -> Column:
            left = F.pmod(p["l"] + F.pmod(F.xxhash64(p["r"], k, key), a), a)
            return F.struct(left.alias("l"), p["r"].alias("r"), k.alias("k"))

        def back(p: Column, k: Column) -> Column:
            q = turn(p, k)
            right = F.pmod(q["r"] + F.pmod(F.xxhash64(q["l"], k, key), b), b)
            return F.struct(q["l"].alias("l"), right.alias("r"))

        pair = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, b).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, back, lambda p: p["l"] * b + p["r"])

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), F.struct(i.cast("bigint").alias("x"), F.lit(False).alias("ok")),
        lambda s, _: F.when(s["ok"], s).otherwise(walk_step(network(s["x"]), n)),
        lambda s: s["x"],
    )


def walk_step(x: Column, n: Column) -> Column:
    return F.struct(x.cast("bigint").alias("x"), (x < n).alias("ok"))


def placed(docs: DataFrame, mix: Mix, id_col: str, source_col: str, text_col: str, keep: tuple = ()) -> DataFrame:
    """Each row with its size and the place of its first word in its source.

    (source, chunk, row) names a row. Text is not carried unless kept.
    """
    plain = [f.name for f in docs.schema.fields if f.name in {*keep, text_col} and not re.search("map<|variant", f.dataType.simpleString())]
    rows = docs.select(
        *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)],
        F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"),
        F.size(F.array_remove(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANK + "+"), ""))
        .cast("bigint").alias("size"), F.xxhash64(*plain).alias("tie"),
    ).withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("id", "tie"), F.lit(mix.seed)), F.lit(CHUNKS)).cast("int"))
    order = Window.partitionBy("source", "chunk").orderBy("id", "size", "tie")
    rows = rows.withColumns(
        {
            "row": F.row_number().over(order),
            "inside": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    return rows.drop("tie")


def with_plan(rows: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """(rows with ``start``, plan with one row per source)."""
    chunks = stored(rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "chunks")
    running = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.withColumn("base", F.coalesce(F.sum("words").over(running), F.lit(0))).select(
        F.col("source").alias("__source"), F.col("chunk").alias("__chunk"), "base"
    )
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("chunk") == F.col("__chunk"))
    rows = rows.join(bases, same).drop("__source", "__chunk").withColumn("start", F.col("base") + F.col("inside"))
    plan = targets(chunks.groupBy("source").agg(F.sum("words").alias("source_size")), mix)
    # whole blocks, the last one filled up by the source's end
    blocks = F.ceil(F.col("source_size") / mix.block).cast("bigint")
    slots = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint")
    plan = plan.withColumn("blocks", blocks).withColumn(
        "slots", F.when(F.col("source_size") > 0, F.least(slots, F.col("blocks") * mix.most_times)).otherwise(F.lit(0))
    )
    return rows.drop("base", "inside"), stored(plan, "mix-plan")


def draw_slots(plan: DataFrame, mix: Mix) -> DataFrame:
    """(source, slot, shard, block, time): every slot of the mix.

    The shards of a source's slots are drawn one by one, so its count per shard
    is multinomial; ``time`` says whether the block comes for the first or a
    later time.
    """
    total = F.sum("slots").over(Window.partitionBy())
    spans = plan.filter("slots > 0").withColumn("shards", F.greatest(F.lit(1), F.ceil(total / mix.shard_slots))).select(
        "source", "blocks", "slots", "shards", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / SPAN))).alias("span")
    )
    # a few rows of the plan stand for all slots: so many tasks as these need
    tasks = max(1, -(-(plan.agg(F.sum("slots")).first()[0] or 0) // (TASK_SPANS * SPAN)))
    spans = spans.repartition(tasks, F.col("source"), F.col("span"))
    slots = spans.select(
        "source", "blocks", "shards",
        F.explode(F.sequence(F.col("span") * SPAN, F.least(F.col("slots"), (F.col("span") + 1) * SPAN) - 1)).alias("slot"),
    )
    name = F.coalesce(F.hex(F.col("source")), F.lit("-"))
    key = F.xxhash64(name, F.floor(F.col("slot") / F.col("blocks")), F.lit(mix.seed))
    return slots.select(
        "source", "slot",
        F.pmod(F.xxhash64(name, "slot", F.lit(mix.seed + 1)), F.col("shards")).alias("shard"),
        permute(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), key).alias("block"),
        (F.floor(F.col("slot") / F.col("blocks"))).cast("int").alias("time"),
    )


def pieces(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row per block that a document's words reach, with the span of words
    (``first`` in the document, ``n``). A very long document is cut in two
    steps, so it is not spread by one task alone."""
    end = F.col("start") + F.col("size") - 1
    wide = rows.filter("size > 0").select(
        "source", "chunk", "row", "start", "size", F.lit(mix.block * SPAN).cast("bigint").alias("span"),
        F.explode(F.sequence(F.floor(F.col("start") / (mix.block * SPAN)), F.floor(end / (mix.block * SPAN)))).alias("part"),
    )
    low = F.greatest(F.floor(F.col("start") / mix.block), F.col("part") * SPAN)
    high = F.least(F.floor((F.col("start") + F.col("size") - 1) / mix.block), (F.col("part") + 1) * SPAN - 1)
    cut = wide.select("source", "chunk", "row", "start", "size", F.explode(F.sequence(low, high)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * mix.block)
    stop = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * mix.block)
    return cut.select("source", "chunk", "row", "block", (begin - F.col("start")).alias("first"), (stop - begin).alias("n"))


def mixed_pieces(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """The mix: each slot's pieces of documents, joined by block number."""
    # a few rows of the plan become all slots: without the hint their size would
    # be taken for the plan's, and they would be broadcast
    slots = draw_slots(plan, mix).withColumnsRenamed({"source": "__source", "block": "__block"}).hint("merge")
    return pieces(rows, mix).join(
        slots, F.col("source").eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block"))
    ).drop("__source", "__block")


def shard_counts(plan: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(shard, source, n): the slots of each source that a shard of the mix gets."""
    return draw_slots(plan, mix).groupBy("shard", "source").agg(F.count("*").alias("n"))


def op9_mix_sources(spark: SparkSession, sf_dir: str, mix: Mix = Mix()) -> DataFrame:
    """What the mix takes of every document, and over how many of its shards."""
    rows = stored(placed(documents(spark, sf_dir), mix, "doc_id", "source", "text"), "placed")
    rows, plan = with_plan(rows, mix)
    rows = stored(rows, "rows")
    # what a shard takes of a document first, so that few rows meet for a document
    parts = mixed_pieces(rows, plan, mix).groupBy("source", "chunk", "row", "shard").agg(F.sum("n").alias("n"))
    taken = parts.groupBy("source", "chunk", "row").agg(F.sum("n").alias("taken"), F.count("*").alias("n_shards"))
    taken = taken.withColumnsRenamed({"source": "__s", "chunk": "__c", "row": "__r"})
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("chunk") == F.col("__c")) & (F.col("row") == F.col("__r"))
    out = rows.join(taken, same, "left").select("id", "source", "size", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("taken", "n_shards")])
    few = plan.count() <= 10_000
    by = plan.select(F.col("source").alias("__s"), "source_size", "target")
    out = out.join(F.broadcast(by) if few else by, F.col("source").eqNullSafe(F.col("__s")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "n_shards")


def remix(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents as the mix takes them: one row for each time, whose text
    is made of the words taken then, in order, with the blanks after them.
    Columns stay; a column ``n_chars`` is counted anew."""
    names = docs.columns
    rows = stored(placed(docs, mix, id_col, source_col, text_col, tuple(names)), "placed")
    rows, plan = with_plan(rows, mix)
    rows = stored(rows, "rows")
    parts = mixed_pieces(rows, plan, mix).groupBy("source", "chunk", "row", "time").agg(
        F.sort_array(F.collect_list(F.struct("first", "n"))).alias("parts"), F.sum("n").alias("taken")
    ).withColumnsRenamed({"source": "__s", "chunk": "__c", "row": "__r"})
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("chunk") == F.col("__c")) & (F.col("row") == F.col("__r"))
    found = rows.join(parts, same)
    columns = {c: F.col(f"__keep_{i}") for i, c in enumerate(names)}
    text = columns[text_col]
    # words with the blanks that follow them; leading blanks belong to the first
    words = F.regexp_extract_all(text, F.lit(rf"^{BLANK}*[^\x20\x09-\x0D]+{BLANK}*|[^\x20\x09-\x0D]+{BLANK}*"), F.lit(0))
    found = found.withColumn("__words", F.when(F.col("taken") < F.col("size"), words))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("__words", p["first"].cast("int") + 1, p["n"].cast("int")))), "")
    out = found.select(*[columns[c].alias(c) if c != text_col else F.when(F.col("taken") < F.col("size"), some).otherwise(text).alias(c) for c in names])
    return out.withColumn("n_chars", F.length(text_col).cast("bigint")) if "n_chars" in names else out


QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLES: dict[str, str] = {}
