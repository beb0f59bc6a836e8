"""Chat formatting with prefix-target expansion.

Each assistant turn is an example of its own: all turns before it are context,
its reply is the target and the only part under the loss mask. So an example is
a prefix of its conversation's text. The text of a conversation is stored once,
as one segment per turn with its place in the text; an example is the row of
its target turn with the length of the prefix and the span of the mask in code
points. The size of the output so grows with the turns, not with their square;
``example_texts`` writes the prefixes out for those who want them.

The template marks a turn as ``<|role|>``, newline, text, ``<|end|>``, newline.
A backslash in a role or text is doubled and one is put inside each control
string of this and other common templates, so no text can forge a mark and
unescaping gives the text back.

Places are running sums in two steps, over spans of ``SPAN`` turn numbers and
over the spans of a conversation, so a conversation of very many turns is not
one task's work.

Defined cases: null role or text counts as empty. Turns are ordered by number
(nulls first), then role, then text; repeated rows are turns of their own. Rows
with a null conversation id are one conversation. A conversation without an
assistant turn has segments but no example. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.llm.tables import stored

SPAN = 64
END = "<|end|>\n"
# Where a control string begins: its first character, before the rest of it.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
SEGMENT = re.compile(r"<\|((?:[^|\\]|\\.)*)\|>\n(.*)<\|end\|>\n", re.S)
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", "$1\\\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per turn: conv_id, seq (0, 1, …), start, segment, and for an
    assistant turn example, prefix_chars, mask_from, mask_to (else null)."""
    empty = F.lit("")
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), empty).alias("text"),
    ).withColumns(
        {
            "span": F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62))).cast("bigint"),
            "head": F.concat(F.lit("<|"), F.replace(escaped(F.col("role")), F.lit("|"), F.lit("\\|")), F.lit("|>\n")),
            "body": escaped(F.col("text")),
        }
    ).withColumn("segment", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    target = (F.col("role") == TRAINED).cast("bigint")
    rows = rows.withColumns(
        {
            "seq": (F.row_number().over(order) - 1).cast("bigint"),
            "start": F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)),
            "example": F.coalesce(F.sum(target).over(before), F.lit(0)),
        }
    )
    spans = rows.groupBy("conv_id", "span").agg(
        F.count("*").alias("turns"), F.sum(F.length("segment")).alias("chars"), F.sum(target).alias("targets")
    )
    running = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select(
        F.col("conv_id").alias("__conv"), F.col("span").alias("__span"),
        *[F.coalesce(F.sum(c).over(running), F.lit(0)).alias(f"__{c}") for c in ("turns", "chars", "targets")],
    )
    rows = rows.join(bases, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("span") == F.col("__span")))
    start = F.col("start") + F.col("__chars")
    trained = F.col("role") == TRAINED
    mask = start + F.length("head")
    return rows.select(
        "conv_id", (F.col("seq") + F.col("__turns")).alias("seq"), start.alias("start"), "segment",
        F.when(trained, F.col("example") + F.col("__targets")).alias("example"),
        F.when(trained, start + F.length("segment")).alias("prefix_chars"),
        F.when(trained, mask).alias("mask_from"), F.when(trained, mask + F.length("body")).alias("mask_to"),
    )


def example_texts(rows: DataFrame) -> DataFrame:
    """(conv_id, example, text, mask_from, mask_to) with the prefixes written
    out: their size grows with the square of a conversation's length."""
    targets = rows.filter("example IS NOT NULL").select(
        F.col("conv_id").alias("__conv"), F.col("seq").alias("__seq"), "example", "mask_from", "mask_to"
    )
    parts = rows.select("conv_id", "seq", "segment").join(
        targets, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("seq") <= F.col("__seq"))
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "segment"))), lambda x: x["segment"]), "")
    return parts.groupBy("conv_id", "example", "mask_from", "mask_to").agg(text.alias("text"))


def read_back(rows: DataFrame) -> DataFrame:
    """Parse formatted rows, read every example, and digest each conversation.

    An example is read as its prefix: the running digest of the text, taken at
    the end of its target turn, is that of all its turns. It has to end there,
    and its mask has to be exactly the reply of an assistant turn; anything else
    is an error. ``examples_sha256`` digests the examples of a conversation in
    order, each as the digest of its text and the span of its mask.

    A digest needs its conversation in order; rows stream past it one by one,
    so a task holds a batch of rows whatever the length of a conversation.
    """
    fields = {
        "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
        "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_examples": pa.int64(), "example_chars": pa.int64(), "examples_sha256": pa.string(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []

        def close() -> None:
            if state is not None:
                done.append([conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:7], state[8].hexdigest()])

        for batch in batches:
            for one, start, segment, prefix, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or one != conv:
                    close()
                    conv, state = one, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                if state[4] != start:
                    raise ValueError(f"conversation {one}: a segment is missing before {start}")
                parts = SEGMENT.fullmatch(segment)
                role, text = unescape(parts[1]), unescape(parts[2])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(segment)
                state[7].update(segment.encode())
                if (low is not None) != (role == TRAINED):
                    raise ValueError(f"conversation {one}: the turn at {start} has a mask that is not its own")
                if low is not None:
                    masked = segment[low - start : high - start]
                    if prefix != state[4] or masked != parts[2] or low - start != parts.start(2):
                        raise ValueError(f"conversation {one}: the example at {start} does not end in its masked reply")
                    reply = unescape(masked)
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    state[5] += 1
                    state[6] += prefix
                    state[8].update(f"{state[7].hexdigest()}:{low}:{high}\n".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), fields.values())], names=list(fields))
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), fields.values())], names=list(fields))

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    ddl = ", ".join(f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in fields.items())
    return dealt.select("conv_id", "start", "segment", "prefix_chars", "mask_from", "mask_to").mapInArrow(run, ddl)


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        f"SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS turn, r AS role, '{PROBE}' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(n, r)"
    )
    return read_back(stored(formatted(turns.unionByName(probe)), "formatted"))


QUERIES = {"op2_chat_examples": op2_chat_examples}
ORACLES = {
    "op2_chat_examples": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -1, n, r, '{PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)
        ), bodies AS (
            SELECT *, '<|' || r || '|>' || chr(10) AS head, regexp_replace(regexp_replace(replace(t, '\', '\\'),
                   '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS body
            FROM turns
        ), sized AS (
            SELECT *, head || body || '<|end|>' || chr(10) AS segment, length(head) + length(body) + {len(END)} AS n FROM bodies
        ), placed AS (
            SELECT *, sum(n) OVER w AS upto, sum(n) OVER w - n + length(head) AS low, sha256(string_agg(segment, '') OVER w) AS prefix
            FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, r, t ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
               CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars, count(*) FILTER (r = 'assistant') AS n_examples,
               CAST(coalesce(sum(upto) FILTER (r = 'assistant'), 0) AS BIGINT) AS example_chars,
               sha256(coalesce(string_agg(prefix || ':' || CAST(low AS BIGINT) || ':' || CAST(low + length(body) AS BIGINT) || chr(10), ''
                               ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS examples_sha256
        FROM placed GROUP BY conv_id
    """
}
