"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is cut
into the longest phrases that occur in that text; the language that needs the
fewest phrases, times the logarithm of its training length and divided by the
length of the text (the estimate of the cross entropy), wins. Whole texts are
parsed.

The automata are fitted on whole texts of a bounded sample of labelled rows:
``SAMPLE_ROWS`` a language, chosen by a hash of the id. Predictions use the text
alone. An automaton is held by every worker, for each language: languages are
few, and what a model needs is the sample's text. Texts of about one length are
parsed together, with a table of all automata.

Texts are lower-cased, and everything between runs of letters counts as one
blank.

Defined cases: null text and text without a letter give ``und`` and score 0, as
does every text if nothing could be learned. Ties go to the first language in
order of its name. The score is 1 - best / second, and 1 if only one language
was learned. Rows without an id are predicted but never learned from.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.llm.tables import documents, text_runs, worker_memory

SAMPLE_ROWS = 16
# Parts of a language whose ids are ranked apart.
PARTS = 64
UNDECIDED = "und"
# Cells of the table of all automata; with more, texts are parsed one by one.
TABLE_CELLS = 50_000_000
# Fewer texts than these are not worth a step together.
TOGETHER = 24
RUN_CHARS = 8 << 20  # of texts parsed together


LETTERS = r"\p{L}+"


def letters(text: str) -> str:
    return " ".join(regex.findall(LETTERS, text.lower()))


def numbered_states(text: str) -> list[dict]:
    """The states of the suffix automaton, the start state first; a state is a
    dict from character to the number of a state."""
    edges: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


def linked(edges: list[dict]) -> list[dict]:
    """The same states, from character to state."""
    for state in edges:
        for c, to in state.items():
            state[c] = edges[to]
    return edges


def automaton(text: str) -> dict:
    """The start state of the suffix automaton; a state is a dict from
    character to state, so a walk is one look-up per character."""
    return linked(numbered_states(text))[0]


def walk(text: str, state: dict, root: dict) -> tuple[int, bool]:
    """Phrases that end while ``text`` is read from ``state`` on, and whether
    nothing is open after it."""
    n = 0
    for c in text:
        following = state.get(c)
        if following is None:
            n += state is not root
            following = root.get(c)
            if following is None:  # a phrase of one unknown character
                n += 1
                following = root
        state = following
    return n, state is root


def phrases(text: str, root: dict) -> int:
    """How many longest matches, one after the other, make up ``text``."""
    n, closed = walk(text, root, root)
    return n + 1 - (closed and n > 0)


class Models:
    """The automata of all languages, also as one table (state, character), by
    which many texts are parsed together: character by character of all texts
    that are as long. Texts that few others are as long as go on alone."""

    def __init__(self, training: dict[str, str]) -> None:
        self.names, self.weights = list(training), [math.log2(len(t) + 1) for t in training.values()]
        signs = sorted(set().union(*training.values()))
        self.width = len(signs) + 1  # the last one stands for every other character
        self.codes = np.full(sys.maxunicode + 1, len(signs), np.int32)
        self.codes[[ord(c) for c in signs]] = range(len(signs))
        self.states: list[list[dict]] = []
        self.table, self.roots, tables, at = None, [], [], 0
        for text in training.values():
            edges = numbered_states(text)
            if (at + len(edges)) * self.width <= TABLE_CELLS:
                table = np.full((len(edges), self.width), -1, np.int32)
                for state, row in zip(edges, table):
                    for c, to in state.items():
                        row[self.codes[ord(c)]] = at + to
                tables.append(table)
            self.roots.append(at)
            at += len(edges)
            self.states.append(linked(edges))
        if len(tables) == len(self.names) > 0:
            self.table = np.concatenate(tables)
            starts = np.array(self.roots, np.int32)[:, None]
            self.first = np.where(self.table[self.roots] < 0, starts, self.table[self.roots])

    def parsed(self, texts: list[str]) -> np.ndarray:
        """The phrases of each text (row) for each language (column)."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        n = np.zeros((len(self.names), len(texts)), np.int64)
        if self.table is None:
            done, state = 0, None
        else:
            done, state = self._together([texts[i] for i in order], lengths, n)
        for i in np.flatnonzero(lengths >= done).tolist():
            rest = texts[order[i]][done:]
            for k, states in enumerate(self.states):
                here = states[0] if state is None else states[state[k, i] - self.roots[k]]
                more, closed = walk(rest, here, states[0])
                total = n[k, i] + more
                n[k, i] = total + 1 - (closed and total > 0)
        out = np.empty_like(n.T)
        out[order] = n.T
        return out

    def _together(self, texts: list[str], lengths: np.ndarray, n: np.ndarray) -> tuple[int, np.ndarray]:
        """Parse texts, the longest first, as far as ``TOGETHER`` of them reach.
        Shorter ones are finished; for the others the states there are returned."""
        signs = self.codes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum(lengths) - lengths
        cells, width, starts = self.table.ravel(), self.width, np.array(self.roots, np.int32)[:, None]
        active = len(texts)
        state = np.repeat(starts, active, axis=1)
        reach = int(lengths[TOGETHER - 1]) if active >= TOGETHER else 0
        # how many texts have a character at each place
        alive = np.searchsorted(-lengths, -np.arange(reach), side="left")
        for t in range(reach):
            if alive[t] < active:
                self._finish(state[:, alive[t] :], n[:, alive[t] : active], starts)
                active = int(alive[t])
                state = state[:, :active].copy()
            sign = signs[begins[:active] + t]
            following = cells[state * width + sign]
            k, i = np.nonzero(following < 0)
            after = self.first[k, sign[i]]
            n[k, i] += (state[k, i] != starts[k, 0]).astype(np.int64) + (after == starts[k, 0])
            following[k, i] = after
            state = following
        over = int(np.searchsorted(-lengths[:active], -reach, side="right"))
        if over < active:
            self._finish(state[:, over:], n[:, over:active], starts)
        return reach, state

    @staticmethod
    def _finish(state: np.ndarray, n: np.ndarray, starts: np.ndarray) -> None:
        n += 1 - ((state == starts) & (n > 0))

    def costs(self, texts: list[str]) -> list[list[tuple[float, str]]]:
        """(cost, language) of each text (of :func:`letters`), the cheapest first;
        none for an empty text."""
        rows = self.parsed(texts).tolist()
        return [sorted((n * w, name) for n, w, name in zip(row, self.weights, self.names)) if text else [] for text, row in zip(texts, rows)]


def training_texts(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS
) -> dict[str, str]:
    """The labelled text of each language, from rows that may be learned from.

    The sample is bounded in rows, so the driver may hold it.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    hashed = F.xxhash64("id")
    # ids are ranked without their texts, by parts of a language first
    keys = rows.select("lang", "id", hashed.alias("h"), F.pmod(hashed, F.lit(PARTS)).alias("part")).distinct()
    for by in (("lang", "part"), ("lang",)):
        keys = keys.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))).filter(F.col("place") <= sample_rows)
    rows = rows.join(F.broadcast(keys.select("lang", "id")), ["lang", "id"], "left_semi")
    # an id may stand for several rows
    order = Window.partitionBy("lang").orderBy(hashed, "id", F.xxhash64("text"))
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_rows)
    found: dict[str, list[str]] = {}
    for row in rows.orderBy("lang", "place").collect():
        found.setdefault(row.lang, []).append(letters(row.text))
    return {lang: text for lang, texts in sorted(found.items()) if (text := " ".join(filter(None, texts)))}


def predicted(docs: DataFrame, training: dict[str, str], text_col: str = "text") -> DataFrame:
    """All columns, ``lang_pred`` and ``score``; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    schema = docs.select(
        "*", F.lit("").cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("score")
    ).schema
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = None
        for batch in batches:
            if models is None:
                models = worker_memory(f"automata {sorted(training.items())}", lambda: Models(training))
            names, scores = [], []
            for run in text_runs((cell.as_py() for cell in batch.column(place)), RUN_CHARS):
                for costs in models.costs([letters(text) for text in run]):
                    names.append(costs[0][1] if costs else UNDECIDED)
                    scores.append(0.0 if not costs else 1.0 if len(costs) == 1 else 1.0 - costs[0][0] / costs[1][0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    training = training_texts(docs.filter(fold != 0), "doc_id", "text", "lang")
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predicted(rows, training).drop("text")


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}
