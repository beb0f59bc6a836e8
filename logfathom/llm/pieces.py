"""SentencePiece encoding over a shared-prefix forward pass, and decoding.

The distinct marked words of a batch are sorted; the sorted list is a trie in
depth-first order. The forward state of a prefix (the last piece, and the score
where scores are summed) is kept on a stack, and each word starts from the
state of the longest prefix it shares with the word before it, so a prefix is
scored once however many words begin with it.

Two rules give the forward state. For ``unigram`` models it is the Viterbi
rule: the best sum of scores over the pieces that end here. For ``bpe`` models
sums of scores do not give the model's own segmentation, so the last piece is
the one that the merges would leave here: it is unique, and a piece is it if
the merges, run over the piece before it and itself, would not join them. So
the ids of a BPE model are those of the sentencepiece library.

Marked words are runs of U+2581 and the characters up to the next one. Pieces
never hold that mark after another character (checked when a model is loaded),
so words are independent. A run of marks before a word is merged after all
other pieces, so all but its last mark are encoded apart.

Characters outside the vocabulary become byte pieces where the model has them,
the unknown piece otherwise. Models with a normaliser of their own use it.

Defined cases: null text is empty and has no ids. Texts that hold U+2581 encode
it like a blank, so they decode with blanks instead; bytes of an invalid
sequence decode to U+FFFD. Rows are independent, so repeated rows have equal ids.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.llm.tables import documents, text_runs, worker_memory

MARK = "▁"
REMEMBERED = 500_000
# Characters up to which a word is remembered.
REMEMBERED_LENGTH = 64
# The library's penalty of an unknown character below the lowest score.
UNKNOWN_PENALTY = 10.0


def proto_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, fields = self.library, {}
        for number, value in proto_fields(sp.serialized_model_proto()):
            if number in (2, 3):  # trainer and normaliser settings
                fields[number] = dict(proto_fields(value))
        self.rule = {1: "unigram", 2: "bpe"}[fields.get(2, {}).get(3, 1)]
        form = fields.get(3, {})
        self.charsmap = bool(form.get(2, b""))
        self.prefix, self.trim = bool(form.get(3, 1)), bool(form.get(4, 1))
        n = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.texts[i]: i for i in plain}
        self.scores = [sp.get_score(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        # the ends of all pieces: the id, or -1 where no piece is the end itself
        self.tails = {text[k:]: -1 for text in self.ids for k in range(1, len(text))} | self.ids
        self.pairs: dict[int, bool] = {}
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("pieces that span words are not supported")
        self.apart = all(set(t) == {MARK} for t in self.ids if t.startswith(MARK * 2))
        # ranks of merges: higher scores first
        self.rank = {i: (-self.scores[i], i) for i in plain}
        low = min((self.scores[i] for i in plain), default=0.0)
        self.unknown_score = low - UNKNOWN_PENALTY
        self.halves: dict[str, tuple[str, str] | None] = {}

    def normal(self, text: str) -> str:
        if self.charsmap or self.trim:
            return self.library.normalize(text)
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def merged(self, text: str, leave: int = 1) -> list[str]:
        """The merges of a BPE model, until ``leave`` symbols are left."""
        parts, after = list(text), list(range(1, len(text) + 1))
        before = list(range(-1, len(text) - 1))
        heap, ids, scores, n = [], self.ids, self.scores, len(parts)

        def offer(a: int, b: int) -> None:
            one = ids.get(parts[a] + parts[b])
            if one is not None:
                heap.append((-scores[one], a, b, parts[a] + parts[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        heapify(heap)
        left = n
        while heap and left > leave:
            _, a, b, both = heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            left -= 1
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y < n:
                    one = ids.get(parts[x] + parts[y])
                    if one is not None:
                        heappush(heap, (-scores[one], x, y, parts[x] + parts[y]))
        return [p for p in parts if p is not None]

    def half(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes ``piece``; None for a character, and
        an empty pair for a piece that merges never make."""
        known = self.halves.get(piece, 0)
        if known == 0:
            if len(piece) == 1:
                known = None
            else:
                known = ("", "")
                if self.merged(piece) == [piece]:
                    known = tuple(self.merged(piece, 2))
            self.halves[piece] = known
        return known

    def made(self, piece: str) -> bool:
        return len(piece) == 1 or self.half(piece) != ("", "")

    def apart_here(self, a: str, b: str) -> bool:
        """Whether merges over ``a + b`` leave these two pieces.

        Merges are undone in reverse order on both sides of the boundary. At
        every stage the two pieces that touch must not merge earlier than the
        merge undone last.
        """
        ids, rank = self.ids, self.rank
        x, y = a, b
        bound = None
        while True:
            both = ids.get(x + y)
            if both is not None and (bound is None or (rank[both] < bound if bound[1] >= 0 else rank[both] <= (bound[0], -bound[1] - 1))):
                return False
            hx, hy = self.half(x), self.half(y)
            if hx is None and hy is None:
                return True
            rx = rank[ids[x]] if hx is not None else None
            ry = rank[ids[y]] if hy is not None else None
            if ry is None or (rx is not None and rx > ry):
                # the left piece was made last; at equal ranks the left one is made first
                bound, x = rx, hx[1]
            else:
                bound, y = (ry[0], -ry[1] - 1), hy[0]

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of sorted distinct marked words."""
        ids, scores, tails, bpe = self.ids, self.scores, self.tails, self.rule == "bpe"
        pairs, many = self.pairs, len(self.texts)
        if len(pairs) > REMEMBERED:
            pairs.clear()
        ends: list[tuple[int, int]] = [(0, -1)]  # by prefix: length and id of its last piece
        sums: list[float] = [0.0]
        last = ""
        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            del ends[same + 1 :], sums[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                best, found = None, None
                for size in range(1, i + 1):
                    text = word[i - size : i]
                    one = tails.get(text)
                    if one is None:  # no longer piece ends so
                        break
                    if one < 0:
                        continue
                    if bpe:
                        length, before = ends[i - size]
                        if before >= 0:
                            pair = before * many + one
                            fits = pairs.get(pair)
                            if fits is None:
                                fits = pairs[pair] = self.made(text) and self.apart_here(word[i - size - length : i - size], text)
                            if not fits:
                                continue
                        elif not self.made(text):
                            continue
                        found = (size, one)
                        break
                    else:
                        score = sums[i - size] + scores[one]
                        if best is None or score > best:
                            best, found = score, (size, one)
                if not bpe:
                    unknown = sums[i - 1] + self.unknown_score
                    if word[i - 1] not in ids and (best is None or unknown > best):
                        best, found = unknown, (1, -1)
                    sums.append(best)
                ends.append(found or (1, -1))
            out: list[int] = []
            i = len(word)
            while i:
                size, one = ends[i]
                if one >= 0:
                    out.append(one)
                elif self.bytes:
                    out += [self.bytes[x] for x in reversed(word[i - 1].encode("utf-8", "replace"))]
                elif not (out and out[-1] == self.unknown):
                    out.append(self.unknown)
                i -= size
            out.reverse()
            last = word
            yield word, out


class Encoder:
    """Encodes texts with a bounded memory of marked words."""

    def __init__(self, path: str) -> None:
        self.model, self.known = Model(path), {}
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [ids for run in text_runs(texts) for ids in self.encode_run(run)]

    def encode_run(self, texts: list[str]) -> list[np.ndarray]:
        model, known = self.model, self.known
        if len(known) > REMEMBERED:
            known.clear()
        groups = [self.split(model.normal(t)) for t in texts]
        new = {g for gs in groups for g in gs if g not in known}
        plain, runs = {}, set()
        for g in new:
            body = g.lstrip(MARK)
            marks = len(g) - len(body)
            if model.rule == "bpe" and model.apart and (marks > 1 or not body):
                plain[g] = (MARK + body if body else "", marks - bool(body))
                runs |= {marks, marks - 1}
            else:
                plain[g] = (g, 0)
        words = sorted({w for w, _ in plain.values() if w})
        found = dict(model.encode_words(words))
        run = {k: [model.ids[p] if p in model.ids else model.unknown for p in model.merged(MARK * k)] for k in runs if k}
        fresh, alone = {}, model.ids.get(MARK)
        for g, (word, extra) in plain.items():
            own = found[word] if word else []
            if extra and own and own[0] == alone:
                own = run[extra + 1] + own[1:]
            elif extra:
                own = run[extra] + own
            fresh[g] = np.array(own, np.int32).tobytes()
        known.update(fresh)
        out = [np.frombuffer(b"".join(map(known.__getitem__, gs)), np.int32) for gs in groups]
        for g in fresh:
            if len(g) > REMEMBERED_LENGTH:
                del known[g]
        return out


class Decoder:
    def __init__(self, path: str) -> None:
        model = Model(path)
        self.prefix = model.prefix
        self.parts = [t.replace(MARK, " ").encode() for t in model.texts]
        for value, i in model.bytes.items():
            self.parts[i] = bytes([value])
        for i in range(len(self.parts)):
            if model.library.is_control(i):
                self.parts[i] = b""
        self.parts[model.unknown] = " ⁇ ".encode()
        self.low, self.high = (min(model.bytes.values()), max(model.bytes.values())) if model.bytes else (1, 0)

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.parts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encoded(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All columns and ``out_col``, the ids of the text; a column of that name is
    replaced."""
    docs = docs.drop(out_col)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(out_col)).schema
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or worker_memory(f"encoder {model}", lambda: Encoder(model))
            found = encoder.encode(batch.column(place).to_pylist())
            sizes = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and ``out_col``, the text of the ids; a column of that name is
    replaced."""
    rows = rows.drop(out_col)
    schema = rows.select("*", F.lit(None).cast("string").alias(out_col)).schema
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or worker_memory(f"decoder {model}", lambda: Decoder(model))
            texts = [decoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, schema)


def digested(rows: DataFrame, model: str) -> DataFrame:
    """Counts and digests of ids (``ids``) and of the text they decode to."""
    schema = "doc_id bigint, n_ids bigint, n_byte_ids bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            if decoder is None:
                decoder = worker_memory(f"decoder {model}", lambda: Decoder(model))
            ids = [x.values.to_numpy(zero_copy_only=False).astype("<u4") for x in batch.column(2)]
            texts = [decoder.decode(x.tolist()) for x in ids]
            given = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([int(((x >= decoder.low) & (x <= decoder.high)).sum()) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                    pa.array([t == (g or "") for t, g in zip(texts, given)]),
                ],
                names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return rows.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), "ids").mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, read back by decoding them."""
    model = default_model()
    return digested(encoded(documents(spark, sf_dir).select("doc_id", "text"), model), model)


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLES: dict[str, str] = {}
