"""Byte-level BPE encoding by a segment tree over adjacent pair ranks, and decoding.

The leaves of the tree are the ranks of the adjacent pairs of a word; an inner
node holds the least rank below it. The root tells whether any pair merges, and
the way down that prefers the left child ends at the leftmost pair of the
lowest rank. A merge changes three leaves, each in as many steps as the tree is
high, so a word of n bytes takes O(n log n) steps however long it is. Words that
a run of texts brings anew are merged together, one merge of each at a time: the
trees of short words of one height are the rows of an array.

The vocabulary is a ``tokenizers`` file of a byte-level BPE model. Texts are
split at its added tokens, then into words by the fixed pattern of such models;
words are merged apart, and their ids are remembered in a bounded memory. What
is a letter depends on the edition of Unicode, so characters that the pattern's
engine and the library class differently are looked for once, on the driver,
and texts that hold one are split with a plain stand-in of the library's class.

Defined cases: null text is empty and has no ids. The string of an added token
inside a text becomes that token, as in the library. Ids that make no valid
UTF-8 decode to U+FFFD; null ids decode to null. Rows are independent, so repeated rows
have equal ids. A column that has the name of the output is replaced by it.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.llm.tables import documents, text_runs, worker_memory

REMEMBERED = 500_000
# Characters up to which a word is remembered.
REMEMBERED_LENGTH = 64
# Fixed value: the word pattern of byte-level BPE models, blanks by property. The
# frequent cases come first; the endings only have to be before other signs.
WORDS = (
    r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NO_RANK = (1 << 31) - 1
# Words of one tree height are merged together in blocks of so many. Fewer than
# the least, or words of more bytes, are merged each by itself.
BLOCK_WORDS = 4096
LEAST_TOGETHER = 32
WIDEST_TOGETHER = 64
# Characters of the texts, or ids, that are taken up at once.
RUN_SIZE = 1 << 18


def byte_signs() -> list[str]:
    """The sign of each byte in the vocabulary: visible Latin-1 characters stand
    for themselves, all other bytes follow from U+0100 on in order."""
    visible = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    signs, spare = [], 256
    for b in range(256):
        signs.append(chr(b if visible[b] else spare))
        spare += not visible[b]
    return signs


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, before = data["model"], data["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        words = before and before["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        added = data["added_tokens"]
        if not plain or not words or data["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("not a plain byte-level BPE file")
        ids, signs = model["vocab"], byte_signs()
        self.bytes = [ids[s] for s in signs]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((ids[a], ids[b]), len(self.made))
            self.made.append(ids[a + b])
        # for merges of many words: ranks by pairs of bytes and, sorted, by pairs of ids
        self.end = max(ids.values()) + 1  # no symbol, in no pair
        self.byte_ids = np.array(self.bytes, np.int64)
        self.made_ids = np.array(self.made, np.int64)
        self.byte_ranks = np.array([[self.ranks.get((a, b), NO_RANK) for b in self.bytes] for a in self.bytes], np.int32)
        pairs = sorted((a * (self.end + 1) + b, rank) for (a, b), rank in self.ranks.items())
        self.pairs = np.array([*(pair for pair, _ in pairs), np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([*(rank for _, rank in pairs), NO_RANK], np.int32)
        self.added = {t["content"]: t["id"] for t in added}
        value = {s: b for b, s in enumerate(signs)}
        self.texts = {i: bytes(map(value.__getitem__, t)) for t, i in ids.items() if set(t) <= value.keys()}
        self.texts |= {i: t.encode() for t, i in self.added.items()}

    def merged(self, word: bytes) -> list[int]:
        """The ids that the merges leave of a word."""
        ranks, made = self.ranks, self.made
        symbols = [self.bytes[b] for b in word]
        n = len(symbols)
        if n < 2:
            return symbols
        width = 1 << (n - 1).bit_length()
        leaves = [ranks.get(pair, NO_RANK) for pair in zip(symbols, symbols[1:])]
        tree = [NO_RANK] * width + leaves + [NO_RANK] * (width - n + 1)
        for i in range(width - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (rank := tree[1]) != NO_RANK:
            place = 1
            while place < width:
                place *= 2
                if tree[place] != rank:
                    place += 1
            a = place - width
            b = after[a]
            c, z = after[b], before[a]
            symbols[a] = one = made[rank]
            symbols[b] = -1
            after[a] = c
            # the pair of b is gone, those that end and begin at a are new
            changed = [(b, NO_RANK)]
            if c < n:
                before[c] = a
                changed.append((a, ranks.get((one, symbols[c]), NO_RANK)))
            else:
                changed.append((a, NO_RANK))
            if z >= 0:
                changed.append((z, ranks.get((symbols[z], one), NO_RANK)))
            for place, value in changed:
                place += width
                if tree[place] == value:
                    continue
                tree[place] = value
                while place > 1:
                    beside = tree[place ^ 1]
                    if beside < value:
                        value = beside
                    place >>= 1
                    if tree[place] == value:
                        break
                    tree[place] = value
        return [s for s in symbols if s >= 0]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left * (self.end + 1) + right
        found = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[found] == pairs, self.pair_ranks[found], NO_RANK)

    def merged_all(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids that the merges leave of each word, as bytes."""
        out, widths = [b""] * len(words), defaultdict(list)
        for i, word in enumerate(words):
            widths[1 << max(len(word) - 1, 0).bit_length()].append(i)
        for width, places in widths.items():
            if width > WIDEST_TOGETHER or len(places) < LEAST_TOGETHER:
                for i in places:
                    out[i] = np.array(self.merged(words[i]), np.int32).tobytes()
                continue
            for first in range(0, len(places), BLOCK_WORDS):
                block = places[first : first + BLOCK_WORDS]
                for i, ids in zip(block, self.merged_together([words[i] for i in block], width)):
                    out[i] = ids
        return out

    def merged_together(self, words: Sequence[bytes], width: int) -> list[bytes]:
        """As ``merged``, for words of at most ``width`` bytes: a round makes one
        merge in every word that has any left. Row by row, an array holds the
        trees of the words, others their symbols and the places around each."""
        n, height = len(words), width.bit_length() - 1
        data = np.frombuffer(b"".join(word.ljust(width, b"\0") for word in words), np.uint8).reshape(n, width)
        sizes = np.fromiter(map(len, words), np.int64, n)[:, None]
        places = np.arange(width + 1)
        symbols = np.full((n, width + 1), self.end)
        symbols[:, :-1] = np.where(places[:-1] < sizes, self.byte_ids[data], self.end)
        tree = np.full((n, 2 * width), NO_RANK, np.int32)
        tree[:, width:-1] = np.where(places[1:-1] < sizes, self.byte_ranks[data[:, :-1], data[:, 1:]], NO_RANK)
        for level in range(height - 1, -1, -1):
            i = 1 << level
            tree[:, i : 2 * i] = np.minimum(tree[:, 2 * i : 4 * i : 2], tree[:, 2 * i + 1 : 4 * i : 2])
        # the first symbol has itself before it
        after, before = np.tile(places + 1, n), np.tile(np.maximum(places - 1, 0), n)
        table, symbols, tree = symbols, symbols.reshape(-1), tree.reshape(-1)
        rows = np.arange(n)
        while len(rows):
            ranks = tree[rows * (2 * width) + 1]
            left = ranks != NO_RANK
            rows, ranks = rows[left], ranks[left]
            top, start = rows * (2 * width), rows * (width + 1)
            place = np.ones(len(rows), np.int64)
            for _ in range(height):
                place *= 2
                place += tree[top + place] != ranks
            a = place - width
            b, z = after[start + a], before[start + a]
            c = after[start + b]
            symbols[start + a] = one = self.made_ids[ranks]
            symbols[start + b] = self.end
            after[start + a], before[start + c] = c, a
            # the leaf of a is set after that of z, which may be the same
            tree[top + width + b] = NO_RANK
            tree[top + width + z] = self.ranks_of(symbols[start + z], one)
            tree[top + width + a] = self.ranks_of(one, symbols[start + c])
            place, top = np.concatenate([a, b, z]) + width, np.tile(top, 3)
            for _ in range(height):
                place >>= 1
                below = top + 2 * place
                tree[top + place] = np.minimum(tree[below], tree[below + 1])
        kept = table != self.end
        ids = table[kept].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [ids[i:j] for i, j in zip([0, *ends], ends)]


@lru_cache
def stand_ins(path: str) -> dict[int, str]:
    """The characters that the library classes unlike ``WORDS`` does, each with
    a sign of the class that the library gives it (letter, number or other).

    Characters from U+40000 on are private or not assigned in any edition.
    """
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(path).pre_tokenizer, regex.compile(WORDS)

    def probe(codes: range) -> tuple[str, list[int], list[int]]:
        text = "".join(f" a{chr(c)} 1{chr(c)}" for c in codes)
        return text, [m.start() for m in own.finditer(text)], [at[0] for _, at in library.pre_tokenize_str(text)]

    out = {}
    for first in range(0, 0x40000, 1024):
        if 0xD800 <= first < 0xE000:
            continue
        _, ours, theirs = probe(range(first, first + 1024))
        if ours == theirs:
            continue
        for c in range(first, first + 1024):
            _, ours, theirs = probe(range(c, c + 1))
            if ours != theirs:
                out[c] = "x" if 2 not in theirs else "1" if 5 not in theirs else "!"
    return out


class Encoder:
    """Encodes texts with a bounded memory of words."""

    def __init__(self, path: str, odd: dict[int, str]) -> None:
        self.vocabulary = Vocabulary(path)
        self.odd, self.odd_signs = odd, set(map(chr, odd))
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(WORDS).findall
        self.added = {name: np.array([i], np.int32).tobytes() for name, i in self.vocabulary.added.items()}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")").split

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(ids, np.int32) for run in text_runs(texts, RUN_SIZE) for ids in self.encode_run(run)]

    def encode_run(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, as bytes. Words that are not known are merged together."""
        known, odd = self.known, self.odd_signs
        texts = [self.cut(text) if any(name in text for name in self.added) else [text] for text in texts]
        parts = [part for text in texts for part in text[::2]]  # between them, added tokens
        done, open_parts = [b""] * len(parts), {}
        for i, part in enumerate(parts):
            words = self.split(part)
            ids = list(map(known.get, words))
            if all(ids):
                done[i] = b"".join(ids)
            else:
                open_parts[i] = words, ids
        fresh = {w for words, ids in open_parts.values() for w in compress(words, map(not_, ids))}
        passing = {w for w in fresh if not odd.isdisjoint(w)}
        if passing:
            # odd words are never known, so every part that has one is open
            for i, (words, _) in open_parts.items():
                if not passing.isdisjoint(words):
                    words = self.split_odd(parts[i])
                    open_parts[i] = words, list(map(known.get, words))
            fresh = {w for words, ids in open_parts.values() for w in compress(words, map(not_, ids))}
            passing = {w for w in fresh if not odd.isdisjoint(w)}
        passing.update(w for w in fresh if len(w) > REMEMBERED_LENGTH)
        new = list(fresh)
        known.update(zip(new, self.vocabulary.merged_all([w.encode() for w in new])))
        for i, (words, ids) in open_parts.items():
            done[i] = b"".join([x or known[w] for x, w in zip(ids, words)])
        for word in passing:
            del known[word]
        if len(known) > REMEMBERED:
            known.clear()
        plain = iter(done)
        return [b"".join([self.added[part] if i % 2 else next(plain) for i, part in enumerate(text)]) for text in texts]

    def split_odd(self, text: str) -> list[str]:
        at, out = 0, []
        for word in self.split(text.translate(self.odd)):
            out.append(text[at : at + len(word)])
            at += len(word)
        return out


class Decoder:
    def __init__(self, path: str) -> None:
        texts = Vocabulary(path).texts
        self.parts = [texts.get(i, b"") for i in range(max(texts) + 1)]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.parts.__getitem__, ids)).decode("utf-8", "replace")


def short_batches(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``RUN_SIZE`` by the sizes of its rows: what is
    made of a part is bounded, however much text a batch has."""
    runs = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // RUN_SIZE
    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
    for first, end in zip(cuts, cuts[1:]):
        yield batch.slice(first, end - first)


def encoded(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All columns and ``out_col``, the ids of the text."""
    rest = [c for c in docs.columns if c != out_col]
    rows = docs.select(*rest, F.col(text_col).cast("string").alias(out_col))
    schema = docs.select(*rest, F.lit(None).cast("array<int>").alias(out_col)).schema
    odd = stand_ins(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or worker_memory(f"byte pairs {vocabulary}", lambda: Encoder(vocabulary, odd))
            for part in short_batches(batch, pc.binary_length(batch.column(batch.num_columns - 1))):
                found = encoder.encode(part.column(part.num_columns - 1).to_pylist())
                sizes = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=part.schema.names)

    return rows.mapInArrow(run, schema)


def decoded(rows: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and ``out_col``, the text of the ids."""
    rest = [c for c in rows.columns if c != out_col]
    place = rest.index(ids_col)
    schema = rows.select(*rest, F.lit(None).cast("string").alias(out_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or worker_memory(f"byte texts {vocabulary}", lambda: Decoder(vocabulary))
            for part in short_batches(batch, pc.list_value_length(batch.column(place))):
                texts = [decoder.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return rows.select(*rest).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of every whole text and of what they decode to."""
    vocabulary = default_vocabulary()
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ids = encoded(docs, vocabulary).select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
    )
    return decoded(ids, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op13_byte_pairs": op13_byte_pairs}
ORACLES: dict[str, str] = {}
