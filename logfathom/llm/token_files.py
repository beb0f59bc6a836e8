"""Token ids in bit-packed files with block offsets.

File layout (little endian):

    head: magic, version, bits per id, ids per block, vocabulary size
    blocks: ``ids per block`` ids each, packed with ``bits`` bits, least
        significant bit first; a block ends at a byte
    table of blocks: offset of each block in the file (64 bits each)
    table of documents: id (64 bits), first id in the file (64 bits), one mark
        per document that has a null id
    tail: the head again, now with the numbers of ids and documents, and the
        offsets of both tables

``bits`` is the least number that holds every id of the vocabulary. A block is
unpacked by numpy in one go, and a range of ids needs its own blocks only.

Documents are ordered by id over all files: rows are dealt by ranges of the id,
each task writes its range, and the table of files gives the number of ids
before each file. Files are written below a shared folder under names of their
own; only those named in the table count.

Defined cases: null text is empty and has the end id only. Null document ids
come first. Rows with equal ids are ordered by text; repeated rows are written
each. An empty table gives no file.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfathom.llm.tables import Layout, documents, fresh_name, open_store, shared_folder, stored, text_runs, worker_memory

HEAD = Layout("<4sHHIQQI")
TAIL = Layout("<QQ4s")
MAGIC = b"LFBP"
BLOCK_IDS = 8192
# A file is closed beyond so many ids; bounds a writer's tables.
FILE_IDS = 200_000_000
# Ids a reading task handles at once.
READ_IDS = 2_000_000
REMEMBERED = 600_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits per id, one after the other."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    wide = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(wide.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class TokenFileWriter:
    def __init__(self, out, vocabulary: int, block: int = BLOCK_IDS) -> None:
        self.out, self.vocabulary, self.bits, self.block = out, vocabulary, bits_for(vocabulary), block
        self.held, self.n_held, self.n, self.offsets, self.docs = [], 0, 0, [], []
        self.at = 0
        self._write(HEAD.pack(MAGIC, 1, self.bits, block, 0, 0, vocabulary))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, stop, self.block):
            self.offsets.append(self.at)
            self._write(pack(ids[i : min(i + self.block, stop)], self.bits))
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        blocks_at = self.at
        self._write(np.array(self.offsets, "<u8").tobytes())
        docs_at = self.at
        self._write(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self._write(np.array([s for _, s in self.docs], "<u8").tobytes())
        self._write(np.array([d is None for d, _ in self.docs], np.uint8).tobytes())
        # streams cannot go back, so the counts stand before the tail
        self._write(HEAD.pack(MAGIC, 1, self.bits, self.block, self.n, len(self.docs), self.vocabulary))
        self._write(TAIL.pack(blocks_at, docs_at, MAGIC))
        self.out.close()


class TokenFile:
    """Random access to one file; ``file`` has ``read_at`` and ``size``."""

    def __init__(self, file) -> None:
        self.file, end = file, file.size()
        tail = file.read_at(HEAD.size + TAIL.size, end - HEAD.size - TAIL.size)
        magic, _, self.bits, self.block, self.n, self.n_docs, self.vocabulary = HEAD.unpack_from(tail)
        self.blocks_at, self.docs_at, again = TAIL.unpack_from(tail, HEAD.size)
        if magic != MAGIC or again != MAGIC:
            raise ValueError("not a token file")

    def doc_range(self, first: int, count: int) -> tuple[list, np.ndarray]:
        """Document ids, and where their tokens start (one more entry: the end)."""
        ids = np.frombuffer(self.file.read_at(8 * count, self.docs_at + 8 * first), "<i8")
        more = min(count + 1, self.n_docs - first)
        at = self.docs_at + 8 * self.n_docs
        starts = np.frombuffer(self.file.read_at(8 * more, at + 8 * first), "<u8").astype(np.int64)
        nulls = np.frombuffer(self.file.read_at(count, at + 8 * self.n_docs + first), np.uint8)
        if more == count:
            starts = np.append(starts, self.n)
        return [None if gone else int(d) for d, gone in zip(ids, nulls)], starts

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Token ids ``start`` to ``stop``, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        offsets = np.frombuffer(self.file.read_at(8 * (last - first + 1), self.blocks_at + 8 * first), "<u8").astype(np.int64)
        whole = (self.block * self.bits + 7) // 8
        size = int(offsets[-1] - offsets[0]) + min(whole, self.blocks_at - int(offsets[-1]))
        data = memoryview(self.file.read_at(size, int(offsets[0])))
        parts = []
        for i, at in enumerate(offsets - offsets[0]):
            n = min(self.block, self.n - (first + i) * self.block)
            parts.append(unpack(data[int(at) : int(at) + (n * self.bits + 7) // 8], n, self.bits))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


# The pre-tokens of the tokenizer in texts of Latin-1 characters, lower-cased:
# contractions, letters, single numbers, the rest but blanks.
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
PRE_TOKENS = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\x09-\\x0D\\x20{LETTERS}{NUMBERS}]+"
JOINED = 1000
# Texts with other characters, or that may hold special tokens, are cut at ASCII
# blanks only.
UNUSUAL = r"[^\x09-\x0D\x20-\x7E\xA1-\xFF]|<\|"


class WordEncoder:
    """Encodes whole texts from the ids of their pre-tokens, with a bounded
    memory of them; what is not remembered is encoded by the library.

    Exact for tokenizers that lower-case, drop white space and split as
    ``PRE_TOKENS`` says; with ``whole`` texts are handed over as they are.
    """

    def __init__(self, path: str, whole: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.whole, self.known = Tokenizer.from_file(path), whole, {}
        self.words = re.compile(r"[^\x20\x09-\x0D]+").findall
        self.mixed = lambda part: self.unusual(part) or len(self.parts(part)) != 1
        self.parts, self.unusual = re.compile(PRE_TOKENS).findall, re.compile(UNUSUAL).search

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for run in text_runs(texts):
            if self.whole:
                for found in self.tokenizer.encode_batch_fast(run, add_special_tokens=False):
                    yield np.array(found.ids, np.uint32)
            else:
                yield from self.encode_run(run)

    def encode_run(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        cut = [self.words(t) if self.unusual(t) else self.parts(t.lower()) for t in texts]
        new = list({w for ws in cut for w in ws if w not in known})
        for i in range(0, len(new), JOINED):
            self.learn(new[i : i + JOINED])
        for ws in cut:
            yield np.frombuffer(b"".join(map(known.__getitem__, ws)), np.uint32)


    def learn(self, parts: list[str]) -> None:
        """Encode parts side by side; the library says whose each id is. Parts
        that are more than one pre-token are encoded one by one."""
        found = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        ids, owner = np.array(found.ids, np.uint32).tobytes(), found.word_ids
        if owner and owner[-1] == len(parts) - 1 and None not in owner and not any(map(self.mixed, parts)):
            cuts = np.searchsorted(np.array(owner), np.arange(len(parts) + 1)) * 4
            self.known.update((p, ids[a:b]) for p, a, b in zip(parts, cuts[:-1].tolist(), cuts[1:].tolist()))
            return
        for part, one in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            self.known[part] = np.array(one.ids, np.uint32).tobytes()


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    whole: bool = False,
) -> DataFrame:
    """Encode and write all rows in order of the id; the table of files
    (path, first_id, n_docs, n_ids)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(1, rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, path, first = None, None, None, None
        end = np.array([end_id], np.uint32)

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pylist(
                [{"path": path, "first_id": first, "n_docs": len(writer.docs), "n_ids": writer.n}],
                pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        for batch in batches:
            encoder = encoder or worker_memory(f"words {tokenizer} {whole}", lambda: WordEncoder(tokenizer, whole))
            for one, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                if writer is None:
                    fs, base = open_store(folder)
                    fs.create_dir(base, recursive=True)
                    name, first = fresh_name("tokens", ".lfbp"), one
                    writer = TokenFileWriter(fs.open_output_stream(f"{base}/{name}"), encoder.tokenizer.get_vocab_size())
                    path = f"{folder}/{name}"
                writer.add(one, np.concatenate((ids, end)))
                if writer.n >= FILE_IDS:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return dealt.mapInArrow(run, "path string, first_id bigint, n_docs bigint, n_ids bigint")


def with_starts(files: DataFrame) -> DataFrame:
    """Add ``start``: the number of ids in all files before. One row per file."""
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_documents(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files.

    A file is dealt out in ranges of documents, so a large one is many tasks.
    """
    step = F.greatest(F.lit(1), F.floor(F.col("n_docs") * READ_IDS / F.greatest(F.lit(1), F.col("n_ids")))).cast("bigint")
    ranges = files.withColumn("step", step).select(
        "path", "start", "n_docs", "step",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1, F.col("step"))).alias("first"),
    )
    ranges = ranges.select("path", "start", "first", F.least("step", F.col("n_docs") - F.col("first")).alias("count"))
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, first, count in zip(*(c.to_pylist() for c in batch.columns)):
                fs, place = open_store(path)
                with fs.open_input_file(place) as opened:
                    file = TokenFile(opened)
                    docs, starts = file.doc_range(first, count)
                    # documents are read in runs of bounded size; one may be long
                    i = 0
                    while i < count:
                        j = i + 1
                        while j < count and starts[j + 1] - starts[i] <= READ_IDS:
                            j += 1
                        ids = file.ids(int(starts[i]), int(starts[j])).astype("<u4")
                        cuts = starts[i : j + 1] - starts[i]
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs[i:j], pa.int64()), pa.array(base + starts[i:j]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())],
                            schema=schema,
                        )
                        i = j

    parts = max(1, files.sparkSession.sparkContext.defaultParallelism * 2)
    dealt = ranges.repartition(parts, "path", "first")
    return dealt.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    files = stored(
        write_tokens(documents(spark, sf_dir), folder, str(public_tokenizers.path("word_bpe_49k.json")), end_id=1), "token-files"
    )
    return read_documents(stored(with_starts(files), "token-starts")).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}
