"""WARC records in ZIP packages, written and range-read by Spark tasks.

A package is a ZIP file with two stored (not compressed) members:
``archive/data.warc.gz``, one gzip stream per record, and ``indexes/index.cdx``,
one line per record with its place in the archive member. The reader parses the
end record, the ZIP64 records and the central directory, finds the place of the
stored members and their index, and reads byte ranges of them; nothing is
extracted and no package is read whole. Packages of other writers are read as
well: archive members are those below ``archive/``, records in gzip streams or
plain; indexes are lines of three columns, CDX with a header line, or CDXJ, and
name the member they are about. Members that no index names are scanned record
by record.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
smallest id is a response and the others are revisits that carry its id and
digest but no payload.

Files are written by tasks below a shared folder under names of their own; the
table of packages that the committed tasks returned says which files count, so
a lost or repeated task leaves an unused file and nothing else.

Defined cases: null payload is empty; a null URL gives a record without target;
control characters and blanks in a URL are percent-encoded; a row with a null id
is a record without id, read back as null; rows with equal id and payload are
all responses if the id is the smallest. An empty table gives no package.
Compressed archive members cannot be range-read: they are listed, and reading
them is an error. A record id that is not one of ours gives a null ``record_id``;
``record_uri`` has every id as it is.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.llm.tables import Layout, fresh_name, join_hot, open_store, shared_folder, stored, text_bytes

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# A package is closed beyond this size; bounds a writer's index and a file.
PACKAGE_BYTES = 1 << 30
# Ranges closer than this are read at once.
READ_BYTES = 8 << 20
ID_PREFIX = "urn:record:"

# Fixed values of the ZIP format (signatures and layouts).
LOCAL = Layout("<4sHHHHHIIIHH")
CENTRAL = Layout("<4sHHHHHHIIIHHHHHII")
END = Layout("<4sHHHHIIH")
END64 = Layout("<4sQHHIIQQQQ")
LOCATOR64 = Layout("<4sIQI")
DESCRIPTOR64 = Layout("<4sIQQ")
DOS_DATE = 0x21  # 1980-01-01
GZIP = b"\x1f\x8b"


class PackageWriter:
    """Writes stored members one after the other; sizes follow each member."""

    def __init__(self, out) -> None:
        self.out, self.at, self.members = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc = name.encode(), self.at, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(LOCAL.pack(b"PK\3\4", 45, 0x0808, 0, 0, DOS_DATE, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), len(extra)))
        self.write(self.name + extra)
        self.data_at = self.at

    def append(self, data: bytes) -> int:
        """Add to the open member; the offset inside the member."""
        place = self.at - self.data_at
        self.crc = zlib.crc32(data, self.crc)
        self.write(data)
        return place

    def end(self) -> None:
        size = self.at - self.data_at
        self.write(DESCRIPTOR64.pack(b"PK\7\x08", self.crc, size, size))
        self.members.append((self.name, self.crc, size, self.start))

    def close(self) -> None:
        """The central directory, always with its ZIP64 form beside it."""
        start = self.at
        for name, crc, size, offset in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self.write(
                CENTRAL.pack(b"PK\1\2", 45, 45, 0x0808, 0, 0, DOS_DATE, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
                + name + extra
            )
        size, n, end = self.at - start, len(self.members), self.at
        self.write(END64.pack(b"PK\6\6", END64.size - 12, 45, 45, 0, 0, n, n, size, start))
        self.write(LOCATOR64.pack(b"PK\6\7", 0, end, 1))
        self.write(END.pack(b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), 0xFFFFFFFF, 0))


def central_directory(read_at, size: int) -> list[dict]:
    """The members of a package; ``read_at(offset, length)`` gives bytes."""
    tail_at = max(0, size - END.size - 0xFFFF)
    tail = read_at(tail_at, size - tail_at)
    place = tail.rfind(b"PK\5\6")
    while place >= 0:
        end = END.unpack_from(tail, place) if place + END.size <= len(tail) else None
        if end and place + END.size + end[7] <= len(tail):
            break
        place = tail.rfind(b"PK\5\6", 0, place)
    if place < 0:
        raise ValueError("not a ZIP package: no end record")
    n, length, start = end[4], end[5], end[6]
    locator_at = tail_at + place - LOCATOR64.size
    if locator_at >= 0:
        locator = LOCATOR64.unpack(read_at(locator_at, LOCATOR64.size))
        if locator[0] == b"PK\6\7":
            end64 = END64.unpack(read_at(locator[2], END64.size))
            if end64[0] != b"PK\6\6":
                raise ValueError("ZIP64 end record not found")
            n, length, start = end64[7], end64[8], end64[9]
    data, at, members = read_at(start, length), 0, []
    for _ in range(n):
        head = CENTRAL.unpack_from(data, at)
        if head[0] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method, crc, packed, plain, offset = head[4], head[7], head[8], head[9], head[16]
        at += CENTRAL.size
        name = data[at : at + head[10]].decode("utf-8", "replace")
        extra = data[at + head[10] : at + head[10] + head[11]]
        at += head[10] + head[11] + head[12]
        while len(extra) >= 4:
            kind, n_bytes = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values, only of the fields that overflow
                wide = list(struct.unpack_from(f"<{n_bytes // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n_bytes :]
        members.append({"name": name, "stored": method == 0, "crc": crc, "size": packed, "header_at": offset})
    return members


def data_start(read_at, header_at: int) -> int:
    """Where a member's bytes begin: names and extras of the local header may
    differ from those in the directory."""
    head = LOCAL.unpack(read_at(header_at, LOCAL.size))
    if head[0] != b"PK\3\4":
        raise ValueError("damaged local header")
    return header_at + LOCAL.size + head[9] + head[10]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_uri(url: str) -> str:
    return "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) if b < 0x7F else f"%{b:02X}" for b in url.encode())


def record_bytes(record_id, url, payload: bytes, digest: str, refers_to, refers: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Date: {date}"]
    if record_id is not None:
        lines.append(f"WARC-Record-ID: <{ID_PREFIX}{record_id}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields (lower case) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    if not fields.get("content-type", "").startswith("application/http"):
        return {"fields": fields, "payload": block, "payload_bytes": len(block)}
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x[15:]) for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:"), len(payload))
    return {"fields": fields, "payload": payload, "payload_bytes": length}


def read_uri(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_id(value: str | None) -> int | None:
    """The number of a record of ours; null for ids of other writers."""
    uri = read_uri(value) or ""
    number = uri.removeprefix(ID_PREFIX)
    return int(number) if uri.startswith(ID_PREFIX) and number.lstrip("-").isdigit() else None


def revisit_targets(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(id, digest256, refers_to) of the rows that become revisits.

    Works on ids and digests only. Equal payloads are grouped by SHA-256;
    the smallest id of each group comes from partial aggregates, so a payload
    with very many copies is one row per task.
    """
    keys = pages.select("id", F.sha2(F.col("payload"), 256).alias("digest256"), F.octet_length("payload").alias("size"))
    keys = stored(keys.filter(F.col("size") >= min_bytes).drop("size"), "payload-keys")
    firsts = keys.groupBy("digest256").agg(F.min("id").alias("refers_to"), F.count("*").alias("copies"))
    firsts = stored(firsts.filter("copies > 1 AND refers_to IS NOT NULL"), "payload-firsts")
    found = join_hot(keys, firsts, ["digest256"], "copies", keys.count(), "inner")
    return found.filter(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "digest256", "refers_to").distinct()


def write_packages(
    pages: DataFrame, folder: str, id_col: str, url_col: str, text_col: str, min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write all rows as records; returns (path, size, records) per package."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    targets = revisit_targets(rows, min_bytes)
    rows = rows.withColumn("__digest", F.sha2("payload", 256))
    rows = rows.join(
        targets.withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("digest256")), "left"
    ).select("id", "url", "payload", "refers_to", F.col("refers_to").isNotNull().alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None

        def opened():
            fs, base = open_store(folder)
            fs.create_dir(base, recursive=True)
            name = fresh_name("package", ".wacz")
            writer = PackageWriter(fs.open_output_stream(f"{base}/{name}"))
            writer.begin(ARCHIVE)
            return writer, f"{folder}/{name}", []

        def closed(writer, path, index) -> pa.RecordBatch:
            writer.end()
            writer.begin(INDEX)
            for i in range(0, len(index), 10_000):
                writer.append(b"".join(index[i : i + 10_000]))
            writer.end()
            writer.close()
            writer.out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "size": [writer.at], "records": [len(index)]})

        for batch in batches:
            ids, urls, refs, marks = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, payload in enumerate(text_bytes(batch.column(2))):
                if writer is None:
                    writer, path, index = opened()
                digest = base32_sha1(payload)
                record = record_bytes(ids[i], urls[i], payload, digest, refs[i], marks[i], date)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = packer.compress(record) + packer.flush()
                at = writer.append(packed)
                index.append(f"{'-' if ids[i] is None else ids[i]} {at} {len(packed)}\n".encode())
                if writer.at >= package_bytes:
                    yield closed(writer, path, index)
                    writer = None
        if writer is not None:
            yield closed(writer, path, index)

    return rows.mapInArrow(run, "path string, size bigint, records bigint")


def _reader(path: str):
    fs, place = open_store(path)
    file = fs.open_input_file(place)
    return (lambda offset, length: file.read_at(length, offset)), file


def list_members(packages: DataFrame) -> DataFrame:
    """(path, member, stored, size) of every member of the packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                read_at, file = _reader(path)
                with file:
                    found = central_directory(read_at, size)
                yield pa.RecordBatch.from_pylist(
                    [{"path": path, "member": m["name"], "stored": m["stored"], "size": m["size"]} for m in found],
                    pa.schema([("path", pa.string()), ("member", pa.string()), ("stored", pa.bool_()), ("size", pa.int64())]),
                )

    return packages.select("path", "size").mapInArrow(run, "path string, member string, stored boolean, size bigint")


def locate_records(packages: DataFrame) -> DataFrame:
    """(path, at, length): the byte range of every record in its package.

    From the index members where they name the archive member. Otherwise it is
    scanned: the end of a gzip stream is found by inflating, that of a plain
    record by its length.
    """
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                read_at, file = _reader(path)
                with file:
                    members = {m["name"]: m for m in central_directory(read_at, size)}
                    held: list[tuple] = []
                    for at, length in record_spans(path, read_at, members):
                        held.append((path, at, length))
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], schema=schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], schema=schema)

    return packages.select("path", "size").mapInArrow(run, "path string, at bigint, length bigint")


def pieces(read_at, start: int, size: int) -> Iterator[bytes]:
    for at in range(0, size, READ_BYTES):
        yield read_at(start + at, min(READ_BYTES, size - at))


def record_spans(path: str, read_at, members: dict[str, dict]) -> Iterator[tuple[int, int]]:
    """(place in the package, length) of all records of the archive members."""
    archives = {n: m for n, m in members.items() if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))}
    bases = {}
    for name, member in archives.items():
        if not member["stored"]:
            raise ValueError(f"{path}: {name} is compressed and cannot be range-read")
        bases[name] = data_start(read_at, member["header_at"])
    known = set()
    for name, member in members.items():
        if name.startswith("indexes/") and member["stored"] and name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            for about, at, length in indexed(read_at, member):
                target = about or ARCHIVE
                if target in bases:
                    known.add(target)
                    yield bases[target] + at, length
    for name, base in bases.items():
        if name not in known:
            scan = scanned if read_at(base, 2) == GZIP else scanned_plain
            for at, length in scan(read_at, base, archives[name]["size"]):
                yield base + at, length


def indexed(read_at, member: dict) -> Iterator[tuple[str | None, int, int]]:
    """(archive member or None, place, length) of the lines of an index: CDXJ,
    CDX whose header names its columns, or our three columns."""
    start = data_start(read_at, member["header_at"])
    parts = pieces(read_at, start, member["size"])
    if member["name"].endswith(".gz"):
        parts = inflated(parts)
    columns, rest = None, b""
    for part in parts:
        *lines, rest = (rest + part).split(b"\n")
        for line in lines:
            if line.strip().startswith(b"CDX "):
                columns = line.split()[1:]
            elif line.strip():
                yield index_entry(line, columns)
    if rest.strip():
        yield index_entry(rest, columns)


def index_entry(line: bytes, columns: list[bytes] | None) -> tuple[str | None, int, int]:
    if b"{" in line:
        entry = json.loads(line[line.index(b"{") :])
        return "archive/" + entry["filename"].rsplit("/", 1)[-1], int(entry["offset"]), int(entry["length"])
    cells = line.split()
    if columns is None:
        return None, int(cells[1]), int(cells[2])
    # S is the length of a record, V its place, g its file
    size, at, file = (cells[columns.index(c)] for c in (b"S", b"V", b"g"))
    return "archive/" + file.decode().rsplit("/", 1)[-1], int(at), int(size)


def inflated(parts: Iterator[bytes]) -> Iterator[bytes]:
    packer = zlib.decompressobj(31)
    for part in parts:
        while part:
            yield packer.decompress(part)
            part = packer.unused_data
            if packer.eof:
                packer = zlib.decompressobj(31)


def scanned_plain(read_at, base: int, size: int) -> Iterator[tuple[int, int]]:
    """Records that are not compressed: a header, and as many bytes as it says."""
    at = 0
    while at < size:
        head, step = b"", 4096
        while (end := head.find(b"\r\n\r\n")) < 0:
            more = read_at(base + at + len(head), min(step, size - at - len(head)))
            if not more:
                return
            head += more
        lines = head[:end].lower().split(b"\r\n")
        length = next((int(x.partition(b":")[2]) for x in lines if x.startswith(b"content-length:")), 0)
        yield at, end + 4 + length
        at += end + 4 + length
        while at < size and read_at(base + at, 2) == b"\r\n":
            at += 2


def scanned(read_at, base: int, size: int) -> Iterator[tuple[int, int]]:
    packer, start, seen = zlib.decompressobj(31), 0, 0
    for part in pieces(read_at, base, size):
        while part:
            packer.decompress(part)
            used = len(part) - len(packer.unused_data)
            seen += used
            part = packer.unused_data
            if packer.eof:
                yield start, seen - start
                start, packer = seen, zlib.decompressobj(31)


def read_records(places: DataFrame) -> DataFrame:
    """Range-read and parse records; one row per record."""
    schema = pa.schema(
        [("record_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()),
         ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("record_uri", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read_at, file = None, None, None
        for batch in batches:
            spans = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            rows, i = [], 0
            while i < len(spans):
                if spans[i][0] != path:
                    if file is not None:
                        file.close()
                    path = spans[i][0]
                    read_at, file = _reader(path)
                # neighbouring records are fetched together
                j, start = i, spans[i][1]
                end = start
                while j < len(spans) and spans[j][0] == path and spans[j][1] == end and (end - start < READ_BYTES or j == i):
                    end += spans[j][2]
                    j += 1
                data = memoryview(read_at(start, end - start))
                for _, at, length in spans[i:j]:
                    packed = bytes(data[at - start : at - start + length])
                    rows.append(row_of(parse_record(zlib.decompress(packed, 31) if packed[:2] == GZIP else packed)))
                i = j
                if sum(len(r["payload"]) for r in rows) > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)
        if file is not None:
            file.close()

    ddl = (
        "record_id bigint, record_type string, target_uri string, refers_to bigint, payload_digest string, "
        "payload_bytes bigint, payload binary, record_uri string"
    )
    return places.select("path", "at", "length").mapInArrow(run, ddl)


def row_of(record: dict) -> dict:
    fields = record["fields"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields.get("warc-type") == "revisit"
    # other writers digest other things, by other functions
    ours = (read_uri(fields.get("warc-record-id")) or ID_PREFIX).startswith(ID_PREFIX)
    if ours and not revisit and base32_sha1(record["payload"]) != digest:
        raise ValueError(f"digest of {fields.get('warc-record-id')} does not match its payload")
    return {
        "record_id": read_id(fields.get("warc-record-id")), "record_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"), "refers_to": read_id(fields.get("warc-refers-to")),
        "payload_digest": digest, "payload_bytes": record["payload_bytes"], "payload": record["payload"],
        "record_uri": read_uri(fields.get("warc-record-id")),
    }


def op1_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_folder(spark, "packages")
    packages = stored(write_packages(pages, folder, "page_id", "url", "html"), "package-list")
    # record places are dealt over the cluster: a package is not one task
    places = locate_records(packages.repartition(max(1, packages.count())))
    parts = max(1, spark.sparkContext.defaultParallelism * 2)
    records = read_records(places.repartitionByRange(parts, "path", "at").sortWithinPartitions("path", "at"))
    return records.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"
    )


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
QUERIES = {"op1_warc_packages": op1_warc_packages}
ORACLES = {
    # target_uri is percent-encoded; the given URLs need no encoding
    "op1_warc_packages": f"""
        SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 +
                   ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS INTEGER) // CAST(power(32, 3 - i % 4) AS INTEGER)) % 32), 1)), '') AS payload_digest,
               CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> f THEN f END AS refers_to, url AS target_uri
        FROM (SELECT page_id, url, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h,
                     min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
    """
}
