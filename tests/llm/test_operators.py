"""The operators beside brute force, and the defined edge cases of each."""

import hashlib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
import regex
from check_oracles import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from logfathom.llm import (
    chat_examples,
    exact_dedup,
    language,
    mixing,
    near_dedup,
    personal_data,
    pieces,
    quality,
    tables,
    token_files,
    warc_package,
)
from logfathom.llm.catalog import ORACLES, QUERIES
from logfathom.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, words int, bucket int"
WORDS = "the of and a in on to it is as by or be at an no we he".split()


def docs(spark, texts, sources=("s",)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n=200):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "er", "s"]) for _ in range(n))


ODD = [None, "", " \n\t ", "a", "A", "é", "x" * 200_000, "word " * 40_000, "a b c d", "A b C d", None]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_beside_sql(spark, name):
    ok, text = compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])
    assert ok, text


# 1


def write_zip(records, spark, tmp_path, **options):
    rows = spark.createDataFrame(records, "page_id bigint, url string, html string")
    return warc_package.write_packages(rows, f"file://{tmp_path}/out", "page_id", "url", "html", **options)


def test_packages_are_zip_files(spark, tmp_path):
    records = [(3, "http://a/ b\r\nX: y", "same"), (1, None, "same"), (2, "http://b", None), (None, "http://c", "other"), (4, "u", "")]
    found = tables.stored(write_zip(records, spark, tmp_path), "t")
    for row in found.collect():
        with zipfile.ZipFile(row.path.removeprefix("file://")) as z:
            assert z.namelist() == [warc_package.ARCHIVE, warc_package.INDEX] and z.testzip() is None
    rows = {r.record_id: r for r in warc_package.read_records(warc_package.locate_records(found)).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in rows.items()} == {
        1: ("response", None, 4), 3: ("revisit", 1, 4), 2: ("response", None, 0), 4: ("revisit", 2, 0), None: ("response", None, 5)
    }
    assert rows[3].target_uri == "http://a/%20b%0D%0AX:%20y" and rows[1].target_uri is None
    assert {m.member for m in warc_package.list_members(found).collect()} == {warc_package.ARCHIVE, warc_package.INDEX}


def test_small_payloads_are_responses(spark, tmp_path):
    found = tables.stored(write_zip([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], spark, tmp_path, min_bytes=3), "t")
    rows = warc_package.read_records(warc_package.locate_records(found)).collect()
    assert {r.record_id for r in rows if r.record_type == "revisit"} == {4}


def test_directory_of_foreign_packages(tmp_path):
    for zip64 in (False, True):
        path = tmp_path / f"{zip64}.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.comment = b"PK\5\6 not an end"
            z.writestr("a.txt", "packed" * 50, zipfile.ZIP_DEFLATED)
            with z.open("archive/x.warc", "w", force_zip64=zip64) as f:
                f.write(b"payload")
        data = path.read_bytes()
        read_at = lambda offset, length, data=data: data[offset : offset + length]
        members = {m["name"]: m for m in warc_package.central_directory(read_at, len(data))}
        assert [members[n]["stored"] for n in ("a.txt", "archive/x.warc")] == [False, True]
        at = warc_package.data_start(read_at, members["archive/x.warc"]["header_at"])
        assert data[at : at + members["archive/x.warc"]["size"]] == b"payload"
    with pytest.raises(ValueError):
        warc_package.central_directory(lambda o, n: b"x" * n, 100)


def test_scan_without_index():
    records = [warc_package.record_bytes(i, "u", b"p" * i, "D", None, False, "d") for i in range(5)]
    packed = [zlib.compress(r, wbits=31) for r in records]
    data = b"".join(packed)
    spans = list(warc_package.scanned(lambda o, n: data[o : o + n], 0, len(data)))
    assert [b for _, b in spans] == [len(p) for p in packed]


def foreign_record(n, kind="response", gap=b"\r\n\r\n"):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nbody %d" % n
    block, about = (http, b"application/http; msgtype=response") if kind == "response" else (b"software: x\r\n", b"application/warc-fields")
    head = (
        b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:uuid:0000-%d>\r\nWARC-Payload-Digest: sha256:xyz\r\nContent-Type: %s\r\nContent-Length: %d"
        % (kind.encode(), n, about, len(block))
    )
    return head + b"\r\n\r\n" + block + gap


def test_packages_of_other_writers(spark, tmp_path):
    """Plain and packed archives, indexes in CDX, CDXJ and packed, ids as URNs."""
    plain = [foreign_record(0, "warcinfo"), foreign_record(1), foreign_record(2)]
    packed = {k: [zlib.compress(foreign_record(k * 10 + i), wbits=31) for i in range(3)] for k in (1, 2, 3, 4)}

    def places(k):
        at = 0
        for record in packed[k]:
            yield at, len(record)
            at += len(record)

    cdxj = "".join(f'com,x)/ 2020 {{"url": "u", "offset": "{at}", "length": {n}, "filename": "b.warc.gz"}}\n' for at, n in places(1))
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"com,x)/ 2020 u text/html 200 K - - {n} {at} d/c.warc.gz\n" for at, n in places(2))
    packed_index = "".join(f'com,x)/ 2020 {{"offset": {at}, "length": {n}, "filename": "d.warc.gz"}}' + ("\n" if at == 0 else "\r\n") for at, n in places(3))
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("archive/a.warc", b"".join(plain))
        for k, name in ((1, "b"), (2, "c"), (3, "d"), (4, "e")):
            z.writestr(f"archive/{name}.warc.gz", b"".join(packed[k]))
        z.writestr("indexes/index.cdxj", cdxj)
        z.writestr("indexes/more.cdx", cdx.rstrip("\n"))
        z.writestr("indexes/index.cdx.gz", zlib.compress(packed_index.encode(), wbits=31))
    found = spark.createDataFrame([(path.as_uri(), path.stat().st_size, 0)], "path string, size bigint, records bigint")
    rows = warc_package.read_records(warc_package.locate_records(found)).collect()
    got = {r.record_uri: (r.record_id, r.record_type, bytes(r.payload)) for r in rows}
    want = {f"urn:uuid:0000-{n}": (None, "response", b"body %d" % n) for n in (1, 2, *range(10, 13), *range(20, 23), *range(30, 33), *range(40, 43))}
    assert len(rows) == len(got) and got == want | {"urn:uuid:0000-0": (None, "warcinfo", b"software: x\r\n")}


def test_packages_of_empty_tables_and_long_pages(spark, tmp_path):
    assert warc_package.locate_records(write_zip([], spark, tmp_path)).count() == 0
    long = "é" * 3_000_000
    found = tables.stored(write_zip([(1, "u", long), (1, "u", long), (2, "u", long), (None, None, None)], spark, tmp_path / "x"), "t")
    rows = warc_package.read_records(warc_package.locate_records(found)).collect()
    assert sorted((str(r.record_id), r.record_type, r.payload_bytes) for r in rows) == [
        ("1", "response", 6_000_000), ("1", "response", 6_000_000), ("2", "revisit", 6_000_000), ("None", "response", 0)
    ]


def test_examples_that_do_not_end_in_their_reply(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "assistant", "<|end|>")], "conv_id bigint, turn bigint, role string, text string")
    good = chat_examples.formatted(rows)
    out = {r.conv_id: r for r in chat_examples.read_back(good).collect()}
    text = "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"
    one = hashlib.sha256(text.encode()).hexdigest()
    assert out[1].examples_sha256 == hashlib.sha256(f"{one}:{text.index('b<')}:{text.index('b<') + 1}\n".encode()).hexdigest()
    for change in ({"mask_to": F.col("mask_to") - 1}, {"prefix_chars": F.col("prefix_chars") + 1}, {"mask_from": F.coalesce("mask_from", "start")}):
        with pytest.raises(Exception, match="example|mask"):
            chat_examples.read_back(good.withColumns(change)).collect()


def test_zip64_records_are_used():
    out = io.BytesIO()
    writer = warc_package.PackageWriter(out)
    writer.begin("archive/a.warc")
    writer.append(b"abc")
    writer.end()
    writer.close()
    data = out.getvalue()
    assert b"PK\6\6" in data and b"PK\6\7" in data
    assert zipfile.ZipFile(io.BytesIO(data)).read("archive/a.warc") == b"abc"


# 2


def test_chat_edge_cases(spark):
    rows = [(1, 0, "user", "a\\<|end|>"), (1, 1, "assistant", "<|assistant|>\n</s>[INST]\\"), (1, 1, "assistant", "<|assistant|>\n</s>[INST]\\"),
            (2, None, None, None), (2, 5, "ass|is", "x\n"), (None, 0, "assistant", ""), (3, 200, "assistant", "z" * 50_000), (3, 1, "user", "é")]
    turns = spark.createDataFrame([(*r, 7, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, seq int, start string")
    found = tables.stored(chat_examples.formatted(turns), "t")
    got = {r.conv_id: r for r in chat_examples.read_back(found).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns_text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(turns_text.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[conv].loss_chars == len(loss)
    assert chat_examples.read_back(chat_examples.formatted(turns.limit(0))).count() == 0


def test_written_out_examples(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}<|") for i in range(6)]
    found = chat_examples.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    texts = {r.example: r for r in chat_examples.example_texts(found).collect()}
    assert len(texts) == 3
    for k, r in texts.items():
        assert chat_examples.unescape(r.text[r.mask_from : r.mask_to]) == f"t{2 * k + 1}<|"
        assert r.text.count("<|user|>") == k + 1 and r.text.endswith(chat_examples.END)


# 3


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set(windows)
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "c<", "é|", "\n", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [t for t in ODD if t is None or len(t) < 300_000]
    rows = quality.judged(docs(spark, texts), keep=("doc_id",)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_counts(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality_verdict(spark):
    clean = [prose(i) + "." for i in range(40)]
    junk = ["#### $$$$ ".join(prose(90).split()), " | ".join("zq%dxv" % i for i in range(300))]
    rows = quality.judged(docs(spark, clean + junk), keep=("doc_id",)).orderBy("doc_id").collect()
    assert all(r.kept for r in rows[:40]) and not any(r.kept for r in rows[40:])
    kept = quality.keep_good(docs(spark, clean + junk))
    assert kept.count() == 40 and kept.columns == docs(spark, ["x"]).columns
    assert quality.judged(docs(spark, ["x"]).limit(0), keep=("doc_id",)).count() == 0


def test_texts_without_common_words_go(spark):
    real = tables.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    rng = random.Random(7)
    gibberish = [" ".join("".join(rng.choice("bcdfghklmnprtvwz") for _ in range(rng.randint(2, 9))) for _ in range(150)).capitalize() + "." for _ in range(20)]
    planted = [(-1 - i, t, ("en", "es", "fr", "de")[i % 4]) for i, t in enumerate(gibberish)]
    german = real.filter("lang = 'de' AND length(text) BETWEEN 1000 AND 3000").orderBy("doc_id").limit(20).collect()
    assert len(german) == 20
    planted += [(-100 - i, r.text, "en") for i, r in enumerate(german)]
    table = real.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string, lang string"))
    kept = {r.doc_id for r in quality.keep_good(table).select("doc_id").collect()}
    stayed = [x[0] for x in planted if x[0] in kept]
    assert len(stayed) <= 2 and all(i <= -100 for i in stayed)  # of 20 gibberish and 20 German as English
    assert len(kept) >= 0.8 * real.count()


def test_quality_verdicts_follow_rows(spark):
    clean, bad = [prose(i) + "." for i in range(40)], "too short"
    rows = [(i, t, "en", i) for i, t in enumerate(clean)] + [(None, bad, "en", 40), (3, bad, None, 41), (None, clean[0], "en", 42)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, at bigint")
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert sorted(r["at"] for r in kept.collect()) == [*range(40), 42]


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = np.sqrt(sum(0.5 * a * np.log2(a / c) for a, c in zip(p, m) if a) + sum(0.5 * b * np.log2(b / c) for b, c in zip(q, m) if b))
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    assert abs(df.select(quality.js_distance(F.col("p"), F.col("q"))).first()[0] - want) < 1e-12


# 4


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.default_model())


def test_pieces_equal_the_library(encoder):
    rng, sp = random.Random(5), encoder.model.library
    parts = ["a", "th", "ing", "the", " ", "  ", "     ", "\n", "é", "中", "𐍈", "\t", "▁", "23", "http://", "==", "{", "\x00", "ß", "." * 9]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [t or "" for t in ODD[:8]] + [" " * 50, "x" + " " * 33, prose(1, 3000)]
    assert [x.tolist() for x in encoder.encode(texts)] == sp.encode(texts)
    decoder = pieces.Decoder(pieces.default_model())
    assert all(decoder.decode(x) == t for x, t in zip(encoder.encode(texts), texts) if "▁" not in t)


def test_viterbi_rule_by_brute_force(encoder, tmp_path):
    """The same pieces as a unigram model: the kind of the model is one byte."""
    data = encoder.model.library.serialized_model_proto()
    trainer = next(v for k, v in pieces.proto_fields(data) if k == 2)
    at = data.index(trainer) + trainer.index(b"\x18\x02")
    path = tmp_path / "unigram.model"
    path.write_bytes(data[: at + 1] + b"\x01" + data[at + 2 :])
    own = pieces.Encoder(str(path))
    assert own.model.rule == "unigram"

    def best(word):
        if not word:
            return 0.0
        cuts = [own.model.scores[own.model.ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in own.model.ids]
        return max(cuts) if cuts else -float("inf")

    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "th", "in", "g", " t", "é", "中", "q", "x"]) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    for text, ids in zip(texts, own.encode(texts)):
        assert sum(own.model.scores[i] for i in ids) == sum(map(best, own.split(own.model.normal(text))))


def test_encoding_keeps_columns(spark):
    df = docs(spark, ODD)
    rows = pieces.encoded(df, pieces.default_model()).collect()
    assert len(rows) == len(ODD) and rows[0].ids == [] and rows[0].words == 1
    back = pieces.decoded(pieces.encoded(df, pieces.default_model()), pieces.default_model())
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert pieces.encoded(df.limit(0), pieces.default_model()).count() == 0


# 5


@pytest.mark.parametrize("vocabulary", [2, 3, 1000, 32000, 50257, 65536, 70000])
def test_packing(vocabulary):
    bits = token_files.bits_for(vocabulary)
    assert (1 << bits) >= vocabulary > (1 << (bits - 1)) // 1 - (bits == 1)
    ids = np.random.default_rng(1).integers(0, vocabulary, 9999).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == (9999 * bits + 7) // 8 and (token_files.unpack(data, 9999, bits) == ids).all()


def test_random_access(tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 1000, n).astype(np.uint32) for n in (0, 5, 70, 64, 1, 300, 0)]
    local = fs.LocalFileSystem()
    writer = token_files.TokenFileWriter(local.open_output_stream(str(tmp_path / "f")), 1000, block=64)
    for i, p in enumerate(parts):
        writer.add(None if i == 0 else i, p)
    writer.close()
    file, flat = token_files.TokenFile(local.open_input_file(str(tmp_path / "f"))), np.concatenate(parts)
    for a, b in [(0, 0), (0, 440), (63, 65), (64, 128), (439, 440), (100, 300)]:
        assert (file.ids(a, b) == flat[a:b]).all()
    ids, starts = file.doc_range(2, 5)
    assert ids == [2, 3, 4, 5, 6] and starts.tolist() == [5, 75, 139, 140, 440, 440]
    assert file.doc_range(0, 1)[0] == [None]


def test_token_files_equal_the_library(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(7)
    texts = ODD[:6] + ["".join(rng.choice(["It's", " ", "\n", "Δς", "é", " ", "x1", "<|endoftext|>", "…", "ÉCOLE "]) for _ in range(12)) for _ in range(300)]
    files = tables.stored(token_files.write_tokens(docs(spark, texts).repartition(3), f"file://{tmp_path}/t", path, 1), "t")
    rows = sorted(token_files.read_documents(token_files.with_starts(files)).collect(), key=lambda r: r.id)
    want = [e.ids + [1] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    start = 0
    for r, ids in zip(rows, want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = token_files.write_tokens(docs(spark, ["x"]).limit(0), f"file://{tmp_path}/e", path, 1)
    assert token_files.read_documents(token_files.with_starts(empty)).count() == 0


# 6


def brute_near(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return [(len(s), label[i]) for i, s in enumerate(sets)]


def test_near_groups(spark):
    rng, texts = random.Random(8), []
    for group in range(4):
        words = prose(group, 150).split()
        for _ in range(30):
            own = list(words)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(999)}"
            texts.append(" ".join(own))
    texts += texts[:3] + [t for t in ODD if t is None or len(t) < 100] + ["A B C D", "a b c d"]
    rows = near_dedup.near_groups(docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == dict(enumerate(brute_near(texts)))
    assert near_dedup.near_groups(docs(spark, texts).limit(0)).count() == 0
    kept = near_dedup.keep_one(docs(spark, texts))
    assert kept.count() == sum(r.kept for r in rows)


def test_sketches_fill_and_agree():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(base[:n]) for n in (1, 3, 50, 4000)] + [np.unique(np.concatenate((base[:3000], base[:1000] + np.uint64(7))))]
    table = near_dedup.sketch(sets, 128)
    assert (table != near_dedup.FULL).all()
    share = (table[3] == table[4]).mean()
    assert abs(share - 3000 / 5000) < 0.15


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in range(100):
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == label


# 7


def test_phrases_by_brute_force():
    rng = random.Random(10)
    base = "".join(rng.choice("abc ") for _ in range(300))
    root = language.automaton(base)
    for _ in range(200):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 40)))
        n, i = 0, 0
        while i < len(text):
            k = i + 1
            while k < len(text) and text[i : k + 1] in base:
                k += 1
            n, i = n + 1, k
        assert language.phrases(text, root) == n, text


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = language.op7_language(spark, sf).join(tables.documents(spark, sf).select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    odd = language.predicted(docs(spark, ODD + ["123 !!"]), {"en": prose(1, 500), "xx": "zzz qqq"}).collect()
    for r in odd:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert language.predicted(docs(spark, ["abc"]), {}).first().lang_pred == "und"
    assert language.training_texts(docs(spark, [None, ""]), "doc_id", "text", "lang") == {}


def test_training_takes_whole_texts_of_bounded_rows(spark):
    header = "cookie notice menu login " * 50
    texts = [header + prose(i, 900) for i in range(100)]
    learned = language.training_texts(docs(spark, texts), "doc_id", "text", "lang")["en"]
    found = [t for t in texts if language.letters(t) in learned]
    assert len(found) == language.SAMPLE_ROWS and len(learned) == sum(len(language.letters(t)) + 1 for t in found) - 1
    few = language.training_texts(docs(spark, ["abc def"] * 2), "doc_id", "text", "lang", 1)["en"]
    assert few == "abc def"


def test_numbers_that_look_like_letters(spark):
    rows = language.predicted(docs(spark, ["½ ² Ⅷ ٣", "½ a"]), {"en": "a b"}).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["und", "en"]


# columns with the operators' own names

CLASHING = "__key ids decoded lang_pred score __drop id words bucket row start size chunk taken __text kept n text_sha256 __row tie component".split()


@pytest.mark.parametrize("stage", ["quality", "exact", "near", "mix", "encode", "language"])
def test_clashing_columns_keep_their_values(spark, stage):
    texts = [prose(i, 150) + "." for i in range(12)] + [prose(0, 150) + ".", None, "", "word"]
    rows = [(i, t, "en", "s", len(t or ""), *([f"v{i}"] * len(CLASHING))) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING))
    run = {
        "quality": quality.keep_good, "exact": exact_dedup.drop_copies, "near": near_dedup.keep_one, "mix": mixing.remix,
        "encode": lambda d: pieces.encoded(d, pieces.default_model()), "language": lambda d: language.predicted(d, {"en": prose(1, 300)}),
    }[stage]
    out = run(table)
    made = {"encode": {"ids"}, "language": {"lang_pred", "score"}}.get(stage, set())
    assert set(out.columns) == set(table.columns)
    for r in out.collect():
        assert all(r[c] == f"v{r.doc_id}" for c in CLASHING if c not in made)
    assert run(table.limit(0)).count() == 0


def test_exact_groups_by_a_column_named_id(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b"), (None, "B")], "id bigint, text string")
    assert {(r.id, r.keep_id, r.kept) for r in exact_dedup.exact_groups(rows, "id").collect()} == {
        (1, 2, False), (2, 2, True), (3, 3, True), (None, 3, False)
    }


# 3, 6, 9 once more


def test_texts_without_a_common_word_go(spark):
    """The limit is relative, so gibberish is beyond it whatever the language's
    common words cover; clean texts stay."""
    rng = random.Random(9)
    clean = [prose(i, 120) + "." for i in range(60)]
    noise = [" ".join("".join(rng.choice("bcdfgklmnprtvz") for _ in range(6)) for _ in range(120)) for _ in range(10)]
    rows = quality.judged(docs(spark, clean + noise), keep=("doc_id",)).collect()
    assert all(r.kept == (r.doc_id < len(clean)) for r in rows)


def test_near_stage_follows_texts_under_one_id(spark):
    a, b = prose(1, 120), prose(2, 120)
    near = a + " and so on"
    rows = spark.createDataFrame([(1, a, 0), (5, near, 1), (5, b, 2), (5, b, 3), (7, b, 4), (None, a, 5)], "doc_id bigint, text string, __drop int")
    kept = near_dedup.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(r["__drop"] for r in kept.collect()) == [0, 2, 3, 5]
    groups = near_dedup.near_groups(rows.select("doc_id", "text")).groupBy("component_id").count().collect()
    assert {r.component_id: r["count"] for r in groups} == {1: 2, 5: 3, None: 1}


def plain_mix(rows, mix):
    """Targets by filling up, and what each document may give."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        for s in over or list(open_):
            target[s] = 2 * sizes[s] if over else left * weight[s] / total
        left -= sum(target[s] for s in over) if over else 0
        open_ -= set(over or open_)
    return sizes, target


def test_mix_query(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i if i % 5 else None, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(800)]
    rows += [(3, None, "b"), (3, "", "b"), (3, "x " * 5000, "c"), (None, "x y " * 3000, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    outs = []
    for k in range(2):  # the same rows in another order and number of partitions
        table.orderBy(F.rand(k)).repartition(3 + 4 * k).write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        outs.append(mixing.op9_mix_sources(spark, str(tmp_path / str(k)), mixing.Mix(block=16, shard_slots=64)).collect())
    key = lambda r: tuple(map(str, r))
    assert sorted(outs[0], key=key) == sorted(outs[1], key=key)
    sizes, target = plain_mix(rows, mixing.Mix())
    by_size = {n: s for s, n in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in outs[0]:
        source = by_size[r.source_size]
        assert abs(r.target - target[source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        assert (r.n_shards > 0) == (r.taken > 0)
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * 16 for s in sizes)
    assert max(r.n_shards for r in outs[0]) > 5


def test_shards_are_drawn(spark):
    """Counts per shard add up to the slots, and scatter like a multinomial."""
    plan = spark.createDataFrame([("a", 3000, 6000), (None, 500, 400)], "source string, blocks bigint, slots bigint")
    counts = mixing.shard_counts(plan, mixing.Mix(shard_slots=200)).collect()
    by = {s: [r.n for r in counts if r.source == s] for s in ("a", None)}
    assert sum(by["a"]) == 6000 and sum(by[None]) == 400 and {r["shard"] for r in counts} == set(range(32))
    mean = 6000 / 32
    spread = sum((n - mean) ** 2 for n in by["a"]) / (mean * (1 - 1 / 32))
    assert 12 < spread < 60 and len(set(by["a"])) > 10


# 8

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for place, (kind, form) in enumerate(BASE.items()):
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d),
                  "phone": lambda d=d: 9 <= len(d) <= 15, "email": lambda: True}[kind]
            if ok():
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data(spark):
    rng = random.Random(2)
    parts = ["1.2.3.4", ".5", "@", "a", "b.c", "x@y.z", " ", "-", "+1 (", "555", "4", "é", "\x01", "𐍈", "0810992847249404", "+49 (12) 345-678-9",
             "..", "%", "10.0.0.256", "0000010.1.1.1", "\n", "9" * 25]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += [None, "", "1 " * 30_000, "a." * 50_000 + "@x.y", "8.8.8.8 " * 3000]
    seeds = [f"Well then, my phone number +1 ({i}) 555-{1000 + i} is new" for i in range(100, 130)]
    texts += seeds + [f"Well then, my phone number 0{i}55-123-45{i}7 is new" for i in range(5)] + ["Order code 0555-123-4567 of today"]
    rows = personal_data.op8_personal_data  # the query reads a table; its parts are used here
    found = personal_data.found_spans(docs(spark, texts)).select(
        "doc_id", personal_data.listed("base").alias("base"), personal_data.listed("spans").alias("spans")
    ).collect()
    assert rows and len(found) == len(texts)
    for r in found:
        assert r.base == ",".join(base_spans(texts[r.doc_id] or ""))
    more = {r.doc_id: r.spans for r in found if r.spans != r.base}
    assert len(more) == 5 and all(s.startswith("phone:") for s in more.values())
    assert personal_data.found_spans(docs(spark, ["x"]).limit(0)).count() == 0


def test_personal_data_by_one_word_and_in_lists(spark):
    """Cues of one word at the start of a text, and lists of numbers."""
    texts = [f"Phone: +1 555 {1000000 + 7 * i}" for i in range(20)] + [f"Phone: 0555-{123456 + i}" for i in range(5)]
    texts += [f"numbers +44 20 7946 {1001 + 2 * i}, 0207-946{1000 + i}\nend" for i in range(8)] + ["nothing 12345678 here", None]
    rows = personal_data.found_spans(docs(spark, texts)).orderBy("doc_id").collect()
    phones = [[(s.start, s.end) for s in r.spans if s.kind == "phone"] for r in rows]
    assert phones[20:25] == [[(7, 18)]] * 5 and [p[-1] for p in phones[25:33]] == [(26, 38)] * 8 and phones[33:] == [[], []]


def test_personal_data_by_found_patterns(spark):
    texts = [f"Well then, my phone number +1 ({i}) 555-{1000 + i} is new" for i in range(100, 110)]
    local = [f"0{i}55-123-45{i}7" for i in range(4)]
    texts += [f"Well then, my phone number {n} is new" for n in local[:3]] + [f"Just ring us {n} today" for n in local]
    texts += [f"Parcel ref code 0{i}77-321-98{i}1 left" for i in range(4)]
    found = personal_data.found_spans(docs(spark, texts)).select("doc_id", F.size("spans").alias("n")).collect()
    assert {r.doc_id for r in found if r.n == 0} == set(range(17, 21))  # the fourth stands after 'ring us' only


# 9


def test_mix(spark):
    texts = [prose(i, 20 + i % 300) for i in range(300)] + [t for t in ODD if t is None or len(t) < 100]
    df = docs(spark, texts, ("b", None, "a", "c", "a", "a"))
    mix = mixing.Mix(block=16)
    rows = tables.stored(mixing.placed(df, mix, "doc_id", "source", "text"), "t")
    rows, plan = mixing.with_plan(rows, mix)
    plan = {r.source: r for r in plan.collect()}
    sizes = {s: sum(len((t or "").split()) for i, t in enumerate(texts) if ("b", None, "a", "c", "a", "a")[i % 6] == s) for s in plan}
    assert {s: r.source_size for s, r in plan.items()} == sizes
    weights = {"a": 3, "b": 1, "c": 2, None: 3}
    left, free, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * sizes[s]}
        for s in over or free:
            want[s] = 2 * sizes[s] if over else weights[s] * level
            left -= want[s]
        free -= over or free
    assert all(abs(plan[s].target - want[s]) < 1e-6 * want[s] for s in want)
    out = mixing.remix(df, mix).collect()
    again = mixing.remix(df, mix).collect()
    key = lambda r: (r.doc_id, r.text)
    assert sorted(map(key, out)) == sorted(map(key, again)) and out[0].asDict().keys() == df.first().asDict().keys()
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(abs(taken[s] - want[s]) < 0.05 * want[s] + 2 * mix.block for s in want)
    assert mixing.remix(df.limit(0), mix).count() == 0
    assert mixing.remix(docs(spark, [None, ""]), mix).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000, 4097])
def test_permutations(spark, n):
    p = mixing.permute(F.col("id"), F.lit(n).cast("bigint"), F.lit(5).cast("bigint"))
    assert sorted(r[0] for r in spark.range(n).select(p).collect()) == list(range(n))


# 10


def test_filters_merge_without_loss():
    rng = np.random.default_rng(4)
    for bits in (0, 3):
        prefix = 5 if bits else 0
        parts, every = [], {}
        for n in (0, 1, 500, 3000):
            f = rng.integers(0, 1 << 61 if bits else 1 << 63, n).astype(np.uint64)
            f = np.concatenate((f[: n // 2], f[: n // 3], f[: n // 3])) | np.uint64(prefix << 61 if bits else 0)
            values, counts = np.unique(f, return_counts=True)
            for v, c in zip(values.tolist(), counts.tolist()):
                every[v] = every.get(v, 0) + c
            if n:
                back = exact_dedup.read_filter(exact_dedup.build_filter(values, counts.astype(np.uint64), bits), prefix)
                assert (back[0] == values).all() and (back[1] == counts).all()
                parts.append(back)
        f, c = exact_dedup.merge_counts(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        assert dict(zip(f.tolist(), c.tolist())) == every


def test_exact_groups_edge_cases(spark):
    texts = ODD + ["Straße", "STRAßE", "É", "é"]
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(docs(spark, texts)).collect()}
    norm = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, x in enumerate(norm) if x == t]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (max(same), len(same), i == max(same))
        assert rows[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    repeated = docs(spark, ["a", "b"]).unionByName(docs(spark, ["a", "b"]))
    assert exact_dedup.drop_copies(repeated).count() == 2
    assert exact_dedup.exact_groups(docs(spark, ["x"]).limit(0)).count() == 0
    no_id = docs(spark, ["q", "q"]).withColumn("doc_id", F.when(F.col("doc_id") == 1, 1))
    assert sorted((r.doc_id or -1, r.keep_id, r.kept) for r in exact_dedup.exact_groups(no_id).collect()) == [(-1, 1, False), (1, 1, True)]


def test_copies_without_ids(spark):
    texts = ["a", "b", "B", "c", "d", "D", "e", "f", None, ""]
    ids = [None, None, None, 3, None, 5, 6, 6, None, None]
    rows = [(ids[i], t, "en", str(i)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, at string")
    stays = exact_dedup.drop_copies(table)
    assert stays.columns == table.columns
    found = sorted((r.doc_id or -1, (r.text or "").lower()) for r in stays.collect())
    assert found == [(-1, ""), (-1, "a"), (-1, "b"), (3, "c"), (5, "d"), (6, "e"), (6, "f")]


def test_hot_keys_join_alike(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 7 = 0 THEN NULL ELSE id % 50 END AS k")
    table = rows.filter("k IS NOT NULL AND k <> 9").groupBy("k").agg(F.count("*").alias("n"))
    want = sorted(map(str, rows.join(table, "k", "left").select("id", "k", "n").collect()))
    for least in (1, 100, 10**6):
        monkeypatch.setattr(tables, "HOT_LEAST", least)
        assert sorted(map(str, tables.join_hot(rows, table, ["k"], "n", 3000).select("id", "k", "n").collect())) == want


# pipeline


def test_pipeline(spark):
    source = tables.documents(spark, SF)
    before = source
    for name, stage in corpus_pipeline.STAGES:
        after = tables.stored(stage(spark, before, SF), "t")
        if name != "encode":
            assert after.columns == source.columns
        assert after.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
        if name == "exact":
            assert exact_dedup.exact_groups(after).filter("group_size > 1").count() == 0
        if name == "near":
            groups = near_dedup.near_groups(before).filter("kept").count()
            assert after.count() == groups
        before = after
    assert before.filter("size(ids) = 0").count() == 0 and before.count() > 100


def test_texts_parsed_together_have_the_phrases_of_each(monkeypatch):
    rng = random.Random(5)
    training = {"a": "abab ba", "b": "xyz é"}
    for together, cells in ((1, 10**6), (3, 10**6), (24, 10**6), (1, 0)):
        monkeypatch.setattr(language, "TOGETHER", together)
        monkeypatch.setattr(language, "TABLE_CELLS", cells)
        models = language.Models(training)
        for _ in range(60):
            texts = ["".join(rng.choices("abxé z\U0001f600", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 12))]
            want = [[language.phrases(t, language.automaton(x)) for x in training.values()] for t in texts]
            assert models.parsed(texts).tolist() == want


def test_classes_are_taken_out_one_after_the_other(spark):
    texts = ["Aé1 \t.,#*=|<>~☃ ½Ⅷ x\x0b\n" * 3, "", "aa  BB22##", None, "😀 a|b"]
    rows = quality.text_columns(docs(spark, texts)).orderBy("doc_id").select("__text", "__classes", "n_symbols").collect()
    for text, counts, symbols in rows:
        assert counts == [len(regex.findall(c, text)) for c in quality.CLASSES]
        assert symbols == len(regex.findall(quality.SYMBOLS, text))


def test_only_ends_of_pieces_are_looked_up():
    model = pieces.Encoder(pieces.default_model()).model
    looked = []

    class Tails(dict):
        def get(self, text):
            looked.append(text)
            return super().get(text)

    model.tails = Tails(model.tails)
    assert len(dict(model.encode_words(["▁qxqxqxqxqxqxqxqx"]))) == 1
    assert len(looked) < 70
