"""Merkle manifest, periodic runs and byte-pair encoding beside brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logfathom.llm import byte_pairs, merkle, periodic_runs

# extra columns bear names that the operators use themselves
DOCS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, ids int, runs int, tree string, "
    "place int, digest string, held string, key string, part int, leaf string, root int, n int, nodes int, decoded int"
)
EXTRA = ("x", 1, 2, "t", 3, "d", "h", "k", 4, "l", 5, 6, 7, 8)


def table(spark, rows):
    """(doc_id, text, lang, source, n_chars) rows with extra columns."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


def saved(spark, tmp_path, rows, files=3):
    table(spark, rows).repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


LONG = "la la land " * 30_000
ODD = [
    (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (None, None, None, None, None), (7, None, None, "s", None), (8, "", "", "", 0),
    (9, " \n\t ", "en", "s", 4), (10, "é\nö", "de", None, 3), (10, "é\nö", "de", None, 3), (10, "other\n", "de", None, 6), (-3, LONG, "en", "t", 9),
    (12, "a <|endoftext|> b\x00c", "en", "ü", 1), (13, "x" * 100_000, "en", "z", 1), (14, "lone", None, "only", None),
]


# --- 11: Merkle manifest ---


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_path(level, at):
    """The top and, by level, the digests beside a node."""
    path = []
    while len(level) > 1:
        start = at // 3 * 3
        path.append(("".join(level[start:at]), "".join(level[at + 1 : start + 3])))
        level, at = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)], at // 3
    return level[0], path


def plain_manifest(rows):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        cut = text.replace("\n", "") if hit and text is not None else text
        groups.setdefault(source, []).append((doc_id, leaf_of([doc_id, source, lang, n, text]), leaf_of([doc_id, source, lang, n, cut])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subroots = [tree_path([r[1] for r in groups[name]], 0)[0] for name in names]
    root = tree_path(subroots, 0)[0] if subroots else None
    out = []
    for k, name in enumerate(names):
        high = tree_path(subroots, k)[1]
        for i, (doc_id, leaf, held) in enumerate(groups[name]):
            path = tree_path([r[1] for r in groups[name]], i)[1] + high
            fold = held
            for a, b in path:
                fold = sha(a, fold, b)
            out.append((doc_id, leaf, subroots[k], root, sha(*(x for p in path for x in p)), fold, fold == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("n, sources", [(0, 1), (1, 1), (3, 3), (700, 1), (600, 200), (300, 3)])
def test_manifest(spark, tmp_path, n, sources):
    rng = random.Random(n + sources)
    names = [None, "", *(f"s{i:03d}" for i in range(300))]
    rows = [(i * 7, f"t{rng.random()}\n{i}", "en", names[rng.randrange(sources)], i) for i in range(n)]
    got = merkle.op11_merkle_manifest(spark, saved(spark, tmp_path, rows))
    assert got.columns == COLUMNS
    assert ordered(got.collect()) == ordered(plain_manifest(rows))


def test_manifest_of_three_stored_levels_and_odd_rows(spark, tmp_path):
    rows = ODD + [(100 + i, f"{i}\n", "en", "hot", i) for i in range(81 * 81 + 5)]
    assert ordered(merkle.op11_merkle_manifest(spark, saved(spark, tmp_path, rows, 7)).collect()) == ordered(plain_manifest(rows))


def test_manifest_catches_a_changed_value(spark, tmp_path):
    rows = table(spark, [(i, f"a{i}", "en", "s", 1) for i in range(100)])
    held = F.when(F.col("doc_id") == 40, merkle.leaf([F.lit("forged")])).otherwise(merkle.leaf([F.col("doc_id"), F.col("text")]))
    got = merkle.manifest_proofs(rows, ["doc_id", "text"], "source", "doc_id", held)
    assert [r.doc_id for r in got.filter("NOT verified").collect()] == [40]
    assert merkle.manifest_proofs(rows, ["doc_id", "text"], "source", "doc_id").filter("verified").count() == 100


# --- 12: periodic runs ---


def plain_runs(words):
    """All runs by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                found.setdefault((start, i - start + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def nested(rng, depth, signs):
    """Repetitions of repetitions, some cut short."""
    if depth == 0 or rng.random() < 0.2:
        return [rng.randrange(signs) for _ in range(rng.randint(1, 6))]
    unit = [x for _ in range(rng.randint(1, 3)) for x in nested(rng, depth - 1, signs)]
    whole = unit * rng.randint(1, 5)
    return whole[: len(whole) - rng.randint(0, len(whole) // 4)] + [rng.randrange(signs)] * rng.randint(0, 2)


@pytest.mark.parametrize("seed", range(4))
def test_runs_beside_all_periods(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        signs = rng.choice([1, 2, 2, 3, 5, 50])
        text = nested(rng, rng.randint(1, 5), signs)[:600]
        if rng.random() < 0.3:
            text = text + [rng.randrange(signs) for _ in range(rng.randint(0, 30))] + text * rng.randint(1, 3)
        texts.append(np.array(text[:1000], np.int64))
    found = periodic_runs.runs_of(texts)
    assert sum(len(f) for f in found) > 100
    for text, rows in zip(texts, found):
        assert list(map(tuple, rows.tolist())) == sorted(plain_runs(text.tolist()), key=lambda r: (r[0], r[2]))


def test_long_periods_and_neighbours():
    rng = random.Random(5)
    unit = [rng.randrange(2) for _ in range(701)]
    text = np.array([7] + unit * 3 + unit[:50] + [9] + [1, 1, 0] * 9, np.int64)
    twice = periodic_runs.runs_of([text, text, text[:20], text])
    want = [(1, 3 * 701 + 50, 701)]
    for rows in (twice[0], twice[1], twice[3]):
        assert [tuple(r) for r in rows.tolist() if r[2] > 100] == want and [1 + 3 * 701 + 51, 27, 3] in rows.tolist()
    assert len(twice[2]) == 0


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


def test_run_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [r for r in ODD if r[1] != LONG] + [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))), "en", "s", 1) for i in range(300)]
    rows += [(i, "x y  z\n" * i, "en", "s", 1) for i in range(60)]
    got = periodic_runs.op12_periodic_runs(spark, saved(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = got.collect()
    assert ordered(got) == ordered(plain_row(r[0], r[1]) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 60


def test_runs_of_long_and_no_texts(spark, tmp_path):
    rows = periodic_runs.with_runs(table(spark, [(1, LONG, "en", "s", 1), (2, None, None, None, None)])).collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows] == [(90_000, [(0, 90_000, 3)], "la la land"), (0, [], "")]
    assert periodic_runs.op12_periodic_runs(spark, saved(spark, tmp_path, [])).count() == 0


# --- 13: byte pairs ---


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_pairs.default_vocabulary())


def test_ids_and_texts_of_the_library():
    rng = random.Random(3)
    signs = [*"ab \n\t'stre1é<|>  \x1c\x85日", "<|endoftext|>", "'ll", "  ", "²", "\U0001f600"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    planes = [(0x20, 0xD800), (0xE000, 0x110000), (0xE000, 0x40000), (0x500, 0x900), (0x1C00, 0x2200)]
    texts += ["".join(chr(rng.randrange(*rng.choice(planes))) for _ in range(20)) for _ in range(20_000)]
    texts += ["a" * 50_000, "ab" * 20_000, "".join(rng.choice("abcdef") for _ in range(50_000)), " " * 10_000, "é" * 10_000, ""]
    theirs = library()
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    path = byte_pairs.default_vocabulary()
    assert [x.tolist() for x in byte_pairs.Encoder(path, byte_pairs.stand_ins(path)).encode(texts)] == want
    decoder = byte_pairs.Decoder(path)
    assert [decoder.decode(x) for x in want] == texts
    loose = [[rng.randrange(50257) for _ in range(20)] for _ in range(2000)]
    assert [decoder.decode(x) for x in loose] == [theirs.decode(x, skip_special_tokens=False) for x in loose]


def test_merges_leftmost_of_lowest_rank():
    """The tree beside a search of all pairs for every merge."""
    vocabulary = byte_pairs.Vocabulary(byte_pairs.default_vocabulary())
    rng = random.Random(4)
    for _ in range(300):
        word = bytes(rng.choice(b"aaabn the") for _ in range(rng.randint(0, 40)))
        symbols = [vocabulary.bytes[b] for b in word]
        while True:
            ranked = [(vocabulary.ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in vocabulary.ranks]
            if not ranked:
                break
            rank, i = min(ranked)
            symbols[i : i + 2] = [vocabulary.made[rank]]
        assert vocabulary.merged(word) == symbols


def test_new_words_merge_together(monkeypatch):
    """Words that are met for the first time are not merged one by one (950 CPU seconds a GB)."""
    path, rng = byte_pairs.default_vocabulary(), random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(5, 12))) for _ in range(100)) for _ in range(200)]
    encoder, alone = byte_pairs.Encoder(path, byte_pairs.stand_ins(path)), []
    merged = byte_pairs.Vocabulary.merged
    monkeypatch.setattr(byte_pairs.Vocabulary, "merged", lambda self, word: alone.append(word) or merged(self, word))
    got = encoder.encode(texts)
    assert len(alone) < 200
    assert [x.tolist() for x in got] == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def test_merges_together_as_alone():
    vocabulary = byte_pairs.Vocabulary(byte_pairs.default_vocabulary())
    rng = random.Random(6)
    words = [bytes(rng.choice(b"aaabn the\xc3\xa9\x00\xff") for _ in range(n)) for n in [*range(80)] * 70]
    words += [b"a" * n for n in range(130)] + [b" " * n for n in range(70)] + [b"", b"the", b"the"]
    want = [vocabulary.merged(word) for word in words]
    got = vocabulary.merged_all(words)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == want
    assert vocabulary.merged_all([]) == []
    assert [vocabulary.merged_all([word])[0] for word in words[:90]] == got[:90]


def test_batches_are_taken_up_in_parts():
    """A part is of a bounded size, or one row; the parts hold all rows in order."""
    import pyarrow as pa

    rng = random.Random(7)
    sizes = [rng.choice([None, 0, 1, 5_000, 100_000, 900_000]) for _ in range(300)]
    batch = pa.record_batch({"i": list(range(300)), "size": pa.array(sizes, pa.int32())})
    parts = list(byte_pairs.short_batches(batch, batch.column(1)))
    assert [i for part in parts for i in part.column(0).to_pylist()] == list(range(300))
    held = [[size or 0 for size in part.column(1).to_pylist()] for part in parts]
    assert len(parts) > 50 and all(sum(part) - max(part) <= byte_pairs.RUN_SIZE for part in held)
    assert [part.num_rows for part in byte_pairs.short_batches(batch.slice(0, 0), batch.column(1).slice(0, 0))] == [0]


def test_words_remembered_are_bounded(monkeypatch):
    """Odd and long words are not kept; what is kept is dropped beyond the bound."""
    path = byte_pairs.default_vocabulary()
    odd = byte_pairs.stand_ins(path)
    sign = chr(next(iter(odd)))
    texts = [None, "", f"one {sign}two<|endoftext|>{sign}{sign} 1{sign}", "one " + "x" * 100, "<|endoftext|><|endoftext|>", f" two {sign}", "two"]
    monkeypatch.setattr(byte_pairs, "text_runs", lambda texts, chars: ([text or ""] for text in texts))
    theirs = [e.ids for e in library().encode_batch([text or "" for text in texts], add_special_tokens=False)]
    encoder = byte_pairs.Encoder(path, odd)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == theirs
        assert {"one", "two", " two"} <= encoder.known.keys()
        assert all(len(word) <= byte_pairs.REMEMBERED_LENGTH and sign not in word for word in encoder.known)
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 2)
    assert [x.tolist() for x in encoder.encode(texts)] == theirs
    assert len(encoder.known) <= 2


def test_pair_query(spark, tmp_path):
    got = byte_pairs.op13_byte_pairs(spark, saved(spark, tmp_path, ODD))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    theirs = library()
    want = []
    for doc_id, text, *_ in ODD:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    assert ordered(got.collect()) == ordered(want)


def test_pair_columns(spark):
    path = byte_pairs.default_vocabulary()
    rows = byte_pairs.decoded(byte_pairs.encoded(table(spark, ODD), path), path)
    assert sorted(rows.columns) == sorted(DOCS.replace(",", "").split()[::2])
    assert all(r.decoded == (r.text or "") and r.n == 6 for r in rows.collect())
    assert byte_pairs.encoded(table(spark, []), path).count() == 0
