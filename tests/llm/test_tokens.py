"""Encoding, packing and the token store."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import packing, token_store
from docloom.llm.common import Encoder, tokenizer_file

TEXTS = [None, "", " ", "Hello, world. It's 3.5% of ÄÖÜ ß!\nNew  line\ttab", "<|endoftext|> a<|startoftext|>b", "é ́x café", "ΑΣ ΣΑΣ İ ẞ", "a\x1cb \x85 c d　e f", "日本語 text 😀👍🏽", "µÅ Å", "don't we'll 'S x's", "a.,b ., .. word. word, word.,", "x" * 500, "\x00 \x07 a"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def whole(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_encoder(tokenizer):
    e = Encoder(tokenizer_file())
    assert list(e.many(pa.array(TEXTS * 2))) == [whole(tokenizer, t) for t in TEXTS * 2]
    assert list(e.many(pa.array(TEXTS)[3:7])) == [whole(tokenizer, t) for t in TEXTS[3:7]]
    assert list(e.many(pa.array([], pa.string()))) == [] and e.encode("<|ENDOFTEXT|> a") == whole(tokenizer, "<|ENDOFTEXT|> a")
    plain = Encoder(tokenizer_file("byte_bpe_50k.json"))
    assert not plain.by_piece and plain.encode("a b\nc") == np.array(plain.tokenizer.encode("a b\nc", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_every_latin_letter(tokenizer):
    e = Encoder(tokenizer_file())
    words = [f"a{chr(c)}{chr(d)}b" for c in range(0x20, 0x180) for d in (0x61, 0xC9, 0xF7, 0x178)] + ["\u212a\u212b", "\u1e9eA", "I\u0130i"]
    assert list(e.many(pa.array(words))) == [whole(tokenizer, w) for w in words]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_encoder_on_documents(tokenizer):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].combine_chunks()
    assert list(Encoder(tokenizer_file()).many(texts)) == [whole(tokenizer, t) for t in texts.to_pylist()]


def test_encoder_on_random_texts(tokenizer):
    rng, e = np.random.default_rng(0), Encoder(tokenizer_file())
    alphabet = list("aBé .,'\n\tſKÅñ1-!") + ["́", " ", "ﬁ", "Σ"]
    for _ in range(1500):
        t = "".join(rng.choice(alphabet, int(rng.integers(0, 40))))
        assert e.encode(t) == whole(tokenizer, t), repr(t)


def test_fill():
    rng = np.random.default_rng(1)
    for _ in range(300):
        lengths = rng.integers(1, 30, int(rng.integers(1, 9))).tolist()
        room = int(rng.integers(1, 60))
        counts = {x: lengths.count(x) for x in set(lengths)}
        got = packing.fill(counts, room)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(x) <= counts[x] for x in got)


def check_pieces(rows, ids_of, size=64):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for d, ids in ids_of.items():
        at = 0
        for r in sorted(docs[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, sum(map(len, ids_of.values()))


def test_packing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(0, 300))) for i in range(400)] + [(400, None)]

    def make():
        return lambda texts: (np.arange(len(t or ""), dtype="<u4").tobytes() for t in texts.to_pylist())

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hold in (4096, 50):
        got = packing.pieces(packing.pack(df, make, size=64, hold=hold)).collect()
        padding, total = check_pieces(got, {i: [*range(len(t or "")), 1] for i, t in rows})
        assert padding <= 0.01 * total
    assert packing.pack(df.limit(0), make).count() == 0


def test_packing_odd(spark, odd, tokenizer):
    """Real ids: every piece has the checksum of its part of the whole text's ids."""
    got = packing.pieces(packing.pack(odd, packing.encoder_of(tokenizer_file()))).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(whole(tokenizer, r["text"]) + np.array([1], dtype="<u4").tobytes())
    for r in got:
        ids = texts[r["doc_id"]][0]
        assert r["doc_tokens"] == len(ids) // 4 and r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
    for doc, same in texts.items():
        spans = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == doc)
        assert sum(n for _, n in spans) == sum(len(x) // 4 for x in same)
    check_pieces(got, {}, 2048)


def test_remainders_that_do_not_fit_together():
    """20,000 remainders just over half a window: planned in linear time, never more than `hold` held."""
    import time

    began, rest, seen, most = time.perf_counter(), [], 0, 0
    ids = np.zeros(1100, dtype="<u4").tobytes()
    flushes = 0
    for doc in range(20_000):
        rest.append((doc, 0, ids, 1100))
        most = max(most, len(rest))
        if len(rest) >= 4096:
            windows, rest = packing._flush(rest, 2048, False, 8)
            flushes += 1
            seen += sum(len(p[2]) // 4 for w in windows for p in w)
            assert len(rest) <= 2048 and all(sum(len(p[2]) // 4 for p in w) == 2048 for w in windows)
    windows, rest = packing._flush(rest, 2048, True, 8)
    seen += sum(len(p[2]) // 4 for w in windows for p in w)
    assert seen == 20_000 * 1100 and not rest and most == 4096 and flushes <= 10 and time.perf_counter() - began < 20


def test_segment():
    keys = [None, None, -5, 3, 3, 10**12]
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (2, 0, 5, 1, 7, 3)]
    r = token_store.Reader(token_store.segment(9, keys, ids) + b"\n")
    assert r.ordinal == 9 and r.width == 2
    seen = {}
    for k, x in zip(keys, ids):
        nth = seen.get(k, 0)
        seen[k] = nth + 1
        assert r.get(k, nth).astype("<u4").tobytes() == x
    assert sum(r.get(k) is not None for k in range(1000, 3000)) <= 1
    assert token_store.Reader(token_store.segment(0, [1], [np.array([70_000], dtype="<u4").tobytes()])).get(1).tolist() == [70_000]


def test_minimal_perfect():
    h = token_store._mix(np.arange(5000, dtype=np.uint64))
    pilots = token_store.build_hash(h)
    s = token_store._slots(h, pilots[token_store._bucket(h, len(pilots)).astype(np.int64)], len(h))
    assert sorted(s.tolist()) == list(range(5000))


def test_store(spark, odd):
    e = Encoder(tokenizer_file())
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.store(odd, tokenizer_file()).collect()), key=lambda r: r[1:3])
    rows = sorted(odd.collect(), key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"]))
    at, want = 0, []
    for r in rows:
        ids = e.encode(r["text"]) + np.array([2], dtype="<u4").tobytes()
        want.append((-1 if r["doc_id"] is None else r["doc_id"], at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    assert token_store.store(odd.limit(0), tokenizer_file()).count() == 0


def test_segments_split(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(300)], "doc_id long, text string")
    token_store.write(df, str(tmp_path / "s"), tokenizer_file(), segment_ids=50, shard_bytes=400)
    got = token_store.starts(token_store.read(spark, str(tmp_path / "s"))).orderBy("doc_id").collect()
    at = 0
    for i, r in enumerate(got):
        assert (r["doc_id"], r["start"]) == (i, at)
        at += r["n_tokens"]


def test_lookup(spark, tmp_path):
    e, path = Encoder(tokenizer_file()), str(tmp_path / "s")
    rows = [(3 * i, f"word{i} " * (i % 9)) for i in range(400)] + [(30, "again"), (30, "again"), (30, None), (None, "no id"), (None, "no id either"), (-8, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS hash", "2 AS row", "3 AS segment")
    token_store.write(df, path, tokenizer_file(), segment_ids=100, shard_bytes=900)
    found = token_store.read(spark, path)
    token_store.write_directory(found, path)
    assert found.select("file").distinct().count() > 5 and found.select("segment").distinct().count() > 8
    keys = [0, 3, 30, 31, -8, None, 1197, 10**12, -(10**12), 600]
    got = {}
    for r in token_store.lookup(spark, path, keys).orderBy("nth").collect():
        assert r["nth"] == len(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]].append(r["ids"])
    want = {}
    for k, text in rows:
        if k in keys:
            want.setdefault(k, []).append([*np.frombuffer(e.encode(text), dtype="<u4").tolist(), 2])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_store.lookup(spark, path, [10**12]).count() == token_store.lookup(spark, path, []).count() == 0
    with pytest.raises(ValueError):
        token_store.lookup(spark, path, [1, 2, 3], most=2)


def test_one_id_in_many_files(spark, tmp_path):
    """Rows of one id, most of them wholly alike, are dealt to many files and still come back in one order."""
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(7, "same text here " * 5)] * 300 + [(7, f"other {i} " * 5) for i in range(100)] + [(9, "z")], "doc_id long, text string")
    token_store.write(df, path, tokenizer_file(), shard_bytes=2000)
    found = token_store.read(spark, path)
    assert found.where("doc_id = 7").select("file").distinct().count() > 5
    rows = token_store.starts(found).orderBy("segment", "place").collect()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert rows[-1]["doc_id"] == 9 and len(rows) == 401
