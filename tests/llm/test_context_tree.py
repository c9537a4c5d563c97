import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import context_tree as ct


def learn():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0


def words(text):
    return (text or "").encode().translate(ct._LOWER).split()


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def decisions(text, depth):
    """(context, bits so far, bit) of every binary decision of a text."""
    data = b"\n" * depth + b" ".join(words(text)) + b"\n"
    for i in range(depth, len(data)):
        bits = f"{data[i]:08b}"
        for k in range(8):
            yield data[i - depth : i], bits[:k], int(bits[k])


def brute(docs, depth):
    """The tree as textbooks have it: a recursion over contexts in plain Python."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for doc, text in docs:
        if not held_out(doc):
            for context, bits, bit in decisions(text, depth):
                for d in range(depth + 1):
                    counts[context[depth - d :], bits][bit] += 1
                    if d:
                        children[context[depth - d + 1 :], bits].add(context[depth - d :])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}
    for d in range(depth, -1, -1):
        for (context, bits), (a, b) in list(counts.items()):
            if len(context) == d:
                own = kt(a, b)
                below = sum(weighted[c, bits] for c in children[context, bits])
                weighted[context, bits] = own if d == depth else math.log(0.5) + np.logaddexp(own, below)

    def one(context, bits, d):
        a, b = counts.get((context[depth - d :], bits), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        if a + b == 0:
            return 0.5
        share = math.exp(kt(a, b) + math.log(0.5) - weighted[context[depth - d :], bits])
        return share * own + (1 - share) * one(context, bits, d + 1)

    c = Counter(w for doc, text in docs if not held_out(doc) for w in [*words(text), b"\n"])
    n = sum(c.values())
    out = []
    for doc, text in docs:
        tokens = [*words(text), b"\n"]
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (len(c) + 1))) for t in tokens)
        score = sum(math.log10(p if bit else 1 - p) for context, bits, bit in decisions(text, depth) for p in [one(context, bits, 0)])
        out.append((doc, held_out(doc), len(tokens), sum(c[t] > 0 for t in tokens), n, round(base, 6), round(score, 3)))
    return sorted(out, key=repr)


def scored(spark, docs, **how):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block long, keys string").repartition(3)
    rows = ct.score(df, learn(), **how).collect()
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 3)) for r in rows), key=repr)


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_against_brute_force(spark, depth):
    rng = np.random.default_rng(depth)
    text = lambda: " ".join("".join(rng.choice(list("abeÉT"), rng.integers(1, 5))) for _ in range(rng.integers(0, 30)))
    docs = [(i, text()) for i in range(60)]
    assert scored(spark, docs, depth=depth, block_bytes=300, shard_bytes=500) == brute(docs, depth)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "One one\x1cONE\x00"), (4, "One one\x1cONE\x00"), (None, "of no name"), (None, None), (5, "x" * 5000 + " y"), (1, "other text of one id")]
    assert scored(spark, docs) == brute(docs, 5)
    assert scored(spark, []) == []
    held = [(i, "all held out") for i in range(200) if held_out(i)]
    got = scored(spark, held)
    assert got == brute(held, 5) and got[0][6] == round(-13 * 8 * math.log10(2), 3)


def test_long_words_and_steps():
    data = b"ab  cde\tf" * 20
    for step in (1, 2, 5, 1000):
        assert sum(ct.words_of(data, step), []) == data.split()
    texts = [b"abcab\n", b"\n", b"abc\n" * 9]
    keys, counts = ct.count_runs(texts, 3)
    want = Counter(t2[i : i + 4] for t in texts for t2 in [b"\n\n\n" + t] for i in range(len(t)))
    assert {int(k).to_bytes(4, "big"): n for k, n in zip(keys, counts)} == want


def test_held_out_texts_code_shorter_than_by_words(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 2)) + "ing" for _ in range(40)]
    docs = [(i, " ".join(vocabulary[(j * 7 + i) % 40] for j in range(60))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ct.score(df, learn()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_a_block_is_scored_in_little_memory():
    """What a task holds above its keys and its text, while it scores a block."""
    rng, depth = np.random.default_rng(0), 5
    words = [bytes(rng.choice(list(b"abcdefgh"), 5).astype(np.uint8)) for _ in range(300)]
    texts = [b" ".join([words[i] for i in rng.integers(0, 300, 40_000)]) + ct.END for _ in range(16)]
    keys, counts = ct.count_runs(texts, depth)
    text, lengths, said = b"".join(texts), np.array([len(t) for t in texts], dtype=np.int64), dict.fromkeys([*words, ct.END], 1)
    del texts
    tracemalloc.start()
    figures = ct._score_block(keys, np.log(counts / counts.sum()), said, text, lengths, depth)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert figures[0].sum() == 16 * 40_001 and np.isfinite(figures[3]).all()
    assert peak < 12 * len(text), peak / len(text)


def test_runs_are_held_once_and_their_places_fill_little():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 48, 1000).astype(np.uint64))
    places = ct._Places(keys)
    assert len(places.table) <= 4 * len(keys) and (keys[places.find(keys[::-1])] == keys[::-1]).all()
    texts = [b"ab ab\n", b"\n"]
    runs, counts = ct.count_runs(texts, 2)
    parts, vals = [runs[:2], runs[2:]], [np.zeros(2), np.zeros(len(runs) - 2)]
    assert ct._run_figures(parts, vals, b"".join(texts), np.array([6, 1]), 2).tolist() == [0, 0] and parts == vals == []
