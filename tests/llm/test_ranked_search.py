import math
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(rs.UPPER, rs.LOWER)))


def brute(docs, items, k=10):
    """The contract by scoring every document."""
    docs = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scored = []
        for d, c, size in docs:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            scored += [(-s, d)] if s > 0 else []
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **index):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, shard int, score int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    return sorted(map(tuple, rs.search(rs.build_index(d, **index), q).collect()), key=repr)


@pytest.mark.parametrize("index", [{}, {"shard_docs": 7}, {"shard_postings": 60}])
def test_against_brute_force(spark, index):
    """Zipf-like texts with groups of copies (ties) and repeated terms in the queries."""
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, n), 400))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(1000 - i, docs[5][1]) for i in range(30)]
    items = [(i, text(12)) for i in range(12)] + [(50, docs[5][1])]
    got = ranked(spark, docs, items, **index)
    assert got == brute(docs, items) and len(got) > 100


def test_odd_rows(spark):
    long = "lang-" * 1000 + " zebra " + "x" * 300_000 + " zebra"
    docs = [(1, "One TWO zwei Ärger"), (2, None), (3, ""), (4, " .,; "), (5, "one two one"), (5, "one two one"), (None, "one two"), (7, long), (8, "ÄRGER ärger\x00two"), (9, "x" * 300_000)]
    items = [(1, "One one"), (1, "One one"), (2, None), (3, "!"), (4, "Ärger zebra"), (5, "x" * 300_000), (None, "two"), (6, "nowhere")]
    assert ranked(spark, docs, items) == brute(docs, items) != []
    assert ranked(spark, docs[1:4], items) == [] == ranked(spark, docs, [])


def test_long_texts_are_split_at_terms():
    text = ("alpha beta-gamma " * 50).encode()
    for step in (1, 3, 7, 64, 10_000):
        assert sum(rs._split(text, step), []) == [b"alpha", b"beta", b"gamma"] * 50
