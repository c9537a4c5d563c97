import re
from collections import Counter

import numpy as np

from docloom.llm import ngram_join


def runs(text):
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", text or "") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [runs(t) for _, t in rows]
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    return sorted((d, min(classes[find(i)]), links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(20, 200))))
        for _ in range(int(rng.integers(1, 6))):
            t = list(base)
            for k in rng.integers(0, len(t), int(rng.integers(0, 4))):
                t[k] = "x" + str(rng.integers(99))
            rows.append((n, " ".join(t)))
            n += 1
    hot = list(rng.choice(vocabulary, 400))
    for _ in range(40):
        t = list(hot)
        t[int(rng.integers(400))] = "y" + str(rng.integers(1000))
        rows.append((n, " ".join(t)))
        n += 1
    return rows + [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, ""), (n + 3, "a b"), (n + 4, "a b")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for how in ({}, {"block": 8}, {"block_bytes": 20_000}):  # the second and third split large groups into blocks
        got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.similar(df, **how).collect())
        assert got == want


def test_hub_and_chain(spark):
    """Components are exact for a star with more rows than there are salts, a long chain and a few pairs."""
    from docloom.llm.common import label

    star = [(5000, 10_000 + i) for i in range(1500)]
    chain = [(i, i + 1) for i in range(100)]
    df = spark.createDataFrame(star + chain + [(200, 300), (300, 200), (7000, 7000)], "a long, b long")
    got = {r["node"]: r["root"] for r in label(df).collect()}
    want = {n: 5000 for _, n in star} | {i: 0 for i in range(101)} | {5000: 5000, 200: 200, 300: 200}
    assert got == want


def test_clashing_columns(spark):
    rows = corpus(4)[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS size", "3 AS h", "4 AS root", "5 AS block", "'z' AS row_key", "6 AS _salt")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.similar(df).collect())
    assert got == brute(rows)
    assert ngram_join.keep_one(df).columns == df.columns


def test_keep_one(spark, odd):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8]


def test_empty(spark, odd):
    assert ngram_join.similar(odd.limit(0)).count() == 0


def test_shingles():
    assert len(ngram_join.shingles("a b c d e f")) == 2
    assert len(ngram_join.shingles("a b")) == 1
    assert len(ngram_join.shingles(" \t")) == len(ngram_join.shingles(None)) == 0
    assert (ngram_join.shingles("ä b c d e") == ngram_join.shingles("ä  b\nc d e ")).all()
    assert ngram_join.bands_for(0.8, 0.9999, 7) == 40


def test_plans_stay_small(spark, monkeypatch):
    """No step holds the plans of those before it many times over, as the driver keeps them all."""
    joins, made = {}, ngram_join.materialise

    def seen(df, name):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return made(df, name)

    monkeypatch.setattr(ngram_join, "materialise", seen)
    df = spark.createDataFrame([(i, "one two three four five six seven " + "x" * (i % 3)) for i in range(9)], "doc_id long, text string")
    assert ngram_join.similar(df).count() == 9
    assert joins["members"] and max(joins.values()) <= 12, joins
