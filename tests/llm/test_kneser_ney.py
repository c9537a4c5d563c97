import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import kneser_ney as kn


def brute_model(texts):
    """Interpolated modified Kneser-Ney of order 5 over characters, with dictionaries."""
    top = Counter()
    for t in texts:
        s = "\x02" * 4 + t
        top.update(s[i - 4 : i + 1] for i in range(4, len(s)))
    levels, counts = {5: top}, top
    for k in (4, 3, 2, 1):
        counts = Counter(g[1:] for g in counts)
        levels[k] = counts
    tables = {}
    for k, counts in levels.items():
        n = Counter(min(c, 5) for c in counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        d = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[1] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)]
        total, mass = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3) - 1]
        tables[k] = counts, d, total, mass

    def p(g, k=5):
        if k == 0:
            return 1 / 0x110000
        g = g[-k:]
        counts, d, total, mass = tables[k]
        if not total[g[:-1]]:
            return p(g, k - 1)
        c = counts[g]
        return (c - d[min(c, 3) - 1] if c else 0) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * p(g, k - 1)

    return p


def brute_score(good, bad, t):
    """Negative log-likelihood under one model, and the largest gain of the other over any passage."""
    s = "\x02" * 4 + t
    logs = [(math.log(good(s[i - 4 : i + 1])), math.log(bad(s[i - 4 : i + 1]))) for i in range(4, len(s))]
    gain = best = 0.0
    for a, b in logs:
        gain = max(0.0, gain + b - a)
        best = max(best, gain)
    return -sum(a for a, _ in logs), best


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(["the", "ing", "reed", "thou", "an", "of", "ä"], int(rng.integers(3, 30)))) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    good, odd = texts(60, 0), ["XX!! $$$ ###" * 3, None, "", "the of", "日本 😀", "the of"]
    vile = [x + " scum vermin " + x for x in texts(20, 5)]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(good)] + [(100 + i, t, "en") for i, t in enumerate(odd)] + [(300 + i, t, "en") for i, t in enumerate(vile)]
    rows += [(200, "no model here", "zz"), (None, "the an", "en"), (1, good[1], "en"), (1, good[1], "en")]
    path = str(tmp_path_factory.mktemp("kn") / "docs")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # names that the operator might use inside
    df.selectExpr("*", "1 AS mid", "2 AS block", "'k' AS key", "3 AS kind", "4 AS id", "5 AS x", "'y' AS threshold", "6 AS label_id", "7 AS nth").repartition(3).write.parquet(path)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100, 0, 0), (1, 1, None), (None, 1, 0)] + [(300 + i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    return spark.read.parquet(path), labels, good, vile


def test_scores(table):
    docs, labels, good, vile = table
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", kn.fold(F.col("doc_id")).alias("f")).collect()}
    assert set(folds.values()) == {0, 1}
    trusted = lambda f, lang: brute_model([t for i, t in enumerate(good) if i % 2 == (lang == "en") and folds[i] != f] + [good[1]] * 2 * (lang == "en" and folds[1] != f))
    toxic = lambda f: brute_model([t for i, t in enumerate(vile) if folds[300 + i] != f])
    models = {(f, lang): (trusted(f, lang), toxic(f) if lang else None) for f in (0, 1) for lang in ("en", None)}
    known = kn.train(docs, labels)
    assert 1000 < known.count()
    # with all, some and no counts sent ahead
    got = [r for common in (1 << 20, 1000, 0) for r in kn.score(docs, known, block_bytes=500, common=common).collect()]
    assert len(got) == 3 * docs.count()
    for r in got:
        assert r["_kn_chars"] == len(r["text"] or "")
        if not r["text"] or r["lang"] == "zz":
            assert r["_kn_nll"] is None
            continue
        a, b = models[folds[r["doc_id"]], r["lang"]]
        nll, gain = brute_score(a, b or a, r["text"])
        assert r["_kn_nll"] == pytest.approx(nll, rel=1e-5)
        assert r["_kn_toxic"] is None if b is None else r["_kn_toxic"] == pytest.approx(gain, rel=1e-3, abs=1e-3)


def test_classify(table):
    docs, labels, good, vile = table
    out = kn.classify(docs, labels)
    assert out.columns == [*[c for c in docs.columns if c != "threshold"], *kn.OUTPUT]
    rows = out.collect()
    assert len(rows) == docs.count()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert all(kept[i] for i in range(60)) and kept[200] and kept[103] and kept[None]
    assert not kept[100] and not kept[101] and not kept[102]
    assert sum(kept[300 + i] for i in range(20)) <= 1
    for r in rows:
        if r["text"] and r["threshold"] is not None:
            assert r["kept"] == (r["perplexity"] <= r["threshold"] and (r["toxicity"] is None or r["toxicity"] <= r["toxicity_limit"]))
    assert len({r["perplexity"] for r in rows if r["doc_id"] == 1}) == 1
    assert kn.classify(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark, tmp_path):
    """Documents without labels are judged like their kind."""
    rng = np.random.default_rng(3)
    words = ["the", "ing", "reed", "thou", "an", "of", "tion", "er"]
    plain = lambda: " ".join("".join(rng.choice(words, int(rng.integers(1, 4)))) for _ in range(40))
    junk = lambda: "".join(rng.choice(list("qxzjkw#$%0 "), 200))
    vile = lambda: plain() + " worthless scum " + plain()
    rows = [(3 * i + k, make(), "en") for i in range(150) for k, make in enumerate((plain, junk, vile))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(225)], "doc_id long, quality int, toxic int")
    new = [r for r in kn.classify(spark.read.parquet(str(tmp_path / "d")), labels).collect() if r["doc_id"] >= 225]
    share = lambda k: sum(r["kept"] for r in new if r["doc_id"] % 3 == k) / 75
    assert share(0) >= 0.94 and share(1) == 0 and share(2) <= 0.03


def test_long_text_in_chunks():
    t = "".join(texts(300, 4)) + "😀日本"
    both = [t, None, "", t[:50], "a"]
    want = Counter()
    for x in both:
        s = "\x02" * 4 + (x or "")
        want.update(s[i - 4 : i + 1] for i in range(4, len(s)))
    for most in (1, 3, 37, 1 << 20):
        h, g, n = kn.distinct(both, most)
        assert (np.diff(h.astype(object)) > 0).all()
        assert dict(zip(kn._strings(g).to_pylist(), n.tolist())) == dict(want)


def test_bitmap(spark):
    ids = spark.range(500).selectExpr("id * 7 AS label_id")
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    left = {r["doc_id"] for r in kn.likely(docs, ids, "doc_id").collect()}
    assert {7 * i for i in range(500)} <= left and len(left) < 3000


def test_the_head_passes_the_driver_once(spark):
    """The counts sent ahead, as they were, with little beside them in the driver."""
    known = spark.range(200_000).select(F.xxhash64("id").alias("id"), *[(F.col("id") + i).cast("float").alias(c) for i, c in enumerate(kn._CELLS)])
    tracemalloc.start()
    sent, others = kn.largest(known, 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got, want = kn.Counts.unpacked(sent.value), kn.Counts.of(known.toArrow())
    assert (got.ids == want.ids).all() and (got.cells == want.cells).all() and others.count() == 0
    assert peak < 2.5 * len(sent.value), peak / len(sent.value)
    none, _ = kn.largest(known.limit(0), 1 << 20)
    assert not len(kn.Counts.unpacked(none.value).ids)


def test_each_run_once(monkeypatch):
    """A block's runs are numbered, not sorted, and each distinct one is looked up once."""
    sizes = []
    real = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **y: sizes.append(len(a)) or real(a, *x, **y))
    many = texts(3000, 6)
    h, g, n = kn.distinct(many)
    assert n.sum() == sum(map(len, many)) > 100 * len(h)
    assert max(sizes) < 0.1 * n.sum()
    runs = {s[i - k : i] for t in many for s in ["\x02" * 4 + t] for i in range(5, len(s) + 1) for k in range(6)} | {"\x02" * k for k in range(5)}
    asked = []
    find = kn.Counts.find
    monkeypatch.setattr(kn.Counts, "find", lambda self, ids: asked.append(len(ids)) or find(self, ids))
    none = kn.Counts(np.zeros(0, dtype=np.int64), np.zeros((0, 6), dtype=np.float32))
    nll, toxic = kn._scores(many, len(many), "0:en", [none])
    assert np.isnan(nll).all() and np.isnan(toxic).all()
    # runs across two texts, which end in the mark of a start, are the only others
    assert len(runs) <= sum(asked) < 1.5 * len(runs)


def test_levels_of_narrow_and_wide_alphabets(monkeypatch):
    """Runs, their contexts and endings are the same whether told apart by a table or in order."""
    rng = np.random.default_rng(1)
    wide = ["".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, 400)) + "\U0001f600", "", None, "a", *texts(20, 2)]
    for table in (1 << 23, 0):
        monkeypatch.setattr(kn, "_TABLE", table)
        for c, runs in kn._chunks(wide, 700):
            s = c.astype("<u4").tobytes().decode("utf-32-le")
            levels, which = kn._levels(c)
            names = [["".join(map(chr, p)) for p in level.points] for level in levels]
            assert [names[5][w] for w in which] == [s[i : i + 5] for i in range(len(s) - 4)]
            for k in range(1, 6):
                assert len(set(names[k])) == len(names[k]) and set(names[k]) == {s[i : i + k] for i in range(len(s) - k + 1)}
                assert [names[k - 1][i] for i in levels[k].context] == [x[:-1] for x in names[k]]
                assert [names[k - 1][i] for i in levels[k].ending] == [x[1:] for x in names[k]]
        h, g, n = kn.distinct(wide, 700)
        want = Counter(("\x02" * 4 + t)[i - 4 : i + 1] for t in wide if t for i in range(4, len(t) + 4))
        assert dict(zip(kn._strings(g).to_pylist(), n.tolist())) == dict(want)
