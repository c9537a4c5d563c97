import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(wins)
    cover = {i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


TEXTS = [None, "", " ", "a b c d e a b c d e", "a a a a a a a", "x\nx\n x\n\n\nx", "a#b$ |c <d> &&% **", "one two three four five six seven eight nine ten one two three four five", "é ü x y", "a\rb\x0bc\x0cd"]


def test_measures(spark):
    rng = np.random.default_rng(1)
    texts = TEXTS + [" ".join(rng.choice(list("abc"), int(n))) for n in rng.integers(1, 60, 60)] + ["w " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.measure(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]]), repr(texts[r["doc_id"]])[:80]


def test_adaptive_thresholds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'w' * int(rng.integers(2, 9))}{i}x{k}" for k in range(40)), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join(f"w{i}x{k}$$$" for k in range(40)), "en", "s") for i in range(20)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(df).collect()}
    assert all(kept[i] for i in range(400)) and not any(kept[1000 + i] for i in range(20))


def test_sketches_come_near_exact_quantiles(spark):
    values = list(range(2000))
    df = spark.createDataFrame([(v, 100, 100, 0, 0, v, "en", "s") for v in values], "doc_id long, n_words long, word_chars long, n_dup_lines long, n_repeat_words long, n_symbols long, lang string, source string")
    t = rules.thresholds(df, (rules.Rule("symbols", "n_symbols", 0.01),)).first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert t["symbols_high"] == pytest.approx(q3 + 3 * (q3 - q1), rel=0.05)


def test_reruns_agree_and_sources_lean_on_their_language(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("w" * int(rng.integers(1, 12)) + str(k) for k in range(30)) + " #" * int(rng.integers(0, 9)), "en", f"s{i % 40}") for i in range(2000)]
    make = lambda n: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(n)
    a, b = (sorted((r["doc_id"], r["kept"]) for r in rules.judge(make(n)).collect()) for n in (1, 7))
    assert a == b
    measured = rules.measure(make(2))
    bounds = {p: {r["source"]: r["symbols_high"] for r in rules.thresholds(measured, prior=p).collect()} for p in (0.0, 200.0, 1e9)}
    whole = bounds[1e9]["s0"]
    assert all(abs(bounds[200.0][s] - whole) <= abs(bounds[0.0][s] - whole) + 1e-9 for s in bounds[0.0])


def test_verdict_against_brute_force(spark):
    """Bounds from exact quantiles give the same verdict but for documents within the sketch's accuracy of a bound."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'w' * int(rng.integers(1, 9))}{k}{i}" for k in range(40)) + " $" * int(rng.integers(0, 3) if i % 20 else 60), "en", None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = {i: brute(t) for i, t, _, _ in rows}
    share = {i: x[2] / x[1] for i, x in m.items()}
    q1, q3 = np.quantile(list(share.values()), [0.25, 0.75])
    high = q3 + 3 * max(q3 - q1, 0.03)
    got = {r["doc_id"]: "symbols" in r["failed"] for r in rules.judge(df).collect()}
    assert all(got[i] == (share[i] > high) for i in got if abs(share[i] - high) > 0.02 * high) and 0 < sum(got.values()) < 100


def test_odd_rows(spark, odd):
    got = rules.judge(odd)
    assert got.count() == odd.count()
    assert {r["kept"] for r in got.where("n_words < 10").collect()} == {False}
    assert rules.judge(odd.limit(0)).count() == 0
