import math

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import hard_negatives as hn

ROW = "vec_id long, embedding array<double>, label int, dim int, part string"


def brute(rows, every, positives=5, negatives=10):
    """The contract by comparing every anchor with every row; exact, as Python's integers are."""
    one = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in v) < 2**62:
            one[i] = min(one.get(i, (label, v)), (label, v))
    out = []
    for a, (label, q) in one.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, own == label) for i, (own, v) in one.items() if i != a and len(v) == len(q))
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            fits = [(s, i) for s, i, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every, **index):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], ROW)
    return sorted(map(tuple, hn.mine(df, F.col("label"), F.col("vec_id") % every == 0, **index).collect()))


def test_clusters_against_brute_force(spark):
    """Clusters of very uneven sizes, one with over half of the rows (more than one part), ties, and lists that bounds skip."""
    rng = np.random.default_rng(3)
    of = np.minimum(rng.geometric(0.5, 9000), 30)
    x = np.round(3 * rng.normal(size=(31, 6))[of] + 0.2 * rng.normal(size=(9000, 6)), 1)
    rows = [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(x, rng.integers(0, 4, 9000)))]
    got = mined(spark, rows, 900, clusters=40)
    assert got == brute(rows, 900) and len(got) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (3, [9.0, 9.0], 7), (4, [0.4, 0.5], 3)]
    rows += [(5, None, 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (12, [], 1), (13, [1e300, 1.0], 1), (14, [1e-200, 0.5], 2)]
    rows += [(100, [1.0, 2.0, 3.0], 1), (101, [1.0, 2.0, 3.0], 1), (102, [0.5, 1.0, 1.5], 2), (200, [0.0, 0.0], 1), (300, [-1.0, -1.0], 1)]
    assert mined(spark, rows, 100) == brute(rows, 100) != []
    empty = spark.createDataFrame([], ROW)
    assert hn.mine(empty, F.col("label"), F.col("vec_id") % 2 == 0).count() == 0


def test_large_products_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 2e6).tolist(), int(i % 3)) for i in range(300)]
    assert mined(spark, rows, 50) == brute(rows, 50) != []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, c, q = rng.integers(-500, 500, (200, 8)), rng.integers(-500, 500, 8).astype(float), rng.integers(-500, 500, 8).astype(float)
    low, high = hn._bounds(q, c[None, :], np.array([float(((x - c) ** 2).sum(axis=1).max())]))
    assert (x @ q >= low).all() and (x @ q <= high).all()
