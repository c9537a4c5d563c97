import numpy as np
from pyspark.sql import functions as F

from docloom.llm import ann


def exact(ids, x, queries, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in queries:
        s = u @ u[q]
        out[ids[q]] = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]
    return out


def test_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)) + 2 * rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=700).toPandas()
    want = exact(list(range(3000)), x, range(0, 3000, 50), 5)
    assert len(got) == 300 and set(got["rank"]) == {1, 2, 3, 4, 5}
    hits = sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / 300 >= 0.95
    for r in got.head(20).itertuples():
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt(a @ a * (b @ b))) < 1e-12


def test_recall_on_clusters_over_shards(spark):
    """The registered settings, on tight clusters, some far larger than others, over four shards."""
    rng = np.random.default_rng(7)
    of = np.minimum(rng.geometric(0.02, 14_000), 200)
    x = rng.normal(size=(201, 32))[of] + 0.05 * rng.normal(size=(14_000, 32))
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, dim int, shard int")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    want = exact(list(range(14_000)), x, range(0, 14_000, 50), 5)
    hits = sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id"))
    assert len(got) == 1400 and hits / 1400 >= 0.97


def test_graph():
    """Every node is linked, links hold no node itself and none twice, and search by graph alone comes near the exact answer."""
    rng = np.random.default_rng(2)
    x = ann._unit(rng.normal(size=(1500, 16)))
    levels, graph = ann.build_graph(x, 16, 64, 0)
    for level, links in enumerate(graph):
        for i, row in enumerate(links):
            own = row[row >= 0]
            assert len(set(own)) == len(own) and i not in own and (levels[own] >= level).all()
        assert level or (links[:, 0] >= 0).all()
    assert [len(ann.build_graph(x[:n], 16, 64, 0)[0]) for n in (1, 2, 3)] == [1, 2, 3]


def test_copies_odd_rows_and_few(spark):
    one, nan, inf = [1.0, 0.0], float("nan"), float("inf")
    rows = [(i, one) for i in range(20)] + [(50, [1.0, 0.1]), (100, None), (101, []), (102, [0.0, 0.0]), (103, [None, 1.0]), (104, [nan, 1.0]), (105, [inf, 1.0]), (150, [1.0, 2.0, 3.0]), (None, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % 50 == 0).collect()):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_ids_and_extreme_norms(spark):
    """An id in several rows is asked and found once; neither tiny nor huge components spoil a cosine."""
    rows = [(i, [1.0, i / 10]) for i in range(1, 8)] + [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [2.0, 9.0]), (3, [1.0, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(i, i) for i in range(1, 6)]
    rows = [(50, [1.0, 0.0]), (1, [1e-200, 0.0]), (2, [1e300, 1e300]), (3, [1e-310, 1e-310]), (4, [0.0, 1e200]), (5, [-1e-200, 0.0])]
    got = {r["vec_id"]: r["score"] for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50).collect()}
    assert got == {1: 1.0, 2: got[2], 3: got[3], 4: 0.0, 5: -1.0} and abs(got[2] - 0.5**0.5) < 1e-15 and abs(got[3] - 0.5**0.5) < 1e-9
