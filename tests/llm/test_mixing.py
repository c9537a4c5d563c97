import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing
from docloom.llm.common import n_words


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water filling step by step: the excess over a cap is shared anew until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), None if i % 11 == 0 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return [mixing.mix(df, n_words(F.col("text"))).toPandas() for _ in range(2)]


def test_targets(mixed):
    m = mixed[0]
    sizes = {None if isinstance(k, float) else k: int(v) for k, v in m.groupby("source", dropna=False)["size"].sum().items()}
    want = filled(sizes)
    for (source, target), rows in m.groupby(["source", "target"], dropna=False):
        source = None if isinstance(source, float) else source
        assert target == pytest.approx(want[source])
        assert rows["source_size"].iloc[0] == sizes[source]
        assert abs(rows["taken"].sum() - target) <= rows["size"].max()


def test_limits_and_reruns(mixed):
    a, b = (m.sort_values("doc_id")["taken"].tolist() for m in mixed)
    assert a == b
    assert (mixed[0]["taken"] <= 2 * mixed[0]["size"]).all()
    assert len(a) == 3000


def test_small_leaves_form_a_tree(spark):
    items = spark.range(500).select(F.col("id").alias("key"), F.lit(0).cast("long").alias("nth"), F.lit("s").alias("source"), (F.col("id") % 50 + 1).alias("size"), F.lit(0.3).alias("chance"), F.lit(500).cast("long").alias("n"))
    out = mixing.round_copies(items, leaf=16).toPandas()
    assert len(out) == 500 and set(out["taken"]) <= {0, 1}
    assert abs((out["taken"] * out["size"]).sum() - 0.3 * out["size"].sum()) <= 50


def test_settle_keeps_the_sum_and_the_mean():
    sizes, chances = [5, 3, 8, 1, 9, 2], [0.2, 0.7, 0.5, 0.9, 0.1, 0.4]
    total, mean = sum(s * c for s, c in zip(sizes, chances)), np.zeros(6)
    for seed in range(4000):
        f, held = mixing.settle(range(6), sizes, chances, seed, False)
        assert sum(s * c for s, c in zip(sizes, f)) == pytest.approx(total)
        assert sum(0 < x < 1 for x in f) <= 1
        mean += f
    assert mean / 4000 == pytest.approx(chances, abs=0.04)


def test_common_chance_leaves_the_smallest():
    sizes, mean = [900, 40, 30, 300, 7, 5, 60, 3], np.zeros(8)
    for seed in range(4000):
        f, held = mixing.settle(range(8), sizes, [0.35] * 8, seed, False)
        assert sum(s * c for s, c in zip(sizes, f)) == pytest.approx(0.35 * sum(sizes))
        assert sum(0 < x < 1 for x in f) <= 1
        mean += f
    assert mean / 4000 == pytest.approx([0.35] * 8, abs=0.04)
    sizes = [500, *[20] * 100, 2]
    assert all(mixing.settle(range(102), sizes, [0.35] * 102, seed, False)[1] != 0 for seed in range(200))


def test_one_id_for_many_rows(spark):
    """Rows without an id are documents of their own, dealt to many leaves."""
    df = spark.range(9000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'s' || (id % 2) AS source", "1 + id % 40 AS size", "5 AS nth", "6 AS leaf")
    got = [mixing.mix(df, F.col("size")).toPandas() for _ in range(2)]
    key = ["source", "size", "nth", "copies"]
    assert len(got[0]) == 9000 and got[0][key].sort_values(key).values.tolist() == got[1][key].sort_values(key).values.tolist()
    for _, rows in got[0].groupby("source"):
        assert abs(rows["taken"].sum() - rows["target"].iloc[0]) <= 40


def test_odd_rows(odd):
    m = mixing.mix(odd, n_words(F.col("text")))
    assert m.count() == odd.count()
    assert m.where("size = 0 AND taken > 0").count() == 0
    assert mixing.mix(odd.limit(0), n_words(F.col("text"))).count() == 0
