import random
import re

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import phrases


def test_key_phrases_are_those_of_the_patterns(spark):
    rng = random.Random(3)
    words = ["mortality", "Mortality rate", "outcomes", "outcome", "12.5%", "n = 40", "P<0.01", "3 ± 1.5", "4 - 7", "5 (3 - 9)", "GCS", ".", ". ", "1.5", "of", "the", "edema", "x" * 160]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(200)] + ["", ".", "no end of it: hydrocephalus"]

    def plain(t):
        out = [m for p in tx.PHRASES for m in re.findall(p, t, re.A)]
        out += [m for w in tx.TERMS for m in re.findall(rf"(?i)[^.]*\b{w}\b[^.]*\.?", t, re.A) if 10 < len(m) < 150]
        return [p for p in dict.fromkeys(out) if len(p) > 3]

    got = dict(tuple(r) for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tx.key_phrases(F.col("text"))).collect())
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert spark.range(1).select(tx.key_phrases(F.lit(None).cast("string"))).first()[0] is None


def test_uncovered_against_pairs():
    rng = random.Random(4)
    for _ in range(200):
        hits = [(rng.randrange(3), rng.randrange(4), "p", s, s + rng.randrange(1, 9)) for s in rng.choices(range(20), k=rng.randrange(12))]
        want = [h for i, h in enumerate(sorted(hits)) if not any(g[3] <= h[3] and g[4] >= h[4] for g in sorted(hits)[:i])]
        assert phrases.uncovered(hits) == want


def test_occurrences_and_markers(spark):
    responses = spark.createDataFrame([(1, "AAAA says 12.5% and 12.5%[7] İ 12.5%"), (2, None), (3, ""), (4, "nothing here")], "response_id long, text string")
    asked = spark.createDataFrame([(1, 1, 0, "aa"), (1, 2, 0, "12.5%"), (1, 2, 1, "2.5%"), (1, 3, 0, "12.5%"), (2, 1, 0, "x"), (4, 1, 0, ""), (4, 1, 1, "absent"), (9, 1, 0, "no response")], "response_id long, idx int, nth int, phrase string")
    got = sorted(tuple(r) for r in phrases.occurrences(responses, asked).collect())
    assert [(r[1], r[2], r[4]) for r in got if r[1] < 3] == [(1, 0, 0), (1, 0, 2), (2, 0, 10), (2, 0, 20), (2, 0, 31), (2, 1, 11), (2, 1, 21), (2, 1, 32)]
    apart = phrases.occurrences(responses, asked, apart=True)
    assert sorted((r["idx"], r["start"]) for r in apart.collect()) == [(1, 0), (1, 2), (2, 10), (2, 20), (2, 31)]
    text = {r["response_id"]: r["marked"] for r in phrases.marked(responses, apart).collect()}
    assert text == {1: "AA[1]AA[1] says 12.5%[2] and 12.5%[7] İ 12.5%[2]", 2: None, 3: "", 4: "nothing here"}
    share = {r["response_id"]: r for r in phrases.supported_share(responses, apart).collect()}
    assert share[1]["n_supports"] == 5 and abs(share[1]["share"] - 19 / 36) < 1e-9 and share[3]["share"] == 0 and share[4]["n_sources"] == 0
