import pytest

from docloom.llm import kneser_ney as kn


def scored(spark, rows):
    return spark.createDataFrame(rows, "id long, lang string, x double, toxicity double")


def test_limit_is_the_trusted_quantile(spark):
    """However far the poor documents lie, the limit doesn't move towards them."""
    good = [(i, "en", 0.001 * i, 0.002 * i) for i in range(1000)]
    poor = [(2000 + k, "en", 4.0 + k, 50.0 + k) for k in range(200)]
    trusted = spark.createDataFrame([(i,) for i, *_ in good], "label_id long")
    r = kn.thresholds(scored(spark, good + poor), trusted, prior=0.0).first()
    assert r["threshold"] == pytest.approx(2.718281828**0.989, rel=0.005) and r["toxicity_limit"] == pytest.approx(1.99, abs=0.02)


def test_few_trusted_documents_lean_on_all_languages(spark):
    rows = [(i, "en", 0.001 * i, 1.0) for i in range(1000)] + [(2000 + i, "fr", 5.0, 9.0) for i in range(10)]
    trusted = spark.createDataFrame([(r[0],) for r in rows], "label_id long")
    r = {x["lang"]: x for x in kn.thresholds(scored(spark, rows), trusted, prior=30.0).collect()}
    assert r["fr"]["toxicity_limit"] == pytest.approx(9.0, rel=0.002) and 5.0 < __import__("math").log(r["fr"]["threshold"]) < 5.5
