import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages(spark):
    import corpus_pipeline as p
    from docloom.llm import common, ngram_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for i, (_, stage) in enumerate(p.STAGES):
        before = docs
        docs = common.materialise(stage(spark, docs, SF), f"test{i}")
        seen.append(docs.count())
        if i < len(p.STAGES) - 1:
            assert docs.columns == list(p.COLUMNS)
        if i == 1:
            assert ngram_join.similar(docs).where("n_links > 0").count() == 0
        if i == 2:
            assert docs.count() == before.count() and docs.where("text LIKE '%@%.com%'").count() == 0
        if i == 3:
            assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
    assert 0.6 * seen[0] < seen[2] <= seen[1] < seen[0] and seen[3] == seen[2] and seen[5] > 0


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


def test_odd_rows_and_clashing_columns(spark, odd, tmp_path):
    import corpus_pipeline as p

    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 1, None), (6, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    clash = odd.selectExpr("*", "1 AS size", "2 AS node", "3 AS root", "'x' AS threshold", "5 AS copies", "6 AS block", "7 AS mid", "8 AS kept", "9 AS key", "10 AS kind", "11 AS nth")
    clash.write.parquet(str(tmp_path / "documents.parquet"))
    rows = p.run(spark, str(tmp_path)).collect()
    assert rows and all(r["n_tokens"] <= 2048 for r in rows)
    none = tmp_path / "none"
    odd.limit(0).write.parquet(str(none / "documents.parquet"))
    labels.limit(0).write.parquet(str(none / "labels.parquet"))
    assert p.run(spark, str(none)).count() == 0


def test_mixture_of_repeated_rows(spark):
    """Taken on its own, the stage keeps near its targets also where rows repeat."""
    import corpus_pipeline as p
    from docloom.llm import common, mixing
    from pyspark.sql import functions as F

    rows = [(i % 40 if i % 3 else None, "w " * (i % 25 + 1), "en", f"s{i % 2}", 0) for i in range(900)]
    docs = spark.createDataFrame(rows + [(7, "w " * 9, "en", "s0", 0)] * 300, "doc_id long, text string, lang string, source string, n_chars long")
    out = p.mixture(spark, docs, "")
    size = common.n_words(F.col("text"))
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    per = docs.groupBy("source").agg(F.sum(size).alias("source_size"))
    for r in mixing.source_targets(per).collect():
        assert abs(got[r["source"]] - r["target"]) <= 25
