import json

from pyspark.sql import functions as F

from docloom.operators import export, fusion, matching, providers
from docloom.sources import files
from docloom.streaming import quiet


def test_json(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": "1", "createdAt": "x", "data": {"metadata": {"firstAuthor": "Kim", "publicationYear": 2016}}}, {"id": "2", "data": {"population": {"sampleSize": "many"}}}]))
    rows = {r["id"]: r for r in files.read_json(spark, str(tmp_path / "s.json")).collect()}
    assert rows["1"]["data"]["metadata"]["firstAuthor"] == "Kim" and rows["2"]["_corrupt_record"]
    assert files.read_json(spark, str(tmp_path / "none.json")).count() == 0


def test_list_pdfs(spark, tmp_path):
    for n in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r["name"] for r in files.list_pdfs(spark, str(tmp_path)).collect()) == ["a.pdf", "b.PDF"]


def test_append_and_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    for _ in range(2):
        export.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("created_at IS NOT NULL").count() == 2
    export.write_json(df, str(tmp_path / "j"))
    assert spark.read.schema("id long, t string").json(str(tmp_path / "j")).first()["t"] == "a"


def test_stream_of_bursts(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:10:00"), (1, "2024-01-01 12:00:00"), (2, "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "e"))
    live = quiet.bursts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "30 minutes", late="1 hour")
    q = live.writeStream.outputMode("complete").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("bursts").collect())) == sorted(map(tuple, quiet.bursts(df, "30 minutes").collect()))


def test_blocks(spark):
    s = spark.createDataFrame([(1, i, "x" * 30, i * 31, i * 31 + 30) for i in range(10)], "doc_id long, pos int, text string, start_char long, end_char long")
    rows = sorted(matching.text_blocks(s, 50).collect())
    assert [len(r["text"]) for r in rows] == [61] * 5 and rows[-1]["end_char"] == 309


def test_patients(spark):
    n = spark.createDataFrame([(1, 4000)], "study_id long, n long")
    a, b = (fusion.patients(n, 60, 10, 0.001, 1000, 3).toPandas() for _ in range(2))
    assert abs(a["age"].mean() - 60) < 1 and abs(a["age"].std() - 10) < 1 and abs(a["died"].mean() - 0.632) < 0.03
    assert sorted(a["age"]) == sorted(b["age"])


def test_provider(spark):
    d = spark.createDataFrame([(1, "short"), (2, None), (3, "n = 12 " + "x" * 100), (4, "y" * 200)], "doc_id long, text string")
    got = providers.extract_all(providers.Rules(), d)
    assert [tuple(r) for r in got.select("doc_id", "value").collect()] == [(3, "12")]
    assert {r["doc_id"]: r["status"] for r in providers.status(d, got).collect()} == {1: "scanned", 2: "scanned", 3: "extracted", 4: "empty"}
