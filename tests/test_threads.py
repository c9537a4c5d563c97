import random

import pytest
from pyspark.sql import functions as F

from docloom.streaming import threads

TURNS = "session_id string, thread string, turn long, role string, content string"


def test_ranges():
    order = list(range(60))
    random.Random(1).shuffle(order)
    ranges = []
    for i, t in enumerate(order):
        ranges = threads.insert(ranges, t)
        assert sum(b - a + 1 for a, b in ranges) == i + 1 and threads.insert(ranges, t) is None
    assert ranges == [(0, 59)]


def rows_of(df):
    return sorted((r["session_id"], r["thread"], r["n_messages"], r["last_turn"], tuple((t["turn"], t["role"], t["content"]) for t in r["context"])) for r in df.collect())


@pytest.mark.parametrize("order", ["in order", "shuffled"])
def test_stream_equals_replay(spark, tmp_path, order):
    """Micro-batches with late and repeated turns; the stream is stopped after some and goes on from its marks; a batch that is written again changes nothing."""
    rows = [(f"s{s}", th, t, "user" if t % 2 == 0 else "model", f"{s}-{t}") for s in range(4) for th, n in (("main", 9 + s), ("side", 2)) for t in range(n)]
    rows += [("s0", "main", 3, "model", "0-3"), (None, "main", 0, "user", "x"), ("s1", None, 0, "user", "x"), ("s1", "main", None, "user", "x"), ("s9", "main", 7, "model", None)]
    if order == "shuffled":
        random.Random(5).shuffle(rows)
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for part in range(3):
        spark.createDataFrame(rows[part::3], TURNS).coalesce(1).write.mode("append").parquet(source)
        if part != 1:  # two parts wait for the second run
            live = threads.contexts(spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(source), keep=6)
            threads.start(live, out, marks).awaitTermination()
    got = threads.latest(spark, out)
    assert rows_of(got) == rows_of(threads.replay(spark.createDataFrame(rows, TURNS), keep=6))
    last = max((tmp_path / "out").glob("batch=*"), key=lambda p: int(p.name[6:]))
    again = spark.read.parquet(str(last)).withColumn("n_messages", F.col("n_messages"))
    rewritten = again.collect()
    spark.createDataFrame(rewritten, again.schema).write.mode("overwrite").parquet(str(last))
    assert rows_of(threads.latest(spark, out)) == rows_of(got)


def test_first_message_by_the_model_stays_unless_older_ones_were_left_out(spark):
    df = spark.createDataFrame([("a", "main", 0, "model", "x"), ("a", "main", 1, "user", "y"), ("b", "main", 0, "user", "x"), ("b", "main", 1, "model", "y"), ("b", "main", 2, "user", "z")], TURNS)
    assert [(r[0], len(r[4])) for r in rows_of(threads.replay(df, keep=2))] == [("a", 2), ("b", 1)]
