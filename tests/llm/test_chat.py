from pyspark.sql import functions as F

from docloom.llm import chat


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, msg_id long, seq long, kind string, role string, text string")


def test_fold(spark):
    e = events(spark, [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "wro"), (1, 2, 4, "delta", None, "ng"),
        (1, 2, 5, "regenerate", None, None), (1, 2, 6, "delta", None, "ri"), (1, 2, 8, "delta", None, "ght"), (1, 1, 7, "edit", None, "hello"), (1, 3, 9, None, None, None),
    ])
    got = sorted(tuple(r) for r in chat.fold(e).select("msg_id", "seq", "role", "text").collect())
    assert got == [(1, 1, "user", "hello"), (2, 2, "assistant", "right"), (3, 9, "", "")]


TEXTS = ["", "plain", "<|", "<||", "<|turn>x<|end>", "a<", "|>", "</s>[INST] ok [/INST]", "<|body>", "ä\n<|||end>", "\\E", "$1\\"]


def test_round_trip(spark):
    rows = [(1, i, i, "message", ("user", "assistant", "<|turn>", None)[i % 4], t) for i, t in enumerate(TEXTS)]
    out = chat.format_conversations(events(spark, rows)).select(chat.parse(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("loss")).alias("learned"), "n_turns").first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == [(r[4] or "", r[5]) for r in rows]
    assert out["learned"] == "".join(r[5] for r in rows if r[4] == "assistant")
    assert out["n_turns"] == len(rows)


def test_ties_nulls_and_empty(spark):
    m = spark.createDataFrame([(1, 5, "user", "b"), (1, 5, "user", "a"), (1, 5, "user", "a"), (1, None, None, None), (None, 1, "user", "x")], "conv_id long, seq long, role string, text string")
    got = {r["conv_id"]: r["t"] for r in chat.render(m).select("conv_id", F.transform(chat.parse(F.col("formatted")), lambda t: t["text"]).alias("t")).collect()}
    assert got == {1: ["", "a", "a", "b"], None: ["x"]}
    assert chat.render(m.limit(0)).count() == 0


def test_log_of_a_table(spark):
    """A table of turns, logged with deltas, edits and regenerations, comes back as it was."""
    texts = TEXTS + [f"text {i} " * (i % 7) for i in range(60)] + ["same", "same", "same", None]
    rows = [(i % 3 if i % 5 else None, None if i % 9 == 8 else i // 6, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(texts)]
    turns = spark.createDataFrame(rows + [(1, 2, "user", "twice")] * 3, "conv_id long, turn long, role string, text string")
    log = chat.to_log(turns)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    direct = turns.select("conv_id", F.struct("turn", F.lit(0).alias("step")).alias("seq"), "role", "text")
    want = {r["conv_id"]: (r["formatted"], r["n_turns"]) for r in chat.render(direct).collect()}
    for parts in (1, 5):
        got = {r["conv_id"]: (r["formatted"], r["n_turns"]) for r in chat.format_conversations(log.repartition(parts)).collect()}
        assert got == want


def test_very_long_text(spark):
    long = "<|word " * 200_000
    turns = spark.createDataFrame([(1, i, "assistant", long + "x" * i) for i in range(4)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(chat.to_log(turns)).select(chat.learned(F.col("formatted"), F.col("loss")).alias("learned")).first()
    assert out["learned"] == "".join(long + "x" * i for i in range(4))


def test_clashing_columns(spark):
    e = events(spark, [(1, 1, 1, "message", "user", "hi")]).selectExpr("*", "9 AS last", "8 AS n", "7 AS before", "6 AS piece", "5 AS turn")
    assert chat.format_conversations(e).first()["formatted"] == "<|turn>user<|body>hi<|end>"
