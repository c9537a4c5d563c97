"""Hand-traced cases."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import chunking, evaluation, export, fusion, retrieval, rules, spans, tables


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("r")).first()["r"]


def test_tokens(spark):
    assert [one(spark, tx.estimate_tokens(F.lit(t))) for t in ("", "abcd", "abcde")] == [0, 1, 2]


@pytest.mark.parametrize(("text", "expected"), [
    ("One. Two! three. Four", ["One.", "Two! three.", "Four"]),
    ("Dr. Smith came. He left.", ["Dr. Smith came.", "He left."]),
    ("p was 3.5 here. Next", ["p was 3.5 here.", "Next"]),
    ("", []),
])
def test_sentences(spark, text, expected):
    assert one(spark, tx.sentences(F.lit(text))) == expected


def test_paragraphs(spark):
    assert one(spark, tx.paragraphs(F.lit("a\n\nb\n  c"))) == ["a", "b", "c"]


@pytest.mark.parametrize(("text", "expected"), [("Methods: x", "methods"), ("Methods", None), ("TABLE 2", "tables"), ("x\nResults: ", None)])
def test_section(spark, text, expected):
    assert one(spark, tx.section_of(F.lit(text))) == expected


@pytest.mark.parametrize(("text", "days"), [("90 days", 90), ("3 months", 90), ("1 year", 365), ("135d", 135), ("30-day", None), ("", None)])
def test_days(spark, text, days):
    assert one(spark, tx.parse_days(F.lit(text))) == days


@pytest.mark.parametrize(("days", "standard"), [(60, 30), (135, 90), (272, 180), (273, 365), (None, None)])
def test_standard_days(spark, days, standard):
    assert one(spark, tx.standard_days(F.lit(days).cast("long"))) == standard


@pytest.mark.parametrize(("text", "share"), [("15%", 0.15), ("15/100", 0.15), ("15 of 100 patients died", None), ("1/0", None)])
def test_mortality(spark, text, share):
    assert one(spark, tx.parse_mortality(F.lit(text))) == share


@pytest.mark.parametrize(("text", "strict", "hits"), [("12/20 (60%)", True, 1), ("12/20 (60%)", False, 0), ("60% (12/20)", True, 0), ("15.3% (24/156)", True, 0), ("50% (12/20)", False, 1)])
def test_arithmetic(spark, text, strict, hits):
    df = spark.createDataFrame([(1, text)], "study_id long, mortality string")
    assert rules.arithmetic(df, strict=strict).count() == hits


@pytest.mark.parametrize(("scores", "score"), [((4, 2, 3, 9), 1.0), ((5, 2, 3, 10), 0.5), ((3, 1, 2, 7), 0.5), ((None,) * 4, 1.0)])
def test_nos(spark, scores, score):
    assert one(spark, rules.nos(*[F.lit(x).cast("int") for x in scores])["score"]) == score


def test_jaccard_truncate_cells(spark):
    assert one(spark, tx.jaccard(F.lit("A b c"), F.lit("b c d"))) == 0.5
    assert len(one(spark, tx.truncate(F.lit("x" * 201)))) == 200
    assert one(spark, tables.cells(F.lit("| a | | b |"), keep_empty=False)) == ["a", "b"]
    assert one(spark, tables.cells(F.lit("| a | | b |"))) == ["a", "", "b"]
    assert one(spark, tx.table_kind(F.array(F.lit("Percentage")))) == "demographics"
    assert one(spark, tx.table_kind(F.array(F.lit("GCS")))) == "baseline"


def test_chunks_cover_and_overlap(spark):
    df = spark.createDataFrame([(1, "".join(chr(97 + i % 26) for i in range(1000))), (2, ""), (3, None), (4, "abc")], "doc_id long, text string")
    rows = sorted(chunking.fixed_chunks(df, 50, 10).collect())
    one_ = [r for r in rows if r["doc_id"] == 1]
    assert one_[0]["char_start"] == 0 and one_[-1]["char_end"] == 1000
    assert all(b["char_start"] == a["char_end"] - 40 for a, b in zip(one_, one_[1:]))
    assert [r["doc_id"] for r in rows if r["doc_id"] != 1] == [4]
    with pytest.raises(ValueError):
        chunking.fixed_chunks(df, 10, 10)


def test_semantic_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 396), (2, "x" * 397), (3, "a" * 300 + "\n\n" + "b" * 300 + "\n\n" + "c" * 300)], "doc_id long, text string")
    got = {}
    for r in sorted(chunking.semantic_chunks(df, 150, 60, 0).collect()):
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[3] == ["a" * 300 + "\n\n" + "b" * 300, "c" * 300]
    assert chunking.semantic_chunks(df.where("doc_id = 1"), 150, 100, 0).count() == 0
    assert chunking.semantic_chunks(df.where("doc_id = 2"), 150, 100, 0).count() == 1


def test_merge_boxes(spark):
    boxes = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), b)]) for b in ((0, 0, 10, 10), (15, 1, 20, 11), (40, 0, 50, 10))])
    assert [tuple(b) for b in one(spark, spans.merge_boxes(boxes))] == [(0, 0, 20, 11), (40, 0, 50, 10)]


def test_overlap_clips(spark):
    c = spark.createDataFrame([(1, 1, 3, 8)], "doc_id long, cite_id int, c_start long, c_end long")
    s = spark.createDataFrame([(1, 0, "abcde", 0, 5, 1, 0, 0, 50), (1, 1, "fghi", 6, 10, 1, 60, 0, 40)], "doc_id long, pos int, text string, start_char long, end_char long, page long, x long, y long, width long")
    assert sorted(r["text"] for r in spans.overlap(c, s).collect()) == ["de", "fg"]


def test_confidence(spark):
    issues = spark.createDataFrame([(1, "CRITICAL"), (1, "WARNING"), (1, "WARNING")], "study_id long, severity string")
    critics = spark.createDataFrame([(k, 0.86875) for k in (1, 2)] + [(3, 0.0)], "study_id long, confidence double")
    anchored = spark.createDataFrame([(1, True), (2, True)], "study_id long, anchored boolean")
    got = {r["study_id"]: round(r["confidence"], 5) for r in rules.verdict(issues, anchored, critics).collect()}
    assert got == {1: 0.56875, 2: 0.86875, 3: 0.5}


def test_weights(spark):
    parts = {"a": (F.lit(1.0), 0.3), "b": (F.lit(1.0), 0.3), "c": (F.lit(0.5), 0.15), "d": (F.lit(None).cast("double"), 0.25)}
    assert one(spark, evaluation.weighted_score(parts)) == 0.9


def test_window_and_markers(spark):
    t = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "model", "") for i in range(21)], "conv_id long, turn long, role string, text string")
    assert retrieval.recent_turns(t).count() == 19
    chunks = spark.createDataFrame([(r, i) for r in (1, 2) for i in (1, 2, 3)], "response_id long, idx int")
    said = spark.createDataFrame([(1, "x [2] y [9]"), (2, "no marker")], "response_id long, text string")
    assert sorted(map(tuple, retrieval.inline_citations(said, chunks).collect())) == [(1, 2), (2, 1), (2, 2), (2, 3)]


def test_fusion(spark):
    v = spark.createDataFrame([(1, "m", "main-paper", 0, "15%"), (1, "m", "erratum", 1, "18%"), (2, "m", "registry", 0, "a"), (2, "m", "protocol", 1, "b")], "study_id long, field string, source string, pos long, value string")
    assert {r["study_id"]: r["value"] for r in fusion.resolve(v).collect()} == {1: "18%", 2: "a"}
    assert fusion.conflicts(v).count() == 2


def test_citation_quality(spark):
    df = spark.createDataFrame([("A", "T", "J", "2016", None)], "authors string, title string, journal string, year string, doi string")
    assert df.select(export.citation_quality() >= 0.85).first()[0]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "id long, t string")
    export.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, export.read_csv(spark, str(tmp_path / "c"), "id long, t string").collect())) == [(1, 'a "quoted", text'), (2, None)]
