"""Costly steps happen once a row, not once for every use of what they give."""

from docloom.operators import matching, paths, spans


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_parsed_once(spark):
    records = spark.createDataFrame([(1, '{"a": {"value": "long", "sourceText": null}, "b": "no", "c": {"d": 1234}}'), (2, "no json"), (3, None)], "study_id long, data string")
    df = paths.searchable(records, ["a", "b", "c.d", "a"])
    assert sorted(map(tuple, df.collect())) == [(1, "a", "long"), (1, "c.d", "1234")]
    assert optimised(df).count("parseJson") == 1
    assert optimised(paths.values_at(records, ["a", "b", "c.d"])).count("parseJson") == 1


def cleaned_above_join(df):
    """Whether the join itself, or what stands above it, cleans texts."""
    lines = optimised(df).split("\n")
    at = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    return any("regexp_replace" in line for line in lines[: at + 1])


ODD = "Alpha\tBETA-x\n gamma  (delta) ünd _e1 it's\x0bend"


def test_containment_cleans_a_block_once(spark):
    quotes = spark.createDataFrame([(1, 1, 1, "betax; its ND end"), (1, 2, 1, "?!"), (1, 3, 1, "alpha beta gamma nope"), (1, 4, 1, None)], "doc_id long, quote_id int, page int, quote string").coalesce(1)
    blocks = spark.createDataFrame([(1, 1, 0, "nothing"), (1, 1, 1, ODD), (1, 1, 2, ODD), (1, 1, 3, None)], "doc_id long, page int, block int, text string").coalesce(1)
    df = spans.containment(quotes, blocks)
    assert sorted(map(tuple, df.collect())) == [(1, 1, 1, 1.0), (1, 3, 1, 0.75)]
    assert not cleaned_above_join(df)


def test_fuzzy_cleans_a_block_once(spark):
    quotes = spark.createDataFrame([(1, 1, "betax; its end END"), (1, 2, "?!"), (1, 3, "alpha beta gamma"), (1, 4, None)], "doc_id long, quote_id int, quote string").coalesce(1)
    blocks = spark.createDataFrame([(1, 0, "alpha"), (1, 1, ODD), (1, 2, ODD), (1, 3, None)], "doc_id long, block int, text string").coalesce(1)
    df = matching.fuzzy(quotes, blocks, 0.4, 1)
    assert sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in df.collect()) == [(1, 1, 1, 0.0, 1), (1, 3, 1, 0.333333, 1)]
    assert not cleaned_above_join(df)


def test_smart_meets_the_blocks_once(spark):
    quotes = spark.createDataFrame([(1, 1, "X\n GAMMA  (d"), (1, 2, "(d"), (1, 3, "gamma delta nope alpha"), (1, 4, "nowhere"), (1, 5, None), (2, 1, "alpha")], "doc_id long, quote_id int, quote string").coalesce(1)
    blocks = spark.createDataFrame([(1, 0, "alpha"), (1, 1, ODD), (1, 2, ODD), (1, 3, None)], "doc_id long, block int, text string").coalesce(1)
    df = matching.smart(quotes, blocks)
    assert sorted(map(tuple, df.collect())) == [(1, 1, "exact", 1, 1.0), (1, 2, "exact", 1, 1.0), (1, 3, "fuzzy", 1, 0.75), (1, 4, "none", None, 0.0), (1, 5, "none", None, 0.0), (2, 1, "none", None, 0.0)]
    assert optimised(df).count("Join Inner") == 1 and not cleaned_above_join(df)
