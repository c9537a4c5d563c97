import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import paths

SCHEMA = "study_id long, data string"


def leaves(value, at=()):
    """Leaves of a JSON value by recursion."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, (*at, k))
    elif at:
        yield at, value


def lay(target, source):
    """One source over another, as the recursion has it; a later object takes the place of a plain value."""
    for k, v in source.items():
        if isinstance(v, dict):
            if any(x not in (None, "") for _, x in leaves(v)):
                target[k] = lay(target[k] if isinstance(target.get(k), dict) else {}, v)
        elif v not in (None, ""):
            target[k] = v
    return target


RECORDS = [
    {"a": {"b": {"c": 1, "d": None}, "e": [1, {"x": {"y": 2}}]}, "f": "q\"t\\n\né", "g": True, "h": {}, "i": 1.5},
    {"a.b": {"": {"z": "dots and nothing"}}, "deep": {"1": {"2": {"3": {"4": {"5": "x"}}}}}},
    {}, [1, {"a": 2}], "text {[{[", None, 7,
    {"braces": "{{{{[[[", "a": {"quoted \"key\"": "tab\t"}},
]


def table(spark, rows):
    return spark.createDataFrame([(i, r if isinstance(r, str | None) else json.dumps(r)) for i, r in rows], SCHEMA)


def test_walk_finds_every_leaf(spark):
    df = table(spark, [*enumerate(RECORDS), (50, "no json"), (51, '{"open": ')])
    got = sorted((r[0], tuple(r[1]), json.loads(r[2])) for r in paths.walk(df).select("study_id", "path", F.to_json("value")).collect())
    want = sorted((i, p, v) for i, r in enumerate(RECORDS) if isinstance(r, dict) for p, v in leaves(r))
    assert got == want
    assert paths.levels(df) == 6 and paths.levels(df.limit(0)) == 0 and paths.walk(df.limit(0)).count() == 0


def test_rebuild_gives_back_what_walk_took_apart(spark):
    df = table(spark, enumerate(RECORDS))
    got = {r[0]: json.loads(r[1]) for r in paths.rebuild(paths.walk(df), 6).collect()}
    want = {i: {k: v for k, v in r.items() if v != {}} for i, r in enumerate(RECORDS) if isinstance(r, dict) and r}
    assert got == want


def test_merge_against_recursion(spark):
    sources = [
        (1, [{"a": {"x": 1, "y": {"z": 2}}}, {"a": {"y": {"w": 3}}}, {"a": {"x": None, "y": ""}}, {"b": 0}]),
        (2, [{"a": {"x": 1}}, {"a": "plain"}, {"a": {"y": 2}}, {"a": {"y": {"z": 3}}}]),
        (3, [{"a": {"x": {"y": {"z": 1}}}}, {"a": {"x": 5}}]),
        (4, [{"a": [1, 2]}, {"a": [3]}, {"c": False}]),
        (5, [{"a": "x"}, {"a": {"b": None, "c": ""}}, {"a": {}}]),
        (6, [{}, {"n": None}]),
    ]
    rows = [(i, json.dumps(s), n) for i, all_ in sources for n, s in enumerate(all_)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, n int").repartition(4)
    merged = paths.merge(df, [F.col("n")])
    want = {}
    for i, all_ in sources:
        target = {}
        for s in all_:
            lay(target, s)
        want[i] = target
    assert {r[0]: json.loads(r[1]) for r in merged.collect()} == {i: t for i, t in want.items() if t}
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 2, plan


@pytest.mark.parametrize("a,b,same", [('{"x": 1, "y": [1, 2]}', '{"y": [1,2], "x": 1.0}', True), ('{"y": [2, 1]}', '{"y": [1, 2]}', False), (None, None, True), (None, "{}", False), ('{"a": null}', "{}", False)])
def test_same(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(paths.same(F.col("a"), F.col("b"))).first()[0] is same


def test_fields_with_evidence(spark):
    record = {"population": {"age": {"value": {"mean": 60}, "sourceText": "the mean age was 60"}, "arms": [{"n": {"value": None, "sourceText": None}}]}, "value": 3, "sourceText": {"value": 1, "sourceText": "a source of its own"}}
    df = table(spark, [(1, {k: record[k] for k in ("population",)}), (2, {"top": record})])
    got = {(r[0], r[1]): (r[2], r[3]) for r in paths.verifiable(df).collect()}
    assert got[1, "population.age"] == ('{"mean":60}', "the mean age was 60") and got[1, "population.arms.0.n"] == (None, None)
    # an object with both keys stays whole, with all that is in it
    assert [k for k in got if k[0] == 2] == [(2, "top")]
    texts = spark.createDataFrame([(1, "it says the mean age was 60 or so")], "study_id long, text string")
    assert {(r[1], r[2]) for r in paths.unsupported(paths.verifiable(df.where("study_id = 1")), texts).collect()} == {("population.arms.0.n", "WARNING")}


def test_report_escapes_and_keeps_empty_records(spark):
    df = table(spark, [(1, {"a": {"<b>": {"value": "1 < 2", "sourceText": "\"q\""}, "c": [1]}, "top": 1}), (2, None)])
    marks = spark.createDataFrame([(1, 2, "L&", "it's")], "study_id long, page int, label string, text string")
    got = {r["study_id"]: r for r in paths.report(df, marks, "T").collect()}
    assert (got[1]["n_fields"], got[1]["n_evidence"], got[2]["n_fields"]) == (2, 1, 0)
    html = got[1]["html"]
    assert "a.&lt;b&gt;" in html and "1 &lt; 2" in html and "L&amp;" in html and "it&#39;s" in html and "top" not in html and '<td colspan="2">[1]</td>' in html
