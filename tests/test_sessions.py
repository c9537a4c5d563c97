import json

import pytest

from docloom.sources import sessions

TURNS = "session_id string, thread string, turn long, role string, content string"
ROWS = [("a", "main", 0, "user", "hi"), ("a", "main", 1, "model", "hello"), ("a", "side", 0, "user", "x"), ("b/../c", "main", 0, "user", None), ("d", "main", 0, "user", "bye")]


@pytest.fixture
def store(spark, tmp_path):
    return sessions.Store(spark, str(tmp_path / "store"))


def ids(df):
    return sorted(r["session_id"] for r in df.collect())


def test_get_list_save_delete(spark, store):
    assert ids(store.list()) == [] == ids(store.sessions()) and store.get("a").count() == 0
    rows = sessions.from_turns(spark.createDataFrame(ROWS, TURNS))
    store.save(rows, 1, "t1")
    assert ids(store.list()) == ["a", "b/../c", "d"]
    a = store.get("a").first()
    assert (a["created_at"], a["updated_at"], [m["content"] for m in a["threads"]["main"]], len(a["threads"])) == ("t1", "t1", ["hi", "hello"], 2)
    store.save(store.get("a").withColumn("state", sessions.F.lit("{}")), 2, "t2")
    store.save(store.get("a"), 2, "t2")  # again, as after a failure
    a = store.get("a").first()
    assert (a["state"], a["created_at"], a["updated_at"]) == ("{}", "t1", "t2")
    store.delete(spark.createDataFrame([("d",), ("never there",)], "session_id string"), 3)
    assert ids(store.list()) == ids(store.sessions()) == ["a", "b/../c"] and store.get("d").count() == 0
    store.save(rows.where("session_id = 'd'"), 4, "t4")
    assert ids(store.list()) == ["a", "b/../c", "d"]


def test_a_look_up_reads_one_folder_with_the_id_pushed_down(spark, store):
    store.save(sessions.from_turns(spark.createDataFrame(ROWS, TURNS)), 1, "t1")
    plan = store.get("a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(session_id,a)" in plan.split("PushedFilters")[1]


def test_compact_keeps_what_counts(spark, store, tmp_path):
    store.save(sessions.from_turns(spark.createDataFrame(ROWS, TURNS)), 1, "t1")
    store.delete(store.list().where("session_id = 'a'"), 2)
    other = store.compact(str(tmp_path / "other"), 3)
    assert ids(other.list()) == ["b/../c", "d"] and spark.read.parquet(other.path).count() == 2


def test_files_and_turns(spark, tmp_path):
    folder = tmp_path / "sessions"
    folder.mkdir()
    (folder / "a_b.json").write_text(json.dumps({"id": "a/b", "state": {"k": [1]}, "threads": {"main": [{"role": "user", "content": "q"}]}, "createdAt": "x", "updatedAt": "y"}, indent=2))
    (folder / "bad.json").write_text("{")
    (folder / "c.json").write_text(json.dumps({"id": "c", "threads": {}}))
    got = {r["session_id"]: r for r in sessions.read_files(spark, str(folder)).collect()}
    assert set(got) == {"a/b", "c"} and got["a/b"]["state"] == '{"k":[1]}' and got["c"]["threads"] == {}
    one = sessions.read_files(spark, str(folder), "a/b")
    assert [r["session_id"] for r in one.collect()] == ["a/b"] and len(one.inputFiles()) == 1
    assert [tuple(r)[:5] for r in sessions.to_turns(one).collect()] == [("a/b", "main", 0, "user", "q")]
