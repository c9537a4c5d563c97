import threading
import time

import pytest

from docloom.operators import running


def test_pauses_grow_and_reruns_wait_as_long():
    p = running.Policy(attempts=6, seed=3)
    pauses = [p.pause("k", i) for i in range(1, 7)]
    assert pauses == [p.pause("k", i) for i in range(1, 7)] and pauses != [p.pause("other", i) for i in range(1, 7)]
    assert all(min(10, 2.0 ** (i - 1)) <= x <= min(10, 2.0 ** (i - 1) + 0.5) for i, x in enumerate(pauses, 1))


@pytest.mark.parametrize("errors,want", [([], (True, "v", None, 1)), (["503", "rate limit"], (True, "v", None, 3)), (["timeout"] * 3, (False, None, "timeout", 3)), (["bad key"], (False, None, "bad key", 1)), (["500", ""], (False, None, "RuntimeError", 2))])
def test_what_is_tried_again(errors, want):
    slept, left = [], list(errors)

    def work(attempt):
        if left:
            raise RuntimeError(left.pop(0))
        return "v"

    got = running.try_one(work, "k", running.Policy(), slept.append)
    assert got[:4] == want and got[4] == sum(slept) and len(slept) == want[3] - 1


def test_every_document_has_a_status(spark):
    def make_client():
        """A client that says how many calls were under way at once."""
        lock, seen = threading.Lock(), {"now": 0, "most": 0}

        def client(doc_id, agent, text, attempt):
            with lock:
                seen["now"] += 1
                seen["most"] = max(seen["most"], seen["now"])
            time.sleep(0.01)
            with lock:
                seen["now"] -= 1
            if doc_id == 3 and agent == "b":
                raise ValueError("no")
            return None if text is None else f"{agent}/{seen['most']}"

        return client

    docs = spark.createDataFrame([(i, "x" * 120) for i in range(40)] + [(50, None), (51, "short")], "doc_id long, text string")
    answers = running.call(running.requests(docs, ("a", "b")).coalesce(1), make_client, running.Policy(at_once=3), together=8)
    got = {r["doc_id"]: r for r in running.together(docs, answers, 2).collect()}
    assert len(got) == 42 and {i for i, r in got.items() if r["status"] == "error"} == {3, 50, 51}
    assert got[3]["message"] == "b: no" and got[3]["data"] is None and got[50]["n_attempts"] == 0
    assert max(int(v.split("/")[1]) for r in got.values() for v in (r["data"] or {}).values()) == 3
    assert {r["status"]: r["n"] for r in running.counts(running.together(docs, answers, 2)).collect()} == {"extracted": 39, "error": 3}
    assert running.together(docs, answers.limit(0), 2).where("status = 'error'").count() == 42
