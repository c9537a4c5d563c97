"""Calls to a service for every row of a table: a bounded number at once, retried with growing pauses, and no failure lost or spread.

    asked = running.requests(docs, KINDS)                       # one row per document and agent
    answers = running.call(asked, Client, running.Policy(at_once=4))
    studies = running.together(docs, answers, len(KINDS))        # all agents of a study or none

A row that fails is a row with its error; it ends neither its task nor its study's neighbours. Write answers down before they are used twice, as calls cost money.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "doc_id {id}, agent string, ok boolean, value string, error string, attempts int, waited double"
# What the message of an error says where trying again may help; pauses in seconds.
PASSING = ("429", "rate limit", "500", "503", "timeout", "ETIMEDOUT")


@dataclass(frozen=True)
class Policy:
    """How rows are tried. Pauses grow by `factor` from `first` up to `most`, each with up to `jitter` more that follows from the row, the attempt and `seed`, so a rerun waits as long. at_once: calls of one task at a time; so many times the running tasks are under way in all."""

    attempts: int = 3
    first: float = 1.0
    factor: float = 2.0
    most: float = 10.0
    jitter: float = 0.5
    seed: int = 0
    at_once: int = 2

    def pause(self, key: str, attempt: int) -> float:
        """Seconds to wait after a failed attempt (from 1)."""
        share = int.from_bytes(hashlib.blake2b(f"{self.seed}|{key}|{attempt}".encode(), digest_size=6).digest()) / 2**48
        return min(self.first * self.factor ** (attempt - 1) + self.jitter * share, self.most)


def try_one(work: Callable[[str], str | None], key: str, policy: Policy, sleep: Callable[[float], None] = time.sleep) -> tuple[bool, str | None, str | None, int, float]:
    """(ok, value, error, attempts, seconds waited) of work(key's text); errors that won't pass aren't tried again."""
    waited = 0.0
    for attempt in range(1, policy.attempts + 1):
        try:
            return True, work(attempt), None, attempt, waited
        except Exception as e:  # whatever a client raises belongs to its row
            said = str(e) or type(e).__name__
            if attempt == policy.attempts or not any(p in said for p in PASSING):
                return False, None, said, attempt, waited
            pause = policy.pause(key, attempt)
            sleep(pause)
            waited += pause
    raise ValueError("at least one attempt is needed")


def requests(docs: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """(doc_id, agent, text): each document for each agent."""
    return docs.select("doc_id", F.explode(F.array(*map(F.lit, agents))).alias("agent"), "text")


def call(asked: DataFrame, make_client: Callable[[], Callable], policy: Policy = Policy(), together: int = 64) -> DataFrame:
    """ANSWER: what client(doc_id, agent, text, attempt) says for each row of asked (doc_id, agent, text), or why it says nothing.

    make_client is called once per task, on the executor; the client is called from several threads. Rows are handed on some at a time, so a slow row keeps few others waiting.
    """
    id_type = asked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        with ThreadPoolExecutor(policy.at_once) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, together):
                    part = batch.slice(at, together)
                    rows = list(zip(*[part.column(i).to_pylist() for i in range(3)]))
                    done = list(pool.map(lambda r: try_one(lambda attempt: client(*r, attempt), f"{r[0]}|{r[1]}", policy), rows))
                    ok, value, error, attempts, waited = zip(*done)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(ok), pa.array(value, pa.string()), pa.array(error, pa.string()), pa.array(attempts, pa.int32()), pa.array(waited, pa.float64())],
                        ["doc_id", "agent", "ok", "value", "error", "attempts", "waited"],
                    )

    return asked.select("doc_id", "agent", "text").mapInArrow(run, ANSWER.format(id=id_type))


def together(docs: DataFrame, answers: DataFrame, agents: int, least: int = 100) -> DataFrame:
    """(doc_id, status, message, data: map of agent to value, n_attempts), one row per document: extracted only if all agents answered.

    Texts of under `least` characters are errors that ask no agent (answers for them don't count). Of several failures the message names the first agent by name, with its error.
    """
    failed = F.min(F.when(~F.col("ok"), F.struct("agent", "error")))
    said = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("agent", "value")))))
    per = answers.groupBy("doc_id").agg(F.count_if(F.col("ok")).alias("n_ok"), failed.alias("f"), said.alias("data"), F.sum("attempts").alias("n_attempts"))
    short = F.coalesce(F.length("text"), F.lit(0)) < least
    whole = F.coalesce(F.col("n_ok") == agents, F.lit(False))
    status = F.when(short | ~whole, "error").otherwise("extracted")
    message = F.when(short, "PDF appears empty or contains minimal text (possible scanned PDF)").when(F.col("f").isNotNull(), F.concat("f.agent", F.lit(": "), "f.error")).when(~whole, "not all agents answered")
    rows = docs.select("doc_id", "text").join(per, "doc_id", "left")
    return rows.select("doc_id", status.alias("status"), message.alias("message"), F.when(~short & whole, F.col("data")).alias("data"), F.when(short, 0).otherwise(F.coalesce("n_attempts", F.lit(0))).cast("long").alias("n_attempts"))


def counts(studies: DataFrame) -> DataFrame:
    """(status, n, n_attempts): how a batch went."""
    return studies.groupBy("status").agg(F.count("*").alias("n"), F.sum("n_attempts").alias("n_attempts"))
