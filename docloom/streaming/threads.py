"""Chat threads as the state of a stream: turns are appended, the model's context stays bounded.

    live = threads.contexts(turns)                      # a stream of (session_id, thread, turn, role, content)
    threads.start(live, "/data/contexts", "/data/marks")  # one folder per micro-batch; a batch that runs again replaces its own
    threads.latest(spark, "/data/contexts")

State is kept per (session_id, thread): the last turns as a list, and which turns have been seen as ranges, so that turns may come late, out of order or several times.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CONTEXT = "session_id string, thread string, n_messages long, last_turn long, context array<struct<turn: long, role: string, content: string>>"
#: transformWithState needs this kind of state store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def insert(ranges: list[tuple[int, int]], turn: int) -> list[tuple[int, int]] | None:
    """Ascending ranges (first, last) with one turn more; None where it is there already."""
    out, lo, hi = [], turn, turn
    for a, b in ranges:
        if a <= turn <= b:
            return None
        if b == turn - 1:
            lo = a
        elif a == turn + 1:
            hi = b
        else:
            out.append((a, b))
    return sorted([*out, (lo, hi)])


class Threads(StatefulProcessor):
    """Appends turns to their thread and hands on its context after every micro-batch that brought one."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, content string")
        self.seen = handle.getValueState("seen", "ranges array<struct<a: long, b: long>>")

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        import pandas as pd

        ranges = [(r[0], r[1]) for r in self.seen.get()[0]] if self.seen.exists() else []
        held = {r[0]: (r[0], r[1], r[2]) for r in self.turns.get()} if self.turns.exists() else {}
        fresh = False
        for batch in rows:
            for turn, role, content in sorted(zip(batch["turn"].tolist(), batch["role"], batch["content"]), key=lambda x: (x[0], str(x[1]), str(x[2]))):
                more = insert(ranges, turn)
                if more is None:
                    continue
                ranges, fresh = more, True
                held[turn] = (turn, role, content)
                if len(held) > self.keep:
                    del held[min(held)]
        if fresh:
            last = [held[t] for t in sorted(held)]
            self.turns.put(last)
            self.seen.update(([(a, b) for a, b in ranges],))
            n = sum(b - a + 1 for a, b in ranges)
            shown = last[1:] if n > self.keep and last[0][1] == "model" else last
            yield pd.DataFrame({"session_id": [key[0]], "thread": [key[1]], "n_messages": [n], "last_turn": [ranges[-1][1]], "context": [[{"turn": t, "role": r, "content": c} for t, r, c in shown]]})

    def close(self) -> None:
        pass


def contexts(turns: DataFrame, keep: int = 20) -> DataFrame:
    """A stream of CONTEXT: for each thread with new turns its number of messages and its last `keep`, without a first one by the model where older ones have been left out.

    turns: a stream of (session_id, thread, turn long from 0, role, content). A turn counts once, as it came first (within a micro-batch: the first by role and content); rows without a session, thread or turn
    are left out. A late turn that is older than the context counts, but isn't shown. State per thread: `keep` turns and the ranges of turns seen.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = turns.select("session_id", "thread", F.col("turn").cast("long").alias("turn"), "role", "content").where("session_id IS NOT NULL AND thread IS NOT NULL AND turn IS NOT NULL")
    return rows.groupBy("session_id", "thread").transformWithStateInPandas(Threads(keep), CONTEXT, "Update", "None")


def start(live: DataFrame, path: str, marks: str, **trigger) -> StreamingQuery:
    """Write a stream of contexts below path, a folder per micro-batch. A batch that runs again after a failure replaces its folder, so nothing is there twice. marks: the stream's checkpoint. trigger: as writeStream.trigger takes."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return live.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", marks).trigger(**trigger or {"availableNow": True}).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last context of each thread below path."""
    rows = spark.read.schema(f"{CONTEXT}, batch int").parquet(path)
    columns = ("n_messages", "last_turn", "context")
    return rows.groupBy("session_id", "thread").agg(F.max_by(F.struct(*columns), "batch").alias("l")).select("session_id", "thread", *[f"l.{c}" for c in columns])


def replay(turns: DataFrame, keep: int = 20) -> DataFrame:
    """What a stream of all these turns ends with, from the whole table at once."""
    rows = turns.where("session_id IS NOT NULL AND thread IS NOT NULL AND turn IS NOT NULL").groupBy("session_id", "thread", F.col("turn").cast("long").alias("turn")).agg(F.min(F.struct("role", "content")).alias("m"))
    w = Window.partitionBy("session_id", "thread")
    last = rows.withColumn("n_messages", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("turn")))).where(F.col("r") <= keep)
    turn = F.struct("turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
    out = last.groupBy("session_id", "thread").agg(F.max("n_messages").alias("n_messages"), F.max("turn").alias("last_turn"), F.sort_array(F.collect_list(turn)).alias("c"))
    late = (F.col("n_messages") > keep) & (F.col("c")[0]["role"] == "model")
    return out.select("session_id", "thread", "n_messages", "last_turn", F.when(late, F.slice("c", 2, F.size("c"))).otherwise(F.col("c")).alias("context"))
