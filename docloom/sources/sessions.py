"""Chat sessions: rows of turns, the files that a chat service keeps, and a store for them.

Turns are (session_id, thread, turn, role, content, updated_at). A stored session is (session_id, state: JSON, threads: map of thread to its turns, created_at, updated_at).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THREADS = "map<string, array<struct<role: string, content: string>>>"
SESSION = f"session_id string, state string, threads {THREADS}, created_at string, updated_at string"
COLUMNS = ("session_id", "state", "threads", "created_at", "updated_at")
#: Folders of a store. A session's folder follows from its id, so a look-up reads one of them.
BUCKETS = 64


def session(turns: DataFrame, session_id: str) -> DataFrame:
    return turns.where(F.col("session_id") == session_id)


def overview(turns: DataFrame) -> DataFrame:
    """(session_id, n_messages in the main thread, n_threads)."""
    return turns.groupBy("session_id").agg(F.count_if(F.col("thread") == "main").alias("n_messages"), F.count_distinct("thread").alias("n_threads"))


def delete(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """turns without the sessions in ids (session_id)."""
    return turns.join(ids, "session_id", "left_anti")


def from_turns(turns: DataFrame) -> DataFrame:
    """SESSION rows without state or dates, threads in order of turn; turns: (session_id, thread, turn, role, content)."""
    threads = turns.groupBy("session_id", "thread").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
    return threads.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("thread", "turns"))).alias("threads")).select("session_id", F.lit(None).cast("string").alias("state"), "threads", *[F.lit(None).cast("string").alias(c) for c in ("created_at", "updated_at")])


def to_turns(sessions: DataFrame) -> DataFrame:
    """(session_id, thread, turn long from 0, role, content, updated_at)."""
    threads = sessions.select("session_id", "updated_at", F.explode("threads").alias("thread", "turns"))
    return threads.select("session_id", "thread", "updated_at", F.posexplode("turns").alias("turn", "t")).select("session_id", "thread", F.col("turn").cast("long").alias("turn"), "t.role", "t.content", "updated_at")


def read_files(spark: SparkSession, folder: str, session_id: str | None = None) -> DataFrame:
    """SESSION rows of a folder of JSON files, one per session and named by its id; of one session alone where an id is given, whose file alone is then listed. Files that aren't JSON are left out."""
    name = re.sub("[^A-Za-z0-9_-]", "_", session_id) + ".json" if session_id is not None else "*.json"
    files = spark.read.option("pathGlobFilter", name).text(folder, wholetext=True)
    part = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = files.select(F.try_parse_json("value").alias("v")).select(
        part("$.id", "string").alias("session_id"), F.to_json(part("$.state", "variant")).alias("state"), F.coalesce(part("$.threads", THREADS), F.create_map().cast(THREADS)).alias("threads"),
        part("$.createdAt", "string").alias("created_at"), part("$.updatedAt", "string").alias("updated_at"),
    )
    return rows.where("session_id IS NOT NULL")


def _bucket(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int")


class Store:
    """Sessions below a path, on any file system that Spark reaches: a log of versions in BUCKETS folders.

    Saving and deleting append rows, in one commit each, so readers see all of a call or nothing of it, and writers don't wait for each other; the highest version of an id counts (at a tie, a deletion, then the larger content).
    A look-up reads one folder, with the id pushed down to its Parquet files. compact() writes a store anew without what is superseded.
    """

    SCHEMA = f"{SESSION}, version long, deleted boolean, bucket int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def _current(self, log: DataFrame) -> DataFrame:
        # maps can't be ordered, so the threads are compared as JSON
        last = F.max_by(F.struct("state", "threads", "created_at", "updated_at", "deleted"), F.struct("version", "deleted", F.coalesce(F.to_json("threads"), F.lit("")), F.coalesce("state", F.lit(""))))
        return log.groupBy("session_id").agg(last.alias("s")).where("NOT s.deleted").select("session_id", "s.state", "s.threads", "s.created_at", "s.updated_at")

    def sessions(self) -> DataFrame:
        """All sessions."""
        return self._current(self._log())

    def get(self, session_id: str) -> DataFrame:
        """One session; no row where there is none."""
        bucket = self.spark.range(1).select(_bucket(F.lit(session_id)).alias("b")).first()["b"]
        return self._current(self._log().where((F.col("bucket") == bucket) & (F.col("session_id") == session_id)))

    def list(self) -> DataFrame:
        """(session_id) of all sessions; reads no contents."""
        newest = F.max(F.struct("version", "deleted"))
        return self._log().groupBy("session_id").agg(newest.alias("s")).where("NOT s.deleted").select("session_id")

    def _append(self, rows: DataFrame, version: int, deleted: bool) -> None:
        own = rows.where("session_id IS NOT NULL").withColumns({"version": F.lit(version).cast("long"), "deleted": F.lit(deleted), "bucket": _bucket(F.col("session_id"))})
        own.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def save(self, sessions: DataFrame, version: int, now: str | None = None) -> None:
        """Store SESSION rows, in place of those with the same ids; version: larger than those before, such as milliseconds. updated_at becomes `now`, and so does a missing created_at. Rows without an id are left out."""
        rows = sessions.select(*COLUMNS)
        if now is not None:
            rows = rows.withColumns({"updated_at": F.lit(now), "created_at": F.coalesce("created_at", F.lit(now))})
        self._append(rows, version, False)

    def delete(self, ids: DataFrame, version: int) -> None:
        """Delete the sessions in ids (session_id); ids that aren't there do no harm."""
        blank = [F.lit(None).cast(t).alias(c) for c, t in (("state", "string"), ("threads", THREADS), ("created_at", "string"), ("updated_at", "string"))]
        self._append(ids.select("session_id", *blank), version, True)

    def compact(self, path: str, version: int) -> "Store":
        """The same sessions in a new store, without what is superseded or deleted."""
        other = Store(self.spark, path)
        other._append(self.sessions(), version, False)
        return other
