"""Helpers shared by the training-data operators: the shared folder, materialised steps, words and tokens."""

from __future__ import annotations

import array
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: Fixed: what the contracts call a word, and the six characters that part words.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package also where the driver's own path alone leads to it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a local master gets a temporary folder, as in tests; on a cluster that would be another folder on each machine, so there it is an error.
    """
    prepare(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master: {master})")
        named = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it from there: cuts lineage and survives lost executors. What the driver freed meanwhile goes back to the machine."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    release_jvm(df.sparkSession)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by materialise() once all that is made of them is written elsewhere. Other tables are left alone."""
    for table in tables:
        if path := getattr(table, "_scratch", None):
            delete(table.sparkSession, path)


def small(table: DataFrame, most: int = 10_000) -> DataFrame:
    """The side of a join, for a written table: broadcast if it has at most `most` rows, which is counted first."""
    return F.broadcast(table) if table.count() <= most else table


def release() -> None:
    """Give freed memory back to the machine, as a worker lives on after its task: what Arrow keeps for later, and what the C library does."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release_jvm(spark: SparkSession) -> None:
    """The same for the driver's JVM, which lives on from job to job: compiling and planning take memory of the C library and free it, and the library keeps it for each of hundreds of threads.

    Done by the JVM's own management command; a JVM without it keeps that memory.
    """
    from py4j.protocol import Py4JError

    jvm = spark._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by way of the interface, as the server's class isn't open to others
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, given)
    except Py4JError:
        pass


def parts(spark: SparkSession, rows: int, each: int, least: int = 1) -> int:
    """Tasks for so many rows (or bytes) at about `each` a task."""
    return max(least, -(-int(rows) // each))


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread_join(rows: DataFrame, per: DataFrame, key: str, by: str, salts: int = 256) -> DataFrame:
    """rows joined (inner) with per, which has one row for each value of key; `by` tells apart the rows of one key.

    A key with many rows is a hub: its row of per goes out once per salt that occurs, and each salt's rows meet it in a group of their own.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    needed = dealt.select(key, "_salt").distinct().join(per, key)
    return dealt.join(needed, [key, "_salt"]).drop("_salt")


def label(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, without bringing links or labels to the driver.

    edges: (a long, b long). Returns (node long, root long), root being the smallest node of its component; nodes
    without an edge to another node may be missing. Alternates two steps that each keep one row per edge at most: every
    node passes its smallest neighbour to its larger neighbours, then to its smaller ones. Ends when a round leaves the set of edges as it was;
    only the number of changed edges reaches the driver. Minima combine before the shuffle, and joins deal a hub's edges to many groups.
    """
    pair = materialise(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    while True:
        # larger side: all neighbours above u move to the smallest node seen around u
        both = pair.union(pair.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = spread_join(both.where("v > u"), low, "u", "v").selectExpr("v AS u", "m AS v").distinct()
        wide = materialise(wide, "wide")  # read four times
        # smaller side: u and all neighbours not above it move to the smallest of them
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.expr("array(struct(v AS u, m AS v), struct(u AS u, m AS v))"))
        close = spread_join(wide, low, "u", "v").select(ends.alias("e")).select("e.*").where("u <> v").distinct()
        close = materialise(close, "edges")
        # both are sets, so they are equal if one holds the other and has as many rows
        same = close.count() == pair.count() and close.join(pair, ["u", "v"], "left_anti").isEmpty()
        discard(pair, wide)
        pair = close
        if same:
            break
    return pair.selectExpr("u AS node", "v AS root").union(pair.selectExpr("v AS node", "v AS root").distinct())


def blocks(batch: "pa.RecordBatch", text_at: int, most: int) -> Iterator["pa.RecordBatch"]:
    """Slices of a batch with at most about `most` bytes of text, one row at least."""
    start, held = 0, 0
    for i, cell in enumerate(batch.column(text_at)):
        n = len(cell.as_buffer()) if cell.is_valid else 0
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


class Runs:
    """Many arrays of ids, one after another in one array."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = ids, lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    @classmethod
    def of(cls, lists: list[array.array]) -> "Runs":
        ids = np.frombuffer(b"".join([x.tobytes() for x in lists]), dtype="<u4")
        return cls(ids, np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))

    def take(self, places: np.ndarray, step: int = 200_000) -> "Runs":
        n = self.lengths[places]
        out, to = np.empty(int(n.sum()), dtype=self.ids.dtype), 0
        for i in range(0, len(places), step):
            own, k = places[i : i + step], n[i : i + step]
            ends = np.cumsum(k)
            at = np.repeat(self.starts[own] - (ends - k), k)
            at += np.arange(len(at))
            out[to : to + len(at)] = self.ids[at]
            to += len(at)
        return Runs(out, n)


#: Fixed: a piece of Latin letters, perhaps with a point or comma behind, which the tokenizer in use parts from it.
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes with: printable ones as they are, the others from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts by the tokenizers library.

    The tokenizer in use drops white space and never joins characters across it, so a text's ids are those of its blank-separated pieces, one after
    another; pieces repeat a lot, so the distinct pieces of a block of texts are encoded once. Nothing is kept from block to block.
    Plain pieces go to the tokenizer's merges without its normalizer, all others through the whole tokenizer; texts that might hold special
    tokens, which it finds first of all, and all texts of other tokenizers are encoded whole.
    """

    tokenizers: dict[str, tuple] = {}

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if file not in self.tokenizers:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(file)
            said = json.loads(t.to_str())
            kinds = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
            by_piece = kinds == ["NFC", "Replace", "Lowercase"] and said["pre_tokenizer"]["pretokenizers"][0].get("behavior") == "Removed"
            self.tokenizers[file] = t, by_piece
        self.tokenizer, self.by_piece = self.tokenizers[file]
        self.letters = _byte_letters()

    def _raw(self, text: str) -> array.array:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> array.array:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array.array("I", [x.id for x in self.tokenizer.model.tokenize(word)])

    def _pieces(self, pieces: "pa.Array") -> Runs:
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(pieces, _PLAIN)
        words = pc.utf8_lower(pieces.filter(plain))
        last = pc.utf8_slice_codeunits(words, -1)
        point, comma = pc.equal(last, "."), pc.equal(last, ",")
        base = pc.if_else(pc.or_(point, comma), pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        odd = pieces.filter(pc.invert(plain))
        lists = [array.array("I"), self._raw("."), self._raw(",")]
        lists += [self._word(x) for x in base.dictionary.to_pylist()]
        first_odd = len(lists)
        lists += [self._raw(x) for x in odd.to_pylist()]
        is_plain = plain.to_numpy(zero_copy_only=False)
        # each piece is a word and what stands behind it, or an odd piece and nothing
        parts = np.zeros((len(pieces), 2), dtype=np.int32)
        parts[is_plain, 0] = base.indices.to_numpy() + 3
        parts[is_plain, 1] = point.to_numpy(zero_copy_only=False) + 2 * comma.to_numpy(zero_copy_only=False)
        parts[~is_plain, 0] = first_odd + np.arange(len(odd))
        halves = Runs.of(lists).take(parts.ravel())
        return Runs(halves.ids, halves.lengths.reshape(-1, 2).sum(axis=1))

    def many(self, texts: "pa.Array") -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; a null text has none."""
        import pyarrow.compute as pc

        if not self.by_piece:
            yield from (self._raw(x or "").tobytes() for x in texts.to_pylist())
            return
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        whole = special.to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.if_else(special, "", pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        out = self._pieces(coded.dictionary).take(coded.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        bounds, raw = out.starts[upto] * 4, memoryview(np.ascontiguousarray(out.ids, dtype="<u4")).cast("B")
        for i in range(len(texts)):
            yield self._raw(texts[i].as_py()).tobytes() if whole[i] else bytes(raw[bounds[i] : bounds[i + 1]])

    def encode(self, text: str | None) -> bytes:
        import pyarrow as pa

        return next(self.many(pa.array([text], pa.string())))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
