"""Quality classifier: interpolated modified Kneser-Ney n-gram models score every document by its perplexity.

The grams are runs of five characters (code points). Two models come from the labels: one of trusted texts, whose perplexity judges form, and one of
toxic texts; where a passage is far likelier under the second, the text is toxic however well formed the rest is. Both exist twice, each trained on the documents of one
fold, and a document is scored by the models of the other fold, so no text is judged by a model that holds it.

Counts are tables keyed by model and gram. Documents are read in blocks of one language and fold; a block asks for its distinct runs of characters, as grams and as contexts, that the models may
hold, the questions of all blocks meet the count tables in a join on hashed keys, and each answer goes back to the block that asked. The counts that nearly every block would ask for, a
bounded number of the largest, go to all tasks at once instead. So neither the models nor the corpus' grams need fit anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, discard, materialise, parts, release, shared_dir, small

ORDER = 5
#: Stands four times before a text, so that its first characters have whole contexts too.
START = "\x02"
#: Below order 1 all code points are alike.
CODE_POINTS = 0x110000
#: Columns of our own; no table has such names.
_KEY, _TEXT, _NLL, _CHARS, _TOXIC = "_kn_key", "_kn_text", "_kn_nll", "_kn_chars", "_kn_toxic"
_U = np.uint64
#: So many numbers at most are told apart by a table of them (9 bytes each).
_TABLE = 1 << 23


def _chunks(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Runs of ORDER characters, about `most` at a time: code points, and (text, where in them its first run starts, number of its runs) in order. A long text goes on in the next chunk."""
    parts: list[str] = []
    runs: list[tuple[int, int, int]] = []
    held = 0

    def made() -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4"), runs

    for i, text in enumerate(texts):
        text = text or ""
        at = 0
        while at < len(text):
            n = min(len(text) - at, most - held)
            parts.append(START * (ORDER - 1) + text[:n] if at == 0 else (START * (ORDER - 1) + text[:at])[1 - ORDER :] + text[at : at + n] if at < ORDER else text[at + 1 - ORDER : at + n])
            runs.append((i, held + (ORDER - 1) * len(runs), n))
            at, held = at + n, held + n
            if held >= most:
                yield made()
                parts, runs, held = [], [], 0
    if runs:
        yield made()


def _number(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, all less than `below`, and which of them stands at each place. Values are sorted only where a table of all that may occur would be large."""
    if below > min(_TABLE, 32 * len(values)):
        return np.unique(values, return_inverse=True)
    seen = np.zeros(below, dtype=bool)
    seen[values] = True
    found = np.flatnonzero(seen)
    place = np.empty(below, dtype=np.int64)
    place[found] = np.arange(len(found))
    return found, place.take(values)


class Level(NamedTuple):
    """The distinct runs of one length: code points [n, length], and for each run the places, in the level below, of the run without its last and without its first character."""

    points: np.ndarray
    context: np.ndarray
    ending: np.ndarray


def _levels(c: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Distinct runs of 0 to ORDER characters of c, and which of the longest starts at each place. A run is numbered by the number of its context and its last character.

    Runs across two texts are among them. They end in the first characters of START before a text, where nobody looks them up.
    """
    none = np.zeros(1, dtype=np.int64)
    levels, which, held = [Level(np.zeros((1, 0), dtype=np.uint32), none, none)], np.zeros(len(c) + 1, dtype=np.int64), none
    chars, char = _number(c.astype(np.int64), CODE_POINTS)
    for k in range(1, ORDER + 1):
        below, n = levels[-1], len(chars)
        numbers = which[: len(c) - k + 1] * n
        numbers += char[k - 1 :]
        found, which = _number(numbers, len(below.points) * n)
        context, last = np.divmod(found, n)
        # a run's ending is its context's ending, and the last character
        ending = np.searchsorted(held, below.ending[context] * n + last) if k > 1 else np.zeros(n, dtype=np.int64)
        levels.append(Level(np.concatenate([below.points[context], chars[last, None].astype(np.uint32)], axis=1), context, ending))
        held = found
    return levels, which


def _hashes(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of grams [n, ORDER]. They only tell apart the grams that a task counts: two of a million share one with a chance of 1 in 10^7."""
    h = np.zeros(len(points), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ORDER):
            h += points[:, j]
            h *= _U(0xD6E8FEB86659FD93)
            h ^= h >> _U(29)
    return h


def distinct(texts: Iterable[str | None], most: int = 1 << 20, start: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of some texts, and of those that `start` came from: hashes in order, code points [n, ORDER], counts."""
    h, g, n = start or (np.zeros(0, dtype=np.uint64), np.zeros((0, ORDER), dtype=np.uint32), np.zeros(0, dtype=np.int64))
    for c, runs in _chunks(texts, most):
        levels, which = _levels(c)
        points = levels[ORDER].points
        many = np.bincount(np.concatenate([which[at : at + k] for _, at, k in runs]), minlength=len(points))
        own = np.flatnonzero(many)
        both, points, many = np.concatenate([h, _hashes(points[own])]), np.concatenate([g, points[own]]), np.concatenate([n, many[own]])
        order = np.argsort(both)
        both = both[order]
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        h, g, n = both[at], points[order[at]], np.add.reduceat(many[order], at)
    return h, g, n


def _strings(g: np.ndarray) -> pa.Array:
    k = g.shape[1]
    s = np.ascontiguousarray(g, dtype="<u4").tobytes().decode("utf-32-le", "replace")
    return pa.array([s[i : i + k] for i in range(0, len(s), k)], pa.string())


def _ids(points: np.ndarray, key: str) -> np.ndarray:
    """64-bit names of character runs [n, k] under a key. Among a billion, two share one with a chance of 3%, and would then share their counts."""
    k = points.shape[1]
    seed = int.from_bytes(hashlib.blake2b(f"{k}:{key}".encode(), digest_size=8).digest(), "little")
    h = np.full(len(points), seed, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ points[:, j]) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
    return h.view(np.int64)


def _names(levels: list[Level], key: str) -> np.ndarray:
    """The names of the runs of all levels, from the shortest on."""
    return np.concatenate([_ids(x.points, key) for x in levels])


def _by_key(batches: Iterator[pa.RecordBatch], text_at: int, key_at: int, most: int) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Blocks of rows with one key."""
    for batch in batches:
        for block in blocks(batch, text_at, most):
            keys = block.column(key_at).dictionary_encode()
            codes = keys.indices.to_numpy()
            for i, key in enumerate(keys.dictionary.to_pylist()):
                yield key, block.take(pa.array(np.flatnonzero(codes == i)))


def _texts(block: pa.RecordBatch, at: int) -> Iterator[str | None]:
    return (cell.as_py() for cell in block.column(at))


def fold(id_: Column) -> Column:
    """0 or 1, by a hash of a document's id (null: a fold like any other id's)."""
    return F.pmod(F.xxhash64(id_.cast("long"), F.lit(17)), F.lit(2)).cast("int")


def _key(lang: Column, fold_: Column) -> Column:
    """Names the fold and language that share models; a null language is one of its own."""
    return F.concat_ws(":", fold_.cast("string"), lang.cast("string"))


def count(docs: DataFrame, block_bytes: int = 16_000_000, most: int = 1_000_000) -> DataFrame:
    """(key, g, c): how often each gram occurs in the texts of each key. docs: (key string, text string). A task gathers up to about `most` distinct grams before it hands them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, (_, g, c) in held.items():
                for at in range(0, len(g), 100_000):
                    part = g[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.string()), _strings(part), pa.array(c[at : at + 100_000], pa.int64())], names=["key", "g", "c"])
            held.clear()

        for key, block in _by_key(batches, 1, 0, block_bytes):
            held[key] = distinct(_texts(block, 1), start=held.get(key))
            if sum(len(h) for h, _, _ in held.values()) > most:
                yield from out()
        yield from out()
        release()

    return docs.select("key", "text").mapInArrow(run, "key string, g string, c long").groupBy("key", "g").agg(F.sum("c").alias("c"))


def model(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 up, (key, g, num): discounted count of each gram, and (key, h, total, gamma): what its context's counts are
    divided by, and the weight of the order below. counts: as from count().

    The highest order has true counts; below, a gram's count is how many characters it follows. The three discounts of an order come from its counts of counts, per model.
    """
    out, level = [], counts
    for k in range(ORDER, 0, -1):
        level = materialise(level, f"kn{k}")
        n = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(i: int, y: Column = y) -> Column:
            d = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
            return F.least(F.greatest(F.coalesce(F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), d), F.lit(0.5 * i)), F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}")

        # one row per model
        stats = materialise(level.groupBy("key").agg(*n).select("key", *[discount(i) for i in (1, 2, 3)]), "discounts")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = level.join(small(stats), "key").select("key", "g", F.expr(f"left(g, {k - 1})").alias("h"), "c", d.alias("d"))
        below = materialise(t.groupBy("key", "h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")), f"contexts{k}")
        out.append((t.select("key", "g", (F.col("c") - F.col("d")).alias("num")), below))
        if k > 1:
            level = level.groupBy("key", F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c"))
    return out[::-1]


_COUNTS = ("num", "total", "gamma")
_CELLS = [f"{which}_{c}" for which in ("good", "bad") for c in _COUNTS]


def items(tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row for each run of up to ORDER characters that a fold's models know, as a gram or as a context: (id long, <good|bad>_<num|total|gamma> float). See model()."""
    none = F.lit(None).cast("double")
    rows = None
    for k, (t, below) in enumerate(tables, 1):
        grams = t.select("key", F.lit(k).alias("k"), F.col("g").alias("s"), "num", none.alias("total"), none.alias("gamma"))
        contexts = below.select("key", F.lit(k - 1).alias("k"), F.col("h").alias("s"), none.alias("num"), "total", "gamma")
        both = grams.unionByName(contexts)
        rows = both if rows is None else rows.unionByName(both)
    kind, key = F.expr("split_part(key, ':', 1)"), F.expr("substring(key, instr(key, ':') + 1)")
    cells = [F.max(F.when(kind == which, F.col(c))).cast("float").alias(f"{which}_{c}") for which in ("good", "bad") for c in _COUNTS]
    merged = rows.groupBy(key.alias("own"), "k", "s").agg(*cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths, strings = (batch.column(i).to_pylist() for i in range(3))
            ids = np.zeros(len(keys), dtype=np.int64)
            groups: dict[tuple[str, int], list[int]] = {}
            for i, at in enumerate(zip(keys, lengths)):
                groups.setdefault(at, []).append(i)
            for (own, k), at in groups.items():
                points = np.frombuffer("".join([strings[i] for i in at]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(at), k)
                ids[at] = _ids(points, own)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *batch.columns[3:]], names=["id", *_CELLS])
        release()

    return merged.mapInArrow(run, "id long, " + ", ".join(f"{x} float" for x in _CELLS))


def bitmap(spark: SparkSession, ids: DataFrame, most: int = 28) -> tuple[Broadcast, int]:
    """A broadcast bitmap of hashed ids (one long column) and its size in bits: 16 for each id, 2^16 at least and 2^most (32 MB) at most. With more ids it only lets more others pass."""
    bits = 1 << min(most, max(16, (16 * ids.count()).bit_length()))
    # Spark's bitmaps count from 1: buckets of 4096 bytes each
    place = F.pmod(_scatter(F.col(ids.columns[0])), F.lit(bits)) + 1
    marked = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    whole = bytearray(max(bits // 8, 4096))
    for row in marked.toLocalIterator():
        whole[(row["n"] - 1) * 4096 : row["n"] * 4096] = row["m"]
    sent = spark.sparkContext.broadcast(whole)
    del whole, marked
    release()  # the driver too lives on
    return sent, bits


def _scatter(id_: Column) -> Column:
    return id_.bitwiseXOR(F.shiftright(id_, 32))


def _marked(mask: bytes, bits: int, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be in the bitmap."""
    p = (ids ^ (ids >> 32)) & (bits - 1)
    return np.frombuffer(mask, dtype=np.uint8)[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1


def _worst(excess: np.ndarray, before: float) -> tuple[float, float]:
    """Largest sum of a run of values, and the largest sum of one that ends at the last; `before` is that of a run that ends before the first."""
    s = before + np.cumsum(excess, dtype=np.float64)
    w = s - np.minimum(np.minimum.accumulate(s), 0.0)
    return float(w.max()), float(w[-1])


class Counts:
    """Items in memory: their ids in order, and a row of _CELLS for each."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids, self.cells = ids, cells

    @classmethod
    def of(cls, rows: pa.Table) -> "Counts":
        ids = rows["id"].to_numpy()
        order = np.argsort(ids)
        cells = np.stack([rows[c].to_numpy() for c in _CELLS], axis=1).astype("<f4")  # null becomes nan
        return cls(ids[order], cells[order])

    def packed(self) -> bytes:
        return self.ids.astype("<i8").tobytes() + self.cells.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> "Counts":
        n = len(data) // (8 + 4 * len(_CELLS))
        return cls(np.frombuffer(data, dtype="<i8", count=n), np.frombuffer(data, dtype="<f4", offset=8 * n).reshape(n, len(_CELLS)))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ids, and whether they are here."""
        if not len(self.ids):
            return np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=bool)
        # in order, as neighbours then lie near each other
        order, at = np.argsort(ids), np.empty(len(ids), dtype=np.int64)
        at[order] = np.minimum(np.searchsorted(self.ids, ids[order]), len(self.ids) - 1)
        return at, self.ids[at] == ids


def largest(known: DataFrame, most: int) -> tuple[Broadcast, DataFrame]:
    """The items with the largest counts, at most `most` of them (32 bytes each), packed and broadcast; and the ids of the others."""
    weight = F.floor(8 * F.log2(F.greatest(*[F.coalesce(f"{which}_{c}", F.lit(0.0)) for which in ("good", "bad") for c in ("num", "total")]) + 1e-3)).cast("int")
    steps = sorted(((r["w"], r["n"]) for r in known.groupBy(weight.alias("w")).agg(F.count("*").alias("n")).collect()), reverse=True)
    taken, least = 0, None
    for w, n in steps:
        if taken + n > most:
            break
        taken, least = taken + n, w
    sent = packed(known.where(weight >= least) if least is not None else known.limit(0))
    return sent, (known if least is None else known.where(weight < least)).select("id")


def packed(known: DataFrame) -> Broadcast:
    """Items as Counts.packed() has them, broadcast. Executors sort and pack them in 16 ranges of ids, which are hashes; the driver holds the packed bytes once and a range or a few beside them."""
    spark = known.sparkSession

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        own = Counts.of(rows)
        release()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(own.ids)], pa.int64()), "ids": pa.array([own.ids.astype("<i8").tobytes()], pa.binary()), "cells": pa.array([own.cells.tobytes()], pa.binary())})

    table = materialise(known.groupBy(F.shiftright("id", 60)).applyInArrow(pack, "part long, n long, ids binary, cells binary"), "head")
    sizes = dict(table.select("part", "n").collect())
    total, at, before = sum(sizes.values()), {}, 0
    for part in sorted(sizes):
        at[part], before = before, before + sizes[part]
    whole = bytearray(total * (8 + 4 * len(_CELLS)))
    for part, n, ids, cells in table.toLocalIterator():
        whole[8 * at[part] : 8 * (at[part] + n)] = ids
        first = 8 * total + 4 * len(_CELLS) * at[part]
        whole[first : first + len(cells)] = cells
    sent = spark.sparkContext.broadcast(whole)
    del whole
    discard(table)
    release()  # the driver too lives on
    return sent


def _cells(tables: list[Counts], ids: np.ndarray) -> np.ndarray:
    """The cells of each id, from the one table that has it; nan where none has."""
    out, left = np.full((len(ids), len(_CELLS)), np.nan), np.arange(len(ids))
    for table in tables:
        at, there = table.find(ids[left])
        out[left[there]] = table.cells[at[there]]
        left = left[~there]
    return out


def _logs(levels: list[Level], key: str, tables: list[Counts]) -> list[np.ndarray | None]:
    """Under the trusted and the toxic model, the natural logarithm of the interpolated probability of each gram's last character after those before; None without a model.

    From order 1 up: p = num / total + gamma * p of the order below, and p of the order below where the context is unknown. Each distinct run is looked up once, as a gram and as a context.
    """
    upto = np.cumsum([len(x.points) for x in levels])
    cells = np.split(_cells(tables, _names(levels, key)), upto[:-1])
    p, known = [np.full(1, 1.0 / CODE_POINTS)] * 2, [False] * 2
    for level, ends, below in zip(levels[1:], cells[1:], cells):
        for i in (0, 1):
            num, total, gamma, lower = np.nan_to_num(ends[:, 3 * i]), below[level.context, 3 * i + 1], below[level.context, 3 * i + 2], p[i][level.ending]
            seen = ~np.isnan(total)
            known[i] = known[i] or seen.any()
            p[i] = np.where(seen, num / np.where(seen, total, 1.0) + np.where(seen, gamma, 1.0) * lower, lower)
    return [np.log(x) if k else None for x, k in zip(p, known)]


def _asked(texts: Iterable[str | None], key: str, mask: bytes, bits: int, head: Counts) -> np.ndarray:
    """The ids, in order, that a block asks for: names of its runs that may be in the bitmap, but are not in the head."""
    wanted = np.zeros(0, dtype=np.int64)
    for c, _ in _chunks(texts):
        names = _names(_levels(c)[0], key)
        wanted = np.union1d(wanted, names[_marked(mask, bits, names)])
    return wanted[~head.find(wanted)[1]]


def _scores(texts: Iterable[str | None], n: int, key: str, tables: list[Counts]) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts, the negative logarithm of its probability, and how much likelier the toxic model makes a passage at most (see score()); nan without text or model."""
    total, worst, running, scored, toxic = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool), False
    # a chunk is scored at a time, rather than all that a block holds
    for c, runs in _chunks(texts):
        levels, which = _levels(c)
        good, bad = _logs(levels, key, tables)
        if good is None:
            break
        logp, excess = good[which], None if bad is None else (bad - good)[which]
        for i, at, k in runs:
            scored[i] = True
            total[i] -= logp[at : at + k].sum()
            if excess is not None:
                top, running[i] = _worst(excess[at : at + k], running[i])
                worst[i] = max(worst[i], top)
        toxic = excess is not None
    return np.where(scored, total, np.nan), np.where(scored & toxic, worst, np.nan)


def score(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", keep: list[str] | None = None, block_bytes: int = 16_000_000, common: int = 1 << 20) -> DataFrame:
    """docs (or its columns `keep`) with _kn_nll double: negative logarithm of the text's probability under the trusted model of the other fold, _kn_chars long: its length, and
    _kn_toxic double: over all passages, the largest logarithm of how much likelier the toxic model makes it than the trusted one.

    known: as from items(), written. Null where there is nothing to score (null or empty text) or no model. docs must be a stable read, such as a table: its blocks are made
    twice, once for their questions and once, compressed, to meet the answers. The `common` largest counts (32 MB) go to all tasks, a bitmap of the others thins the questions, and the join decides.
    """
    keep = docs.columns if keep is None else keep
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.select(*keep, F.col(text_col).alias(_TEXT), _key(F.col(lang_col), fold(F.col(id_col))).alias(_KEY))
    n = len(keep)
    # the text travels once, also where it is one of the columns to keep
    sent = [c for c in keep if c != text_col]
    head, others = largest(known, common)
    mask, bits = bitmap(spark, others)

    def number() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId() << 32

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, (key, block) in enumerate(_by_key(batches, 0, 1, block_bytes), number()):
            wanted = _asked(_texts(block, 0), key, mask.value, bits, Counts.unpacked(head.value))
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(wanted), pa.int64()), pa.array(wanted)], names=["block", "id"])
        release()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, (key, block) in enumerate(_by_key(batches, n, n + 1, block_bytes), number()):
            block = block.select([*sent, _TEXT])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
                w.write_batch(block)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([key], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "key", "rows"])
        release()

    def answer(packed: pa.Table, known: pa.Table) -> pa.Table:
        if packed.num_rows != 1:
            raise ValueError("a block differs between two reads; give score() a stable table")
        block = pa.ipc.open_stream(packed["rows"][0].as_buffer()).read_all().combine_chunks()
        at = block.schema.get_field_index(_TEXT)
        lengths = np.array([len(x or "") for x in _texts(block, at)], dtype=np.int64)
        nll, toxic = _scores(_texts(block, at), len(lengths), packed["key"][0].as_py(), [Counts.unpacked(head.value), Counts.of(known)])
        cells = [block.column(at if c == text_col else block.schema.get_field_index(c)) for c in keep]
        release()
        optional = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
        return pa.Table.from_arrays([*cells, optional(nll), pa.array(lengths), optional(toxic)], names=[*keep, _NLL, _CHARS, _TOXIC])

    answers = rows.select(_TEXT, _KEY).mapInArrow(ask, "block long, id long").join(known, "id")
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField(_NLL, T.DoubleType()), T.StructField(_CHARS, T.LongType()), T.StructField(_TOXIC, T.DoubleType())])
    packed = rows.mapInArrow(pack, "block long, key string, rows binary")
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, out)
    scored._held = head, mask
    return scored


def _drop(df: DataFrame) -> None:
    """Take back what df has sent to all tasks, once what is made of it is written."""
    for sent in getattr(df, "_held", ()):
        sent.destroy()


def likely(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without most of the rows whose id isn't in ids (one column); every row whose id is there stays. So a join on the id that follows moves few texts."""
    mask, bits = bitmap(docs.sparkSession, ids.select(F.xxhash64(F.col(ids.columns[0]).cast("long")).alias("h")))
    n = len(docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(n).to_numpy()
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n]).filter(pa.array(_marked(mask.value, bits, hashes)))
        release()

    out = docs.where(F.col(id_col).isNotNull()).select("*", F.xxhash64(F.col(id_col).cast("long"))).mapInArrow(keep, docs.schema)
    out._held = (mask,)
    return out


def verdicts(labels: DataFrame) -> DataFrame:
    """(label_id, kind) from (doc_id, quality, toxic): bad for ids that any row calls toxic, good for those that all rows call of good quality; no others, and no null id."""
    by = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    per = by.agg(F.max(F.coalesce("toxic", F.lit(0))).alias("t"), F.min(F.coalesce("quality", F.lit(0))).alias("q"))
    return per.select("label_id", F.when(F.col("t") == 1, "bad").when(F.col("q") == 1, "good").alias("kind")).where("kind IS NOT NULL")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Written items() of the models of the trusted and of the toxic texts, for each language and fold; a fold's models are trained on the documents of the other fold."""
    shared_dir(docs.sparkSession)
    said = verdicts(labels)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    near = likely(texts, said.select("label_id"), "id")
    chosen = near.join(said, F.expr("id = label_id"))
    key = F.concat_ws(":", "kind", _key(F.col("lang"), 1 - fold(F.col("id"))))
    # some thousands of documents to a task, so that grams are counted together before they are handed on
    tables = model(count(chosen.select(key.alias("key"), "text").coalesce(parts(docs.sparkSession, said.count(), 8000))))
    known = materialise(items(tables), "items")
    _drop(near)
    for pair in tables:
        discard(*pair)
    return known


def quantiles(values: DataFrame, share: float, width: float = 1e-3) -> DataFrame:
    """(lang, x, n): per language, the value up to which a share of (lang, x) lies, and their number.

    A sketch per language counts values in bins of this width; counts add up exactly, in any order, so reruns agree. Values span a few units, so bins are at most some 10,000 a language.
    """
    bins = values.groupBy("lang", F.floor(F.col("x") / width).alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang")
    ranked = bins.withColumn("upto", F.sum("c").over(w.orderBy("bin"))).withColumn("n", F.sum("c").over(w))
    return ranked.groupBy("lang").agg(((F.min(F.when(F.col("upto") >= share * F.col("n"), F.col("bin"))) + 1) * width).alias("x"), F.max("n").alias("n"))


def _limit(values: DataFrame, share: float, prior: float) -> DataFrame:
    """(lang, limit): per language, the quantile `share` of (lang, x), drawn towards that of all languages together as if `prior` values spoke for it. One row per language."""
    pooled = quantiles(values.select(F.lit(0).alias("lang"), "x"), share).first()
    other = F.lit(pooled["x"] if pooled else None).cast("double")
    return quantiles(values, share).select("lang", ((F.col("n") * F.col("x") + prior * other) / (F.col("n") + prior)).alias("limit"))


def thresholds(scored: DataFrame, trusted: DataFrame, good: float = 0.99, spotless: float = 0.995, prior: float = 30.0) -> DataFrame:
    """(lang, threshold, toxicity_limit), one row per language of scored: (id, lang, x: logarithm of perplexity, toxicity).

    Among a language's trusted documents (ids in trusted: (label_id)), a share `good` has at most perplexity threshold, and a share `spotless` at most toxicity_limit. Few documents say little about a quantile, so each is drawn towards that of all languages, perplexities relative to the language's middle:
    with n documents, the language's own counts n / (n + prior). Quantiles come from mergeable sketches, of toxicity on a logarithmic scale.
    """
    mids = materialise(quantiles(scored.where("x IS NOT NULL").select("lang", "x"), 0.5).select("lang", F.col("x").alias("mid")), "mids")
    known = scored.where("x IS NOT NULL").join(trusted, F.expr("id = label_id"), "left_semi").alias("k")
    known = materialise(known.join(small(mids).alias("m"), F.expr("k.lang <=> m.lang")).select("k.lang", (F.col("x") - F.col("mid")).alias("x"), "toxicity"), "trusted")
    toxicity = known.select("lang", F.log1p("toxicity").alias("x")).where("x IS NOT NULL")
    out = mids
    for name, values, share in (("threshold", known.select("lang", "x"), good), ("toxicity_limit", toxicity, spotless)):
        limit = materialise(_limit(values, share, prior), name).select(F.col("lang").alias("_l"), F.col("limit").alias(name))
        out = out.join(small(limit), F.expr("lang <=> _l"), "left").drop("_l")
    return out.select("lang", F.exp(F.col("mid") + F.col("threshold")).alias("threshold"), F.expm1("toxicity_limit").alias("toxicity_limit"))


OUTPUT = ("perplexity", "threshold", "toxicity", "toxicity_limit", "kept")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", keep: list[str] | None = None, inert: float = 20.0, **shares) -> DataFrame:
    """docs (or its columns `keep`, which must hold id and language) with perplexity, threshold, toxicity, toxicity_limit and kept. docs must be a stable read, such as a table.

    kept: perplexity <= threshold and toxicity <= toxicity_limit, where these exist. perplexity is per character; since a few characters say little, each text is scored as if
    it went on for `inert` characters at its language's middle. Languages without trusted texts are kept unjudged, so is the half of a language whose trusted texts all lie in that same fold, and
    where no text is labelled toxic, toxicity is null. Null and empty texts are not kept, since nothing speaks for them; their perplexity is null.
    Null language is a language of its own. Repeated rows are scored alike. An empty table gives no rows. Columns of docs with the five names are replaced; names beginning with _kn_ are taken, and others never clash.
    """
    shared_dir(docs.sparkSession)
    docs = docs.drop(*OUTPUT)
    keep = docs.columns if keep is None else keep
    known = train(docs, labels, id_col, lang_col, text_col)
    raw = score(docs, known, id_col, lang_col, text_col, keep)
    scored = materialise(raw, "scored")
    _drop(raw)
    discard(known)
    # the language's middle in the same rough way for texts of all lengths
    rate = quantiles(scored.where(F.col(_NLL).isNotNull()).select(F.col(lang_col).alias("lang"), (F.col(_NLL) / F.col(_CHARS)).alias("x")), 0.5)
    rate = small(materialise(rate.select(F.col("lang").alias("_kn_lang"), F.col("x").alias("_kn_rate")), "rates"))
    x = (F.col(_NLL) + inert * F.col("_kn_rate")) / (F.col(_CHARS) + inert)
    scored = scored.join(rate, F.expr(f"`{lang_col}` <=> _kn_lang"), "left").withColumn("_kn_x", x)
    plain = scored.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col("_kn_x").alias("x"), F.col(_TOXIC).alias("toxicity"))
    limits = materialise(thresholds(plain, verdicts(labels).where("kind = 'good'").select("label_id"), **shares), "limits").withColumnRenamed("lang", "_kn_limit")
    out = scored.join(small(limits), F.expr(f"`{lang_col}` <=> _kn_limit"), "left")
    fine = F.coalesce(F.exp("_kn_x") <= F.col("threshold"), F.lit(True)) & F.coalesce(F.col(_TOXIC) <= F.col("toxicity_limit"), F.lit(True))
    return out.select(*keep, F.exp("_kn_x").alias("perplexity"), "threshold", F.col(_TOXIC).alias("toxicity"), "toxicity_limit", ((F.col(_CHARS) > 0) & fine).alias("kept"))
