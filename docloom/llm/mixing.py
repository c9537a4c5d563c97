"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same wanted number of copies, target / source size. Its whole part is taken; the rest, a probability, is
settled by dependent rounding: two documents trade words, so that their sum stays, until one has a whole number of
copies. Leaves of a bounded number of documents settle on their own and hand on the one document that is left; the same step over those, level by
level, is a reduction tree. What a source takes thus differs from its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, small

_TINY = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target double to (source, source_size).

    Sources by code point, null last, get the weights in turn and share `share` times all sizes; none gets more than `most` times its size, and
    the excess is shared anew by weight until none is above. With sources sorted by most * size / weight, the level at which the shared
    amount runs out is the largest of (amount - caps before) / (weights from here), so one ordered pass finds it. One row per source goes through
    one task here: sources are names of collections, not documents.
    """
    if share > most:
        raise ValueError("share must not exceed most: the targets could not hold it")
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    return s.withColumn("target", F.least("cap", F.col("w") * F.max("level").over(every))).select(*sizes.columns, "target")


def _uniform(a: np.uint64, b: np.uint64, seed: int) -> float:
    """A number in [0, 1) fixed by two documents and a seed."""
    x = (int(a) * 0x9E3779B97F4A7C15 + int(b) * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * k) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / 2**53


def _pool(order: list[int], ids: Sequence[int], sizes: Sequence[int], f: np.ndarray, seed: int) -> int:
    """Settles documents that have one chance in common. Each in turn, largest first, is paired with the pool of all after it, which keep one chance: so even a document
    larger than any other finds enough words to trade with, and what is left over at the end is the smallest."""
    common, left = float(f[order[0]]), sum(sizes[i] for i in order)
    for k, i in enumerate(order[:-1]):
        left -= sizes[i]
        up, down = min(1 - common, common * left / sizes[i]), min(common, (1 - common) * left / sizes[i])
        if _uniform(ids[i], ids[order[k + 1]], seed) * (up + down) < down:
            own, common = common + up, common - up * sizes[i] / left
        else:
            own, common = common - down, common + down * sizes[i] / left
        whole = own <= _TINY or own >= 1 - _TINY
        f[i] = round(own) if whole else own
        if common <= _TINY or common >= 1 - _TINY:
            f[order[k + 1 :]] = round(common)
            return -1 if whole else i
    f[order[-1]] = common
    return order[-1]


def settle(ids: Sequence[int], sizes: Sequence[int], chances: Sequence[float], seed: int, last: bool) -> tuple[np.ndarray, int]:
    """Pivotal rounding over one leaf. Returns the chances, now 0 or 1 but for the document at the returned place (-1: none).

    The sum of size * chance stays as it was, and each chance is kept on average. Large documents go first, so the one that is left over tends to be small. With `last`, it is
    settled too.
    """
    f = np.asarray(chances, dtype=float).copy()
    order = sorted(range(len(f)), key=lambda i: (-sizes[i], ids[i]))
    held = -1
    if len(f) and _TINY < f.min() and f.max() < 1 - _TINY and f.max() - f.min() <= _TINY:
        held, order = _pool(order, ids, sizes, f, seed), []
    for i in order:
        if f[i] <= _TINY or f[i] >= 1 - _TINY:
            f[i] = round(f[i])
            continue
        if held < 0:
            held = i
            continue
        ratio = sizes[i] / sizes[held]
        up, down = min(1 - f[held], f[i] * ratio), min(f[held], (1 - f[i]) * ratio)
        if _uniform(ids[held], ids[i], seed) * (up + down) < down:
            f[held], f[i] = f[held] + up, f[i] - up / ratio
        else:
            f[held], f[i] = f[held] - down, f[i] + down / ratio
        whole = [k for k in (held, i) if f[k] <= _TINY or f[k] >= 1 - _TINY]
        for k in whole:
            f[k] = round(f[k])
        left = [k for k in (held, i) if k not in whole]
        held = left[0] if left else -1
    if held >= 0 and last:
        f[held] = float(_uniform(ids[held], 0, seed + 1) < f[held])
        held = -1
    return f, held


def round_copies(items: DataFrame, seed: int = 0, leaf: int = 4096) -> DataFrame:
    """Settles chances within each source. items: (key long, nth long, source, size long > 0, chance double in [0, 1), n long: rows of the source); key and nth tell rows of a source apart.

    Returns (key, nth, source, size, taken int 0 or 1). Leaves are dealt by a hash of key and nth, so no group of more than about `leaf` rows meets in one task, however many rows a source
    or a key has.
    """
    schema = "key long, nth long, source string, size long, chance double, n long, leaf long, open boolean"
    mask = 0xFFFFFFFFFFFFFFFF

    def level(seed: int, last: bool):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            ids = [((0 if pd.isna(x) else int(x)) * 0x9E3779B97F4A7C15 + int(k)) & mask if k else (0 if pd.isna(x) else int(x)) & mask for x, k in zip(rows["key"], rows["nth"])]
            f, held = settle(ids, rows["size"].tolist(), rows["chance"].tolist(), seed, last)
            open_ = np.zeros(len(rows), dtype=bool)
            if held >= 0:
                open_[held] = True
            return rows.assign(chance=f, open=open_)

        return run

    most = items.agg(F.max("n")).first()[0] or 0
    done, k = [], 0
    own = ["key", "nth", "source", "size", "chance", "n"]
    now = items.select(*own)
    while True:
        leaves = F.ceil(F.col("n") / leaf).cast("long")
        spread = F.xxhash64("key", "nth") if not k else F.xxhash64("leaf", F.lit(k))
        last = most <= leaf
        dealt = now.withColumn("leaf", F.pmod(spread, leaves)).withColumn("open", F.lit(False)).select(*own, "leaf", "open")
        settled = materialise(dealt.groupBy("source", "leaf").applyInPandas(level(seed + 7 * k, last), schema), "mix")
        done.append(settled.where(~F.col("open")).select("key", "nth", "source", "size", F.col("chance").cast("int").alias("taken")))
        if last:
            break
        most = -(-most // leaf)
        now = settled.where("open").withColumn("n", F.ceil(F.col("n") / leaf).cast("long"))
        k += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """How many words the mix takes of each document: (doc_id, nth, source, size, source_size, target, copies, taken).

    size gives a document's size; null counts as 0. Documents of size 0 are taken 0 times. Rows alike in id, source and size are documents of their
    own, numbered by nth from 0. Reruns agree: chances come from id, nth and the seed alone. An empty table gives no rows.
    """
    shared_dir(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    # counted first, so that rows that are alike get numbers without meeting in a task
    alike = plain.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    sized = materialise(alike.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("nth")), "sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    per = materialise(source_targets(per, weights, share, most), "targets")
    rows = sized.alias("d").join(small(per).alias("p"), F.expr("d.source <=> p.source")).select("d.doc_id", "d.nth", "d.source", "d.size", "p.source_size", "p.target", "p.n")
    wish = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(wish + _TINY).cast("long")).withColumn("chance", F.greatest(wish - F.col("whole"), F.lit(0.0)))
    # what is left to settle; the others have a whole number of copies already
    loose = rows.where(F.col("chance") > _TINY).select(F.col("doc_id").alias("key"), "nth", "source", "size", "chance", "n")
    drawn = round_copies(loose, seed).alias("r")
    fixed = rows.where(F.col("chance") <= _TINY).select("doc_id", "nth", "source", "size", "source_size", "target", F.col("whole").alias("copies"))
    copies = (F.floor(F.col("p.target") / F.col("p.source_size") + _TINY) + F.col("r.taken")).cast("long").alias("copies")
    settled = drawn.join(small(per).alias("p"), F.expr("r.source <=> p.source")).select(F.col("r.key").alias("doc_id"), "r.nth", "r.source", "r.size", "p.source_size", "p.target", copies)
    return fixed.unionByName(settled).withColumn("taken", F.col("copies") * F.col("size"))
