"""Hard-negative mining: exact top lists from k-means inverted lists with stored radii.

Vectors become integers and are dealt to the lists of their nearest centroids. For an anchor q, a list with centroid c whose rows lie within radius r of it
holds inner products between q.c - |q| r and q.c + |q| r (Cauchy-Schwarz). An anchor visits lists by falling upper bound, skips those whose bounds
miss its window of scores, and stops where the bound falls strictly below its kth score. Over a cluster that walk has two rounds: the lists with the highest bounds first;
then, knowing the kth score that those gave, every other list whose bound still reaches it. Centroids and products are integers and bounds are rounded outwards, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, parts, release, shared_dir

#: Rows of a list that are stored together; a larger list is stored in as many parts as it needs.
PART_ROWS = 4096
_LOW, _HIGH = -(2**63), 2**63 - 1
_INDEX = "dim int, cluster int, part int, n long, radius2 double, ids binary, labels binary, vectors binary"
_ASKED = "anchor_id long, slot int, label long, v array<int>, lo long, hi long"


def integers(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label long, v array<int>): one row per id, components as floor(scale * x).

    Rows with a null id or label, or a vector that is null, empty or holds a null or non-finite component, take no part; neither do those whose integers have a sum of squares of 2^62 or
    more, whose products would not be 64-bit integers. Of rows with the same id the one with the smallest label counts, then the one with the smallest vector.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.floor(x * scale) * F.floor(x * scale).cast("double"))
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(F.size(v) > 0, F.when(fine, F.when(length2 < 2.0**62, whole))).alias("v"))
    one = out.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centroids.T).argmin(axis=1) for i in range(0, len(x), 4096)])


def fit(rows: DataFrame, clusters: int, sample: int, rounds: int = 8) -> dict[int, np.ndarray]:
    """Integer centroids by dimension, by Lloyd's algorithm on the `sample` rows with the smallest hashes; `clusters` in all at most.

    Only the sample reaches the driver, a bounded number of rows. A dimension that it doesn't hold has one list around zero, so every row belongs somewhere.
    """
    taken = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    sizes = np.array([len(x) for x in taken], dtype=np.int64)
    out = {}
    for dim in np.unique(sizes).tolist():
        x = _matrix(taken.filter(pa.array(sizes == dim)))
        own = np.unique(x, axis=0)
        k = max(1, min(len(own), clusters * len(x) // len(taken)))
        c = own[np.random.default_rng(dim).choice(len(own), k, replace=False)]
        for _ in range(rounds):
            at = _nearest(x, c)
            n = np.bincount(at, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, at, x)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        out[dim] = np.unique(np.rint(c), axis=0)
    return out


def build_index(rows: DataFrame, clusters: int = 1024, sample: int = 16_384) -> DataFrame:
    """Parts of lists, one row each: ids, labels and vectors as flat arrays, with the square of the radius around the list's centroid; its centroids are `_centroids`.

    rows: as from integers(), written. There are about as many lists as the square root of the rows, `clusters` at most; a list is dealt to parts of about PART_ROWS rows by a hash of the id, so
    one that holds a third of all rows is many tasks. Every row is in the index, whatever the sample was.
    """
    spark = rows.sparkSession
    centroids = fit(rows, min(clusters, max(1, int(rows.count() ** 0.5))), sample)
    held = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            dims = np.array([len(x) for x in v], dtype=np.int32)
            cluster = np.zeros(len(v), dtype=np.int32)
            for dim in np.unique(dims).tolist():
                if dim in held.value:
                    at = np.flatnonzero(dims == dim)
                    cluster[at] = _nearest(_matrix(v.take(pa.array(at))), held.value[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cluster)], [*batch.schema.names, "dim", "cluster"])
        release()

    dealt = materialise(rows.mapInArrow(assign, "vec_id long, label long, v array<int>, dim int, cluster int"), "lists")
    sizes = dealt.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))  # one row per list
    lists = dealt.join(F.broadcast(sizes), ["dim", "cluster"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")

    def pack(group: pa.Table) -> pa.Table:
        dim, cluster = group["dim"][0].as_py(), group["cluster"][0].as_py()
        x = _matrix(group["v"].combine_chunks())
        c = held.value[dim][cluster] if dim in held.value else np.zeros(dim)
        flat = lambda y: pa.array([np.ascontiguousarray(y).tobytes()], pa.binary())
        values = [pa.array([dim], pa.int32()), pa.array([cluster], pa.int32()), pa.array([group["part"][0].as_py()], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([float(((x - c) ** 2).sum(axis=1).max())]), flat(group["vec_id"].to_numpy()), flat(group["label"].to_numpy()), flat(x.astype(np.int32))]
        return pa.table(values, names=["dim", "cluster", "part", "n", "radius2", "ids", "labels", "vectors"])

    tasks = parts(spark, dealt.count(), 4 * PART_ROWS, spark.sparkContext.defaultParallelism)
    index = materialise(lists.repartition(tasks, "dim", "cluster", "part").groupBy("dim", "cluster", "part").applyInArrow(pack, _INDEX), "inverted")
    discard(dealt)
    held.unpersist()
    index._centroids = centroids
    return index


def _bounds(q: np.ndarray, centroids: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner product of q with any row of each list, rounded outwards."""
    mid = centroids @ q
    reach = np.sqrt((q @ q) * radius2) + 1
    # doubles err by less than this where integers of 62 bits are summed
    slack = 1e-12 * (np.abs(centroids) @ np.abs(q) + reach) + 1
    return mid - reach - slack, mid + reach + slack


def route(asked: DataFrame, lists: Broadcast, best: int, later: bool) -> DataFrame:
    """(dim, cluster, part) of every part that an anchor visits, with what it asks.

    First round: the `best` lists with the highest bounds among those that may hold a score of the window. Later round: all the others whose bound is not strictly below
    the kth score of the first (the column floor; null where fewer than k were found), asked for nothing below it.
    lists: by dimension (centroids, radius2, parts, clusters), a bounded number of lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, place = [], []
            floors = batch.column("floor").to_pylist() if later else [None] * len(batch)
            for i, (v, lo, hi, floor) in enumerate(zip(batch.column("v"), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), floors)):
                if len(v) not in lists.value:
                    continue
                centroids, radius2, count, names = lists.value[len(v)]
                low, high = _bounds(v.values.to_numpy().astype(np.float64), centroids, radius2)
                near = np.argsort(-high, kind="stable")
                near = near[(high[near] >= lo) & (low[near] <= hi)]
                near = near[best:] if later else near[:best]
                if floor is not None:
                    near = near[high[near] >= floor]
                for c in near.tolist():
                    place += [(len(v), int(names[c]), p) for p in range(count[c])]
                    rows += [i] * int(count[c])
            out = batch.select(["anchor_id", "slot", "label", "v", "lo", "hi"])
            if later:
                least = pa.array([lo if f is None else max(lo, f) for lo, f in zip(out.column("lo").to_pylist(), floors)], pa.int64())
                out = out.set_column(4, "lo", least)
            for at in range(0, len(rows), 4096):
                where = np.array(place[at : at + 4096], dtype=np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*map(pa.array, where.T.copy()), *out.take(pa.array(rows[at : at + 4096])).columns], ["dim", "cluster", "part", *out.schema.names])

    return asked.mapInArrow(run, f"dim int, cluster int, part int, {_ASKED}")


def visit(index: DataFrame, visits: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, vec_id, score): each visited part's k best rows of the anchor's label (same) or of others, in its window.

    A part goes once to the task that takes its visitors, ahead of them in the sort order; the task streams, holding one part and 256 visitors.
    """
    flat = index.select("dim", "cluster", "part", F.lit(0).alias("kind"), "ids", "labels", "vectors")
    both = visits.withColumn("kind", F.lit(1)).unionByName(flat, allowMissingColumns=True)
    tasks = parts(index.sparkSession, index.count(), 16, index.sparkSession.sparkContext.defaultParallelism)
    both = both.repartition(tasks, "dim", "cluster", "part").sortWithinPartitions("dim", "cluster", "part", "kind", "anchor_id", "slot")

    def answer(part: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, x = part
        q = _matrix(rows.column("v"))
        if np.abs(q).max() * np.abs(x).max(initial=0) * q.shape[1] < 2.0**53:
            scores = (q @ x.T.astype(np.float64)).astype(np.int64)
        else:
            scores = q.astype(np.int64) @ x.T.astype(np.int64)
        own, lo, hi = (rows.column(c).to_numpy()[:, None] for c in ("label", "lo", "hi"))
        anchors, slots = rows.column("anchor_id").to_numpy(), rows.column("slot").to_numpy()
        fits = ((labels == own) == same) & (ids != anchors[:, None]) & (scores >= lo) & (scores <= hi)
        out = []
        for i in range(len(q)):
            at = np.flatnonzero(fits[i])
            if len(at) > 4 * k:  # ties with the kth stay in
                at = at[scores[i][at] >= np.partition(scores[i][at], len(at) - k)[len(at) - k]]
            at = at[np.lexsort((ids[at], -scores[i][at]))[:k]]
            out.append((np.full(len(at), anchors[i]), np.full(len(at), slots[i], dtype=np.int32), ids[at], scores[i][at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor_id", "slot", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, ()
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "cluster", "part", "kind")], axis=1)
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if keys[lo, 3] == 0:
                    get = lambda c, kind: np.frombuffer(batch.column(c)[lo].as_py(), dtype=kind)  # noqa: B023, E731
                    held, part = tuple(keys[lo, :3]), (get("ids", np.int64), get("labels", np.int64), get("vectors", np.int32).reshape(-1, keys[lo, 0]))
                elif held == tuple(keys[lo, :3]):  # else the hash dealt no row to that part
                    for at in range(lo, hi, 256):
                        yield answer(part, batch.slice(at, min(256, hi - at)))
        release()

    return both.mapInArrow(run, "anchor_id long, slot int, vec_id long, score long")


def _best(answers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, asked: DataFrame, k: int, same: bool, best: int = 8) -> DataFrame:
    """(anchor_id, slot, rank int, vec_id, score long): the k highest scores, ties to smaller ids, among the rows of the anchor's label (same) or of others, in its window.

    asked: (anchor_id, slot, label, v, lo, hi), written; (anchor_id, slot) is unique. The row with the anchor's own id is left out.
    """
    spark = index.sparkSession
    about = index.groupBy("dim", "cluster").agg(F.max("radius2").alias("radius2"), (F.max("part") + 1).alias("parts")).orderBy("dim", "cluster").collect()  # one row per list, a bounded number
    lists = {}
    for dim in {r["dim"] for r in about}:
        own = [r for r in about if r["dim"] == dim]
        names = np.array([r["cluster"] for r in own])
        c = index._centroids[dim][names] if dim in index._centroids else np.zeros((1, dim))
        lists[dim] = c, np.array([r["radius2"] for r in own]), np.array([r["parts"] for r in own]), names
    held = spark.sparkContext.broadcast(lists)
    first = materialise(_best(visit(index, route(asked, held, best, False), k, same), k), "first")
    kth = first.where(F.col("rank") == k).select("anchor_id", "slot", F.col("score").alias("floor"))
    again = visit(index, route(asked.join(kth, ["anchor_id", "slot"], "left"), held, best, True), k, same)
    out = materialise(_best(first.drop("rank").unionByName(again), k), "best")
    discard(first)
    held.unpersist()
    return out.select("anchor_id", "slot", "rank", "vec_id", "score")


def mine(
    df: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100),
    scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", **index,
) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score): hard negatives for each anchor and each of its nearest positives.

    Scores are inner products of the integers floor(scale * component). An anchor's positives are its `positives` highest rows of the same label; for each, the negatives are the
    `negatives` highest rows of other labels whose score lies between low and high (fractions) of the positive's. Ties go to smaller ids.
    is_anchor is a condition on the id column. Rows that take no part: see integers(). Vectors are compared with those of their own dimension only. An id in several rows counts
    once. Anchors without positives, and positives without negatives, give no rows; so does an empty table.
    """
    shared_dir(df.sparkSession)
    rows = materialise(integers(df, id_col, label, vector_col, scale), "integers")
    lists = build_index(rows, **index)
    anchors = rows.withColumn(id_col, F.col("vec_id")).where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.lit(0).alias("slot"), "label", "v", F.lit(_LOW).alias("lo"), F.lit(_HIGH).alias("hi"))
    anchors = materialise(anchors, "anchors")
    near = materialise(search(lists, anchors, positives, True), "positives")
    # the whole numbers between the two fractions of the positive's score
    p = F.col("score").cast("decimal(20,0)")
    lo, hi = F.ceil(p * low[0] / low[1]).cast("long"), F.floor(p * high[0] / high[1]).cast("long")
    asked = near.select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), lo.alias("lo"), hi.alias("hi"))
    windows = materialise(asked.where("lo <= hi").join(anchors.select("anchor_id", "label", "v"), "anchor_id").select("anchor_id", "slot", "label", "v", "lo", "hi"), "windows")
    found = search(lists, windows, negatives, False)
    out = found.join(asked.select("anchor_id", "slot", "positive_id", "positive_score"), ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
