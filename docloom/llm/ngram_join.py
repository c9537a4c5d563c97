"""Self-join on n-gram Jaccard similarity: MinHash banding finds candidates, full n-gram sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, label, materialise, parts, release, shared_dir, spread_join

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of `rows` rows that find a pair of this similarity with at least this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            with np.errstate(over="ignore"):
                m = 1 << int(n).bit_length()
                cls.up = np.concatenate([[_U(1)], np.cumprod(np.full(m, _BASE, dtype=np.uint64))])
                cls.down = np.concatenate([[_U(1)], np.cumprod(np.full(m, _INVERSE, dtype=np.uint64))])
        return cls.up[:n], cls.down[:n]


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of n words ([^\\x20\\x09-\\x0D]+). A text of 1 to n - 1 words is one run; one without words has none."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    edge = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up, down = _Powers.upto(len(raw) + 1)
        total = np.concatenate([[_U(0)], np.cumsum(_TABLE[raw] * up[:-1])])
        words = _mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        k = min(n, len(words))
        run = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for j in range(k):
            run = (run + words[j : len(words) - k + 1 + j]) * _U(0xD6E8FEB86659FD93)
            run ^= run >> _U(29)
        return np.unique(_mix(run ^ _U(k)))


@lru_cache
def _factors(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]


def signature(s: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """One 64-bit hash per band from the MinHash values of a set of hashes."""
    k = bands * rows
    a, b = _factors(k, seed)
    x = (s ^ (s >> _U(32))).astype(np.uint32)
    low = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 512):
            v = a * x[None, i : i + 512]
            v += b
            np.minimum(low, v.min(axis=1), out=low)
        v, h = low.reshape(bands, rows).astype(np.uint64), np.arange(1, bands + 1, dtype=np.uint64)
        for j in range(rows):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + v[:, j])
    return h.view(np.int64)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    with np.errstate(over="ignore"):
        m = _mix(s + _U(0x632BE59BD9B4E019))
        return int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(m).view(np.int64))


def sign(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(node: a number of the row's own, doc_id, row_key: a hash of id and text, size, k1, k2: the set's key, bands array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                size, keys, sigs = [], [], []
                for cell in part.column(1):
                    s = shingles(cell.as_py(), n)
                    size.append(len(s))
                    keys.append(_set_key(s))
                    sigs.append(signature(s, bands, rows) if len(s) else np.zeros(0, dtype=np.int64))
                cells = [pa.array(range(node, node + part.num_rows), pa.int64()), part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sigs, pa.list_(pa.int64()))]
                node += part.num_rows
                yield pa.RecordBatch.from_arrays(cells, names=["node", "doc_id", "row_key", "size", "k1", "k2", "bands"])
        release()

    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).withColumn("row_key", F.xxhash64("doc_id", text_col))
    return row.mapInArrow(run, "node long, doc_id long, row_key long, size long, k1 long, k2 long, bands array<long>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections; memory is bounded by blocks of shared hashes."""
    m = len(sets)
    out = np.zeros((m, m), dtype=np.int64)
    if m <= 6:
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    shared = np.bincount(group)[group] > 1
    group, owner = np.unique(group[shared], return_inverse=True)[1], owner[shared]
    width = 8192
    for lo in range(0, int(group.max()) + 1 if len(group) else 0, width):
        a, b = np.searchsorted(group, [lo, lo + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[owner[a:b], group[a:b] - lo] = 1
        out += (x @ x.T).astype(np.int64)
    return out


_VERIFY = "node long, low long, links long"


def _verify(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        root, i, j, node, copies, block = (table[c].to_numpy() for c in ("root", "i", "j", "node", "copies", "block"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["hashes"].to_pylist()]
        out_node, out_low, out_links = [], [], []
        order = np.lexsort((node, block, j, i, root))
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(root[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0), [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            at = order[a:b]
            size = np.array([len(sets[k]) for k in at])
            both = overlaps([sets[k] for k in at])
            linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if i[at[0]] != j[at[0]]:  # two blocks of a large group: pairs inside either are seen elsewhere
                linked &= block[at][:, None] != block[at][None, :]
            low = node[at].copy()
            while True:
                new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (new == low).all():
                    break
                low = new
            out_node.append(node[at])
            out_low.append(low)
            out_links.append((linked * copies[at][None, :]).sum(axis=1))
        return pa.table({"node": np.concatenate(out_node), "low": np.concatenate(out_low), "links": np.concatenate(out_links)})

    return run


def _place(members: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Adds blocks and block to members (root, node, size, center, ...): how many blocks a component has, and which is the row's.

    A block holds about `block` members or block_bytes of hashes. Members of one center, which share a bucket, go to the same blocks as far as they fit, so that most blocks of a
    component that chance ties hold together have no bucket in common. members: written, as it is read several times; so are the steps here, or each would hold the plans of those before many times over.
    """
    fit = lambda n, b: F.greatest(F.ceil(F.col(n) / block), F.ceil(8 * F.col(b) / block_bytes)).cast("long")
    whole = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("w")).select("root", fit("m", "w").alias("blocks"))
    members = materialise(spread_join(members, whole, "root", "node"), "components")
    own = members.where("blocks > 1").groupBy("center").agg(F.count("*").alias("m"), F.sum("size").alias("w")).select("center", fit("m", "w").alias("shares"))
    large = spread_join(members.where("blocks > 1"), own, "center", "node")
    share = F.pmod(F.xxhash64("node"), F.col("shares"))
    large = large.withColumn("block", F.pmod(F.xxhash64("center", share), F.col("blocks"))).drop("shares")
    out = materialise(members.where("blocks = 1").withColumn("block", F.lit(0).cast("long")).unionByName(large), "members")
    discard(members)
    return out


def _pairs(members: DataFrame, put: DataFrame, similarity: float) -> DataFrame:
    """(root, i, j), i < j: the blocks of large components that have to be compared, since some bucket reaches into both and their sets' sizes allow a link."""
    large = members.where("blocks > 1").select("root", "node", "block", "size")
    sizes = large.groupBy("root", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    reach = put.join(large.select("node", "root", "block"), "node").select("h", "root", "block").distinct()
    # a bucket lies in one component; only buckets that reach into two blocks or more make pairs
    wide = reach.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    reach = reach.join(wide, "h", "left_semi")
    i, j = reach.select("h", "root", F.col("block").alias("i")), reach.select("h", F.col("block").alias("j"))
    met = i.join(j, "h").where("i < j").select("root", "i", "j").distinct()
    a = sizes.select("root", F.col("block").alias("i"), F.col("least").alias("a_least"), F.col("most").alias("a_most"))
    b = sizes.select("root", F.col("block").alias("j"), F.col("least").alias("b_least"), F.col("most").alias("b_most"))
    may = (F.col("a_most") >= similarity * F.col("b_least") - 1e-9) & (F.col("b_most") >= similarity * F.col("a_least") - 1e-9)
    return met.join(a, ["root", "i"]).join(b, ["root", "j"]).where(may).select("root", "i", "j")


def similar(
    docs: DataFrame, similarity: float = 0.8, n: int = 5, rows: int = 7, recall: float = 0.9999, block: int = 256, block_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: (node, doc_id, row_key, class_id, n_links, first).

    A link joins two rows whose sets of n-word runs have a Jaccard similarity of at least `similarity`; n_links counts a row's links, copies included. class_id is the smallest doc_id
    among the rows that links connect, and first is true for one row of each class. Rows without words have no links and are classes of their own; null ids count as
    smallest, but other ids name the class where there are any.

    Steps: rows with the same set are one class representative. Representatives meet in buckets of equal band hashes; each is tied to the smallest
    of its bucket, so a bucket makes as many rows as it has members, and the ties' connected components hold every pair that shares a bucket.
    Components are verified on full sets: small ones whole, several to a task; large ones in blocks of `block` representatives or block_bytes of hashes, each
    block in itself and each pair of blocks that some bucket reaches into. A group is compared by counting shared hashes in a matrix, and only each member's links
    and its smallest partner come out. bands follow from similarity, rows and recall (the chance to find a pair right at the threshold; pairs above it have more).
    Keys that many rows share (a bucket, a component, a center) are joined with salts.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    bands = bands_for(similarity, recall, rows)
    signed = materialise(sign(docs, n, bands, rows, id_col, text_col), "signed")
    key = ["size", "k1", "k2"]
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best")
    reps = signed.where("size > 0").groupBy(*key).agg(F.min("node").alias("rep"), F.count("*").alias("copies"), best)
    reps = materialise(reps, "reps")
    put = signed.join(reps.select(F.col("rep").alias("node")), "node", "left_semi").select("node", F.explode("bands").alias("h"))
    low = put.groupBy("h").agg(F.min("node").alias("low"), F.count("*").alias("m")).where("m > 1").select("h", "low")
    put = materialise(spread_join(put, low, "h", "node"), "buckets")
    found = label(put.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    centers = put.groupBy("node").agg(F.min("low").alias("center"))
    members = found.join(centers, "node").join(reps.select(F.col("rep").alias("node"), "copies", *key), "node").join(signed.select("node", "row_key"), "node")
    found = materialise(members, "found")
    members = _place(found, block, block_bytes)
    discard(found)

    # full sets of the members only
    texts = docs.select(F.xxhash64(F.col(id_col).cast("long"), text_col).alias("row_key"), F.col(text_col).alias("text")).join(members.select("row_key").distinct(), "row_key", "left_semi").select("text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(x.as_py(), n) for x in part.column(0)]
                keys = [_set_key(s) for s in sets]
                cells = [pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=[*key, "hashes"])
        release()

    sets = members.join(texts.mapInArrow(full, "size long, k1 long, k2 long, hashes binary").dropDuplicates(key), key)
    sets = materialise(sets.select("root", "node", "copies", "block", "blocks", "size", "hashes"), "sets")
    columns = ["root", "node", "copies", "block", "hashes"]
    # small components share tasks, about block_bytes of hashes in each; of a large one, each block and each pair of blocks is a group
    shares = parts(spark, 8 * (members.agg(F.sum("size")).first()[0] or 0), block_bytes)
    none = F.lit(-1).cast("long")
    alone = sets.where("blocks = 1").select(*columns, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), none.alias("large"), F.pmod(F.xxhash64("root"), F.lit(shares)).alias("share"))
    pairs = materialise(_pairs(members, put, similarity), "pairs")
    ends = pairs.select("root", F.expr("inline(array(struct(i AS block, i, j), struct(j AS block, i, j)))"))
    ends = ends.unionByName(members.where("blocks > 1").select("root", "block", F.col("block").alias("i"), F.col("block").alias("j")).distinct())
    large = sets.where("blocks > 1").join(ends, ["root", "block"]).select(*columns, "i", "j", F.col("root").alias("large"), F.lit(0).cast("long").alias("share"))
    checked = alone.unionByName(large).groupBy("large", "share", "i", "j").applyInArrow(_verify(similarity), _VERIFY)
    checked = materialise(checked, "checked")
    discard(sets, put, pairs)

    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = label(checked.where("low <> node").select(F.col("node").alias("a"), F.col("low").alias("b")))
    per = reps.withColumnRenamed("rep", "node").join(joined, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = linked = materialise(per, "linked")
    tops = per.groupBy("root").agg(F.min("best").alias("top"))
    per = spread_join(per, tops, "root", "node").select(*key, F.col("top.doc_id").alias("class_id"), F.col("top.node").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per = materialise(per, "classes")
    discard(members, checked, reps, linked)
    # copies of one text are a hub here too, and rows without words have no class of their own in `per`
    out = spread_join(signed.where("size > 0").select("node", "doc_id", "row_key", F.struct(*key).alias("k")), per.select(F.struct(*key).alias("k"), "class_id", "top", "n_links"), "k", "node")
    out = out.select("node", "doc_id", "row_key", "class_id", F.col("n_links").cast("long").alias("n_links"), (F.col("node") == F.col("top")).alias("first"))
    alone = signed.where("size = 0").select("node", "doc_id", "row_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without near duplicates: of each class of similar(), one row stays, with all its columns. Rows alike in id and text are one.

    The join on a row's key and the removal of repeated rows work on the same partitioning, so texts are moved once.
    """
    first = similar(docs, id_col=id_col, text_col=text_col, **how).where("first").select(F.col("row_key").alias("_row_key")).distinct()
    keyed = docs.withColumn("_row_key", F.xxhash64(F.col(id_col).cast("long"), text_col))
    return keyed.join(first, "_row_key", "left_semi").dropDuplicates(["_row_key"]).drop("_row_key")
