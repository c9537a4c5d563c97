"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, stored as flat neighbour arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, shared_dir, small

_INDEX = "shard long, dim int, n int, top int, ids binary, vectors binary, levels binary, neighbours binary"


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1: cosines stay the same to the last bit, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _greedy(x: np.ndarray, links: np.ndarray, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place each query reaches from `at` by going to the nearest neighbour while that is nearer."""
    at = at.copy()
    sim, moving = np.einsum("ij,ij->i", x[at], queries), np.arange(len(queries))
    while len(moving):
        c = links[at[moving]]
        s = np.where(c >= 0, np.einsum("ijk,ik->ij", x[np.maximum(c, 0)], queries[moving]), -np.inf)
        best = s.argmax(axis=1)
        top = s[np.arange(len(moving)), best]
        better = top > sim[moving]
        moving, to, top = moving[better], c[np.arange(len(c)), best][better], top[better]
        at[moving], sim[moving] = to, top
    return at


def _beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities of `width` near nodes for each query (-1: none), best first, from its entries [queries, some] (-1: none), all queries moving at once."""
    q, n = len(queries), len(x)
    width = max(width, entries.shape[1])
    found = np.full((q, width), -1, dtype=np.int64)
    score = np.full((q, width), -np.inf)
    done = np.ones((q, width), dtype=bool)
    seen = np.zeros((q, n), dtype=bool)
    rows, cols = np.nonzero(entries >= 0)
    start = entries[rows, cols]
    found[rows, cols], done[rows, cols] = start, False
    score[rows, cols] = np.einsum("ij,ij->i", x[start], queries[rows])
    seen[rows, start] = True
    active = np.arange(q)
    while len(active):
        todo = np.where(done[active], -np.inf, score[active])
        pick = todo.argmax(axis=1)
        go = todo[np.arange(len(active)), pick] > -np.inf
        active, pick = active[go], pick[go]
        if not len(active):
            break
        done[active, pick] = True
        c = links[found[active, pick]]
        fresh = (c >= 0) & ~seen[active[:, None], np.maximum(c, 0)]
        r, col = np.nonzero(fresh)
        seen[active[r], c[r, col]] = True
        s = np.full(c.shape, -np.inf)
        s[r, col] = np.einsum("ij,ij->i", x[c[r, col]], queries[active[r]])
        all_s = np.concatenate([score[active], s], axis=1)
        all_i = np.concatenate([found[active], np.where(fresh, c, -1)], axis=1)
        all_d = np.concatenate([done[active], ~fresh], axis=1)
        keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        score[active] = np.take_along_axis(all_s, keep, axis=1)
        found[active] = np.take_along_axis(all_i, keep, axis=1)
        done[active] = np.take_along_axis(all_d, keep, axis=1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)


def _choose(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (places, nearest first, with similarities own), those to link: nearer to the node than to any chosen before, so that links point apart; places left over go to the nearest others."""
    if len(candidates) <= most:
        return candidates
    v = x[candidates]
    among = v @ v.T
    taken, nearest = [], np.full(len(candidates), -np.inf)
    for j in range(len(candidates)):
        if own[j] > nearest[j]:
            taken.append(j)
            if len(taken) == most:
                break
            np.maximum(nearest, among[j], out=nearest)
    if len(taken) < most:
        free = np.ones(len(candidates), dtype=bool)
        free[taken] = False
        taken = np.sort(np.concatenate([taken, np.flatnonzero(free)[: most - len(taken)]])).astype(np.int64)
    return candidates[taken]


def build_graph(x: np.ndarray, m: int, pool: int, seed: int, batch: int = 256) -> tuple[np.ndarray, list[np.ndarray]]:
    """Levels of the nodes, and for each level an int32 array [n, width] of neighbours (-1: none); width is 2 m on level 0, m above.

    x: unit vectors. Node levels fall off geometrically. Nodes come in at random, the highest first, in batches that grow to `batch`: each searches the graph so
    far for its `pool` nearest on every level it has, sees the others of its batch too, and links to m of them (m / 2 above level 0). Links hold both ways; a
    node with too many keeps those that point apart. So building costs a search per node, not a comparison of all pairs.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    levels = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(m)).astype(np.int32), 8)
    order = rng.permutation(n)
    if n:
        first = int(np.argmax(levels[order]))
        order[[0, first]] = order[[first, 0]]
    top = int(levels.max()) if n else 0
    widths = [2 * m if level == 0 else m for level in range(top + 1)]
    # room for twice the links while building, so that few nodes have to choose before the end
    room = [np.full((n, 2 * w), -1, dtype=np.int32) for w in widths]
    used = [np.zeros(n, dtype=np.int64) for _ in widths]

    def shrink(level: int, node: int, most: int) -> None:
        c = room[level][node, : used[level][node]].astype(np.int64)
        own = x[c] @ x[node]
        by = np.argsort(-own, kind="stable")
        kept = _choose(x, own[by], c[by], most)
        room[level][node] = -1
        room[level][node, : len(kept)], used[level][node] = kept, len(kept)

    at = 1
    while at < n:
        new = order[at : at + min(batch, at)]
        at += len(new)
        entry = np.full(len(new), order[0])
        among = x[new] @ x[new].T
        np.fill_diagonal(among, -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(top, -1, -1):
            who = np.flatnonzero(levels[new] >= level)
            if level:
                above = np.flatnonzero(levels[new] < level)
                entry[above] = _greedy(x, room[level], x[new[above]], entry[above])
            if len(who):
                near, sim = _beam(x, room[level], x[new[who]], entry[who][:, None], pool)
                entry[who] = near[:, 0]
                found.append((who, near, sim))
            else:
                found.append((who, np.zeros((0, pool), dtype=np.int64), np.zeros((0, pool))))
        for level, (who, near, sim) in zip(range(top, -1, -1), found):
            beside = among[np.ix_(who, who)]
            most = widths[level] // 2
            for i, row in enumerate(who):
                peers = np.flatnonzero(beside[i] > (sim[i][min(most, len(sim[i])) - 1]))
                c = np.concatenate([near[i][near[i] >= 0], new[who[peers]]])
                own = np.concatenate([sim[i][near[i] >= 0], beside[i][peers]])
                by = np.argsort(-own, kind="stable")[:pool]
                node = new[row]
                for j in _choose(x, own[by], c[by], most):
                    for a, b in ((node, j), (j, node)):
                        k = used[level][a]
                        if (room[level][a, :k] == b).any():
                            continue
                        if k == room[level].shape[1]:
                            shrink(level, a, widths[level])
                            k = used[level][a]
                        room[level][a, k] = b
                        used[level][a] = k + 1
    for level, w in enumerate(widths):
        for node in np.flatnonzero(used[level] > w):
            shrink(level, int(node), w)
    return levels, [np.ascontiguousarray(r[:, :w]) for r, w in zip(room, widths)]


def search_graph(x: np.ndarray, levels: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, width: int, entries: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities of `width` near nodes for each query (-1: none), best first: down the levels with up to `entries` places each, then the lowest with the whole width."""
    near = np.full((len(queries), 1), int(np.argmax(levels)), dtype=np.int64)
    for level in range(len(graph) - 1, 0, -1):
        near = _beam(x, graph[level], queries, near, entries)[0][:, :entries]
    found, score = _beam(x, graph[0], queries, near, max(width, near.shape[1]))
    return found[:, :width], score[:, :width]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>), one row per id, of the rows that take part: an id, and a vector without null, NaN or infinite components and not all zero. Of several such rows of one id, the smallest vector counts."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def build_index(vectors: DataFrame, k: int, shard_rows: int = 4096, m: int = 16, pool: int = 64, seed: int = 0) -> DataFrame:
    """One row per shard: ids, vectors and graph as flat binary arrays. vectors: as from usable().

    Rows with the same vector are one node that lists their k + 1 smallest ids, more than which no answer can need; so a vector that a third of the rows share
    is one node. Shards hold about shard_rows nodes of one dimension, dealt by a hash of the vector, and no more come together in a task.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    v = vectors.withColumn("h", F.xxhash64("vector")).withColumn("dim", F.size("vector"))
    first = v.withColumn("r", F.row_number().over(Window.partitionBy("h", "vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = first.groupBy("h", "dim", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialise(nodes, "nodes")
    counts = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))
    dealt = nodes.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("h"), F.col("shards")))

    def build(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        x = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        lists = group["ids"].to_pylist()
        ids = np.full((len(lists), k + 1), -(2**63), dtype=np.int64)
        sizes = np.array([len(a) for a in lists], dtype=np.int64)
        for i, a in enumerate(lists):
            ids[i, : len(a)] = a
        x = _scaled(x)
        order = np.argsort(ids[:, 0], kind="stable")
        x, ids, sizes = np.ascontiguousarray(x[order]), ids[order], sizes[order]
        levels, graph = build_graph(_unit(x), m, pool, seed)
        flat = np.concatenate([g.ravel() for g in graph]) if graph else np.zeros(0, dtype=np.int32)
        return pa.table({
            "shard": pa.array([group["shard"][0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(x)], pa.int32()), "top": pa.array([len(graph)], pa.int32()),
            "ids": pa.array([np.concatenate([sizes[:, None], ids], axis=1).tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()), "levels": pa.array([levels.tobytes()], pa.binary()), "neighbours": pa.array([flat.tobytes()], pa.binary()),
        })

    # building costs far more than its bytes suggest, so shards get tasks of their own rather than being gathered by size
    tasks = max(1, -(-nodes.count() // shard_rows))
    return dealt.select("shard", "dim", "vector", "ids").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, _INDEX)


def _flat(row: pa.RecordBatch, m: int) -> tuple:
    """An index row as arrays: ids, vectors, unit vectors, norms, levels, graph."""
    get = lambda name: row.column(name)[0]
    n, dim, top = get("n").as_py(), get("dim").as_py(), get("top").as_py()
    x = np.frombuffer(get("vectors").as_py(), dtype=np.float64).reshape(n, dim)
    ids = np.frombuffer(get("ids").as_py(), dtype=np.int64).reshape(n, -1)
    flat, graph, at = np.frombuffer(get("neighbours").as_py(), dtype=np.int32), [], 0
    for level in range(top):
        w = 2 * m if level == 0 else m
        graph.append(flat[at : at + n * w].reshape(n, w))
        at += n * w
    return ids, x, _unit(x), np.sqrt(np.einsum("ij,ij->i", x, x)), np.frombuffer(get("levels").as_py(), dtype=np.int32), graph


def search(index: DataFrame, queries: DataFrame, k: int = 5, width: int = 128, together: int = 256, m: int = 16) -> DataFrame:
    """(query_id, rank int, vec_id, score): the k nearest found for each query by cosine, over all shards; the query's own row is left out.

    index: as from build_index, written, with the same k and m. queries: as from usable(). Each query goes to every shard of its dimension, and each shard once to the task that takes its
    queries, ahead of them in the sort order: the task streams, holding one shard and `together` queries. Each shard answers with k rows a query, and the answers are merged per query.
    """
    # one row per dimension
    where = materialise(index.groupBy("dim").agg(F.max("shard").alias("last")), "shards")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("shard")
    asked = queries.withColumn("dim", F.size("vector")).join(small(where), "dim").select("dim", every, F.lit(1).alias("kind"), "vec_id", "vector")
    flat = index.select("dim", "shard", F.lit(0).alias("kind"), "n", "top", "ids", "vectors", "levels", "neighbours")
    both = asked.unionByName(flat, allowMissingColumns=True).repartition(max(1, index.count()), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answer(shard: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, x, unit, norms, levels, graph = shard
        names = rows.column("vec_id").to_pylist()
        asked = _scaled(rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1))
        found, _ = search_graph(unit, levels, graph, _unit(asked), min(width, len(x)))
        a: list[tuple[int, int, float]] = []
        for i, name in enumerate(names):
            near = found[i][found[i] >= 0]
            exact = (x[near] * asked[i]).sum(axis=1) / (norms[near] * np.sqrt((asked[i] * asked[i]).sum()))
            own = []
            for j in np.lexsort((ids[near, 1], -exact))[: k + 1]:
                node = near[j]
                own += [(name, int(v), float(exact[j])) for v in ids[node, 1 : 1 + ids[node, 0]] if v != name]
            own.sort(key=lambda t: (-t[2], t[1]))
            a += own[:k]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*a) if a else ((), (), ()), out.types)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, ()
        for batch in batches:
            dims, shards, kinds = (batch.column(c).to_numpy() for c in ("dim", "shard", "kind"))
            new = (kinds[1:] == 0) | (kinds[:-1] == 0) | (shards[1:] != shards[:-1]) | (dims[1:] != dims[:-1])
            edges = np.flatnonzero(np.concatenate([[True], new, [True]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if kinds[lo] == 0:
                    held, shard = (dims[lo], shards[lo]), _flat(batch.slice(lo, 1), m)
                elif held == (dims[lo], shards[lo]):  # else no vector fell on that number
                    for at in range(lo, hi, together):
                        yield answer(shard, batch.slice(at, min(together, hi - at)))
        release()

    answers = both.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", **index) -> DataFrame:
    """The k nearest other rows of each row that is_query (a Column on the id) holds for. Rows not usable() take no part, on either side.

    An id counts once, as a query and as an answer, with its smallest usable vector. Vectors are compared with those of their own dimension only. Fewer than k other rows: all of them. An empty table gives no rows.
    """
    shared_dir(df.sparkSession)
    rows = materialise(usable(df, id_col, vector_col), "vectors")
    asked = rows.withColumn(id_col, F.col("vec_id")).where(is_query).select("vec_id", "vector")
    return search(materialise(build_index(rows, k, **index), "hnsw"), asked, k)
