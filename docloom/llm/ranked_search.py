"""Ranked lexical search: exact top-k lists from dual-sorted wavelet trees, one per shard of documents.

A shard concatenates the postings of all its terms, each term's by falling impact, and keeps the documents' numbers in a wavelet tree: level by level, a bit says which half
of a node's documents a posting belongs to. Stable mapping keeps the order by impact, so in every node the first posting of a term's range bounds that term's impact on all documents of the
node; at a leaf it is the impact itself. A search starts with the terms' ranges at the root, opens the nodes with the highest bounds first, intersecting all terms' ranges at once, and drops
nodes whose bound can't reach the kth score any more; what is left is exact.

Scores are integers: a term's weight, floor(1000 ln((2N+2) / (2df+1))), times its impact, (10^9 tf) div (1000 tf + 8 m), with m = 25 + (75 n N) div L.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts, release, shared_dir, small

#: Fixed: what the contract calls a term; letters and digits of ASCII, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEPT = (UPPER + LOWER + "0123456789").encode() + bytes(range(128, 256))
_PLAIN = bytes(b if b in _KEPT else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
_INDEX = "shard long, bits int, n_docs int, docs binary, terms binary, sizes binary, impacts binary, tree binary"


def n_terms(text: Column) -> Column:
    """Number of terms of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).cast("long")


def _split(text: bytes, step: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes of it at a time."""
    at = 0
    while at < len(text):
        end = at + step
        plain = text[at:end].translate(_PLAIN)
        while end < len(text) and _PLAIN[text[end]] != 32:  # the term at the cut, to its end
            more = text[end : end + step].translate(_PLAIN)
            stop = more.find(b" ")
            plain += more if stop < 0 else more[:stop]
            end += len(more) if stop < 0 else stop
        yield plain.split()
        at = end


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Shard:
    """Documents on their way into a shard."""

    def __init__(self) -> None:
        self.numbers, self.docs, self.lengths, self.terms, self.counts, self.postings, self.read = _Numbers(), [], [], [], [], 0, 0

    def add(self, doc_id: int, text: bytes) -> None:
        ids, counts, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        for words in _split(text):
            n += len(words)
            own, tf = np.unique(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words)), return_counts=True)
            if len(ids):
                own, at = np.unique(np.concatenate([ids, own]), return_inverse=True)
                tf = np.bincount(at, np.concatenate([counts, tf]), len(own)).astype(np.int64)
            ids, counts = own, tf
        if n:
            self.docs.append(doc_id)
            self.lengths.append(n)
            self.terms.append(ids)
            self.counts.append(counts)
            self.postings += len(ids)
        self.read += len(text)

    def row(self, shard: int, total_docs: int, total_terms: int) -> pa.RecordBatch:
        order = np.argsort(np.array(self.docs, dtype=np.int64), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        m = 25 + 75 * np.array(self.lengths, dtype=np.int64) * total_docs // total_terms
        sizes = np.array([len(x) for x in self.terms])
        term, tf, doc, m = np.concatenate(self.terms), np.concatenate(self.counts), np.repeat(place, sizes), np.repeat(m, sizes)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        by = np.lexsort((doc, -impact, term))
        doc, impact = doc[by], impact[by]
        bits = max(1, (len(order) - 1).bit_length())
        tree = []
        for level in range(bits):
            nodes = doc[np.argsort(doc >> (bits - level), kind="stable")] if level else doc
            tree.append(np.packbits((nodes >> (bits - 1 - level) & 1).astype(np.uint8)).tobytes())
        values = [np.array(self.docs, dtype=np.int64)[order].tobytes(), b" ".join(self.numbers), np.bincount(term, minlength=len(self.numbers)).astype(np.int32).tobytes(), impact.astype(np.int32).tobytes(), b"".join(tree)]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([bits], pa.int32()), pa.array([len(order)], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], [c.split()[0] for c in _INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 4096, shard_postings: int = 1 << 20, shard_bytes: int = 1 << 25) -> DataFrame:
    """One row per shard, written; its attributes are n_docs, the number of documents with a term, and numbers, a table that counts the shards.

    Rows without an id can't be named and take no part; rows with the same id are documents of their own.

    Documents are gathered within the partitions they lie in, without a shuffle, until a shard has so many documents, postings or bytes of text; one text may go beyond the last two.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    named = docs.where(F.col(id_col).isNotNull())
    n = n_terms(F.col(text_col))
    held, total = named.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    shard.add(doc_id, text.as_py())
                if len(shard.docs) >= shard_docs or shard.postings >= shard_postings or shard.read >= shard_bytes and shard.docs:
                    yield shard.row(number, held, total)
                    shard, number = _Shard(), number + 1
        if shard.docs:
            yield shard.row(number, held, total)
        release()

    index = materialise(named.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, _INDEX), "wavelet")
    index.n_docs = held
    # ids alone, one to some thousands of documents
    index.numbers = materialise(index.select("shard", (F.row_number().over(Window.orderBy("shard")) - 1).alias("no")), "numbers")
    return index


class Tree:
    """A shard's wavelet tree, ready to search: for each level, zeros before each place, and the impacts in its order."""

    def __init__(self, row: dict):
        self.bits, self.docs = row["bits"], np.frombuffer(row["docs"], dtype=np.int64)
        self.names = {t: i for i, t in enumerate(row["terms"].split(b" "))}
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], dtype=np.int32))])
        impact = np.frombuffer(row["impacts"], dtype=np.int32)
        n, width = len(impact), -(-len(impact) // 8)
        raw = np.frombuffer(row["tree"], dtype=np.uint8)
        self.zeros, self.impacts = [], [impact]
        edges = np.array([0, n])  # of the level's nodes
        for level in range(self.bits):
            bit = np.unpackbits(raw[level * width : (level + 1) * width], count=n)
            zeros = np.concatenate([[0], np.cumsum(bit == 0, dtype=np.int32)]).astype(np.int32)
            inside = zeros[edges[1:]] - zeros[edges[:-1]]  # zeros of each node
            # a zero moves to its node's start and as many places on as zeros stand before it there, a one behind all its node's zeros
            shift = np.repeat(edges[:-1] - zeros[edges[:-1]], np.diff(edges)).astype(np.int32)
            ahead = np.repeat(inside + zeros[edges[:-1]], np.diff(edges)).astype(np.int32)
            to = np.where(bit == 0, zeros[:-1] + shift, np.arange(n, dtype=np.int32) - zeros[:-1] + ahead)
            moved = np.empty_like(impact)
            moved[to] = self.impacts[-1]
            self.zeros.append(zeros)
            self.impacts.append(moved)
            edges = np.stack([edges[:-1], edges[:-1] + inside], axis=1).ravel()
            edges = np.append(edges, n)
        self.edges = edges  # of the leaves: postings of documents with smaller numbers

    def ranges(self, terms: list[bytes]) -> np.ndarray:
        """Numbers of the terms; -1 for those that the shard doesn't hold."""
        return np.array([self.names.get(t, -1) for t in terms], dtype=np.int64)

    def _children(self, level: int, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zeros, span = self.zeros[level], self.bits - level
        start, end = self.edges[node << span][:, None], self.edges[(node + 1) << span][:, None]
        before = zeros[start]
        left = start - before
        right = start + (zeros[end] - before) - left
        zl, zr = zeros[lo], zeros[hi]
        return np.concatenate([2 * node, 2 * node + 1]), np.concatenate([left + zl, right + lo - zl]), np.concatenate([left + zr, right + hi - zr])

    def top(self, terms: list[bytes], weights: np.ndarray, k: int, batch: int = 128) -> list[tuple[int, int]]:
        """(score, document) of the k best with a score above 0, best first, ties by document."""
        at = self.ranges(terms)
        weights, at = weights[at >= 0], at[at >= 0]
        # the frontier by level: nodes, ranges of the terms, bounds
        level = np.zeros(1, dtype=np.int64)
        node, lo, hi = np.zeros(1, dtype=np.int64), self.starts[at][None, :], self.starts[at + 1][None, :]
        bound = np.full(1, 1 << 62)
        best, names, floor, last = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, -1
        while len(at) and len(bound):
            first = node << (self.bits - level)
            # what can't come before the kth any more: lower, or as high and all behind it
            alive = (bound > floor) | ((bound == floor) & (first < last))
            level, node, lo, hi, bound, first = level[alive], node[alive], lo[alive], hi[alive], bound[alive], first[alive]
            open_ = np.lexsort((first, -bound))[:batch]
            rest = np.ones(len(bound), dtype=bool)
            rest[open_] = False
            kept = [(level[rest], node[rest], lo[rest], hi[rest], bound[rest])]
            for depth in np.unique(level[open_]).tolist():
                own = open_[level[open_] == depth]
                n, a, b = self._children(depth, node[own], lo[own], hi[own])
                held = self.impacts[depth + 1]
                most = np.where(b > a, held[np.minimum(a, len(held) - 1)], 0) @ weights
                some = most > 0
                n, a, b, most = n[some], a[some], b[some], most[some]
                if depth + 1 == self.bits:
                    best, names = np.concatenate([best, most]), np.concatenate([names, n])
                    order = np.lexsort((names, -best))[:k]
                    best, names = best[order], names[order]
                else:
                    kept.append((np.full(len(n), depth + 1), n, a, b, most))
            if len(best) == k:
                floor, last = int(best[-1]), int(names[-1])
            level, node, lo, hi, bound = (np.concatenate(x) for x in zip(*kept))
        return [(int(s), int(d)) for s, d in zip(best, names)]


def _to_shards(index: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Every row to every shard, behind the shard's own row, in the partition and order in which a task streams them. index.numbers counts the shards from 0."""
    n = index.numbers.count()
    own = index.select("shard", *columns).join(small(index.numbers), "shard").select("no", F.lit(0).alias("kind"), *columns)
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.explode(F.array().cast("array<int>"))
    both = rows.select(each.alias("no"), F.lit(1).alias("kind"), "*").unionByName(own, allowMissingColumns=True)
    return both.repartition(max(1, n), "no").sortWithinPartitions("no", "kind")


def frequencies(index: DataFrame, terms: DataFrame, together: int = 1024) -> DataFrame:
    """(term, df long): the number of documents that hold each term of the column term; those that none holds are missing. terms: distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[bytes, int] = {}
        for batch in batches:
            for kind, own, counts, asked in zip(batch.column("kind").to_pylist(), batch.column("terms"), batch.column("sizes"), batch.column("asked")):
                if kind == 0:
                    sizes = dict(zip(own.as_py().split(b" "), np.frombuffer(counts.as_py(), dtype=np.int32).tolist()))
                else:
                    found = [(t.decode(), sizes[t]) for t in map(str.encode, asked.as_py()) if t in sizes]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], ["term", "df"])
        release()

    blocks = parts(index.sparkSession, terms.count(), together)
    asked = terms.groupBy(F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block")).agg(F.collect_list("term").alias("asked")).select("asked")
    return _to_shards(index, asked, ["terms", "sizes"]).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, rank int, doc_id, score long): the k best documents of each query with a score above 0, ties by ascending doc_id.

    index: as from build_index. A query is a distinct (id, text), so repeated rows count once; null texts and texts without a term find nothing. Terms count as often as the query repeats them.
    Every query goes to every shard, as a stated query set does, and each shard once to the task that streams its queries; a shard answers with k rows a query at most.
    """
    plain = F.translate(F.col(text_col), UPPER, LOWER)
    asked = queries.select(F.col(id_col).alias("query_id"), text_col).distinct().select("query_id", F.xxhash64(text_col).alias("q"), F.explode(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))).alias("term"))
    asked = materialise(asked.groupBy("query_id", "q", "term").agg(F.count("*").alias("times")), "asked")
    df = materialise(frequencies(index, asked.select("term").distinct()), "frequencies")
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df, "term").groupBy("query_id", "q").agg(F.collect_list(F.struct("term", (weight * F.col("times")).alias("w"))).alias("of"))
    weighed = weighed.select("query_id", "q", F.col("of.term").alias("words"), F.col("of.w").alias("weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("query_id")
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == 0:
                    tree = Tree({c: batch.column(c)[i].as_py() for c in ("bits", "docs", "terms", "sizes", "impacts", "tree")})
                else:
                    words = [w.encode() for w in batch.column("words")[i].as_py()]
                    out += [(i, batch.column("q")[i].as_py(), int(tree.docs[d]), s) for s, d in tree.top(words, np.array(batch.column("weights")[i].as_py(), dtype=np.int64), k)]
            at, q, doc, score = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in (q, doc, score)]], ["query_id", "q", "doc_id", "score"])
        release()

    id_type = queries.schema[id_col].dataType.simpleString()
    answers = _to_shards(index, weighed, ["bits", "docs", "terms", "sizes", "impacts", "tree"]).mapInArrow(run, f"query_id {id_type}, q long, doc_id long, score long")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "doc_id")
    ranked = answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(id_col), "rank", "doc_id", "score")
