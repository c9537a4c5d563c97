"""LM scoring: context-tree weighting over bytes gives every text its code length.

A text is its words (A-Z lower-cased, parted by one blank) and an end mark. Each byte is eight binary decisions; a decision's node is the context, the last d bytes for every d from 0 to `depth`,
and the bits of the byte so far. A node estimates its next bit from its counts as Krichevsky and Trofimov do, and weighs that against the weighted estimates of the nodes with one more
byte of context. Learning is counting: the runs of depth + 1 bytes of the texts to learn from, summed. Weights come from the counts, deepest contexts first, and probabilities go the other way, down from the
root, until each run has the probability of its last byte. The model then stands still: a text's probability is the product over its bytes, in base 10.

Documents are read in blocks. A block's distinct runs, with their counts in what is learned from, go to shards by hash; there they are summed, dealt anew by the last bytes of their contexts, so
that a whole subtree lies in one task (at most 2^24 runs share one), and weighed; the few levels above are sums over all tasks. The questions of all blocks then meet the probabilities
in the shards, and answers go back to the blocks. Words take the same way for the unigram figures. Rows carry sorted arrays, and no task holds a model or the questions to it as a whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, parts, release, shared_dir

_U = np.uint64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The end mark; blanks never occur in words.
END = b"\n"
_TEXT, _RUNS, _WORDS = 0, 1, 2
_BLOCKS = "kind int, shard int, block long, keys binary, vals binary, meta binary"


def words_of(text: bytes, step: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes of it at a time. (bytes.split parts at the contract's six blanks, no others.)"""
    at = 0
    while at < len(text):
        end = at + step
        piece = text[at:end]
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":  # the word at the cut, to its end
            more = text[end : end + step].split(maxsplit=1)[0]
            piece += more
            end += len(more)
        yield piece.translate(_LOWER).split()
        at = end


def runs_of(data: np.ndarray, length: int) -> np.ndarray:
    """Runs of `length` bytes as integers, the first byte highest; one less than `length` fewer than data."""
    if length == 1:
        return data.astype(_U)
    half = length // 2
    high = runs_of(data, length - half)
    low = high if half == length - half else runs_of(data, half)
    return (high[: len(data) - length + 1] << _U(8 * half)) | low[length - half :][: len(data) - length + 1]


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _padded(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each behind `depth` end marks, so that its first bytes have whole contexts; where each begins."""
    starts = np.cumsum([0, *[len(t) + depth for t in texts]])[:-1]
    return np.frombuffer(b"".join([x for t in texts for x in (END * depth, t)]), dtype=np.uint8), starts


def _steps(data: np.ndarray, starts: np.ndarray, depth: int, step: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, runs that end at each place from there, whether they belong to a text rather than the marks before it)."""
    for a in range(depth, len(data), step):
        b = min(len(data), a + step)
        fits = np.ones(b - a, dtype=bool)
        own = starts[np.searchsorted(starts, a - depth) : np.searchsorted(starts, b)]
        for k in range(depth):
            at = own + k - a
            fits[at[(at >= 0) & (at < b - a)]] = False
        yield a, runs_of(data[a - depth : b], depth + 1), fits


def count_runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    data, starts = _padded(texts, depth)
    keys, counts = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    for _, runs, fits in _steps(data, starts, depth):
        runs = np.sort(runs[fits])
        first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, dtype=np.int64)
        own = np.diff(np.append(first, len(runs)))
        keys, counts = _add_up(np.concatenate([keys, runs[first]]), np.concatenate([counts, own]))
    return keys, counts


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit integers."""
    x = x * _U(0x9E3779B97F4A7C15)
    return (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def _deal(keys: np.ndarray, of: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of keys that hash to each shard, in the order of the keys."""
    shard = ((_mix(of) >> _U(33)) % _U(shards)).astype(np.uint16 if shards <= 1 << 16 else np.uint32)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for i in np.flatnonzero(np.diff(edges)).tolist():
        yield i, order[edges[i] : edges[i + 1]]


class _Block:
    """Documents on their way into a block: those to learn from, and the others."""

    def __init__(self) -> None:
        self.texts: tuple[list, list] = ([], [])
        self.names: tuple[list, list] = ([], [])
        self.words: Counter = Counter()
        self.seen: set = set()
        self.bytes = 0

    def add(self, name: int | None, learned: bool, text: bytes) -> None:
        said = []
        for words in words_of(text):
            said += [b" ".join(words)] if words else []
            self.words.update(words) if learned else self.seen.update(words)
        self.words.update([END]) if learned else self.seen.add(END)
        self.texts[learned].append(b" ".join(said) + END)
        self.names[learned].append(name)
        self.bytes += len(self.texts[learned][-1])

    def rows(self, block: int, shards: int, depth: int) -> Iterator[pa.RecordBatch]:
        (other, own), (other_names, own_names) = self.texts, self.names
        names, n = own_names + other_names, len(own)
        lengths = np.array([len(t) for t in own + other], dtype=np.int64)
        meta = np.array([0 if x is None else x for x in names], dtype=np.int64).tobytes() + bytes((x is None) | (i < n) << 1 for i, x in enumerate(names))
        yield _row(_TEXT, 0, block, pa.compress(b"".join(own + other), "zstd", asbytes=True), lengths.tobytes(), meta)
        learned, counts = count_runs(own, depth)
        heard, _ = count_runs(other, depth)
        keys, counts = _add_up(np.concatenate([learned, heard]), np.concatenate([counts, np.zeros(len(heard), dtype=np.int64)]))
        for shard, at in _deal(keys, keys, shards):
            yield _row(_RUNS, shard, block, keys[at].tobytes(), counts[at].tobytes())
        by: dict[int, list] = {}
        for word in self.words.keys() | self.seen:
            by.setdefault(zlib.crc32(word) % shards, []).append(word)
        for shard, own in by.items():
            yield _row(_WORDS, shard, block, b" ".join(own), np.array([self.words[w] for w in own], dtype=np.int64).tobytes())


def _row(kind: int, shard: int, block: int, keys: bytes, vals: bytes, meta: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in (keys, vals, meta)]], ["kind", "shard", "block", "keys", "vals", "meta"])


def read_blocks(docs: DataFrame, learn: Column, id_col: str, text_col: str, depth: int, shards: int, block_bytes: int) -> DataFrame:
    """Blocks of texts, the runs and the words of each (see _BLOCKS); a text larger than block_bytes is a block by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, number = _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for name, learned, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block.add(name, learned, text.as_py() or b"")
                if block.bytes >= block_bytes:
                    yield from block.rows(number, shards, depth)
                    block, number = _Block(), number + 1
                    release()
        if block.bytes:
            yield from block.rows(number, shards, depth)
        release()

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(learn, F.lit(True)), F.col(text_col).cast("binary"))
    return rows.mapInArrow(run, _BLOCKS)


def _decode(kind: int, keys: bytes) -> np.ndarray | list[bytes]:
    return keys.split(b" ") if kind == _WORDS else np.frombuffer(keys, dtype=_U)


def sum_up(asked: DataFrame, tasks: int, hold: int = 1 << 21) -> DataFrame:
    """(kind, shard, keys, vals: counts, n_keys, n_known, total): each shard's distinct keys with their counts in all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, keys, counts, wait, waiting = None, Counter(), np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), [], 0

        def row() -> pa.RecordBatch:
            n = np.fromiter(words.values(), dtype=np.int64, count=len(words)) if at[0] == _WORDS else counts
            values = [*at, b" ".join(words) if at[0] == _WORDS else keys.tobytes(), n.tobytes(), len(n), int(np.count_nonzero(n)), int(n.sum())]
            return pa.RecordBatch.from_pylist([dict(zip(("kind", "shard", "keys", "vals", "n_keys", "n_known", "total"), values))], schema=schema)

        for batch in batches:
            for kind, shard, k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if (kind, shard) != at:
                    if at:
                        keys, counts = _add_up(np.concatenate([keys, *[x[0] for x in wait]]), np.concatenate([counts, *[x[1] for x in wait]]))
                        yield row()
                    at, words, keys, counts, wait, waiting = (kind, shard), Counter(), np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), [], 0
                own, n = _decode(kind, k.as_py()), np.frombuffer(v.as_py(), dtype=np.int64)
                if kind == _WORDS:
                    words.update(dict(zip(own, n.tolist())))
                    continue
                wait.append((own, n))
                waiting += len(own)
                if waiting > hold:
                    keys, counts = _add_up(np.concatenate([keys, *[x[0] for x in wait]]), np.concatenate([counts, *[x[1] for x in wait]]))
                    wait, waiting = [], 0
        if at:
            keys, counts = _add_up(np.concatenate([keys, *[x[0] for x in wait]]), np.concatenate([counts, *[x[1] for x in wait]]))
            yield row()
        release()

    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary()), ("n_keys", pa.int64()), ("n_known", pa.int64()), ("total", pa.int64())])
    dealt = asked.select("kind", "shard", "keys", "vals").repartition(tasks, "kind", "shard").sortWithinPartitions("kind", "shard")
    return dealt.mapInArrow(run, "kind int, shard int, keys binary, vals binary, n_keys long, n_known long, total long")


#: ln of the gamma function at n + 1/2 and at n + 1, for small n.
_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(4096) + 0.5))]) + 0.5 * np.log(np.pi)
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097.0)))])


def _gamma(n: np.ndarray, plus: float, known: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 4096) + plus
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= 4096, known[np.minimum(n, 4096).astype(np.int64)], far)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the probability that Krichevsky's and Trofimov's estimates give a sequence with so many zeros and ones."""
    return _gamma(zeros, 0.5, _HALVES) + _gamma(ones, 0.5, _HALVES) - _gamma(zeros + ones, 1.0, _WHOLES) - np.log(np.pi)


def weight(kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The share of a node's own estimate, given ln of what it and what the nodes below it give their sequence."""
    return 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))


class Subtree:
    """The nodes of contexts of `cut` to `depth` bytes, from runs and their counts."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, depth: int, cut: int):
        self.runs, self.depth, self.cut = runs, depth, cut
        byte = (runs & _U(255)).astype(np.int64)
        bits = np.arange(8)
        #: a node is its context and then the bits so far behind a leading one; the bit that each run takes at each of its nodes
        node = (1 << bits) | (byte[:, None] >> (8 - bits))
        self.bit = (byte[:, None] >> (7 - bits) & 1).astype(bool)
        names, self.at = np.unique(((runs >> _U(8)) << _U(8))[:, None] | node.astype(_U), return_inverse=True)
        self.at = self.at.reshape(-1, 8)
        n = np.repeat(counts, 8).astype(np.float64)
        flat = self.at.ravel()
        ones = np.bincount(flat, n * self.bit.ravel(), len(names))
        zeros = np.bincount(flat, n, len(names)) - ones
        kt = log_kt(zeros, ones)
        self.levels = [(names, zeros, ones, kt, kt, None)]  # deepest first: (names, zeros, ones, ln KT, ln weighted, place of the parent)
        for d in range(depth - 1, cut - 1, -1):
            self.levels.append(self._above(d))

    def _above(self, d: int) -> tuple:
        """The nodes of contexts of d bytes, from those with one more."""
        names, zeros, ones, kt, weighted, _ = self.levels[-1]
        up, parent = np.unique(names & _U((1 << (8 * d + 8)) - 1), return_inverse=True)
        self.levels[-1] = names, zeros, ones, kt, weighted, parent
        zeros, ones, below = (np.bincount(parent, x, len(up)) for x in (zeros, ones, weighted))
        own = log_kt(zeros, ones)
        return up, zeros, ones, own, np.logaddexp(own, below) + np.log(0.5), None

    def sums(self) -> tuple[np.ndarray, ...]:
        """(names with one byte less than cut, zeros, ones, ln weighted), summed over the subtree's uppermost nodes."""
        up, zeros, ones, _, _, _ = self._above(self.cut - 1)
        names, _, _, _, weighted, parent = self.levels[-1]
        return up, zeros, ones, np.bincount(parent, weighted, len(up))

    def log_probabilities(self, above: np.ndarray, said: np.ndarray, left: np.ndarray) -> np.ndarray:
        """ln of the probability of each run's last byte, given what the nodes above (ascending names) say of a one, and the share that they leave to the nodes below."""
        names = self.levels[-1][0]
        at = np.searchsorted(above, names & _U((1 << (8 * self.cut)) - 1))
        said, left = said[at], left[at]
        for level in range(len(self.levels) - 1, -1, -1):
            _, zeros, ones, kt, weighted, _ = self.levels[level]
            one = (ones + 0.5) / (zeros + ones + 1)
            if level:
                # ln weighted = ln(KT / 2 + below / 2), so the node's own share is KT / (2 weighted)
                own = np.exp(np.minimum(kt - weighted, np.log(2.0)) + np.log(0.5))
                parent = self.levels[level - 1][5]
                said, left = (said + left * own * one)[parent], (left * (1 - own))[parent]
            else:
                said = said + left * one
        p = said[self.at]
        return np.log(np.where(self.bit, p, 1 - p)).sum(axis=1)


def _top(sums: DataFrame, cut: int) -> DataFrame:
    """(name long, said, left) of the nodes with cut - 1 bytes of context: all levels above the subtrees, weighed level by level.

    sums: (name, zeros, ones, below), any number of rows a node. Sums combine before the shuffle; a level has 255 nodes for each of its contexts, of which there are at most 65,536 with two bytes.
    """

    @F.pandas_udf("kt double, share double, weighted double")
    def weigh(zeros, ones, below):
        import pandas as pd

        kt = log_kt(zeros.to_numpy(), ones.to_numpy())
        return pd.DataFrame({"kt": kt, "share": weight(kt, below.to_numpy()), "weighted": np.logaddexp(kt, below.to_numpy()) + np.log(0.5)})

    levels = []
    for d in range(cut - 1, -1, -1):
        mask = F.lit((1 << (8 * d + 8)) - 1)
        own = sums.groupBy(F.col("name").bitwiseAND(mask).alias("name")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
        own = materialise(own.select("*", weigh("zeros", "ones", "below").alias("w")).select("name", "zeros", "ones", "w.share", "w.weighted"), "level")
        levels.append(own)
        sums = own.select("name", "zeros", "ones", F.col("weighted").alias("below"))
    said, left = F.lit(0.0), F.lit(1.0)
    here = None
    for d, own in enumerate(reversed(levels)):
        if here is not None:
            own = own.withColumn("up", F.col("name").bitwiseAND(F.lit((1 << (8 * d)) - 1))).join(here.select(F.col("name").alias("up"), "said", "left"), "up")
            said, left = F.col("said"), F.col("left")
        one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        here = own.select("name", (said + left * F.col("share") * one).alias("said"), (left * (1 - F.col("share"))).alias("left"))
    return here


def learn_model(runs: DataFrame, depth: int, shards: int, subtree_runs: int = 500_000) -> DataFrame:
    """(shard, keys, vals: ln probabilities as doubles) of all runs. runs: (keys, vals, n_keys) as from sum_up(), written."""
    spark = runs.sparkSession
    cut = max(1, depth - 2)
    trees = parts(spark, runs.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0], subtree_runs)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v in zip(batch.column(0), batch.column(1)):
                keys, counts = np.frombuffer(k.as_py(), dtype=_U), np.frombuffer(v.as_py(), dtype=np.int64)
                rows = [(t, keys[at].tobytes(), counts[at].tobytes()) for t, at in _deal(keys, (keys >> _U(8)) & _U((1 << (8 * cut)) - 1), trees)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]], ["tree", "keys", "vals"])

    def subtree(group: pa.Table) -> Subtree:
        keys = np.concatenate([np.frombuffer(x.as_py(), dtype=_U) for x in group["keys"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in group["vals"]])
        return Subtree(keys, counts, depth, cut)

    def up(group: pa.Table) -> pa.Table:
        names, zeros, ones, below = subtree(group).sums()
        release()
        return pa.table({"tree": pa.array([group["tree"][0].as_py()] * len(names), pa.int32()), "name": names.astype(np.int64), "zeros": zeros, "ones": ones, "below": below})

    def down(group: pa.Table, above: pa.Table) -> pa.Table:
        tree = subtree(group)
        above = above.sort_by("name")
        name, said, left = (above[c].to_numpy() for c in ("name", "said", "left"))
        vals = tree.log_probabilities(name.astype(_U), said, left)
        rows = [(s, tree.runs[at].tobytes(), vals[at].tobytes()) for s, at in _deal(tree.runs, tree.runs, shards)]
        release()
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "vals": pa.array([r[2] for r in rows], pa.binary())})

    dealt = materialise(runs.select("keys", "vals").mapInArrow(spread, "tree int, keys binary, vals binary"), "subtrees")
    sums = materialise(dealt.groupBy("tree").applyInArrow(up, "tree int, name long, zeros double, ones double, below double"), "sums")
    above = sums.select("tree", "name").join(_top(sums.drop("tree"), cut), "name")
    out = materialise(dealt.groupBy("tree").cogroup(above.groupBy("tree")).applyInArrow(down, "shard int, keys binary, vals binary"), "probabilities")
    discard(dealt, sums)
    return out


def answer(asked: DataFrame, known: DataFrame, tasks: int) -> DataFrame:
    """(block, kind, keys, vals): what each block asks for, with what is known of it. known: (kind, shard, keys, vals), any number of rows a shard.

    A task streams its shards: what is known of one first, then its questions one by one.
    """
    both = asked.select("kind", "shard", F.lit(1).alias("later"), "block", "keys", F.lit(None).cast("binary").alias("vals")).unionByName(known.select("kind", "shard", F.lit(0).alias("later"), F.lit(0).cast("long").alias("block"), "keys", "vals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have, words, keys, vals = None, [], {}, None, None
        for batch in batches:
            for kind, shard, later, block, k, v in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4), batch.column(5)):
                if (kind, shard) != at:
                    at, have, words, keys = (kind, shard), [], {}, None
                own = _decode(kind, k.as_py())
                if not later:
                    if kind == _WORDS:
                        words.update(zip(own, np.frombuffer(v.as_py(), dtype=np.int64).tolist()))
                    else:
                        have.append((own, np.frombuffer(v.as_py(), dtype=np.float64)))
                    continue
                if kind == _WORDS:
                    found = np.array([words[w] for w in own], dtype=np.int64)
                else:
                    if keys is None:
                        keys, vals = np.concatenate([x[0] for x in have]), np.concatenate([x[1] for x in have])
                        order = np.argsort(keys)
                        keys, vals, have = keys[order], vals[order], []
                    found = vals[np.searchsorted(keys, own)].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([k.as_py()], pa.binary()), pa.array([found.tobytes()], pa.binary())], ["block", "kind", "keys", "vals"])
        release()

    return both.repartition(tasks, "kind", "shard").sortWithinPartitions("kind", "shard", "later").mapInArrow(run, "block long, kind int, keys binary, vals binary")


class _Places:
    """Places of keys, by open addressing over a table at most half full."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, 64 - max(4, (2 * len(keys)).bit_length())
        self.mask = (1 << (64 - self.shift)) - 1
        self.table = np.full(self.mask + 1, -1, dtype=np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), (_mix(keys) >> _U(self.shift)).astype(np.int64)
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            left = self.table[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Places of keys that are all there."""
        at = (_mix(asked) >> _U(self.shift)).astype(np.int64)
        out = self.table[at]
        miss = np.flatnonzero(self.keys[out] != asked)
        while len(miss):
            at[miss] = (at[miss] + 1) & self.mask
            out[miss] = self.table[at[miss]]
            miss = miss[self.keys[out[miss]] != asked[miss]]
        return out


def _texts(text: bytes, lengths: np.ndarray) -> Iterator[bytes]:
    """Each text of a block, one at a time."""
    for end, n in zip(np.cumsum(lengths).tolist(), lengths.tolist()):
        yield text[end - n : end]


def _word_figures(words: dict[bytes, int], text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text of a block: tokens, known tokens, and the sum of log10(count + 0.1) over its tokens."""
    tokens, known, logs = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths))
    for i, t in enumerate(_texts(text, lengths)):
        for own in [*words_of(t), [END]]:
            c = np.fromiter(map(words.__getitem__, own), dtype=np.int64, count=len(own))
            tokens[i] += len(own)
            known[i] += np.count_nonzero(c)
            logs[i] += np.log10(c + 0.1).sum()
    return tokens, known, logs


def _run_figures(keys: list[np.ndarray], vals: list[np.ndarray], text: bytes, lengths: np.ndarray, depth: int) -> np.ndarray:
    """ln of the probability of each text of a block. Takes what is in keys and vals out of them, so that it is held once."""
    data, starts = _padded(list(_texts(text, lengths)), depth)
    del text
    own = np.concatenate(keys)
    keys.clear()
    p_of = np.concatenate(vals)
    vals.clear()
    total, places = np.zeros(len(lengths)), _Places(own)
    for a, runs, fits in _steps(data, starts, depth, 1 << 18):
        p = np.zeros(len(runs))
        p[fits] = p_of[places.find(runs[fits])]
        first = np.searchsorted(starts, a, "right") - 1
        inside = starts[first + 1 : np.searchsorted(starts, a + len(runs))] - a
        total[first : first + 1 + len(inside)] += np.add.reduceat(p, np.concatenate([[0], inside]).astype(np.int64))
    return total


def _score_block(keys: np.ndarray, vals: np.ndarray, words: dict[bytes, int], text: bytes, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """For each text: tokens, known tokens, the sum of log10(count + 0.1) over its tokens, and ln of its probability."""
    return *_word_figures(words, text, lengths), _run_figures([keys], [vals], text, lengths, depth)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, block_bytes: int = 1 << 25, shard_bytes: int = 1 << 24) -> DataFrame:
    """(id_col long, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), one row per document.

    learn says which rows to learn from (null: yes). score is log10 of the probability of the text's words and end mark under the tree, base_score the same under smoothed counts of words;
    bits_per_byte is the code length over the bytes that are coded: words, one blank between two, one end mark. Null and empty texts are the end mark alone. Rows with the same
    id, and rows without one, are documents of their own; an empty table gives no rows. Nothing to learn from: every bit costs one bit. 1 to 7 bytes of context.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    shards = parts(spark, size, shard_bytes)
    blocks = materialise(read_blocks(docs, learn, id_col, text_col, depth, shards, block_bytes), "blocks")
    asked = blocks.where(F.col("kind") != _TEXT)
    sums = materialise(sum_up(asked, 2 * shards), "sums")
    tokens, types = sums.where(F.col("kind") == _WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()
    model = learn_model(sums.where(F.col("kind") == _RUNS), depth, shards)
    known = model.withColumn("kind", F.lit(_RUNS)).unionByName(sums.where(F.col("kind") == _WORDS).select("kind", "shard", "keys", "vals"))
    texts = blocks.where(F.col("kind") == _TEXT).select("block", "kind", "keys", "vals", "meta")
    both = texts.unionByName(answer(asked, known, 2 * shards), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vals, words, block, said = [], [], {}, None, None

        def out() -> pa.RecordBatch:
            text, lengths, meta = block
            n = len(lengths)
            figures = [*said, _run_figures(keys, vals, pa.decompress(text, int(lengths.sum()), "zstd", asbytes=True), lengths, depth)]
            flags = np.frombuffer(meta, dtype=np.uint8, offset=8 * n)
            ids = pa.array(np.frombuffer(meta, dtype=np.int64, count=n), mask=(flags & 1).astype(bool))
            release()
            return pa.RecordBatch.from_arrays([ids, pa.array((flags & 2) == 0), *map(pa.array, figures), pa.array(lengths)], ["id", "held_out", "n_tokens", "n_known", "logs", "ln", "n_bytes"])

        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                k, v = batch.column("keys")[i].as_py(), batch.column("vals")[i].as_py()
                if kind == _TEXT:
                    if block:
                        yield out()
                    block, said = (k, np.frombuffer(v, dtype=np.int64), batch.column("meta")[i].as_py()), None
                elif kind == _WORDS:
                    words.update(zip(k.split(b" "), np.frombuffer(v, dtype=np.int64).tolist()))
                else:
                    if said is None:  # all words are here; none is needed beside the runs
                        said = _word_figures(words, pa.decompress(block[0], int(block[1].sum()), "zstd", asbytes=True), block[1])
                        words = {}
                    keys.append(np.frombuffer(k, dtype=_U))
                    vals.append(np.frombuffer(v, dtype=np.float32))
            batch = k = v = None  # before the next is made
        if block:
            yield out()
        release()

    # a block's text comes first, then its words, then its runs, of which there are some in every block
    dealt = both.repartition(parts(spark, texts.count(), 1), "block").sortWithinPartitions("block", F.col("kind") != _TEXT, F.desc("kind"))
    figures = dealt.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, logs double, ln double, n_bytes long")
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(tokens + 0.1 * (types + 1)))
    return figures.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("ln") / float(np.log(10))).alias("score"), "n_bytes", (-F.col("ln") / float(np.log(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
