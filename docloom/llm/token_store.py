"""Token ids in shard files with keyed access.

A segment holds the ids of a run of documents in ascending id order and an index: a minimal perfect hash sends a document's key to its own slot among as many slots as
documents, and the slot has a fingerprint of the key (to tell keys that the segment lacks), the place of the ids and their number. Looking up
a key costs two hashes and one read, whatever the size. Ids are stored raw, in 16 bits each if all fit, else in 32.

Layout (little-endian): header, pilots u32[buckets], slots (u32 fingerprint, u32 n, u64 at)[n_docs], keys i64[n_docs], ids. Segments lie one after another in a file, a line feed behind each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Encoder, blocks, materialise, parts, prepare, release, scratch

#: Folder of the directory, below a store's; file listings pass over names that begin so.
DIRECTORY = "_segments"
MAGIC = b"DLTOKENS"
#: magic, ordinal of the segment, documents, documents with a null id (they come first), ids, bytes per id, buckets, seed
HEADER = struct.Struct("<8sQQQQIIQ")
SLOT = np.dtype([("mark", "<u4"), ("n", "<u4"), ("at", "<u8")])
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_keys(keys: np.ndarray, nth: np.ndarray, null: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of (document id or null, which of the rows with that id)."""
    with np.errstate(over="ignore"):
        h = _mix(keys.astype(np.int64).view(np.uint64) + _U(seed) * _U(0x9E3779B97F4A7C15) + _U(1))
        return _mix(h ^ (nth.astype(np.uint64) * _U(0xD6E8FEB86659FD93)) ^ (null.astype(np.uint64) * _U(0xA0761D6478BD642F)))


def _slots(h: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h ^ (pilots.astype(np.uint64) * _U(0xE7037ED1A0B428DB))) >> _U(8)) % _U(n)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> _U(17)) % _U(buckets)


def build_hash(h: np.ndarray) -> np.ndarray:
    """Pilots u32 of a minimal perfect hash for distinct hashes: buckets, fullest first, each try pilots until all of their keys fall on free slots."""
    n, buckets = len(h), max(1, -(-len(h) // 4))
    of = _bucket(h, buckets).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    first = np.concatenate([[0], np.cumsum(sizes)])
    taken, pilots = np.zeros(n, dtype=bool), np.zeros(buckets, dtype=np.uint32)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        own, at, step = h[order[first[b] : first[b + 1]]], 0, 32
        while True:
            tries = np.arange(at, at + step, dtype=np.uint64)
            s = _slots(own[None, :], tries[:, None], n)
            good = ~taken[s].any(axis=1)
            if len(own) > 1:
                ranked = np.sort(s, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                i = int(good.argmax())
                pilots[b] = at + i
                taken[s[i]] = True
                break
            at, step = at + step, min(4 * step, 1 << 15)
    return pilots


def _nth(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """For sorted keys, which of the rows with the same key each is."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])])
    place = np.arange(len(keys))
    return place - np.maximum.accumulate(np.where(new, place, 0))


def segment(ordinal: int, keys: list[int | None], ids: list[bytes]) -> bytes:
    """A segment of documents in ascending order of keys (null first); ids: little-endian 32-bit, one bytes per document."""
    null = np.array([k is None for k in keys], dtype=bool)
    key = np.array([k or 0 for k in keys], dtype=np.int64)
    nth, seed = _nth(key, null), 0
    while len(np.unique(h := hash_keys(key, nth, null, seed))) < len(h):
        seed += 1
    payload = np.frombuffer(b"".join(ids), dtype="<u4")
    narrow = not len(payload) or payload.max() < 1 << 16
    n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    pilots = build_hash(h)
    slots = np.zeros(len(keys), dtype=SLOT)
    s = _slots(h, pilots[_bucket(h, len(pilots)).astype(np.int64)], len(keys))
    slots["mark"][s] = (h & _U(0xFFFFFFFF)).astype(np.uint32)
    slots["n"][s] = n
    slots["at"][s] = np.concatenate([[0], np.cumsum(n)[:-1]])
    head = HEADER.pack(MAGIC, ordinal, len(keys), int(null.sum()), len(payload), 2 if narrow else 4, len(pilots), seed)
    return b"".join([head, pilots.tobytes(), slots.tobytes(), key.astype("<i8").tobytes(), payload.astype("<u2" if narrow else "<u4").tobytes()])


class Reader:
    """Keyed access to the segment at the beginning of `data`."""

    def __init__(self, data: memoryview | bytes):
        magic, self.ordinal, self.n_docs, self.n_null, self.n_ids, self.width, buckets, self.seed = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEADER.size
        self.pilots = np.frombuffer(data, dtype="<u4", count=buckets, offset=at)
        at += 4 * buckets
        self.slots = np.frombuffer(data, dtype=SLOT, count=self.n_docs, offset=at)
        at += SLOT.itemsize * self.n_docs
        self.keys = np.frombuffer(data, dtype="<i8", count=self.n_docs, offset=at)
        at += 8 * self.n_docs
        self.ids = np.frombuffer(data, dtype=f"<u{self.width}", count=self.n_ids, offset=at)
        self.end = at + self.width * self.n_ids

    def find(self, keys: np.ndarray, nth: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of ids of each key, and whether the segment has it (by fingerprint)."""
        h = hash_keys(keys, nth, null, self.seed)
        s = self.slots[_slots(h, self.pilots[_bucket(h, len(self.pilots)).astype(np.int64)], self.n_docs).astype(np.int64)]
        return s["at"], s["n"], s["mark"] == (h & _U(0xFFFFFFFF)).astype(np.uint32)

    def get(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        """Ids of one document, or None if the segment lacks it."""
        if not self.n_docs:
            return None
        at, n, there = self.find(np.array([key or 0]), np.array([nth]), np.array([key is None]))
        if not there[0] or not self._holds(key, nth):
            return None
        return self.ids[int(at[0]) : int(at[0] + n[0])]

    def _holds(self, key: int | None, nth: int) -> bool:
        """Whether the sorted keys have this one, at least nth + 1 times; asked only for keys whose fingerprint agrees."""
        if key is None:
            return nth < self.n_null
        own = self.keys[self.n_null :]
        return nth < np.searchsorted(own, key, "right") - np.searchsorted(own, key)

    @property
    def low(self) -> int:
        """Smallest id; beyond the largest where all are null."""
        return int(self.keys[self.n_null]) if self.n_null < self.n_docs else 0

    @property
    def high(self) -> int:
        return int(self.keys[-1]) if self.n_null < self.n_docs else -1


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 2_000_000, shard_bytes: int = 24_000_000, block_bytes: int = 4_000_000,
) -> None:
    """Encode every whole text, add end_id, and write the ids in ascending order of id (null ids first, repeated ids by a hash of the text, then by text) below path.

    Files are written by Spark's own writer, so lost tasks leave nothing behind and any file system will do. Null and empty texts are end_id alone. A file has about
    shard_bytes of text; rows of one id, or rows wholly alike, may lie in many files, so no id makes a file large.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("row"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.asc_nulls_first("doc_id"), "hash", "row"]
    dealt = d.repartitionByRange(parts(spark, total, shard_bytes), *order).sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash", F.asc_nulls_first("text")).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = Encoder(tokenizer).many, np.array([end_id], dtype="<u4").tobytes()
        number, keys, ids, held = TaskContext.get().partitionId() << 24, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(number, keys, ids)], pa.binary())], names=["value"])

        for batch in (b for whole in batches for b in blocks(whole, 1, block_bytes)):
            for key, own in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                keys.append(key)
                ids.append(own + end)
                held += len(ids[-1]) // 4
                if held >= segment_ids:
                    yield out()
                    number, keys, ids, held = number + 1, [], [], 0
        if keys:
            yield out()
        release()

    dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def _segments(content: pa.Scalar) -> Iterator[tuple[int, Reader]]:
    """Place and reader of each segment of a file."""
    data, at = memoryview(content.as_buffer()), 0
    while at < len(data):
        r = Reader(data[at:])
        yield at, r
        at += r.end + 1


def read(spark: SparkSession, path: str) -> DataFrame:
    """(segment, place, doc_id, at, n_tokens, ids_crc32, file, segment_at) of every document, each found through the index of its segment."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for began, r in _segments(content):
                    null = np.arange(r.n_docs) < r.n_null
                    place, n, there = r.find(r.keys, _nth(r.keys, null), null)
                    if not there.all():
                        raise ValueError(f"segment {r.ordinal}: the index misses documents of its own")
                    raw = memoryview(r.ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(place.tolist(), n.tolist())]
                    same = lambda x, t, n=r.n_docs: pa.array([x] * n, t)
                    yield pa.RecordBatch.from_arrays(
                        [same(r.ordinal, pa.int64()), pa.array(range(r.n_docs), pa.int64()), pa.array(r.keys, pa.int64(), mask=null), pa.array(place.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64()), same(name, pa.string()), same(began, pa.int64())],
                        names=["segment", "place", "doc_id", "at", "n_tokens", "ids_crc32", "file", "segment_at"],
                    )

    return files.mapInArrow(run, "segment long, place long, doc_id long, at long, n_tokens long, ids_crc32 long, file string, segment_at long")


def write_directory(documents: DataFrame, path: str) -> None:
    """Write the directory of a store beside its files: for each segment its file, place there, smallest and largest id, and whether it holds null ids. documents: as from read()."""
    per = documents.groupBy("file", "segment_at", "segment").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    per.repartitionByRange("segment").write.mode("overwrite").parquet(f"{path}/{DIRECTORY}")


def lookup(spark: SparkSession, path: str, keys: Sequence[int | None], most: int = 100_000) -> DataFrame:
    """(doc_id, nth, ids array<long>): the ids, end id included, of the documents with these keys, in the store at path, which has its directory. Keys that it lacks give no rows; nth numbers the rows of a repeated key.

    At most `most` keys at once, which go to every task; a join with read() serves more. The directory says which segments may hold a key; only their files are read, and in a segment the
    hash index leads from key to ids, whatever the number of documents. A fingerprint that agrees by chance (1 in 2^32) is told by the stored key.
    """
    prepare(spark)
    wanted = sorted({k for k in keys if k is not None})
    null = any(k is None for k in keys)
    if len(wanted) > most:
        raise ValueError(f"{len(wanted)} keys at once; at most {most}, or join with read()")
    asked = np.array(wanted, dtype=np.int64)
    listed = spark.read.parquet(f"{path}/{DIRECTORY}")
    span = (F.col("last") >= (wanted[0] if wanted else 0)) & (F.col("first") <= (wanted[-1] if wanted else -1))
    near = listed.where(span | (F.col("has_null") if null else F.lit(False)))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, nulls = (batch.column(i).to_pylist() for i in (1, 2, 3))
            some = [bool(h and null) or (a is not None and np.searchsorted(asked, a) < np.searchsorted(asked, b, "right")) for a, b, h in zip(first, last, nulls)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some, pa.bool_()))], names=["file"])

    # a key lies in one segment, or in neighbours where it is repeated, so there are about as many files as keys at most
    files = [r["file"] for r in near.select("file", "first", "last", "has_null").mapInArrow(hold, "file string").distinct().collect()]
    schema = "doc_id long, segment long, place long, ids array<long>"
    if not files:
        return spark.createDataFrame([], "doc_id long, nth int, ids array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for _, r in _segments(content):
                    out = []
                    for key in [None] * null + asked[np.searchsorted(asked, r.low) : np.searchsorted(asked, r.high, "right")].tolist():
                        nth = 0
                        while (found := r.get(key, nth)) is not None:
                            out.append({"doc_id": key, "segment": r.ordinal, "place": nth, "ids": found.tolist()})
                            nth += 1
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("segment", pa.int64()), ("place", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    found = spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, schema)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("segment", "place")) - 1
    return found.select("doc_id", nth.alias("nth"), "ids")


def starts(documents: DataFrame) -> DataFrame:
    """Adds start: ids of all documents before, over all segments. documents: as from read().

    Running sums over the totals of segments, in two levels, so that one task never sees more than some hundreds per level-one group.
    """
    totals = documents.groupBy("segment").agg(F.sum("n_tokens").alias("ids")).withColumn("block", F.floor(F.col("segment") / (1 << 30)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("ids").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(before(Window.orderBy("block"))), F.lit(0)))
    inner = F.coalesce(F.sum("ids").over(before(Window.partitionBy("block").orderBy("segment"))), F.lit(0))
    based = totals.withColumn("inner", inner).join(blocks.select("block", "base"), "block").select("segment", (F.col("base") + F.col("inner")).alias("base"))
    return documents.join(based, "segment").withColumn("start", F.col("base") + F.col("at")).drop("base")


def store(docs: DataFrame, tokenizer: str, end_id: int = 2, **columns) -> DataFrame:
    """Write docs to a fresh store in the shared folder, with its directory, and read it back: (doc_id, start, n_tokens, ids_crc32). An empty table gives no rows."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write(docs, path, tokenizer, end_id, **columns)
    found = materialise(read(spark, path), "token-index")
    write_directory(found, path)
    return starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")
