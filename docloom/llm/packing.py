"""Sequence packing by minimum bin slack.

Documents are cut into full windows and one remainder each. Remainders are gathered, some thousands at a time, and fill windows: the longest one left opens a window, and a subset-sum over the
multiset of remaining lengths, kept as a bitset, finds those that fill it closest to capacity. Cutting is free, so remainders that don't fit together are cut, and what a
partition has left at its end goes out in sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Encoder, blocks, release, shared_dir

SEQUENCE = "sequence_id long, n_tokens int, ids binary, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>"
_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
_SCHEMA = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE))])


def fill(counts: dict[int, int], room: int) -> list[int]:
    """Lengths out of the multiset whose sum comes closest to room without passing it; the multiset is left as it is.

    reach is a bitset of the sums that can be had. It grows length by length, longest first, by doubling steps of that length's count; each step is
    kept, and walking the steps backwards tells how many of each length the best sum takes. Ends at once when room itself can be had.
    """
    full, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            grown = (reach | (reach << (length * k))) & full
            steps.append((length, k, reach))
            reach, left, k = grown, left - k, 2 * k
            if reach & goal:
                break
        if reach & goal:
            break
    best, taken = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            taken += [length] * k
            best -= length * k
    return taken


def plan(lengths: list[int], size: int) -> list[list[int]]:
    """Places of `lengths` (each under size), window by window."""
    places, counts = defaultdict(list), defaultdict(int)
    for i in range(len(lengths) - 1, -1, -1):
        places[lengths[i]].append(i)
        counts[lengths[i]] += 1
    out = []

    def take(length: int) -> int:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return places[length].pop()

    for length in sorted(places, reverse=True):
        while counts.get(length):
            window = [take(length)]
            window += [take(x) for x in fill(counts, size - length)]
            out.append(window)
    return out


def _cut(rest: list[tuple], size: int, most: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Windows without slack out of one stream of pieces, cut where a window is full; ends when `most` pieces at most are left or the tokens left don't fill a window."""
    windows, left = [], sum(len(p[2]) // 4 for p in rest)
    while len(rest) > most and left:
        room = size if left >= size else 1 << (left.bit_length() - 1)
        left -= room
        window = []
        while room:
            doc, start, ids, n = rest.pop()
            k = min(room, len(ids) // 4)
            window.append((doc, start, ids[: 4 * k], n))
            if k < len(ids) // 4:
                rest.append((doc, start + k, ids[4 * k :], n))
            room -= k
        windows.append(window)
    return windows, rest


def _flush(rest: list[tuple], size: int, last: bool, loose: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Windows of pieces (doc_id, start, ids, doc_tokens), and the pieces to keep for later: those of windows with more slack than `loose`.

    Lengths that don't fit together, such as many just over half a window, would be kept forever: where more than half of the pieces are left, the
    others are cut to fill windows. So a call frees half of the pieces at least, and each piece is planned twice on average at most. With `last`, all are cut and the end goes out in falling powers of two.
    """
    windows, later = [], []
    for places in plan([len(p[2]) // 4 for p in rest], size):
        pieces = [rest[i] for i in places]
        total = sum(len(p[2]) // 4 for p in pieces)
        if size - total > loose and total & (total - 1):
            later += pieces
        else:
            windows.append(pieces)
    cut, later = _cut(later, size, 0 if last else len(rest) // 2)
    return windows + cut, later


def pack(docs: DataFrame, make_encoder: Callable[[], Callable[[pa.Array], Iterator[bytes]]], end_id: int = 1, size: int = 2048, pad_id: int = 0, hold: int = 4096, loose: int = 8, block_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most `size` tokens: (sequence_id, n_tokens: without padding, ids: little-endian 32-bit, padded, pieces).

    make_encoder is called on the executor and gives texts -> ids of each as bytes; each document gets end_id at its end, so null and empty texts are that id alone. A sequence is padded
    to size unless its length is a power of two. Works partition by partition in one pass, without a shuffle; memory is bounded by `hold` remainders,
    each under a window, and the document at hand. Repeated ids stay separate. Ids depend on the partition and order of the input only, so a retried task writes the same.
    """
    shared_dir(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = make_encoder(), np.array([end_id], dtype="<u4").tobytes()
        pad = np.array([pad_id], dtype="<u4").tobytes()
        number = (TaskContext.get().partitionId() << 36) - 1
        rest: list[tuple] = []

        def rows(windows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal number
            made = []
            for pieces in windows:
                number += 1
                ids = b"".join(p[2] for p in pieces)
                total, at, listed = len(ids) // 4, 0, []
                for doc, start, part, n in pieces:
                    listed.append({"doc_id": doc, "start": start, "length": len(part) // 4, "doc_tokens": n, "offset": at})
                    at += len(part) // 4
                made.append({"sequence_id": number, "n_tokens": total, "ids": ids if total & (total - 1) == 0 else ids + pad * (size - total), "pieces": listed})
            return pa.RecordBatch.from_pylist(made, schema=_SCHEMA)

        for batch in (b for whole in batches for b in blocks(whole, 1, block_bytes)):
            whole: list[list[tuple]] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, size):
                    piece = (doc, at, ids[4 * at : 4 * (at + size)], n)
                    whole.append([piece]) if n - at >= size else rest.append(piece)
                if len(whole) >= 256:
                    yield rows(whole)
                    whole = []
                if len(rest) >= hold:
                    windows, rest = _flush(rest, size, False, loose)
                    for i in range(0, len(windows), 256):
                        yield rows(windows[i : i + 256])
                    release()
            if whole:
                yield rows(whole)
        if rest:
            windows, _ = _flush(rest, size, True, loose)
            for i in range(0, len(windows), 256):
                yield rows(windows[i : i + 256])
        release()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SEQUENCE)


def encoder_of(file: str) -> Callable[[], Callable[[pa.Array], Iterator[bytes]]]:
    return lambda: Encoder(file).many


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece, its ids' checksum computed from the sequence that holds it."""
    one = sequences.select("sequence_id", "ids", F.inline("pieces"))
    ids = F.substring("ids", (F.col("offset") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return one.select("doc_id", "start", "length", F.crc32(ids).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
