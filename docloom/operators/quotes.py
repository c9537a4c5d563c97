"""Quotes found again in texts although some characters differ: edit distance to the nearest passage, in words of bits behind an index of q-grams.

A quote with at most k errors shares most of its q-grams with the passage, at places shifted by about the same number. Only passages where enough shared q-grams meet are compared, by an algorithm
that holds a column of the table of distances as two integers with a bit per character of the quote. Case of A-Z doesn't count. Long texts are cut into overlapping slices, so one text is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Only A-Z change, so places in a text stay what they are.
_FOLD = {i: i + 32 for i in range(65, 91)}


def fold(text: str) -> str:
    return text.translate(_FOLD)


def column_ends(quote: str, text: str) -> Iterator[int]:
    """For each character of text, the least edit distance of quote to any substring that ends there."""
    m = len(quote)
    where: dict[str, int] = {}
    for i, c in enumerate(quote):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m  # bits of cells that are one more, and one less, than the cell above
    for c in text:
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        distance += 1 if more & top else -1 if less & top else 0
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(diagonal | more)), more & diagonal
        yield distance


class Index:
    """The q-grams of a text by value."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _grams(codes: np.ndarray, q: int) -> np.ndarray:
        out = np.zeros(max(0, len(codes) - q + 1), dtype=np.uint64)
        for k in range(q):
            out = (out << np.uint64(21)) | codes[k : len(codes) - q + 1 + k]
        return out

    def places(self, quote: np.ndarray, q: int) -> np.ndarray:
        """Place in the text less place in the quote, for every pair of equal q-grams."""
        if q not in self.by:
            grams = self._grams(self.codes, q)
            order = np.argsort(grams, kind="stable")
            self.by[q] = grams[order], order
        grams, order = self.by[q]
        own = self._grams(quote, q)
        lo, hi = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return order[at] - np.repeat(np.arange(len(own)), n)


def passages(index: Index, quote: str, most: int) -> list[tuple[int, int]]:
    """Parts of the text, apart and in order, that hold every substring at a distance of `most` or less from the quote, with room in front of it."""
    m, n = len(quote), len(index.codes)
    codes = np.frombuffer(quote.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    for q in (3, 2):
        # each error spoils q of the quote's q-grams at most
        shared = m - q + 1 - most * q
        if shared >= (m // 10 if q == 3 else 1) and shared >= 1:
            break
    else:
        return [(0, n)]
    width = 2 * most + 1
    band = np.floor_divide(index.places(codes, q), width)
    if not len(band):
        return []
    names, counts = np.unique(band, return_counts=True)
    beside = np.zeros_like(counts)
    follows = np.flatnonzero(names[1:] == names[:-1] + 1)
    beside[follows] = counts[follows + 1]
    # a band and the next, or a band and the one before it that itself is empty
    out: list[tuple[int, int]] = []
    for b in np.unique(np.concatenate([names[counts + beside >= shared], names[counts >= shared] - 1])).tolist():
        lo, hi = max(0, b * width - 2 * most - 1), min(n, (b + 2) * width + m + 2 * most + 1)
        if lo >= hi:
            continue
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def runs(index: Index, text: str, quote: str, most: int, lowest: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(first, last, distance, start, end): the runs of places from `lowest` on where substrings at a distance of `most` or less end; of each its least distance, the first place where one ends that has it, and where the shortest of those starts."""
    out: list[list[int]] = []
    for lo, hi in passages(index, quote, most):
        for i, d in enumerate(column_ends(quote, text[lo:hi]), lo + 1):
            if d > most or i <= lowest:
                continue
            if out and out[-1][1] == i - 1:
                out[-1][1] = i
                if d < out[-1][2]:
                    out[-1][2:] = [d, i]
            else:
                out.append([i, i, d, i])
    found = []
    for first, last, d, end in out:
        back = text[max(0, end - len(quote) - d) : end][::-1]
        length = next((k for k, x in enumerate(column_ends(quote[::-1], back), 1) if x == d), 0)
        found.append((first, last, d, end - length, end))
    return found


def nearest(index: Index, text: str, quote: str, most: int, lowest: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Runs among which is the one that comes first of all runs() by distance and place: few errors are allowed first, as then few passages are compared, and more only where nothing was found."""
    for allowed in sorted({most // 8, most // 3, most}):
        if found := runs(index, text, quote, allowed, lowest):
            return found
    return []


def approximate(quotes: DataFrame, texts: DataFrame, threshold: float = 0.3, k: int = 1, step: int = 1 << 20, together: int = 256) -> DataFrame:
    """(doc_id, quote_id, rank int, distance int, ratio, start_char, end_char): for each quote the k nearest passages of its document's text, at an edit distance of at most threshold * length.

    quotes: (doc_id, quote_id, quote); texts: (doc_id, text), one row per id. Places where a passage may end that follow each other are one passage: of these the least distance counts, then the first end, then the
    shortest. Nearest first, then as they come in the text; k limits what is shown. ratio is the distance by the quote's length; distance 0 is the quote itself. Empty and null quotes and texts find nothing.
    step: characters of a slice; together: quotes of a document that one task looks for in one slice.
    """
    asked = quotes.where(F.length("quote") > 0).select("doc_id", "quote_id", "quote", F.floor(F.length("quote") * threshold).cast("int").alias("most"))
    dealt = asked.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("quote_id")) - 1) / together))
    groups = dealt.groupBy("doc_id", "part").agg(F.collect_list(F.struct("quote_id", "quote", "most")).alias("quotes"), F.max(F.length("quote") + 2 * F.col("most") + 2).alias("reach"))
    whole = texts.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / step))).alias("slice"))
    # a slice begins as far ahead of its own places as a passage may reach back
    begin = F.greatest(F.col("slice") * step - F.col("reach"), F.lit(0))
    own = whole.join(groups, "doc_id").select("doc_id", "quotes", (F.col("slice") * step).alias("own"), begin.alias("begin"), F.substring(F.col("text"), (begin + 1).cast("int"), ((F.col("slice") + 1) * step - begin).cast("int")).alias("text"))
    id_type, quote_type = (quotes.schema[c].dataType.simpleString() for c in ("doc_id", "quote_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (quoted, first, begin_, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("quotes", "own", "begin", "text")])):
                text = fold(text)
                index, find = Index(text), nearest if k == 1 else runs
                for q in quoted:
                    out += [(i, q["quote_id"], len(q["quote"]), d, *(begin_ + x for x in (a, b, s, e))) for a, b, d, s, e in find(index, text, fold(q["quote"]), q["most"], first - begin_)]
            at, names, lengths, d, a, b, s, e = zip(*out) if out else [()] * 8
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, quote_kind), *[pa.array(c, pa.int64()) for c in (lengths, d, a, b, s, e)]], ["doc_id", "quote_id", "length", "distance", "first", "last", "start_char", "end_char"])

    quote_kind = pa.string() if quote_type == "string" else pa.int64() if quote_type == "bigint" else pa.int32()
    found = own.mapInArrow(run, f"doc_id {id_type}, quote_id {quote_type}, length long, distance long, first long, last long, start_char long, end_char long")
    # a run that a slice's end cuts is one passage again
    by = Window.partitionBy("doc_id", "quote_id").orderBy("first")
    runs_ = found.withColumn("new", F.coalesce((F.col("first") > F.lag("last").over(by) + 1).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(by))
    best = runs_.groupBy("doc_id", "quote_id", "run").agg(F.min(F.struct("distance", "end_char", "start_char", "length")).alias("b"))
    order = Window.partitionBy("doc_id", "quote_id").orderBy("b.distance", "b.end_char")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("doc_id", "quote_id", "rank", F.col("b.distance").cast("int").alias("distance"), (F.col("b.distance") / F.col("b.length")).alias("ratio"), "b.start_char", "b.end_char")


def locate(quotes: DataFrame, texts: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """(doc_id, quote_id, method, confidence, start_char, end_char), one row per quote: exact, fuzzy or none; confidence is 1 less the share of characters that differ."""
    near = approximate(quotes, texts, threshold, 1, **how)
    rows = quotes.select("doc_id", "quote_id").join(near, ["doc_id", "quote_id"], "left")
    method = F.when(F.col("distance") == 0, "exact").when(F.col("distance").isNotNull(), "fuzzy").otherwise("none")
    return rows.select("doc_id", "quote_id", method.alias("method"), F.coalesce(1 - F.col("ratio"), F.lit(0.0)).alias("confidence"), "start_char", "end_char")
