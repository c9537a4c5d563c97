"""Quotes and values found again in texts: fuzzily, in windows of words, in cited texts, by position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


def text_blocks(spans: DataFrame, most: int = 500) -> DataFrame:
    """(doc_id, block, text, start_char, end_char): spans in order, a new block once the one before has more than `most` characters.

    One linear pass over the words of each document.
    """

    def run(words: pa.Table) -> pa.Table:
        words = words.sort_by([(c, "ascending") for c in ("pos", "text", "start_char", "end_char")])
        texts = words["text"].to_pylist()
        # characters of the words up to each one, with a blank after every word but the last
        upto = np.cumsum(np.array([len(t) for t in texts], dtype=np.int64) + 1) - 1
        starts, ends = [0], []
        while True:
            past = int(upto[starts[-1] - 1]) + 1 if starts[-1] else 0
            end = min(int(np.searchsorted(upto, past + most, side="right")) + 1, len(texts))
            ends.append(end)
            if end == len(texts):
                break
            starts.append(end)
        made = pa.array([" ".join(texts[a:b]) for a, b in zip(starts, ends)], pa.string())
        number = pa.array(range(len(starts)), pa.int32())
        return pa.table([words["doc_id"].take(starts), number, made, words["start_char"].take(starts), words["end_char"].take([b - 1 for b in ends])], names=["doc_id", "block", "text", "start_char", "end_char"])

    s = spans.select("doc_id", "pos", "text", F.col("start_char").cast("long"), F.col("end_char").cast("long"))
    out = T.StructType([s.schema["doc_id"], T.StructField("block", T.IntegerType()), *[s.schema[c] for c in ("text", "start_char", "end_char")]])
    return s.groupBy("doc_id").applyInArrow(run, out)


def _asked(quotes: DataFrame, *more: Column) -> DataFrame:
    """Quotes with their distinct words as _w, a blank before and behind each."""
    words = F.array_distinct(F.filter(F.split(tx.normalise(F.col("quote")), r"\s+"), lambda w: w != ""))
    return quotes.select("doc_id", "quote_id", F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))).alias("_w"), *more)


def _cleaned(blocks: DataFrame, *more: Column) -> DataFrame:
    """Blocks with their words as _b: cleaned once a block, before they meet the quotes."""
    return blocks.select("doc_id", "block", tx.plain_words(F.col("text")).alias("_b"), *more)


def _lacking() -> Column:
    """The share of the words _w that _b lacks; null where there are none."""
    return 1 - F.try_divide(F.size(F.filter("_w", lambda w: F.contains(F.col("_b"), w))), F.size("_w"))


def fuzzy(quotes: DataFrame, blocks: DataFrame, threshold: float = 0.4, k: int = 1) -> DataFrame:
    """(doc_id, quote_id, block, distance, rank): the k blocks of the document that share most of a quote's words; distance is the share they lack, at most `threshold`.

    quotes: (doc_id, quote_id, quote).
    """
    j = _asked(quotes).where(F.size("_w") > 0).join(_cleaned(blocks), "doc_id").withColumn("distance", _lacking()).where(F.col("distance") <= threshold)
    w = Window.partitionBy("doc_id", "quote_id").orderBy("distance", "block")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", "quote_id", "block", "distance", "rank")


def smart(quotes: DataFrame, blocks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, quote_id, method, block, confidence): the first block that contains the quote, else the nearest one by words, else none. Both are found in one pass over the blocks."""
    j = _asked(quotes, F.lower("quote").alias("_q")).join(_cleaned(blocks, F.lower("text").alias("_low")), "doc_id")
    j = j.select("doc_id", "quote_id", "block", F.contains("_low", "_q").alias("exact"), _lacking().alias("distance")).where(F.col("exact") | (F.col("distance") < threshold))
    near = F.min(F.when(F.col("distance") < threshold, F.struct("distance", "block")))
    hits = j.groupBy("doc_id", "quote_id").agg(F.min(F.when(F.col("exact"), F.col("block"))).alias("e"), near.alias("f"))
    found = quotes.select("doc_id", "quote_id").join(hits, ["doc_id", "quote_id"], "left")
    method = F.when(F.col("e").isNotNull(), "exact").when(F.col("f").isNotNull(), "fuzzy").otherwise("none")
    confidence = F.when(F.col("e").isNotNull(), 1.0).otherwise(F.coalesce(1 - F.col("f.distance"), F.lit(0.0)))
    return found.select("doc_id", "quote_id", method.alias("method"), F.coalesce("e", "f.block").alias("block"), confidence.alias("confidence"))


def in_windows(spans: DataFrame, needle: str, most: int = 20) -> DataFrame:
    """(doc_id, pos, n_words): words from which on a window of at most `most` words contains the text; n_words is the shortest such window."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, most - 1)
    ahead = spans.select("doc_id", "pos", F.collect_list(F.lower("text")).over(w).alias("w"))
    n = F.array_min(F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: F.when(F.contains(F.array_join(F.slice("w", F.lit(1), k), " "), F.lit(needle.lower())), k)))
    return ahead.select("doc_id", "pos", n.alias("n_words")).where(F.col("n_words").isNotNull())


def link_values(fields: DataFrame, cited: DataFrame) -> DataFrame:
    """(doc_id, field, cite_id): citations whose text contains a field's value, ignoring case. fields: (doc_id, field, value); cited: (doc_id, cite_id, text)."""
    return fields.join(cited, "doc_id").where(F.contains(F.lower("text"), F.lower("value"))).select("doc_id", "field", "cite_id")


def marked_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, field, value) of lines like "**Name**: value"; the last one of a name counts."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    p = r"\*\*\[?(.+?)\]?\*\*:\s*(.+)"
    name = F.regexp_replace(F.lower(F.regexp_extract("line", p, 1)), r"\s+", "_")
    hit = lines.where(F.col("line").rlike(p)).select("doc_id", name.alias("field"), tx.strip(F.regexp_extract("line", p, 2)).alias("value"), "i")
    return hit.groupBy("doc_id", "field").agg(F.max_by("value", "i").alias("value"))


def captions_in_order(items: DataFrame, captions: DataFrame) -> DataFrame:
    """The i-th caption of a page with its i-th item, left outer: (doc_id, page, item, caption). items: (doc_id, page, item); captions: (doc_id, page, pos, caption)."""
    a = items.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("item")))
    b = captions.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos"))).select("doc_id", "page", "_n", "caption")
    return a.join(b, ["doc_id", "page", "_n"], "left").select("doc_id", "page", "item", "caption")


def table_caption(text: Column, start: Column, reach: int = 200) -> Column:
    """The first "Table n ..." within `reach` characters before a place (from 1), or null."""
    before = F.substring(text, F.greatest(F.lit(1), start - reach), F.least(start - 1, F.lit(reach)))
    return F.nullif(tx.strip(F.regexp_extract(before, r"(?i)Table\s+\d+\.?\s*[^\n]*", 0)), F.lit(""))


def figure_caption(text: Column, index: Column) -> Column:
    """The caption of the figure with this index from 0, or null."""
    return tx.strip(F.get(F.regexp_extract_all(text, F.lit(r"(?i)(?:Figure|Fig\.?)\s*\d+\.?\s*[^\n]*"), F.lit(0)), index))


def supports(phrases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(response_id, phrase, idx): the first chunk that contains a phrase. phrases: (response_id, phrase); chunks: (response_id, idx, text)."""
    j = phrases.join(chunks, "response_id").where(F.contains(F.lower("text"), F.lower("phrase")))
    return j.groupBy("response_id", "phrase").agg(F.min("idx").alias("idx"))


def reading_order(words: DataFrame, tolerance: float = 5) -> DataFrame:
    """Adds line and order to (doc_id, page, x, y): words whose y is within `tolerance` of the word above are one line; lines read from left to right."""
    w = Window.partitionBy("doc_id", "page").orderBy("y", "x", "pos")
    fresh = F.when(F.col("y") - F.lag("y").over(w) > tolerance, 1).otherwise(0)
    lines = words.withColumn("_f", fresh).withColumn("line", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.withColumn("order", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line", "x", "pos"))).drop("_f")


def to_canvas(x: Column, y: Column, width: Column, height: Column, page_height: Column, scale: float) -> Column:
    """Rectangle of a page, y upwards, on a canvas, y downwards."""
    return F.struct((x * scale).alias("x"), ((page_height - y - height) * scale).alias("y"), (width * scale).alias("width"), (height * scale).alias("height"))


def crop(x0: Column, y0: Column, x1: Column, y1: Column, page_width: float, page_height: float, dpi: int = 150, padding: int = 20) -> Column:
    """Pixels of a region with padding, within the page."""
    s = dpi / 72
    return F.struct(F.greatest(F.lit(0.0), x0 * s - padding).alias("x0"), F.greatest(F.lit(0.0), y0 * s - padding).alias("y0"), F.least(F.lit(page_width * s), x1 * s + padding).alias("x1"), F.least(F.lit(page_height * s), y1 * s + padding).alias("y1"))
