"""Text spans: offsets, sections, interval and substring joins, boxes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def word_spans(docs: DataFrame, page_chars: int = 1000, line_chars: int = 80, char_width: int = 6, line_height: int = 12) -> DataFrame:
    """Words of each document with running offsets: (doc_id, pos, text, start_char, end_char, page, x, y, width, height). Words are parted by single blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = pc.split_pattern(batch.column(1), " ")
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                words, first = lists.flatten(), np.cumsum(n) - n
                upto = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64) + 1)])
                pos, start = np.arange(len(words)) - np.repeat(first, n), upto[:-1] - np.repeat(upto[first], n)
                doc = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                made = pa.RecordBatch.from_arrays([doc, pa.array(pos, pa.int32()), words, pa.array(start, pa.int64())], names=["doc_id", "pos", "text", "start_char"])
                yield from (made.slice(k, 100_000) for k in range(0, len(words), 100_000))

    # offsets are sums within a text, made where the text is: no word is shuffled for them
    kind = docs.schema["doc_id"].dataType.simpleString()
    one = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pos int, text string, start_char long")
    one = one.withColumn("end_char", F.col("start_char") + F.length("text"))
    s = F.col("start_char")
    return one.withColumns({"page": (F.floor(s / page_chars) + 1).cast("long"), "x": (s % line_chars * char_width).cast("long"), "y": (F.floor(s / line_chars) * line_height).cast("long"), "width": (F.length("text") * char_width).cast("long"), "height": F.lit(line_height).cast("long")})


# Whole lines that are section headers.
HEADERS = (
    ("abstract", "^abstract$"),
    ("introduction", "^(introduction|background)$"),
    ("methods", "^(methods|patients|materials|study design|subjects|study population)$"),
    ("methods", "^(patients and methods|materials and methods)$"),
    ("results", "^results$"),
    ("discussion", "^discussion$"),
    ("conclusion", "^(conclusion|conclusions)$"),
    ("references", "^(references|bibliography)$"),
    ("table", r"^table\s*\d"),
    ("figure", r"^(figure|fig\.?)\s*\d"),
)
PRIMARY = ("methods", "results", "table", "figure")


def header_of(text: Column) -> Column:
    t = tx.strip(text)
    end = r"(?i)(table)\s*\d.*[:.]?\s*$"
    fig = r"(?i)(figure|fig\.?)\s*\d.*[:.]?\s*$"
    return F.coalesce(F.when(t.rlike(end), "table"), F.when(t.rlike(fig), "figure"), *[F.when(t.rlike("(?i)" + p), F.lit(n)) for n, p in HEADERS])


def carry_sections(lines: DataFrame) -> DataFrame:
    """Adds section to (doc_id, pos, text): that of the last header at or above the line, "unknown" before the first."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(header_of(F.col("text")), ignorenulls=True).over(w), F.lit("unknown")))


def section_ranges(lines: DataFrame) -> DataFrame:
    """(doc_id, section, start_pos, end_pos): from each header to the next; lines before the first header belong to none."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    heads = lines.withColumn("section", header_of(F.col("text"))).withColumn("n", F.max("pos").over(Window.partitionBy("doc_id")) + 1).where(F.col("section").isNotNull())
    return heads.select("doc_id", "section", F.col("pos").alias("start_pos"), F.coalesce(F.lead("pos").over(w), "n").alias("end_pos"))


def overlap(citations: DataFrame, spans: DataFrame, cell: int = 256) -> DataFrame:
    """Interval join: parts of spans under citations, with proportional place and width.

    citations: (doc_id, cite_id, c_start, c_end), half open. Both sides are dealt to the cells of `cell` characters that they touch, so the join is on (doc_id, cell) and long
    documents spread; a pair counts in the first cell that both touch.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor((F.greatest(b, a + 1) - 1) / cell)))
    c = citations.withColumn("cell", cells(F.col("c_start"), F.col("c_end")))
    s = spans.withColumn("cell", cells(F.col("start_char"), F.col("end_char")))
    j = c.join(s, ["doc_id", "cell"]).where("start_char < c_end AND c_start < end_char")
    lo, hi = F.greatest("c_start", "start_char"), F.least("c_end", "end_char")
    j = j.where(F.col("cell") == F.floor(lo / cell))
    n = F.col("end_char") - F.col("start_char")
    clipped = F.substring(F.col("text"), (lo - F.col("start_char") + 1).cast("int"), (hi - lo).cast("int"))
    return j.select("doc_id", "cite_id", "pos", clipped.alias("text"), "page", (F.col("x") + F.col("width") * (lo - F.col("start_char")) / n).alias("x"), "y", (F.col("width") * (hi - lo) / n).alias("width"))


def first_at(citations: DataFrame, spans: DataFrame, cell: int = 256) -> DataFrame:
    """For each citation the first span that holds its start (end included), left outer: (doc_id, cite_id, page, x, y), page 1 and zeros where none does.

    The join is on cells of `cell` characters: a start lies in one, a span in those that it touches.
    """
    c = citations.withColumn("cell", F.floor(F.col("c_start") / cell))
    s = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_char") / cell), F.floor(F.col("end_char") / cell))))
    hit = c.join(s, ["doc_id", "cell"]).where("c_start >= start_char AND c_start <= end_char")
    best = hit.groupBy("doc_id", "cite_id").agg(F.min_by(F.struct("page", "x", "y"), "pos").alias("s"))
    return citations.join(best, ["doc_id", "cite_id"], "left").select("doc_id", "cite_id", F.coalesce("s.page", F.lit(1)).alias("page"), F.coalesce("s.x", F.lit(0)).alias("x"), F.coalesce("s.y", F.lit(0)).alias("y"))


def first_containing(terms: DataFrame, spans: DataFrame) -> DataFrame:
    """First span, by position, whose text contains the term, ignoring case: (doc_id, term, pos). terms: (doc_id, term)."""
    j = terms.join(spans.select("doc_id", "pos", "text"), "doc_id").where(F.contains(F.lower("text"), F.lower("term")))
    return j.groupBy("doc_id", "term").agg(F.min("pos").alias("pos"))


def refine(ranges: DataFrame, spans: DataFrame, cell: int = 256) -> DataFrame:
    """Spans within a broad range that contain a text: (doc_id, cite_id, pos). ranges: (doc_id, cite_id, c_start, c_end, term).

    The join is on cells of `cell` characters: a span that lies within a range starts in one of the cells that the range touches.
    """
    r = ranges.where("c_end >= c_start").withColumn("cell", F.explode(F.sequence(F.floor(F.col("c_start") / cell), F.floor(F.col("c_end") / cell))))
    s = spans.select("doc_id", "pos", "start_char", "end_char", "text", F.floor(F.col("start_char") / cell).alias("cell"))
    j = r.join(s, ["doc_id", "cell"])
    return j.where((F.col("start_char") >= F.col("c_start")) & (F.col("end_char") <= F.col("c_end")) & F.contains(F.lower("text"), F.lower("term"))).select("doc_id", "cite_id", "pos")


def in_rectangle(spans: DataFrame, rectangles: DataFrame, cell: float = 96) -> DataFrame:
    """Words that touch a rectangle of their page: (doc_id, rect_id, pos). rectangles: (doc_id, rect_id, page, x0, y0, x1, y1).

    Each page is a grid of squares of `cell`; words and rectangles are dealt to the squares that they touch, so the join is on (doc_id, page, square), and a pair counts in the first square that both touch.
    """
    squares = lambda a, b: F.sequence(F.floor(a / cell).cast("long"), F.floor(b / cell).cast("long"))

    def dealt(rows: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
        return rows.where((x1 >= x0) & (y1 >= y0)).withColumn("gx", F.explode(squares(x0, x1))).withColumn("gy", F.explode(squares(y0, y1)))

    c = F.col
    s = dealt(spans.select("doc_id", "page", "pos", "x", "y", "width", "height"), c("x"), c("y"), c("x") + c("width"), c("y") + c("height"))
    j = s.join(dealt(rectangles, c("x0"), c("y0"), c("x1"), c("y1")), ["doc_id", "page", "gx", "gy"])
    first = (c("gx") == F.floor(F.greatest("x", "x0") / cell)) & (c("gy") == F.floor(F.greatest("y", "y0") / cell))
    return j.where(first & F.expr("x < x1 AND x + width > x0 AND y < y1 AND y + height > y0")).select("doc_id", "rect_id", "pos")


def item_offsets(items: DataFrame, gap: int = 2) -> DataFrame:
    """items with start_char and end_char in the whole text, which is each page's items, a blank behind each, then `gap` characters behind each page, pages without items included.

    items: (doc_id, page from 1, pos, text, ...); those without a text have no place and are left out. Sums are made in two levels, within pages and over the lengths of pages, so a long document is as many tasks as it has pages.
    """
    rows = items.where(F.length("text") > 0)
    n = F.length("text") + 1
    lengths = rows.groupBy("doc_id", "page").agg(F.sum(n).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    begins = lengths.select("doc_id", "page", (F.coalesce(upto, F.lit(0)) + (F.col("page") - 1) * gap).alias("_begin"))
    within = F.coalesce(F.sum(n).over(Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_within", within).join(begins, ["doc_id", "page"])
    start = (F.col("_begin") + F.col("_within")).cast("long")
    return placed.select(*items.columns, start.alias("start_char"), (start + F.length("text")).alias("end_char"))


def whole_text(items: DataFrame, pages: DataFrame, gap: str = "\n\n") -> DataFrame:
    """(doc_id, text) that item_offsets() counts in. pages: (doc_id, n_pages)."""
    made = items.where(F.length("text") > 0).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda t: F.concat(t["text"], F.lit(" "))), "").alias("t"))
    every = pages.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page"))
    full = every.join(made, ["doc_id", "page"], "left").select("doc_id", F.struct("page", F.concat(F.coalesce("t", F.lit("")), F.lit(gap)).alias("t")).alias("p"))
    return full.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "").alias("text"))


def containment(quotes: DataFrame, blocks: DataFrame, least: float = 0.7) -> DataFrame:
    """First block of the page that contains at least this share of a quote's words. quotes: (doc_id, quote_id, page, quote); blocks: (doc_id, page, block, text)."""
    words = F.filter(F.split(tx.normalise(F.col("quote")), " "), lambda w: w != "")
    asked = quotes.select("doc_id", "page", "quote_id", words.alias("_w")).where(F.size("_w") > 0)
    # before the join, so that a block is cleaned once, not for every word of every quote
    j = asked.join(blocks.select("doc_id", "page", "block", tx.plain_words(F.col("text")).alias("_b")), ["doc_id", "page"])
    share = F.size(F.filter("_w", lambda w: F.contains(F.col("_b"), w))) / F.size("_w")
    return j.withColumn("ratio", share).where(F.col("ratio") >= least).groupBy("doc_id", "quote_id").agg(F.min_by("block", "block").alias("block"), F.min_by("ratio", "block").alias("ratio"))


def phrase_starts(spans: DataFrame, phrase: list[str]) -> DataFrame:
    """Positions where consecutive words contain the words of a phrase, each in turn: (doc_id, pos)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    hit = F.lit(True)
    for i, word in enumerate(phrase):
        hit = hit & F.coalesce(F.contains(F.lower(F.lead("text", i).over(w) if i else F.col("text")), F.lit(word.lower())), F.lit(False))
    return spans.withColumn("_hit", hit).where("_hit").select("doc_id", "pos")


def envelope(boxes: DataFrame, *keys: str) -> DataFrame:
    """Smallest box around the boxes of each group."""
    return boxes.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))


def next_boxes(words: DataFrame, n: int) -> DataFrame:
    """(doc_id, pos, boxes array<struct<x0, y0, x1, y1>>): of each word and the n - 1 after it, as many as there are. words: (doc_id, pos, x0, y0, x1, y1)."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, n - 1)
    return words.select("doc_id", "pos", F.collect_list(F.struct("x0", "y0", "x1", "y1")).over(w).alias("boxes"))


def merge_boxes(boxes: Column, line: float = 5, gap: float = 10) -> Column:
    """array<struct<x0, y0, x1, y1>> of boxes (the same struct, doubles) in order: one joins the box before it if it is on the same line (y0 less than `line` away) and begins less than `gap` after its end."""
    start = F.array().cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.abs(F.try_element_at(acc, F.lit(-1))["y0"] - b["y0"]) < line) & (b["x0"] - F.try_element_at(acc, F.lit(-1))["x1"] < gap)
        last = F.try_element_at(acc, F.lit(-1))
        both = F.struct(F.least(last["x0"], b["x0"]).alias("x0"), F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(F.array_sort(boxes), start, step)


def primary_only(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """Citations that start in a primary section; those that start on no known line stay. lines: (doc_id, start_char, end_char, section)."""
    on = F.expr("doc_id = _d AND c_start >= start_char AND c_start < end_char")
    hit = citations.join(lines.select(F.col("doc_id").alias("_d"), "start_char", "end_char", "section"), on, "left")
    return hit.where(F.col("section").isNull() | F.col("section").isin(*PRIMARY)).select(*citations.columns)
