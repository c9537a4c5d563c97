"""File sources. Schemas are given, never inferred; rows that don't parse are kept aside instead of failing the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STUDY = (
    "id string, createdAt string, data struct<metadata: struct<firstAuthor: string, publicationYear: int, hospitalCenter: string, studyPeriod: string>,"
    " population: struct<sampleSize: int, diagnosis: string>, quality: struct<selectionScore: int, comparabilityScore: int, outcomeScore: int, totalScore: int>>"
)


def read_json(spark: SparkSession, path: str, schema: str = STUDY) -> DataFrame:
    """Whole-array JSON files; records that don't parse have their text in _corrupt_record. A missing path gives no rows."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def list_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, bytes, modified) of the PDF files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose names aren't known yet."""
    return files.join(known.select("name"), "name", "left_anti")


def split_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page from 0, text): texts parted at form feeds."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "text"))


def join_pages(pages: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, text, n_pages): pages in order with a blank line between; first and last, both included, cut out a range."""
    some = pages if first is None else pages.where(F.col("page").between(first, last))
    parts = F.sort_array(F.collect_list(F.struct("page", "text")))
    return some.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("n_pages"))


def marked_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages under headings that number them."""
    parts = F.sort_array(F.collect_list(F.struct("page", "text")))
    line = F.transform(parts, lambda p: F.concat(F.lit("--- Page "), p["page"].cast("string"), F.lit(" ---\n"), p["text"]))
    return pages.groupBy("doc_id").agg(F.array_join(line, "\n").alias("text"))


LAYOUT = "page array<struct<_width: double, _height: double, word: array<struct<_VALUE: string, _xMin: double, _yMin: double, _xMax: double, _yMax: double>>>>"


def layout_words(xml: Column) -> Column:
    """array<struct<page, text, x, y, width, height>> from the XML of a page layout."""
    pages = F.from_xml(xml, LAYOUT)["page"]

    def words(p: Column, i: Column) -> Column:
        one = lambda w: F.struct((i + 1).alias("page"), w["_VALUE"].alias("text"), w["_xMin"].alias("x"), w["_yMin"].alias("y"), (w["_xMax"] - w["_xMin"]).alias("width"), (w["_yMax"] - w["_yMin"]).alias("height"))
        return F.transform(F.coalesce(p["word"], F.array()), one)

    return F.flatten(F.transform(pages, words))


_BOX = "_xMin: double, _yMin: double, _xMax: double, _yMax: double"
NESTED = f"page array<struct<_width: double, _height: double, block array<struct<{_BOX}, line: array<struct<{_BOX}, word: array<struct<_VALUE: string, {_BOX}>>>>>>>>"


def layout_blocks(layouts: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(doc_id, page, block, line, word, pos, text, x0, y0, x1, y1): the words of pages of blocks of lines. layouts: (doc_id, and XML text).

    All places count from 1, but pos, which counts a page's words from 0 through its blocks and lines. Words without a text have no row and no place; what isn't such XML has no words. Each level is opened by a generator
    in the same stage; counts of words ahead come from the sizes within the record, so nothing is shuffled.
    """
    full = lambda words: F.filter(F.coalesce(words, F.array()), lambda w: F.coalesce(w["_VALUE"], F.lit("")) != "")
    pages = layouts.select("doc_id", F.posexplode(F.from_xml(xml_col, NESTED)["page"]).alias("page", "p"))
    # a page's lines in order, each with its block's and its own place
    flat = F.flatten(F.transform(F.coalesce("p.block", F.array()), lambda b, i: F.transform(F.coalesce(b["line"], F.array()), lambda l, j: F.struct((i + 1).alias("block"), (j + 1).alias("line"), full(l["word"]).alias("words")))))
    lines = pages.select("doc_id", (F.col("page") + 1).alias("page"), flat.alias("lines"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("ahead"))
    ahead = F.aggregate("lines", start, lambda s, l: F.struct((s["n"] + F.size(l["words"])).alias("n"), F.array_append(s["ahead"], s["n"]).alias("ahead")), lambda s: s["ahead"])
    lines = lines.withColumn("ahead", ahead).select("doc_id", "page", F.inline(F.arrays_zip(F.col("lines").alias("l"), F.col("ahead").alias("ahead"))))
    words = lines.select("doc_id", "page", "l.block", "l.line", "ahead", F.posexplode("l.words").alias("word", "w"))
    box = [F.col(f"w._{a}").alias(b) for a, b in (("xMin", "x0"), ("yMin", "y0"), ("xMax", "x1"), ("yMax", "y1"))]
    return words.select("doc_id", "page", "block", "line", (F.col("word") + 1).alias("word"), (F.col("ahead") + F.col("word")).alias("pos"), F.col("w._VALUE").alias("text"), *box)


def grid(rows: Column) -> tuple[Column, Column]:
    """Headers and rows of extracted cells, array<array<string>>: null cells are empty, white space is single blanks, the first row with any content is the header."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    full = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    return F.try_element_at(full, F.lit(1)), F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0)))
