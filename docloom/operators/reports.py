"""Reports as text and as rows: verdict sentences, citations for display, agreement between critics, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(passed: Column, critical: Column, warning: Column, info: Column, anchored: Column, missing: Column, applied: Column, mode: str = "AUTO") -> Column:
    """One sentence on a verdict. Parts that count nothing are left out."""
    part = lambda n, text: F.when(n > 0, F.concat(n.cast("string"), F.lit(text)))
    parts = [part(critical, " CRITICAL issues"), part(warning, " warnings"), F.when(~anchored, F.concat(missing.cast("string"), F.lit(" fields missing source quotes")))]
    if mode == "AUTO":
        parts.append(part(applied, " auto-corrections applied"))
    good = F.concat(F.lit("PASSED: All validations passed. "), warning.cast("string"), F.lit(" warnings, "), info.cast("string"), F.lit(" info notes."))
    return F.when(passed, good).otherwise(F.concat(F.lit("VALIDATION FAILED: "), F.array_join(F.array_compact(F.array(*parts)), ", ")))


def consensus(findings: DataFrame, least: int = 2) -> DataFrame:
    """(study_id, field, n_critics, severities): fields that at least `least` critics find fault with."""
    g = findings.groupBy("study_id", "field").agg(F.count_distinct("critic").alias("n_critics"), F.sort_array(F.collect_set("severity")).alias("severities"))
    return g.where(F.col("n_critics") >= least)


def escape_html(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def response_sources(responses: DataFrame) -> DataFrame:
    """(response_id, idx from 1, title, cited) from (response_id, blocks): blocks is JSON, an array of {"title", "cited_text"}; what isn't JSON has no sources."""
    blocks = F.from_json("blocks", "array<struct<title: string, cited_text: string>>")
    return responses.select("response_id", F.posexplode(blocks).alias("i", "b")).select("response_id", (F.col("i") + 1).alias("idx"), F.col("b.title").alias("title"), F.col("b.cited_text").alias("cited"))


def grounding(chunks: DataFrame) -> DataFrame:
    """Chunks as sources of an answer: (doc_id, chunk_idx, source struct<title, uri>, text)."""
    source = F.struct(F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_idx").cast("string")).alias("uri"))
    return chunks.select("doc_id", "chunk_idx", source.alias("source"), "text")


def stable_id(*columns: Column) -> Column:
    """A key that depends on the values alone, so that reruns agree."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256), F.lit(16))


def nested_fields(record: Column, paths: list[str]) -> Column:
    """array<struct<path, value>>: values at dotted paths of a JSON text, null where there is none."""
    return F.array(*[F.struct(F.lit(p).alias("path"), F.get_json_object(record, f"$.{p}").alias("value")) for p in paths])
