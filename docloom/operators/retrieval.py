"""Keyword and vector retrieval, and what is built on their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyword_score(text: Column, query: str) -> Column:
    """Share of the query's terms (parts between white space, lower case) that the text contains."""
    terms = F.split(F.lower(F.lit(query)), r"\s+")
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms)


def keyword_top_k(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """The k best chunks of all, ties to smaller (doc_id, chunk_idx): a top-k per partition and a merge, without a full sort."""
    return chunks.withColumn("score", keyword_score(F.col("text"), query)).orderBy(F.desc("score"), "doc_id", "chunk_idx").limit(k)


def context(hits: DataFrame, most: int = 500) -> DataFrame:
    """Per document, its hits in chunk order, each cut to `most` characters: (doc_id, n_chunks, context)."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_idx", F.left("text", F.lit(most)).alias("text"))))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(parts, lambda c: c["text"]), "\n\n---\n\n").alias("context"))


def best_per_chunk(hits: DataFrame) -> DataFrame:
    """One row per chunk with its best score."""
    return hits.groupBy("doc_id", "chunk_idx").agg(F.max("score").alias("score"), F.count("*").alias("n_hits"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors nearest to one query vector, exactly: the query is a literal, so each partition keeps its k best."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col("embedding"), q)).orderBy(F.desc("score"), "vec_id").limit(k)


def recent_turns(turns: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of each conversation; where older ones are left out, one by the model at the beginning of those is dropped too. turns: (conv_id, turn, role, text), role user or model."""
    w = Window.partitionBy("conv_id")
    last = turns.withColumn("_r", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("_n", F.count("*").over(w)).where(F.col("_r") <= n)
    return last.where(~((F.col("_r") == n) & (F.col("_n") > n) & (F.col("role") == "model"))).drop("_r", "_n")


def inline_citations(responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Markers [n] of a response joined with its n-th chunk; a response without a valid marker cites all of its chunks.

    responses: (response_id, text). chunks: (response_id, idx from 1). Returns (response_id, idx), distinct.
    """
    marks = responses.select("response_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[(\d{1,9})\]"), F.lit(1)).cast("array<int>")).alias("idx")).distinct()
    hit = marks.join(chunks.select("response_id", "idx"), ["response_id", "idx"], "left_semi")
    rest = chunks.select("response_id", "idx").join(hit.select("response_id").distinct(), "response_id", "left_anti")
    return hit.unionByName(rest)


def relevance(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id").agg(F.avg("score").alias("avg_score"))
