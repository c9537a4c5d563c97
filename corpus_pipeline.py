"""The corpus pipeline: five stages over `documents`, each on all that the one before kept.

    from corpus_pipeline import run
    run(spark, "/data/sf1")

Between stages the documents are written as Parquet and read again, so every stage starts from a stable table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common, kneser_ney, mixing, ngram_join, packing, pii

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity and toxicity pass their language's limits."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.classify(docs, labels, keep=list(COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the new text."""
    return pii.redact(docs, pii.train(docs), length_col="n_chars").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (0, 1 or 2), as so many rows."""
    # rows are told apart by all they hold, so that repeated ids stay documents of their own; rows that are wholly alike are one, taken as often as all of them together
    docs = docs.select(*COLUMNS).withColumn("_row", F.xxhash64(*COLUMNS))
    taken = mixing.mix(docs, common.n_words(F.col("text")), id_col="_row").where("copies > 0").groupBy(F.col("doc_id").alias("_row")).agg(F.sum("copies").alias("copies"))
    rows = docs.dropDuplicates(["_row"]).join(taken, "_row")
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: (sequence_id, n_tokens, ids, pieces). Texts reach Python some hundreds at a time in this session from now on, as the executors hold what earlier stages needed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return packing.pack(docs, packing.encoder_of(common.tokenizer_file()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixture),
    ("packing", packed),
]

#: SQL can express neither the language model nor MinHash, expectation-maximisation, dependent rounding or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage{i}")
            common.discard(before)
    return docs
