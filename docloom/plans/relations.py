"""Relations derived from the driver's tables with integer arithmetic only, so that any engine gets the same rows. Each has its DataFrame and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATEST_YEAR = 2026

K = "c_custkey"
STUDY = {
    "study_id": K,
    "first_author": "c_name",
    "hospital": "n_name",
    "publication_year": f"CAST(1890 + {K} % 160 AS INT)",
    "selection": f"CAST({K} % 7 AS INT)",
    "comparability": f"CAST({K} % 4 AS INT)",
    "outcome": f"CAST({K} % 5 AS INT)",
    "total": f"CAST({K} % 7 + {K} % 4 + {K} % 5 + CASE WHEN {K} % 11 = 0 THEN 1 ELSE 0 END AS INT)",
    "n_patients": f"CAST(CASE WHEN {K} % 17 = 0 THEN NULL ELSE {K} % 13 + 2 END AS INT)",
    "age_mean": f"CAST(CASE WHEN {K} % 9 = 0 THEN NULL ELSE {K} % 130 END AS INT)",
    "procedure": f"CASE {K} % 4 WHEN 0 THEN 'Decompressive surgery' WHEN 1 THEN 'suboccipital craniectomy' WHEN 2 THEN '' ELSE 'drainage' END",
    "technique": f"CASE {K} % 3 WHEN 0 THEN 'wide decompression' ELSE NULL END",
    "diagnosis": f"CASE {K} % 5 WHEN 0 THEN 'Cerebellar infarction' WHEN 1 THEN 'stroke of the cerebellum' ELSE 'stroke' END",
    "mortality": f"CASE {K} % 6 WHEN 0 THEN concat(CAST({K} % 41 AS STRING), '/40 (', CAST(CAST(floor(({K} % 41) * 2.5) AS INT) AS STRING), '%)') WHEN 1 THEN concat(CAST({K} % 140 AS STRING), '%') WHEN 2 THEN concat(CAST({K} % 41 AS STRING), '/40') WHEN 3 THEN concat(CAST(CAST(floor(({K} % 41) * 2.5) AS INT) + {K} % 4 AS STRING), '% (', CAST({K} % 41 AS STRING), '/40)') WHEN 4 THEN 'not reported' ELSE '' END",
    "mrs": f"CASE {K} % 8 WHEN 0 THEN '' WHEN 1 THEN concat(CAST({K} % 10 AS STRING), '/10 (', CAST({K} % 10 * 10 + {K} % 3 AS STRING), '%)') ELSE concat(CAST({K} % 8 AS STRING), '/10') END",
    "follow_up": f"CASE {K} % 8 WHEN 0 THEN concat(CAST({K} % 400 AS STRING), ' days') WHEN 1 THEN concat(CAST(1 + {K} % 14 AS STRING), ' months') WHEN 2 THEN concat('median ', CAST(1 + {K} % 3 AS STRING), ' years') WHEN 3 THEN '60 days' WHEN 4 THEN '135d' WHEN 5 THEN '' WHEN 6 THEN 'not stated' ELSE NULL END",
    "source_text": f"concat('In this series of ', CAST({K} % 97 AS STRING), ' cases from ', n_name, ' the result was ', CAST({K} % 41 AS STRING))",
    "is_duplicate": f"{K} % 12 = 0",
    "dup_confidence": f"CASE {K} % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END",
    "gcs": f"CAST(CASE WHEN {K} % 10 = 0 THEN NULL ELSE {K} % 23 END AS INT)",
    "mortality_pct": f"CAST(CASE WHEN {K} % 7 = 0 THEN NULL ELSE {K} % 113 - 3 END AS INT)",
    "n_stated": f"CAST({K} % 29 - 1 AS INT)",
    "evd_used": f"CASE {K} % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE NULL END",
    "complications": f"CASE {K} % 4 WHEN 0 THEN 'bleeding' WHEN 1 THEN '' ELSE NULL END",
    "comparator_exists": f"{K} % 3 = 0",
    "comparator_n": f"CAST(CASE {K} % 6 WHEN 0 THEN 0 WHEN 3 THEN NULL ELSE {K} % 50 END AS INT)",
    "difficulty": f"CASE {K} % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END",
    "screened": f"CAST({K} % 90 + 10 AS INT)",
    "excluded": f"CAST({K} % 31 AS INT)",
    "enrolled": f"CAST({K} % 90 + 10 - {K} % 31 + CASE WHEN {K} % 13 = 0 THEN 2 ELSE 0 END AS INT)",
    "arm_a": f"CAST(CASE WHEN {K} % 19 = 0 THEN NULL ELSE floor(({K} % 13 + 2) / 2.0) END AS INT)",
    "arm_b": f"CAST({K} % 13 + 2 AS INT) - CAST(floor(({K} % 13 + 2) / 2.0) AS INT) + CAST(CASE WHEN {K} % 16 = 0 THEN 1 ELSE 0 END AS INT)",
    "design": f"CASE {K} % 3 WHEN 0 THEN 'cohort' WHEN 1 THEN 'series' ELSE 'trial' END",
}
STUDIES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in STUDY.items()) + " FROM customer JOIN nation ON c_nationkey = n_nationkey"

#: Extracted fields against ground truth: per study four fields; some values changed, some missing, quotes of several qualities.
FIELDS = ("population.sampleSize", "population.age.mean", "quality.totalScore", "metadata.hospital")
_VALUES = "CASE f WHEN 0 THEN CAST(n_patients AS STRING) WHEN 1 THEN CAST(age_mean AS STRING) WHEN 2 THEN CAST(total AS STRING) ELSE hospital END"
_NAME = "CASE f " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FIELDS)) + " END"
EXTRACTED = {
    "study_id": "study_id",
    "field": _NAME,
    "value": f"CASE WHEN (study_id + f) % 10 = 7 THEN NULL WHEN (study_id + f) % 10 = 3 THEN 'changed' ELSE {_VALUES} END",
    "source_text": "CASE (study_id + f) % 4 WHEN 0 THEN source_text WHEN 1 THEN NULL WHEN 2 THEN substring(source_text, 1, 24) ELSE concat(source_text, ' by the end of follow up in all of the groups that were seen') END",
}
TRUTH = {"study_id": "study_id", "field": _NAME, "truth": _VALUES, "evidence": "source_text"}
_F4 = "(SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)"
EXTRACTED_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in EXTRACTED.items()) + f" FROM studies CROSS JOIN {_F4} x"
TRUTH_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in TRUTH.items()) + f" FROM studies CROSS JOIN {_F4} x"

#: Sources of one record: orders as papers, errata and the like.
SOURCE = "CASE o_orderkey % 5 WHEN 0 THEN 'main-paper' WHEN 1 THEN 'supplement' WHEN 2 THEN 'erratum' WHEN 3 THEN 'protocol' ELSE 'registry' END"
_SV = "CASE f WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority ELSE CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS STRING) END END"
SOURCES = {"study_id": "o_custkey", "field": "CASE f WHEN 0 THEN 'status' WHEN 1 THEN 'priority' ELSE 'arm' END", "source": SOURCE, "pos": "o_orderkey", "value": _SV}
SOURCES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in SOURCES.items()) + " FROM orders CROSS JOIN (SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2) x"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, F.expr("c_nationkey = n_nationkey")).selectExpr(*[f"{e} AS {k}" for k, e in STUDY.items()])


def _times(df: DataFrame, n: int, columns: dict[str, str]) -> DataFrame:
    return df.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).selectExpr(*[f"{e} AS {k}" for k, e in columns.items()])


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(studies(spark, sf_dir), 4, EXTRACTED)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(studies(spark, sf_dir), 4, TRUTH)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), 3, SOURCES)


SECTIONED = "concat('Intro line', chr(10), CASE doc_id % 4 WHEN 0 THEN 'Methods: ' WHEN 1 THEN 'Results' WHEN 2 THEN 'Table 3' ELSE 'Discussion ' END, chr(10), text)"
HEADLINE = "concat(CASE doc_id % 6 WHEN 0 THEN 'Methods: x' WHEN 1 THEN 'Methods' WHEN 2 THEN 'table 3 of' WHEN 3 THEN 'Fig 2' WHEN 4 THEN 'Background of' ELSE 'x results: ' END, chr(10), text)"
