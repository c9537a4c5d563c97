"""Queries of reports and small projections. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, export, reports, rules, spans
from . import relations as rel
from .queries import _COMPLETE, _RANGE, _REF, _STUDIES, _chunks, _issues_sql, docs, query
from .relations import table


@query(f"""{_STUDIES}, i AS ({_issues_sql(_RANGE)} UNION ALL {_issues_sql(_COMPLETE)}) SELECT study_id, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS n_critical FROM i GROUP BY study_id""")
def so2_all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    both = rules.union(rules.apply_rules(s, rules.range_rules(rel.LATEST_YEAR)), rules.apply_rules(s, rules.completeness_rules()))
    return both.groupBy("study_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"))


@query(f"""{_STUDIES}, i AS ({_issues_sql(_RANGE)} UNION ALL SELECT study_id, 'other', 'quality.totalScore', 'WARNING', '' FROM studies WHERE study_id % 2 = 0)
SELECT study_id, field, count(DISTINCT critic) AS n_critics, list_sort(list(DISTINCT severity)) AS severities FROM i GROUP BY study_id, field HAVING count(DISTINCT critic) >= 2""")
def a25_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    other = s.where("study_id % 2 = 0").selectExpr("study_id", "'other' AS critic", "'quality.totalScore' AS field", "'WARNING' AS severity", "'' AS message")
    return reports.consensus(rules.union(rules.apply_rules(s, rules.range_rules(rel.LATEST_YEAR)), other))


@query(f"""{_STUDIES} SELECT study_id, CASE WHEN study_id % 4 = 0 THEN concat('PASSED: All validations passed. ', study_id % 3, ' warnings, 0 info notes.') ELSE concat('VALIDATION FAILED: ', concat_ws(', ', CASE WHEN study_id % 4 > 0 THEN concat(study_id % 4, ' CRITICAL issues') END, CASE WHEN study_id % 3 > 0 THEN concat(study_id % 3, ' warnings') END, CASE WHEN study_id % 5 = 0 THEN '7 fields missing source quotes' END)) END AS summary FROM studies""")
def f41_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("study_id")
    return rel.studies(spark, sf_dir).select("study_id", reports.summary(k % 4 == 0, k % 4, k % 3, F.lit(0), k % 5 != 0, F.lit(7), F.lit(0)).alias("summary"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM documents")
def f41_escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", reports.escape_html(F.col("text")).alias("html"))


@query("SELECT c_custkey AS response_id, 1 AS idx, c_mktsegment AS title, 'a \"b\"' AS cited FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 2, 'T', NULL FROM customer WHERE c_custkey % 3 > 0")
def f43_response_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.when(F.col("c_custkey") % 3 == 0, "not json").otherwise(F.concat(F.lit('[{"title": "'), "c_mktsegment", F.lit('", "cited_text": "a \\"b\\""}, {"title": "T"}]')))
    return reports.response_sources(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("response_id"), blocks.alias("blocks")))


@query("WITH c AS (SELECT doc_id, unnest(range(0, CAST(greatest(ceil((length(text) - 2400) / 2000.0), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, i::INT AS chunk_idx, concat('Document ', doc_id) AS title, concat('doc:', doc_id, '#', i) AS uri FROM c")
def f42_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grounding(_chunks(spark, sf_dir)).select("doc_id", "chunk_idx", "source.title", "source.uri")


@query("SELECT c_custkey AS id, substring(sha256(concat(c_custkey, chr(31), c_name)), 1, 16) AS key FROM customer")
def f17_stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), reports.stable_id(F.col("c_custkey"), F.col("c_name")).alias("key"))


@query("SELECT c_custkey AS id, 'a.b' AS path, CAST(c_nationkey AS STRING) AS value FROM customer UNION ALL SELECT c_custkey, 'a.c', NULL FROM customer UNION ALL SELECT c_custkey, 'd', c_mktsegment FROM customer")
def p5_p6_nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_json(F.struct(F.struct(F.col("c_nationkey").alias("b")).alias("a"), F.col("c_mktsegment").alias("d")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.inline(reports.nested_fields(record, ["a.b", "a.c", "d"])))


@query(f"""WITH r AS (SELECT {", ".join(_REF)} FROM part), q AS (SELECT round(CASE WHEN authors <> '' THEN 0.25 ELSE 0 END + 0.25 + CASE WHEN journal IS NOT NULL THEN 0.20 ELSE 0 END + 0.15 + CASE WHEN doi IS NOT NULL THEN 0.15 ELSE 0 END, 6) AS q FROM r)
SELECT count(*) FILTER (q >= 0.85) AS valid, count(*) FILTER (q < 0.85) AS invalid, round(avg(q), 6)::DOUBLE AS avg_quality FROM q""")
def a12_reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "part").selectExpr(*_REF).select(F.round(export.citation_quality(), 6).alias("q"))
    return q.agg(F.count_if(F.col("q") >= 0.85).alias("valid"), F.count_if(F.col("q") < 0.85).alias("invalid"), F.round(F.avg("q"), 6).alias("avg_quality"))


@query(f"{_STUDIES}, u AS (SELECT study_id, unnest(['author', 'procedure', 'mortality']) AS field, unnest([first_author, procedure, mortality]) AS value FROM studies) SELECT study_id, field, value FROM u WHERE length(coalesce(value, '')) >= 3")
def p13_searchable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.unpivot(rel.studies(spark, sf_dir), {"author": "first_author", "procedure": "procedure", "mortality": "mortality"}).where(F.length(F.coalesce("value", F.lit(""))) >= 3)


@query("SELECT l_orderkey AS page, count(*) AS n, list_sort(list(l_linenumber)) AS items FROM lineitem GROUP BY l_orderkey")
def a14_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("l_linenumber")).alias("items"))


_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'Mean Age' WHEN 1 THEN 'GCS score' WHEN 2 THEN 'Deaths' WHEN 3 THEN 'Wound infection' ELSE 'Colour' END"


@query(f"SELECT p_partkey AS id, {_KIND.replace('Mean Age', 'demographics').replace('GCS score', 'baseline').replace('Deaths', 'outcomes').replace('Wound infection', 'complications').replace('Colour', 'other')} AS kind FROM part")
def f28_table_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.table_kind(F.array(F.lit("x"), F.expr(_KIND))).alias("kind"))


@query("SELECT doc_id, doc_id % 3 AS c_start FROM documents WHERE doc_id % 4 < 2 OR doc_id % 3 = 2")
def p7_primary_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    lines = d.selectExpr("doc_id", "0L AS start_char", "2L AS end_char", "CASE WHEN doc_id % 4 < 2 THEN 'results' ELSE 'discussion' END AS section")
    return spans.primary_only(d.selectExpr("doc_id", "doc_id % 3 AS c_start"), lines)


@query(f"{_STUDIES} SELECT a.study_id, (a.selection = b.selection AND coalesce(a.age_mean, -1) = coalesce(b.age_mean, -1)) AS same FROM studies a JOIN studies b ON b.study_id = a.study_id + 70")
def f15_deep_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir).select("study_id", F.struct("selection", F.struct("age_mean").alias("age")).alias("r"))
    other = s.select((F.col("study_id") - 70).alias("study_id"), F.col("r").alias("q"))
    return s.join(other, "study_id").select("study_id", F.equal_null("r", "q").alias("same"))
