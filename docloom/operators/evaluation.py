"""Extracted records against ground truth, and reports on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Fields that weigh more, and the kinds of errors in the order of the report.
CRITICAL_FIELDS = ("population.sampleSize", "population.age.mean", "intervention.technique", "outcomes.mortality", "outcomes.mRS_favorable", "quality.totalScore")
ERRORS = ("missing", "hallucination", "inaccurate", "partial", "correct")


def unpivot(studies: DataFrame, fields: dict[str, str], id_col: str = "study_id") -> DataFrame:
    """(study_id, field, value string): fields maps field names to columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for f, c in fields.items()])
    return studies.select(F.col(id_col).alias("study_id"), F.inline(pairs))


def field_metrics(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """(study_id, field, match, has_source, grounding, error_type), one row per annotation.

    extracted: (study_id, field, value, source_text). truth: (study_id, field, truth, evidence). Values compare as strings, two nulls are alike. A value is grounded in a quote of 10
    characters or more; grounding is the quote's word overlap with the annotated evidence.
    """
    j = truth.join(extracted, ["study_id", "field"], "left")
    has = (F.length(F.coalesce("source_text", F.lit(""))) >= 10) & F.contains(F.col("field"), F.lit("."))
    g = F.when(has & (F.coalesce("evidence", F.lit("")) != ""), tx.jaccard(F.col("source_text"), F.col("evidence"))).otherwise(0.0)
    j = j.withColumns({"match": F.equal_null("value", "truth"), "has_source": has, "grounding": g})
    kind = F.when(F.col("match"), "correct").when(F.coalesce("value", F.lit("")) == "", "missing").when(~F.col("has_source") | (F.col("grounding") < 0.3), "hallucination").when(F.col("grounding") < 0.7, "partial").otherwise("inaccurate")
    return j.select("study_id", "field", "match", "has_source", "grounding", kind.alias("error_type"))


def study_metrics(metrics: DataFrame) -> DataFrame:
    """(study_id, n_fields, accuracy, f1, grounding_rate, critical_accuracy, precision, recall).

    accuracy is the share of annotations that match; f1 equals it, as precision and recall do where every annotated field counts as extracted. precision and recall
    here leave out fields that weren't extracted, from the former only.
    """
    share = lambda c: F.avg(c.cast("double"))
    critical = F.col("field").isin(*CRITICAL_FIELDS)
    found = F.col("error_type") != "missing"
    return metrics.groupBy("study_id").agg(
        F.count("*").alias("n_fields"), share(F.col("match")).alias("accuracy"), share(F.col("match")).alias("f1"), share(F.col("has_source")).alias("grounding_rate"),
        F.coalesce(F.avg(F.when(critical, F.col("match").cast("double"))), F.lit(1.0)).alias("critical_accuracy"),
        F.coalesce(F.avg(F.when(found, F.col("match").cast("double"))), F.lit(0.0)).alias("precision"), share(F.col("match")).alias("recall"),
    )


def error_histogram(metrics: DataFrame) -> DataFrame:
    """One row with a count per kind of error, zeros included."""
    return metrics.agg(*[F.count_if(F.col("error_type") == e).alias(e) for e in ERRORS])


def by_stratum(per_study: DataFrame, strata: DataFrame, column: str) -> DataFrame:
    """(stratum, n, avg_f1). strata: (study_id, column)."""
    return per_study.join(strata.select("study_id", F.col(column).alias("stratum")), "study_id").groupBy("stratum").agg(F.count("*").alias("n"), F.avg("f1").alias("avg_f1"))


def completeness(columns: list[str]) -> tuple[Column, Column]:
    """Share of columns that aren't null, and the names of those that are."""
    there = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return there / len(columns), F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))


def truthy_completeness(columns: list[str]) -> Column:
    """Percentage of columns that are neither null nor empty nor 0 nor false."""
    full = lambda c: F.coalesce(~F.col(c).cast("string").isin("", "0", "0.0", "false"), F.lit(False))
    return tx.round_half_up(100 * sum((full(c).cast("int") for c in columns), F.lit(0)) / len(columns))


def source_share(fields: DataFrame) -> DataFrame:
    """(study_id, score): share of values with a quote of more than 10 characters, 1 without values. fields: (study_id, field, value, source_text)."""
    quoted = F.length(F.coalesce("source_text", F.lit(""))) > 10
    return fields.groupBy("study_id").agg(F.coalesce(F.avg(F.when(F.col("value").isNotNull(), quoted.cast("double"))), F.lit(1.0)).alias("score"))


def weighted_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the scores that aren't null, to two digits, halves up."""
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts.values()), F.lit(0.0))
    return tx.round_half_up(F.try_divide(value, total), 2)


def latest_annotations(annotations: DataFrame) -> DataFrame:
    """The last annotation of each field. annotations: (study_id, field, truth, annotator, seq)."""
    return annotations.groupBy("study_id", "field").agg(F.max_by("truth", "seq").alias("truth"), F.sort_array(F.collect_set("annotator")).alias("annotators"))


# What a report advises, and when: six means of studies and the number of hallucinated fields.
ADVICE = (
    ("Overall F1 score below 0.7 - consider improving extraction prompts or model", "f1 < 0.7"),
    ("Low source grounding rate - extraction may be hallucinating data", "grounding_rate < 0.5"),
    ("Newcastle-Ottawa scores frequently inconsistent - add validation checks", "nos_consistency < 0.8"),
    ("High hallucination error count - strengthen source text verification", "hallucination > 5 * n_studies"),
    ("Critical field accuracy below 85% - focus on improving high-importance field extraction", "critical_accuracy < 0.85"),
)
MEANS = ("precision", "recall", "f1", "grounding_rate", "nos_consistency", "critical_accuracy")


def corpus_means(per_study: DataFrame, consistent: DataFrame) -> DataFrame:
    """One row: n_studies and six means. consistent: (study_id, nos_consistency boolean)."""
    j = per_study.join(consistent.select("study_id", F.col("nos_consistency").cast("double").alias("nos_consistency")), "study_id")
    return j.agg(F.count("*").alias("n_studies"), *[F.avg(c).alias(c) for c in MEANS])


def report(per_study: DataFrame, consistent: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: the means, a count per kind of error, and what they advise. Over no studies: no advice."""
    # both sides are one row
    both = corpus_means(per_study, consistent).withColumn("_one", F.lit(1)).join(error_histogram(metrics).withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("recommendations", F.array_compact(F.array(*[F.when(F.expr(when), F.lit(text)) for text, when in ADVICE])))


# What each evaluator weighs in the composite, and from where a record passes.
EVALUATORS = {"faithfulness": 0.30, "relevancy": 0.15, "hallucination": 0.30, "clinical": 0.25}
PASSES = 0.7


def composite(scores: DataFrame) -> DataFrame:
    """(study_id, composite, passes, weak: evaluators under the threshold, in order) from (study_id, one column per evaluator). A null score counts as 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in EVALUATORS.items()), F.lit(0.0))
    weak = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0.0)) < PASSES, F.lit(c)) for c in EVALUATORS]))
    return scores.select("study_id", total.alias("composite"), (F.round(total, 9) >= PASSES).alias("passes"), weak.alias("weak"))


def section_completion(fields: DataFrame) -> DataFrame:
    """(study_id, section, percent): share of a section's fields that have a value; the section is what stands before a field's first point. fields: (study_id, field, value)."""
    full = (F.coalesce("value", F.lit("")) != "").cast("double")
    return fields.groupBy("study_id", F.substring_index("field", ".", 1).alias("section")).agg(tx.round_half_up(100 * F.avg(full)).alias("percent"))


def truth_template(studies: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """An empty annotation for each field: (study_id, field, truth null, checksum of the study's id and field)."""
    one = studies.select("study_id", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    return one.select("study_id", "field", F.lit(None).cast("string").alias("truth"), F.sha2(F.concat_ws(":", "study_id", "field"), 256).alias("checksum"))
