"""Steps that a model or a vendor's service does elsewhere: one interface, and an offline default made of rules.

The default reads what patterns can find. It makes pipelines run without a network and is not meant to equal a model.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

KINDS = ("metadata", "population", "intervention", "comparator", "outcomes", "quality", "citations")


class Provider(Protocol):
    def extract(self, kind: str, docs: DataFrame) -> DataFrame:
        """(doc_id, field, value, source_text) for documents (doc_id, text). kind: one of KINDS."""


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


class Rules:
    """Patterns for the numbers that reports state in fixed forms."""

    patterns = {
        "metadata": {"metadata.publicationYear": r"\b((?:19|20)\d{2})\b"},
        "population": {"population.sampleSize": r"(?i)\bn\s*=\s*(\d+)", "population.age.mean": r"(?i)age[^.\d]{0,30}(\d+\.?\d*)"},
        "intervention": {"intervention.procedure": r"(?i)(decompressive \w+|craniectomy)"},
        "comparator": {"comparator.type": r"(?i)(control group|conservative treatment)"},
        "outcomes": {"outcomes.mortality": r"(?i)mortality[^.\d]{0,30}(\d+\.?\d*\s*%|\d+\s*/\s*\d+)"},
        "quality": {"quality.totalScore": r"(?i)total score[^.\d]{0,20}(\d)"},
        "citations": {"citations.first": r"\[(\d+)\]"},
    }

    def extract(self, kind: str, docs: DataFrame) -> DataFrame:
        if kind not in self.patterns:
            raise ValueError(f"unknown kind: {kind}")
        text = F.col("text")
        rows = [F.when(_found(text, p).isNotNull(), F.struct(F.lit(f).alias("field"), _found(text, p).alias("value"), F.regexp_extract(text, p, 0).alias("source_text"))) for f, p in self.patterns[kind].items()]
        return docs.select("doc_id", F.inline(F.array_compact(F.array(*rows))))


def extract_all(provider: Provider, docs: DataFrame, least: int = 100) -> DataFrame:
    """All kinds, for documents of at least `least` characters; shorter ones are scans without text."""
    usable = docs.where(F.length("text") >= least)
    out = provider.extract(KINDS[0], usable)
    for kind in KINDS[1:]:
        out = out.unionByName(provider.extract(kind, usable))
    return out


def status(docs: DataFrame, extracted: DataFrame, least: int = 100) -> DataFrame:
    """(doc_id, status): scanned, empty or extracted."""
    n = extracted.groupBy("doc_id").agg(F.count("*").alias("n"))
    s = F.when(F.coalesce(F.length("text"), F.lit(0)) < least, "scanned").when(F.col("n").isNull(), "empty").otherwise("extracted")
    return docs.join(n, "doc_id", "left").select("doc_id", s.alias("status"))


# Patterns of imaging findings, and the weight of each finding.
IMAGING = (
    ("infarct_volume", r"(?i)(?:infarct|lesion)\s+volume.*?(\d+\.?\d*)\s*(ml|cm3)"),
    ("edema_volume", r"(?i)edema\s+volume.*?(\d+\.?\d*)\s*(ml|cm3)"),
    ("midline_shift", r"(?i)midline\s+shift.*?(\d+\.?\d*)\s*mm"),
    ("fourth_ventricle", "(?i)(fourth ventricle|4th ventricle|IVth ventricle)"),
    ("hydrocephalus", "(?i)hydrocephalus"),
)
IMAGING_WEIGHTS = (("infarct_volume_ml", 0.3), ("edema_volume_ml", 0.2), ("midline_shift_mm", 0.2), ("imaging_modality", 0.15), ("imaging_timepoint", 0.15))


def imaging(docs: DataFrame) -> DataFrame:
    """Imaging findings of (doc_id, text): numbers, flags, mentions as map, confidence."""
    t = F.col("text")
    num = lambda p: _found(t, p).try_cast("double")
    mentions = F.map_from_entries(F.array_compact(F.array(*[F.when(F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0))) > 0, F.struct(F.lit(n), F.array_join(F.regexp_extract_all(t, F.lit(p), F.lit(0)), "; "))) for n, p in IMAGING])))
    out = docs.select(
        "doc_id", num(r"(?i)infarct\s+volume.*?(\d+\.?\d*)").alias("infarct_volume_ml"), num(r"(?i)edema\s+volume.*?(\d+\.?\d*)").alias("edema_volume_ml"), num(r"(?i)midline\s+shift.*?(\d+\.?\d*)").alias("midline_shift_mm"),
        t.rlike("(?i)hydrocephalus").alias("hydrocephalus"), t.rlike("(?i)(fourth ventricle|4th ventricle).*?compres").alias("ventricle_compression"),
        tx.imaging_timepoint(t).alias("imaging_timepoint"), tx.imaging_modality(t).alias("imaging_modality"), mentions.alias("mentions"),
    )
    score = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in IMAGING_WEIGHTS), F.lit(0.0))
    return out.withColumn("confidence", F.least(score, F.lit(1.0)))


# Which reviewers look at a record, in order of dispatch, and when.
REVIEWERS = (
    ("math_consistency", "true"), ("scale_inversion", "has_outcomes"), ("etiology_segregation", "coalesce(diagnosis, '') <> ''"), ("evd_confounding", "evd_used IS NOT NULL"),
    ("flowchart_consistency", "has_text"), ("surgical_technique", "true"), ("outcome_definition", "has_outcomes"), ("source_citation", "has_text"),
)


def triage(records: DataFrame) -> DataFrame:
    """(study_id, reviewers, priority, skipped, quality) from (study_id, diagnosis, evd_used, has_text, has_outcomes, has_comparator, has_quality).

    priority is the order of dispatch, but that the reviewer of scales comes first.
    """
    on = [F.when(F.expr(c), F.lit(n)) for n, c in REVIEWERS]
    sorted_on = [on[1], on[0], *on[2:]]
    off = [F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in REVIEWERS]
    plus = sum((F.when(F.col(c), w).otherwise(0.0) for c, w in (("has_text", 0.15), ("has_comparator", 0.1), ("has_outcomes", 0.15), ("has_quality", 0.1))), F.lit(0.5))
    return records.select("study_id", F.array_compact(F.array(*on)).alias("reviewers"), F.array_compact(F.array(*sorted_on)).alias("priority"), F.array_compact(F.array(*off)).alias("skipped"), F.least(F.lit(1.0), plus).alias("quality"))


def discussion(text: Column) -> Column:
    """struct<findings, limitations, implications>: the first sentences with certain words, at most 3, 3 and 2."""
    s = F.split(text, r"\.\s+")
    pick = lambda words, n: F.slice(F.filter(s, lambda x: F.lower(x).rlike("|".join(words))), F.lit(1), F.lit(n))
    last = F.array_join(pick(("implication", "suggest"), 2), ". ")
    return F.struct(pick(("found", "showed"), 3).alias("findings"), pick(("limitation", "limited by"), 3).alias("limitations"), F.when(last == "", "Not explicitly stated").otherwise(last).alias("implications"))


def fallback_references(docs: DataFrame) -> DataFrame:
    """(doc_id, number, raw_text, quality): lines of more than 20 characters, numbered from 1."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(tx.strip(x)) > 20)
    return docs.select("doc_id", F.posexplode(lines).alias("i", "raw_text")).select("doc_id", (F.col("i") + 1).alias("number"), "raw_text", F.lit(0.3).alias("quality"))
