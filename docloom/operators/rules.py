"""Validation of study records: rules as data, compiled to one pass that yields issues; confidence and verdict."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

ISSUE = ("study_id", "critic", "field", "severity", "message")


@dataclass(frozen=True)
class Rule:
    """An issue for every row where `broken` holds (SQL condition over the columns `needs`; null counts as no)."""

    critic: str
    field: str
    severity: str
    broken: str
    message: str
    needs: tuple[str, ...]


def bounds(field: str, column: str, low: float, high: float, label: str, severity: str = "CRITICAL") -> Rule:
    return Rule("range", field, severity, f"{column} < {low} OR {column} > {high}", f"{label} outside {low}-{high}", (column,))


def range_rules(latest_year: int) -> list[Rule]:
    """Possible values. latest_year is a parameter, so that results don't change with the calendar."""
    return [
        bounds("population.age.mean", "age_mean", 0, 120, "mean age"),
        bounds("population.gcs", "gcs", 3, 15, "coma score"),
        bounds("outcomes.mortality_rate", "mortality_pct", 0, 100, "mortality percentage"),
        bounds("metadata.publicationYear", "publication_year", 1900, latest_year, "publication year", "WARNING"),
        bounds("quality.totalScore", "total", 0, 9, "total score"),
        bounds("quality.selectionScore", "selection", 0, 4, "selection score"),
        bounds("quality.comparabilityScore", "comparability", 0, 2, "comparability score"),
        bounds("quality.outcomeScore", "outcome", 0, 3, "outcome score"),
        Rule("range", "quality.totalScore", "CRITICAL", "abs(selection + comparability + outcome - total) > 0.1", "total differs from the sum of domains", ("selection", "comparability", "outcome", "total")),
    ]


def absent(column: str, field: str, label: str) -> Rule:
    return Rule("completeness", field, "WARNING", f"coalesce(CAST({column} AS STRING), '') = ''", f"missing: {label}", (column,))


def completeness_rules() -> list[Rule]:
    return [
        absent("first_author", "metadata.firstAuthor", "first author"),
        absent("publication_year", "metadata.publicationYear", "publication year"),
        absent("n_patients", "population.sampleSize", "sample size"),
        absent("procedure", "intervention.procedure", "procedure"),
        absent("mortality", "outcomes.mortality", "mortality"),
        Rule("completeness", "comparator.sampleSize", "WARNING", "comparator_exists AND coalesce(comparator_n, 0) = 0", "comparator without sample size", ("comparator_exists", "comparator_n")),
    ]


def criteria_rules(topic: tuple[str, ...] = ("cerebellar", "cerebellum"), surgery: tuple[str, ...] = ("decompres", "craniectomy")) -> list[Rule]:
    none_of = lambda col, words: " AND ".join(f"NOT contains(lower(coalesce({col}, '')), '{w}')" for w in words)
    return [
        Rule("criteria", "population.diagnosis", "CRITICAL", none_of("diagnosis", topic), "topic not met", ("diagnosis",)),
        Rule("criteria", "intervention.procedure", "CRITICAL", f"{none_of('procedure', surgery)} AND {none_of('technique', surgery)}", "procedure not met", ("procedure", "technique")),
        Rule("criteria", "outcomes", "CRITICAL", "coalesce(mortality, '') = '' AND coalesce(mrs, '') = '' AND coalesce(complications, '') = ''", "no clinical outcome", ("mortality", "mrs", "complications")),
        Rule("criteria", "population.sampleSize", "WARNING", "coalesce(n_patients, 0) < 5", "small sample", ("n_patients",)),
    ]


def sample_rules(column: str = "n_stated") -> list[Rule]:
    """A sample size is a whole number above 0."""
    return [Rule("arithmetic", "population.sampleSize", "CRITICAL", f"{column} <= 0 OR {column} <> floor({column})", "sample size is not a positive whole number", (column,))]


def sum_rules(whole: str, parts: tuple[str, ...], field: str = "population.sampleSize") -> list[Rule]:
    """Groups of patients add up to all of them, where all numbers are given."""
    return [Rule("math_consistency", field, "WARNING", f"{' + '.join(parts)} <> {whole}", "groups do not add up to the whole", (whole, *parts))]


def flow_rules(screened: str = "screened", excluded: str = "excluded", enrolled: str = "enrolled") -> list[Rule]:
    """Patients screened less those excluded are those enrolled, and no more can be excluded than were screened."""
    needs = (screened, excluded, enrolled)
    return [
        Rule("flowchart_consistency", "population.flow", "WARNING", f"{screened} - {excluded} <> {enrolled}", "screened less excluded differs from enrolled", needs),
        Rule("flowchart_consistency", "population.flow", "CRITICAL", f"{excluded} > {screened}", "more excluded than screened", needs[:2]),
    ]


def apply_rules(studies: DataFrame, rules: list[Rule], id_col: str = "study_id") -> DataFrame:
    """(study_id, critic, field, severity, message): one row per broken rule, from a single pass whatever their number. A rule whose columns the table lacks is an error."""
    lacks = {c for r in rules for c in r.needs} - set(studies.columns)
    if lacks:
        raise ValueError(f"no columns {sorted(lacks)}")
    issue = lambda r: F.struct(*[F.lit(x).alias(n) for n, x in (("critic", r.critic), ("field", r.field), ("severity", r.severity), ("message", r.message))])
    broken = F.array(*[F.when(F.expr(r.broken), issue(r)) for r in rules])
    return studies.select(F.col(id_col).alias("study_id"), F.explode(F.array_compact(broken)).alias("i")).select("study_id", "i.*")


def arithmetic(measures: DataFrame, text_col: str = "mortality", field: str = "outcomes.mortality", strict: bool = False) -> DataFrame:
    """Texts whose fraction and percentage differ by more than one point: (study_id, field, severity, deaths, n, stated, suggested).

    strict takes the number a text begins with for the percentage, even where it is part of the fraction ("12/20 (60%)"); otherwise the number before the percent sign counts.
    """
    t = F.col(text_col)
    a, b, p = tx.fraction_part(t, 1), tx.fraction_part(t, 2), tx.parse_percentage(t, strict)
    calc = F.try_divide(a.cast("double"), b.cast("double")) * 100
    bad = measures.withColumns({"deaths": a, "n": b, "stated": p, "calc": calc}).where(F.abs(F.col("calc") - F.col("stated")) > 1.0)
    said = F.concat(F.col("deaths").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" ("), F.format_string("%.1f", F.floor(F.col("calc") * 10 + 0.5) / 10), F.lit("%)"))
    return bad.select("study_id", F.lit(field).alias("field"), F.lit("CRITICAL").alias("severity"), "deaths", "n", "stated", said.alias("suggested"))


def anchoring(fields: DataFrame, least: int = 10, allowed: int = 2) -> DataFrame:
    """(study_id, n_missing, anchored): values without a quote of at least `least` characters. fields: (study_id, field, value, source_text)."""
    bare = F.col("value").isNotNull() & (F.length(F.coalesce("source_text", F.lit(""))) < least)
    return fields.groupBy("study_id").agg(F.count_if(bare).alias("n_missing")).withColumn("anchored", F.col("n_missing") <= allowed)


def hallucinations(fields: DataFrame, documents: DataFrame, prefix: int = 30) -> DataFrame:
    """(study_id, field, severity, evidence): numbers of a value that its quote lacks (CRITICAL, one row each), and quotes of more than 20 characters whose beginning the document lacks (WARNING).

    fields: (study_id, doc_id, field, value, source_text). documents: (doc_id, text).
    """
    q = F.col("source_text")
    lost = F.filter(tx.numbers(F.col("value")), lambda n: ~F.contains(q, n))
    wrong = fields.where(F.coalesce(q, F.lit("")) != "").select("study_id", "field", F.lit("CRITICAL").alias("severity"), F.explode(lost).alias("evidence"))
    quoted = fields.where((F.length(q) > 20) & (F.size(tx.numbers(F.col("value"))) > 0)).join(documents.select("doc_id", "text"), "doc_id")
    snippet = F.left(q, F.lit(prefix))
    gone = quoted.where(~F.contains(F.col("text"), snippet)).select("study_id", "field", F.lit("WARNING").alias("severity"), snippet.alias("evidence"))
    return wrong.unionByName(gone)


def source_check(fields: DataFrame, documents: DataFrame, prefix: int = 30) -> DataFrame:
    """(study_id, field, severity): quotes under 10 characters (WARNING), and quotes whose beginning the document lacks (CRITICAL)."""
    q = F.coalesce("source_text", F.lit(""))
    j = fields.where(F.col("value").isNotNull()).join(documents.select("doc_id", "text"), "doc_id", "left")
    sev = F.when(F.length(q) < 10, "WARNING").when(~F.contains(F.coalesce("text", F.lit("")), F.left(q, F.lit(prefix))), "CRITICAL")
    return j.withColumn("severity", sev).where(F.col("severity").isNotNull()).select("study_id", "field", "severity")


def nos(selection: Column, comparability: Column, outcome: Column, total: Column) -> dict[str, Column]:
    """Consistency of a quality scale: range_valid, sum_matches, expected_total, score (half a point each). Null scores count as 0."""
    s, c, o, t = (F.coalesce(x, F.lit(0)) for x in (selection, comparability, outcome, total))
    ok = s.between(0, 4) & c.between(0, 2) & o.between(0, 3) & t.between(0, 9)
    same = t == s + c + o
    return {"range_valid": ok, "sum_matches": same, "expected_total": s + c + o, "score": F.when(ok, 0.5).otherwise(0.0) + F.when(same, 0.5).otherwise(0.0)}


def nos_detailed(selection: Column, comparability: Column, outcome: Column, total: Column, items_match: Column) -> Column:
    """Score with items: .33 for ranges, .34 for the sum, .33 for items that add up (null: nothing to compare, counts as right)."""
    n = nos(selection, comparability, outcome, total)
    return F.when(n["range_valid"], 0.33).otherwise(0.0) + F.when(n["sum_matches"], 0.34).otherwise(0.0) + F.when(F.coalesce(items_match, F.lit(True)), 0.33).otherwise(0.0)


def nos_loose(selection: Column, comparability: Column, outcome: Column, total: Column) -> Column:
    """Third variant: domains in range and the total within .01 of their sum; the total's own range isn't looked at."""
    s, c, o, t = (F.coalesce(x, F.lit(0)) for x in (selection, comparability, outcome, total))
    return s.between(0, 4) & c.between(0, 2) & o.between(0, 3) & (F.abs(t - (s + c + o)) < 0.01)


def verdict(issues: DataFrame, anchored: DataFrame, critics: DataFrame) -> DataFrame:
    """(study_id, n_critical, n_warning, confidence, passed).

    critics: (study_id, confidence), one row per model-backed critic, 0 where it failed. confidence: mean of those above 0 (.5 if none), less .2 per critical
    issue, .05 per warning and .1 if unanchored, within 0 and 1. passed: no critical issue, and anchored.
    """
    per = issues.groupBy("study_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.count_if(F.col("severity") == "WARNING").alias("n_warning"))
    mean = critics.groupBy("study_id").agg(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.5)).alias("mean"))
    j = mean.join(per, "study_id", "left").join(anchored.select("study_id", "anchored"), "study_id", "left").fillna(0, ["n_critical", "n_warning"]).fillna(True, ["anchored"])
    raw = F.col("mean") - 0.2 * F.col("n_critical") - 0.05 * F.col("n_warning") - F.when(F.col("anchored"), 0.0).otherwise(0.1)
    return j.select("study_id", "n_critical", "n_warning", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("confidence"), ((F.col("n_critical") == 0) & F.col("anchored")).alias("passed"))


def corrections(issues: DataFrame) -> DataFrame:
    """(study_id, corrections map<string, string>): suggestions of critical issues, the last per field. issues: with field, severity, suggested, seq."""
    last = issues.where("severity = 'CRITICAL' AND suggested IS NOT NULL").groupBy("study_id", "field").agg(F.max_by("suggested", "seq").alias("v"))
    return last.groupBy("study_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "v")))).alias("corrections"))


def decide(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Human decisions joined to each field's first issue: (study_id, field, action, value); modify has the reviewer's value, accept the suggestion, reject none."""
    first = issues.groupBy("study_id", "field").agg(F.min_by("suggested", "seq").alias("suggested"))
    value = F.when(F.col("action") == "modify", F.col("new_value")).when(F.col("action") == "accept", F.col("suggested"))
    return decisions.join(first, ["study_id", "field"]).select("study_id", "field", "action", value.alias("value"))


def union(*issues: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), issues)


def quick(studies: DataFrame, layer1: DataFrame, layer3: DataFrame) -> DataFrame:
    """Gate for live checks: (study_id, passed, errors, warnings). layer1 and layer3: issues (study_id, severity, message). passed: no critical issue of layer 1; errors are
    its critical messages, warnings those of layer 3, both in order."""
    errors = layer1.where("severity = 'CRITICAL'").groupBy("study_id").agg(F.sort_array(F.collect_list("message")).alias("errors"))
    warnings = layer3.where("severity = 'WARNING'").groupBy("study_id").agg(F.sort_array(F.collect_list("message")).alias("warnings"))
    none = F.array().cast("array<string>")
    j = studies.select("study_id").join(errors, "study_id", "left").join(warnings, "study_id", "left")
    return j.select("study_id", F.col("errors").isNull().alias("passed"), F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings"))


def critique(issues: DataFrame, anchored: DataFrame, critics: DataFrame, modes: DataFrame) -> DataFrame:
    """The whole verdict with its mode: (study_id, mode, n_critical, n_warning, confidence, passed, corrections map or null).

    issues: with field, severity, suggested, seq. modes: (study_id, mode AUTO, REVIEW or MANUAL, approved by a reviewer, may be null). A reviewer's approval passes a record in REVIEW
    mode. Corrections, the suggestions of critical issues, come with AUTO mode and with approval.
    """
    v = verdict(issues, anchored, critics).join(modes, "study_id").join(corrections(issues), "study_id", "left")
    approved = (F.col("mode") == "REVIEW") & F.coalesce("approved", F.lit(False))
    given = F.when((F.col("mode") == "AUTO") | approved, F.col("corrections"))
    return v.select("study_id", "mode", "n_critical", "n_warning", "confidence", (F.col("passed") | approved).alias("passed"), given.alias("corrections"))


def gate(candidates: DataFrame, existing: DataFrame, matches: DataFrame) -> DataFrame:
    """What happens to records to be saved: (study_id, status). candidates: (study_id, passed). matches: (study_id, confidence), what a duplicate check found.

    rejected: the critique failed; saved: no record exists yet or no match was found, or only a Low one; flagged: a Medium match; duplicate: a High one.
    """
    rank = F.expr("CASE confidence WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END")
    best = matches.groupBy("study_id").agg(F.max(rank).alias("rank"))
    # one row, whatever exists: nothing is run while the plan is made
    some = existing.select(F.lit(True).alias("some")).limit(1).groupBy().agg(F.coalesce(F.first("some"), F.lit(False)).alias("some")).withColumn("one", F.lit(1))
    j = candidates.join(best, "study_id", "left").withColumn("one", F.lit(1)).join(F.broadcast(some), "one")
    rank = F.when(F.col("some"), F.coalesce("rank", F.lit(0))).otherwise(0)
    return j.select("study_id", F.when(~F.col("passed"), "rejected").when(rank == 2, "duplicate").when(rank == 1, "flagged").otherwise("saved").alias("status"))


def findings(issues: DataFrame, critic: str | None = None, severity: str | None = None) -> DataFrame:
    """Issues of one critic, one severity, both or all."""
    out = issues if critic is None else issues.where(F.col("critic") == critic)
    return out if severity is None else out.where(F.col("severity") == severity)
