"""Queries over study records: critique with its modes, reports, records by path, rendering. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, records, rules, spans
from . import relations as rel
from .queries import _COMPLETE, _FIELDS, _PER, _RANGE, _STUDIES, _issues_sql, query
from .relations import table

# --- critique ------------------------------------------------------------------

_ARMS = rules.sum_rules("n_patients", ("arm_a", "arm_b"))
_FLOW = rules.flow_rules()


@query(f"{_STUDIES} {_issues_sql(rules.sample_rules())}")
def c1_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(rel.studies(spark, sf_dir), rules.sample_rules())


@query(f"""{_STUDIES}, m AS (SELECT study_id, TRY_CAST(nullif(regexp_extract(mrs, '(\\d+)\\s*/\\s*(\\d+)', 1), '') AS BIGINT) AS deaths, TRY_CAST(nullif(regexp_extract(mrs, '(\\d+)\\s*/\\s*(\\d+)', 2), '') AS BIGINT) AS n, TRY_CAST(nullif(regexp_extract(mrs, '(\\d+\\.?\\d*)\\s*%', 1), '') AS DOUBLE) AS p, TRY_CAST(nullif(regexp_extract(mrs, '^\\s*(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS l FROM studies)
SELECT study_id, 'outcomes.mRS_favorable' AS field, deaths, n, coalesce(p, l) AS stated, concat(deaths, '/', n, ' (', printf('%.1f', floor(CAST(deaths AS DOUBLE) / n * 1000 + 0.5) / 10), '%)') AS suggested FROM m WHERE abs(CAST(deaths AS DOUBLE) / n * 100 - coalesce(p, l)) > 1.0""")
def c1_mrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.arithmetic(rel.studies(spark, sf_dir), "mrs", "outcomes.mRS_favorable").drop("severity")


@query(f"{_STUDIES} {_issues_sql(_ARMS)}")
def l14_group_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(rel.studies(spark, sf_dir), _ARMS)


@query(f"{_STUDIES} {_issues_sql(_FLOW)}")
def l16_patient_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(rel.studies(spark, sf_dir), _FLOW)


_LAYER1 = _RANGE + _COMPLETE + rules.sample_rules()
_LAYER3 = "SELECT study_id, CASE WHEN length(coalesce(source_text, '')) < 10 THEN 'WARNING' ELSE 'INFO' END AS severity, concat('no quote: ', field) AS message FROM extracted WHERE value IS NOT NULL"


def _layer3(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.length(F.coalesce("source_text", F.lit(""))) < 10
    return rel.extracted(spark, sf_dir).where("value IS NOT NULL").select("study_id", F.when(short, "WARNING").otherwise("INFO").alias("severity"), F.concat(F.lit("no quote: "), F.col("field")).alias("message"))


@query(f"""{_FIELDS}, i AS ({_issues_sql(_LAYER1)}), e AS (SELECT study_id, list_sort(list(message)) AS errors FROM i WHERE severity = 'CRITICAL' GROUP BY study_id), w AS (SELECT study_id, list_sort(list(message)) AS warnings FROM ({_LAYER3}) x WHERE severity = 'WARNING' GROUP BY study_id)
SELECT s.study_id, errors IS NULL AS passed, coalesce(errors, []) AS errors, coalesce(warnings, []) AS warnings FROM studies s LEFT JOIN e ON e.study_id = s.study_id LEFT JOIN w ON w.study_id = s.study_id""")
def c9_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    return rules.quick(s, rules.apply_rules(s, _LAYER1), _layer3(spark, sf_dir))


_MODES = "SELECT study_id, CASE study_id % 3 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'REVIEW' ELSE 'MANUAL' END AS mode, CASE study_id % 4 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS approved FROM studies"


@query(f"""{_FIELDS}, raw AS ({_issues_sql(_LAYER1)}), i AS (SELECT *, CASE WHEN field LIKE 'quality%' THEN concat('fix ', message) END AS suggested FROM raw), anch AS (SELECT study_id, count(*) FILTER (value IS NOT NULL AND length(coalesce(source_text, '')) < 10) <= 2 AS anchored FROM extracted GROUP BY study_id),
p AS (SELECT study_id, count(*) FILTER (severity = 'CRITICAL') AS nc, count(*) FILTER (severity = 'WARNING') AS nw FROM i GROUP BY study_id), last AS (SELECT study_id, field, max(suggested) AS v FROM i WHERE severity = 'CRITICAL' AND suggested IS NOT NULL GROUP BY study_id, field),
c AS (SELECT study_id, string_agg(concat(field, '=', v), '; ' ORDER BY field) AS corrections FROM last GROUP BY study_id), m AS ({_MODES})
SELECT m.study_id, mode, coalesce(nc, 0) AS n_critical, coalesce(nw, 0) AS n_warning, round(greatest(0, least(1, 0.9 - 0.2 * coalesce(nc, 0) - 0.05 * coalesce(nw, 0) - CASE WHEN coalesce(anchored, true) THEN 0 ELSE 0.1 END)), 6)::DOUBLE AS confidence,
(coalesce(nc, 0) = 0 AND coalesce(anchored, true)) OR (mode = 'REVIEW' AND coalesce(approved, false)) AS passed, CASE WHEN mode = 'AUTO' OR (mode = 'REVIEW' AND coalesce(approved, false)) THEN corrections END AS corrections
FROM m LEFT JOIN p USING (study_id) LEFT JOIN anch USING (study_id) LEFT JOIN c USING (study_id)""")
def c8_critique(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    issues = rules.apply_rules(s, _LAYER1).withColumn("suggested", F.when(F.col("field").startswith("quality"), F.concat(F.lit("fix "), F.col("message")))).withColumn("seq", F.col("message"))
    critics = s.selectExpr("study_id", "CAST(0.9 AS DOUBLE) AS confidence")
    modes = s.selectExpr("study_id", "CASE study_id % 3 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'REVIEW' ELSE 'MANUAL' END AS mode", "CASE study_id % 4 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS approved")
    out = rules.critique(issues, rules.anchoring(rel.extracted(spark, sf_dir)), critics, modes)
    said = F.array_join(F.transform(F.sort_array(F.map_entries("corrections")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return out.withColumns({"confidence": F.round("confidence", 6), "corrections": said})


@query(f"""{_STUDIES}, i AS ({_issues_sql(_LAYER1)}), bad AS (SELECT DISTINCT study_id FROM i WHERE severity = 'CRITICAL')
SELECT s.study_id, CASE WHEN b.study_id IS NOT NULL THEN 'rejected' WHEN is_duplicate AND dup_confidence = 'High' THEN 'duplicate' WHEN is_duplicate AND dup_confidence = 'Medium' THEN 'flagged' ELSE 'saved' END AS status FROM studies s LEFT JOIN bad b ON b.study_id = s.study_id""")
def c14_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    passed = rules.quick(s, rules.apply_rules(s, _LAYER1), _layer3(spark, sf_dir)).select("study_id", "passed")
    return rules.gate(passed, s, s.where("is_duplicate").select("study_id", F.col("dup_confidence").alias("confidence")))


@query(f"{_STUDIES}, i AS ({_issues_sql(_LAYER1)}) SELECT study_id, critic, field, severity, message FROM i WHERE critic = 'range' AND severity = 'WARNING'")
def p10_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(rules.apply_rules(rel.studies(spark, sf_dir), _LAYER1), "range", "WARNING")


# --- evaluation ------------------------------------------------------------------

_REPORT = f"""{_PER}, nosc AS (SELECT study_id, (selection BETWEEN 0 AND 4 AND comparability BETWEEN 0 AND 2 AND outcome BETWEEN 0 AND 3 AND total BETWEEN 0 AND 9 AND total = selection + comparability + outcome)::INT AS nos FROM studies),
a AS (SELECT count(*) AS n_studies, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(grounding_rate) AS grounding_rate, avg(nos) AS nos_consistency, avg(critical_accuracy) AS critical_accuracy FROM per JOIN nosc USING (study_id)),
h AS (SELECT count(*) FILTER (error_type = 'missing') AS missing, count(*) FILTER (error_type = 'hallucination') AS hallucination, count(*) FILTER (error_type = 'inaccurate') AS inaccurate, count(*) FILTER (error_type = 'partial') AS partial, count(*) FILTER (error_type = 'correct') AS correct FROM metrics)"""


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    metrics = evaluation.field_metrics(rel.extracted(spark, sf_dir), rel.truth(spark, sf_dir))
    n = rules.nos(*[F.col(c) for c in ("selection", "comparability", "outcome", "total")])
    consistent = rel.studies(spark, sf_dir).select("study_id", (n["range_valid"] & n["sum_matches"]).alias("nos_consistency"))
    return metrics, evaluation.study_metrics(metrics), consistent


@query(f"{_REPORT} SELECT n_studies, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in evaluation.MEANS) + ", " + ", ".join(evaluation.ERRORS) + ", list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{text}' END" for text, when in evaluation.ADVICE) + "], lambda x: x IS NOT NULL) AS recommendations FROM a, h")
def a10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics, per, consistent = _measured(spark, sf_dir)
    return evaluation.report(per, consistent, metrics).withColumns({c: F.round(c, 6) for c in evaluation.MEANS})


@query(f"{_PER} SELECT difficulty AS stratum, count(*) AS n, round(avg(f1), 6)::DOUBLE AS avg_f1 FROM per JOIN studies USING (study_id) GROUP BY difficulty")
def a10_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, per, _ = _measured(spark, sf_dir)
    return evaluation.by_stratum(per, rel.studies(spark, sf_dir), "difficulty").withColumn("avg_f1", F.round("avg_f1", 6))


_SCORES = "study_id, (study_id % 11) / 10.0::DOUBLE AS faithfulness, (study_id % 7) / 6.0::DOUBLE AS relevancy, (study_id % 5) / 4.0::DOUBLE AS hallucination, CASE WHEN study_id % 9 = 0 THEN NULL ELSE (study_id % 3) / 2.0::DOUBLE END AS clinical"


@query(f"""{_STUDIES}, s AS (SELECT {_SCORES} FROM studies), t AS (SELECT *, 0.3 * faithfulness + 0.15 * relevancy + 0.3 * hallucination + 0.25 * coalesce(clinical, 0) AS c FROM s)
SELECT study_id, round(c, 6)::DOUBLE AS composite, round(c, 9) >= 0.7 AS passes, array_to_string(list_filter([CASE WHEN faithfulness < 0.7 THEN 'faithfulness' END, CASE WHEN relevancy < 0.7 THEN 'relevancy' END, CASE WHEN hallucination < 0.7 THEN 'hallucination' END, CASE WHEN coalesce(clinical, 0) < 0.7 THEN 'clinical' END], lambda x: x IS NOT NULL), ',') AS weak FROM t""")
def a17_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "CAST(study_id % {0} AS DOUBLE) / {1}"
    scores = rel.studies(spark, sf_dir).selectExpr("study_id", f"{c.format(11, 10)} AS faithfulness", f"{c.format(7, 6)} AS relevancy", f"{c.format(5, 4)} AS hallucination", f"CASE WHEN study_id % 9 <> 0 THEN {c.format(3, 2)} END AS clinical")
    return evaluation.composite(scores).withColumns({"composite": F.round("composite", 6), "weak": F.array_join("weak", ",")})


@query(f"{_FIELDS} SELECT study_id, string_split(field, '.')[1] AS section, CAST(floor(100 * avg((coalesce(value, '') <> '')::INT) + 0.5) AS DOUBLE) AS percent FROM extracted GROUP BY study_id, section")
def a18_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.section_completion(rel.extracted(spark, sf_dir)).withColumn("percent", F.col("percent").cast("double"))


@query(f"{_STUDIES} SELECT study_id, field, NULL::VARCHAR AS truth, sha256(concat(study_id, ':', field)) AS checksum FROM studies, (SELECT unnest([{', '.join(repr(x) for x in rel.FIELDS)}]) AS field) x")
def c13_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.truth_template(rel.studies(spark, sf_dir), rel.FIELDS)


# --- records ---------------------------------------------------------------------


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.studies(spark, sf_dir).selectExpr("study_id", "named_struct('hospital', hospital, 'year', publication_year) AS metadata", "named_struct('age', named_struct('mean', age_mean), 'n', n_patients, 'arms', array(arm_a, arm_b)) AS population")


@query(f"""{_STUDIES}, l AS (SELECT study_id, unnest(['metadata.hospital', 'metadata.year', 'population.age.mean', 'population.n', 'population.arms']) AS path, unnest([hospital, CAST(publication_year AS VARCHAR), CAST(age_mean AS VARCHAR), CAST(n_patients AS VARCHAR), concat('[', coalesce(CAST(arm_a AS VARCHAR), 'null'), ',', arm_b, ']')]) AS value FROM studies)
SELECT * FROM l WHERE value IS NOT NULL""")
def p6_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.long_form(_nested(spark, sf_dir))


@query(f"{_STUDIES} SELECT study_id, CASE WHEN study_id % 2 = 0 THEN 99 ELSE age_mean END AS mean, n_patients AS n FROM studies")
def p5_set_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("study_id") % 2 == 0, F.lit(99)).otherwise(records.get_path(F.col("population"), "age.mean"))
    changed = _nested(spark, sf_dir).select("study_id", records.set_path(F.col("population"), "age.mean", new).alias("p"))
    return changed.select("study_id", F.col("p.age.mean").alias("mean"), F.col("p.n").alias("n"))


@query(f"""{_FIELDS}, f AS (SELECT study_id, field AS path, value, study_id % 2 = 0 AS ai FROM extracted), c AS (SELECT study_id, 'population.sampleSize' AS path, 'by hand' AS value, FALSE AS ai FROM studies WHERE study_id % 3 = 0 UNION ALL SELECT study_id, 'notes', 'model', TRUE FROM studies WHERE study_id % 5 = 0),
n AS (SELECT * FROM c UNION ALL SELECT f.* FROM f ANTI JOIN c ON f.study_id = c.study_id AND f.path = c.path) SELECT study_id, count(*) AS n_fields, coalesce(string_agg(path, ',' ORDER BY path) FILTER (ai), '') AS ai_fields, max(value) FILTER (path = 'population.sampleSize') AS size FROM n GROUP BY study_id""")
def p5_update_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    fields = rel.extracted(spark, sf_dir).selectExpr("study_id", "field AS path", "value", "study_id % 2 = 0 AS ai")
    one = s.where("study_id % 3 = 0").selectExpr("study_id", "'population.sampleSize' AS path", "inline(array(named_struct('value', 'first', 'ai', true, 'seq', 1), named_struct('value', 'by hand', 'ai', false, 'seq', 2)))")
    two = s.where("study_id % 5 = 0").selectExpr("study_id", "'notes' AS path", "'model' AS value", "true AS ai", "1 AS seq")
    out = records.set_field(fields, one.unionByName(two))
    per = out.groupBy("study_id").agg(F.count("*").alias("n_fields"), F.max(F.when(F.col("path") == "population.sampleSize", F.col("value"))).alias("size"))
    return per.join(records.provenance(out).select("study_id", F.array_join("ai_fields", ",").alias("ai_fields")), "study_id")


@query(f"{_STUDIES} SELECT study_id, coalesce(first_author, '') AS first_author, coalesce(technique, '') AS technique, coalesce(n_patients, 0) AS n_patients, coalesce(age_mean, 0) AS age_mean FROM studies")
def p1_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.plain(rel.studies(spark, sf_dir), ["first_author", "technique"], ["n_patients", "age_mean"])


@query(f"{_STUDIES} SELECT study_id, total, {len(rel.STUDY)} AS n_available FROM studies")
def p14_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.subset(rel.studies(spark, sf_dir), ["total", "no such column"])
    return out.select("study_id", "total", F.size("available").alias("n_available"))


@query("SELECT conv_id, turn, role FROM conversations")
def p15_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.without(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["text"])


@query("SELECT p_partkey AS id FROM part WHERE p_size * 10 >= 200 AND p_partkey % 400 >= 200")
def p12_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.large_figures(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size * 10 AS width", "p_partkey % 400 AS height"), 200).select("id")


@query("SELECT p_partkey AS id, CAST(p_size % 4 + p_partkey % 3 AS INT) AS n FROM part")
def a24_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr("map('a', array_repeat('x', CAST(p_size % 4 AS INT)), 'b', array_repeat('y', CAST(p_partkey % 3 AS INT)))")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), records.highlight_count(m).cast("int").alias("n"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN concat('Table ', p_partkey) ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'given' ELSE p_brand END AS head, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n_rows, CASE p_partkey % 4 WHEN 0 THEN 'bar-chart' ELSE 'other' END AS kind FROM part""")
def f35_f36_given_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, head = F.expr("array(array(p_brand, p_type), array(p_name, p_type))"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN array('given', 'names') END")
    t = records.given_table(data, head, F.expr("CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END"), F.col("p_partkey"))
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'chart' WHEN 1 THEN 'diagram' WHEN 2 THEN 'photo' END")
    one = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.alias("t"), records.image_kind(kind).alias("kind"))
    return one.select("id", F.col("t.title").alias("title"), F.get("t.headers", F.lit(0)).alias("head"), F.size("t.rows").alias("n_rows"), "kind")


@query("SELECT p_partkey AS id, [p_size * 1.0, p_partkey - 12.0, p_size + 30.0, p_partkey * 1.0]::DOUBLE[] AS rect FROM part")
def f39_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = records.annotation(*[F.expr(f"CAST({x} AS DOUBLE)") for x in ("p_size", "p_partkey", "30", "12")])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), a["rect"].alias("rect"))


# --- rendering ---------------------------------------------------------------------

_LINE = "concat('- **Age (Mean)**: ', coalesce(CAST(age_mean AS VARCHAR), 'Not Found'), CASE WHEN study_id % 4 <> 1 THEN concat(chr(10), '  > \"', source_text, '\"', CASE WHEN study_id % 6 <> 0 THEN concat(' (p.', study_id % 6, ')') ELSE '' END) ELSE '' END, chr(10))"


@query(f"{_STUDIES} SELECT study_id, concat('# Data Verification Report', chr(10), '## ', first_author, ' et al. (', publication_year, ')', chr(10), '### Population (n=', coalesce(CAST(n_patients AS VARCHAR), 'null'), ')', chr(10), {_LINE}) AS report FROM studies")
def f41_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = records.verification("Age (Mean)", F.col("age_mean"), F.expr("CASE WHEN study_id % 4 <> 1 THEN source_text END"), F.expr("study_id % 6"))
    head = F.concat(F.lit("# Data Verification Report\n## "), F.col("first_author"), F.lit(" et al. ("), F.col("publication_year").cast("string"), F.lit(")\n### Population (n="), F.coalesce(F.col("n_patients").cast("string"), F.lit("null")), F.lit(")\n"))
    return rel.studies(spark, sf_dir).select("study_id", F.concat(head, line).alias("report"))


@query("""WITH c AS (SELECT l_orderkey AS response_id, l_linenumber AS id, min(l_linestatus) AS m, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber),
l AS (SELECT response_id, id, concat('[', id, '] ', CASE WHEN id % 3 = 0 THEN CASE WHEN f = 'N' THEN 'Source' ELSE f END ELSE concat('Page ', id * 2, CASE WHEN f = 'N' THEN '' ELSE concat(', ', f) END) END, ': "', m, '"') AS line FROM c) SELECT response_id, concat(chr(10), chr(10), 'Sources:', chr(10), string_agg(line, chr(10) ORDER BY id)) AS shown FROM l GROUP BY response_id""")
def f41_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("m"), F.min("l_returnflag").alias("f"))
    return records.display(li.selectExpr("l_orderkey AS response_id", "l_linenumber AS id", "CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber * 2 END AS page", "nullif(f, 'N') AS section", "m AS source_text"))


@query(f"""{_FIELDS}, r AS (SELECT study_id, field, concat('<tr><td>', field, '</td><td>', coalesce(replace(replace(value, '&', '&amp;'), '<', '&lt;'), ''), '</td><td>', coalesce(source_text, ''), '</td></tr>') AS row FROM extracted)
SELECT study_id, concat('<table>', chr(10), string_agg(row, chr(10) ORDER BY field, row), chr(10), '</table>') AS html FROM r GROUP BY study_id""")
def snk8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.html_rows(rel.extracted(spark, sf_dir).selectExpr("study_id", "field AS path", "value", "source_text AS source"))


_BOXES = "SELECT l_orderkey AS doc_id, l_linenumber AS pos, CAST(min(l_partkey) % 40 AS DOUBLE) AS x0, CAST(l_linenumber * 3 AS DOUBLE) AS y0 FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(f"""WITH b AS ({_BOXES}), n AS (SELECT doc_id, pos, list(struct_pack(x0 := x0, y0 := y0)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM b)
SELECT doc_id, pos::INT AS pos, len(w)::INT AS n_words, list_min(list_transform(w, lambda x: x.x0)) AS left, list_max(list_transform(w, lambda x: x.x0)) + 8 AS right FROM n""")
def w6_next_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    boxes = li.selectExpr("l_orderkey AS doc_id", "l_linenumber AS pos", "CAST(p % 40 AS DOUBLE) AS x0", "CAST(l_linenumber * 3 AS DOUBLE) AS y0").selectExpr("*", "x0 + 8 AS x1", "y0 + 2 AS y1")
    w = spans.next_boxes(boxes, 3)
    left, right = F.array_min(F.transform("boxes", lambda b: b["x0"])), F.array_max(F.transform("boxes", lambda b: b["x1"]))
    return w.select("doc_id", F.col("pos").cast("int").alias("pos"), F.size("boxes").alias("n_words"), left.alias("left"), right.alias("right"))


@query(f"""WITH b AS ({_BOXES}), l AS (SELECT *, lag(x0) OVER w AS px, lag(y0) OVER w AS py FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY x0, y0, pos)) SELECT doc_id, CAST(sum(CASE WHEN px IS NOT NULL AND abs(py - y0) < 1000 AND x0 - (px + 8) < 10 THEN 0 ELSE 1 END) AS INT) AS n_merged FROM l GROUP BY doc_id""")
def a15_merge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    boxes = li.selectExpr("l_orderkey AS doc_id", "named_struct('x0', CAST(p % 40 AS DOUBLE), 'y0', CAST(l_linenumber * 3 AS DOUBLE), 'x1', CAST(p % 40 + 8 AS DOUBLE), 'y1', CAST(l_linenumber * 3 + 2 AS DOUBLE)) AS b")
    merged = boxes.groupBy("doc_id").agg(spans.merge_boxes(F.collect_list("b"), line=1000).alias("m"))
    return merged.select("doc_id", F.size("m").alias("n_merged"))
