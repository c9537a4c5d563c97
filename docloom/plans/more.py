"""Further queries: matching, sources, sessions, providers, reports. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, export, matching, providers, retrieval, rules, spans
from ..sources import files, sessions
from ..streaming import quiet
from . import relations as rel
from .queries import _FIELDS, _LINES, _MD, _SPANS, _STUDIES, docs, query
from .relations import table

# --- matching --------------------------------------------------------------------

#: Quotes from all over the text: as they stand, with other words behind, from its end, and from nowhere.
_QUOTED = {
    1: "substring(text, CAST(30 + (doc_id * 131) % greatest(length(text) - 90, 1) AS INT), 60)",
    2: "concat(substring(text, CAST(10 + (doc_id * 977) % greatest(length(text) - 50, 1) AS INT), 40), ' zzz qqq')",
    3: "'nothing like this there'",
    4: "substring(text, CAST(greatest(length(text) - 70, 1) AS INT), 60)",
}
_QUOTES = f"SELECT * FROM ({' UNION ALL '.join(f'SELECT doc_id, {i} AS quote_id, {q} AS quote FROM documents WHERE text IS NOT NULL' for i, q in _QUOTED.items())}) x WHERE regexp_matches(quote, '[A-Za-z0-9_]')"
_BLOCKS = "blocks AS (SELECT doc_id, CAST(i AS INT) AS block, substring(text, CAST(i * 400 + 1 AS INT), 500) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 400.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0))"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\s+', ' ', 'g'), '[^A-Za-z0-9_\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g')"
_FUZZY = f"""quotes AS ({_QUOTES}), {_BLOCKS}, q AS (SELECT *, list_distinct(list_filter(regexp_split_to_array({_PLAIN.format("quote")}, '\\s+'), lambda x: x <> '')) AS w FROM quotes),
d AS (SELECT q.doc_id, quote_id, block, 1 - len(list_intersect(w, regexp_split_to_array({_PLAIN.format("text")}, '\\s+'))) / CAST(len(w) AS DOUBLE) AS distance FROM q JOIN blocks b ON b.doc_id = q.doc_id WHERE len(w) > 0)"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text")
    # a quote without a word says nothing
    return d.select("doc_id", F.inline(F.array(*[F.struct(F.lit(i).alias("quote_id"), F.expr(q).alias("quote")) for i, q in _QUOTED.items()]))).where(F.col("quote").rlike("[A-Za-z0-9_]"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("length(text) > 0").select("doc_id", "text")
    n = F.ceil(F.length("text") / 400).cast("int")
    return d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("block")).select("doc_id", "block", F.substring(F.col("text"), F.col("block") * 400 + 1, F.lit(500)).alias("text"))


@query(f"WITH {_FUZZY}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, quote_id ORDER BY distance, block) AS rank FROM d WHERE distance <= 0.4) SELECT doc_id, quote_id, block, round(distance, 9) AS distance, rank::INT AS rank FROM r WHERE rank <= 2")
def j9_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.fuzzy(_quotes(spark, sf_dir), _blocks(spark, sf_dir), 0.4, 2).withColumn("distance", F.round("distance", 9))


@query(f"""WITH {_FUZZY}, e AS (SELECT q.doc_id, quote_id, min(block) AS e FROM quotes q JOIN blocks b ON b.doc_id = q.doc_id WHERE contains(lower(text), lower(quote)) GROUP BY q.doc_id, quote_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, quote_id ORDER BY distance, block) AS rank FROM d WHERE distance < 0.3)
SELECT q.doc_id, q.quote_id, CASE WHEN e IS NOT NULL THEN 'exact' WHEN block IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method, coalesce(e, block) AS block, round(CASE WHEN e IS NOT NULL THEN 1.0 ELSE coalesce(1 - distance, 0.0) END::DOUBLE, 9) AS confidence
FROM quotes q LEFT JOIN e ON e.doc_id = q.doc_id AND e.quote_id = q.quote_id LEFT JOIN (SELECT * FROM r WHERE rank = 1) r ON r.doc_id = q.doc_id AND r.quote_id = q.quote_id""")
def j9_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.smart(_quotes(spark, sf_dir), _blocks(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH quotes AS ({_QUOTES}), {_BLOCKS}, q AS (SELECT *, list_filter(string_split({_PLAIN.format("quote")}, ' '), lambda x: x <> '') AS w FROM quotes),
j AS (SELECT q.doc_id, quote_id, block, len(list_filter(w, lambda x: contains({_PLAIN.format("text")}, x))) / CAST(len(w) AS DOUBLE) AS ratio FROM q JOIN blocks b ON b.doc_id = q.doc_id)
SELECT doc_id, quote_id, min(block) AS block, round(min_by(ratio, block), 9) AS ratio FROM j WHERE ratio >= 0.7 GROUP BY doc_id, quote_id""")
def j10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, b = _quotes(spark, sf_dir).withColumn("page", F.lit(1)), _blocks(spark, sf_dir).withColumn("page", F.lit(1))
    return spans.containment(q, b).withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH {_SPANS}, v AS (SELECT doc_id, pos, list(lower(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM spans),
n AS (SELECT doc_id, pos, list_min(list_filter(list_transform(range(1, len(w) + 1), lambda k: CASE WHEN contains(array_to_string(w[1:k], ' '), 'the er') THEN k END), lambda x: x IS NOT NULL)) AS n FROM v) SELECT doc_id, pos, n::INT AS n_words FROM n WHERE n IS NOT NULL""")
def j12_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.in_windows(spans.word_spans(docs(spark, sf_dir).select("doc_id", "text")), "The er", 5)


def _slices(d: DataFrame, step: int, width: int) -> DataFrame:
    """(doc_id, i, text): slices of `width` characters at every `step` characters up to the end of each text."""
    n = F.ceil(F.length("text") / step).cast("int")
    d = d.where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return d.select("doc_id", "i", F.substring(F.col("text"), F.col("i") * step + 1, F.lit(width)).alias("text"))


_SLICES = "(SELECT doc_id, i::INT AS i, substring(text, CAST(i * {0} + 1 AS INT), {1}) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / {0}.0) AS BIGINT))) AS i FROM documents))"


@query(f"""WITH f AS (SELECT doc_id, unnest(['a', 'b']) AS field, unnest([substring(text, 3, 4), 'und']) AS value FROM documents), c AS {_SLICES.format(50, 60)}
SELECT f.doc_id, field, i AS cite_id FROM f JOIN c ON c.doc_id = f.doc_id WHERE contains(lower(text), lower(value))""")
def j14_link_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "text")
    f = d.select("doc_id", F.inline(F.array(F.struct(F.lit("a").alias("field"), F.substring("text", 3, 4).alias("value")), F.struct(F.lit("b").alias("field"), F.lit("und").alias("value")))))
    return matching.link_values(f, _slices(d, 50, 60).withColumnRenamed("i", "cite_id"))


_MARKED = "concat('**Sample Size**: ', CAST(c_custkey AS STRING), chr(10), 'note', chr(10), '**[Age]**:  ', c_mktsegment, ' ', chr(10), '**Sample Size**: ', CAST(c_custkey % 7 AS STRING))"


@query("SELECT c_custkey AS doc_id, 'sample_size' AS field, CAST(c_custkey % 7 AS STRING) AS value FROM customer UNION ALL SELECT c_custkey, 'age', c_mktsegment FROM customer")
def j14_marked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.marked_fields(table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{_MARKED} AS text"))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber), i AS (SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM u), c AS (SELECT l_orderkey AS doc_id, flag AS caption, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM u WHERE l_linenumber % 2 = 0)
SELECT i.doc_id, page, item, caption FROM i LEFT JOIN c ON c.doc_id = i.doc_id AND c.n = i.n""")
def j15_captions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    items = li.selectExpr("l_orderkey AS doc_id", "1 AS page", "l_linenumber AS item")
    return matching.captions_in_order(items, li.where("l_linenumber % 2 = 0").selectExpr("l_orderkey AS doc_id", "1 AS page", "l_linenumber AS pos", "flag AS caption"))


@query("SELECT c_custkey AS doc_id, 'Table 1' AS caption, CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 3 = 1 THEN 'Fig. 2 second' ELSE 'Figure 1. First' END AS figure FROM customer")
def j15_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr(_MD)
    figs = F.lit("x\nFigure 1. First\ny\nFig. 2 second\n")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), matching.table_caption(t, F.instr(t, "|")).alias("caption"), matching.figure_caption(figs, (F.col("c_custkey") % 3).cast("int")).alias("figure"))


@query(f"""WITH p AS (SELECT DISTINCT doc_id AS response_id, unnest(['the', 'und', 'THERE', 'nowhere']) AS phrase FROM documents), c AS {_SLICES.format(100, 100)}
SELECT response_id, phrase, min(i)::INT AS idx FROM p JOIN c ON doc_id = response_id WHERE contains(lower(text), lower(phrase)) GROUP BY response_id, phrase""")
def j21_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "text")
    p = d.select(F.col("doc_id").alias("response_id"), F.explode(F.array(*map(F.lit, ("the", "und", "THERE", "nowhere")))).alias("phrase"))
    return matching.supports(p, _slices(d, 100, 100).select(F.col("doc_id").alias("response_id"), F.col("i").alias("idx"), "text"))


@query(f"""WITH {_SPANS}, f AS (SELECT doc_id, page, pos, x, y, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, x, pos) > 5 THEN 1 ELSE 0 END AS f FROM spans), l AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, page ORDER BY y, x, pos ROWS UNBOUNDED PRECEDING) AS line FROM f)
SELECT doc_id, page, CAST(max(line) AS BIGINT) + 1 AS n_lines, count(*) AS n_words FROM l GROUP BY doc_id, page""")
def s5_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = matching.reading_order(spans.word_spans(docs(spark, sf_dir).select("doc_id", "text")))
    return o.groupBy("doc_id", "page").agg((F.max("line") + 1).alias("n_lines"), F.count("*").alias("n_words"))


@query()
def w5_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.text_blocks(spans.word_spans(docs(spark, sf_dir).select("doc_id", "text")))


@query("SELECT l_orderkey AS id, l_linenumber AS n, round(l_quantity * 1.5, 6) AS x, round((800 - l_tax * 100 - 12) * 1.5, 6) AS y, 90.0::DOUBLE AS width, 18.0::DOUBLE AS height FROM lineitem")
def f40_to_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = matching.to_canvas(F.col("l_quantity"), F.col("l_tax") * 100, F.lit(60.0), F.lit(12.0), F.lit(800.0), 1.5)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), c.alias("c")).select("id", "n", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), "c.width", "c.height")


@query("SELECT l_orderkey AS id, l_linenumber AS n, round(greatest(0, l_quantity * 2 - 20)::DOUBLE, 6) AS x0, 0.0::DOUBLE AS y0, round(least(1200, (l_quantity + 60) * 2 + 20)::DOUBLE, 6) AS x1, 60.0::DOUBLE AS y1 FROM lineitem")
def snk9_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = matching.crop(F.col("l_quantity"), F.lit(5.0), F.col("l_quantity") + 60, F.lit(20.0), 600, 800, 144)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), c.alias("c")).select("id", "n", F.round("c.x0", 6).alias("x0"), "c.y0", F.round("c.x1", 6).alias("x1"), "c.y1")


# --- sources and sessions -----------------------------------------------------------

@query("SELECT doc_id, i::INT - 1 AS page, p AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def src19_split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_pages(docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text")))


@query("WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text, count(*) AS n_pages FROM p WHERE i BETWEEN 1 AND 3 GROUP BY doc_id")
def src3_src4_join_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.join_pages(files.split_pages(docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))), 1, 3)


@query("WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) SELECT doc_id, string_agg(concat('--- Page ', i, ' ---', chr(10), p), chr(10) ORDER BY i) AS text FROM p GROUP BY doc_id")
def src9_marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.marked_pages(files.split_pages(docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))))


_XML = "concat('<pdf2xml><page width=\"600\" height=\"800\"><word xMin=\"1.5\" yMin=\"2\" xMax=\"', CAST(c_custkey AS STRING), '\" yMax=\"12\">', c_mktsegment, '</word></page><page width=\"1\" height=\"1\"></page><page width=\"600\" height=\"800\"><word xMin=\"0\" yMin=\"0\" xMax=\"5\" yMax=\"5\">b</word><word xMin=\"6\" yMin=\"0\" xMax=\"9\" yMax=\"5\">c</word></page></pdf2xml>')"


@query("""SELECT c_custkey AS doc_id, 1 AS page, c_mktsegment AS text, 1.5::DOUBLE AS x, (c_custkey - 1.5)::DOUBLE AS width FROM customer UNION ALL SELECT c_custkey, 3, 'b', 0, 5 FROM customer UNION ALL SELECT c_custkey, 3, 'c', 6, 3 FROM customer""")
def src15_layout_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.inline(files.layout_words(F.expr(_XML))))
    return w.select("doc_id", "page", "text", "x", "width")


@query("SELECT c_custkey AS doc_id, ['Name', 'N x'] AS headers, 2 AS n_rows, ['', CAST(c_custkey AS STRING)] AS first FROM customer")
def src13_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.expr("array(array(NULL, '  '), array(' Name', concat('N ', chr(10), ' x')), array(NULL, CAST(c_custkey AS STRING)), array('a', 'b'))")
    head, body = files.grid(rows)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), head.alias("headers"), F.size(body).alias("n_rows"), F.try_element_at(body, F.lit(1)).alias("first"))


@query("SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def j16_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").selectExpr("o_custkey AS name").distinct()
    return files.new_files(table(spark, sf_dir, "customer").selectExpr("c_custkey AS name"), known)


_TURNS = "SELECT CAST(conv_id AS STRING) AS session_id, CASE WHEN turn % 3 = 2 THEN 'side' ELSE 'main' END AS thread, turn, role, text AS content FROM conversations"


@query(f"WITH t AS ({_TURNS}) SELECT session_id, count(*) FILTER (thread = 'main') AS n_messages, count(DISTINCT thread) AS n_threads FROM t WHERE session_id NOT LIKE '%7' GROUP BY session_id")
def src7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS STRING) AS session_id", "CASE WHEN turn % 3 = 2 THEN 'side' ELSE 'main' END AS thread", "turn", "role", "text AS content")
    return sessions.overview(sessions.delete(t, t.where("session_id LIKE '%7'").select("session_id").distinct()))


# --- providers, triage, imaging -------------------------------------------------------

_REPORT = "concat('Patients with n = ', CAST(c_custkey % 90 AS STRING), ' cases, mean age ', CAST(c_custkey % 80 AS STRING), '.5 years. Mortality was ', CAST(c_custkey % 100 AS STRING), '%. Infarct volume was ', CAST(c_custkey % 40 AS STRING), ' ml on admission CT, ', CASE WHEN c_custkey % 2 = 0 THEN 'with' ELSE 'no' END, ' midline shift of ', CAST(c_custkey % 9 AS STRING), ' mm. We found less. This showed more. A limitation is size. Results suggest care')"


@query("SELECT c_custkey AS doc_id, 'population.sampleSize' AS field, CAST(c_custkey % 90 AS STRING) AS value FROM customer UNION ALL SELECT c_custkey, 'population.age.mean', concat(c_custkey % 80, '.5') FROM customer UNION ALL SELECT c_custkey, 'outcomes.mortality', concat(c_custkey % 100, '%') FROM customer")
def l1_l7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{_REPORT} AS text")
    return providers.extract_all(providers.Rules(), d).select("doc_id", "field", "value")


@query("SELECT c_custkey AS doc_id, (c_custkey % 40)::DOUBLE AS infarct_volume_ml, (c_custkey % 9)::DOUBLE AS midline_shift_mm, false AS hydrocephalus, 'baseline' AS imaging_timepoint, 'CT' AS imaging_modality, 0.8::DOUBLE AS confidence FROM customer")
def f31_imaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = providers.imaging(table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{_REPORT} AS text"))
    return i.select("doc_id", "infarct_volume_ml", "midline_shift_mm", "hydrocephalus", "imaging_timepoint", "imaging_modality", F.round("confidence", 6).alias("confidence"))


@query("SELECT c_custkey AS doc_id, 2 AS n_findings, 'A limitation is size' AS limitation, 'Results suggest care' AS implications FROM customer")
def w9_discussion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), providers.discussion(F.expr(_REPORT)).alias("d"))
    return d.select("doc_id", F.size("d.findings").alias("n_findings"), F.get("d.limitations", F.lit(0)).alias("limitation"), "d.implications")


_REC = "study_id, diagnosis, evd_used, study_id % 2 = 0 AS has_text, study_id % 3 = 0 AS has_outcomes, study_id % 5 = 0 AS has_comparator, true AS has_quality"


@query(f"""{_STUDIES}, r AS (SELECT {_REC} FROM studies) SELECT study_id, 2 + CASE WHEN has_outcomes THEN 2 ELSE 0 END + CASE WHEN has_text THEN 2 ELSE 0 END + 1 + CASE WHEN evd_used IS NOT NULL THEN 1 ELSE 0 END AS n_reviewers, CASE WHEN has_outcomes THEN 'scale_inversion' ELSE 'math_consistency' END AS first,
round((0.6 + CASE WHEN has_text THEN 0.15 ELSE 0 END + CASE WHEN has_comparator THEN 0.1 ELSE 0 END + CASE WHEN has_outcomes THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS quality FROM r""")
def p16_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rel.studies(spark, sf_dir).selectExpr(*[x.strip() for x in _REC.split(",")])
    return providers.triage(r).select("study_id", F.size("reviewers").alias("n_reviewers"), F.get("priority", F.lit(0)).alias("first"), F.round("quality", 6).alias("quality"))


@query("WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 20) AS l FROM documents) SELECT doc_id, i::INT AS number, l[i] AS raw_text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)")
def f25_fallback_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.fallback_references(docs(spark, sf_dir)).select("doc_id", "number", "raw_text")


@query("SELECT doc_id, CASE WHEN length(text) < 100 THEN 'scanned' WHEN NOT regexp_matches(text, '\\[(\\d+)\\]|(?i)age[^.\\d]{0,30}\\d|\\bn\\s*=\\s*\\d|\\b(19|20)\\d\\d\\b|mortality[^.\\d]{0,30}(\\d+\\.?\\d*\\s*%|\\d+\\s*/\\s*\\d+)') THEN 'empty' ELSE 'extracted' END AS status FROM documents")
def p11_c15_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "text")
    return providers.status(d, providers.extract_all(providers.Rules(), d))


@query("WITH s AS (SELECT CASE WHEN length(text) < 100 THEN 'scanned' WHEN length(text) < 400 THEN 'short' ELSE 'fine' END AS s FROM documents) SELECT count(*) AS n, count(*) FILTER (s = 'scanned') AS scanned, count(*) FILTER (s = 'short') AS short, count(*) FILTER (s = 'fine') AS fine FROM s")
def a4_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.length("text") < 100, "scanned").when(F.length("text") < 400, "short").otherwise("fine")
    return docs(spark, sf_dir).select(s.alias("s")).agg(F.count("*").alias("n"), *[F.count_if(F.col("s") == k).alias(k) for k in ("scanned", "short", "fine")])


# --- records ------------------------------------------------------------------------

_TRUTHY = ["study_id", "first_author", "publication_year", "hospital", "n_patients", "procedure", "mortality", "design"]


@query(f"{_STUDIES} SELECT study_id, floor(100.0 * (" + " + ".join(f"CASE WHEN coalesce(CAST({c} AS STRING), '') NOT IN ('', '0') THEN 1 ELSE 0 END" for c in _TRUTHY) + ") / 8 + 0.5)::DOUBLE AS pct FROM studies")
def a18_truthy_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.studies(spark, sf_dir).select("study_id", evaluation.truthy_completeness(_TRUTHY).cast("double").alias("pct"))


@query(f"{_STUDIES} SELECT study_id, list_filter(['n_patients' , 'age_mean', 'technique'], lambda c: CASE c WHEN 'n_patients' THEN n_patients IS NULL WHEN 'age_mean' THEN age_mean IS NULL ELSE technique IS NULL END) AS missing FROM studies")
def a5_so5_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.studies(spark, sf_dir).select("study_id", evaluation.completeness(["n_patients", "age_mean", "technique"])[1].alias("missing"))


@query(f"{_FIELDS}, c AS (SELECT study_id, field, 'fixed' AS v FROM extracted WHERE study_id % 5 = 0 AND field = 'population.sampleSize') SELECT e.study_id, e.field, coalesce(v, value) AS value FROM extracted e LEFT JOIN c ON c.study_id = e.study_id AND c.field = e.field")
def p5_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.extracted(spark, sf_dir)
    c = e.where("study_id % 5 = 0 AND field = 'population.sampleSize'").select("study_id", "field", F.lit("fixed").alias("v"))
    return e.join(c, ["study_id", "field"], "left").select("study_id", "field", F.coalesce("v", "value").alias("value"))


@query(f"""{_STUDIES}, i AS (SELECT study_id, field, suggested, seq FROM (SELECT study_id, 'a' AS field, CAST(total AS STRING) AS suggested, 1 AS seq FROM studies UNION ALL SELECT study_id, 'a', CAST(selection AS STRING), 2 FROM studies WHERE study_id % 2 = 0))
SELECT study_id, field, max_by(suggested, seq) AS suggested FROM i GROUP BY study_id, field""")
def c10_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    i = s.selectExpr("study_id", "'a' AS field", "'CRITICAL' AS severity", "CAST(total AS STRING) AS suggested", "1 AS seq").unionByName(s.where("study_id % 2 = 0").selectExpr("study_id", "'a' AS field", "'CRITICAL' AS severity", "CAST(selection AS STRING) AS suggested", "2 AS seq"))
    return rules.corrections(i).select("study_id", F.explode("corrections").alias("field", "suggested"))


@query(f"{_STUDIES} SELECT study_id, 'a' AS field, CASE study_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'modify' END AS action, CASE study_id % 3 WHEN 0 THEN CAST(total AS STRING) WHEN 2 THEN 'mine' END AS value FROM studies")
def j17_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    issues = s.selectExpr("study_id", "'a' AS field", "CAST(total AS STRING) AS suggested", "1 AS seq").unionByName(s.selectExpr("study_id", "'a' AS field", "'later' AS suggested", "2 AS seq"))
    return rules.decide(issues, s.selectExpr("study_id", "'a' AS field", "CASE study_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'modify' END AS action", "'mine' AS new_value"))


@query(f"{_STUDIES}, a AS (SELECT study_id, 'x' AS field, design AS truth, 'ann' AS annotator, 1 AS seq FROM studies UNION ALL SELECT study_id, 'x', 'newer', 'bob', 2 FROM studies WHERE study_id % 2 = 1) SELECT study_id, field, max_by(truth, seq) AS truth, list_sort(list(DISTINCT annotator)) AS annotators FROM a GROUP BY study_id, field")
def c12_latest_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    a = s.selectExpr("study_id", "'x' AS field", "design AS truth", "'ann' AS annotator", "1 AS seq").unionByName(s.where("study_id % 2 = 1").selectExpr("study_id", "'x' AS field", "'newer' AS truth", "'bob' AS annotator", "2 AS seq"))
    return evaluation.latest_annotations(a)


@query("SELECT l_orderkey AS run_id, l_linenumber AS step, round(least(0.95::DOUBLE, sum(0.2::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber))::DOUBLE, 6) AS done FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def w8_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = quiet.progress(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().selectExpr("l_orderkey AS run_id", "l_linenumber AS step", "CAST(0.2 AS DOUBLE) AS weight"))
    return p.select("run_id", "step", F.round("done", 6).alias("done"))


@query("""WITH s AS (SELECT doc_id, (doc_id % 10) / 10.0::DOUBLE AS score FROM documents UNION ALL SELECT doc_id, 0.5 FROM documents) SELECT doc_id, round(avg(score), 6) AS avg_score FROM s GROUP BY doc_id""")
def a13_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    s = d.selectExpr("doc_id", "CAST(doc_id % 10 AS DOUBLE) / 10 AS score").unionByName(d.selectExpr("doc_id", "CAST(0.5 AS DOUBLE) AS score"))
    return retrieval.relevance(s).withColumn("avg_score", F.round("avg_score", 6))


_FIG = "CASE p_partkey % 4 WHEN 0 THEN 'MRI' WHEN 1 THEN 'pie' WHEN 2 THEN NULL ELSE 'forest_plot' END"


@query(f"SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'mri' WHEN 1 THEN 'other' WHEN 2 THEN NULL ELSE 'forest_plot' END AS kind FROM part")
def f29_figure_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.figure_kind(F.expr(_FIG)).alias("kind"))


@query("""SELECT p_partkey AS ref_id, concat('@article{', lower(string_split(p_brand, ',')[1]), CAST(1950 + p_size AS STRING), ',', chr(10), '  author = {', p_brand, '},', chr(10), '  title = {', p_name, '},', chr(10), '  year = {', CAST(1950 + p_size AS STRING), '},', chr(10), '  pages = {10--19}', chr(10), '}') AS entry FROM part""")
def f24_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "part").selectExpr("p_partkey AS ref_id", "p_brand AS authors", "p_name AS title", "CAST(NULL AS STRING) AS journal", "1950 + p_size AS year", "'' AS volume", "'' AS issue", "'10-19' AS pages", "'' AS doi")
    return r.select("ref_id", export.bibtex().alias("entry"))


@query()
def f38_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import fusion

    n = rel.studies(spark, sf_dir).where("n_patients IS NOT NULL").selectExpr("study_id", "CAST(n_patients AS BIGINT) AS n")
    return fusion.patients(n, 62.5, 12.0, 0.002, 365, 7)


@query(f"WITH {_LINES} SELECT doc_id, pos::INT AS pos, regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^\\d+/\\d+') AS ratio FROM lines")
def p7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _lines

    return _lines(spark, sf_dir).select("doc_id", "pos", tx.strip(F.col("text")).rlike(r"^\d+/\d+").alias("ratio"))
