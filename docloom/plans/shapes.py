"""Queries over records of many shapes and over chat sessions as stored and streamed. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, paths
from ..sources import sessions, shared
from ..streaming import threads
from . import relations as rel
from .queries import query
from .relations import table

_K = "c_custkey"
#: Five shapes of record: plain, fields with evidence, arrays of objects, odd characters, deep nesting; some are null, no object or no JSON.
RECORDS = {
    "study_id": _K,
    "data": f"""CASE
      WHEN {_K} % 25 = 4 THEN NULL WHEN {_K} % 25 = 9 THEN '[1, 2]' WHEN {_K} % 25 = 14 THEN 'no json'
      WHEN {_K} % 5 = 0 THEN concat('{{"population": {{"sampleSize": ', {_K} % 97, ', "age": {{"value": ', {_K} % 130, '.5, "sourceText": "mean age was ', {_K} % 130, ' years"}}}}, "metadata": {{"firstAuthor": "', c_name, '", "year": ', 1890 + {_K} % 160, '}}}}')
      WHEN {_K} % 5 = 1 THEN concat('{{"population": {{"age": {{"value": {{"mean": 60, "sd": ', {_K} % 9, '}}, "sourceText": null}}, "arms": [{{"label": "a", "n": {{"sourceText": "arm a had ', {_K}, ' patients", "value": ', {_K} % 7, '}}}}, {{"label": "b"}}]}}, "outcomes": {{}}}}')
      WHEN {_K} % 5 = 2 THEN concat('{{"outcomes": {{"mortality": {{"value": "', {_K} % 41, '%", "sourceText": "short"}}, "followUp": {{"months": {{"median": ', {_K} % 30, ', "range": [1, 2], "value": null}}}}}}, "note": {{"text": "a ', chr(92), '"b', chr(92), '" <', c_mktsegment, '> & c"}}}}')
      WHEN {_K} % 5 = 3 THEN concat('{{"a": {{"b": {{"c": {{"d": {{"e": ', {_K}, '}}, "d.e": "dot"}}}}}}, "flag": true, "none": null, "empty": []}}')
      ELSE '{{"metadata": {{}}, "n": 1}}' END""",
}
RECORDS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in RECORDS.items()) + " FROM customer"

_O = "o_orderkey"
#: Sources of one record with values, objects and arrays at the same paths.
PARTS = {
    "study_id": "o_custkey",
    "source": rel.SOURCE,
    "pos": _O,
    "data": f"""CASE {_O} % 4
      WHEN 0 THEN concat('{{"status": "', o_orderstatus, '", "detail": {{"priority": "', o_orderpriority, '", "price": {{"value": ', {_O} % 100, '}}}}}}')
      WHEN 1 THEN concat('{{"detail": {{"priority": "", "note": null, "price": {{"currency": "EUR"}}}}, "arm": ', {_O} % 3, '}}')
      WHEN 2 THEN CASE WHEN {_O} % 3 = 0 THEN '{{"detail": "none"}}' ELSE concat('{{"tags": ["a", ', {_O} % 9, ']}}') END
      ELSE concat('{{"detail": {{"price": {{"value": {{"low": 1, "high": ', {_O} % 9, '}}}}}}, "status": null}}') END""",
}
PARTS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PARTS.items()) + " FROM orders"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in RECORDS.items()])


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in PARTS.items()])


def _walk_sql(rows: str, keys: str, leaf: str = "false", arrays: bool = False) -> str:
    """CTEs json, walk (every value of every record, recursively) and leaves, over a relation with columns `keys` and data."""
    from_array = f" UNION ALL SELECT {keys}, list_append(path, CAST(k AS VARCHAR)), v->CAST(k AS INT) FROM (SELECT *, unnest(range(0, CAST(json_array_length(v) AS BIGINT))) AS k FROM walk WHERE json_type(v) = 'ARRAY')" if arrays else ""
    return f"""json AS (SELECT {keys}, CAST([] AS VARCHAR[]) AS path, CAST(data AS JSON) AS v FROM {rows} WHERE json_valid(data) AND json_type(CASE WHEN json_valid(data) THEN data END) = 'OBJECT'),
walk AS (SELECT * FROM json UNION ALL (SELECT {keys}, list_append(path, k), v->k FROM (SELECT *, unnest(json_keys(v)) AS k FROM walk WHERE json_type(v) = 'OBJECT' AND NOT coalesce({leaf}, false)){from_array})),
leaves AS (SELECT * FROM walk WHERE len(path) > 0 AND (json_type(v) <> 'OBJECT' OR coalesce({leaf}, false)))"""


@query(f"WITH RECURSIVE records AS ({RECORDS_SQL}), {_walk_sql('records', 'study_id')} SELECT array_to_string(path, '.') AS path, count(DISTINCT study_id) AS n FROM leaves GROUP BY 1")
def p6_found_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.found(records(spark, sf_dir))


@query(f"WITH RECURSIVE records AS ({RECORDS_SQL}), {_walk_sql('records', 'study_id')} SELECT study_id, array_to_string(path, '.') AS path, v->>'$' AS value FROM leaves")
def p6_found_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.walk(records(spark, sf_dir)).select("study_id", paths.dotted(F.col("path")).alias("path"), paths.text(F.col("value")).alias("value"))


_BOTH = "list_contains(json_keys(v), 'value') AND list_contains(json_keys(v), 'sourceText') AND json_type(v) = 'OBJECT'"
_VERIFIABLE = f"{_walk_sql('records', 'study_id', _BOTH, arrays=True)}, fields AS (SELECT study_id, array_to_string(path, '.') AS path, v->'value'->>'$' AS value, v->'sourceText'->>'$' AS source FROM leaves WHERE {_BOTH})"


@query(f"WITH RECURSIVE records AS ({RECORDS_SQL}), {_VERIFIABLE} SELECT study_id, path, value, source FROM fields")
def p6_verifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.verifiable(records(spark, sf_dir))


_TEXT = f"CASE WHEN {_K} % 3 > 0 THEN concat('In all, the mean age was ', {_K} % 2 * 5, ' years; arm a had ', {_K} % 1000, ' patients') END"
_TEXTS = f"SELECT {_K} AS study_id, {_TEXT} AS text FROM customer"


@query(f"""WITH RECURSIVE records AS ({RECORDS_SQL}), texts AS ({_TEXTS}), {_VERIFIABLE}, j AS (SELECT f.*, t.text, length(coalesce(source, '')) < 10 AS short FROM fields f JOIN texts t USING (study_id))
SELECT study_id, path, CASE WHEN short THEN 'WARNING' ELSE 'CRITICAL' END AS severity,
       CASE WHEN short THEN concat('Missing or incomplete source quote for ', path, '. Value: "', coalesce(value, 'null'), '"') ELSE concat('Source quote not found in PDF text for ', path, '. Possible hallucination.') END AS message
FROM j WHERE short OR NOT contains(text, left(source, 30))""")
def c7_found_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").selectExpr(f"{_K} AS study_id", f"{_TEXT} AS text")
    return paths.unsupported(paths.verifiable(records(spark, sf_dir)), texts)


REQUIRED = ["metadata.firstAuthor", "metadata.publicationYear", "metadata.hospitalCenter", "population.sampleSize", "population.diagnosis", "intervention.procedure", "outcomes.mortality", "quality.totalScore"]
#: Studies as JSON, some fields null, some missing, some without a quote.
_STUDY = f"""concat('{{"metadata": {{"firstAuthor": "', c_name, '", "publicationYear": ', CASE WHEN {_K} % 7 = 0 THEN 'null' ELSE '2001' END, CASE WHEN {_K} % 5 = 0 THEN '' ELSE ', "hospitalCenter": "C"' END, '}}, "population": {{"sampleSize": {{"value": ', CASE WHEN {_K} % 6 = 0 THEN 'null' ELSE '40' END, ', "sourceText": ', CASE WHEN {_K} % 4 = 0 THEN 'null' ELSE '"n = 40"' END, '}}, "diagnosis": "d"}}, "intervention": {{"procedure": "craniectomy"}}, "outcomes": {{"mortality": {{"value": "', {_K} % 41, '%", "sourceText": "',
  CASE WHEN {_K} % 3 = 0 THEN '' ELSE 'died' END, '"}}}}, "quality": {{"selection": ', {_K} % 5, ', "comparability": 1, "outcome": null, "totalScore": ', {_K} % 5 + CASE WHEN {_K} % 11 = 0 THEN 2 ELSE 1 END, '}}}}')"""


@query(f"""WITH k AS (SELECT {_K} AS k FROM customer),
m AS (SELECT k, list_filter([CASE WHEN k % 7 = 0 THEN 'metadata.publicationYear' END, CASE WHEN k % 5 = 0 THEN 'metadata.hospitalCenter' END, CASE WHEN k % 6 = 0 THEN 'population.sampleSize' END], lambda x: x IS NOT NULL) AS missing,
  list_filter([CASE WHEN k % 3 = 0 THEN 'outcomes.mortality' END, CASE WHEN k % 4 = 0 AND k % 6 > 0 THEN 'population.sampleSize' END], lambda x: x IS NOT NULL) AS bare FROM k)
SELECT k AS study_id, list_filter([CASE WHEN len(missing) > 0 THEN concat('Missing critical fields: ', array_to_string(missing, ', ')) END, CASE WHEN len(bare) > 0 THEN concat('Add source quotes for: ', array_to_string(bare, ', ')) END,
  CASE WHEN k % 11 = 0 THEN 'NOS total score doesn''t match sum of components - verify calculation' END], lambda x: x IS NOT NULL) AS recommendations FROM m""")
def a8_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").selectExpr(f"{_K} AS study_id", f"{_STUDY} AS data")
    return paths.recommendations(s, REQUIRED, ("quality.totalScore", ["quality.selection", "quality.comparability", "quality.outcome"]))


@query(f"""WITH k AS (SELECT {_K} AS k, c_name FROM customer) SELECT k AS study_id, 'metadata.firstAuthor' AS field, c_name AS value FROM k UNION ALL SELECT k, 'metadata.publicationYear', '2001' FROM k WHERE k % 7 > 0
UNION ALL SELECT k, 'intervention.procedure', 'craniectomy' FROM k UNION ALL SELECT k, 'outcomes.mortality', concat(k % 41, '%') FROM k WHERE k % 41 > 9""")
def p13_searchable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.searchable(table(spark, sf_dir, "customer").selectExpr(f"{_K} AS study_id", f"{_STUDY} AS data"), REQUIRED)


_RANKED = "CASE source WHEN 'erratum' THEN 4 WHEN 'supplement' THEN 3 WHEN 'main-paper' THEN 2 ELSE 1 END"


@query(f"""WITH RECURSIVE parts AS ({PARTS_SQL}), {_walk_sql('parts', 'study_id, source, pos')},
said AS (SELECT study_id, path, v->>'$' AS value, {_RANKED} AS r, pos FROM leaves WHERE coalesce(v->>'$', '') <> '')
SELECT a.study_id, array_to_string(a.path, '.') AS path, a.value FROM said a WHERE NOT EXISTS (
  SELECT 1 FROM said b WHERE b.study_id = a.study_id AND (b.r > a.r OR (b.r = a.r AND b.pos > a.pos)) AND a.path[1:least(len(a.path), len(b.path))] = b.path[1:least(len(a.path), len(b.path))])""")
def f33_deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources laid over each other and rebuilt as JSON; the rebuilt records are read again."""
    merged = paths.merge(parts(spark, sf_dir), [fusion.rank_of(F.col("source")), F.col("pos")])
    return paths.walk(merged).select("study_id", paths.dotted(F.col("path")).alias("path"), paths.text(F.col("value")).alias("value"))


@query(f"""WITH RECURSIVE parts AS ({PARTS_SQL}), {_walk_sql('parts', 'study_id, source, pos')}, f AS (SELECT pos, list_sort(list(array_to_string(path, '.'))) AS fields FROM leaves GROUP BY pos)
SELECT study_id, source, pos, coalesce(fields, []) AS fields FROM parts LEFT JOIN f USING (pos)""")
def p6_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.contributions(parts(spark, sf_dir), ["study_id", "source", "pos"])


_SAME = f"""CASE {_K} % 4 WHEN 0 THEN concat('{{"a": {{"y": [', {_K} % 3, ', 2], "x": ', {_K} % 2, '}}, "b": null}}') WHEN 1 THEN '{{"b": null}}' WHEN 2 THEN 'no json' END"""
_OTHER = f"""CASE {_K} % 4 WHEN 0 THEN '{{"b": null, "a": {{"x": 0, "y": [1, 2]}}}}' WHEN 1 THEN '{{}}' WHEN 2 THEN NULL END"""


@query(f"SELECT {_K} AS id, CASE {_K} % 4 WHEN 0 THEN {_K} % 3 = 1 AND {_K} % 2 = 0 WHEN 1 THEN false ELSE true END AS same FROM customer")
def f15_deep_equal_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col(_K).alias("id"), paths.same(F.expr(_SAME), F.expr(_OTHER)).alias("same"))


_SAFE = "replace(replace(replace(replace(replace(coalesce({}, 'N/A'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_HAS = "list_contains(json_keys(v), 'value') AND json_type(v) = 'OBJECT'"


@query(f"""WITH RECURSIVE records AS ({RECORDS_SQL}), {_walk_sql('records', 'study_id', _HAS)},
rows AS (SELECT study_id, path, concat('<tr><td><strong>', {_SAFE.format("array_to_string(path, '.')")}, '</strong></td>', CASE WHEN coalesce({_HAS}, false) THEN concat('<td>', {_SAFE.format("(v->'value'->>'$')")}, '</td><td class="source">', {_SAFE.format("(v->'sourceText'->>'$')")}, '</td></tr>')
         ELSE concat('<td colspan="2">', {_SAFE.format("(v->>'$')")}, '</td></tr>') END) AS html FROM leaves WHERE len(path) > 1),
f AS (SELECT study_id, count(*) AS n_fields, string_agg(html, chr(10) ORDER BY path) AS rows FROM rows GROUP BY study_id),
e AS (SELECT o_custkey AS study_id, count(*) AS n_evidence, string_agg(concat('<div class="card"><h3>', o_orderpriority, '</h3><p class="source">"', o_orderstatus, '"</p><p>Page ', o_orderkey % 7, '</p></div>'), chr(10) ORDER BY o_orderkey % 7, o_orderpriority, o_orderstatus) AS cards FROM orders GROUP BY o_custkey)
SELECT study_id, coalesce(n_fields, 0) AS n_fields, coalesce(n_evidence, 0) AS n_evidence, concat('<!DOCTYPE html>', chr(10), '<html lang="en">', chr(10), '<head><meta charset="UTF-8"><title>Report</title></head>', chr(10), '<body>', chr(10), '<h1>Report</h1>', chr(10), '<table>', chr(10),
  '<tr><th>Field</th><th>Value</th><th>Source Text</th></tr>', chr(10), coalesce(rows, ''), chr(10), '</table>', chr(10), '<h2>Evidence (', coalesce(n_evidence, 0), ')</h2>', chr(10), coalesce(cards, ''), chr(10), '</body>', chr(10), '</html>') AS html
FROM records LEFT JOIN f USING (study_id) LEFT JOIN e USING (study_id)""")
def snk8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "orders").selectExpr("o_custkey AS study_id", "o_orderkey % 7 AS page", "o_orderpriority AS label", "o_orderstatus AS text")
    return paths.report(records(spark, sf_dir), marks, "Report")


# --- chat sessions ---------------------------------------------------------

_TURNS = "SELECT CAST(conv_id AS STRING) AS session_id, CASE WHEN turn % 3 = 2 THEN 'side' ELSE 'main' END AS thread, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text AS content FROM conversations"


def turns(df: DataFrame) -> DataFrame:
    return df.selectExpr("CAST(conv_id AS STRING) AS session_id", "CASE WHEN turn % 3 = 2 THEN 'side' ELSE 'main' END AS thread", "turn", "CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role", "text AS content")


@query(f"""WITH t AS (SELECT session_id, thread, turn, min((role, content)) AS m FROM ({_TURNS}) GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY session_id, thread ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY session_id, thread) AS n_messages FROM t)
SELECT session_id, thread, n_messages, turn, m[1] AS role, m[2] AS content FROM l WHERE r <= 3 AND NOT (r = 3 AND n_messages > 3 AND m[1] = 'model')""")
def st4_thread_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a stream of turns, in micro-batches of a file or some; what the state ends with."""
    schema = table(spark, sf_dir, "conversations").schema
    # as a pattern, since the table may be one file, which a stream doesn't take by its name
    live = threads.contexts(turns(spark.readStream.schema(schema).option("maxFilesPerTrigger", 32).parquet(f"{sf_dir}/conversations.parque[t]")), keep=3)
    out = shared.folder(spark, "contexts")
    threads.start(live, out, shared.folder(spark, "marks")).awaitTermination()
    return threads.latest(spark, out).select("session_id", "thread", "n_messages", F.explode("context").alias("t")).select("session_id", "thread", "n_messages", "t.turn", "t.role", "t.content")


@query(f"""WITH t AS ({_TURNS}) SELECT session_id, CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN '{{"topic": "b"}}' ELSE '{{"topic": "a"}}' END AS state, CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN 'day 2' ELSE 'day 1' END AS updated_at,
  count(*) FILTER (thread = 'main') AS n_messages, count(DISTINCT thread) AS n_threads FROM t WHERE session_id NOT LIKE '%7' GROUP BY ALL""")
def src8_session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions saved, some saved again, some deleted, the store compacted and read."""
    store = sessions.Store(spark, shared.folder(spark, "sessions"))
    first = sessions.from_turns(turns(table(spark, sf_dir, "conversations"))).withColumn("state", F.lit('{"topic": "a"}'))
    store.save(first, 1, "day 1")
    third = store.sessions().where("CAST(session_id AS LONG) % 3 = 0").withColumn("state", F.lit('{"topic": "b"}'))
    store.save(third, 2, "day 2")
    store.delete(store.list().where("session_id LIKE '%7'"), 3)
    kept = store.compact(shared.folder(spark, "sessions"), 4).sessions()
    counts = sessions.overview(sessions.to_turns(kept))
    return kept.select("session_id", "state", "updated_at").join(counts, "session_id")
