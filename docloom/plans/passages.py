"""Queries that find quotes, phrases and places again in whole texts. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import duplicates, phrases, quotes, running, tables, vector_index
from ..sources import files, shared
from .queries import docs, query
from .relations import table

# Four quotes of 60 characters from all over each text, with up to three errors of a sign that no text holds: each costs one edit, no more and no less. A fifth is of that sign alone.
_START = "CAST(1 + (doc_id * 131 + i * 977) % (length(text) - 80) AS INT)"
_ERRORS = "(doc_id + i) % 4"
_PART = "substring(substring(text, {s}, 60), {a}, {n})"
_PIECES = [(1, 9), ">= 1 THEN '¤' ELSE {10}", (11, 20), ">= 2 THEN '¤' ELSE ''", (31, 19), ">= 3 THEN '¤' ELSE {50}", (51, 10)]


def _quote() -> str:
    cut = lambda a, n: _PART.format(s=_START, a=a, n=n)
    out = [cut(*p) if isinstance(p, tuple) else f"CASE WHEN {_ERRORS} {p.replace('{10}', cut(10, 1)).replace('{50}', cut(50, 1))} END" for p in _PIECES]
    return f"CASE WHEN i = 4 THEN '¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤' ELSE concat({', '.join(out)}) END"


@query(f"SELECT doc_id, CAST(i AS INT) AS quote_id, CASE WHEN i = 4 THEN 'none' WHEN {_ERRORS} = 0 THEN 'exact' ELSE 'fuzzy' END AS method, CASE WHEN i = 4 THEN 0 ELSE 1 - {_ERRORS} / CAST(60 + CASE WHEN {_ERRORS} >= 2 THEN 1 ELSE 0 END AS DOUBLE) END AS confidence FROM documents, (SELECT unnest([0, 1, 2, 3, 4]) AS i) x WHERE length(text) > 100")
def j9_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = docs(spark, sf_dir).where("length(text) > 100").select("doc_id", "text")
    asked = texts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("doc_id", F.col("i").alias("quote_id"), F.expr(_quote()).alias("quote"))
    return quotes.locate(asked, texts).select("doc_id", "quote_id", "method", F.col("confidence").cast("double").alias("confidence"))


# --- key phrases and what they support ---------------------------------------

_K = "c_custkey"
#: Responses with figures, sentences with terms, markers and repeated phrases, and two sources of each.
_RESPONSE = f"""concat('Mortality was ', {_K} % 40, '.5% in N = ', {_K} % 90, ' cases of ', c_name, ', that is ', {_K} % 40, '.5% [2]. The OUTCOME of ', {_K} % 7, ' was fair', CASE WHEN {_K} % 3 = 0 THEN '[1]' ELSE '' END, '. We found p < 0.0', {_K} % 9, ' and ', {_K} % 12, ' ± 3.5, range ', {_K} % 5, ' - ', {_K} % 5 + 4, '. Mortality was ', {_K} % 40, '.5%.')"""
_SOURCE_1 = f"concat('In all, mortality was ', {_K} % 40, '.5% . n = ', {_K} % 90, '. The outcome of ', {_K} % 7, ' was fair. It says p < 0.0', {_K} % 8)"
_SOURCE_2 = f"concat('Values ', {_K} % 12, ' ± 3.5 and ', {_K} % 5, ' - ', {_K} % 5 + 4, ' with ', {_K} % 40, '.5%. Edema and hematoma', CASE WHEN {_K} % 4 = 0 THEN ' of the outcome of 3 was fair' ELSE '' END)"


def _phrases_sql(rows: str, keys: str) -> str:
    """(keys, phrase, nth: the order of phrases), over a relation with columns keys and text."""
    parts = [f"SELECT {keys}, {i} AS p, generate_subscripts(m, 1) AS j, unnest(m) AS phrase FROM (SELECT {keys}, regexp_extract_all(text, '{x}') AS m FROM {rows})" for i, x in enumerate(tx.PHRASES)]
    sentences = f"SELECT {keys}, unnest(range(1, len(s) + 1)) AS j, s FROM (SELECT {keys}, string_split(text, '.') AS s FROM {rows})"
    likely = f"SELECT {keys}, j, CASE WHEN j < len(s) THEN concat(s[j], '.') ELSE s[j] END AS phrase FROM ({sentences})"
    terms = ", ".join(f"({len(tx.PHRASES) + i}, '{t}')" for i, t in enumerate(tx.TERMS))
    parts += [f"SELECT {keys}, p, j, phrase FROM ({likely}) l, (VALUES {terms}) t(p, term) WHERE length(phrase) > 10 AND length(phrase) < 150 AND regexp_matches(phrase, concat('(?i)\\b', term, '\\b'))"]
    return f"SELECT {keys}, phrase, min((p, j)) AS nth FROM ({' UNION ALL '.join(parts)}) WHERE length(phrase) > 3 GROUP BY {keys}, phrase"


@query(f"WITH p AS ({_phrases_sql('documents', 'doc_id')}) SELECT phrase, count(DISTINCT doc_id) AS n FROM p GROUP BY phrase")
def f22_key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.distinct(docs(spark, sf_dir))


_SUPPORTS = f"""responses AS (SELECT {_K} AS response_id, {_RESPONSE} AS text FROM customer),
sources AS (SELECT {_K} AS response_id, 1 AS idx, {_SOURCE_1} AS text FROM customer UNION ALL SELECT {_K}, 2, {_SOURCE_2} FROM customer),
phrases AS ({_phrases_sql('sources', 'response_id, idx')}),
hits AS (SELECT p.response_id, idx, nth, phrase, s AS "start", s + length(phrase) AS "end" FROM (SELECT p.*, r.text, unnest(range(0, length(r.text))) AS s FROM phrases p JOIN responses r ON r.response_id = p.response_id) p WHERE starts_with(lower(substring(text, s + 1, length(phrase))), lower(phrase))),
supports AS (SELECT * FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.response_id = a.response_id AND (b.idx, b.nth, b."start") < (a.idx, a.nth, a."start") AND b."start" <= a."start" AND b."end" >= a."end"))"""


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    sources = c.selectExpr(f"{_K} AS response_id", f"inline(array(struct(1 AS idx, {_SOURCE_1} AS text), struct(2 AS idx, {_SOURCE_2} AS text)))")
    return c.selectExpr(f"{_K} AS response_id", f"{_RESPONSE} AS text"), sources


@query(f"""WITH {_SUPPORTS} SELECT response_id, idx, "start", "end", phrase FROM supports""")
def j21_phrase_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.supports(*_answers(spark, sf_dir))


@query(f"""WITH {_SUPPORTS}, e AS (SELECT response_id, "end", min(idx) AS idx FROM supports GROUP BY ALL), m AS (SELECT response_id, text, unnest(range(0, length(text) + 1)) AS i FROM responses)
SELECT m.response_id, string_agg(concat(substring(text, i, 1), CASE WHEN e.idx IS NOT NULL AND NOT regexp_matches(substring(text, i + 1, 5), '^\\[\\d+\\]') THEN concat('[', e.idx, ']') ELSE '' END), '' ORDER BY i) AS marked
FROM m LEFT JOIN e ON e.response_id = m.response_id AND e."end" = m.i WHERE i > 0 GROUP BY m.response_id""")
def j21_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses, sources = _answers(spark, sf_dir)
    return phrases.marked(responses, phrases.supports(responses, sources))


# --- studies that may be the same ----------------------------------------------

_NAME = f"translate(substring(md5(CAST({_K} AS STRING)), 1, 10), '0123456789', 'ghijklmnop')"
#: Every customer's study, and of one in five a second one with spelling mistakes, a shifted period, or other years.
_STUDY_A = {"study_id": f"{_K}", "author": f"concat('Dr. ', {_NAME})", "centre": "concat(n_name, ' University Hospital')", "year_from": f"CAST(1990 + {_K} % 20 AS INT)", "year_to": f"CAST(1993 + {_K} % 20 AS INT)"}
_STUDY_B = {
    "study_id": f"{_K} + 1000000000",
    "author": f"CASE {_K} % 4 WHEN 0 THEN concat('DR ', {_NAME}) WHEN 1 THEN concat('Dr. ', substring({_NAME}, 1, 4), substring({_NAME}, 6, 5)) WHEN 2 THEN concat('Dr. ', {_NAME}, 'x') ELSE concat('Dr. z', substring({_NAME}, 1, 3), 'z', substring({_NAME}, 5, 6)) END",
    "centre": f"CASE {_K} % 3 WHEN 0 THEN concat(n_name, ' University Hospital') WHEN 1 THEN concat(n_name, ' Univercity Hospitl') ELSE concat(n_name, ' University Hospital') END",
    "year_from": f"CAST(1990 + {_K} % 20 + {_K} % 7 AS INT)",
    "year_to": f"CAST(1992 + {_K} % 20 + {_K} % 7 AS INT)",
}
_OF = "FROM customer JOIN nation ON c_nationkey = n_nationkey"
_ALL_STUDIES = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _STUDY_A.items())} {_OF} UNION ALL SELECT {', '.join(f'{e} AS {n}' for n, e in _STUDY_B.items())} {_OF} WHERE {_K} % 5 = 3"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(lower({}), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_PAIRS = f"""studies AS ({_ALL_STUDIES}), s AS (SELECT study_id, {_PLAIN.format("author")} AS author, {_PLAIN.format("centre")} AS centre, year_from, year_to FROM studies),
d AS (SELECT a.study_id AS a, b.study_id AS b, levenshtein(a.author, b.author) AS author_distance, levenshtein(a.centre, b.centre) AS centre_distance, least(a.year_to, b.year_to) - greatest(a.year_from, b.year_from) + 1 AS shared_years,
  greatest(a.year_to, b.year_to) - least(a.year_from, b.year_from) + 1 AS years, greatest(length(a.author), length(b.author)) AS la, greatest(length(a.centre), length(b.centre)) AS lc, least(length(a.author), length(b.author)) // 5 AS ka, least(length(a.centre), length(b.centre)) // 5 AS kc
  FROM s a JOIN s b ON a.study_id < b.study_id AND a.year_from <= b.year_to AND b.year_from <= a.year_to),
pairs AS (SELECT a, b, CAST(author_distance AS INT) AS author_distance, CAST(centre_distance AS INT) AS centre_distance, CAST(shared_years AS INT) AS shared_years, (1 - author_distance / la::DOUBLE + 1 - centre_distance / lc::DOUBLE + shared_years / years::DOUBLE) / 3 AS score,
  CASE WHEN author_distance + centre_distance = 0 AND shared_years / years::DOUBLE >= 0.5 THEN 'High' WHEN author_distance + centre_distance <= 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM d WHERE author_distance <= ka AND centre_distance <= kc)"""


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    make = lambda rows, of: rows.selectExpr(*[f"{e} AS {n}" for n, e in of.items()])
    return make(c, _STUDY_A).unionByName(make(c.where(f"{_K} % 5 = 3"), _STUDY_B))


@query(f"WITH {_PAIRS} SELECT * REPLACE (round(score, 9) AS score) FROM pairs")
def j4_duplicate_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_studies(_studies(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"WITH {_PAIRS}, m AS (SELECT b AS study_id, count(*) AS n, max_by((a, confidence), (score, -a)) AS m FROM pairs GROUP BY b) SELECT s.study_id, m.m IS NOT NULL AS is_duplicate, m.m[1] AS duplicate_of, m.m[2] AS confidence, coalesce(n, 0) AS n_candidates FROM studies s LEFT JOIN m ON m.study_id = s.study_id")
def l10_duplicate_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _studies(spark, sf_dir)
    return duplicates.assessment(s, duplicates.duplicate_studies(s))


# --- a batch of calls to a service that fails at times ---------------------------

AGENTS = ("comparator", "intervention", "metadata", "outcomes", "population", "quality")


class Flaky:
    """Says how long a text is. Fails for good on every 23rd document with the agent for quality, and before that up to four times with the error of a service that is overloaded."""

    def __call__(self, doc_id: int, agent: str, text: str, attempt: int) -> str:
        if agent == "quality" and doc_id % 23 == 0:
            raise ValueError("unreadable")
        if attempt <= (doc_id + AGENTS.index(agent)) % 37 % 5 and doc_id % 3 == 0:
            raise RuntimeError("503 overloaded")
        return str(len(text))


@query(f"""WITH r AS (SELECT doc_id, text, unnest(range(0, 6)) AS i, unnest([{', '.join(f"'{a}'" for a in AGENTS)}]) AS agent FROM documents WHERE length(coalesce(text, '')) >= 100),
t AS (SELECT *, i = 5 AND doc_id % 23 = 0 AS bad, CASE WHEN doc_id % 3 = 0 THEN (doc_id + i) % 37 % 5 ELSE 0 END AS fails FROM r),
a AS (SELECT doc_id, agent, NOT bad AND fails < 3 AS ok, CASE WHEN bad THEN 'unreadable' WHEN fails >= 3 THEN '503 overloaded' END AS error, CASE WHEN bad THEN 1 ELSE least(fails + 1, 3) END AS attempts FROM t),
g AS (SELECT doc_id, count(*) FILTER (ok) AS n_ok, min((agent, error)) FILTER (NOT ok) AS f, sum(attempts) AS n_attempts FROM a GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n_ok = 6 THEN 'extracted' ELSE 'error' END AS status, CASE WHEN g.doc_id IS NULL THEN 'PDF appears empty or contains minimal text (possible scanned PDF)' WHEN f IS NOT NULL THEN concat(f[1], ': ', f[2]) END AS message, CAST(coalesce(n_attempts, 0) AS BIGINT) AS n_attempts
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""")
def c15_batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six agents for every document, retried without pauses; a study is whole or an error."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    answers = running.call(running.requests(d.where("length(text) >= 100"), AGENTS), Flaky, running.Policy(first=0.0, jitter=0.0, at_once=4))
    return running.together(d, answers, len(AGENTS)).drop("data")


# --- layouts and tables -------------------------------------------------------------

def _word(text: str, x: str, y: str) -> str:
    return f"""'<word xMin="', {x}, '" yMin="', {y}, '" xMax="', {x} + 5, '" yMax="', {y} + 10, '">', {text}, '</word>'"""


# two pages; the first has two blocks of two lines, of as many words as the order has units, the second a block with an empty word and a line without words
_BLOCK = "concat('<block><line>', ws, '</line><line>', ws, '<word xMin=\"1\" yMin=\"2\" xMax=\"3\" yMax=\"4\">end</word></line></block>')"
_LAYOUT = f"""concat('<doc><page width="600" height="800">', {_BLOCK}, {_BLOCK}, '</page><page width="1" height="1"><block><line><word xMin="0" yMin="0" xMax="1" yMax="1"></word>', {_word("c_mktsegment", "1", "2")}, '</line><line></line></block></page></doc>')"""
_WORDS = "array_join(transform(sequence(1, 1 + c_custkey % 4), n -> concat('<word xMin=\"', n * 10, '\" yMin=\"', c_custkey % 9, '\" xMax=\"', n * 10 + 5, '\" yMax=\"', c_custkey % 9 + 10, '\">w', n, '</word>')), '')"


@query("""WITH c AS (SELECT c_custkey AS doc_id, CAST(1 + c_custkey % 4 AS INT) AS n, c_custkey % 9 AS y, c_mktsegment AS m FROM customer),
w AS (SELECT doc_id, n, y, b, l, unnest(range(1, CASE WHEN l = 2 THEN n + 2 ELSE n + 1 END)) AS i FROM c, (SELECT unnest([1, 1, 2, 2]) AS b, unnest([1, 2, 1, 2]) AS l) x)
SELECT doc_id, 1 AS page, b AS block, l AS line, i::INT AS word, ((b - 1) * (2 * n + 1) + (l - 1) * n + i - 1)::INT AS pos, CASE WHEN i > n THEN 'end' ELSE concat('w', i) END AS text,
  CASE WHEN i > n THEN 1 ELSE i * 10 END::DOUBLE AS x0, CASE WHEN i > n THEN 2 ELSE y END::DOUBLE AS y0, CASE WHEN i > n THEN 3 ELSE i * 10 + 5 END::DOUBLE AS x1, CASE WHEN i > n THEN 4 ELSE y + 10 END::DOUBLE AS y1 FROM w
UNION ALL SELECT doc_id, 2, 1, 1, 1, 0, m, 1, 2, 6, 12 FROM c""")
def src16_layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment", f"{_WORDS} AS ws")
    return files.layout_blocks(c.selectExpr("c_custkey AS doc_id", f"{_LAYOUT} AS xml"))


#: A table of each kind, of figures in several forms.
_TABLES = {
    "headers": f"""CASE {_K} % 4 WHEN 0 THEN array('Group', 'Mortality', 'mRS 0-2') WHEN 1 THEN array('Item', 'Hydrocephalus', 'GCS') WHEN 2 THEN array('Complications', 'n') ELSE array('Step of those screened', 'Number') END""",
    "rows": f"""CASE {_K} % 4
      WHEN 0 THEN array(array('a', concat({_K} % 40, '.5 %'), concat({_K} % 9, '/9 (', {_K} % 100, '%)')), array('b', concat({_K} % 7, '/', {_K} % 11), 'n/a'), array('c', '', '50%'))
      WHEN 1 THEN array(array('x', concat({_K} % 100, ' (', {_K} % 90, '.2%)'), '9'), array('y', 'none', '8'))
      WHEN 2 THEN array(array('Infection', concat({_K} % 9, '')), array('', '3'), array('Bleeding', ''))
      ELSE array(array('Patients enrolled', concat({_K} % 300, '')), array('Excluded', '5'), array('Included in analysis', concat('n = ', {_K} % 200))) END""",
}
_TABLES_SQL = "SELECT c_custkey AS doc_id, " + ", ".join(f"{e} AS {n}" for n, e in _TABLES.items()).replace("array(", "list_value(") + " FROM customer"


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").selectExpr(f"{_K} AS doc_id", "0 AS table_idx", *[f"{e} AS {n}" for n, e in _TABLES.items()])
    return t.withColumn("kind", tx.table_kind(F.col("headers")))


@query(f"""WITH t AS ({_TABLES_SQL}), r AS (SELECT doc_id, headers[1] AS first, unnest(rows) AS r FROM t), f AS (
  SELECT doc_id, 'outcomes.mortality' AS field, r[2] AS source, coalesce(nullif(regexp_extract(r[2], '(\\d+\\.?\\d*)\\s*%', 1), ''), CAST(floor(CAST(nullif(regexp_extract(r[2], '(\\d+)\\s*/\\s*(\\d+)', 1), '') AS DOUBLE) / nullif(CAST(nullif(regexp_extract(r[2], '(\\d+)\\s*/\\s*(\\d+)', 2), '') AS DOUBLE), 0) * 1000 + 0.5) / 10 AS VARCHAR)) AS v FROM r WHERE first = 'Group'
  UNION ALL SELECT doc_id, 'outcomes.mRS_favorable', r[3], nullif(regexp_extract(r[3], '(\\d+\\.?\\d*)\\s*%', 1), '') FROM r WHERE first = 'Group'
  UNION ALL SELECT doc_id, 'population.hydrocephalus.percentage', r[2], nullif(regexp_extract(r[2], '(\\d+\\.?\\d*)\\s*%', 1), '') FROM r WHERE first = 'Item'
  UNION ALL SELECT doc_id, 'population.sampleSize', array_to_string(r, ' '), nullif(regexp_extract(array_to_string(r, ' '), '(\\d+)', 1), '') FROM r WHERE first = 'Step of those screened' AND regexp_matches(lower(array_to_string(r, ' ')), 'enrolled|included'))
SELECT doc_id, field, CAST(v AS DOUBLE) AS value, source AS source_text FROM f WHERE v IS NOT NULL""")
def f30_table_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.map_fields(_given(spark, sf_dir)).drop("table_idx")


@query(f"WITH t AS ({_TABLES_SQL}) SELECT doc_id, list_transform(list_filter(rows, lambda r: r[1] <> ''), lambda r: array_to_string(r, ' - ')) AS complications FROM t WHERE headers[1] = 'Complications'")
def f30_complications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.complications(_given(spark, sf_dir)).drop("table_idx")


# --- an index that grows --------------------------------------------------------------

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round({_COS}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, label) AS rank FROM s)
SELECT query_id, CAST(count(*) AS BIGINT) AS n_chunks, string_agg(concat('[', rank, '] chunk ', vec_id), chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5 GROUP BY query_id""")
def snk7_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the vectors appended after the other; every 50th asks all cells."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.selectExpr("vec_id AS doc_id", "label AS chunk_idx", "concat('chunk ', vec_id) AS text", "embedding")
    index = vector_index.create(spark, shared.folder(spark, "index"), rows)
    index.append(rows.where("doc_id % 2 = 0"))
    index.append(rows.where("doc_id % 2 = 1"))
    return vector_index.contexts(e.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding"), index.search, 5, probes=None)
