"""Queries over the driver's tables, one per operator or small group of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, evaluation, export, fusion, retrieval, rules, spans, tables
from . import relations as rel
from .relations import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_STUDIES = f"WITH studies AS ({rel.STUDIES_SQL})"
_FIELDS = f"{_STUDIES}, extracted AS ({rel.EXTRACTED_SQL}), truth AS ({rel.TRUTH_SQL})"
_SOURCES = f"WITH sources AS ({rel.SOURCES_SQL})"


# --- retrieval over chunks -------------------------------------------------

ASKED = "the tion und"
_CHUNKS = """chunks AS (
  SELECT doc_id, CAST(i AS INT) AS chunk_idx, substring(text, CAST(i * 2000 + 1 AS INT), 2400) AS text, CAST(i * 2000 AS INT) AS char_start
  FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 2400) / 2000.0), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0))"""
_SCORED = f"""{_CHUNKS}, scored AS (
  SELECT *, (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'und') AS INT)) / 3.0::DOUBLE AS score FROM chunks),
top AS (SELECT * FROM scored ORDER BY score DESC, doc_id, chunk_idx LIMIT 50)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(docs(spark, sf_dir).select("doc_id", "text"), 600, 100)


@query(f"WITH {_SCORED} SELECT doc_id, count(*) AS n_chunks, string_agg(substring(text, 1, 500), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_idx) AS context FROM top GROUP BY doc_id")
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: chunk, score by keywords, keep the best, put each document's hits together."""
    return retrieval.context(retrieval.keyword_top_k(_chunks(spark, sf_dir), ASKED, 50))


@query(f"WITH {_SCORED} SELECT doc_id, chunk_idx, score FROM top")
def s1_keyword_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_top_k(_chunks(spark, sf_dir), ASKED, 50).select("doc_id", "chunk_idx", "score")


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_idx, text, char_start, CAST(char_start + length(text) AS INT) AS char_end, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM chunks")
def f5_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query("""WITH h AS (SELECT doc_id, CAST(doc_id % 7 AS INT) AS chunk_idx, (doc_id % 10) / 10.0::DOUBLE AS score FROM documents UNION ALL SELECT doc_id, CAST(doc_id % 3 AS INT), (doc_id % 4) / 4.0::DOUBLE FROM documents)
SELECT doc_id, chunk_idx, max(score) AS score, count(*) AS n_hits FROM h GROUP BY doc_id, chunk_idx""")
def a19_best_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    a = d.selectExpr("doc_id", "CAST(doc_id % 7 AS INT) AS chunk_idx", "CAST(doc_id % 10 AS DOUBLE) / 10 AS score")
    b = d.selectExpr("doc_id", "CAST(doc_id % 3 AS INT) AS chunk_idx", "CAST(doc_id % 4 AS DOUBLE) / 4 AS score")
    return retrieval.best_per_chunk(a.unionByName(b))


_Q = [round(0.3 - 0.01 * i, 2) for i in range(64)]
_QSQL = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"


@query(f"""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 6) AS score
FROM embeddings, (SELECT {_QSQL} AS q) ORDER BY score DESC, vec_id LIMIT 20""")
def j20_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_top_k(table(spark, sf_dir, "embeddings"), _Q, 20).select("vec_id", F.round("score", 6).alias("score"))


_TURNS = "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text FROM conversations WHERE role <> 'system'"


@query(f"""WITH t AS ({_TURNS}), l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM t)
SELECT conv_id, turn, role FROM l WHERE r <= 4 AND NOT (r = 4 AND n > 4 AND role = 'model')""")
def w1_recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role <> 'system'").selectExpr("conv_id", "turn", "CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role", "text")
    return retrieval.recent_turns(t, 4).select("conv_id", "turn", "role")


_RESP = "SELECT doc_id AS response_id, concat('as said [', CAST(doc_id % 5 AS STRING), '] and [9] and [', CAST(1 + doc_id % 2 AS STRING), CASE WHEN doc_id % 3 = 0 THEN ']' ELSE '' END) AS text FROM documents"


@query(f"""WITH r AS ({_RESP}), c AS (SELECT response_id, CAST(i AS INT) AS idx FROM r, (SELECT unnest([1, 2, 3]) AS i) x), m AS (SELECT DISTINCT response_id, CAST(unnest(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) AS INT) AS idx FROM r),
h AS (SELECT m.* FROM m SEMI JOIN c USING (response_id, idx)) SELECT * FROM h UNION ALL SELECT * FROM c WHERE response_id NOT IN (SELECT response_id FROM h)""")
def j19_inline_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = docs(spark, sf_dir).selectExpr(*_RESP.removeprefix("SELECT ").removesuffix(" FROM documents").replace(", concat(", "\0concat(", 1).split("\0"))
    return retrieval.inline_citations(r, r.select("response_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("idx")))


# --- text ------------------------------------------------------------------

@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(ceil(length(text) / 3000.0) AS BIGINT) AS pages FROM documents")
def f1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"), tx.estimate_pages(F.col("text")).alias("pages"))


@query(f"WITH {_CHUNKS}, t AS (SELECT CAST(ceil(length(text) / 4.0) AS BIGINT) AS n FROM chunks) SELECT count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS tokens, CAST(floor(avg(n) + 0.5) AS BIGINT) AS avg_tokens FROM t")
def a1_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _chunks(spark, sf_dir).select("tokens")
    return n.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.floor(F.avg("tokens") + 0.5), F.lit(0)).alias("avg_tokens"))


_ABBR = "text"
for _a in tx.ABBREVIATIONS:
    _ABBR = f"replace({_ABBR}, '{_a}', '{_a.replace('.', chr(1))}')"
_SENT = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({_ABBR}, '([0-9])\\.([0-9])', '\\1{chr(1)}\\2', 'g'), '([.!?])\\s+([A-Z])', '\\1{chr(2)}\\2', 'g'), '{chr(2)}'), lambda s: regexp_replace(replace(s, '{chr(1)}', '.'), '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query(f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents) SELECT doc_id, CAST(len(s) AS INT) AS n, s[1] AS first, s[len(s)] AS last FROM s")
def f2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.try_element_at("s", F.lit(1)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


@query("WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS p FROM documents) SELECT doc_id, CAST(len(p) AS INT) AS n, p[1] AS first FROM p")
def f3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return docs(spark, sf_dir).select("doc_id", tx.paragraphs(t).alias("p")).select("doc_id", F.size("p").alias("n"), F.try_element_at("p", F.lit(1)).alias("first"))


_CASE = " ".join(f"WHEN regexp_matches(l, '(?i){p}') THEN '{n}'" for n, p in tx.SECTION_STARTS)


@query(f"WITH t AS (SELECT doc_id, regexp_replace(string_split({rel.HEADLINE}, chr(10))[1], '^\\s+|\\s+$', '', 'g') AS l FROM documents) SELECT doc_id, CASE {_CASE} END AS section FROM t")
def f4_section_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.section_of(F.expr(rel.HEADLINE)).alias("section"))


@query(f"""{_STUDIES} SELECT study_id, TRY_CAST(nullif(regexp_extract(mortality, '(\\d+)\\s*/\\s*(\\d+)', 1), '') AS BIGINT) AS numerator, TRY_CAST(nullif(regexp_extract(mortality, '(\\d+)\\s*/\\s*(\\d+)', 2), '') AS BIGINT) AS denominator,
TRY_CAST(nullif(regexp_extract(mortality, '^\\s*(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS strict_pct,
coalesce(TRY_CAST(nullif(regexp_extract(mortality, '(\\d+\\.?\\d*)\\s*%', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(mortality, '^\\s*(\\d+\\.?\\d*)', 1), '') AS DOUBLE)) AS pct FROM studies""")
def f10_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mortality")
    return rel.studies(spark, sf_dir).select("study_id", tx.fraction_part(m, 1).alias("numerator"), tx.fraction_part(m, 2).alias("denominator"), tx.parse_percentage(m, True).alias("strict_pct"), tx.parse_percentage(m).alias("pct"))


@query(f"""{_STUDIES}, t AS (SELECT study_id, unnest([mortality, mrs, source_text]) AS text, unnest([1, 2, 3]) AS n FROM studies)
SELECT study_id, n, coalesce(TRY_CAST(nullif(regexp_extract(text, '(\\d+)\\s*/\\s*(\\d+)', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(text, '\\d+'), '') AS BIGINT)) AS numerator, TRY_CAST(nullif(regexp_extract(text, '(\\d+)\\s*/\\s*(\\d+)', 2), '') AS BIGINT) AS denominator FROM t""")
def f10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rel.studies(spark, sf_dir).select("study_id", F.posexplode(F.array("mortality", "mrs", "source_text")).alias("n", "text"))
    return t.select("study_id", (F.col("n") + 1).alias("n"), tx.parse_count(F.col("text")).alias("c")).select("study_id", "n", "c.*")


_DAYS = "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(follow_up, '(?i)(\\d+)\\s*{p}', 1), '') AS BIGINT) * {n}" for p, n in (("d(?:ay)?s?", 1), ("m(?:onth)?s?", 30), ("y(?:ea)?r?s?", 365))) + ")"
_MORT = "coalesce(TRY_CAST(nullif(regexp_extract(mortality, '(\\d+\\.?\\d*)%', 1), '') AS DOUBLE) / 100, TRY_CAST(nullif(regexp_extract(mortality, '(\\d+)\\s*/\\s*(\\d+)', 1), '') AS DOUBLE) / nullif(TRY_CAST(nullif(regexp_extract(mortality, '(\\d+)\\s*/\\s*(\\d+)', 2), '') AS DOUBLE), 0))"


@query(f"""{_STUDIES}, d AS (SELECT study_id, nullif({_DAYS}, 0) AS days, {_MORT} AS m FROM studies), s AS (SELECT *, CAST(CASE WHEN days IS NULL THEN NULL WHEN days <= 60 THEN 30 WHEN days <= 135 THEN 90 WHEN days <= 272 THEN 180 ELSE 365 END AS INT) AS std FROM d)
SELECT study_id, days, std AS standard_days, CASE WHEN days IS NOT NULL THEN round(m, 9) END AS mortality, coalesce(days <> std, false) AS converted, CASE WHEN coalesce(days <> std, false) THEN 'medium' ELSE 'high' END AS confidence FROM s""")
def f14_harmonise(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = rel.studies(spark, sf_dir).select("study_id", fusion.harmonise(F.col("follow_up"), F.col("mortality")).alias("h"))
    return h.select("study_id", "h.days", "h.standard_days", F.round("h.mortality", 9).alias("mortality"), "h.converted", "h.confidence")


@query("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE concat(regexp_replace(substring(text, 1, 197), '^\\s+|\\s+$', '', 'g'), '...') END AS short,
regexp_replace(concat('Id ', source, '/', CAST(doc_id AS STRING)), '[^A-Za-z0-9_-]', '_', 'g') AS safe, regexp_replace(regexp_replace(regexp_replace(text, '-\\s*\\n\\s*', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS joined FROM documents""")
def f18_f21_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", tx.truncate(t).alias("short"), tx.safe_id(F.concat(F.lit("Id "), "source", F.lit("/"), F.col("doc_id").cast("string"))).alias("safe"), tx.join_lines(t).alias("joined"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^A-Za-z0-9_\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS plain FROM documents")
def f20_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.normalise(F.col("text")).alias("plain"))


@query("""WITH p AS (SELECT a.doc_id, list_distinct(regexp_split_to_array(lower(a.text), '\\s+')) AS x, list_distinct(regexp_split_to_array(lower(b.text), '\\s+')) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 9) AS similarity FROM p""")
def so1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    # hashes of words, not texts, go through the join
    d = docs(spark, sf_dir).select("doc_id", tx.word_hashes(F.col("text")).alias("words"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("words").alias("other"))
    return d.join(b, "doc_id").select("doc_id", F.round(tx.jaccard_of_sets(F.col("words"), F.col("other")), 9).alias("similarity"))


_CELL = "CASE l_orderkey % 7 WHEN 0 THEN concat(CAST(l_linenumber AS STRING), ' ± 3') WHEN 1 THEN concat(CAST(l_linenumber AS STRING), ' (30%)') WHEN 2 THEN '5/20 x' WHEN 3 THEN '<0.05' WHEN 4 THEN ' P = 0.03' WHEN 5 THEN 'n=45' ELSE 'mean of 4' END"


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, regexp_replace({_CELL}, '^\\s+|\\s+$', '', 'g') AS c FROM lineitem)
SELECT l_orderkey % 7 AS kind, count(*) AS n, CAST(sum(CASE WHEN {" OR ".join(f"regexp_matches(c, '{p}')" for p in tx.CELL_STARTS)} THEN 1 ELSE 0 END) AS BIGINT) AS n_table FROM c GROUP BY 1""")
def p17_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 7 AS kind", f"{_CELL} AS c")
    return c.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(tx.is_table_content(F.col("c"))).alias("n_table"))


_CITE = "CASE doc_id % 4 WHEN 0 THEN '12. Kim J, Lee. Title. J.' WHEN 1 THEN 'Kim, J. (2016). Title' WHEN 2 THEN 'Kim \"A title\". Journal' ELSE 'nothing' END"


@query(f"""WITH c AS (SELECT doc_id, {_CITE} AS c FROM documents) SELECT doc_id, CASE WHEN regexp_matches(c, '^\\d+\\.\\s') THEN 'vancouver' WHEN regexp_matches(c, '\\(\\d{{4}}\\)') THEN 'apa' WHEN regexp_matches(c, '"[^"]+"\\.\\s') THEN 'mla' ELSE 'unknown' END AS style FROM c""")
def f23_citation_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.citation_style(F.expr(_CITE)).alias("style"))


@query("SELECT doc_id, regexp_extract_all(text, '\\d+\\.?\\d*') AS numbers FROM documents WHERE regexp_matches(text, '\\d')")
def f22_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.col("text").rlike(r"\d")).select("doc_id", tx.numbers(F.col("text")).alias("numbers"))


@query("SELECT doc_id, sha256(text) AS checksum FROM documents")
def f16_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("checksum"))


# --- chunking that folds (tests hold these against hand-traced cases) --------

@query()
def f6_semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.semantic_chunks(d, 300, 100, 50)


def _five_line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text): five lines to a page, in order, each a paragraph."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n\n")
    return lines.groupBy("doc_id", (F.floor(F.col("i") / 5) + 1).alias("page")).agg(in_order.alias("text"))


@query()
def w2_page_chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page_chunks(_five_line_pages(spark, sf_dir), 400, 100, 60)


@query()
def f8_paper_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paper_chunks(docs(spark, sf_dir).select("doc_id", F.replace(F.expr(rel.SECTIONED), F.lit("\n"), F.lit("\n\n")).alias("text")), 300, 50, 50)


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(floor(avg(CAST(ceil(length(text) / 4.0) AS BIGINT)) + 0.5) AS BIGINT) AS avg_tokens FROM chunks GROUP BY doc_id")
def f9_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(chunking.chunk(docs(spark, sf_dir).select("doc_id", "text"), "fixed", max_tokens=600, overlap_tokens=100))


_HEADED = "concat('Title', chr(10), CASE doc_id % 3 WHEN 0 THEN 'Abstract: ' WHEN 1 THEN 'METHODS ' ELSE 'none ' END, text, ' RESULTS AND MORE ', substring(text, CAST(length(text) / 2 AS INT), 25), chr(10), CASE doc_id % 2 WHEN 0 THEN 'Conclusion x' ELSE 'Discussion y' END, left(text, 9))"
_HEAD_SQL = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, length(regexp_extract(t, '(?is)^(.*?)\\b(?:{w})\\b', 1)) AS pre, regexp_extract(t, '(?i)\\b(?:{w})\\b') AS m, t FROM h WHERE regexp_matches(t, '(?i)\\b(?:{w})\\b')" for n, w in chunking.HEADINGS)


@query(f"""WITH h AS (SELECT doc_id, {_HEADED} AS t FROM documents), f AS ({_HEAD_SQL}), r AS (SELECT doc_id, name, m, substring(t, (pre + length(m) + 1)::INT) AS rest FROM f)
SELECT doc_id, name, regexp_replace(concat(m, CASE WHEN regexp_matches(rest, '\\b[A-Z][A-Z\\s]{{2,}}\\b') THEN regexp_extract(rest, '(?s)^(.*?)\\b[A-Z][A-Z\\s]{{2,}}\\b', 1) ELSE rest END), '^\\s+|\\s+$', '', 'g') AS text FROM r""")
def f4_named_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.inline(chunking.named_sections(F.expr(_HEADED))))


@query()
def f7_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page_chunks(_five_line_pages(spark, sf_dir), 400, 100)


@query()
def f8_paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = docs(spark, sf_dir).select("doc_id", F.explode(chunking.paper_sections(F.expr(rel.SECTIONED))).alias("s"))
    return s.select("doc_id", F.col("s.type").alias("section"), F.length("s.text").alias("chars"))


# --- records: projections, rules, verdicts ----------------------------------

@query(f"{_STUDIES} SELECT study_id, coalesce(nullif(first_author, ''), 'Unknown') AS author, publication_year, hospital, coalesce(n_patients, 0) AS n, count(*) OVER () AS total FROM studies")
def p2_list_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    listed = s.selectExpr("study_id", "coalesce(nullif(first_author, ''), 'Unknown') AS author", "publication_year", "hospital", "coalesce(n_patients, 0) AS n")
    total = listed.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    return listed.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


@query(f"""{_STUDIES} SELECT study_id AS \"DocID\", first_author AS \"FirstAuthor\", publication_year AS \"Year\", age_mean AS \"Age_Mean\", CASE WHEN age_mean IS NOT NULL THEN source_text END AS \"Age_Mean_Source\", CASE WHEN age_mean IS NOT NULL THEN CAST(study_id % 30 + 1 AS INT) END AS \"Age_Mean_Page\",
concat('mortality@', coalesce(follow_up, ''), ': ', mortality, '; mRS@', coalesce(follow_up, ''), ': ', mrs) AS \"AllOutcomes\", total AS \"NOS_Total\" FROM studies""")
def p4_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = export.verifiable(F.col("age_mean"), F.col("source_text"), F.expr("CAST(study_id % 30 + 1 AS INT)"))
    nested = rel.studies(spark, sf_dir).select("*", F.when(F.col("age_mean").isNotNull(), age).alias("age"), F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce("follow_up", F.lit("")).alias("time"), F.col(c).alias("value")) for n, c in (("mortality", "mortality"), ("mRS", "mrs"))]).alias("all"))
    return nested.select(F.col("study_id").alias("DocID"), F.col("first_author").alias("FirstAuthor"), F.col("publication_year").alias("Year"), *export.flatten_field("Age_Mean", F.col("age")), export.outcomes_text(F.col("all")).alias("AllOutcomes"), F.col("total").alias("NOS_Total"))


@query(f"{_STUDIES} SELECT study_id, dup_confidence FROM studies WHERE NOT (is_duplicate AND dup_confidence <> 'Low')")
def p8_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.without_duplicates(rel.studies(spark, sf_dir)).select("study_id", "dup_confidence")


def _issues_sql(rs: list[rules.Rule]) -> str:
    return " UNION ALL ".join(f"SELECT study_id, '{r.critic}' AS critic, '{r.field}' AS field, '{r.severity}' AS severity, '{r.message}' AS message FROM studies WHERE {r.broken}" for r in rs)


_RANGE = rules.range_rules(rel.LATEST_YEAR)
_COMPLETE = rules.completeness_rules()
_CRITERIA = rules.criteria_rules()


@query(f"{_STUDIES} {_issues_sql(_RANGE)}")
def c2_range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(rel.studies(spark, sf_dir), rules.range_rules(rel.LATEST_YEAR))


@query(f"{_STUDIES} {_issues_sql(_COMPLETE)}")
def c3_completeness_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(rel.studies(spark, sf_dir), rules.completeness_rules())


@query(f"{_STUDIES} {_issues_sql(_CRITERIA)}")
def c6_criteria_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(rel.studies(spark, sf_dir), rules.criteria_rules())


def _arith_sql(pct: str) -> str:
    return f"""{_STUDIES}, m AS (SELECT study_id, TRY_CAST(nullif(regexp_extract(mortality, '(\\d+)\\s*/\\s*(\\d+)', 1), '') AS BIGINT) AS deaths, TRY_CAST(nullif(regexp_extract(mortality, '(\\d+)\\s*/\\s*(\\d+)', 2), '') AS BIGINT) AS n,
TRY_CAST(nullif(regexp_extract(mortality, '{pct}', 1), '') AS DOUBLE) AS stated FROM studies)
SELECT study_id, 'outcomes.mortality' AS field, 'CRITICAL' AS severity, deaths, n, stated, concat(deaths, '/', n, ' (', printf('%.1f', floor(CAST(deaths AS DOUBLE) / n * 1000 + 0.5) / 10), '%)') AS suggested FROM m WHERE abs(CAST(deaths AS DOUBLE) / n * 100 - stated) > 1.0"""


@query(_arith_sql("^\\s*(\\d+\\.?\\d*)"))
def c1_arithmetic_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.arithmetic(rel.studies(spark, sf_dir), strict=True)


@query(f"""{_arith_sql("(\\d+\\.?\\d*)\\s*%").replace("(\\d+\\.?\\d*)\\s*%', 1), '') AS DOUBLE) AS stated", "(\\d+\\.?\\d*)\\s*%', 1), '') AS DOUBLE) AS p, TRY_CAST(nullif(regexp_extract(mortality, '^\\s*(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS l").replace("deaths, n, stated, concat", "deaths, n, coalesce(p, l) AS stated, concat").replace("- stated)", "- coalesce(p, l))")}""")
def c1_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.arithmetic(rel.studies(spark, sf_dir))


@query(f"""{_STUDIES}, r AS (SELECT study_id, selection BETWEEN 0 AND 4 AND comparability BETWEEN 0 AND 2 AND outcome BETWEEN 0 AND 3 AND total BETWEEN 0 AND 9 AS ok, total = selection + comparability + outcome AS same, selection + comparability + outcome AS want,
selection BETWEEN 0 AND 4 AND comparability BETWEEN 0 AND 2 AND outcome BETWEEN 0 AND 3 AND abs(total - (selection + comparability + outcome)) < 0.01 AS loose FROM studies)
SELECT study_id, ok AS range_valid, same AS sum_matches, CAST(want AS INT) AS expected_total, CAST(CASE WHEN ok THEN 0.5 ELSE 0 END + CASE WHEN same THEN 0.5 ELSE 0 END AS DOUBLE) AS score, round(CAST(CASE WHEN ok THEN 0.33 ELSE 0 END + CASE WHEN same THEN 0.34 ELSE 0 END + 0.33 AS DOUBLE), 6) AS detailed, loose FROM r""")
def m1_m3_nos(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = [F.col(c) for c in ("selection", "comparability", "outcome", "total")]
    return rel.studies(spark, sf_dir).select("study_id", *[c.alias(n) for n, c in rules.nos(*four).items()], F.round(rules.nos_detailed(*four, F.lit(None).cast("boolean")), 6).alias("detailed"), rules.nos_loose(*four).alias("loose"))


@query(f"""{_FIELDS} SELECT study_id, count(*) FILTER (value IS NOT NULL AND length(coalesce(source_text, '')) < 10) AS n_missing, count(*) FILTER (value IS NOT NULL AND length(coalesce(source_text, '')) < 10) <= 2 AS anchored FROM extracted GROUP BY study_id""")
def c4_anchoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.anchoring(rel.extracted(spark, sf_dir))


@query(f"""{_FIELDS}, n AS (SELECT study_id, field, source_text, unnest(regexp_extract_all(value, '\\d+\\.?\\d*')) AS evidence FROM extracted WHERE coalesce(source_text, '') <> ''),
q AS (SELECT e.study_id, field, substring(source_text, 1, 30) AS evidence, text FROM extracted e JOIN documents d ON d.doc_id = e.study_id WHERE length(source_text) > 20 AND regexp_matches(value, '\\d'))
SELECT study_id, field, 'CRITICAL' AS severity, evidence FROM n WHERE NOT contains(source_text, evidence) UNION ALL SELECT study_id, field, 'WARNING', evidence FROM q WHERE NOT contains(text, evidence)""")
def c5_hallucinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.hallucinations(rel.extracted(spark, sf_dir).withColumn("doc_id", F.col("study_id")), docs(spark, sf_dir))


@query(f"""{_FIELDS}, j AS (SELECT e.study_id, field, coalesce(source_text, '') AS q, coalesce(text, '') AS text FROM extracted e LEFT JOIN documents d ON d.doc_id = e.study_id WHERE value IS NOT NULL),
s AS (SELECT study_id, field, CASE WHEN length(q) < 10 THEN 'WARNING' WHEN NOT contains(text, substring(q, 1, 30)) THEN 'CRITICAL' END AS severity FROM j) SELECT * FROM s WHERE severity IS NOT NULL""")
def c7_source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.source_check(rel.extracted(spark, sf_dir).withColumn("doc_id", F.col("study_id")), docs(spark, sf_dir))


_CRIT = "SELECT study_id, CASE f WHEN 0 THEN 0.9 WHEN 1 THEN CASE WHEN study_id % 4 = 0 THEN 0.0 ELSE 0.8 END ELSE 0.85 END AS confidence FROM studies CROSS JOIN (SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2) x"


@query(f"""{_FIELDS}, issues AS ({_issues_sql(_RANGE)}), anch AS (SELECT study_id, count(*) FILTER (value IS NOT NULL AND length(coalesce(source_text, '')) < 10) <= 2 AS anchored FROM extracted GROUP BY study_id), critics AS ({_CRIT}),
p AS (SELECT study_id, count(*) FILTER (severity = 'CRITICAL') AS nc, count(*) FILTER (severity = 'WARNING') AS nw FROM issues GROUP BY study_id), m AS (SELECT study_id, coalesce(avg(CAST(confidence AS DOUBLE)) FILTER (confidence > 0), 0.5) AS mean FROM critics GROUP BY study_id)
SELECT m.study_id, coalesce(nc, 0) AS n_critical, coalesce(nw, 0) AS n_warning, round(greatest(0, least(1, mean - 0.2 * coalesce(nc, 0) - 0.05 * coalesce(nw, 0) - CASE WHEN coalesce(anchored, true) THEN 0 ELSE 0.1 END)), 6)::DOUBLE AS confidence, coalesce(nc, 0) = 0 AND coalesce(anchored, true) AS passed
FROM m LEFT JOIN p USING (study_id) LEFT JOIN anch USING (study_id)""")
def c8_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    critics = s.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr("study_id", "CAST(CASE f WHEN 0 THEN 0.9 WHEN 1 THEN CASE WHEN study_id % 4 = 0 THEN 0.0 ELSE 0.8 END ELSE 0.85 END AS DOUBLE) AS confidence")
    v = rules.verdict(rules.apply_rules(s, rules.range_rules(rel.LATEST_YEAR)), rules.anchoring(rel.extracted(spark, sf_dir)), critics)
    return v.withColumn("confidence", F.round("confidence", 6))


# --- evaluation ---------------------------------------------------------------

_METRICS = f"""{_FIELDS}, j AS (SELECT t.study_id, t.field, value, truth, source_text, evidence, length(coalesce(source_text, '')) >= 10 AND contains(t.field, '.') AS has FROM truth t LEFT JOIN extracted e ON e.study_id = t.study_id AND e.field = t.field),
w AS (SELECT *, list_distinct(regexp_split_to_array(lower(source_text), '\\s+')) AS x, list_distinct(regexp_split_to_array(lower(evidence), '\\s+')) AS y FROM j),
g AS (SELECT *, CASE WHEN has AND coalesce(evidence, '') <> '' THEN len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) ELSE 0.0::DOUBLE END AS grounding, value IS NOT DISTINCT FROM truth AS match FROM w),
metrics AS (SELECT study_id, field, match, has AS has_source, grounding, CASE WHEN match THEN 'correct' WHEN coalesce(value, '') = '' THEN 'missing' WHEN NOT has OR grounding < 0.3 THEN 'hallucination' WHEN grounding < 0.7 THEN 'partial' ELSE 'inaccurate' END AS error_type FROM g)"""
_CRITICAL = ", ".join(f"'{x}'" for x in evaluation.CRITICAL_FIELDS)
_PER = f"""{_METRICS}, per AS (SELECT study_id, count(*) AS n_fields, avg(match::INT) AS accuracy, avg(match::INT) AS f1, avg(has_source::INT) AS grounding_rate, coalesce(avg(match::INT) FILTER (field IN ({_CRITICAL})), 1.0) AS critical_accuracy, coalesce(avg(match::INT) FILTER (error_type <> 'missing'), 0.0) AS precision, avg(match::INT) AS recall FROM metrics GROUP BY study_id)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.field_metrics(rel.extracted(spark, sf_dir), rel.truth(spark, sf_dir))


@query(f"{_METRICS} SELECT study_id, field, match, has_source, round(grounding, 9) AS grounding, error_type FROM metrics")
def c11_field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).withColumn("grounding", F.round("grounding", 9))


@query(f"{_PER} SELECT study_id, n_fields, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("accuracy", "f1", "grounding_rate", "critical_accuracy", "precision", "recall")) + " FROM per")
def a9_study_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.study_metrics(_metrics(spark, sf_dir))
    return m.select("study_id", "n_fields", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


@query(f"{_METRICS} SELECT " + ", ".join(f"count(*) FILTER (error_type = '{e}') AS {e}" for e in evaluation.ERRORS) + " FROM metrics")
def a10_error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.error_histogram(_metrics(spark, sf_dir))


@query(f"{_PER} SELECT design AS stratum, count(*) AS n, round(avg(f1), 6)::DOUBLE AS avg_f1 FROM per JOIN studies USING (study_id) GROUP BY design")
def a10_by_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = evaluation.by_stratum(evaluation.study_metrics(_metrics(spark, sf_dir)), rel.studies(spark, sf_dir), "design")
    return b.withColumn("avg_f1", F.round("avg_f1", 6))


_EIGHT = ["first_author", "publication_year", "hospital", "n_patients", "age_mean", "technique", "mortality", "total"]
_COMPL = "(" + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in _EIGHT) + ") / 8.0::DOUBLE"


@query(f"""{_FIELDS}, q AS (SELECT study_id, coalesce(avg(CASE WHEN length(coalesce(source_text, '')) > 10 THEN 1 ELSE 0 END) FILTER (value IS NOT NULL), 1.0) AS src FROM extracted GROUP BY study_id),
c AS (SELECT study_id, {_COMPL} AS compl, CASE WHEN selection BETWEEN 0 AND 4 AND comparability BETWEEN 0 AND 2 AND outcome BETWEEN 0 AND 3 AND total BETWEEN 0 AND 9 THEN 0.5 ELSE 0 END + CASE WHEN total = selection + comparability + outcome THEN 0.5 ELSE 0 END AS nos FROM studies)
SELECT study_id, compl AS completeness, round(src, 6)::DOUBLE AS sourced, nos::DOUBLE AS nos, floor((compl * 0.3 + src * 0.3 + nos * 0.15) / 0.75 * 100 + 0.5 + 1e-9) / 100 AS overall FROM c JOIN q USING (study_id)""")
def a8_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    four = [F.col(c) for c in ("selection", "comparability", "outcome", "total")]
    score, _ = evaluation.completeness(_EIGHT)
    j = s.select("study_id", score.alias("completeness"), rules.nos(*four)["score"].alias("nos")).join(evaluation.source_share(rel.extracted(spark, sf_dir)).withColumnRenamed("score", "sourced"), "study_id")
    parts = {"a": (F.col("completeness"), 0.3), "b": (F.col("sourced"), 0.3), "c": (F.col("nos"), 0.15), "d": (F.lit(None).cast("double"), 0.25)}
    return j.select("study_id", "completeness", F.round("sourced", 6).alias("sourced"), "nos", evaluation.weighted_score(parts).alias("overall"))


# --- fusion ---------------------------------------------------------------------

_RANK = "CASE source WHEN 'erratum' THEN 4 WHEN 'supplement' THEN 3 WHEN 'main-paper' THEN 2 ELSE 1 END"


@query(f"{_SOURCES} SELECT study_id, field, count(DISTINCT value) AS n_values, count(*) AS n_sources FROM sources WHERE value IS NOT NULL GROUP BY study_id, field HAVING count(DISTINCT value) > 1")
def j18_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.conflicts(rel.sources(spark, sf_dir))


@query(f"{_SOURCES}, r AS (SELECT *, row_number() OVER (PARTITION BY study_id, field ORDER BY {_RANK} DESC, pos) AS k FROM sources WHERE value IS NOT NULL) SELECT study_id, field, value, source FROM r WHERE k = 1")
def w7_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.resolve(rel.sources(spark, sf_dir))


@query(f"{_SOURCES}, r AS (SELECT *, row_number() OVER (PARTITION BY study_id, field ORDER BY {_RANK} DESC, pos DESC) AS k FROM sources WHERE coalesce(value, '') <> '') SELECT study_id, field, value FROM r WHERE k = 1")
def f33_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merge(rel.sources(spark, sf_dir))


@query(f"""{_SOURCES}, c AS (SELECT study_id, field FROM sources WHERE value IS NOT NULL GROUP BY study_id, field HAVING count(DISTINCT value) > 1), n AS (SELECT study_id, count(*) AS n FROM c GROUP BY study_id),
p AS (SELECT study_id, count(DISTINCT pos) AS n_sources, list_sort(list(DISTINCT source)) AS modules FROM sources GROUP BY study_id)
SELECT study_id, n_sources, modules, coalesce(n, 0) AS n_conflicts, CASE WHEN n_sources = 1 THEN 'single' WHEN coalesce(n, 0) > 0 THEN 'highest-quality' ELSE 'merged' END AS strategy FROM p LEFT JOIN n USING (study_id)""")
def f34_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(rel.sources(spark, sf_dir))


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS centre, CAST(1990 + s_suppkey % 23 AS INT) AS a, CAST(1990 + s_suppkey % 23 + s_suppkey % 3 AS INT) AS b FROM supplier)
SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.centre = y.centre AND x.id < y.id AND x.a <= y.b AND y.a <= x.b""")
def j4_duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS study_id", "concat('Centre ', CAST(s_nationkey AS STRING)) AS centre", "CAST(1990 + s_suppkey % 23 AS INT) AS year_from", "CAST(1990 + s_suppkey % 23 + s_suppkey % 3 AS INT) AS year_to")
    return fusion.duplicate_candidates(s)


# --- spans ----------------------------------------------------------------------

_SPANS = """w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char FROM w),
spans AS (SELECT doc_id, pos::INT AS pos, text, start_char, start_char + length(text) AS end_char, start_char // 1000 + 1 AS page, start_char % 80 * 6 AS x, start_char // 80 * 12 AS y, length(text) * 6 AS width, 12 AS height FROM o)"""
#: Citations of 60 characters all over each text, the last beyond its end.
_CITES = "cites AS (SELECT doc_id, i::INT AS cite_id, i * 137 AS c_start, i * 137 + 60 AS c_end FROM (SELECT doc_id, unnest(range(0, CAST(length(text) // 137 + 2 AS BIGINT))) AS i FROM documents))"


def _cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = docs(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 137).cast("int") + 1)).alias("cite_id"))
    return cites.selectExpr("doc_id", "cite_id", "CAST(cite_id * 137 AS BIGINT) AS c_start", "CAST(cite_id * 137 + 60 AS BIGINT) AS c_end")


@query(f"WITH {_SPANS} SELECT doc_id, count(*) AS n, max(end_char) AS chars, max(page) AS pages, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM spans GROUP BY doc_id")
def w3_word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.word_spans(docs(spark, sf_dir).select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end_char").alias("chars"), F.max("page").alias("pages"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(f"""WITH {_SPANS}, {_CITES} SELECT c.doc_id, cite_id, pos, substring(text, (greatest(c_start, start_char) - start_char + 1)::INT, (least(c_end, end_char) - greatest(c_start, start_char))::INT) AS text, page, round(x + width * (greatest(c_start, start_char) - start_char) / (end_char - start_char)::DOUBLE, 6) AS x, y, round(width * (least(c_end, end_char) - greatest(c_start, start_char)) / (end_char - start_char)::DOUBLE, 6) AS width
FROM cites c JOIN spans s ON c.doc_id = s.doc_id AND start_char < c_end AND c_start < end_char""")
def j5_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spans.overlap(_cites(spark, sf_dir), spans.word_spans(docs(spark, sf_dir).select("doc_id", "text")))
    return o.withColumns({"x": F.round("x", 6), "width": F.round("width", 6)})


@query(f"""WITH {_SPANS}, {_CITES}, h AS (SELECT c.doc_id, cite_id, page, x, y, row_number() OVER (PARTITION BY c.doc_id, cite_id ORDER BY pos) AS r FROM cites c JOIN spans s ON c.doc_id = s.doc_id AND c_start >= start_char AND c_start <= end_char)
SELECT c.doc_id, c.cite_id, coalesce(page, 1) AS page, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM cites c LEFT JOIN (SELECT * FROM h WHERE r = 1) h ON h.doc_id = c.doc_id AND h.cite_id = c.cite_id""")
def j6_first_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.first_at(_cites(spark, sf_dir), spans.word_spans(docs(spark, sf_dir).select("doc_id", "text")))


@query(f"WITH {_SPANS} SELECT doc_id, t AS term, min(pos) AS pos FROM spans, (SELECT unnest(['THE', 'tion', 'und']) AS t) x WHERE contains(lower(text), lower(t)) GROUP BY doc_id, t")
def j8_first_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "text")
    return spans.first_containing(d.select("doc_id", F.explode(F.array(*map(F.lit, ("THE", "tion", "und")))).alias("term")), spans.word_spans(d))


@query(f"WITH {_SPANS}, {_CITES} SELECT c.doc_id, cite_id, pos FROM cites c JOIN spans s ON c.doc_id = s.doc_id AND start_char >= c_start AND end_char <= c_end WHERE contains(lower(text), 'er')")
def j7_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.refine(_cites(spark, sf_dir).withColumn("term", F.lit("Er")), spans.word_spans(docs(spark, sf_dir).select("doc_id", "text")))


@query(f"WITH {_SPANS} SELECT s.doc_id, page AS rect_id, pos FROM spans s WHERE x < 300 AND x + width > 100 AND y < (page - 1) * 150 + 60 AND y + height > (page - 1) * 150 + 24")
def j13_in_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "text")
    # a rectangle on each page; y counts on from page to page
    pages = d.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.length("text") / 1000) + 1)).alias("page"))
    r = pages.selectExpr("doc_id", "page AS rect_id", "page", "100 AS x0", "(page - 1) * 150 + 24 AS y0", "300 AS x1", "(page - 1) * 150 + 60 AS y1")
    return spans.in_rectangle(spans.word_spans(d), r)


_ITEMS = """items AS (SELECT doc_id, CAST(i AS INT) AS page, generate_subscripts(string_split(line, ' '), 1) - 1 AS pos, unnest(string_split(line, ' ')) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + (page - 1) * 2 AS start_char FROM items WHERE text <> '')"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("page"), F.posexplode(F.split("line", " ")).alias("pos", "text"))


@query(f"WITH {_ITEMS} SELECT doc_id, page, pos::INT AS pos, start_char, start_char + length(text) AS end_char FROM placed")
def w3_page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages; offsets count the blank behind each item and the gap behind each page."""
    return spans.item_offsets(_items(spark, sf_dir)).drop("text")


@query(f"WITH {_SPANS} SELECT doc_id, page, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM spans GROUP BY doc_id, page")
def a15_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.envelope(spans.word_spans(docs(spark, sf_dir).select("doc_id", "text")), "doc_id", "page")


@query(f"WITH {_SPANS}, n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS t2 FROM spans) SELECT doc_id, pos FROM n WHERE contains(lower(text), 'th') AND contains(lower(t2), 'er')")
def j11_phrase_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.phrase_starts(spans.word_spans(docs(spark, sf_dir).select("doc_id", "text")), ["Th", "er"])


_LINES = f"lines AS (SELECT doc_id, unnest(string_split({rel.SECTIONED}, chr(10))) AS text, generate_subscripts(string_split({rel.SECTIONED}, chr(10)), 1) - 1 AS pos FROM documents)"
_HEAD = "CASE WHEN regexp_matches(t, '(?i)(table)\\s*\\d.*[:.]?\\s*$') THEN 'table' WHEN regexp_matches(t, '(?i)(figure|fig\\.?)\\s*\\d.*[:.]?\\s*$') THEN 'figure' " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{n}'" for n, p in spans.HEADERS) + " END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.expr(rel.SECTIONED), "\n")).alias("pos", "text"))


@query(f"""WITH {_LINES}, h AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM lines), s AS (SELECT doc_id, pos, {_HEAD} AS sec FROM h),
c AS (SELECT doc_id, coalesce(last_value(sec IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'unknown') AS section FROM s) SELECT doc_id, section, count(*) AS n FROM c GROUP BY doc_id, section""")
def w4_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.carry_sections(_lines(spark, sf_dir)).groupBy("doc_id", "section").agg(F.count("*").alias("n"))


@query(f"""WITH {_LINES}, h AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, max(pos) OVER (PARTITION BY doc_id) + 1 AS n FROM lines), s AS (SELECT doc_id, pos, n, {_HEAD} AS section FROM h)
SELECT doc_id, section, pos::INT AS start_pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), n)::INT AS end_pos FROM s WHERE section IS NOT NULL""")
def w4_section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.section_ranges(_lines(spark, sf_dir))


# --- tables, references, histograms, tables of files ---------------------------------

_MD = "concat('Table 1', chr(10), '| Age | N | GCS |', chr(10), '|---|---|---|', chr(10), '| ', CAST(c_custkey % 80 AS STRING), '.5 ± 3 | ', CAST(c_custkey % 50 AS STRING), ' pts |  |', chr(10), '| none | 7 | 9.5 |')"


@query("""WITH r AS (SELECT c_custkey AS doc_id FROM customer)
SELECT doc_id, 0 AS table_idx, 'population.age.mean' AS field, (doc_id % 80 + 0.5)::DOUBLE AS value, concat(CAST(doc_id % 80 AS STRING), '.5 ± 3') AS source_text FROM r
UNION ALL SELECT doc_id, 0, 'population.age.sd', 3.0::DOUBLE, concat(CAST(doc_id % 80 AS STRING), '.5 ± 3') FROM r
UNION ALL SELECT doc_id, 0, 'population.sampleSize', (doc_id % 50)::DOUBLE, concat(CAST(doc_id % 50 AS STRING), ' pts') FROM r
UNION ALL SELECT doc_id, 0, 'population.sampleSize', 7.0::DOUBLE, '7' FROM r UNION ALL SELECT doc_id, 0, 'population.gcs.median', 9.5::DOUBLE, '9.5' FROM r""")
def f26_f30_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.map_fields(tables.parse_markdown(table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{_MD} AS text")))


_REF = ("CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(p_brand, ', A') END AS authors", "p_name AS title", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS journal", "CAST(1950 + p_size AS INT) AS year", "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS STRING) ELSE NULL END AS volume", "CASE WHEN p_partkey % 4 = 0 THEN '3' ELSE NULL END AS issue", "'10-19' AS pages", "CASE WHEN p_partkey % 7 = 0 THEN '10.1/x' ELSE NULL END AS doi")


@query(f"""WITH r AS (SELECT p_partkey AS ref_id, {", ".join(_REF)} FROM part), q AS (SELECT *, round(CASE WHEN authors <> '' THEN 0.25 ELSE 0 END + 0.25 + CASE WHEN journal IS NOT NULL THEN 0.20 ELSE 0 END + 0.15 + CASE WHEN doi IS NOT NULL THEN 0.15 ELSE 0 END, 6)::DOUBLE AS quality FROM r)
SELECT ref_id, quality, quality >= 0.85 AS valid, concat_ws('. ', nullif(authors, ''), title, concat(coalesce(journal, ''), '. ', CAST(year AS STRING), CASE WHEN volume IS NOT NULL THEN concat(';', volume, CASE WHEN issue IS NOT NULL THEN '(3)' ELSE '' END, ':10-19') ELSE '' END)) || '.' AS line FROM q""")
def a20_f24_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "part").selectExpr("p_partkey AS ref_id", *_REF)
    q = F.round(export.citation_quality(), 6)
    return r.select("ref_id", q.alias("quality"), (q >= 0.85).alias("valid"), export.vancouver().alias("line"))


@query("SELECT coalesce(event_type, 'other') AS kind, count(*) AS n, count(*) FILTER (value > 50) AS n_full FROM events GROUP BY 1")
def a2_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("other")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_full"))


@query(f"{_STUDIES} SELECT study_id, 'new' AS author FROM studies WHERE study_id % 3 = 0 UNION ALL SELECT study_id, first_author FROM studies WHERE study_id % 3 <> 0 AND study_id % 2 = 0")
def snk3_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    new = s.where("study_id % 3 = 0").selectExpr("study_id", "'new' AS author")
    return export.upsert(s.where("study_id % 2 = 0").selectExpr("study_id", "first_author AS author"), new, ["study_id"])


@query(f"{_STUDIES}, t AS (SELECT study_id, CASE WHEN study_id % 3 = 0 THEN 'phase1' WHEN study_id % 3 = 1 THEN 'phase2' ELSE 'phase3' END AS phase FROM studies) SELECT s.study_id, total FROM studies s SEMI JOIN (SELECT * FROM t WHERE phase = 'phase2') p ON p.study_id = s.study_id")
def p9_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rel.studies(spark, sf_dir)
    return s.join(s.where("study_id % 3 = 1").select("study_id"), "study_id", "left_semi").select("study_id", "total")


_SESSION = "SELECT user_id, event_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events"


@query(f"WITH s AS ({_SESSION}), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, k")
def st2_quiet_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events that a quiet period of 30 minutes ends, as session windows."""
    from ..streaming import quiet

    return quiet.bursts(table(spark, sf_dir, "events"), "30 minutes").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("SELECT user_id, max_by(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY user_id")
def st3_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))
