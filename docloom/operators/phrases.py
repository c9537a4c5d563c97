"""Key phrases of sources and the places of a response that they support.

All phrases of a response's sources go into one automaton, a trie with failure links, so each response is read once whatever the number of phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .quotes import fold


def of_sources(sources: DataFrame) -> DataFrame:
    """(response_id, idx, nth from 0, phrase): the key phrases of each source, as they come. sources: (response_id, idx from 1, text)."""
    return sources.select("response_id", "idx", F.posexplode(tx.key_phrases(F.col("text"))).alias("nth", "phrase"))


def distinct(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(phrase, n): all key phrases of a table of texts, and of how many texts."""
    return texts.select(id_col, F.explode(tx.key_phrases(F.col(text_col))).alias("phrase")).groupBy("phrase").agg(F.count_distinct(id_col).alias("n"))


def uncovered(hits: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """Those of (idx, nth, phrase, start, end), in this order, that lie within none before them.

    The farthest end of all segments that start at or before a place is kept in a tree over the starts, so a segment costs a few steps, however many there are.
    """
    starts = {x: i for i, x in enumerate(sorted({h[3] for h in hits}), 1)}
    farthest = [-1] * (len(starts) + 1)
    out = []
    for h in sorted(hits):
        i, most = starts[h[3]], -1
        while i:
            most, i = max(most, farthest[i]), i & (i - 1)
        if most >= h[4]:
            continue
        out.append(h)
        i = starts[h[3]]
        while i < len(farthest):
            farthest[i], i = max(farthest[i], h[4]), i + (i & -i)
    return out


def occurrences(responses: DataFrame, phrases: DataFrame, apart: bool = False) -> DataFrame:
    """(response_id, idx, nth, phrase, start, end): where a response has a phrase, A-Z in either case; of occurrences of one phrase that overlap, the first.

    responses: (response_id, text), one row per id; phrases: (response_id, idx, nth, phrase). A response and its phrases are one row of a task. Places count characters from 0; empty phrases occur nowhere.
    apart: an occurrence that lies within one of an earlier source, or of an earlier phrase of its source, is left out.
    """
    asked = phrases.where("phrase <> ''").groupBy("response_id").agg(F.collect_list(F.struct("idx", "nth", "phrase")).alias("phrases"))
    rows = responses.where("text IS NOT NULL").select("response_id", "text").join(asked, "response_id")
    id_type = responses.schema["response_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for batch in batches:
            out: list[tuple] = []
            for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("phrases").to_pylist())):
                who: dict[str, list[tuple[int, int, str]]] = {}
                for p in wanted:
                    who.setdefault(fold(p["phrase"]), []).append((p["idx"], p["nth"], p["phrase"]))
                automaton = ahocorasick.Automaton()
                for word in who:
                    automaton.add_word(word, word)
                automaton.make_automaton()
                upto: dict[str, int] = {}
                hits: list[tuple[int, int, str, int, int]] = []
                for last, word in automaton.iter(fold(text)):
                    start = last + 1 - len(word)
                    if start >= upto.get(word, 0):
                        upto[word] = last + 1
                        hits += [(*p, start, last + 1) for p in who[word]]
                out += [(i, *h) for h in (uncovered(hits) if apart else hits)]
            at, idx, nth, phrase, start, end = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("response_id").take(pa.array(at, pa.int64())), pa.array(idx, pa.int32()), pa.array(nth, pa.int32()), pa.array(phrase, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["response_id", "idx", "nth", "phrase", "start", "end"],
            )

    typed = rows.select("response_id", "text", F.transform("phrases", lambda p: F.struct(p["idx"].cast("int").alias("idx"), p["nth"].cast("int").alias("nth"), p["phrase"].alias("phrase"))).alias("phrases"))
    return typed.mapInArrow(run, f"response_id {id_type}, idx int, nth int, phrase string, start long, end long")


def supports(responses: DataFrame, sources: DataFrame) -> DataFrame:
    """(response_id, idx, start, end, phrase): the segments of each response that a source's key phrases support.

    Sources count in order, then their phrases; a segment that lies within one supported before is left out.
    """
    hits = occurrences(responses, of_sources(sources), apart=True)
    return hits.select("response_id", "idx", "start", "end", "phrase")


def marked(responses: DataFrame, supported: DataFrame) -> DataFrame:
    """(response_id, marked): the response with [idx] behind each supported segment, but not where a marker stands already; where several end at one place, the first source's marker. supported: as from supports()."""
    ends = supported.groupBy("response_id", "end").agg(F.min("idx").alias("idx"))
    places = ends.groupBy("response_id").agg(F.sort_array(F.collect_list(F.struct("end", "idx"))).alias("ends"))
    rows = responses.select("response_id", "text").join(places, "response_id", "left")
    piece = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    start = F.struct(F.lit("").alias("made"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        there = F.substring(F.col("text"), (x["end"] + 1).cast("int"), F.lit(5)).rlike(r"^\[\d+\]")
        mark = F.when(there, "").otherwise(F.concat(F.lit("["), x["idx"].cast("string"), F.lit("]")))
        return F.struct(F.concat(s["made"], piece(s["at"], x["end"]), mark).alias("made"), x["end"].alias("at"))

    folded = F.aggregate(F.coalesce("ends", F.array().cast("array<struct<end: bigint, idx: int>>")), start, step)
    return rows.select("response_id", "text", folded.alias("f")).select("response_id", F.concat("f.made", F.substring(F.col("text"), (F.col("f.at") + 1).cast("int"), F.length("text"))).alias("marked"))


def supported_share(responses: DataFrame, supported: DataFrame) -> DataFrame:
    """(response_id, n_supports, n_sources, share): how many segments of a response are supported, by how many sources, and what share of its characters."""
    w = Window.partitionBy("response_id").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), before), F.lit(0))
    per = supported.withColumn("fresh", fresh).groupBy("response_id").agg(F.count("*").alias("n_supports"), F.count_distinct("idx").alias("n_sources"), F.sum("fresh").alias("covered"))
    rows = responses.select("response_id", F.length("text").alias("n")).join(per, "response_id", "left").fillna(0, ["n_supports", "n_sources", "covered"])
    return rows.select("response_id", "n_supports", "n_sources", F.when(F.col("n") > 0, F.col("covered") / F.col("n")).otherwise(0.0).alias("share"))
