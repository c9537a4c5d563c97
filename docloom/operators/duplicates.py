"""Studies that may report the same patients: names that nearly agree, periods that overlap, ranked verdicts.

Names are compared by edit distance, but only those of which the longer has one of k + 1 pieces of the shorter, at nearly its place. That loses nothing: the pieces don't overlap, so k edits
leave one of them whole, and move it by k characters at most. Where they lie is free, so the rarest are taken. The work is done on distinct names; a name that a third of all studies bear is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Characters of a piece, and of those of a name of PER_EDIT characters, which is too short for two of them.
PIECE, SHORT_PIECE = 4, 3
#: Counts of pieces are kept by hash, so that they go to all tasks; they only say which pieces are taken.
BUCKETS = 1 << 16
#: Above any place in a name.
FAR = 1 << 24
#: A name of n characters may differ by n // PER_EDIT edits.
PER_EDIT = 5


def edits(name: Column) -> Column:
    return F.floor(F.length(name) / PER_EDIT).cast("int")


def _pairs_of_grams(padded: Column) -> Column:
    """The pairs of characters of a text as bits of a long. One edit changes at most two of a name's pairs into two others, so names within k edits differ in 4 * k bits at most."""
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))
    return F.aggregate(grams, F.lit(0).cast("long"), lambda bits, g: bits.bitwiseOR(bit(g)))


def similar_names(names: DataFrame) -> DataFrame:
    """(x, y, distance): all ordered pairs of different names within the edits that the shorter one may have, and each name with itself. names: (name), null and repeated ones allowed."""
    one = names.where("name IS NOT NULL").select("name").distinct()
    padded = F.concat(F.lit("\x01"), F.col("name"), F.lit("\x02"))
    # names without edits to spare equal nothing but themselves; as the longer of a pair they don't count either
    rows = one.where(F.length("name") >= PER_EDIT).select("name", padded.alias("padded"), edits(F.col("name")).alias("k"), F.length("name").alias("n"), _pairs_of_grams(padded).alias("bits"))
    size = F.when(F.col("n") == PER_EDIT, SHORT_PIECE).otherwise(PIECE)
    cut = lambda at, size: F.substring("padded", at, size)
    bucket = lambda piece: F.pmod(F.xxhash64(piece), F.lit(BUCKETS))
    # all pieces of the longer names: of the short kind only where the shorter may have PER_EDIT characters
    every = lambda size: F.transform(F.sequence(F.lit(1), F.col("n") + 3 - size), lambda i: F.struct(i.alias("at"), cut(i, F.lit(size)).alias("piece")))
    near_short = F.when(F.col("n") <= PER_EDIT + 1, every(SHORT_PIECE)).otherwise(F.array().cast("array<struct<at: int, piece: string>>"))
    longer = rows.select("name", "n", "bits", F.inline(F.concat(every(PIECE), near_short)))
    often = longer.groupBy(bucket(F.col("piece")).alias("bucket")).agg(F.count("*").alias("often"))
    # k + 1 pieces side by side, from each place where they fit; those that are met least are taken, which is one number per name: how often, then the first place
    places = F.sequence(F.lit(1), F.col("n") + 3 - size * (F.col("k") + 1))
    tried = rows.select("name", "padded", "k", size.alias("size"), F.explode(places).alias("first")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    tried = tried.select("name", "first", bucket(cut(F.col("first") + F.col("i") * F.col("size"), F.col("size"))).alias("bucket"))
    met = tried.join(F.broadcast(often), "bucket").groupBy("name", "first").agg(F.sum("often").alias("often"))
    best = met.groupBy("name").agg(F.min(F.col("often") * FAR + F.col("first")).alias("best"))
    at = (F.pmod("best", F.lit(FAR)) + F.col("i") * size).cast("int")
    shorter = rows.join(best, "name").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).select("name", "n", "k", "bits", at.alias("at"), cut(at, size).alias("piece"))
    a, b = shorter.alias("a"), longer.alias("b")
    order = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.name") < F.col("b.name")))
    near = (F.abs(F.col("a.at") - F.col("b.at")) <= F.col("k")) & (F.col("b.n") - F.col("a.n") <= F.col("k")) & order & (F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= 4 * F.col("k"))
    pairs = a.join(b, (F.col("a.piece") == F.col("b.piece")) & near).select(F.col("a.name").alias("x"), F.col("b.name").alias("y"), "k").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("x", "y")).where(F.col("distance") <= F.col("k")).select("x", "y", "distance")
    both = pairs.select(F.inline(F.array(F.struct("x", "y", "distance"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "distance"))))
    return both.unionByName(one.select(F.col("name").alias("x"), F.col("name").alias("y"), F.lit(0).alias("distance")))


def duplicate_studies(studies: DataFrame) -> DataFrame:
    """(a, b, author_distance, centre_distance, shared_years, score, confidence), a < b: pairs whose first authors and centres nearly agree, case and signs aside, and whose periods overlap.

    studies: (study_id, author, centre, year_from, year_to), one row per id; a study without one of these takes part in no pair. score: the mean of what share of the author's characters, of the centre's, and of the years of either period agrees.
    confidence: High for equal names and at least half of the years, Medium for two edits at most, else Low.
    """
    full = "study_id IS NOT NULL AND author <> '' AND centre <> '' AND year_from <= year_to"
    s = studies.select("study_id", tx.normalise(F.col("author")).alias("author"), tx.normalise(F.col("centre")).alias("centre"), "year_from", "year_to").where(full)
    authors, centres = (similar_names(s.select(F.col(c).alias("name"))).select(F.col("x").alias(c), F.col("y").alias(f"other_{c}"), F.col("distance").alias(f"{c}_distance")) for c in ("author", "centre"))
    # an author of a single study meets none by the same name; most are such, so they go before the studies are dealt to centres
    alone = s.groupBy("author").count().where("count = 1").select("author", F.col("author").alias("other_author"))
    asked = s.join(authors.join(alone, ["author", "other_author"], "left_anti"), "author").join(centres, "centre")
    other = s.select(F.col("study_id").alias("b"), F.col("author").alias("other_author"), F.col("centre").alias("other_centre"), F.col("year_from").alias("from_b"), F.col("year_to").alias("to_b"))
    pairs = asked.join(other, ["other_author", "other_centre"]).where("study_id < b AND year_from <= to_b AND from_b <= year_to")
    shared = F.least("year_to", "to_b") - F.greatest("year_from", "from_b") + 1
    share = shared / (F.greatest("year_to", "to_b") - F.least("year_from", "from_b") + 1)
    alike = lambda c: 1 - F.col(f"{c}_distance") / F.greatest(F.length(c), F.length(f"other_{c}"))
    off = F.col("author_distance") + F.col("centre_distance")
    confidence = F.when((off == 0) & (share >= 0.5), "High").when(off <= 2, "Medium").otherwise("Low")
    return pairs.select(F.col("study_id").alias("a"), "b", "author_distance", "centre_distance", shared.cast("int").alias("shared_years"), ((alike("author") + alike("centre") + share) / 3).alias("score"), confidence.alias("confidence"))


def assessment(studies: DataFrame, pairs: DataFrame) -> DataFrame:
    """(study_id, is_duplicate, duplicate_of, confidence, n_candidates): for every study, the earlier one (by id) that it most likely repeats: by score, then the smallest id."""
    best = pairs.groupBy(F.col("b").alias("study_id")).agg(F.count("*").alias("n_candidates"), F.max_by(F.struct("a", "confidence"), F.struct("score", -F.col("a"))).alias("m"))
    out = studies.select("study_id").join(best, "study_id", "left")
    return out.select("study_id", F.col("m").isNotNull().alias("is_duplicate"), F.col("m.a").alias("duplicate_of"), F.col("m.confidence").alias("confidence"), F.coalesce("n_candidates", F.lit(0).cast("long")).alias("n_candidates"))
