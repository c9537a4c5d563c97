"""Several sources of one record: conflicts, resolution, merge; and harmonised outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Rank of each type of source.
RANKS = {"erratum": 4, "supplement": 3, "main-paper": 2, "main": 2, "protocol": 1, "registry": 1}


def rank_of(source: Column) -> Column:
    return F.coalesce(*[F.when(source == name, F.lit(r)) for name, r in RANKS.items()], F.lit(0))


def conflicts(values: DataFrame) -> DataFrame:
    """(study_id, field, n_values, n_sources): fields for which sources have different values. values: (study_id, field, source, pos, value)."""
    per = values.where("value IS NOT NULL").groupBy("study_id", "field").agg(F.count_distinct("value").alias("n_values"), F.count("*").alias("n_sources"))
    return per.where("n_values > 1")


def resolve(values: DataFrame) -> DataFrame:
    """(study_id, field, value, source): the value of the highest ranked source, the first given at a tie."""
    best = F.max_by(F.struct("value", "source"), F.struct(rank_of(F.col("source")), -F.col("pos")))
    return values.where("value IS NOT NULL").groupBy("study_id", "field").agg(best.alias("b")).select("study_id", "field", "b.value", "b.source")


def merge(values: DataFrame) -> DataFrame:
    """(study_id, field, value): sources laid over each other from low rank to high, in input order within a rank; the last value that isn't empty stays."""
    full = values.where(F.coalesce("value", F.lit("")) != "")
    return full.groupBy("study_id", "field").agg(F.max_by("value", F.struct(rank_of(F.col("source")), "pos")).alias("value"))


def fuse(values: DataFrame) -> DataFrame:
    """(study_id, n_sources, n_conflicts, strategy, modules): how each record came about."""
    per = values.groupBy("study_id").agg(F.count_distinct("pos").alias("n_sources"), F.sort_array(F.collect_set("source")).alias("modules"))
    n = conflicts(values).groupBy("study_id").agg(F.count("*").alias("n_conflicts"))
    how = F.when(F.col("n_sources") == 1, "single").when(F.col("n_conflicts") > 0, "highest-quality").otherwise("merged")
    return per.join(n, "study_id", "left").fillna(0, ["n_conflicts"]).withColumn("strategy", how)


def harmonise(follow_up: Column, mortality: Column) -> Column:
    """struct<days, standard_days, mortality, converted, confidence> from free texts; without a follow-up time all but confidence are null."""
    days = tx.parse_days(follow_up)
    days = F.when(days != 0, days)
    std = tx.standard_days(days)
    moved = F.coalesce(days != std, F.lit(False))
    return F.struct(days.alias("days"), std.alias("standard_days"), F.when(days.isNotNull(), tx.parse_mortality(mortality)).alias("mortality"), moved.alias("converted"), F.when(moved, "medium").otherwise("high").alias("confidence"))


def duplicate_candidates(studies: DataFrame) -> DataFrame:
    """Pairs of studies that may report the same patients: same centre (ignoring case and signs) and overlapping periods; never all pairs.

    studies: (study_id, centre, year_from, year_to). Centres are the blocks of the join; Spark splits one that holds too many rows. Returns (a, b) with a < b.
    """
    s = studies.withColumn("block", tx.normalise(F.col("centre")))
    a, b = s.alias("a"), s.alias("b")
    on = (F.col("a.block") == F.col("b.block")) & (F.col("a.study_id") < F.col("b.study_id")) & (F.col("a.year_from") <= F.col("b.year_to")) & (F.col("b.year_from") <= F.col("a.year_to"))
    return a.join(b, on).select(F.col("a.study_id").alias("a"), F.col("b.study_id").alias("b"))


def patients(n: DataFrame, mean_age: float, sd_age: float, daily_risk: float, days: int, seed: int) -> DataFrame:
    """Synthetic patients for (study_id, n): normal ages, exponential times to death, drawn from a hash of (study, patient, seed), so reruns agree."""
    one = n.select("study_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("patient"))
    u = lambda k: (F.pmod(F.xxhash64("study_id", "patient", F.lit(seed), F.lit(k)), F.lit(2**52)) + 0.5) / float(2**52)
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    t = -F.log(u(3)) / daily_risk
    return one.select("study_id", "patient", F.greatest(F.lit(0.0), mean_age + sd_age * z).alias("age"), F.least(t, F.lit(float(days))).alias("time"), (t <= days).alias("died"))
