"""Flattening of nested study records, citations as text, and file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def verifiable(value: Column, source: Column, page: Column) -> Column:
    return F.struct(value.alias("value"), source.alias("sourceText"), page.alias("pageNumber"))


def flatten_field(name: str, field: Column) -> list[Column]:
    """A verifiable field as three columns: name, name_Source, name_Page; a null field gives nulls."""
    return [field["value"].alias(name), field["sourceText"].alias(f"{name}_Source"), field["pageNumber"].alias(f"{name}_Page")]


def outcomes_text(outcomes: Column) -> Column:
    """array<struct<name, time, value>> as "name@time: value; ..."."""
    return F.array_join(F.transform(outcomes, lambda o: F.concat(o["name"], F.lit("@"), o["time"], F.lit(": "), o["value"])), "; ")


def without_duplicates(studies: DataFrame, include: bool = False) -> DataFrame:
    """Without studies flagged as duplicates, unless the confidence is Low or `include` is set. studies: with is_duplicate, dup_confidence."""
    return studies if include else studies.where(~(F.coalesce("is_duplicate", F.lit(False)) & (F.coalesce("dup_confidence", F.lit("")) != "Low")))


def citation_quality() -> Column:
    """Share of a reference that is there: authors .25, title .25, journal .20, year .15, doi .15, added in that order."""
    has = lambda c, w: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", w).otherwise(0.0)
    return F.lit(0.0) + has("authors", 0.25) + has("title", 0.25) + has("journal", 0.20) + has("year", 0.15) + has("doi", 0.15)


def vancouver() -> Column:
    """A reference as one line, from (authors, title, journal, year, volume, issue, pages); empty parts are left out."""
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    tail = F.when(some("volume").isNotNull(), F.concat(F.lit(";"), some("volume"), F.coalesce(F.concat(F.lit("("), some("issue"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(":"), some("pages")), F.lit(""))))
    journal = F.concat(F.coalesce(some("journal"), F.lit("")), F.coalesce(F.concat(F.lit(". "), some("year")), F.lit("")), F.coalesce(tail, F.lit("")))
    return F.concat(F.array_join(F.array(some("authors"), some("title"), F.nullif(journal, F.lit(""))), ". "), F.lit("."))


def bibtex() -> Column:
    """A reference as a BibTeX article, keyed by first author and year."""
    pair = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    names = (("author", some("authors")), ("title", some("title")), ("journal", some("journal")), ("year", some("year")), ("volume", some("volume")), ("number", some("issue")), ("pages", F.regexp_replace(some("pages"), "^([^-]*)-", "$1--")), ("doi", some("doi")))
    fields = F.array_compact(F.array(*[pair(n, v) for n, v in names]))
    key = F.concat(F.lower(F.split(F.col("authors"), ",")[0]), F.col("year").cast("string"))
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows in place of old ones with the same keys, which are neither null nor repeated in new."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a table, with the time they came."""
    df.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
