"""Tables in text: markdown to rows, rows to typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def cells(line: Column, keep_empty: bool = True) -> Column:
    """Cells of a markdown line, trimmed. keep_empty=False drops empty cells and dashes, so that later cells move left."""
    inner = F.regexp_replace(tx.strip(line), r"^\||\|$", "") if keep_empty else line
    out = F.transform(F.split(inner, r"\|"), tx.strip)
    return out if keep_empty else F.filter(out, lambda c: (c != "") & ~c.rlike("^-+$"))


def parse_markdown(docs: DataFrame, keep_empty: bool = True) -> DataFrame:
    """(doc_id, table_idx, headers, rows, kind) of the markdown tables in (doc_id, text): runs of two or more lines in pipes, the last one with or without a line end."""
    blocks = F.regexp_extract_all(F.concat(F.col("text"), F.lit("\n")), F.lit(r"((?:\|[^\n]+\|\n)+)"), F.lit(1))
    lines = F.transform(blocks, lambda b: F.filter(F.split(b, "\n"), lambda x: tx.strip(x) != ""))
    tables = F.filter(lines, lambda x: F.size(x) >= 2)
    one = docs.select("doc_id", F.posexplode(tables).alias("table_idx", "l"))
    first = F.when(F.contains(F.col("l")[1], F.lit("---")), F.lit(3)).otherwise(F.lit(2))
    head = cells(F.col("l")[0], keep_empty)
    body = F.transform(F.slice("l", first, F.size("l")), lambda x: cells(x, keep_empty))
    return one.select("doc_id", "table_idx", head.alias("headers"), body.alias("rows")).withColumn("kind", tx.table_kind(F.col("headers")))


def column_like(headers: Column, *words: str, exact: tuple[str, ...] = ()) -> Column:
    """Place (from 0) of the first header that contains one of the words or equals one of `exact`; null if none does."""
    hit = F.transform(headers, lambda h, i: F.when(F.lower(h).isin(*exact) | F.lower(h).rlike("|".join(words)), i))
    return F.try_element_at(F.array_compact(hit), F.lit(1))


def map_fields(tables: DataFrame) -> DataFrame:
    """(doc_id, table_idx, field, value double, source_text) from the rows of tables, by kind of table. Complications come from complications()."""
    t = tables.select("doc_id", "table_idx", "kind", "headers", F.explode("rows").alias("row"))
    h = F.col("headers")
    at = lambda place: F.when(place.isNotNull(), F.get("row", place))
    num = lambda text, p, g=1: F.nullif(F.regexp_extract(text, p, g), F.lit("")).try_cast("double")
    age, n, gcs = at(column_like(h, "age")), at(column_like(h, "patients", exact=("n",))), at(column_like(h, "gcs"))
    dead, mrs, hydro = at(column_like(h, "mortality", "death")), at(column_like(h, "mrs", "rankin")), at(column_like(h, "hydrocephalus"))
    pct = r"(\d+\.?\d*)\s*%"
    share = tx.round_half_up(F.try_divide(tx.fraction_part(dead, 1).cast("double"), tx.fraction_part(dead, 2).cast("double")) * 100, 1)
    joined = F.array_join("row", " ")
    flow = F.when(F.lower(joined).rlike("enrolled|included"), num(joined, r"(\d+)"))
    made = [
        ("demographics", "population.age.mean", num(age, r"(\d+\.?\d*)\s*[±+]\s*(\d+\.?\d*)"), age),
        ("demographics", "population.age.sd", num(age, r"(\d+\.?\d*)\s*[±+]\s*(\d+\.?\d*)", 2), age),
        ("demographics", "population.sampleSize", F.nullif(F.regexp_replace(n, r"\D", ""), F.lit("")).try_cast("double"), n),
        ("demographics", "population.gcs.median", num(gcs, r"(\d+\.?\d*)"), gcs),
        ("outcomes", "outcomes.mortality", F.coalesce(num(dead, pct), share), dead),
        ("outcomes", "outcomes.mRS_favorable", num(mrs, pct), mrs),
        ("baseline", "population.hydrocephalus.percentage", num(hydro, pct), hydro),
        ("flowchart", "population.sampleSize", flow, joined),
    ]
    rows = F.array_compact(F.array(*[F.when((F.col("kind") == k) & v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value"), s.alias("source_text"))) for k, f, v, s in made]))
    return t.select("doc_id", "table_idx", F.inline(rows))


def complications(tables: DataFrame) -> DataFrame:
    """(doc_id, table_idx, complications array<string>): rows of complication tables, cells joined by " - "."""
    rows = F.transform(F.filter("rows", lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")) != ""), lambda r: F.array_join(r, " - "))
    return tables.where("kind = 'complications'").select("doc_id", "table_idx", rows.alias("complications")).where(F.size("complications") > 0)
