"""Records whose fields are reached by path, and texts made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaf_paths(schema: T.StructType, before: str = "") -> list[str]:
    """Dotted paths of a schema's leaves, in order; arrays and maps are leaves."""
    out = []
    for f in schema.fields:
        path = f"{before}{f.name}"
        out += leaf_paths(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [path]
    return out


def long_form(records: DataFrame, id_col: str = "study_id") -> DataFrame:
    """(study_id, path, value string): one row per leaf with a value; structures are written as JSON."""
    pairs = []
    for path in leaf_paths(records.schema):
        if path != id_col:
            kind = records.select(path).schema[0].dataType
            value = F.to_json(path) if isinstance(kind, T.ArrayType | T.MapType) else F.col(path).cast("string")
            pairs.append(F.struct(F.lit(path).alias("path"), value.alias("value")))
    return records.select(F.col(id_col).alias("study_id"), F.inline(F.array(*pairs))).where("value IS NOT NULL")


def get_path(record: Column, path: str) -> Column:
    """The value at a dotted path of a struct; null where a part on the way is null."""
    for name in path.split("."):
        record = record[name]
    return record


def set_path(record: Column, path: str, value: Column) -> Column:
    """The struct with the value at a dotted path, whose last part is made if it isn't there."""
    return record.withField(path, value)


def set_field(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """Long rows (study_id, path, value, ai: whether a model wrote it) after changes of the same form, the last per path (by seq) taking effect; paths that weren't there are added."""
    last = changes.groupBy("study_id", "path").agg(F.max_by(F.struct("value", "ai"), "seq").alias("c")).select("study_id", "path", "c.*")
    return fields.join(last, ["study_id", "path"], "left_anti").select("study_id", "path", "value", "ai").unionByName(last)


def provenance(fields: DataFrame) -> DataFrame:
    """(study_id, ai_fields: paths that a model wrote, in order)."""
    return fields.groupBy("study_id").agg(F.sort_array(F.collect_set(F.when(F.col("ai"), F.col("path")))).alias("ai_fields"))


def plain(records: DataFrame, texts: list[str], numbers: list[str], id_col: str = "study_id") -> DataFrame:
    """Some columns, falsy values as "" or 0."""
    return records.select(id_col, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts], *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers])


def subset(records: DataFrame, wanted: list[str], id_col: str = "study_id") -> DataFrame:
    """The wanted columns that there are, and the names of all columns as `available`."""
    there = [c for c in records.columns if c in set(wanted) and c != id_col]
    return records.select(id_col, *there, F.array(*map(F.lit, sorted(records.columns))).alias("available"))


def without(records: DataFrame, heavy: list[str]) -> DataFrame:
    """Without columns that only the store needs."""
    return records.drop(*heavy)


def large_figures(figures: DataFrame, least: int = 100) -> DataFrame:
    """Figures of at least `least` in width and height: (…, width, height)."""
    return figures.where((F.col("width") >= least) & (F.col("height") >= least))


def highlight_count(highlights: Column) -> Column:
    """How many highlights a map of lists holds."""
    return F.aggregate(F.map_values(highlights), F.lit(0), lambda n, x: n + F.size(x))


def given_table(data: Column, headers: Column, caption: Column, number: Column) -> Column:
    """struct<title, headers, rows> of a table, array<array<string>>: its headers if it has any, else the first row; titled by its caption or its number."""
    first = F.when(F.size(data) > 0, F.get(data, F.lit(0))).otherwise(F.array().cast("array<string>"))
    rest = F.slice(data, F.lit(2), F.greatest(F.size(data) - 1, F.lit(0)))
    title = F.coalesce(F.nullif(caption, F.lit("")), F.concat(F.lit("Table "), number.cast("string")))
    return F.struct(title.alias("title"), F.coalesce(headers, first).alias("headers"), F.when(headers.isNotNull(), data).otherwise(rest).alias("rows"))


def image_kind(kind: Column) -> Column:
    """Kind of figure from the kind of image: charts are taken for bar charts."""
    return F.when(kind == "chart", "bar-chart").otherwise("other")


# Colour of a highlight.
YELLOW = (255.0, 255.0, 0.0, 0.3)


def annotation(x: Column, y: Column, width: Column, height: Column) -> Column:
    """struct<rect, color> of a highlight, in coordinates that count upwards."""
    return F.struct(F.array(x, y - height, x + width, y).alias("rect"), F.array(*map(F.lit, YELLOW)).alias("color"))


def verification(label: str, value: Column, source: Column, page: Column) -> Column:
    """One line of a report: a field, and below it the quote that shows it; "Not Found" for no value."""
    where = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" (p."), page.cast("string"), F.lit(")"))).otherwise("")
    quote = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit('\n  > "'), source, F.lit('"'), where)).otherwise("")
    return F.concat(F.lit(f"- **{label}**: "), F.coalesce(value.cast("string"), F.lit("Not Found")), quote, F.lit("\n"))


def display(citations: DataFrame) -> DataFrame:
    """(response_id, shown): a numbered line per citation (response_id, id, page, section, source_text), in order of id."""
    place = F.when(F.col("page").isNotNull(), F.concat(F.lit("Page "), F.col("page").cast("string"), F.coalesce(F.concat(F.lit(", "), F.col("section")), F.lit("")))).otherwise(F.coalesce("section", F.lit("Source")))
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), place, F.lit(': "'), F.col("source_text"), F.lit('"'))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n")
    return citations.groupBy("response_id").agg(F.concat(F.lit("\n\nSources:\n"), lines).alias("shown"))


def html_rows(fields: DataFrame) -> DataFrame:
    """(study_id, html): a table of a study's fields in order of path, escaped. fields: (study_id, path, value, source)."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    row = F.concat(F.lit("<tr><td>"), safe(F.col("path")), F.lit("</td><td>"), safe(F.col("value")), F.lit("</td><td>"), safe(F.col("source")), F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", row.alias("row")))), lambda x: x["row"]), "\n")
    return fields.groupBy("study_id").agg(F.concat(F.lit("<table>\n"), rows, F.lit("\n</table>")).alias("html"))
