"""Records of any shape: fields found in JSON data by path, records laid over each other and rebuilt, reports of all their fields.

Records are (id, JSON text). Paths come from the data, not from a schema: values are VARIANT, and every level of nesting is one generator in the same stage, so finding the fields of
a table is one scan without a shuffle. Paths are arrays of keys, so keys may hold dots; dotted() writes them as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import escape_html


def levels(records: DataFrame, data_col: str = "data") -> int:
    """The deepest nesting of objects and arrays in the column; strings don't count. One number reaches the driver."""
    bare = F.regexp_replace(F.regexp_replace(data_col, r"\\.", ""), '"[^"]*"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[{}\[\]]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(seen: Column, mark: Column) -> Column:
        now = seen["now"] + F.when(mark.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(seen["most"], now).alias("most"))

    return records.agg(F.max(F.aggregate(marks, start, step)["most"])).first()[0] or 0


def kind(value: Column) -> Column:
    """"{" for objects, "[" for arrays, else something else."""
    return F.left(F.to_json(value), F.lit(1))


def holds(value: Column, *keys: str) -> Column:
    """Whether an object has all these keys, null values included; null for null."""
    there = [F.try_variant_get(value, f"$.{k}", "variant").isNotNull() for k in keys]
    return (kind(value) == "{") & F.array_min(F.array(*there))


def walk(records: DataFrame, id_col: str = "study_id", data_col: str = "data", arrays: bool = False, leaf: tuple[str, ...] = (), depth: int | None = None) -> DataFrame:
    """(id_col, path array<string>, value variant): one row per leaf of each record.

    Leaves are all but objects; with `arrays`, arrays are opened too, their elements' keys being places from 0; objects that have all keys of `leaf` stay whole. Empty objects (and opened empty arrays) have no leaves.
    Text that isn't JSON, null, and data that is no object has none either. depth: levels to open, found from the data where None.
    """
    spark = records.sparkSession
    depth = levels(records, data_col) if depth is None else depth
    rows = records.select(id_col, F.array().cast("array<string>").alias("path"), F.try_parse_json(data_col).alias("value")).where(kind(F.col("value")) == "{")
    for _ in range(depth):
        shut = F.coalesce(holds(F.col("value"), *leaf), F.lit(False)) if leaf else F.lit(False)
        nested = kind(F.col("value")).isin(["{", "["] if arrays else ["{"])
        rows = rows.withColumn("open", F.when(nested & ~shut, F.col("value"))).alias("r").lateralJoin(spark.tvf.variant_explode_outer(F.col("r.open").outer()).alias("e"))
        step = F.coalesce(F.col("e.key"), F.col("e.pos").cast("string"))
        path = F.when(F.col("e.pos").isNotNull(), F.array_append("r.path", step)).otherwise(F.col("r.path"))
        value = F.when(F.col("e.pos").isNotNull(), F.col("e.value")).otherwise(F.col("r.value"))
        rows = rows.where(F.col("r.open").isNull() | F.col("e.pos").isNotNull()).select(f"r.{id_col}", path.alias("path"), value.alias("value"))
    return rows.where(F.size("path") > 0)


def dotted(path: Column) -> Column:
    return F.array_join(path, ".")


def text(value: Column) -> Column:
    """A value as text: strings as they are, objects and arrays as JSON, JSON's null as null."""
    return F.when(~F.is_variant_null(value), value.cast("string"))


def found(records: DataFrame, id_col: str = "study_id", data_col: str = "data") -> DataFrame:
    """(path, n): every dotted path that any record has, and in how many records."""
    return walk(records, id_col, data_col).groupBy(dotted(F.col("path")).alias("path")).agg(F.count_distinct(id_col).alias("n"))


#: Fixed: what a field with evidence is called by.
VALUE, SOURCE = "value", "sourceText"


def verifiable(records: DataFrame, id_col: str = "study_id", data_col: str = "data") -> DataFrame:
    """(id_col, path, value, source): the fields that state a value and where it comes from, wherever they are, in arrays too."""
    leaves = walk(records, id_col, data_col, arrays=True, leaf=(VALUE, SOURCE))
    part = lambda k: text(F.try_variant_get("value", f"$.{k}", "variant"))
    return leaves.where(holds(F.col("value"), VALUE, SOURCE)).select(id_col, dotted(F.col("path")).alias("path"), part(VALUE).alias(VALUE), part(SOURCE).alias("source"))


def unsupported(fields: DataFrame, texts: DataFrame, id_col: str = "study_id", least: int = 10, quote: int = 30) -> DataFrame:
    """(id_col, path, severity, message): fields, as from verifiable(), with no quote or a short one, and those whose quote's first characters the study's text lacks. texts: (id_col, text); where there is none, only the first is judged."""
    rows = fields.join(texts.select(id_col, "text"), id_col, "left")
    short = F.length(F.coalesce("source", F.lit(""))) < least
    absent = (F.coalesce("text", F.lit("")) != "") & ~F.contains(F.col("text"), F.left("source", F.lit(quote)))
    weak = F.concat(F.lit("Missing or incomplete source quote for "), F.col("path"), F.lit('. Value: "'), F.coalesce("value", F.lit("null")), F.lit('"'))
    wrong = F.concat(F.lit("Source quote not found in PDF text for "), F.col("path"), F.lit(". Possible hallucination."))
    return rows.where(short | absent).select(id_col, "path", F.when(short, "WARNING").otherwise("CRITICAL").alias("severity"), F.when(short, weak).otherwise(wrong).alias("message"))


def _read_at(records: DataFrame, fields: list[str], data_col: str) -> tuple[DataFrame, dict[str, str]]:
    """records with a text column per path, and those columns' names. Each step is a column that the next one names more than once, so that the optimizer keeps it: data is parsed once a row."""
    names = {f: f"_at{i}" for i, f in enumerate(dict.fromkeys(fields))}
    rows = records.withColumn("_json", F.try_parse_json(data_col))
    rows = rows.withColumns({n: F.try_variant_get("_json", f"$.{f}", "variant") for f, n in names.items()})
    rows = rows.withColumns({n: F.when(holds(F.col(n), VALUE), F.try_variant_get(n, f"$.{VALUE}", "variant")).otherwise(F.col(n)) for n in names.values()})
    return rows.withColumns({n: text(F.col(n)) for n in names.values()}), names


def values_at(records: DataFrame, fields: list[str], id_col: str = "study_id", data_col: str = "data") -> DataFrame:
    """(id_col, fields map<string, string>): what stands at some dotted paths of each record, as text; of a field with evidence, its value. What isn't there is missing from the map; one pass, no shuffle."""
    rows, names = _read_at(records, fields, data_col)
    pairs = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(n).alias("value"))) for f, n in names.items()]))
    return rows.select(id_col, F.map_from_entries(pairs).alias("fields"))


def searchable(records: DataFrame, fields: list[str], least: int = 3, id_col: str = "study_id", data_col: str = "data") -> DataFrame:
    """(id_col, field, value): texts of at least `least` characters at some paths, to look for in the source."""
    rows, names = _read_at(records, fields, data_col)
    # a row per path straight from the columns; exploding a map would have it made again for a filter on its size
    rows = rows.select(id_col, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(n).alias("value")) for f, n in names.items()])))
    return rows.where(F.length("value") >= least)


def recommendations(records: DataFrame, required: list[str], sum_of: tuple[str, list[str]], id_col: str = "study_id", data_col: str = "data") -> DataFrame:
    """(id_col, recommendations array<string>): what is to be mended in a record: required fields without a value, fields with a value but no quote, a total that isn't the sum of its parts.

    sum_of: the path of the total, and those of its parts, where missing ones count 0. A record without a total has no such fault; what is no JSON object lacks all that is required.
    """
    total, parts = sum_of
    known = values_at(records, [*required, total, *parts], id_col, data_col)
    there = F.col("fields")
    missing = F.array_compact(F.array(*[F.when(there[f].isNull(), F.lit(f)) for f in required]))
    number = lambda f: F.coalesce(there[f].try_cast("double"), F.lit(0.0))
    wrong = there[total].try_cast("double") != sum((number(f) for f in parts), F.lit(0.0))
    bare = verifiable(records, id_col, data_col).where(F.col("value").isNotNull() & (F.coalesce("source", F.lit("")) == "")).groupBy(id_col).agg(F.sort_array(F.collect_list("path")).alias("bare"))
    said = [
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing critical fields: "), F.array_join(missing, ", "))),
        F.when(F.col("bare").isNotNull(), F.concat(F.lit("Add source quotes for: "), F.array_join("bare", ", "))),
        F.when(wrong, F.lit("NOS total score doesn't match sum of components - verify calculation")),
    ]
    return known.join(bare, id_col, "left").select(id_col, F.array_compact(F.array(*said)).alias("recommendations"))


def same(a: Column, b: Column) -> Column:
    """Whether two JSON texts say the same: keys in any order, arrays in order. Null (or no JSON) equals null only."""
    plain = lambda c: F.to_json(F.try_parse_json(c))
    return plain(a).eqNullSafe(plain(b))


def lay_over(leaves: DataFrame, order: list[Column], depth: int, id_col: str = "study_id") -> DataFrame:
    """The leaves of each record that stay when sources are laid over each other in this order.

    leaves: as from walk(), with what `order` needs; JSON's null and empty strings say nothing. A later leaf takes the place of an earlier one at its path, above it or below it. Level by level, top-down: at a path of that length either the last plain value stays
    or the objects laid over it since. All levels are windows over records, so rows move once.
    """
    rows = leaves.where(F.coalesce(text(F.col("value")), F.lit("")) != "").withColumn("o", F.struct(*order)).repartition(id_col)
    for n in range(1, depth + 1):
        at = Window.partitionBy(id_col, F.slice("path", 1, n))
        size = F.size("path")
        rows = rows.withColumn("plain", F.max(F.when(size == n, F.col("o"))).over(at)).withColumn("deep", F.max(F.when(size > n, F.col("o"))).over(at))
        last = (F.col("o") == F.col("plain")) & (F.col("deep").isNull() | (F.col("deep") < F.col("o")))
        over = F.col("plain").isNull() | (F.col("plain") < F.col("o"))
        rows = rows.where(F.when(size < n, True).when(size == n, last).otherwise(over)).drop("plain", "deep")
    return rows.drop("o")


def rebuild(leaves: DataFrame, depth: int, id_col: str = "study_id") -> DataFrame:
    """(id_col, data): records as JSON from (id_col, path, value), keys in order; no path may go on below another. Rows move once, as all levels are grouped within records."""
    rows = leaves.select(id_col, "path", F.to_json("value").alias("json")).repartition(id_col)
    quoted = lambda key: F.to_json(key.cast("variant"))
    for n in range(depth - 1, -1, -1):
        deep = F.size("path") > n
        member = F.when(deep, F.struct(F.element_at("path", -1).alias("key"), "json"))
        rows = rows.select(id_col, F.when(deep, F.slice("path", 1, n)).otherwise(F.col("path")).alias("path"), member.alias("member"), F.when(~deep, F.col("json")).alias("own"))
        members = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda m: F.concat(quoted(m["key"]), F.lit(":"), m["json"])), ",")
        rows = rows.groupBy(id_col, "path").agg(F.coalesce(F.first("own", ignorenulls=True), F.concat(F.lit("{"), members, F.lit("}"))).alias("json"))
    return rows.select(id_col, F.col("json").alias("data"))


def merge(sources: DataFrame, order: list[Column], id_col: str = "study_id", data_col: str = "data") -> DataFrame:
    """(id_col, data): the sources of each record laid over each other, deeply; what comes later in `order` (Columns of sources; together they should be unique in a record) wins. Records whose sources say nothing are missing."""
    depth = levels(sources, data_col)
    names = [f"_o{i}" for i in range(len(order))]
    rows = sources.select(F.struct(id_col, *[c.alias(n) for c, n in zip(order, names)]).alias("_s"), data_col)
    leaves = walk(rows, "_s", data_col, depth=depth).select(f"_s.{id_col}", *[f"_s.{n}" for n in names], "path", "value")
    return rebuild(lay_over(leaves, [F.col(n) for n in names], depth, id_col), depth, id_col)


def contributions(sources: DataFrame, keys: list[str], data_col: str = "data") -> DataFrame:
    """keys and fields: for each source, the dotted paths of its leaves, in order; sources without any have an empty list."""
    rows = sources.select(F.struct(*keys).alias("_s"), data_col)
    paths = walk(rows, "_s", data_col).groupBy("_s").agg(F.array_sort(F.collect_list(dotted(F.col("path")))).alias("fields"))
    out = rows.select("_s").join(paths, "_s", "left").select("_s.*", "fields")
    return out.withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))


def report(records: DataFrame, highlights: DataFrame, title: str, id_col: str = "study_id", data_col: str = "data") -> DataFrame:
    """(id_col, n_fields, n_evidence, html): a page per record, with a table of all fields below its sections and a card per highlight.

    Fields are found at any depth, in order of path: one that has a value is a row with its source, any other leaf a row of two cells; arrays are written as JSON. What stands outside of sections is left out.
    highlights: (id_col, page, label, text), shown in order of page, label and text. All texts are escaped. A record without fields still has a page; one that isn't in records has none.
    """
    safe = lambda c: escape_html(F.coalesce(c, F.lit("N/A")))
    leaves = walk(records, id_col, data_col, leaf=(VALUE,)).where(F.size("path") > 1)
    part = lambda k: text(F.try_variant_get("value", f"$.{k}", "variant"))
    name = F.concat(F.lit("<tr><td><strong>"), safe(dotted(F.col("path"))), F.lit("</strong></td>"))
    stated = F.concat(name, F.lit("<td>"), safe(part(VALUE)), F.lit('</td><td class="source">'), safe(part(SOURCE)), F.lit("</td></tr>"))
    row = F.when(holds(F.col("value"), VALUE), stated).otherwise(F.concat(name, F.lit('<td colspan="2">'), safe(text(F.col("value"))), F.lit("</td></tr>")))
    in_order = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda r: r["html"]), "\n")
    fields = leaves.groupBy(id_col).agg(F.count("*").alias("n_fields"), in_order(F.struct("path", row.alias("html"))).alias("rows"))
    card = F.concat(F.lit('<div class="card"><h3>'), safe(F.col("label")), F.lit('</h3><p class="source">"'), safe(F.col("text")), F.lit('"</p><p>Page '), safe(F.col("page").cast("string")), F.lit("</p></div>"))
    cards = highlights.groupBy(id_col).agg(F.count("*").alias("n_evidence"), in_order(F.struct("page", "label", "text", card.alias("html"))).alias("cards"))
    out = records.select(id_col).join(fields, id_col, "left").join(cards, id_col, "left").fillna(0, ["n_fields", "n_evidence"]).fillna("", ["rows", "cards"])
    head = f'<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="UTF-8"><title>{title}</title></head>\n<body>\n<h1>{title}</h1>\n<table>\n<tr><th>Field</th><th>Value</th><th>Source Text</th></tr>\n'
    page = F.concat(F.lit(head), F.col("rows"), F.lit("\n</table>\n<h2>Evidence ("), F.col("n_evidence").cast("string"), F.lit(")</h2>\n"), F.col("cards"), F.lit("\n</body>\n</html>"))
    return out.select(id_col, "n_fields", "n_evidence", page.alias("html"))
