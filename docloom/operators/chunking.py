"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def fixed_chunks(docs: DataFrame, max_tokens: int, overlap_tokens: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of max_tokens * 4 characters, each beginning overlap_tokens * 4 before the end of the one before; the last ends with the text.

    Returns (doc_id, chunk_idx, text, char_start, char_end, tokens). Empty and null texts have no chunks. overlap_tokens must be under max_tokens.
    """
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("overlap must be under the chunk size")
    size, step = max_tokens * 4, (max_tokens - overlap_tokens) * 4
    n = F.length(text_col)
    # starts go on while the window before hasn't reached the end
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    at = docs.where(n > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).alias("chunk_idx", "char_start"))
    chunk = F.substring(F.col("_t"), F.col("char_start") + 1, F.lit(size))
    return at.select("doc_id", "chunk_idx", chunk.alias("text"), "char_start", (F.col("char_start") + F.length(chunk)).alias("char_end"), tx.estimate_tokens(chunk).alias("tokens"))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once however often f refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _suffix(text: Column, overlap: int) -> Column:
    """The longest run of last sentences with at most `overlap` tokens, joined by blanks."""
    s = tx.sentences(text)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("bigint").alias("tokens"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["tokens"] + tx.estimate_tokens(x)
        stop = acc["full"] | (n > overlap)
        return F.struct(F.when(stop, acc["kept"]).otherwise(F.concat(F.array(x), acc["kept"])).alias("kept"), F.when(stop, acc["tokens"]).otherwise(n).alias("tokens"), stop.alias("full"))

    return F.array_join(F.aggregate(F.reverse(s), start, step, lambda a: a["kept"]), " ")


def pack_units(units: Column, max_tokens: int, min_tokens: int, overlap: int) -> Column:
    """array<struct<text, tokens>>: units, array<struct<text, sep, big>>, packed greedily in order.

    A unit opens a new chunk if it would take the current one over max_tokens; sep joins a chunk that is closed at that unit, and a blank line the last one. The last chunk is dropped
    if it has under min_tokens. With overlap, a new chunk begins with the last sentences of the one before. big marks a unit that is tested as
    a paragraph over max_tokens: it closes the current chunk with a blank line before its own sentences come.
    """
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("tokens"), F.array().cast("array<struct<text: string, tokens: bigint>>").alias("done"))

    def close(acc: Column, sep: Column) -> Column:
        text = F.array_join(acc["parts"], "\x02")
        return F.replace(text, F.lit("\x02"), sep)

    def state(parts: Column, tokens: Column, done: Column, u: Column) -> Column:
        more = F.when(u["big"], parts).otherwise(F.concat(parts, F.array(u["text"])))
        total = tokens + F.when(u["big"], 0).otherwise(tx.estimate_tokens(u["text"]))
        return F.struct(more.alias("parts"), total.cast("bigint").alias("tokens"), done.alias("done"))

    def step(acc: Column, u: Column) -> Column:
        over = (acc["tokens"] + tx.estimate_tokens(u["text"]) > max_tokens) & (F.size(acc["parts"]) > 0)

        def closed(text: Column) -> Column:
            done = F.concat(acc["done"], F.array(F.struct(text.alias("text"), acc["tokens"].alias("tokens"))))
            none = F.array().cast("array<string>")
            if not overlap:
                return state(none, F.lit(0).cast("bigint"), done, u)
            return bind(_suffix(text, overlap), lambda c: state(F.when(c != "", F.array(c)).otherwise(none), tx.estimate_tokens(c), done, u))

        return F.when(over, bind(close(acc, u["sep"]), closed)).otherwise(state(acc["parts"], acc["tokens"], acc["done"], u))

    def finish(acc: Column) -> Column:
        last = F.struct(close(acc, F.lit("\n\n")).alias("text"), acc["tokens"].alias("tokens"))
        return F.when((F.size(acc["parts"]) > 0) & (acc["tokens"] >= min_tokens), F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    return F.aggregate(units, start, step, finish)


def semantic_chunks(docs: DataFrame, max_tokens: int = 1500, min_tokens: int = 100, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs packed into chunks of at most max_tokens; longer paragraphs are packed by sentences.

    Returns (doc_id, chunk_idx, text, section, tokens). Documents whose only chunk stays under min_tokens have none.
    """

    def unit(p: Column) -> Column:
        big = tx.estimate_tokens(p) > max_tokens
        one = lambda t, sep, b: F.struct(t.alias("text"), F.lit(sep).alias("sep"), F.lit(b).alias("big"))
        mark = F.array(F.struct(p.alias("text"), F.lit("\n\n").alias("sep"), F.lit(True).alias("big")))
        return F.when(big, F.concat(mark, F.transform(tx.sentences(p), lambda s: one(s, " ", False)))).otherwise(F.array(one(p, "\n\n", False)))

    units = F.flatten(F.transform(tx.paragraphs(F.col(text_col)), unit))
    chunks = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pack_units(units, max_tokens, min_tokens, overlap)).alias("chunk_idx", "c"))
    return chunks.select("doc_id", "chunk_idx", F.col("c.text").alias("text"), tx.section_of(F.col("c.text")).alias("section"), F.col("c.tokens").alias("tokens"))


# Words that begin the sections of a paper, in order.
MARKERS = (
    ("abstract", "abstract|summary"),
    ("introduction", "introduction|background"),
    ("methods", "methods|materials and methods|patients and methods"),
    ("results", "results"),
    ("discussion", "discussion"),
    ("conclusion", "conclusion|conclusions"),
    ("references", "references|bibliography"),
)


def paper_sections(text: Column) -> Column:
    """array<struct<type, text>>: from the first occurrence of each section's marker to the next one of a later section, in order of the markers. Text before the first is left out."""
    found = []
    for i, (name, words) in enumerate(MARKERS):
        p = rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"
        at = F.regexp_instr(text, F.lit(p))
        mark = F.length(F.regexp_substr(text, F.lit(p)))
        rest = F.substring(text, at + mark, F.length(text))
        later = [F.nullif(F.regexp_instr(rest, F.lit(rf"(?i)(?<![A-Za-z0-9_])(?:{w})(?![A-Za-z0-9_])")), F.lit(0)) for _, w in MARKERS[i + 1 :]]
        end = F.least(*later, F.length(rest) + 1) if len(later) > 1 else F.coalesce(later[0], F.length(rest) + 1) if later else F.length(rest) + 1
        body = tx.strip(F.concat(F.substring(text, at, mark), F.substring(rest, F.lit(1), end - 1)))
        found.append(F.when(at > 0, F.struct(F.lit(name).alias("type"), body.alias("text"))))
    return F.array_compact(F.array(*found))


def paper_chunks(docs: DataFrame, max_tokens: int = 2000, min_tokens: int = 100, overlap: int = 150, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each section of a paper in chunks of its own: (doc_id, chunk_idx, section, text, tokens); chunk_idx counts through the document. Papers without a marked section are one section, named by each chunk's text."""
    text = F.col(text_col)
    parts = bind(paper_sections(text), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("type"), text.alias("text")))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("nth", "s"))
    made = semantic_chunks(rows.select(F.struct("doc_id", "nth", "s.type").alias("at"), F.col("s.text").alias("text")), max_tokens, min_tokens, overlap, id_col="at")
    order = Window.partitionBy("doc_id").orderBy("nth", "idx")
    flat = made.select("doc_id.doc_id", "doc_id.nth", F.col("chunk_idx").alias("idx"), F.coalesce("doc_id.type", "section").alias("section"), "text", "tokens")
    return flat.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_idx"), "section", "text", "tokens")


def chunk(docs: DataFrame, strategy: str = "medical", **options) -> DataFrame:
    """(doc_id, chunk_idx, text, tokens) by strategy: medical (sections kept), semantic or fixed."""
    ways = {"medical": paper_chunks, "semantic": semantic_chunks, "fixed": fixed_chunks}
    if strategy not in ways:
        raise ValueError(f"unknown strategy: {strategy}")
    return ways[strategy](docs, **options).select("doc_id", "chunk_idx", "text", "tokens")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, avg_tokens): halves round up."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.floor(F.avg("tokens") + 0.5).alias("avg_tokens"))


#: What word boundaries go by: ASCII letters, digits and the underscore.
_WORD = "[A-Za-z0-9_]"


def named_sections(text: Column) -> Column:
    """array<struct<name, text>>: for each heading that occurs, from its first occurrence to the next run of capitals, or the end."""
    out = []
    for name, words in HEADINGS:
        p = rf"(?i)(?<!{_WORD})(?:{words})(?!{_WORD})"
        at, mark = F.regexp_instr(text, F.lit(p)), F.length(F.regexp_substr(text, F.lit(p)))
        rest = F.substring(text, at + mark, F.length(text))
        end = F.coalesce(F.nullif(F.regexp_instr(rest, F.lit(rf"(?<!{_WORD})[A-Z][A-Z\s]{{2,}}(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))")), F.lit(0)), F.length(rest) + 1)
        out.append(F.when(at > 0, F.struct(F.lit(name).alias("name"), tx.strip(F.substring(text, at, mark + end - 1)).alias("text"))))
    return F.array_compact(F.array(*out))


# Headings that name the sections of a paper.
HEADINGS = (
    ("abstract", "ABSTRACT"),
    ("introduction", "INTRODUCTION"),
    ("methods", "METHODS?|MATERIALS AND METHODS|PATIENTS AND METHODS"),
    ("results", "RESULTS?"),
    ("discussion", "DISCUSSION"),
    ("conclusion", "CONCLUSION"),
)


def _last_items(items: Column, overlap: int) -> Column:
    """The longest run of last items, array<struct<text, page>>, with at most `overlap` tokens."""
    start = F.struct(F.array().cast("array<struct<text: string, page: bigint>>").alias("kept"), F.lit(0).cast("bigint").alias("tokens"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["tokens"] + tx.estimate_tokens(x["text"])
        stop = acc["full"] | (n > overlap)
        return F.struct(F.when(stop, acc["kept"]).otherwise(F.concat(F.array(x), acc["kept"])).alias("kept"), F.when(stop, acc["tokens"]).otherwise(n).cast("bigint").alias("tokens"), stop.alias("full"))

    return F.aggregate(F.reverse(items), start, step, lambda a: a["kept"])


def page_chunks(pages: DataFrame, max_tokens: int = 1500, min_tokens: int = 100, overlap: int = 0) -> DataFrame:
    """Chunks that know their pages. pages: (doc_id, page, text). Returns (doc_id, chunk_idx, text, page_start, page_end).

    With overlap, a new chunk begins with the last paragraphs of the one before that have at most so many tokens together.
    """
    body = F.array_sort(F.collect_list(F.struct("page", F.col("text"))))
    joined = pages.groupBy("doc_id").agg(body.alias("p"))
    unit = lambda t, p: F.struct(t.alias("text"), p["page"].cast("bigint").alias("page"))
    units = F.flatten(F.transform("p", lambda p: F.transform(tx.paragraphs(p["text"]), lambda t: unit(t, p))))
    done = "array<struct<text: string, a: bigint, b: bigint>>"
    start = F.struct(F.array().cast("array<struct<text: string, page: bigint>>").alias("items"), F.lit(0).cast("bigint").alias("tokens"), F.array().cast(done).alias("done"))

    def made(items: Column) -> Column:
        page = F.transform(items, lambda x: x["page"])
        return F.array(F.struct(F.array_join(F.transform(items, lambda x: x["text"]), "\n\n").alias("text"), F.array_min(page).alias("a"), F.array_max(page).alias("b")))

    def step(acc: Column, u: Column) -> Column:
        over = (acc["tokens"] + tx.estimate_tokens(u["text"]) > max_tokens) & (F.size(acc["items"]) > 0)
        kept = _last_items(acc["items"], overlap) if overlap else F.array().cast("array<struct<text: string, page: bigint>>")
        items = F.concat(F.when(over, kept).otherwise(acc["items"]), F.array(u))
        total = F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: (a + tx.estimate_tokens(x["text"])).cast("bigint"))
        return F.struct(items.alias("items"), total.alias("tokens"), F.when(over, F.concat(acc["done"], made(acc["items"]))).otherwise(acc["done"]).alias("done"))

    def finish(acc: Column) -> Column:
        return F.when((F.size(acc["items"]) > 0) & (acc["tokens"] >= min_tokens), F.concat(acc["done"], made(acc["items"]))).otherwise(acc["done"])

    out = joined.select("doc_id", F.posexplode(F.aggregate(units, start, step, finish)).alias("chunk_idx", "c"))
    return out.select("doc_id", "chunk_idx", F.col("c.text").alias("text"), F.col("c.a").alias("page_start"), F.col("c.b").alias("page_end"))
