"""Text functions: measures, splitting, parsing of free-text values, classification by patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that don't end a sentence.
ABBREVIATIONS = (
    "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "et al.", "vs.", "i.e.", "e.g.",
    "Fig.", "Tab.", "Ref.", "No.", "Vol.", "pp.", "Inc.", "Ltd.", "Corp.",
    "Jan.", "Feb.", "Mar.", "Apr.", "Jun.", "Jul.", "Aug.", "Sep.", "Oct.", "Nov.", "Dec.",
)

# Section names and the patterns that begin them, in order of precedence.
SECTION_STARTS = (
    ("abstract", r"^abstract[:\s]"),
    ("introduction", r"^(introduction|background)[:\s]"),
    ("methods", r"^(methods|materials and methods|methodology|study design)[:\s]"),
    ("results", r"^results[:\s]"),
    ("discussion", r"^discussion[:\s]"),
    ("conclusion", r"^(conclusion|conclusions|summary)[:\s]"),
    ("references", r"^(references|bibliography)[:\s]"),
    ("tables", r"^table\s+\d+"),
    ("figures", r"^(figure|fig\.?)\s+\d+"),
)

# Days of the standard follow-up times.
STANDARD_DAYS = (30, 90, 180, 365)

_DOT = "\x01"


def strip(text: Column) -> Column:
    """Without white space at both ends (not only blanks, as trim would do)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up. Null stays null."""
    return F.ceil(F.length(text) / 4).cast("long")


def estimate_pages(text: Column, chars: int = 3000) -> Column:
    return F.ceil(F.length(text) / chars).cast("long")


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def _shielded() -> str:
    """Pattern of the dots that end no sentence: each dot of an abbreviation, by what stands around it, and those between digits."""
    around = [r"(?<=[0-9]\.)(?=[0-9])"]
    for word in ABBREVIATIONS:
        for i, c in enumerate(word):
            if c == ".":
                before, after = re.escape(word[: i + 1]), re.escape(word[i + 1 :])
                around.append(f"(?<={before})" + (f"(?={after})" if after else ""))
    return r"\.(?:" + "|".join(around) + ")"


def shield(text: Column) -> Column:
    """Dots of abbreviations and decimals become a control character, so that they end no sentence."""
    return F.regexp_replace(text, _shielded(), _DOT)


def sentences(text: Column) -> Column:
    """array<string>: split after . ! ? where white space and a capital A-Z follow; trimmed, without empty ones."""
    parts = F.split(shield(text), r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit(_DOT), F.lit(".")))), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """array<string>: split at blank lines and before lines indented by two or more; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n|\n(?=\s{2,})"), strip), lambda s: s != "")


def section_of(text: Column, patterns: Sequence[tuple[str, str]] = SECTION_STARTS) -> Column:
    """Name of the section that the first line begins, or null. The first pattern that matches counts."""
    line = strip(F.split(text, "\n")[0])
    return F.coalesce(*[F.when(line.rlike("(?i)" + p), F.lit(name)) for name, p in patterns])


def leading_number(text: Column) -> Column:
    """The number a text begins with, or null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def parse_percentage(text: Column, strict: bool = False) -> Column:
    """Percentage of a free text. strict: the number it begins with, whatever follows; otherwise the number before the first %, and only if there is none, the leading number."""
    first = leading_number(F.regexp_replace(text, "^([^%]*)%", "$1"))
    if strict:
        return first
    marked = F.nullif(F.regexp_extract(text, r"(\d+\.?\d*)\s*%", 1), F.lit("")).try_cast("double")
    return F.coalesce(marked, first)


def fraction_part(text: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", group), F.lit("")).try_cast("long")


def parse_count(text: Column) -> Column:
    """struct<numerator, denominator>: of "a/b", or the first integer and null."""
    a, b = fraction_part(text, 1), fraction_part(text, 2)
    return F.struct(F.coalesce(a, F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).try_cast("long")).alias("numerator"), b.alias("denominator"))


def parse_days(text: Column) -> Column:
    """Days in a follow-up text: days, else months of 30, else years of 365; null if none is found."""
    get = lambda p: F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")).try_cast("long")
    return F.coalesce(get(r"(\d+)\s*d(?:ay)?s?"), get(r"(\d+)\s*m(?:onth)?s?") * 30, get(r"(\d+)\s*y(?:ea)?r?s?") * 365)


def standard_days(days: Column) -> Column:
    """The nearest standard time, the smaller one at a tie."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(s) - days).alias("d"), F.lit(s).alias("s")) for s in STANDARD_DAYS]))
    return F.when(days.isNotNull(), near["s"])


def parse_mortality(text: Column) -> Column:
    """Share of deaths: of "x%", else of "a/b"; null otherwise and for a zero denominator."""
    pct = F.nullif(F.regexp_extract(text, r"(\d+\.?\d*)%", 1), F.lit("")).try_cast("double") / 100
    return F.coalesce(pct, F.try_divide(fraction_part(text, 1).cast("double"), fraction_part(text, 2).cast("double")))


def truncate(text: Column, most: int = 200) -> Column:
    """Longer texts end in three dots and have at most `most` characters; blanks at the cut go."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(strip(F.left(text, F.lit(most - 3))), F.lit("...")))


def normalise(text: Column) -> Column:
    """Lower case, single blanks, letters a-z, digits, underscores and blanks only, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"[^A-Za-z0-9_\s]", ""))


def plain_words(text: Column) -> Column:
    """The words of normalise() with a blank before and behind each, more than one at places: to look for " word " or for a part of a word."""
    blank = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\f\r", F.lower(text))
    return F.concat(F.lit(" "), F.regexp_replace(blank, "[^a-z0-9_ ]+", ""), F.lit(" "))


def join_lines(text: Column) -> Column:
    """Words hyphenated at a line end are joined, white space becomes single blanks."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"-\s*\n\s*", ""), r"\s+", " "))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"\s+"))


def word_hashes(text: Column) -> Column:
    """array<long>: 64-bit hashes of the distinct words of a text, for joins that should not move words."""
    return F.array_distinct(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.xxhash64(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words among all words of two texts."""
    return jaccard_of_sets(word_set(a), word_set(b))


def jaccard_of_sets(x: Column, y: Column) -> Column:
    """Share of common words among all words of two word sets, words or hashes; what is not common is counted, not built."""
    return F.transform(F.array(F.size(F.array_intersect(x, y)).cast("double")), lambda n: F.try_divide(n, F.size(x) + F.size(y) - n))[0]


# What cells of a table begin with.
CELL_STARTS = (
    r"^\d+\s*[±+]\s*\d+",
    r"^\d+\s*\(\d+\.?\d*%?\)",
    r"^\d+/\d+",
    r"^[<>≤≥]\s*\d+",
    r"(?i)^p\s*[=<>]\s*\d",
    r"(?i)^n\s*=\s*\d+",
)


def is_table_content(text: Column) -> Column:
    """Whether a trimmed cell begins like a cell of a table."""
    t = strip(text)
    return reduce(lambda a, b: a | b, [t.rlike(p) for p in CELL_STARTS])


# Kinds of tables by words in their headers, in order of precedence.
TABLE_KINDS = (
    ("demographics", "age|sex|gender|male|female|baseline"),
    ("baseline", "gcs|admission|diagnosis|etiology|infarction|hemorrhage"),
    ("outcomes", "mortality|death|mrs|rankin|outcome|favorable"),
    ("complications", "complication|infection|reoperation|hydrocephalus"),
    ("flowchart", "screened|enrolled|excluded|analyzed|follow-up"),
    ("statistical", "odds ratio|hazard|ci|p-value|significant"),
    ("imaging", "volume|lesion|edema|swelling|midline"),
    ("surgical", "surgical|evd|duraplasty|craniectomy|technique"),
)

# Kinds of figures.
FIGURE_KINDS = ("flowchart", "bar_chart", "line_chart", "kaplan_meier", "forest_plot", "ct_scan", "mri", "scatter_plot", "other")


def table_kind(headers: Column) -> Column:
    """Kind of a table from its headers, an array<string>."""
    joined = F.lower(F.array_join(headers, " "))
    return F.coalesce(*[F.when(joined.rlike(p), F.lit(name)) for name, p in TABLE_KINDS], F.lit("other"))


def figure_kind(name: Column) -> Column:
    """A known kind, "other" for an unknown name, null for a null or empty one."""
    low = F.lower(name)
    return F.when(F.coalesce(name, F.lit("")) != "", F.when(low.isin(*FIGURE_KINDS), low).otherwise("other"))


def citation_style(text: Column) -> Column:
    """vancouver, apa, mla or unknown."""
    return F.when(text.rlike(r"^\d+\.\s"), "vancouver").when(text.rlike(r"\(\d{4}\)"), "apa").when(text.rlike(r'"[^"]+"\.\s'), "mla").otherwise("unknown")


# Numeric phrases, and terms whose sentences count as phrases.
PHRASES = (
    r"\d+\.?\d*\s*%",
    r"(?i)n\s*=\s*\d+",
    r"(?i)p\s*[<>=]\s*0\.\d+",
    r"\d+\s*±\s*\d+\.?\d*",
    r"\d+\.?\d*\s*-\s*\d+\.?\d*",
    r"\d+\.?\d*\s*\(\s*\d+\.?\d*\s*-\s*\d+\.?\d*\s*\)",
)
TERMS = ("mortality", "mRS", "GCS", "GOS", "hydrocephalus", "craniectomy", "decompressive", "infarction", "hemorrhage", "EVD", "duraplasty", "hematoma", "edema", "herniation", "outcome", "complication")


def key_phrases(text: Column) -> Column:
    """Distinct phrases of more than 3 characters: numbers with context, then, term by term, sentences of 11 to 149 characters that hold it, with their full stop. Sentences are parted first, so a text is read in linear time."""
    numbers_ = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PHRASES]
    sentences = F.regexp_extract_all(text, F.lit(r"[^.]+\.?"), F.lit(0))
    word = lambda t: rf"(?i)(?<![A-Za-z0-9_])(?:{t})(?![A-Za-z0-9_])"
    likely = F.filter(sentences, lambda s: (F.length(s) > 10) & (F.length(s) < 150) & s.rlike(word("|".join(TERMS))))
    by_term = F.flatten(F.transform(F.array(*[F.lit(word(t)) for t in TERMS]), lambda t: F.filter(likely, lambda s: F.regexp_like(s, t))))
    return F.filter(F.array_distinct(F.concat(*numbers_, by_term)), lambda p: F.length(p) > 3)


def imaging_timepoint(text: Column) -> Column:
    return F.when(text.rlike("(?i)admission|baseline|initial"), "baseline").when(text.rlike(r"(?i)24\s*h|24-h"), "24-hour").when(text.rlike("(?i)follow-?up"), "follow-up")


def imaging_modality(text: Column) -> Column:
    word = lambda w: rf"(?i)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])"
    return F.when(text.rlike(word("CT") + "|(?i)computed tomography"), "CT").when(text.rlike(word("MRI") + "|(?i)magnetic resonance"), "MRI").when(text.rlike(word("DWI") + "|(?i)diffusion-weighted"), "DWI-MRI")


def numbers(text: Column) -> Column:
    """array<string> of the numbers in a text."""
    return F.regexp_extract_all(text, F.lit(r"\d+\.?\d*"), F.lit(0))
