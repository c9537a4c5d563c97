"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, materialise, shared_dir, small

#: Fixed: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def split_words(text: Column) -> Column:
    """array<string> of the words of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once however often f refers to it, inside lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def windows(words: Column, window: int = 5) -> Column:
    """array<bigint>: a 64-bit hash of each run of `window` words, by its first word. Shorter texts have none."""

    def runs(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - window)
        return F.when(F.size(h) >= window, F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _covered(wins: Column, window: int) -> Column:
    """Words covered by windows whose hash occurs more than once. Only texts that have any come here: the windows are sorted with their places."""
    placed = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        alike = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(alike, lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    return bind(placed, lambda s: bind(starts(s), total))


def measure(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) to docs, from whole texts. Null text: all 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counted = bind(split_words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), windows(w, window).alias("wins")))
    out = docs.withColumns({
        "_words": counted,
        "_lines": lines,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    wins = F.col("_words.wins")
    repeats = F.when(F.size(wins) > F.size(F.array_distinct(wins)), _covered(wins, window)).otherwise(F.lit(0))
    return out.withColumns({
        "n_words": F.col("_words.n"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeats.cast("long"),
    }).drop("_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """A measure per word and how far from the bulk of its group it may lie.

    Bounds: [q1 - reach * spread, q3 + reach * spread], spread being the group's q3 - q1, but at least `slack`,
    so a group of like documents doesn't lose those that differ a little. lower=False: only the upper bound counts.
    """

    name: str
    value: str
    slack: float
    reach: float = 3.0
    lower: bool = False


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", 0.03),
    Rule("dup_lines", "n_dup_lines / greatest(n_words, 1)", 0.02),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", 0.05),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 1.0, lower=True),
)


#: The bin of the value 0, below all others.
_ZERO = -(1 << 40)


def sketches(measured: DataFrame, rules: tuple[Rule, ...], accuracy: float = 0.01) -> DataFrame:
    """(lang, source, rule, bin, n): one quantile sketch per rule, language and source, as counts of logarithmic bins.

    A bin holds the values within a share `accuracy` of each other, so it stands for each of them that nearly. Counts of the same bin add up, so sketches merge exactly, in any
    order, and reruns agree; that happens before the shuffle, so a hot source costs no more than others. Values from 10^-6 to 10^6 make under 3000 bins.
    """
    named = F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.expr(f"CAST({r.value} AS DOUBLE)").alias("value")) for r in rules]))
    bin_ = F.when(F.col("value") > 0, F.floor(F.log("value") / F.log(F.lit(1 + accuracy)))).otherwise(F.lit(_ZERO)).cast("long")
    return measured.select("lang", "source", named).groupBy("lang", "source", "rule", bin_.alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float], accuracy: float = 0.01) -> DataFrame:
    """(keys, n, one column per share): the values below which these shares lie, from a sketch (keys, bin, n)."""
    w = Window.partitionBy(*keys)
    ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    value = lambda b: F.when(b == _ZERO, 0.0).otherwise(F.pow(F.lit(1 + accuracy), b + 0.5))
    return ranked.groupBy(*keys).agg(F.max("all").alias("n"), *[value(F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin")))).alias(name) for name, share in shares.items()])


def thresholds(measured: DataFrame, rules: tuple[Rule, ...] = RULES, prior: float = 200.0) -> DataFrame:
    """(lang, source, <rule>_low, <rule>_high) from one sketch per rule, language and source.

    Few documents say little about quantiles, so a source's are drawn towards those of its language, whose sketch is the merge of its sources': with n documents, its own
    count n / (n + prior).
    """
    by = materialise(sketches(measured, rules), "sketches")
    shares = {"q1": 0.25, "q3": 0.75}
    own = quantiles(by, ["lang", "source", "rule"], shares)
    whole = quantiles(by.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n")), ["lang", "rule"], shares)
    both = own.alias("o").join(whole.alias("w"), F.expr("o.lang <=> w.lang AND o.rule = w.rule"))
    drawn = lambda q: ((F.col("o.n") * F.col(f"o.{q}") + prior * F.col(f"w.{q}")) / (F.col("o.n") + prior)).alias(q)
    both = both.select("o.lang", "o.source", "o.rule", drawn("q1"), drawn("q3"))
    out = []
    for r in rules:
        reach = r.reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(r.slack))
        low = F.col("q1") - reach if r.lower else F.lit(float("-inf"))
        out += [F.max(F.when(F.col("rule") == r.name, x)).alias(f"{r.name}_{side}") for side, x in (("low", low), ("high", F.col("q3") + reach))]
    return both.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: float = 200.0) -> DataFrame:
    """One row per document: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed array<string>, kept).

    base_failed: under 10 words, or over 20% of words in repeated windows; such documents don't shape the thresholds either. kept is
    false for them, else true if every rule holds. Null language or source is a group like any other. Documents of a
    group in which all fail the base have no thresholds and none to meet. An empty table gives no rows.
    """
    shared_dir(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    m = measure(plain).drop("text").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    m = materialise(m, "measured")
    t = materialise(thresholds(m.where(~F.col("base_failed")), rules, prior), "thresholds")
    j = m.alias("m").join(small(t).alias("t"), F.expr("m.lang <=> t.lang AND m.source <=> t.source"), "left")
    value = {r.name: F.expr(f"CAST({r.value} AS DOUBLE)") for r in rules}
    failed = F.array_compact(F.array(*[F.when((value[r.name] > F.col(f"t.{r.name}_high")) | (value[r.name] < F.col(f"t.{r.name}_low")), F.lit(r.name)) for r in rules]))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return j.select(*[F.col(f"m.{c}").alias(c) for c in cols], failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
