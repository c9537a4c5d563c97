"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events becomes one formatted text per conversation: events are folded into messages, messages are put in
order and rendered with a template. Every step is a grouped aggregate, a window or a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers of the output. All begin with `lead`; inside roles and texts `lead` is always followed by `guard`, and no marker goes on with
    `guard`, so that no text can be taken for a marker and the original text can be had back."""

    lead: str = "<|"
    guard: str = "|"
    turn: str = "<|turn>"
    body: str = "<|body>"
    end: str = "<|end>"
    learn: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for x in (self.turn, self.body, self.end):
            if not x.startswith(self.lead) or x.startswith(self.lead + self.guard):
                raise ValueError(f"a marker must begin with {self.lead!r} and not go on with {self.guard!r}")


def escape(text: Column, t: Template = Template()) -> Column:
    return F.replace(text, F.lit(t.lead), F.lit(t.lead + t.guard))


def unescape(text: Column, t: Template = Template()) -> Column:
    return F.replace(text, F.lit(t.lead + t.guard), F.lit(t.lead))


def fold(events: DataFrame) -> DataFrame:
    """Final messages from a log of events.

    events: (conv_id, msg_id, seq, kind, role, text), msg_id and seq of any type that has an order, kind one of
    message (opens msg_id with a text), delta (adds text to it), edit (puts text in its place) and regenerate (drops
    what was streamed; later deltas build the new text). Returns (conv_id, msg_id, seq, role, text): seq is that of the
    message's first event, role the first that is given (empty if none is), text what holds after the last event. A null text is empty, an unknown
    kind counts as message. Equal seq values in a message are ordered by text. Cost: grouped aggregates on (conv_id, msg_id), a bounded group.
    """
    reset = F.when(F.col("kind") != "delta", F.col("seq"))
    w = Window.partitionBy("conv_id", "msg_id")
    live = events.withColumn("kind", F.coalesce("kind", F.lit("message"))).withColumn("last", F.max(reset).over(w))
    kept = F.when(F.col("last").isNull() | F.col("seq").isNull() | (F.col("seq") >= F.col("last")), F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))
    return live.groupBy("conv_id", "msg_id").agg(
        F.min("seq").alias("seq"),
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))), F.lit("")).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["text"]), "").alias("text"),
    )


def to_log(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log of events that a chat service would have kept: (conv_id, msg_id, seq, kind, role, text).

    By a hash of the turn, it was written whole, streamed in three deltas, corrected by an edit, or streamed anew after a draft that was dropped. A
    message is named by its turn, a hash of what it says, and its number among rows that are wholly alike; seq is the turn and the step within it. So the log is the same on every run.
    """
    text, same = F.coalesce("text", F.lit("")), F.xxhash64("role", "text")
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn", "hash").orderBy("hash"))
    one = turns.select("conv_id", "turn", "role", text.alias("text"), same.alias("hash")).withColumn("nth", nth)
    third = (F.length("text") / 3).cast("int")
    cut = [F.left(F.col("text"), third), F.substring(F.col("text"), third + 1, third), F.substring(F.col("text"), 2 * third + 1, F.length("text"))]
    draft = F.concat(F.left(F.col("text"), F.lit(8)), F.lit(" ..."))

    def steps(*events: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), x.alias("said")) for k, (kind, x) in enumerate(events)])

    nothing = F.lit(None).cast("string")
    streamed = [("delta", x) for x in cut]
    ways = (steps(("message", F.col("text"))), steps(("message", nothing), *streamed), steps(("message", draft), ("edit", F.col("text"))), steps(("message", nothing), ("delta", draft), ("regenerate", nothing), *streamed))
    way = F.pmod(F.xxhash64("hash", "turn"), F.lit(len(ways)))
    chosen = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    out = one.withColumn("event", F.explode(chosen))
    # only a message's first event names the role
    role = F.when(F.col("event.step") == 0, F.col("role"))
    return out.select("conv_id", F.struct("turn", "hash", "nth").alias("msg_id"), F.struct("turn", "event.step").alias("seq"), "event.kind", role.alias("role"), F.col("event.said").alias("text"))


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: (conv_id, n_turns long, formatted string, loss array<struct<start, length>>).

    messages: (conv_id, seq, role, text). Order: seq (null first), then role, then text, so ties and repeated rows have a defined place and all
    stay. loss holds the spans, in characters of `formatted` from 0, that a model learns from: the escaped texts of the template's roles.
    """
    role, text = escape(F.coalesce("role", F.lit("")), template), escape(F.coalesce("text", F.lit("")), template)
    head = F.concat(F.lit(template.turn), role, F.lit(template.body))
    learn = F.coalesce(F.col("role").isin(*template.learn), F.lit(False))
    one = messages.select("conv_id", "seq", F.col("role").alias("r"), F.col("text").alias("x"), F.concat(head, text, F.lit(template.end)).alias("piece"), F.when(learn, F.length(head)).alias("at"), F.length(text).alias("len"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("seq"), F.asc_nulls_first("r"), F.asc_nulls_first("x"))
    # running length of what stands before; streamed, so that a conversation of any length needs no array here
    one = one.withColumn("n", F.row_number().over(w)).withColumn("before", F.sum(F.length("piece").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece"))
    pieces = F.sort_array(F.collect_list(F.struct("n", "piece")))
    spans = F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct((F.col("before") + F.col("at")).alias("start"), F.col("len").cast("long").alias("length")))))
    return one.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    turns = F.split(formatted, "\\Q" + template.turn + "\\E")
    parted = F.transform(F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0))), lambda x: F.split(x, "\\Q" + template.body + "\\E", 2))
    cut = len(template.end)
    return F.transform(parted, lambda x: F.struct(unescape(x[0], template).alias("role"), unescape(F.left(x[1], F.length(x[1]) - cut), template).alias("text")))


def learned(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), template)), "")


def format_conversations(events: DataFrame, template: Template = Template()) -> DataFrame:
    """Log of events to formatted conversations: fold, then render. An empty log gives no rows."""
    return render(fold(events), template)
