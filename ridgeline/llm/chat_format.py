"""Chat formatting from event logs: fold the events of each conversation into turns, render them, mark the loss.

Events have conv_id, seq, kind, turn, role and text. `message` begins a turn with a text, `delta` adds text to it,
`edit` replaces it, `regenerate` begins it anew and drops the later turns that began before. All of it is window and
aggregate functions over one shuffle by conversation.

The template writes a turn as `<turn role="ROLE">`, its text and `</turn>`, on lines of their own. In texts `&` and
`<` are written `&amp;` and `&lt;`, so no control string can occur in one, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_value

TURN = r'<turn role="([^"]*)">\n([^<]*)\n</turn>\n'
EVENT_COLUMNS = ["conv_id", "seq", "kind", "turn", "role", "text"]


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def message_events(rows: DataFrame) -> DataFrame:
    """One `message` event for each row of conv_id, turn, role, text, in order of turn (ties: role, then text)."""
    order = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "seq", F.lit("message").alias("kind"), F.col("seq").alias("turn"), "role", "text")


def streamed_events(rows: DataFrame) -> DataFrame:
    """An event log that folds to the rows of conv_id, turn, role, text, with events of every kind.

    Each text is streamed in two parts. Of three turns one is streamed straight away, one as a draft with a delta that
    an edit replaces, and one as a draft that is regenerated.
    """
    turns = message_events(rows).withColumn("said", F.coalesce("text", F.lit("")))
    half = F.floor(F.char_length("said") / 2).cast("int")
    first, rest = F.substring("said", F.lit(1), half), F.substring("said", half + 1, F.char_length("said"))

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(events)])

    straight = log(("message", first), ("delta", rest))
    edited = log(("message", F.lit("draft")), ("delta", F.lit(" of it")), ("edit", first), ("delta", rest))
    renewed = log(("message", F.lit("draft")), ("regenerate", first), ("delta", rest))
    way = F.col("seq") % 3
    events = turns.select("conv_id", "seq", "turn", "role", F.explode(F.when(way == 0, straight).when(way == 1, edited).otherwise(renewed)).alias("x"))
    return events.select("conv_id", (4 * F.col("seq") + F.col("x.k")).alias("seq"), F.col("x.kind").alias("kind"), "turn", "role", F.col("x.text").alias("text"))


def folded(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: what the events leave standing. Events of one seq count in order of kind and text."""
    begins = F.col("kind").isin("message", "edit", "regenerate")
    turn = Window.partitionBy("conv_id", "turn")
    events = events.select(*EVENT_COLUMNS).withColumn("reset", F.max(F.when(begins, F.col("seq"))).over(turn))
    live = F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))
    pieces = F.array_sort(F.collect_list(F.when(live, F.struct("seq", F.when(begins, 0).otherwise(1).alias("later"), "kind", F.coalesce("text", F.lit("")).alias("text")))))
    turns = events.groupBy("conv_id", "turn").agg(
        pieces.alias("pieces"),
        F.max_by(F.when(F.col("role").isNotNull(), F.col("role")), F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.coalesce(F.max(F.when(F.col("kind") == "message", F.col("seq"))), F.min("seq")).alias("began"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("renewed"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("renewed").over(earlier)).where("cut IS NULL OR cut < began")
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("text"))


def rendered(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, parts and loss_spans of each conversation.

    parts: (text, loss), which put together are formatted; loss marks texts of trained_role. loss_spans: (start, end)
    of those in formatted, in code points.
    """
    head = F.concat(F.lit('<turn role="'), escaped(F.col("role")), F.lit('">\n'))
    tail = F.lit("\n</turn>\n")
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumns({"head": head, "body": escaped(F.col("text")), "loss": F.col("role") == trained_role})
    size = F.char_length("head") + F.char_length("body") + F.char_length(tail)
    turns = turns.withColumn("start", F.sum(size).over(order) - F.char_length("body") - F.char_length(tail))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "head", "body", "loss", "start"))).alias("t"))
    parts = F.flatten(F.transform("t", lambda x: F.array(F.struct(x["head"].alias("text"), F.lit(False).alias("loss")), F.struct(x["body"].alias("text"), x["loss"].alias("loss")), F.struct(tail.alias("text"), F.lit(False).alias("loss")))))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["body"])).alias("end")))
    out = turns.select("conv_id", parts.alias("parts"), spans.alias("loss_spans"))
    return out.select("conv_id", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("formatted"), "parts", "loss_spans")


def chat_format(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Formatted conversations of an event log; see folded() and rendered().

    Null texts are empty, a null role is written as an empty one, null conv_id or turn is a key like any other.
    Repeated events count each. Other columns are not read, whatever their names. No events give no conversations.
    A conversation is one string, so its turns meet in one task; nothing else does.
    """
    return rendered(folded(events), trained_role)


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of (role, text)."""
    roles, texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescaped(r).alias("role"), unescaped(t).alias("text")))


def trained_texts(formatted: Column, loss_spans: Column) -> Column:
    """What stands under the loss mask in a formatted conversation, unescaped: array of texts. Four bytes a character give places at once."""
    cut = lambda wide, x: F.decode(F.substring(wide, (4 * x["start"] + 1).cast("int"), (4 * (x["end"] - x["start"])).cast("int")), "UTF-32")
    return with_value(F.encode(formatted, "UTF-32"), lambda wide: F.transform(loss_spans, lambda x: unescaped(cut(wide, x))))
