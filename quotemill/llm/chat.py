"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log of events is partitioned by conversation and ordered by sequence. Events of one message are folded into its text:
`message` and `edit` set it, `delta` appends to it, `regenerate` empties it and also drops all messages that came after the
message before that event, `delete` removes it. The messages left, in the order of their first events, are rendered.

A turn is rendered as `### role: text</turn>` and a line feed. Inside texts and roles the control strings are escaped:
backslash as \\b, `###` as \\h, `</turn>` as \\t, and in roles `: ` as \\c. As every backslash that is left starts an escape,
replacing in the opposite order restores the text. The loss mask covers the escaped assistant texts, nothing between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (": ", "\\c"))


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escaped(c: Column, escapes: tuple = ESCAPES) -> Column:
    return _replaced(c, list(escapes))


def unescaped(c: Column, escapes: tuple = ESCAPES) -> Column:
    return _replaced(c, [(new, old) for old, new in reversed(escapes)])


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the final messages of an event log with conv_id, seq, kind, message_id, role, text.

    Null texts are empty; a message's role is that of its first event that has one, else empty. Unknown kinds are ignored. Events
    without a sequence come first, those of equal sequence go by kind, then text. A repeated row applies twice: a repeated delta
    appends twice, a repeated message or edit sets the same text again. A null conv_id is a conversation of its own, as a null
    message_id is a message. An empty log gives no rows. The events of one message, and the rendered text of one conversation, are
    one value in one task, which the format asks for; a conversation is bounded by what a row can hold (2 GB).
    """
    rows = events.filter(F.col("kind").isin("message", "edit", "delta", "regenerate", "delete"))
    event = F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    folded = rows.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.array_sort(F.collect_list(event)).alias("events"),
    )
    resets = F.array_max(F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(-1))))
    live = F.slice("events", F.greatest(resets, F.lit(0)) + 1, F.size("events"))
    text = F.array_join(F.transform(live, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
    last = F.when(resets >= 0, F.element_at("events", resets + 1)["kind"])
    before = Window.partitionBy("conv_id").orderBy("first", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = folded.withColumn("text", text).withColumn("last", last).withColumn("cut", F.max("regenerated").over(before))
    kept = kept.filter((F.col("cut").isNull() | (F.col("first") > F.col("cut"))) & (F.coalesce("last", F.lit("")) != "delete"))
    return kept.select("conv_id", F.col("first").alias("position"), F.coalesce("role", F.lit("")).alias("role"), "text")


def formatted(events: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): each conversation's text, and the (start, length) of its learned texts in code points from 0.

    See messages for the log. A conversation of which nothing is left has no row; an empty table gives none.
    """
    turns = messages(events)
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE))
    body = escaped(F.col("text"))
    rows = turns.select("conv_id", "position", head.alias("head"), body.alias("body"), (F.col("role") == learned).alias("learned"))
    size = (F.length("head") + F.length("body") + len(TAIL)).cast("long")
    before = Window.partitionBy("conv_id").orderBy("position", "head", "body", "learned").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "head", "body", "learned", "start"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "")
    span = lambda t: F.struct((t["start"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))
    return grouped.select("conv_id", text.alias("formatted"), F.transform(F.filter("turns", lambda t: t["learned"]), span).alias("loss"))


def read_back(column: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    parts = F.split(column, TAIL, -1)

    def turn(t: Column) -> Column:
        role = F.substring_index(F.substr(t, F.lit(len(HEAD) + 1)), MIDDLE, 1)
        text = F.substr(t, F.lit(len(HEAD) + len(MIDDLE) + 1) + F.length(role))
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def loss_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order. It looks each span up from the text's beginning; for very long conversations see read_rows."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def read_rows(done: DataFrame) -> DataFrame:
    """What formatted conversations (conv_id, formatted, loss) hold, in rows: for each turn its place in the text `at`, n_chars, role and text; for each span of the
    loss mask `at` and learned, the unescaped text under it. The work is linear in a conversation, which is cut into turns once; a span lies within one turn.
    """
    place = Window.partitionBy("conv_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    cut = done.select("conv_id", F.posexplode(F.split("formatted", f"(?<={TAIL})")).alias("_n", "_turn")).filter("_turn <> ''").withColumn("n_chars", F.length("_turn").cast("long"))
    turns = cut.select("conv_id", F.coalesce(F.sum("n_chars").over(place), F.lit(0).cast("long")).alias("at"), "n_chars", "_turn", F.lit(None).cast("long").alias("_length"))
    spans = done.select("conv_id", F.explode("loss").alias("_s")).select("conv_id", F.col("_s.start").alias("at"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("_turn"), F.col("_s.length").alias("_length"))
    upto = Window.partitionBy("conv_id").orderBy("at", F.col("_length").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_turn").isNotNull(), F.struct("at", F.col("_turn").alias("turn"))), ignorenulls=True).over(upto)
    rows = turns.unionByName(spans).withColumn("_in", held)
    learned = F.when(F.col("_length").isNotNull(), unescaped(F.substr("_in.turn", (F.col("at") - F.col("_in.at") + 1).cast("int"), F.col("_length").cast("int"))))
    role = F.substring_index(F.substr("_turn", F.lit(len(HEAD) + 1)), MIDDLE, 1)
    body = F.substr("_turn", F.lit(len(HEAD) + len(MIDDLE) + 1) + F.length(role), F.length("_turn") - len(HEAD) - len(MIDDLE) - len(TAIL) - F.length(role))
    return rows.select("conv_id", "at", "n_chars", unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(body).alias("text"), learned.alias("learned"))
