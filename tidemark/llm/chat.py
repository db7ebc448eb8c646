"""Chat formatting from event logs, with DataFrame functions only.

A log row is an event of a message in a conversation: `message` and `edit` set its text, `delta` adds to it,
`regenerate` empties it and drops every later message as it was then. Events count in the order of seq; ties
go by message, event, role and text. Folding: the events of a conversation stand in one partition, in order;
a running minimum from the end says which events a later regenerate undoes, the last event that sets a text
begins what counts of a message, and the texts from there on are joined.

Rendering: a turn is <s>[INST]role[/INST]text</s>. Control strings and backslashes inside roles and texts are
escaped, so that a reader finds the marks again and unescapes to the very text. The loss mask is run-length
coded over the formatted string, three runs a turn: before the text, the text (in the loss if the role is
assistant), after it.

The digests take conversations as streams: see streamed_events_of. Edge cases: a null role or text is empty; a very long
text is cut into pieces by its length and joined again; a null turn or message comes first; rows that repeat a turn are
turns each; a null conv_id is a conversation of its own; an empty table gives an empty result; other columns
are ignored. A conversation is one row of the result, so its length is bounded by what a row can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template and what stands for them inside a text.
BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPES = (("\\", "\\e"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]"))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for safe, plain in (("\\l", "<"), ("\\b", "["), ("\\e", "\\")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the messages that a log of (conv_id, seq, event, message, role, text) leaves."""
    conversation = Window.partitionBy("conv_id").orderBy("seq", "message", "event", "role", "text")
    after = conversation.rowsBetween(1, Window.unboundedFollowing)
    own = Window.partitionBy("conv_id", "message")
    rows = events.select("conv_id", "seq", "event", "message", "role", "text").withColumn("place", F.row_number().over(conversation))
    undone = F.min(F.when(F.col("event") == "regenerate", F.col("message"))).over(after)
    rows = rows.withColumn("undone", undone).where("undone is null or message <= undone")
    begin = F.max(F.when(F.col("event").isin("message", "edit", "regenerate"), F.col("place"))).over(own)
    rows = rows.withColumn("begin", begin)
    kept = F.when(F.col("begin").isNull() | (F.col("place") >= F.col("begin")), F.struct("place", F.coalesce("text", F.lit("")).alias("text")))
    parts = F.array_sort(F.collect_list(kept))
    role = F.min_by("role", F.when(F.col("role").isNotNull(), F.col("place")))
    return rows.groupBy("conv_id", "message").agg(role.alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, mask) of (conv_id, message, role, text); messages come in their order."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(BEGIN + HEAD), escape(role), F.lit(BODY))
    run = lambda chars, loss: F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))
    no = F.lit(False)
    turns = messages.select("conv_id", "message", role.alias("role"), text.alias("text"), head.alias("head"))
    turn = F.struct("message", "role", F.concat("head", "text", F.lit(END)).alias("shown"), F.array(run(F.char_length("head"), no), run(F.char_length("text"), F.col("role") == "assistant"), run(F.lit(len(END)), no)).alias("runs"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    shown = F.array_join(F.transform("turns", lambda t: t["shown"]), "")
    return listed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), shown.alias("formatted"), F.flatten(F.transform("turns", lambda t: t["runs"])).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns, an array of (role, text, loss), read from the formatted string and its mask."""
    shown = F.split("formatted", END)
    pieces = F.slice(shown, F.lit(1), F.size(shown) - 1)  # nothing stands after the last end mark

    def turn(piece: Column, k: Column) -> Column:
        halves = F.split(F.substring(piece, len(BEGIN + HEAD) + 1, 1 << 30), r"\[/INST\]")
        body = F.element_at("mask", k * 3 + 2)
        text = F.substring(piece, F.element_at("mask", k * 3 + 1)["chars"] + 1, body["chars"])
        return F.struct(unescape(halves[0]).alias("role"), unescape(text).alias("text"), body["loss"].alias("loss"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def events_of(conversations: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as a log: each row sets the text of a message of its own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    place = F.row_number().over(order).cast("long")
    return rows.withColumn("seq", place).select("conv_id", "seq", F.lit("message").alias("event"), F.col("seq").alias("message"), "role", "text")


PIECES = 4  # deltas of a text


def streamed_events_of(conversations: DataFrame) -> DataFrame:
    """Plain rows as the log of a chat that streams them, by a fixed rule: texts come in pieces; every third message
    begins with a draft that is edited away; every third is regenerated after a false start to which an answer had been
    given already. Folding must restore the very texts."""
    rows = events_of(conversations).select("conv_id", "message", "role", F.coalesce("text", F.lit("")).alias("text"))
    size = F.greatest(F.ceil(F.char_length("text") / PIECES), F.lit(1)).cast("int")
    rows = rows.withColumn("pieces", F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(F.col("text"), k * size + 1, size)))

    def event(kind: str, text: Column, later: int = 0) -> Column:
        return F.struct(F.lit(kind).alias("event"), (F.col("message") + later).alias("message"), (F.lit("nobody") if later else F.col("role")).alias("role"), text.alias("text"))

    deltas = lambda first: F.transform(F.slice("pieces", first, PIECES), lambda p: event("delta", p))
    piece = F.col("pieces")[0]
    edited = F.concat(F.array(event("message", F.lit("a draft")), event("edit", piece)), deltas(2))
    false_start = [event("message", F.lit("a false")), event("delta", F.lit(" start")), event("message", F.lit("an answer to it"), 1), event("regenerate", F.lit(None).cast("string"))]
    regenerated = F.concat(F.array(*false_start), deltas(1))
    plain = F.concat(F.array(event("message", piece)), deltas(2))
    kind = F.col("message") % 3
    log = rows.select("conv_id", F.col("message").alias("place"), F.posexplode(F.when(kind == 0, edited).when(kind == 1, regenerated).otherwise(plain)).alias("k", "e"))
    return log.select("conv_id", (F.col("place") * 16 + F.col("k")).alias("seq"), "e.event", "e.message", "e.role", "e.text")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Format all conversations, as a chat that streams them, and digest what reads back."""
    back = read_back(render(fold_events(streamed_events_of(conversations))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    digests = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return digests.select("conv_id", "n_turns", sha("told").alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), sha("loss").alias("loss_sha256"), "formatted_chars")
