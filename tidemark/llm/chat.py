"""Chat formatting: conversations are rebuilt from an event log, then rendered.

Events: (conv_id, message, seq, kind, role, text). `open` starts a message and `delta` appends streamed text.
`regenerate` drops what a message has so far and begins a new stream with its text, to which later deltas are appended.
`edit` puts its text in place of what the message has and ends the stream: later deltas, which still belong to that
stream, don't count until the next regeneration. `drop` takes the message away. Events are folded in order of seq:
first within chunks of CHUNK sequence numbers of a message (so that a long stream is not gathered at once), then over
the chunks. Messages are rendered in chunks of MESSAGES and joined in order of message number.

Template: `<s>[role] text </s>` and a newline for each turn. In roles and texts, & < and [ are escaped (&amp; &lt; &lsb;), so no
control string can stand inside, and unescaping gives the text back. The loss mask covers the escaped texts of the
roles in LOSS_ROLES, as segments.

Defined results: null texts and roles count as empty; events of one seq are ordered by kind, then text; repeated
events count each time; a message without events that leave it text is an empty turn; a dropped message is gone; a
conversation without messages has no row; other columns are ignored. All is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, MESSAGES = 1024, 64
LOSS_ROLES = ("assistant",)
_RESETS = ("edit", "regenerate")
_TURN = r"<s>\[([^\]]*)\] ([^<]*) </s>\n"


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsb;"), ("]", "&rsb;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("]", "&rsb;"), ("[", "&lsb;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def fold_events(events: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """(keys, message, role, text) from events, by two aggregations.

    keys: conv_id and columns that follow from conv_id and message; where events are partitioned by them, neither
    aggregation moves rows.
    """
    text = F.coalesce("text", F.lit(""))
    kind = F.col("kind")
    event = F.struct("seq", F.when(kind == "open", 0).when(kind == "delta", 2).otherwise(1).alias("rank"), text.alias("text"), kind.alias("kind"))
    parts = events.groupBy(*keys, "message", F.floor(F.col("seq") / CHUNK).alias("chunk")).agg(
        F.array_sort(F.collect_list(event)).alias("e"),
        F.min_by("role", F.struct((kind != "open").alias("later"), "seq", "role")).alias("role"),
        F.bool_or(kind == "drop").alias("dropped"),
    )
    # what counts begins with the last regeneration or edit, and of the latter's stream nothing that follows it does
    parts = parts.withColumn("at", F.array_max(F.transform("e", lambda x, i: F.when(x["kind"].isin(*_RESETS), i).otherwise(-1))))
    parts = parts.withColumn("ended", (F.col("at") >= 0) & (F.get(F.col("e"), F.col("at"))["kind"] == "edit"))
    tail = F.filter(F.col("e"), lambda x, i: (i >= F.col("at")) & (x["kind"] != "drop") & (~F.col("ended") | (i == F.col("at"))))
    own = F.struct("chunk", (F.col("at") >= 0).alias("reset"), F.array_join(F.transform(tail, lambda x: x["text"]), "").alias("text"), "ended")
    whole = parts.select(*keys, "message", "chunk", "role", "dropped", own.alias("own")).groupBy(*keys, "message").agg(
        F.array_sort(F.collect_list("own")).alias("p"),
        F.min_by("role", F.struct("chunk", "role")).alias("role"),
        F.bool_or("dropped").alias("dropped"),
    )
    whole = whole.withColumn("at", F.array_max(F.transform("p", lambda x, i: F.when(x["reset"], i).otherwise(-1))))
    whole = whole.withColumn("ended", (F.col("at") >= 0) & F.get(F.col("p"), F.col("at"))["ended"])
    text = F.array_join(F.transform(F.filter("p", lambda x, i: (i >= F.col("at")) & (~F.col("ended") | (i == F.col("at")))), lambda x: x["text"]), "")
    return whole.filter(~F.col("dropped")).select(*keys, "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def part_of(position: Column) -> Column:
    """MESSAGES positions share a part; null comes first."""
    return F.floor(F.coalesce(position, F.lit(-(1 << 62))) / MESSAGES)


def render(messages: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, segments, formatted) of messages (conv_id, part, message, role, text); part: part_of() their position.

    Messages stand in order of part, then message; a part is joined by itself before a conversation's parts are.
    segments are array<struct<piece, loss>>, and formatted is their pieces joined.
    """
    own = F.struct("message", "role", "text")
    chunks = messages.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(own)).alias("m"))

    def pieces(x: Column) -> Column:
        part = lambda piece, loss: F.struct(piece.alias("piece"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit("<s>["), escape(x["role"]), F.lit("] ")), F.lit(False)),
            part(escape(x["text"]), x["role"].isin(*loss_roles)),
            part(F.lit(" </s>\n"), F.lit(False)),
        )

    chunks = chunks.select("conv_id", "part", F.flatten(F.transform("m", pieces)).alias("segments"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "segments"))).alias("c"))
    segments = F.flatten(F.transform("c", lambda x: x["segments"]))
    return whole.select("conv_id", segments.alias("segments")).select("conv_id", "segments", F.array_join("segments.piece", "").alias("formatted"))


def turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    roles, texts = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(k)) for k in (1, 2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")


def events_of(conversations: DataFrame) -> DataFrame:
    """A log for stored conversations, such as a chat service would have: a third of the messages are streamed in two
    deltas; a third are streamed in part, regenerated and streamed anew; a third are streamed in part and edited while
    the rest of the stream is on its way. Which one a message is follows from its conversation, turn and text.

    A message is (turn, occurrence): rows of one conversation and turn are numbered in order of role and text. Rows are
    partitioned by conversation and part, which serves all that follows but the joining of parts.
    """
    text = F.coalesce("text", F.lit(""))
    nth = F.row_number().over(Window.partitionBy("conv_id", "part", "turn").orderBy("role", "text"))
    rows = conversations.select(
        "conv_id", part_of(F.col("turn")).alias("part"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"),
    )
    rows = rows.repartition("conv_id", "part").withColumn("nth", nth)
    half = (F.char_length("text") / 2).cast("int")
    event = lambda seq, kind, piece: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), piece.alias("text"))
    begin, end, none = F.left("text", half), F.substring(F.col("text"), half + 1, F.char_length("text")), F.lit("")
    streamed = F.array(event(0, "open", none), event(1, "delta", begin), event(2, "delta", end))
    again = F.array(event(0, "open", none), event(1, "delta", end), event(2, "regenerate", none), event(3, "delta", begin), event(4, "delta", end))
    edited = F.array(event(0, "open", none), event(1, "delta", begin), event(2, "edit", F.col("text")), event(3, "delta", end))
    way = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(3))
    log = F.when(way == 0, streamed).when(way == 1, again).otherwise(edited)
    return rows.select("conv_id", "part", F.struct("turn", "nth").alias("message"), "role", F.inline(log))


def format_conversations(conversations: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Rebuild stored conversations from their log and render them in order of turn (null first), role and text."""
    return render(fold_events(events_of(conversations), ("conv_id", "part")), loss_roles)


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted conversations."""
    read = formatted.select("conv_id", "formatted", turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
