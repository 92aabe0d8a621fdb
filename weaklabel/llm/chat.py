"""Chat formatting from an event log, with DataFrame functions only.

Events carry a conversation, a sequence number, a kind, a message, a role and a text. Within a conversation they are
sorted by sequence and folded into final messages:

* ``message`` starts message ``message`` with this text;
* ``delta`` appends its text to the message (a streamed piece);
* ``edit`` replaces the text of the message by its own, and later deltas append to that;
* ``regenerate`` starts the message anew with its own text and drops every message that began between the message and this
  event; a dropped message stays dropped, whatever comes for it later.

The final messages are rendered in the order in which they began. Each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``;
inside roles and texts ``&`` becomes ``&a;``, ``<|`` becomes ``&l;`` and, in roles, a line break becomes ``&n;``. So no text
can hold a control string, and ``parse`` gives back every turn exactly. Texts of the role ``assistant`` are under the loss
mask.

One conversation ends up in one row, as its rendered text is one cell; before that, events are numbered by a sorted window
and pieces are joined per message, so no list holds a whole log.

``log_of`` writes a table of final turns as the log that a stream of them could have left: texts come in pieces, some after
a draft that an edit replaces, some after a draft that is regenerated together with a turn that followed it.

Defined cases: a null text is the empty text; a null role is the empty role; null conversations form one conversation;
events of equal sequence go by message, kind, role and text; repeated rows are repeated events; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&a;")), F.lit("<|"), F.lit("&l;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&l;"), F.lit("<|")), F.lit("&a;"), F.lit("&"))


def messages_as_events(rows: DataFrame, conversation: str = "conv_id", sequence: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log of whole messages, one event for each row."""
    return rows.select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.col(sequence).cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("message"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


#: Places in the log that a turn may take.
_STRIDE = 8


def log_of(rows: DataFrame, conversation: str = "conv_id", sequence: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log of messages, deltas, edits and regenerations whose final messages are ``rows``.

    A third of the turns, by a hash of what they say, are streamed: a beginning and two deltas. A third are drafts that an
    edit replaces by the beginning, and deltas. A third are drafts that an answer follows, before a regeneration drops
    that and starts anew with the beginning, and deltas.
    """
    plain = messages_as_events(rows, conversation, sequence, role, text)
    turn = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    turns = plain.withColumn("at", F.row_number().over(turn) * _STRIDE)
    n = F.char_length("text")
    first, second = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    own, draft = F.concat(F.lit("m"), F.col("at")), F.reverse("text")
    piece = lambda a, b: F.substr(F.col("text"), a + 1, b - a)

    def event(step: int, kind: str, said: Column, message: Column = own, by: Column | None = None) -> Column:
        return F.struct(
            (F.col("at") + step).cast("long").alias("seq"), F.lit(kind).alias("kind"), message.alias("message"), (F.col("role") if by is None else by).alias("role"), said.alias("text")
        )

    start = piece(F.lit(0), first)
    rest = [event(5, "delta", piece(first, second)), event(6, "delta", piece(second, n))]
    streamed = F.array(event(0, "message", start), *rest)
    edited = F.array(event(0, "message", draft), event(1, "delta", F.lit("!")), event(2, "edit", start), *rest)
    dropped = F.concat(F.lit("d"), F.col("at"))
    regenerated = F.array(event(0, "message", draft), event(1, "message", F.lit("so?"), dropped, F.lit("user")), event(2, "delta", draft, dropped, F.lit("user")), event(3, "regenerate", start), *rest)
    way = F.pmod(F.xxhash64("conv_id", "at", "text"), F.lit(3))
    log = F.when(way == 0, streamed).when(way == 1, edited).otherwise(regenerated)
    return turns.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """Conversations with their final turns: conv_id, turns (array of role and text, in order).

    ``events``: conv_id, seq, kind, message (null for an event that is a message of its own), role, text.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "message", "kind", "role", "text")
    place = events.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("place", F.row_number().over(order))
    place = place.withColumn("message", F.coalesce("message", F.concat(F.lit("#"), F.col("place").cast("string"))))
    whole_message = Window.partitionBy("conv_id", "message")
    begun = place.withColumn("began", F.min("place").over(whole_message))
    # at the place where a message began: the earliest message that is regenerated from there on
    cleared = Window.partitionBy("conv_id").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    begun = begun.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("began"))).over(cleared))
    dropped = F.max((F.col("place") == F.col("began")) & F.coalesce(F.col("cut") < F.col("began"), F.lit(False))).over(whole_message)
    live = begun.withColumn("dropped", dropped).where(~F.col("dropped"))
    reset = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("place"))).over(whole_message)
    kept = live.withColumn("reset", F.coalesce(reset, F.lit(-1)))
    kept = kept.withColumn("piece", F.when(F.col("place") >= F.col("reset"), F.col("text")).otherwise(F.lit("")))
    joined = kept.groupBy("conv_id", "message").agg(
        F.min("began").alias("began"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("place"))).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "").alias("text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("began", F.coalesce("role", F.lit("")).alias("role"), "text")))
    return joined.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id and the formatted text of its turns."""

    def turn(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit("\n"), F.lit("&n;"))
        return F.concat(F.lit(START), role, F.lit("\n"), escape(t["text"]), F.lit(f"{END}\n"))

    return conversations.select("conv_id", F.array_join(F.transform("turns", turn), "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """The turns of a formatted text: adds turns (role, text, loss) to conv_id and formatted."""
    pieces = F.split("formatted", r"<\|im_start\|>")
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = unescape(F.replace(head, F.lit("&n;"), F.lit("\n")))
        length = F.char_length(piece) - F.char_length(head) - 1 - len(f"{END}\n")
        text = unescape(F.substr(piece, F.char_length(head) + 2, length))
        return F.struct(role.alias("role"), text.alias("text"), (role == LOSS_ROLE).alias("loss"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def digest(parsed: DataFrame) -> DataFrame:
    """Digests of what a formatted text gives back."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
