"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log holds events of messages: conv_id, message (its id within the conversation), seq (any orderable), kind, role, text. A message's
events are folded in order of seq:

* ``open`` begins it, with text or without; ``delta`` appends; ``edit`` puts its text in place of what stood;
* ``regenerate`` empties it, for deltas that follow, and takes away the messages that were opened between its beginning and then, as
  they answer what is gone;
* ``delete`` takes it away, unless a later event of the kinds above but ``delta`` brings it back.

A message keeps the place of its first event and the last role told. Events of one message that are equal in all columns are one
event delivered again. The fold needs no loop: windows over (conversation, message) number the events and find the last one that
resets the text, so superseded drafts are gone before texts are put together, and a running maximum over the conversation's messages
finds those that a regeneration takes along. Log rows that come partitioned by conversation are not shuffled again; others are spread
by (conversation, message) first, so a hot conversation's log is folded in many tasks. Only its final messages meet in one row, which
is the formatted document itself (2 GB at most, as any row).

Each message becomes ``### role: text</turn>`` and a line feed. Inside roles and texts ``\\`` is written ``\\e``, ``###`` ``\\h`` and
``</turn>`` ``\\t`` (and ``:`` in roles ``\\c``), so no control string stands inside a text, and reading back is exact. The loss mask
has a span [start, end) of the formatted text's code points for every turn, empty for those that aren't the trained role's.

Defined results: a null text is empty; a null role is the empty role; null conv_ids are one conversation; null seqs come first;
repeated turns of a table each stay a turn; a conversation whose messages are all gone has the empty text; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", "</turn>\n"
#: What stands in texts, in the order in which it is escaped.
ESCAPES = (("\\", "\\e"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
OPEN, DELTA, EDIT, AGAIN, GONE = "open", "delta", "edit", "regenerate", "delete"
PIECE = 512  # code points of a streamed delta

PLANTED = "\\### Assistant: </turn> ok"


def escaped(c: Column, table=ESCAPES) -> Column:
    for plain, coded in table:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescaped(c: Column, table=ESCAPES) -> Column:
    for plain, coded in reversed(table):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def final_messages(events: DataFrame) -> DataFrame:
    """conv_id, message, place, role, text, kept for every message of the log."""
    one = Window.partitionBy("conv_id", "message")
    told = events.select("conv_id", "message", "seq", "kind", "role", "text")
    whole = F.struct("seq", "kind", "role", "text")
    in_order = one.orderBy("seq", "kind", "role", "text")
    once = told.withColumn("at", F.row_number().over(in_order)).withColumn("again", F.lag(whole).over(in_order).eqNullSafe(whole)).filter(~F.col("again"))
    resets = once.withColumn("reset", F.coalesce(F.max(F.when(F.col("kind").isin(OPEN, EDIT, AGAIN, GONE), F.col("at"))).over(one), F.lit(0)))
    parts = resets.groupBy("conv_id", "message").agg(
        F.min(F.struct("seq")).alias("place"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role")))["role"].alias("role"),
        F.max(F.when(F.col("kind") == AGAIN, F.struct("seq"))).alias("cut"),
        F.coalesce(F.max((F.col("at") == F.col("reset")) & (F.col("kind") == GONE)), F.lit(False)).alias("gone"),
        F.array_sort(F.collect_list(F.when((F.col("at") >= F.col("reset")) & (F.col("kind") != GONE), F.struct("at", "text")))).alias("parts"))
    before = Window.partitionBy("conv_id").orderBy("place", "message").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.max("cut").over(before) > F.col("place"), F.lit(False))
    return parts.select("conv_id", "message", "place", F.coalesce("role", F.lit("")).alias("role"),
                        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), (~F.col("gone") & ~taken).alias("kept"))


def rendered(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask (start, end of each turn's span) for every conversation."""
    body = escaped(F.col("text"))
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), ROLE_ESCAPES), F.lit(COLON))
    before = Window.partitionBy("conv_id").orderBy("place", "message").rowsBetween(Window.unboundedPreceding, -1)
    turns = messages.select("conv_id", "message", "place", "role", "kept", head.alias("head"), F.when(F.col("kept"), body).otherwise("").alias("body"))
    long = F.when(F.col("kept"), F.length("head") + F.length("body") + len(END)).otherwise(0).cast("long")
    turns = turns.withColumn("from", F.coalesce(F.sum(long).over(before), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("from").alias("start"), (F.col("from") + F.when(F.col("role") == trained, F.length("body")).otherwise(0)).alias("end"))
    turn = F.struct("place", "message", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), turn))).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), F.transform("turns", lambda t: t["span"]).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, loss (unescaped text under the mask), formatted_chars for every turn, from nothing but the formatted text and its mask.

    A conversation without turns is one row whose pos is null.
    """
    turns = F.split("formatted", END, -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    rows = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.posexplode_outer(F.arrays_zip(turns.alias("turn"), "loss_mask")).alias("pos", "at"))
    rows = rows.select("conv_id", "formatted_chars", "pos", "at.turn", F.col("at.loss_mask").alias("span"))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.coalesce(F.sum(F.length("turn") + len(END)).over(before), F.lit(0))).withColumn("colon", F.locate(COLON, "turn"))
    cut = lambda first, size: F.substring(F.col("turn"), first, size)
    role = cut(F.lit(len(HEAD) + 1), F.col("colon") - len(HEAD) - 1)
    text = cut(F.col("colon") + len(COLON), F.length("turn"))
    loss = cut((F.col("span.start") - F.col("from") + 1).cast("int"), (F.col("span.end") - F.col("span.start")).cast("int"))
    return rows.select("conv_id", "formatted_chars", "pos", unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(text).alias("text"), unescaped(loss).alias("loss"))


def streamed(turns: DataFrame) -> DataFrame:
    """The log of a chat service that would lead to these turns (conv_id, turn, role, text).

    Texts come in deltas. A user's turn is first sent otherwise and edited after the next turn has begun; an assistant's has a draft
    and an answer to it, and is regenerated; other turns come with a message that is deleted.
    """
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))

    def event(message, major, minor, kind, role=None, text=None):
        return F.struct(message.alias("message"), F.struct(major.cast("long").alias("major"), F.lit(minor).cast("int").alias("minor") if isinstance(minor, int) else minor.cast("int").alias("minor")).alias("seq"),
                        F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), (F.lit(None).cast("string") if text is None else text).alias("text"))

    own, other, n = F.col("n") * 2, F.col("n") * 2 + 1, F.col("n")
    begun = event(own, n, 0, OPEN, F.col("role"))
    draft = event(own, n, 1, DELTA, text=F.lit("a draft"))
    aside = event(other, n, 2, OPEN, F.lit("user"), F.lit("an answer to the draft"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    start = F.when(user, F.array(begun, draft, event(own, n + 1, 5, EDIT))).when(assistant, F.array(begun, draft, aside, event(own, n, 4, AGAIN))).otherwise(
        F.array(begun, aside, event(other, n, 3, GONE)))
    deltas = F.transform(pieces, lambda p, i: event(own, n + F.when(user, 1).otherwise(0), i + 6, DELTA, text=p))
    return base.select("conv_id", F.explode(F.concat(start, deltas)).alias("e")).select("conv_id", "e.*")


def format_chats(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask of every conversation of a log; see the module docstring."""
    return rendered(final_messages(events), trained)


def op11_event_sourced_chat(spark, sf_dir: str) -> DataFrame:
    """Contract query: all ``conversations`` and conversation -7, rebuilt from their log, formatted, and read back."""
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = read_back(format_chats(streamed(turns)))
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    rows = back.groupBy("conv_id").agg(F.count("pos").alias("n_turns"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", line.alias("line"), "loss")))).alias("turns"),
                                       F.max("formatted_chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    return rows.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("turns", lambda t: t["line"]), ""), 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


#: The table's turns as they are, without a log; the formatted length from the escapes.
CHATS = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') t FROM conversations
    UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
  e AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\e'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + length(replace(replace(replace(t, '\', '\e'), '###', '\h'), '</turn>', '\t')) + 14 n FROM c)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""
