r"""Chat formatting by relational expressions: one training text per conversation, and back.

The turns of a conversation are collected as structs and sorted; adjacent turns of one
role are merged into a block by array functions, and blocks are concatenated::

    <turn user>first text<next>second text of the same role</turn>
    <turn assistant>answer</turn>

Control strings inside texts are quoted reversibly: after the ``<`` of a control
string, and of one that is quoted already, a backslash is put in; reading takes one
away.  Texts without a control string stay as they are.  Roles stand in the marks
with ``&``, ``<`` and ``>`` written as entities.

``loss_runs`` covers the formatted text from start to end by runs of code points, those
of an assistant's texts under loss, marks and other roles not.  Reading back splits
the formatted text at its marks alone.

Only built-in functions are used.  Quoting is done row by row before the shuffle; each
turn is looked at a fixed number of times, so a conversation costs time in proportion
to its length.  A conversation becomes one string and is thus one row by definition.

Null texts are empty, null roles are an empty role, null conversations are one
conversation of their own.  Turns of equal number follow role, then text; a null
number comes first; repeated rows are turns of their own.  Very long texts are kept
whole.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.columns import bound

OPEN, SHUT, CLOSE, NEXT = "<turn ", ">", "</turn>\n", "<next>"
# What begins like a control string, quoted or not.
CONTROL = r"<(\\*)(turn |/turn>|next>)"
QUOTED = r"<\\(\\*)(turn |/turn>|next>)"
LOSS_ROLE = "assistant"
EXTRA_ID = -7
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def quote(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<\\$1$2")


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, QUOTED, r"<$1$2")


def quote_role(role: Column) -> Column:
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        role = F.replace(role, F.lit(character), F.lit(entity))
    return role


def unquote_role(role: Column) -> Column:
    for character, entity in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        role = F.replace(role, F.lit(entity), F.lit(character))
    return role


def with_extra(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with conversation -7, whose texts hold what templates use."""
    spark = conversations.sparkSession
    kind = conversations.schema["conv_id"].dataType
    extra = spark.range(2).select(
        F.lit(EXTRA_ID).cast(kind).alias("conv_id"),
        F.col("id").cast(conversations.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role merged: array of (role, texts)."""

    def merged(turns: Column) -> Column:
        changes = F.transform(
            turns, lambda t, i: F.when((i == 0) | (t["role"] != F.get(turns, i - 1)["role"]), i)
        )
        return bound(F.filter(changes, lambda i: i.isNotNull()), lambda starts: between(turns, starts))

    def between(turns: Column, starts: Column) -> Column:
        def block(start: Column, number: Column) -> Column:
            end = F.coalesce(F.get(starts, number + 1), F.size(turns))
            own = F.slice(turns, start + 1, end - start)
            return F.struct(
                F.get(turns, start)["role"].alias("role"), F.transform(own, lambda t: t["text"]).alias("texts")
            )

        return F.transform(starts, block)

    return bound(turns, merged)


def _runs(blocks: Column) -> Column:
    """(chars, loss) of the formatted text from start to end."""

    def run(chars: Column, loss: Column | bool) -> Column:
        return F.struct(chars.cast("long").alias("chars"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

    def of_block(block: Column) -> Column:
        opening = F.lit(len(OPEN) + len(SHUT)) + F.length(block["role"])
        texts = F.transform(
            block["texts"],
            lambda text, i: F.array(
                run(F.when(i == 0, opening).otherwise(len(NEXT)), False),
                run(F.length(text), block["role"] == LOSS_ROLE),
            ),
        )
        return F.concat(F.flatten(texts), F.array(run(F.lit(len(CLOSE)), False)))

    return F.flatten(F.transform(blocks, of_block))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_runs: one row per conversation."""
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("turn"),
    )
    # Sorted by the texts themselves, quoted before the shuffle.
    quoted = turns.select(
        "conv_id",
        F.struct(
            F.col("turn.turn").alias("turn"),
            F.col("turn.role").alias("plain_role"),
            F.col("turn.text").alias("plain"),
            quote_role(F.col("turn.role")).alias("role"),
            F.when(F.col("turn.text").contains("<"), quote(F.col("turn.text"))).alias("quoted"),
        ).alias("turn"),
    )
    collected = quoted.groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))
    ordered = F.transform(
        F.array_sort("turns"),
        lambda t: F.struct(t["role"].alias("role"), F.coalesce(t["quoted"], t["plain"]).alias("text")),
    )

    def text_of(block: Column) -> Column:
        return F.concat(F.lit(OPEN), block["role"], F.lit(SHUT), F.array_join(block["texts"], NEXT), F.lit(CLOSE))

    def both(blocks: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(blocks, text_of), "").alias("formatted"), _runs(blocks).alias("loss_runs")
        )

    made = collected.select("conv_id", bound(_blocks(ordered), both).alias("made"))
    return made.select("conv_id", "made.formatted", "made.loss_runs")


def read_back(formatted: Column) -> Column:
    """Array of (role, texts) of the blocks of a formatted text; roles and texts unquoted."""

    def block(part: Column) -> Column:
        # An opening mark ends at the first of its closing signs, a block at its closing mark.
        role = F.substring_index(part, SHUT, 1)
        body = F.regexp_extract(part, r"(?s)^[^>]*>(.*)</turn>\n$", 1)
        return F.struct(
            unquote_role(role).alias("role"),
            F.transform(F.split(body, NEXT, -1), lambda t: F.when(t.contains("<"), unquote(t)).otherwise(t)).alias("texts"),
        )

    # What comes before the first mark is empty.
    return bound(F.split(formatted, OPEN, -1), lambda parts: F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), block))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of turns and loss text, read back from (conv_id, formatted)."""

    def digests(blocks: Column) -> Column:
        every = F.flatten(
            F.transform(
                blocks, lambda b: F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n")))
            )
        )
        under = F.flatten(F.transform(F.filter(blocks, lambda b: b["role"] == LOSS_ROLE), lambda b: b["texts"]))
        return bound(
            F.struct(every.alias("turns"), F.array_join(under, "").alias("loss"), F.size(blocks).alias("blocks")),
            lambda read: F.struct(
                F.size(read["turns"]).cast("long").alias("n_turns"),
                F.sha2(F.array_join(read["turns"], ""), 256).alias("turns_sha256"),
                F.length(read["loss"]).cast("long").alias("loss_chars"),
                F.sha2(read["loss"], 256).alias("loss_sha256"),
                read["blocks"].cast("long").alias("n_blocks"),
            ),
        )

    read = formatted.select(
        "conv_id", "formatted", bound(read_back(F.col("formatted")), digests).alias("read")
    )
    return read.select(
        "conv_id",
        "read.n_turns",
        "read.turns_sha256",
        "read.loss_chars",
        "read.loss_sha256",
        F.length("formatted").cast("long").alias("formatted_chars"),
        "read.n_blocks",
    )


def chat_digests(conversations: DataFrame) -> DataFrame:
    return conversation_digests(format_conversations(with_extra(conversations)))
