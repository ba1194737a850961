"""Chat formatting with typed content parts (native DataFrame code).

A message is an array of typed parts (``PARTS``).  A visitor turns each part
into a piece of the turn's text: a text part into its escaped text, an image,
audio or document part into an ordered placeholder, and records for the
latter the reference and the number of tokens the placeholder stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PARTS = (
    "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
)
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Tokens that a placeholder expands to: an image by tiles of 28 x 28 pixels, audio by the second, a document by the page.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 600
#: Turns that are joined to one piece before the pieces of a conversation meet.
TURNS_PER_PIECE = 64


def escape(text: Column) -> Column:
    r"""Make control strings inside texts inert: every ``\`` is doubled, then ``<|`` becomes ``<\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """The content of a message that is one plain text (null: empty)."""
    empty = [F.lit(None).cast(t) for t in ("string", "int", "int", "double", "int")]
    return F.array(F.struct(F.lit("text"), F.coalesce(text, F.lit("")), *empty)).cast(PARTS)


def parse_parts(content: Column) -> Column:
    """Content given as JSON: an array of parts; whatever is not such an array is one plain text."""
    parsed = F.from_json(content, PARTS)
    is_array = F.ltrim(content).startswith("[") & parsed.isNotNull()
    return F.when(is_array, parsed).otherwise(text_part(content))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def expanded_tokens(part: Column) -> Column:
    """Tokens a part's placeholder stands for: at least 1, and 0 for text; unknown sizes count as one unit."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(1)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(1)) / TILE)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * AUDIO_RATE)
    pages = F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS
    size = F.when(part["type"] == "image", tiles).when(part["type"] == "audio", audio).when(part["type"] == "document", pages)
    return F.when(_is_text(part), F.lit(0)).otherwise(F.greatest(F.lit(1), F.coalesce(size, F.lit(1)))).cast("long")


def visit_parts(parts: Column) -> tuple[Column, Column]:
    """The turn's text, and its attachments as array<struct<part,kind,ref,tokens>> in order.

    A placeholder is ``<|kind_i|>`` with the part's index ``i`` in the message.
    """
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    label = lambda p: F.regexp_replace(kind(p), "[^A-Za-z0-9]", "")
    body = F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
                F.concat(F.lit("<|"), label(p), F.lit("_"), i.cast("string"), F.lit("|>"))
            ),
        ),
        "",
    )
    numbered = F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("part"), kind(p).alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")
        ),
    )
    return F.coalesce(body, F.lit("")), F.coalesce(F.filter(numbered, lambda a: a["kind"] != "text"), F.array().cast("array<struct<part:int,kind:string,ref:string,tokens:bigint>>"))


def format_conversations(
    messages: DataFrame,
    parts_col: str,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    trained_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its formatted text, loss spans and attachments.

    Columns: the id; ``n_turns`` long; ``formatted`` string, the turns
    ``<|im_start|>role\\nbody<|im_end|>\\n`` in order; ``loss_spans``
    array<struct<turn,start,length>>: for each turn (from 0) of a trained role
    the code points of its body that count for the loss, counted from 0 after
    the turn's ``<|im_start|>``; ``attachments``
    array<struct<turn,part,kind,ref,tokens>>; ``attachment_tokens`` long.

    Rows are ordered by turn (nulls first), rows of the same turn by role and
    body.  A null role is written as an empty one, null parts as an empty
    body; null ids form one conversation.  Control strings inside roles and
    texts are escaped reversibly, see :func:`read_turns`.  Extra columns are
    left out; an empty table gives an empty result.

    A long conversation is joined in two steps: pieces of consecutive turns
    first, so that the task that makes the final text gets a few long strings
    and not all its rows.
    """
    body, attached = visit_parts(F.col(parts_col))
    role = F.replace(escape(F.coalesce(F.col(role_col).cast("string"), F.lit(""))), F.lit("\n"), F.lit(NEWLINE))
    turns = messages.select(
        F.col(id_col).alias("__id"),
        F.col(turn_col).alias("__turn"),
        F.floor(F.col(turn_col) / TURNS_PER_PIECE).alias("__piece"),
        role.alias("__role"),
        body.alias("__body"),
        attached.alias("__attached"),
        F.coalesce(F.col(role_col).isin(*trained_roles), F.lit(False)).alias("__trained"),
    )
    turns = turns.select(
        "__id",
        "__piece",
        F.struct(
            F.col("__turn").alias("turn"),
            F.col("__role").alias("role"),
            F.concat(F.lit(START), "__role", F.lit("\n"), "__body", F.lit(END + "\n")).alias("text"),
            F.when(F.col("__trained"), F.struct((F.length("__role") + 1).alias("start"), F.length("__body").alias("length"))).alias("loss"),
            F.col("__attached").alias("attached"),
        ).alias("__row"),
    )
    pieces = (
        turns.groupBy("__id", "__piece")
        .agg(F.sort_array(F.collect_list("__row")).alias("__rows"))
        .select(
            "__id",
            F.struct(
                F.col("__piece").alias("piece"),
                F.array_join(F.transform("__rows", lambda r: r["text"]), "").alias("text"),
                F.transform("__rows", lambda r: r["loss"]).alias("losses"),
                F.transform("__rows", lambda r: r["attached"]).alias("attached"),
            ).alias("__piece"),
        )
    )
    joined = pieces.groupBy("__id").agg(F.sort_array(F.collect_list("__piece")).alias("__pieces"))
    losses = F.flatten(F.transform("__pieces", lambda p: p["losses"]))
    spans = F.filter(
        F.transform(
            losses, lambda x, i: F.struct(i.alias("turn"), x["start"].alias("start"), x["length"].alias("length"))
        ),
        lambda s: s["start"].isNotNull(),
    )
    attachments = F.flatten(
        F.transform(
            F.flatten(F.transform("__pieces", lambda p: p["attached"])),
            lambda a, i: F.transform(
                a,
                lambda x: F.struct(i.alias("turn"), x["part"].alias("part"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")),
            ),
        )
    )
    return joined.select(
        F.col("__id").alias(id_col),
        F.size(losses).cast("long").alias("n_turns"),
        F.array_join(F.transform("__pieces", lambda p: p["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn(
        "attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role,text>>, unescaped: what went in, placeholders kept."""
    raw = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t: t != "")

    def one(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        rest = F.substr(t, F.length(role) + 2)
        body = F.substring_index(rest, END, 1)
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(raw, one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    raw = F.split(formatted, r"<\|im_start\|>")
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(F.get(raw, s["turn"] + 1), s["start"] + 1, s["length"]))), ""
    )
