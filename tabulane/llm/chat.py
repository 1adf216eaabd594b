"""Chat formatting: typed content parts flattened into one marked-up text with a loss mask and its attachments.

A turn is written `<|im_start|>role NEWLINE body <|im_end|> NEWLINE`. Inside roles and texts a backslash goes after every
backslash and every `<` (a line break in a role becomes `<n`), so no text can hold `<|` and every turn can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PART = "struct<kind:string,text:string,ref:string,units:bigint>"
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}  # tokens of a tile, of a second, of a page
OTHER = "attachment"  # placeholder of a kind not listed; each unit counts as one token


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\\])\\", "$1")


def text_part(text: Column) -> Column:
    """A content list of one text."""
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))
    return F.array(part)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _placeholder(part: Column) -> Column:
    named = F.when(part["kind"].isin(*TOKENS_PER_UNIT), part["kind"]).otherwise(OTHER)
    return F.concat(F.lit("<|"), named, F.lit("|>"))


def flatten(parts: Column) -> Column:
    """The body of a turn: escaped texts and placeholders, in order. A part without a kind is text; null texts are empty."""
    visit = F.transform(parts, lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(_placeholder(p)))
    return F.array_join(F.coalesce(visit, F.array().cast("array<string>")), "")


def attachments(parts: Column) -> Column:
    """(place among the parts, kind, ref, expanded tokens) of every part that is not text."""

    def expanded(p: Column) -> Column:
        per_unit = F.coalesce(F.create_map(*[F.lit(x) for kv in TOKENS_PER_UNIT.items() for x in kv])[p["kind"]], F.lit(1))
        return (F.coalesce(p["units"], F.lit(1)) * per_unit).cast("long")

    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens"), _is_text(p).alias("text")))
    kept = F.filter(numbered, lambda p: ~p["text"])
    out = F.transform(kept, lambda p: F.struct(p["part"].alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    return F.coalesce(out, F.array().cast("array<struct<part:int,kind:string,ref:string,tokens:bigint>>"))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn_from: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv, formatted, loss_mask, attachments, attachment_tokens.

    `parts` is an array of PART. loss_mask has one entry per turn: `turn_at` where the turn starts in the formatted text,
    `start` and `length` of the part under the loss within the turn, in code points (length 0: none); the body of a turn
    of `learn_from` is under the loss. Each attachment carries the number of its turn, from 0.

    Turns go by `turn`, ties by role, then body; repeated rows stay. Null roles and texts are empty, a null turn comes
    first, a null conv is a conversation of its own; an empty table has no conversation; other columns are not read. A conversation is one
    text and so has to fit a task; its turns are placed by one sort, in time linear in its length.
    """
    body = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        flatten(F.col(parts)).alias("body"),
        attachments(F.col(parts)).alias("held"),
    )
    header = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    written = body.select(
        "*", header.alias("header"), (F.char_length(header) + F.char_length("body") + len(CLOSE)).cast("long").alias("size")
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    placed = written.select(
        "*",
        F.row_number().over(order).alias("at"),
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("ends"),
    )
    loss = F.col("role") == learn_from
    item = F.struct(
        F.col("at"),
        F.concat("header", "body", F.lit(CLOSE)).alias("text"),
        F.struct(
            (F.col("ends") - F.col("size")).alias("turn_at"),
            F.char_length("header").alias("start"),
            F.when(loss, F.char_length("body")).otherwise(0).alias("length"),
        ).alias("mask"),
        F.transform(
            "held", lambda a: F.struct((F.col("at") - 1).alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
        ).alias("held"),
    )
    chats = placed.groupBy("conv").agg(F.sort_array(F.collect_list(item)).alias("items"))
    held = F.flatten(F.col("items.held"))
    return chats.select(
        F.col("conv").alias(conv),
        F.array_join("items.text", "").alias("formatted"),
        F.col("items.mask").alias("loss_mask"),
        held.alias("attachments"),
        F.aggregate(held, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_back(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns array<struct<role,text>>, loss_texts array<string>, formatted_chars): all read from the formatted text and its mask."""
    pieces = F.filter(F.split(F.col("formatted"), r"<\|im_end\|>\n"), lambda x: x != "")
    role = r"^<\|im_start\|>([^\n]*)\n"

    def turn(piece: Column) -> Column:
        raw = F.regexp_extract(piece, role, 1)
        text = F.substring(piece, F.char_length(raw) + len(OPEN) + 2, F.char_length(piece))
        return F.struct(unescape(F.replace(raw, F.lit("<n"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    cut = chats.select(F.col(conv), F.col("loss_mask"), pieces.alias("pieces"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    under = F.zip_with("pieces", "loss_mask", lambda p, m: F.when(m["length"] > 0, unescape(F.substring(p, m["start"] + 1, m["length"]))))
    return cut.select(
        F.col(conv),
        F.transform("pieces", turn).alias("turns"),
        F.filter(under, lambda x: x.isNotNull()).alias("loss_texts"),
        F.col("formatted_chars"),
    )


def chat_digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what read_back finds."""
    back = read_back(chats, conv)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join("loss_texts", "")
    return back.select(
        F.col(conv),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.col("formatted_chars"),
    )
