"""Chat formatting of typed content parts, in DataFrame functions only.

A message is a role and an array of parts (type, text, ref, size). A visitor takes the parts in order: text is
escaped and written as it is, an image, audio or document part becomes a placeholder, and its reference and the
number of tokens it expands to are recorded. Turns are framed by markers:

    <|turn|>role\\ncontent<|end|>

Inside roles and contents `&`, `<` and `[` are written as character references (and line ends too inside roles), so
no control string of this or of other templates survives there, and `read_turns` gives back every text exactly.

Positions are code points of the formatted conversation, end exclusive. The loss mask covers the content of
assistant turns, as it stands between the frame and the marker.

Edge cases: a null text, role or part is empty, null or empty parts make an empty content; an unknown type is
treated as text if it has one and as a document otherwise; turns sort by turn (null first), then role, then content
(unescaped texts and references), so ties and repeated rows have a fixed order; a null conv_id is a conversation of its own; an empty table gives no
conversation; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"

#: Types with a placeholder, and how many units of size make a token: pixels of an image, milliseconds of audio, and
#: characters of a document.
UNITS = {"image": 784, "audio": 40, "document": 4}

PARTS = "array<struct<type:string,text:string,ref:string,size:bigint>>"

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escaped(text: Column, line_ends: bool = False) -> Column:
    for plain, written in (*_ESCAPES, *([("\n", "&#10;")] if line_ends else [])):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column, line_ends: bool = False) -> Column:
    for plain, written in reversed((*_ESCAPES, *([("\n", "&#10;")] if line_ends else []))):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """An array of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size")))


def _kind(part: Column) -> Column:
    known = F.when(part["type"].isin("text", *UNITS), part["type"])
    return F.coalesce(known, F.when(part["text"].isNull() & part["ref"].isNotNull(), "document").otherwise("text"))


def _visit(part: Column) -> Column:
    return F.when(_kind(part) == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), _kind(part), F.lit("|>")))


def _attachment(turn: Column, part: Column) -> Column:
    tokens = F.lit(None).cast("bigint")
    for kind, unit in UNITS.items():
        tokens = F.when(_kind(part) == kind, F.greatest(F.lit(1), F.ceil(F.coalesce(part["size"], F.lit(0)) / unit)).cast("bigint")).otherwise(tokens)
    return F.struct(turn.alias("turn"), _kind(part).alias("type"), part["ref"].alias("ref"), tokens.alias("tokens"))


def format_chat(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role, parts (PARTS). Per conversation: conv_id, formatted, turns (start, end, loss_start,
    loss_end; the last two null for turns without loss), attachments (turn, type, ref, tokens) in the order of their
    placeholders, and n_attachment_tokens.

    One shuffle by conversation. A conversation is one row of the result, so its turns meet in one task.
    """
    parts = F.filter(F.coalesce("parts", F.array().cast(PARTS)), lambda p: p.isNotNull())
    content = F.array_join(F.transform(parts, _visit), "")
    head = F.concat(F.lit(TURN), escaped(F.coalesce("role", F.lit("")), line_ends=True), F.lit("\n"))
    one = messages.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("loss"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: F.when(_kind(p) == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.coalesce(p["ref"], F.lit("")))), "").alias("said"),
        F.concat(head, content, F.lit(END)).alias("piece"),
        F.char_length(head).cast("bigint").alias("before"),
        F.transform(F.filter(parts, lambda p: _kind(p) != "text"), lambda p: _attachment(F.col("turn").cast("bigint"), p)).alias("attached"),
    ).withColumn("size", F.char_length("piece").cast("bigint"))
    so_far = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "said", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.withColumn("end", F.sum("size").over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "before", "loss", "piece", "attached"))).alias("rows"))
    loss = lambda r, value: F.when(r["loss"], value)
    return rows.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), loss(r, r["start"] + r["before"]).alias("loss_start"), loss(r, r["end"] - len(END)).alias("loss_end"))).alias("turns"),
        F.flatten(F.transform("rows", lambda r: r["attached"])).alias("attachments"),
    ).withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda total, a: total + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array of (role, text): the inverse of the frame and of the escapes.
    Placeholders stay as they are."""
    framed = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t != "")

    def one(turn: Column) -> Column:
        role = F.substring_index(turn, "\n", 1)
        text = F.substring(turn, F.char_length(role) + 2, F.char_length(turn))
        return F.struct(unescaped(F.replace(role, F.lit(TURN), F.lit("")), line_ends=True).alias("role"), unescaped(text).alias("text"))

    return F.transform(framed, one)


def read_loss(formatted: Column, turns: Column) -> Column:
    """The texts under the loss mask, unescaped and in order, as an array. Each is cut from its own turn, so the cost is
    that of the whole text, however many turns there are."""
    framed = F.split(formatted, r"<\|end\|>")
    cut = lambda text, t: F.when(t["loss_start"].isNotNull(), unescaped(F.substring(text, (t["loss_start"] - t["start"] + 1).cast("int"), (t["loss_end"] - t["loss_start"]).cast("int"))))
    return F.array_compact(F.zip_with(F.slice(framed, 1, F.size(turns)), turns, cut))
