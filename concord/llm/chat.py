"""Chat formatting of conversations whose turns hold typed content parts.

A visitor flattens the parts of a turn in order: text is escaped, and an image, audio or
document part becomes a placeholder, with its reference and the tokens that it expands to on
record. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Escape: the opening of every control string in a text gets one more bar.
OPEN, OPEN_ESCAPED = "<|", "<||"
#: A text part's last < where another part follows: were it alone, the next part could complete it to a control string.
LAST = "<|="
#: A line break inside a role, which ends at a line break.
BREAK = "<|break|>"
#: Tokens that a part expands to where it does not say.
EXPANDS = {"image": 256, "audio": 128, "document": 512}
ASSISTANT = "assistant"
PART = "struct<type:string,text:string,ref:string,n_tokens:int>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit(OPEN_ESCAPED))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(?:(\|)|=)", "<$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*EXPANDS), F.lit(False))


def visit(part: Column, is_last: Column) -> Column:
    """What a part becomes in the turn: escaped text, or the placeholder of its type."""
    text = escape(F.coalesce(part["text"], F.lit("")))
    text = F.when(~is_last & F.endswith(text, F.lit("<")), F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(LAST))).otherwise(text)
    return F.when(_is_attachment(part), F.concat(F.lit(OPEN), part["type"], F.lit("|>"))).otherwise(text)


def attachment(part: Column) -> Column:
    """(type, ref, n_tokens) on record for a placeholder."""
    default = F.coalesce(*(F.when(part["type"] == k, F.lit(n)) for k, n in EXPANDS.items()))
    return F.struct(part["type"].alias("type"), part["ref"].alias("ref"), F.coalesce(part["n_tokens"], default).alias("n_tokens"))


def text_content(text: Column) -> Column:
    """The content of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens")))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", content: Column | str = "content") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_mask, loss_spans, attachments, n_attachment_tokens.

    content is an array of PART, or text_content(...). A turn is START role, a line break, its
    parts and END with a line break; turns go by number, then role, then content. loss_mask says
    for each turn whether it is the assistant's; loss_spans are the places (first character from
    0, length) of those texts in `formatted`. attachments lists (turn_index, type, ref, n_tokens)
    in the order of their placeholders. A null text, role, part or content is empty, a part of
    another type is read as text; what neighbouring text parts say is never a control string,
    whichever way it is cut into parts, and read_back() gives it as one text; turns that repeat are kept; rows with a null conv_id form one
    conversation; an empty table gives no rows and other columns of turns do not matter. A
    conversation becomes one value, so it must fit into a task.
    """
    parts = F.col(content) if isinstance(content, str) else content
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p, i: visit(p, i == F.size(parts) - 1)), "").alias("body"),
        F.transform(F.filter(parts, _is_attachment), attachment).alias("attached"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("whole", F.concat("head", "body", F.lit(f"{END}\n"))).withColumn("assistant", F.col("role") == ASSISTANT)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum(F.length("whole")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.struct((F.col("before") + F.length("head")).alias("first"), F.length("body").cast("long").alias("length"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "whole", "assistant", span.alias("span"), "attached"))).alias("t"))
    listed = F.flatten(F.transform("t", lambda x: F.transform(x["attached"], lambda a: F.struct((x["at"] - 1).alias("turn_index"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    return grouped.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["whole"]), "").alias("formatted"),
        F.transform("t", lambda x: x["assistant"]).alias("loss_mask"),
        F.transform(F.filter("t", lambda x: x["assistant"]), lambda x: x["span"]).alias("loss_spans"),
        listed.alias("attachments"),
        F.aggregate(listed, F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("n_attachment_tokens"),
    )


def read_parts(formatted: Column) -> Column:
    """The turns of a formatted conversation with their parts: array of (role, array of (type, text)), in order.

    A placeholder is a part of its type with a NULL text; the text between two of them is one part, empty text none. What a text
    says is escaped, so it is never taken for a placeholder. The references are in `attachments`, in the same order.
    """
    kind = "|".join(EXPANDS)
    text_part = lambda t: F.struct(F.lit("text").alias("type"), unescape(t).alias("text"))

    def parts(body: Column) -> Column:
        texts, kinds = F.split(body, rf"<\|(?:{kind})\|>"), F.regexp_extract_all(body, F.lit(rf"<\|({kind})\|>"), F.lit(1))
        placed = F.transform(kinds, lambda k: F.struct(k.alias("type"), F.lit(None).cast("string").alias("text")))
        both = F.transform(texts, lambda t, i: F.concat(F.array(text_part(t)), F.slice(placed, i + 1, F.lit(1))))
        return F.filter(F.flatten(both), lambda p: F.coalesce(p["text"] != "", F.lit(True)))

    return F.transform(_turns(formatted), lambda t: F.struct(_unescape_role(t["role"]).alias("role"), parts(t["body"]).alias("parts")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped; none of an empty one, NULL of NULL."""
    return F.transform(_turns(formatted), lambda t: F.struct(_unescape_role(t["role"]).alias("role"), unescape(t["body"]).alias("text")))


def _turns(formatted: Column) -> Column:
    """(role, body) of each turn as they are written."""
    pieces = F.split(formatted, r"<\|im_start\|>")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(role.alias("role"), F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END) - 1).alias("body"))

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)
