"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an array of parts. The visitor (one expression over the array) writes text parts with
their control strings escaped and every other part as an ordered placeholder, and records for each
placeholder its ordinal, its reference and the tokens it stands for once expanded.

A turn becomes  <turn role="ROLE">BODY</turn>NEWLINE.  A backslash escapes itself and stands after the
`<` of a control string that was part of a text, so the template can be read back exactly.

Turns are sorted over all tasks by conversation and turn, and assembled in chunks of at most CHUNK turns;
offsets of the loss mask (the bodies of the assistant's turns) are kept within the chunk, so a conversation of
any length, with any turn numbers, is formatted, masked and read back by many tasks, and only the final digest
of a whole conversation needs its text in one row.

Defined results: null text or parts count as an empty body, a null role as the empty role; equal turn
numbers are ordered by role, then body; a null turn number comes first; rows with a null conversation id
form one conversation; repeated rows are repeated turns; a text of any length is one turn, whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns of a chunk, at most.
CHUNK = 64
CLOSE = "</turn>\n"
MARK = "<part >"
#: Expanded tokens of a part. An image has one token for each 28 x 28 patch, audio 25 a second, a document 512 a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 512
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=turn |/turn>|part )", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A message that is one text part."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    )


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to; unknown sizes count as one token."""
    tokens = (
        F.when(part["type"] == "image", F.ceil(part["width"] / F.lit(PATCH)) * F.ceil(part["height"] / F.lit(PATCH)))
        .when(part["type"] == "audio", F.ceil(part["seconds"] * F.lit(AUDIO_RATE)))
        .when(part["type"] == "document", part["pages"].cast("long") * F.lit(PAGE_TOKENS))
    )
    return F.coalesce(tokens, F.lit(1)).cast("long")


def flatten_parts(df: DataFrame, parts_col: str) -> DataFrame:
    """df with _body and _attachments (array of ordinal, type, ref, tokens) in the order of the parts."""
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART_TYPE}>"))
    is_text = lambda p: F.coalesce(p["type"] == "text", F.lit(False))
    media = F.filter(parts, lambda p: ~is_text(p))
    attachments = F.transform(
        media,
        lambda p, k: F.struct((k + 1).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")),
    )
    placeholders = F.transform(media, lambda p, k: F.concat(F.lit("<part "), escape(F.coalesce(p["type"], F.lit("unknown"))), F.lit(" "), (k + 1).cast("string"), F.lit(">")))
    # No escaped text holds MARK, so what lies between two marks is text, and the k-th mark is the k-th placeholder.
    marked = F.array_join(F.transform(parts, lambda p: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.lit(MARK))), "")
    return df.withColumns({"_texts": F.split(marked, MARK, -1), "_placeholders": placeholders, "_attachments": attachments}).withColumn(
        "_body", F.array_join(F.flatten(F.transform("_texts", lambda t, k: F.array(t, F.coalesce(F.get("_placeholders", k), F.lit(""))))), "")
    )


def format_chunks(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv_id, chunk, formatted, loss_spans, attachments): the formatted turns of each chunk in order.

    loss_spans are code points within the chunk's formatted text, the end exclusive; attachments carry
    the index of their turn within the chunk.
    """
    flat = flatten_parts(
        df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"), F.col(parts_col).alias("_parts")),
        "_parts",
    )
    open_tag = F.concat(F.lit('<turn role="'), F.replace(escape(F.col("_role")), F.lit('">'), F.lit('"\\>')), F.lit('">'))
    # One order of all rows, whose ties are alike: a row's place, not its turn number, gives its chunk.
    order = ["conv_id", "_turn", "_role", "_body", "_attachments"]
    placed = flat.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK).cast("long"))
    turns = placed.select("conv_id", "chunk", F.struct("_turn", "_role", "_body", open_tag.alias("_open"), "_attachments").alias("_t"))
    chunks = turns.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    text = F.array_join(F.transform("_ts", lambda t: F.concat(t["_open"], t["_body"], F.lit(CLOSE))), "")
    walk = F.aggregate(
        "_ts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["_open"]) + F.length(t["_body"]) + len(CLOSE)).cast("long").alias("at"),
            F.when(
                t["_role"] == "assistant",
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + F.length(t["_open"])).cast("long").alias("start"), (acc["at"] + F.length(t["_open"]) + F.length(t["_body"])).cast("long").alias("end"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    attachments = F.flatten(F.transform("_ts", lambda t, k: F.transform(t["_attachments"], lambda a: F.struct(k.alias("turn_index"), a.alias("attachment")))))
    return chunks.select("conv_id", "chunk", text.alias("formatted"), walk["spans"].alias("loss_spans"), attachments.alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs that a formatted text holds."""
    pieces = F.split(formatted, CLOSE, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def read(turn: Column) -> Column:
        rest = turn.substr(F.lit(len('<turn role="') + 1), F.length(turn))
        role = F.substring_index(rest, '">', 1)
        return F.struct(unescape(role).alias("role"), unescape(rest.substr(F.length(role) + 3, F.length(rest))).alias("text"))

    return F.transform(turns, read)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def join_chunks(chunks: DataFrame, sums: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    """One row for each conversation: the named string columns of its chunks, joined in order, and sums over its chunks."""
    made = chunks.select("conv_id", F.struct("chunk", *(c.alias(k) for k, c in columns.items())).alias("_c"), *(c.alias(k) for k, c in (sums or {}).items()))
    whole = made.groupBy("conv_id").agg(F.array_sort(F.collect_list("_c")).alias("_cs"), *(F.sum(k).alias(k) for k in sums or ()))
    return whole.select("conv_id", *(F.array_join(F.col(f"_cs.{k}"), "").alias(k) for k in columns), *(sums or ()))


def format_conversations(df: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, formatted) for each conversation."""
    chunks = format_chunks(df, **columns)
    return join_chunks(chunks, formatted=F.col("formatted"))
