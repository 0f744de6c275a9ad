"""Chat formatting with typed content parts, in built-in functions only.

A turn's content is an ordered list of parts: text, image, audio or document.  A visitor (:func:`visit`) flattens the list:
text is escaped, every other part becomes a placeholder ``<|image:3|>`` numbered in order over the conversation's turn, its
reference is recorded, and the tokens it will take once expanded are counted.  A formatted conversation is

    <|turn|>role\\ncontent<|end|>   for every turn, in order

Texts and roles are escaped so that no control string can stand inside them, and reversibly: backslash, ``<`` and ``[``
become ``\\\\e``, ``\\\\l`` and ``\\\\b`` (a backslash in the output is always followed by one of these letters).  A loss mask
is a list of (start, length) in characters, one for each assistant turn's content; placeholders of parts that an assistant's turn
has are under the mask with its text.

Rows of one conversation meet as one row, which the format asks for: a conversation is one training example, as large as its
own turns.  Many conversations with the same content stay apart (their ids differ).

Defined results: null texts and missing parts are empty; a null role is an empty role; turns are in the order of ``turn``
(nulls first), then role, then text (with parts: then content), and repeated rows stay; rows with a null conv_id are one conversation; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TURN, END = "<|turn|>", "<|end|>"
LOSS_ROLE = "assistant"
#: Tokens that a part other than text takes when expanded, for each unit of its ``amount`` (images, seconds, pages).
EXPANDED = (("image", 576), ("audio", 25), ("document", 1024))
PART = "struct<type:string,text:string,ref:string,amount:bigint>"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("[", "\\b"), ("<", "\\l"), ("\\", "\\e")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def text_part(text: Column) -> Column:
    """A content list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("amount"))).cast(f"array<{PART}>")


def visit(parts: Column) -> Column:
    """content, attachments (place, type, ref, tokens) and expanded_tokens of a list of parts.

    A part of a type not known counts as text if it has one, and as nothing otherwise.
    """
    kinds = [k for k, _ in EXPANDED]
    tokens = F.lit(0).cast("bigint")
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())

    def each(p: Column, i: Column) -> Column:
        cost = F.lit(0).cast("bigint")
        for k, n in EXPANDED:
            cost = F.when(p["type"] == k, F.coalesce(p["amount"], F.lit(1)) * n).otherwise(cost)
        other = F.coalesce(p["type"].isin(*kinds), F.lit(False))
        shown = F.when(other, F.concat(F.lit("<|"), p["type"], F.lit(":"), i.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))
        return F.struct(i.cast("int").alias("place"), other.alias("other"), p["type"].alias("type"), p["ref"].alias("ref"), cost.alias("tokens"), shown.alias("shown"))

    seen = F.transform(parts, each)
    return F.transform(
        F.array(seen),
        lambda s: F.struct(
            F.array_join(F.transform(s, lambda x: x["shown"]), "").alias("content"),
            F.transform(F.filter(s, lambda x: x["other"]), lambda x: F.struct(x["place"], x["type"], x["ref"], x["tokens"])).alias("attachments"),
            F.aggregate(s, tokens, lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
        ),
    )[0]


def format_conversations(turns: DataFrame, parts: Column | None = None) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_mask, attachments, expanded_tokens.

    turns: conv_id, turn, role, text; ``parts`` gives a turn's content list instead of its text.
    """
    content = visit(text_part(F.coalesce(F.col("text"), F.lit(""))) if parts is None else parts)
    tie = F.coalesce(F.col("text"), F.lit("")) if parts is None else F.col("c.content")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), content.alias("c"), *(["text"] if parts is None else []))
    each = F.struct("turn", "role", tie.alias("tie"), F.col("c.content").alias("content"), F.col("c.attachments").alias("attachments"), F.col("c.expanded_tokens").alias("expanded_tokens"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(each), _before).alias("t"))
    head = lambda x: F.concat(F.lit(TURN), escape(x["role"]), F.lit("\n"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(head(x), x["content"], F.lit(END))), "")
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(head(x)) + F.length(x["content"]) + len(END)).cast("bigint").alias("at"),
            F.when(x["role"] == LOSS_ROLE, F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(head(x))).cast("bigint").alias("start"), F.length(x["content"]).cast("bigint").alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    found = F.flatten(F.transform("t", lambda x, i: F.transform(x["attachments"], lambda y: F.struct(i.cast("int").alias("turn"), y["place"], y["type"], y["ref"], y["tokens"]))))
    return grouped.select("conv_id", whole.alias("formatted"), spans.alias("loss_mask"), found.alias("attachments"), F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["expanded_tokens"]).alias("expanded_tokens"))


def _before(x: Column, y: Column) -> Column:
    """By turn (nulls first), then role, then text (as it is, not as it is escaped)."""
    out = F.lit(0)
    for c in ("tie", "role", "turn"):
        a, b = x[c], y[c]
        out = F.when(a.eqNullSafe(b), out).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)
    return out


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: role and text, unescaped (placeholders stay as they are)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(x, F.lit(len(TURN) + 2) + F.length(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), "\n", 1)))).alias("text"),
        ),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted rows hold, read back from them."""
    turns = F.col("turns")
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked.alias("masked"))
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select -7L as conv_id, 0L as turn, 'user' as role, '{hard}' as text union all select -7L, 1L, 'assistant', '{hard}'")
    return digest(format_conversations(turns.unionByName(more)))
