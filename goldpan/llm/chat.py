"""Chat formatting with typed content parts, in DataFrame operations only.

A turn is ``<|im_start|>role`` newline, content, ``<|im_end|>`` newline. Inside roles and texts
every ``<``, any number of ``~``, ``|`` gets one ``~`` more, so no text can hold a control string;
one ``~`` less brings the text back. A newline in a role becomes the control string ``<|nl|>``.

Content is a list of typed parts. The visitor walks them in order: a text part is escaped, an image,
audio or document part becomes a placeholder such as ``<|image|>`` and is recorded as an attachment
(position among the attachments, type, reference, tokens that its placeholder expands to).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

OPEN, CLOSE, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
PART = (
    "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
)
KINDS = ("image", "audio", "document")
#: Pixels of a patch side, audio tokens a second, tokens a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 800


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", "<$1~|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)~\|", "<$1|")


def text_part(text: Column) -> Column:
    """A content list of one text part."""
    none = {f: F.lit(None) for f in ("ref", "width", "height", "seconds", "pages")}
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), *[v.alias(k) for k, v in none.items()])
    return F.array(part).cast(f"array<{PART}>")


def _tokens(part: Column) -> Column:
    """Tokens that the placeholder of a part expands to; one where its measures are missing."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    audio = F.ceil(part["seconds"] * AUDIO_RATE)
    count = (
        F.when(part["type"] == "image", image).when(part["type"] == "audio", audio)
        .otherwise(part["pages"] * PAGE_TOKENS)
    )
    return F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)).cast("bigint")


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*KINDS), F.lit(False))


def flatten(parts: Column) -> Column:
    """Content of a turn. Null parts and null texts are empty; an unknown type counts as text."""
    def visit(part: Column) -> Column:
        return F.when(_is_attachment(part), F.concat(F.lit("<|"), part["type"], F.lit("|>"))).otherwise(
            escape(F.coalesce(part["text"], F.lit("")))
        )

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit), "")


def attachments(parts: Column) -> Column:
    """Ordered (ordinal, type, ref, tokens) of the parts that have a placeholder."""
    kept = F.filter(parts, _is_attachment)
    return F.transform(
        kept,
        lambda p, i: F.struct(
            i.alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")
        ),
    )


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss, attachments, expanded_tokens: one row per conversation.

    ``messages`` has conv_id, turn, role, parts. Turns are in the order of (turn, role, content),
    null turns first; a null role is empty; a null conv_id is a conversation of its own. ``loss``
    lists, for every assistant turn, its index, and start and length of its content in code points
    from its opening marker. A conversation is one value, so its turns meet in one task.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(NEWLINE))
    content = flatten(F.col("parts"))
    turns = messages.select("conv_id", "turn", F.col("role").alias("_role"), role.alias("role"), content.alias("content"), attachments(F.col("parts")).alias("files"))
    entry = F.struct("turn", "role", "content", "files", F.coalesce(F.col("_role") == "assistant", F.lit(False)).alias("learned"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("turns"))

    def piece(t: Column) -> Column:
        return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["content"], F.lit(CLOSE + "\n"))

    spans = F.transform(
        "turns",
        lambda t, i: F.struct(
            i.alias("turn"), (F.length(t["role"]) + len(OPEN) + 1).alias("start"),
            F.length(t["content"]).alias("length"), t["learned"].alias("learned"),
        ),
    )
    files = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.transform(
                F.coalesce(t["files"], F.array().cast("array<struct<ordinal:int,type:string,ref:string,tokens:bigint>>")),
                lambda a: F.struct(i.alias("turn"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
            ),
        )
    )
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", piece), "").alias("formatted"),
        F.transform(
            F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["turn"], s["start"], s["length"])
        ).alias("loss"),
        files.alias("attachments"),
    ).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"])
    )


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``learned`` (text under each span of the mask), unescaped."""
    pieces = formatted.withColumn("_pieces", F.expr("slice(split(formatted, '<\\\\|im_start\\\\|>', -1), 2, size(split(formatted, '<\\\\|im_start\\\\|>', -1)))"))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(CLOSE) - 1)
        return F.struct(
            unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(body).alias("text")
        )

    learned = F.transform(
        "loss",
        lambda s: unescape(
            F.substring(F.element_at("_pieces", s["turn"] + 1), s["start"] - len(OPEN) + 1, s["length"])
        ),
    )
    return pieces.withColumn("turns", F.transform("_pieces", turn)).withColumn("learned", learned).drop("_pieces")


def read_back(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: formats, writes,
    reads the written conversations and takes the digests from what it parses."""
    parsed = parse_conversations(written(format_conversations(messages), "chat"))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    said = F.array_join("learned", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length(said).cast("bigint").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def text_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages of one text part each."""
    return conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
