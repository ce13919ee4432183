"""Chat formatting with typed content parts, in DataFrame functions alone.

A message's content is a list of parts: text, image, audio or document. A
visitor goes over them in order: text is escaped and written out, every other
part becomes a numbered placeholder, an entry in the list of attachments, and a
count of the tokens that it will expand to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: The control strings of common chat templates, that must not appear in a text as they are.
CONTROL = [
    "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<|",
]
#: The roles whose texts are learned.
LEARNED = ("assistant",)
#: What other parts expand to: tokens for an image tile, a second of audio, a page of a document.
IMAGE_TILE, IMAGE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 336, 144, 25, 512
#: A part. ``width`` and ``height`` in pixels, ``seconds``, ``pages``: null counts as one unit.
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def _control_pattern() -> str:
    quote = lambda s: "".join("\\" + c if c in r"\[]|/<>.^$*+?(){}" else c for c in s)
    heads = sorted({c[0] for c in CONTROL})
    cases = [f"{quote(h)}(?={'|'.join(quote(c[1:]) for c in CONTROL if c[0] == h)})" for h in heads]
    return "(?s)" + "|".join([r"\\", *cases])


def escape(text: Column) -> Column:
    r"""A backslash after each backslash and after the first character of each control string.

    The outcome holds no control string, and :func:`unescape` gives the text back.
    """
    return F.regexp_replace(text, _control_pattern(), r"$0\\")


def unescape(text: Column) -> Column:
    r"""Each backslash goes; one that follows it stays. After ``<`` or ``[`` of a control string it only parts the string."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A list of one text part."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("uri"), none.cast("int").alias("width"),
            none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
        )
    )


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part other than text takes in the model's input; at least one unit each."""
    tiles = lambda side: F.greatest(F.ceil(F.coalesce(part[side], F.lit(1)) / F.lit(IMAGE_TILE)), F.lit(1))
    return (
        F.when(part["type"] == "image", tiles("width") * tiles("height") * IMAGE_TOKENS)
        .when(part["type"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(1.0))), F.lit(1)) * AUDIO_TOKENS)
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(parts: Column) -> Column:
    """A message's parts as a list of steps: ``text`` (escaped, or null), ``type``, ``uri``, ``tokens``."""
    return F.transform(
        F.coalesce(parts, F.array().cast(f"array<{PART}>")),
        lambda p: F.struct(
            F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).alias("text"),
            F.coalesce(p["type"], F.lit("text")).alias("type"),
            p["uri"].alias("uri"),
            expanded_tokens(p).alias("tokens"),
        ),
    )


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation.

    Returns the conversation's id, ``formatted``; ``loss`` (for each turn, in
    order: how many code points to skip and how many to learn after them, the
    end mark of a learned turn not counted), ``attachments`` (turn, number, type,
    uri, tokens; numbers count from 1 within a turn) and ``expanded_tokens``.

    Turns are in the order of ``turn``, then role, then content; a null turn
    comes first. Null or absent parts are an empty text, a part without a type is
    text, a null role is the empty role; a role is escaped like a text. A null
    conversation is one of its own. Repeated rows are turns of their own. An empty
    table gives an empty table. Other columns are ignored whatever their names.
    """
    steps = messages.select(
        col(conv_col).alias("c"), col(turn_col).alias("turn"), escape(F.coalesce(col(role_col).cast("string"), F.lit(""))).alias("role"),
        F.coalesce(col(role_col).isin(*LEARNED), F.lit(False)).alias("learned"), visit(col(parts_col)).alias("steps"),
    )
    # Placeholders are numbered by the parts before them that are not text.
    numbered = steps.withColumn(
        "steps",
        F.transform(
            "steps",
            lambda s, i: F.struct(
                s["text"].alias("text"), s["type"].alias("type"), s["uri"].alias("uri"), s["tokens"].alias("tokens"),
                F.size(F.filter(F.slice("steps", 1, i + 1), lambda x: x["text"].isNull())).alias("number"),
            ),
        ),
    )
    mark = lambda s: F.concat(F.lit("<|"), escape(s["type"]), F.lit("|"), s["number"].cast("string"), F.lit("|>"))
    body = F.array_join(F.transform("steps", lambda s: F.coalesce(s["text"], mark(s))), "")
    turns = numbered.select("c", "turn", "role", "learned", body.alias("body"), F.filter("steps", lambda s: s["text"].isNull()).alias("others"))
    head = F.concat(F.lit(TURN), "role", F.lit(BODY))
    written = turns.select(
        "c",
        F.struct(
            "turn", "role", "body", "learned",
            F.char_length(head).alias("head_chars"), F.char_length("body").alias("body_chars"),
            F.transform("others", lambda s: F.struct(s["number"].alias("number"), s["type"].alias("type"), s["uri"].alias("uri"), s["tokens"].alias("tokens"))).alias("others"),
        ).alias("m"),
    )
    whole = written.groupBy("c").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    # What is skipped before a turn's learned part: its head, and the end mark of the turn before with what that did not learn.
    loss = F.transform(
        "ms",
        lambda m, i: F.struct(
            (m["head_chars"] + F.when(m["learned"], 0).otherwise(m["body_chars"])).alias("skip"),
            F.when(m["learned"], m["body_chars"]).otherwise(0).alias("learn"),
            F.lit(len(END)).alias("tail"),
        ),
    )
    attached = F.flatten(F.transform("ms", lambda m: F.transform(m["others"], lambda o: F.struct(m["turn"].alias("turn"), o["number"].alias("number"), o["type"].alias("type"), o["uri"].alias("uri"), o["tokens"].alias("tokens")))))
    return whole.select(
        F.col("c").alias(conv_col),
        F.array_join(F.transform("ms", lambda m: F.concat(F.lit(TURN), m["role"], F.lit(BODY), m["body"], F.lit(END))), "").alias("formatted"),
        loss.alias("loss"),
        attached.alias("attachments"),
        F.coalesce(F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]), F.lit(0)).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to :func:`format_chat`'s rows: ``turns`` (role, text) and ``learned`` (unescaped), from ``formatted`` and ``loss`` alone.

    No escaped text holds ``<|``, so the marks part the turns without doubt; what
    is learned is cut out of ``formatted`` by the mask alone. A turn's text is as
    given but for its placeholders: :func:`format_chat`'s ``attachments`` tell
    them from a text that spells the same.
    """
    quoted = lambda s: s.replace("|", "\\|")
    pieces = F.filter(F.split("formatted", quoted(END)), lambda p: p != "")
    halves = F.transform(pieces, lambda p: F.split(F.substring(p, len(TURN) + 1, 2**31 - 1), quoted(BODY), 2))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found"))

    def cut(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["skip"]
        return F.struct((begin + s["learn"] + s["tail"]).alias("at"), F.concat(acc["found"], F.array(F.substring("formatted", begin + 1, s["learn"]))).alias("found"))

    spans = F.aggregate("loss", start, cut, lambda acc: acc["found"])
    return formatted.withColumns(
        {
            "turns": F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text"))),
            "learned": F.array_join(F.transform(spans, unescape), ""),
        }
    )
