"""Chat formatting with a grammar round trip, with DataFrame functions only.

A conversation is rendered as one text, each turn between its role's marks:

    <<SYS>>text<</SYS>>   [INST]text[/INST]   <s>text</s>   <|role:NAME|>text<|/role|>

for system, user, assistant, and any other role by name. A deterministic parser (the next opening mark, then the text up
to its closing mark) reads turns back. A text that holds a control string, perhaps with backslashes after its first
character, would be read back differently; one backslash more after that character (``[INST]`` to ``[\\INST]``) keeps
it from being a mark, and the parser takes one off. That is a bijection, so any text comes back as it was.

Rendering starts from the plain text. Every turn is reparsed alone and compared to its source, and only those that
differ are escaped; then each whole conversation is reparsed, ``identical`` tells the outcome, and the loss mask is
taken from the parsed turns: spans of the assistant's texts in the rendered text.

Defined cases: a null text counts as empty and a null role as the role with an empty name; turns are in the order of
turn (null first), then role and text; repeated rows are turns of their own; each row with a null id, which belongs to no
other, is a conversation of one turn; a conversation must fit a task; texts may be of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

#: Roles with marks of their own: (role, opening, closing).
ROLES = [("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>")]
OTHER_OPEN, OTHER_END, OTHER_CLOSE = "<|role:", "|>", "<|/role|>"

#: What follows the first character of each control string, as alternatives; none holds a backslash.
REST_ANGLE = r"<SYS>>|</SYS>>|s>|/s>|\|role:|\|/role\|>"
REST_SQUARE = r"INST\]|/INST\]"
ESCAPE = rf"(?:(<)(\\*)(?={REST_ANGLE})|(\[)(\\*)(?={REST_SQUARE}))"
UNESCAPE = rf"(?:(<)\\(\\*)(?={REST_ANGLE})|(\[)\\(\\*)(?={REST_SQUARE}))"
#: A role's name may hold anything but its mark's end; names are escaped by the same rule, with | after a backslash.
NAME = r"(?:[^|\\]|\\.)*+"
TURN = rf"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|<\|role:{NAME}\|>.*?<\|/role\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$3$2$4")


def render_turn(role: Column, text: Column) -> Column:
    """A turn between its marks; the text is taken as it is."""
    name = F.regexp_replace(role, r"([|\\])", r"\\$1")
    out = F.concat(F.lit(OTHER_OPEN), name, F.lit(OTHER_END), text, F.lit(OTHER_CLOSE))
    for known, opening, closing in ROLES:
        out = F.when(role == known, F.concat(F.lit(opening), text, F.lit(closing))).otherwise(out)
    return out


def parse(rendered: Column) -> Column:
    """The turns of a rendered text: array of (role, text, opening, closing, raw), lengths in code points."""
    return F.transform(F.regexp_extract_all(rendered, F.lit(TURN), F.lit(0)), parsed_turn)


def parsed_turn(raw: Column) -> Column:
    head = F.regexp_extract(raw, rf"(?s)^<\|role:({NAME})\|>", 1)
    role = F.regexp_replace(head, r"(?s)\\(.)", "$1")
    opening = F.length(F.lit(OTHER_OPEN + OTHER_END)) + F.length(head)
    closing = F.lit(len(OTHER_CLOSE))
    for known, start, end in ROLES:
        here = F.startswith(raw, F.lit(start))
        role = F.when(here, F.lit(known)).otherwise(role)
        opening = F.when(here, F.lit(len(start))).otherwise(opening)
        closing = F.when(here, F.lit(len(end))).otherwise(closing)
    body = F.substring(raw, opening + 1, F.length(raw) - opening - closing)
    return F.struct(role.alias("role"), unescape(body).alias("text"), opening.alias("opening"), closing.alias("closing"), F.length(raw).alias("size"))


def round_trips(role: Column, text: Column, rendered: Column) -> Column:
    """Whether a turn's rendering is read back as that one turn."""
    turns = F.regexp_extract_all(rendered, F.lit(TURN), F.lit(0))
    back = parsed_turn(F.element_at(turns, 1))
    return (F.size(turns) == 1) & (F.element_at(turns, 1) == rendered) & (back["role"] == role) & (back["text"] == text)


def format_chats(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Rows (conv_id, formatted, turns, identical, loss_spans): the rendered text; the turns read back from it, array of
    (role, text); whether they are the source's; where the assistant's texts stand, array of (start, end) in code points."""
    source = turns.select(
        named(id_column).alias("conv_id"),
        named(turn_column).alias("turn"),
        F.coalesce(named(role_column).cast("string"), F.lit("")).alias("role"),
        F.coalesce(named(text_column).cast("string"), F.lit("")).alias("text"),
    )
    plain = render_turn(F.col("role"), F.col("text"))
    tried = source.withColumn("plain", plain)
    rendered = tried.withColumn("rendered", F.when(round_trips(F.col("role"), F.col("text"), F.col("plain")), F.col("plain")).otherwise(render_turn(F.col("role"), escape(F.col("text")))))
    one = F.struct("turn", "role", "text", "rendered")
    known = rendered.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("source"))
    grouped = known.unionByName(rendered.where("conv_id IS NULL").select("conv_id", F.array(one).alias("source")))
    whole = grouped.select("conv_id", "source", F.array_join(F.transform("source", lambda t: t["rendered"]), "").alias("formatted"))
    read = whole.withColumn("parsed", parse(F.col("formatted")))
    same = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    back = F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    covered = F.aggregate("parsed", F.lit(0), lambda total, t: total + t["size"])
    # Ends of the parsed turns by one pass over them; turns stand side by side from the start of the text.
    spans = F.aggregate(
        "parsed",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["size"]).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["opening"]).alias("start"), (acc["at"] + t["size"] - t["closing"]).alias("end")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return read.select("conv_id", "formatted", back.alias("turns"), ((same == back) & (covered == F.length("formatted"))).alias("identical"), spans.alias("loss_spans"))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
