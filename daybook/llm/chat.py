"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar: a conversation is a sequence of turns; a turn is
``### <Role>: <text></turn>`` and a newline.  Inside role and text a backslash
starts a two-character escape; ``</turn>`` is written ``<\\/turn>`` and ``### `` is
written ``\\#\\#\\# ``; in a role also ``:`` is ``\\:``.  So the control strings only ever stand for themselves
and the parser is deterministic: split at the end marker, take the role up to
the first unescaped colon, undo escapes from left to right.

Round trip: every turn is first rendered as it is and parsed back.  Where the
parser finds another number of turns or headers, another role or another text,
the turn's content is escaped; that form always parses back.  ``round_trip``
compares all turns recovered from the joined text with the source.

The loss mask is ``loss_spans``: (first character, length) of each assistant
text in the formatted text, in code points, from 0.

Scale: rendering is per turn; a conversation is one row of output, so its
turns meet in one task: the result itself is one text and one hash over it.

Results for odd input: a null text or role is empty; turns sort by turn, role, text,
nulls first, and repeated rows are repeated turns; rows with a null id are one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
LOSS_ROLE = "assistant"


def _escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(c, F.lit(HEAD), F.lit("\\#\\#\\# "))


def _escape_role(c: Column) -> Column:
    return F.replace(_escape(c), F.lit(":"), F.lit("\\:"))


def _unescape(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"(?s)\\(.)", "$1")).otherwise(c)


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(": "), text, F.lit(END + "\n"))


def _parsed(turn: Column) -> Column:
    """The (role, text) of one turn without its end marker."""
    # a role is a run of plain characters and escapes; what follows its colon is the text
    # (possessive: the matcher neither goes back nor nests, however long the role)
    head = F.regexp_extract(turn, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)
    return F.struct(
        _unescape(head).alias("role"),
        _unescape(F.substr(turn, F.length(head) + len(HEAD) + 3)).alias("text"),
    )


def _count(c: Column, marker: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)


def format_conversations(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id_col, formatted, loss_spans, round_trip), one row per conversation."""
    src = rows.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    plain = _turn(F.col("role"), F.col("text"))
    back = _parsed(F.substr(F.col("plain"), F.lit(1), F.length("plain") - len(END) - 1))
    same = (
        (_count(F.col("plain"), END) == 1)
        & (_count(F.col("plain"), HEAD) == 1)
        & (back["role"] == F.col("role"))
        & (back["text"] == F.col("text"))
    )
    made = (
        src.withColumn("plain", plain)
        .withColumn("same", same)
        .select(
            "id",
            "turn",
            "role",
            "text",
            F.when(F.col("same"), F.col("role")).otherwise(_escape_role(F.col("role"))).alias("r"),
            F.when(F.col("same"), F.col("text")).otherwise(_escape(F.col("text"))).alias("x"),
        )
    )
    size = F.length(_turn(F.col("r"), F.col("x")))
    before = Window.partitionBy("id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("begin", F.coalesce(F.sum(size).over(before), F.lit(0)))
    turns = placed.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "begin", "r", "x"))).alias("turns")
    )
    joined = F.array_join(F.transform("turns", lambda t: _turn(t["r"], t["x"])), "")
    out = turns.select("id", "turns", joined.alias("formatted"))
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == LOSS_ROLE),
        lambda t: F.struct(
            (t["begin"] + len(HEAD) + F.length(t["r"]) + 2).alias("start"), F.length(t["x"]).alias("length")
        ),
    )
    recovered = parse_turns(F.col("formatted"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return out.select(
        F.col("id").alias(id_col), "formatted", spans.alias("loss_spans"), (recovered == source).alias("round_trip")
    )


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> recovered from a formatted conversation."""
    parts = F.split(formatted, END + "\n")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), _parsed)


def masked(formatted: DataFrame) -> Column:
    """The text under the loss mask: what ``loss_spans`` cut out of the formatted text, unescaped, in order."""
    cuts = F.transform("loss_spans", lambda p: _unescape(F.substr(F.col("formatted"), p["start"] + 1, p["length"])))
    return F.array_join(cuts, "")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted text and its mask alone give back: turns, their hash, and the text under the mask."""
    turns = parse_turns(F.col("formatted"))
    both = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("turns", turns).withColumn("loss", masked(formatted)).select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(both, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
