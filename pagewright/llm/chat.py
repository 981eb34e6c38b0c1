"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "### " role ":\\n" body "\\n</turn>\\n"

``role`` is URL-encoded, so it holds no ``:``, ``#``, space or line break.  A
control string (``### `` or ``</turn>``) inside a body is preceded by a
backslash; one further backslash is put before each control string of a text
that does not come back from the parser as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE = "### ", "</turn>"
TAIL = f"\n{CLOSE}\n"
UNESCAPED = r"(?<!\\)(?:### |</turn>)"
TURN_CUT = r"(?<!\\)### "
MAX_ROUNDS = 2      # raw, then escaped: one backslash per control string always parses back


def escape(text: Column) -> Column:
    """A backslash right before every control string."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("\\" + s)), (OPEN, CLOSE), text)


def unescape(body: Column) -> Column:
    return reduce(lambda c, s: F.replace(c, F.lit("\\" + s), F.lit(s)), (OPEN, CLOSE), body)


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit(":\n"))


def parse_turn(piece: Column) -> Column:
    """struct(role, text) of what follows ``### ``; null where the grammar fails."""
    cut = F.instr(piece, ":\n")
    body = F.substring(piece, cut + 2, F.length(piece) - cut - 1 - F.lit(len(TAIL)))
    good = (cut > 0) & piece.endswith(TAIL) & ~body.rlike(UNESCAPED) & (F.length(piece) > cut + len(TAIL))
    return F.when(good, F.struct(F.url_decode(F.substring(piece, F.lit(1), cut - 1)).alias("role"),
                                 unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array<struct<role, text>>.

    Every unescaped ``### `` opens a turn; what stands before the first one
    must be empty, else the result is null.
    """
    pieces = F.split(formatted, TURN_CUT)
    return F.when(F.element_at(pieces, 1) == "",
                  F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), parse_turn))


def format_turns(rows: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Add ``_role``, ``_text`` (null: empty), ``_turn`` (rendered) and ``_body`` to turn rows.

    Round trip: a turn is rendered as it is and parsed again; if the parser
    does not give back exactly this turn, its text is escaped and tried again.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = rows.withColumn("_role", role).withColumn("_text", text).withColumn("_body", F.col("_text"))
    for attempt in range(MAX_ROUNDS):
        turn = F.concat(head(F.col("_role")), F.col("_body"), F.lit(TAIL))
        back = parse(turn)
        same = (F.size(back) == 1) & back[0].eqNullSafe(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))
        same = F.coalesce(same, F.lit(False))
        if attempt + 1 < MAX_ROUNDS:
            out = out.withColumn("_body", F.when(same, F.col("_body")).otherwise(escape(F.col("_body"))))
        else:
            out = out.withColumn("_turn", F.when(same, turn).otherwise(
                F.raise_error(F.lit("chat turn does not parse back to its source"))))
    return out


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``formatted`` and ``loss_spans``
    (array of start, length in ``formatted``, code points from 0).

    Turns are ordered by turn number, then role and text, so repeated numbers
    have a defined order and repeated rows stay; null turn numbers come first,
    a null id is a conversation of its own, null roles and texts count as
    empty, other columns are ignored and an empty table gives no rows.  The
    whole conversation is parsed again and must equal its source turns.  A
    formatted conversation is one value, so one task holds its turns; rows of
    one conversation are never multiplied.
    """
    turns = format_turns(rows.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_no"),
                                     F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    before = (Window.partitionBy("_conv").orderBy(F.col("_no").asc_nulls_first(), "_role", "_text")
              .rowsBetween(Window.unboundedPreceding, -1))
    turns = (turns.withColumn("_start", F.coalesce(F.sum(F.length("_turn")).over(before), F.lit(0)) + F.length(head(F.col("_role"))))
             .withColumn("_len", F.length("_body")))
    item = F.struct(F.col("_start"), F.col("_len"), F.col("_role").alias("role"), F.col("_text").alias("text"),
                    F.col("_turn").alias("rendered"))
    held = turns.groupBy("_conv").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    source = F.transform("_items", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    formatted = F.concat_ws("", F.transform("_items", lambda x: x["rendered"]))
    spans = F.transform(F.filter("_items", lambda x: x["role"] == loss_role),
                        lambda x: F.struct(x["_start"].alias("start"), x["_len"].alias("length")))
    out = held.select("_conv", F.size("_items").cast("long").alias("n_turns"), formatted.alias("_f"),
                      spans.alias("loss_spans"), source.alias("_source"))
    checked = F.when(parse(F.col("_f")).eqNullSafe(F.col("_source")), F.col("_f")).otherwise(
        F.raise_error(F.lit("formatted conversation does not parse back to its source")))
    return out.select(F.col("_conv").alias(conv_col), "n_turns", checked.alias("formatted"), "loss_spans")


def masked_text(formatted: Column, spans: Column) -> Column:
    """Text under the loss mask, read from the formatted string and unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"]))))
