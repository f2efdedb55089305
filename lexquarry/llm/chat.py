"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only that
reply is trainable. Turns after the last reply (all turns, where nobody replies) make one more
example with nothing to train, so that no turn is lost.

A turn is written START role newline text STOP newline. Inside roles and texts a backslash follows each
'<' and '[', so no control string of the usual templates (all begin with one of these) can stand
there; taking that backslash away gives the text back. A newline inside a role is written '<n'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))


def expand(turns: DataFrame) -> DataFrame:
    """Examples of conversations (conv_id, turn, role, text).

    Returns conv_id, example (from 1), formatted, loss_start and loss_end (code points of formatted, end
    exclusive) and trained (false for an example without a reply to train: loss_start = loss_end).

    Turns stand in the order of turn, role, text; null turns come first. Null roles and texts count as
    empty, a null conv_id is a conversation like others, repeated rows are repeated turns. Other columns
    are not read. No rows give no examples. A conversation's turns meet in one row, as its last example does.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def mark(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit("\n"), F.lit("<n"))
        return F.concat(F.lit(START), role, F.lit("\n"), escape(t["text"]), F.lit(STOP))

    upto = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == F.size("turns")))
    cut = talks.select("conv_id", "turns", F.transform("turns", mark).alias("marked"), F.posexplode(upto).alias("example", "upto"))
    last = F.element_at("turns", F.col("upto"))
    shown = cut.select("conv_id", (F.col("example") + 1).alias("example"), F.array_join(F.slice("marked", F.lit(1), F.col("upto")), "").alias("formatted"), (last["role"] == "assistant").alias("trained"), F.length(escape(last["text"])).alias("size"))
    end = F.length("formatted") - len(STOP)
    return shown.select("conv_id", "example", "formatted", F.when(F.col("trained"), end - F.col("size")).otherwise(end).alias("loss_start"), end.alias("loss_end"), "trained")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example, unescaped."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(STOP))
        return F.struct(unescape(F.replace(role, F.lit("<n"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    pieces = F.split(formatted, START.replace("|", "\\|"), -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(formatted, start + 1, end - start))
