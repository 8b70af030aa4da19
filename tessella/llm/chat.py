"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as its turns, each ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``. The rendered text is
read back by a deterministic parser, and the recovered turns are compared with the source; the turns that do not come
back identical are escaped, and rendering and reading are repeated until all do. The escape puts one more backslash
into everything that looks like the start of a control string (``<``, any number of backslashes, ``|``) and the parser
takes one out, so any text is restored in full, including texts that hold escapes already. Line feeds and percent
signs in roles are percent-encoded.

Defined results: turns are ordered by turn, then role, then text, nulls first; null roles and texts count as empty;
repeated rows are repeated turns; each row with a null conv_id is a conversation of its own, as nothing says that they
belong together and there may be any number of them; an empty table gives no rows. The turns of one conversation meet in
one task, as they become one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Role whose texts are under the loss mask.
ASSISTANT = "assistant"
#: Times that conflicting turns are escaped. One escape always suffices; a conversation that still differs is an error.
ROUNDS = 1


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(rendered: Column) -> Column:
    """The turns (role, text) of a rendered text; a null in place of a turn where the grammar does not hold."""
    parts = F.split(rendered, r"<\|im_start\|>")

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(1), F.length(part) - len(END))
        cut = F.instr(body, "\n")
        ok = F.endswith(part, F.lit(END)) & (cut > 0) & ~F.contains(body, F.lit(END.strip()))
        return F.when(ok, F.struct(unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text")))

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def format_chats(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per conversation: conv_id, source, formatted, turns and loss_spans.

    source: the array (role, text) that was rendered. turns: the same as read back from formatted. loss_spans: the
    array (start, length), in code points of formatted, of the rendered texts of assistant turns. Each turn is
    rendered and, where it does not survive, escaped before the turns of a conversation are gathered, so only whole
    rendered turns meet; a running sum over them gives the spans.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    turns = rows.select("conv_id", alone, "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = turns.withColumns({"shown_role": F.col("role"), "shown": F.col("text")})
    source = F.array(F.struct("role", "text"))
    for _ in range(rounds):
        same = F.coalesce(parse(render_turn(F.col("shown_role"), F.col("shown"))) == source, F.lit(False))
        turns = turns.withColumn("same", same).withColumns({"shown_role": F.when(F.col("same"), F.col("shown_role")).otherwise(escape_role(F.col("shown_role"))), "shown": F.when(F.col("same"), F.col("shown")).otherwise(escape(F.col("shown")))})
    turns = turns.withColumn("rendered", render_turn(F.col("shown_role"), F.col("shown")))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    ends = F.sum(F.length("rendered")).over(Window.partitionBy("conv_id", "alone").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at = F.row_number().over(Window.partitionBy("conv_id", "alone").orderBy(*order))
    placed = turns.withColumns({"at": at, "text_start": ends - len(END) - F.length("shown")})
    gathered = placed.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "rendered", "text_start", F.length("shown").alias("shown_length")))).alias("all"))
    out = gathered.select(
        "conv_id",
        F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("all", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda t: t["role"] == ASSISTANT), lambda t: F.struct(t["text_start"].alias("start"), t["shown_length"].cast("long").alias("length"))).alias("loss_spans"),
    )
    read = out.withColumn("turns", parse(F.col("formatted")))
    differs = F.when(F.coalesce(F.col("turns") == F.col("source"), F.lit(False)), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    return read.withColumn("turns", differs)


def loss_text(turns: Column) -> Column:
    """The text under the loss mask: the texts of the assistant turns, one after another."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
