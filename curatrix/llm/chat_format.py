"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
reply is under the loss mask. A conversation that does not end with an assistant turn gets a
closing row without trainable text, so that the rows together hold every turn; ``closing`` marks
the one row of each conversation that holds all of its turns.

Template: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line feed. Control strings
inside texts are escaped: a backslash goes behind their first character, after any backslashes that
are there already, so the step back is exact for every text. A role's backslashes and line feeds
are written as two characters each before its control strings are escaped, so roles come back exactly too.

Defined results: a null role or text is empty; a null conversation id is a conversation of its
own; turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have one
order and each counts; an empty table gives no rows; only the four named columns are read. An
example holds its whole context by its definition, so the rows of one conversation grow with the
square of its turns; the turns of one conversation stay together in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import let

START, END, TAIL = "<|im_start|>", "<|im_end|>", "\n"
TRAINED = "assistant"
#: What may follow the first character (and backslashes) of a control string.
_REST = r"(\|im_start\|>|\|im_end\|>|\|system\|>|\|user\|>|\|assistant\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])"
ESCAPE = r"([<\[])(\\*)" + _REST
UNESCAPE = r"([<\[])\\(\\*)" + _REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")


def formatted(turn: Column) -> Column:
    """A turn struct as text."""
    return F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"), escape(turn["text"]), F.lit(END + TAIL))


def expand(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, example_no from 0, target_turn, closing, formatted, loss_start, loss_end): places are
    0-based code points of ``formatted``, the end exclusive; null where nothing is trained."""
    order = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    whole = turns.groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(order)).alias("turns"))
    parts = whole.select("conv", "turns", F.transform("turns", formatted).alias("parts"))

    def example(t: Column, i: Column) -> Column:
        return F.struct(i.alias("place"), t["turn"].alias("turn"), t["role"].alias("role"))

    picked = F.filter(F.transform("turns", example), lambda e: (e["role"] == TRAINED) | (e["place"] == F.size("turns") - 1))
    each = parts.select("conv", "parts", F.size("turns").alias("n"), F.posexplode_outer(picked).alias("example_no", "e"))
    trained = F.col("e.role") == TRAINED
    context = F.array_join(F.slice("parts", 1, F.col("e.place")), "")
    reply = F.element_at("parts", F.col("e.place") + 1)
    head = F.length(F.lit(START)) + F.length(F.lit(TRAINED)) + 1
    made = each.select("conv", "example_no", "n", "e", context.alias("context"), reply.alias("reply"))
    start = F.length("context") + head
    return made.select(
        F.col("conv").alias(conv),
        "example_no",
        F.when(trained, F.col("e.turn")).alias("target_turn"),
        (F.col("e.place") == F.col("n") - 1).alias("closing"),
        F.concat("context", "reply").alias("formatted"),
        F.when(trained, start).alias("loss_start"),
        F.when(trained, F.length("context") + F.length("reply") - len(END + TAIL)).alias("loss_end"),
    )


def trained_text(rows: DataFrame) -> Column:
    """The text under the loss mask, unescaped; empty where nothing is trained."""
    cut = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return F.coalesce(unescape(cut), F.lit(""))


def parse(text: Column) -> Column:
    """Back from a formatted text to its turns: an array of (role, text)."""

    def turn(part: Column) -> Column:
        def at(cut: Column) -> Column:
            role = F.substring(part, F.lit(len(START) + 1), cut - 1 - len(START))
            return F.struct(unescape_role(role).alias("role"), unescape(F.substring(part, cut + 1, F.length(part))).alias("text"))

        return let(F.locate("\n", part), at)

    parts = F.split(text, r"<\|im_end\|>\n", -1)
    return let(parts, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))
