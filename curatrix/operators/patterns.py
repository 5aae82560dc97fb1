"""Implementation patterns in code. [C3, A3]"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions.text import at_most, contains_any, let
from curatrix.operators.rows import one_row_each


def _shows(code: Column, regex: str) -> Column:
    """Whether lower-case code matches. A rule that is one list of choices is asked choice by
    choice, since most are plain words and need no regex engine."""
    choices = [regex]
    if re.fullmatch(r"\([^()]*\)", regex):
        choices = regex[1:-1].split("|")
    plain = [c.replace("\\.", ".") for c in choices if re.fullmatch(r"(\w|@|\\\.)+", c)]
    others = [c for c in choices if not re.fullmatch(r"(\w|@|\\\.)+", c)]
    shown = contains_any(code, plain)
    for choice in others:
        shown = shown | code.rlike("(?d)" + choice.replace(r"\s", K.WS))
    return shown


def folded_code(code: Column) -> Column:
    """Lower case, with the letters that match i, s and k when case is ignored made plain."""
    return F.translate(F.lower(code), "ıſK", "isk")


def code_patterns(code: Column) -> Column:
    """[C3] array<struct<pattern_type, ..>> of the patterns a lower-case text shows: at least two of a
    type's rules match and their weights sum to over 1.0 (ten tenths, so 0.4 + 0.6 does not)."""

    def of_rules(name: str) -> Callable[[Column], Column]:
        return lambda weights: F.struct(
            F.lit(name).alias("pattern_type"),
            F.size(weights).alias("matches"),
            F.aggregate(weights, F.lit(0), lambda total, w: total + w).alias("tenths"),
        )

    found = []
    for name, rules in K.PATTERN_RULES.items():
        hits = F.array(*[F.when(_shows(code, regex), F.lit(weight)) for regex, weight in rules])
        matched = F.filter(hits, lambda w: w.isNotNull())
        found.append(let(matched, of_rules(name)))
    return F.filter(F.array(*found), lambda p: (p["matches"] >= 2) & (p["tenths"] > 10))


def detect_patterns(snippets: DataFrame, code_chars: int | None = None) -> DataFrame:
    """[C3] One row per snippet and pattern type, in rule order (``type_no``)."""
    others = [c for c in snippets.columns if c != "code"]
    names = F.array(*[F.lit(x) for x in K.PATTERN_RULES])
    texts = F.create_map(*[F.lit(x) for pair in K.PATTERN_TEXT.items() for x in pair])
    found = let(folded_code(F.col("code")), code_patterns)
    rows = one_row_each(snippets, [*others, "code"], found, "p")
    return rows.select(
        *others,
        F.array_position(names, F.col("p.pattern_type")).cast("int").alias("type_no"),
        F.col("p.pattern_type").alias("pattern_type"),
        texts[F.col("p.pattern_type")].alias("description"),
        at_most(F.col("code"), code_chars).alias("code_snippet"),
        F.least(F.lit(1.0), F.col("p.tenths") / F.lit(20.0)).alias("confidence"),
    )


def best_patterns(detected: DataFrame, by: str = "task_id") -> DataFrame:
    """[A3] The surest row of each type per task, the first of equals. ``first_seen`` keeps the
    order of equally sure types. ``detected`` has a ``seq`` per snippet."""
    place = F.struct("seq", "type_no")
    return (
        detected.groupBy(by, "pattern_type")
        .agg(
            F.min_by(
                F.struct("description", "code_snippet", "source", "confidence"),
                F.struct(-F.col("confidence"), F.col("seq")),
            ).alias("best"),
            F.min(place).alias("first_seen"),
        )
        .select(by, "pattern_type", "best.*", "first_seen")
    )
