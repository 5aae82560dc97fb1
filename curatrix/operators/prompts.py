"""The prompt text of a context record. [C10]"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions.text import at_most


@dataclass(frozen=True)
class PromptCaps:
    """The most items of each section and characters of each text and of the prompt; None keeps
    all."""

    chunks: int | None = None
    concepts: int | None = None
    snippets: int | None = None
    references: int | None = None
    practices: int | None = None
    patterns: int | None = None
    answers: int | None = None
    code_chars: int | None = None
    pattern_chars: int | None = None
    answer_chars: int | None = None
    prompt_chars: int | None = None


def _section(items: Column, title: str, cap: int | None, line: Callable[[Column], Column]) -> Column:
    """Title and one text per item; nothing for an empty list."""
    shown = items if cap is None else F.slice(items, 1, cap)
    return F.when(
        F.size(items) > 0, F.concat(F.array(F.lit(f"## {title}\n")), F.transform(shown, line))
    ).otherwise(F.array().cast("array<string>"))


def _text(*parts: Column | str) -> Column:
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    )


def prompt_text(caps: PromptCaps = PromptCaps()) -> Column:  # noqa: B008
    """Prompt of a row with task, relevant_context, context and open_questions."""
    context = F.col("context")
    parts = F.concat(
        F.array(_text("## Developer Task\n\n", F.col("task"), "\n")),
        _section(
            F.col("relevant_context"),
            "Pre-Ranked Context (already filtered for relevance)",
            caps.chunks,
            lambda x: _text(
                "[", F.upper(x["bucket"]), "] ", x["source"], ": ", x["why_it_matters"],
                "\n> ", x["key_detail"], "\n",
            ),
        ),
        _section(
            context["concepts"],
            "Documentation Context",
            caps.concepts,
            lambda x: _text("### ", x["title"], "\n", x["summary"], "\nSource: ", x["source"], "\n"),
        ),
        _section(
            context["code_snippets"],
            "Code Examples",
            caps.snippets,
            lambda x: _text(
                "### ", x["description"],
                F.when(F.coalesce(x["bucket"], F.lit("")) != "", _text(" [", F.upper(x["bucket"]), "]")),
                "\n```", x["language"], "\n", at_most(x["code"], caps.code_chars),
                "\n```\nSource: ", x["source"], "\n",
            ),
        ),
        _section(
            context["api_references"],
            "API References",
            caps.references,
            lambda x: _text("- `", x["function"], "`: ", x["description"], "\n"),
        ),
        _section(
            context["best_practices"], "Best Practices", caps.practices, lambda x: _text("- ", x["practice"], "\n")
        ),
        _section(
            context["implementation_patterns"],
            "Implementation Patterns",
            caps.patterns,
            lambda x: _text(
                "### ", x["pattern_type"], " (confidence: ", x["confidence"], ")\n", x["description"],
                "\n```\n", at_most(x["code_snippet"], caps.pattern_chars), "\n```\n",
            ),
        ),
        _section(
            context["stackoverflow_answers"],
            "StackOverflow Answers",
            caps.answers,
            lambda x: _text(
                "### ", x["question_title"], " (score: ", x["score"], ")\n",
                at_most(x["answer_body"], caps.answer_chars), "\nSource: ", x["question_url"], "\n",
            ),
        ),
        _section(
            F.col("open_questions"), "Known Gaps (from pipeline)", None, lambda x: _text("- ", x, "\n")
        ),
    )
    return F.array_join(parts, "\n")


def build_prompts(records: DataFrame, caps: PromptCaps = PromptCaps()) -> DataFrame:  # noqa: B008
    """[C10] (task_id, prompt): the record as text, then the closing instruction. A prompt longer
    than ``caps.prompt_chars`` is cut there and says so."""
    full = records.select("task_id", prompt_text(caps).alias("full"))
    body = F.col("full")
    if caps.prompt_chars is not None:
        shortened = F.concat(at_most(body, caps.prompt_chars), F.lit(K.PROMPT_CUT))
        body = F.when(F.length("full") > caps.prompt_chars, shortened).otherwise(body)
    return full.select("task_id", F.concat(body, F.lit(K.PROMPT_CLOSING)).alias("prompt"))
