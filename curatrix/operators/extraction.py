"""Pages to documents and their child tables. [E1, E5, E6, E8, E9]"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions import extract as X
from curatrix.functions.text import at_most, first_items, let, text_or_empty
from curatrix.operators.filters import long_enough
from curatrix.operators.rows import one_row_each


def extract_documents(
    pages: DataFrame, body_chars: int | None = None, max_headings: int | None = None
) -> DataFrame:
    """[E1] One document row per page that is long enough; all columns but ``text`` and
    ``content_type`` are kept, ``url`` becomes ``source``.

    ``pages(url, content_type, text)``. Adds title, summary, markdown, headings, snippets,
    api_references and best_practices; references, practices and snippets come from the whole
    markdown. ``body_chars`` and ``max_headings`` shorten what a
    row shows; nothing is cut unless they are given.
    """
    keep = [c for c in pages.columns if c not in ("url", "text", "content_type", "status_code", "fetched_at")]
    url, is_md = F.col("url"), F.col("is_md")
    raw = long_enough(pages).select(
        *keep,
        "url",
        text_or_empty(F.col("text")).alias("raw"),
        (
            F.contains(text_or_empty(F.col("content_type")), F.lit("markdown"))
            | F.endswith(F.col("url"), F.lit(".md"))
        ).alias("is_md"),
    )
    main = raw.withColumn("main", F.when(~is_md, X.main_html(F.col("raw"))))
    last = F.coalesce(F.nullif(F.substring_index(url, "/", -1), F.lit("")), F.lit("README"))
    body = main.select(
        *keep,
        "url",
        "main",
        "is_md",
        F.when(is_md, last).otherwise(X.page_title(F.col("raw"), url)).alias("title"),
        F.when(is_md, F.col("raw")).otherwise(X.html_to_text(F.col("main"))).alias("full"),
        F.when(is_md, X.markdown_headings(F.col("raw")))
        .otherwise(X.html_headings(F.col("main")))
        .alias("headings"),
    )
    blocks = F.transform(
        F.coalesce(X.html_snippets(F.col("main")), F.array()),
        lambda s: F.struct(
            s["language"].alias("language"),
            s["code"].alias("code"),
            F.concat(F.lit("Extracted code block from "), F.col("title")).alias("description"),
        ),
    )
    fences = F.transform(
        X.fenced_snippets(F.col("full")),
        lambda s: F.struct(
            s["language"].alias("language"),
            s["code"].alias("code"),
            F.concat(F.lit("Markdown fenced snippet from "), F.col("title")).alias("description"),
        ),
    )
    return body.select(
        *keep,
        F.col("url").alias("source"),
        "title",
        X.summary(F.col("full")).alias("summary"),
        at_most(F.col("full"), body_chars).alias("markdown"),
        first_items(F.col("headings"), max_headings).alias("headings"),
        F.when(F.col("is_md"), fences).otherwise(F.concat(blocks, fences)).alias("snippets"),
        X.api_references(F.col("full")).alias("api_references"),
        X.best_practices(F.col("full")).alias("best_practices"),
    )


def doc_children(docs: DataFrame, column: str, dedupe: bool = False) -> DataFrame:
    """One row per element of an array column (snippets, api_references, best_practices), with
    ``child_no`` from 0. ``dedupe`` keeps the first of equal code blocks of a page."""
    others = [
        c
        for c in docs.columns
        if c not in ("title", "summary", "markdown", "headings", "snippets", "api_references", "best_practices")
    ]
    items = F.col(column)
    if dedupe:
        items = let(
            F.transform(items, lambda s: s["code"]),
            lambda codes: F.filter(
                F.col(column), lambda s, i: F.array_position(codes, s["code"]) == i + 1
            ),
        )
    rows = one_row_each(docs, others, items, "child", "child_no")
    return rows.select(*others, "child_no", "child.*")
