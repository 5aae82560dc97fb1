"""Search hits and API dumps to candidate and answer tables. [S2 - S5, J1]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions.extract import answer_text, unescape_html
from curatrix.functions.text import contains_any, text_or_empty
from curatrix.functions.urls import domain_boost

def search_hits(hits: DataFrame, per_query: int | None = None) -> DataFrame:
    """[S2] The hits of each (task, query) that have a url, as candidates; of the first
    ``per_query`` only where a number is asked for."""
    first = hits
    if per_query is not None:
        engine_order = Window.partitionBy("task_id", "query").orderBy("seq")
        placed = hits.withColumn("_place", F.row_number().over(engine_order))
        first = placed.filter(F.col("_place") <= per_query)
    url = F.coalesce(F.nullif(F.col("href"), F.lit("")), F.nullif(F.col("url"), F.lit("")))
    return first.withColumn("url", url).filter(F.col("url").isNotNull()).select(
        "task_id",
        "seq",
        F.lit("web").alias("source"),
        text_or_empty(F.col("title")).alias("title"),
        "url",
        text_or_empty(F.col("body")).alias("snippet"),
        domain_boost(F.col("url")).alias("score"),
    )


def _two_rows(payload: DataFrame, keep: Column, first: Column, second: Column) -> DataFrame:
    items = payload.select("task_id", "seq", F.posexplode("items").alias("no", "item")).filter(keep)
    rows = items.select("task_id", "seq", "no", F.posexplode(F.array(first, second)).alias("k", "c"))
    return rows.select(
        "task_id",
        # Order of a candidate: its payload, its item, then which of the item's two rows it is.
        F.struct("seq", "no", "k").alias("seq"),
        F.lit("github").alias("source"),
        "c.title",
        "c.url",
        "c.snippet",
        "c.score",
    )


def _candidate(title: Column, url: Column, snippet: Column, score: Column) -> Column:
    return F.struct(
        title.alias("title"), url.alias("url"), snippet.alias("snippet"), score.alias("score")
    )


def github_repo_candidates(payload: DataFrame) -> DataFrame:
    """[S3] Two candidates per repository with a page: the page and the raw README."""
    item = F.col("item")
    name = text_or_empty(item["full_name"])
    branch = F.coalesce(F.nullif(item["default_branch"], F.lit("")), F.lit("main"))
    text = text_or_empty(item["description"])
    stars = F.coalesce(item["stargazers_count"], F.lit(0)).cast("double")
    raw = F.concat(
        F.lit("https://raw.githubusercontent.com/"), name, F.lit("/"), branch, F.lit("/README.md")
    )
    return _two_rows(
        payload,
        text_or_empty(item["html_url"]) != "",
        _candidate(
            name,
            F.concat(item["html_url"], F.lit("#readme")),
            text,
            F.least(F.lit(5.0), 1.0 + stars / 20000.0),
        ),
        _candidate(
            F.concat(name, F.lit(" README")), raw, text, F.least(F.lit(5.5), 1.5 + stars / 18000.0)
        ),
    )


def github_code_candidates(payload: DataFrame) -> DataFrame:
    """[S4] Two candidates per code hit with repository and path: the page and the raw file."""
    item = F.col("item")
    name = text_or_empty(item["repository"]["full_name"])
    path = text_or_empty(item["path"])
    low = F.lower(path)
    known = F.lit(False)
    for suffix in K.CODE_SUFFIXES:
        known = known | F.endswith(low, F.lit(suffix))
    sample = contains_any(low, K.CODE_FOLDERS)
    score = (
        F.lit(2.0)
        + F.when(known, 0.6).otherwise(0.0)
        + F.when(sample, 0.7).otherwise(0.0)
    )
    page = F.coalesce(
        F.nullif(item["html_url"], F.lit("")),
        F.concat(text_or_empty(item["repository"]["html_url"]), F.lit("/blob/HEAD/"), path),
    )
    title = F.concat(name, F.lit("/"), path)
    raw = F.concat(F.lit("https://raw.githubusercontent.com/"), name, F.lit("/HEAD/"), path)
    return _two_rows(
        payload,
        (name != "") & (path != ""),
        _candidate(title, page, F.concat(F.lit("Code search match in "), path), score),
        _candidate(
            F.concat(title, F.lit(" raw")),
            raw,
            F.concat(F.lit("Raw code content from "), path),
            score + 0.4,
        ),
    )


def stackoverflow_answers(
    questions: DataFrame, answers: DataFrame, max_results: int | None = None
) -> DataFrame:
    """[S5, J1] The questions of a task that are answered, of the first ``max_results`` where a
    number is asked for, with their accepted answer as plain text, in question order."""
    first = questions
    if max_results is not None:
        order = Window.partitionBy("task_id").orderBy("seq")
        placed = questions.withColumn("_place", F.row_number().over(order))
        first = placed.filter(F.col("_place") <= max_results)
    asked = first.filter(F.col("is_answered") & F.col("accepted_answer_id").isNotNull())
    found = answers.select(
        F.col("answer_id").alias("accepted_answer_id"), "body", F.col("score").alias("score")
    )
    return asked.join(found, "accepted_answer_id").select(
        "task_id",
        "seq",
        unescape_html(text_or_empty(F.col("title"))).alias("question_title"),
        F.concat(F.lit("https://stackoverflow.com/questions/"), "question_id").alias("question_url"),
        answer_text(F.col("body")).alias("answer_body"),
        F.coalesce("score", F.lit(0)).alias("score"),
        F.lit(True).alias("accepted"),
        "tags",
    )
