"""One nested context record per task. [C6 - C9, A8, J3, O2, W4]

A record holds what its task's ranked chunks and snippets, their documents and its answers say.
Nothing of it is cut by default; ``Caps`` shortens lists and texts where a caller asks for that, by
a window per task before anything is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions.text import at_most
from curatrix.operators.ranking import first_rows


@dataclass(frozen=True)
class Caps:
    """[W4] The most rows of each list and characters of each text; None keeps all."""

    chunks: int | None = None
    concepts: int | None = None
    references: int | None = None
    practices: int | None = None
    critical_chars: int | None = None
    helpful_chars: int | None = None
    pattern_chars: int | None = None
    answer_chars: int | None = None


# One row per element; arrays of these make up the record.
CHUNK = "struct<source:string,bucket:string,relevance_score:double,why_it_matters:string,key_detail:string>"
SNIPPET = "struct<language:string,description:string,code:string,source:string,bucket:string,relevance_score:double>"
CONCEPT = "struct<title:string,summary:string,source:string>"
REFERENCE = "struct<library:string,function:string,description:string,source:string>"
PRACTICE = "struct<practice:string,reason:string,source:string>"
PATTERN = "struct<pattern_type:string,description:string,code_snippet:string,source:string,confidence:double>"
ANSWER = "struct<question_title:string,question_url:string,answer_body:string,score:bigint,accepted:boolean,tags:array<string>>"


def unique_by_key(rows: DataFrame, by: list[str], key: str, order: list[str]) -> DataFrame:
    """[A8] The first row of each key; rows with an empty key are dropped."""
    named = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    place = Window.partitionBy(*by, key).orderBy(*order)
    return named.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")


def kept_sources(*tables: DataFrame) -> DataFrame:
    """[O2] Distinct (task_id, source) of the given tables."""
    union = tables[0].select("task_id", "source")
    for table in tables[1:]:
        union = union.unionByName(table.select("task_id", "source"))
    return union.distinct()


def docs_of_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """[J3] Documents of a task whose source was kept; a task that kept none keeps all."""
    some = sources.select("task_id").distinct().withColumn("_some", F.lit(True))
    marked = docs.join(some, "task_id", "left").join(
        sources.withColumn("_kept", F.lit(True)), ["task_id", "source"], "left"
    )
    return marked.filter(F.col("_some").isNull() | F.col("_kept")).drop("_some", "_kept")


def _collect(rows: DataFrame, order: list[str], item: Column, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*order, item.alias("item"))))
    return rows.groupBy("task_id").agg(F.transform(ordered, lambda x: x["item"]).alias(name))


def relevant_rows(chunks: DataFrame, caps: Caps = Caps()) -> DataFrame:  # noqa: B008
    """[C6] Critical chunks, and helpful ones only where a task has fewer than three critical.

    ``chunks(task_id, rank, source, text, score, bucket)`` are ranked, so a task has few."""
    task = Window.partitionBy("task_id")
    critical = F.count_if(F.col("bucket") == "critical").over(task)
    shown = chunks.withColumn("include_helpful", critical < 3).filter(
        (F.col("bucket") == "critical") | F.col("include_helpful")
    )
    is_critical = F.col("bucket") == "critical"
    return shown.select(
        "task_id",
        (~is_critical).cast("int").alias("part"),
        "rank",
        "source",
        "bucket",
        F.bround("score", 3).alias("relevance_score"),
        F.when(is_critical, K.WHY_CRITICAL).otherwise(K.WHY_HELPFUL).alias("why_it_matters"),
        F.when(is_critical, at_most(F.col("text"), caps.critical_chars))
        .otherwise(at_most(F.col("text"), caps.helpful_chars))
        .alias("key_detail"),
    )


def snippet_rows(snippets: DataFrame, tasks: DataFrame, helpful_tasks: DataFrame) -> DataFrame:
    """[C6] Critical snippets first; helpful ones fill up to max_code_snippets where the task may
    show helpful rows. ``helpful_tasks(task_id)`` lists those tasks."""
    allowed = helpful_tasks.select("task_id").withColumn("include_helpful", F.lit(True))
    joined = snippets.join(tasks.select("task_id", "max_code_snippets"), "task_id").join(
        allowed, "task_id", "left"
    )
    shown = joined.filter((F.col("bucket") == "critical") | F.col("include_helpful")).withColumn(
        "part", (F.col("bucket") != "critical").cast("int")
    )
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("part", "rank"))
    return (
        shown.withColumn("place", place)
        .filter(F.col("place") <= F.col("max_code_snippets"))
        .withColumn("relevance_score", F.bround("score", 3))
    )


def pattern_rows(patterns: DataFrame, code_chars: int | None = None) -> DataFrame:
    """[C7]"""
    return patterns.withColumn("code_snippet", at_most(F.col("code_snippet"), code_chars)).withColumn(
        "confidence", F.bround("confidence", 3)
    )


def answer_rows(answers: DataFrame, body_chars: int | None = None) -> DataFrame:
    """[C7]"""
    return answers.withColumn("answer_body", at_most(F.col("answer_body"), body_chars))


def helpful_tasks(tasks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tasks with fewer than three critical chunks, those without any chunk included."""
    clear = chunks.filter("bucket = 'critical'").groupBy("task_id").count().filter("count >= 3")
    return tasks.select("task_id").join(clear, "task_id", "left_anti")


def _doc_lists(
    docs: DataFrame, concepts: int | None, references: int | None, practices: int | None
) -> list[DataFrame]:
    """Concepts, references and practices of ``docs(task_id, seq, ..)``."""
    shown = first_rows(docs.filter("summary != ''"), concepts, ["task_id"], ["seq"])

    def children(column: str, key: str, cap: int | None) -> DataFrame:
        rows = docs.select("task_id", "seq", "source", F.posexplode(column).alias("no", "c")).select(
            "task_id", "seq", "no", "source", "c.*"
        )
        return first_rows(
            unique_by_key(rows, ["task_id"], key, ["seq", "no"]), cap, ["task_id"], ["seq", "no"]
        )

    return [
        _collect(shown, ["seq"], F.struct("title", "summary", "source"), "concepts"),
        _collect(
            children("api_references", "function", references),
            ["seq", "no"],
            F.struct("library", "function", "description", "source"),
            "api_references",
        ),
        _collect(
            children("best_practices", "practice", practices),
            ["seq", "no"],
            F.struct("practice", "reason", "source"),
            "best_practices",
        ),
    ]


def _pattern_list(patterns: DataFrame, caps: Caps) -> DataFrame:
    item = F.struct("pattern_type", "description", "code_snippet", "source", "confidence")
    rows = patterns.withColumn("down", -F.col("confidence"))
    return _collect(pattern_rows(rows, caps.pattern_chars), ["down", "first_seen"], item, "implementation_patterns")


def _answer_list(answers: DataFrame, caps: Caps) -> DataFrame:
    item = F.struct(
        "question_title", "question_url", "answer_body",
        F.col("score").cast("bigint").alias("score"), "accepted", "tags",
    )
    return _collect(answer_rows(answers, caps.answer_chars), ["seq"], item, "stackoverflow_answers")


def _list(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>")).cast(f"array<{kind}>").alias(name)


def _sentences(*parts: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, s) for c, s in parts]), lambda s: s.isNotNull())


def assemble_context(
    tasks: DataFrame,
    chunks: DataFrame,
    snippets: DataFrame,
    docs: DataFrame,
    patterns: DataFrame,
    answers: DataFrame,
    caps: Caps = Caps(),  # noqa: B008
) -> DataFrame:
    """[C6, C8] The record of every task, also of tasks without any hit.

    ``tasks(task_id, task, max_code_snippets)``; bucketed ``chunks`` and ``snippets`` with
    ``rank``; ``docs(task_id, seq, source, title, summary, api_references, best_practices)``;
    ``patterns`` of A3; ``answers(task_id, seq, ..)``.
    """
    ambiguous = helpful_tasks(tasks, chunks)
    relevant = relevant_rows(chunks, caps)
    code = snippet_rows(snippets, tasks, ambiguous)
    kept = docs.join(kept_sources(relevant, code), ["task_id", "source"], "left_semi")
    sections = [
        _collect(
            first_rows(relevant, caps.chunks, ["task_id"], ["part", "rank"]),
            ["part", "rank"],
            F.struct("source", "bucket", "relevance_score", "why_it_matters", "key_detail"),
            "relevant_context",
        ),
        _collect(
            code,
            ["place"],
            F.struct("language", "description", "code", "source", "bucket", "relevance_score"),
            "code_snippets",
        ),
        *_doc_lists(kept, caps.concepts, caps.references, caps.practices),
        _pattern_list(patterns, caps),
        _answer_list(answers, caps),
        ambiguous.withColumn("ambiguous", F.lit(True)),
        chunks.filter("bucket = 'helpful'").groupBy("task_id").agg(F.count(F.lit(1)).alias("helpful")),
    ]
    row = tasks.select("task_id", "task")
    for section in sections:
        row = row.join(section, "task_id", "left")
    filled = row.select(
        "task_id",
        "task",
        _list("relevant_context", CHUNK),
        F.struct(
            _list("concepts", CONCEPT),
            _list("code_snippets", SNIPPET),
            _list("api_references", REFERENCE),
            _list("best_practices", PRACTICE),
            _list("implementation_patterns", PATTERN),
            _list("stackoverflow_answers", ANSWER),
        ).alias("context"),
        (F.coalesce("ambiguous", F.lit(False)) & F.col("helpful").isNull()).alias("few"),
    )
    no_code = F.size("context.code_snippets") == 0
    return filled.select(
        "task_id",
        "task",
        "relevant_context",
        "context",
        _sentences(
            (no_code, K.NO_CODE),
            (F.size("context.stackoverflow_answers") == 0, K.NO_ANSWERS),
            (F.col("few"), K.FEW_CHUNKS),
        ).alias("open_questions"),
        _sentences(
            (no_code, K.NEXT_EXAMPLES), (F.size("context.api_references") == 0, K.NEXT_API)
        ).alias("recommended_next_context"),
    )


def assemble_flat(
    tasks: DataFrame,
    chunks: DataFrame,
    snippets: DataFrame,
    docs: DataFrame,
    patterns: DataFrame,
    answers: DataFrame,
    caps: Caps = Caps(),  # noqa: B008
) -> DataFrame:
    """[C9] The older layout: no buckets, all docs, and the ranked chunks as ``llm_chunks``."""
    sections = [
        *_doc_lists(docs, caps.concepts, caps.references, caps.practices),
        _collect(
            snippets.join(tasks.select("task_id", "max_code_snippets"), "task_id").filter(
                F.col("rank") <= F.col("max_code_snippets")
            ),
            ["rank"],
            F.struct("language", "description", "code", "source"),
            "code_snippets",
        ),
        _pattern_list(patterns, caps),
        _answer_list(answers, caps),
        _collect(chunks, ["rank"], F.struct("text", "tokens", "source"), "llm_chunks"),
    ]
    row = tasks.select("task_id", "task")
    for section in sections:
        row = row.join(section, "task_id", "left")
    return row.select(
        "task_id",
        "task",
        F.struct(
            _list("concepts", CONCEPT),
            _list("code_snippets", "struct<language:string,description:string,code:string,source:string>"),
            _list("api_references", REFERENCE),
            _list("best_practices", PRACTICE),
            _list("implementation_patterns", PATTERN),
            _list("stackoverflow_answers", ANSWER),
            _list("llm_chunks", "struct<text:string,tokens:int,source:string>"),
        ).alias("context"),
    )
