"""The whole curation, for all tasks at once. [C5, C11]

Functions here run jobs while they build the plan: near-duplicate removal works in rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions.text import TokenCounter, text_relevance, token_count
from curatrix.operators import filters, patterns, ranking, report, scoring
from curatrix.operators.assemble import assemble_context, docs_of_sources, kept_sources
from curatrix.operators.chunking import chunk_documents
from curatrix.operators.extraction import doc_children, extract_documents
from curatrix.operators.neardup import near_dedup
from curatrix.operators.rows import few
from curatrix.session import cut_lineage, stored
from curatrix.sources import payloads

# (task text, item text) -> relevance in 0 .. 1, for pairs that are already joined
PairScore = Callable[[Column, Column], Column]


def corpus_chunks(docs: DataFrame, doc_id: str, max_tokens: int = 500) -> DataFrame:
    """(doc_id, seq, chunk_no, text, tokens) of a document table, stored once for its readers."""
    chunks = chunk_documents(docs.select(doc_id, "text"), "text", max_tokens)
    return stored(
        chunks.withColumn("seq", F.struct(F.col(doc_id).alias("doc"), F.col("chunk_no").alias("no")))
    )


def rank_corpus(
    tasks: DataFrame, docs: DataFrame, doc_id: str = "doc_id", k: int = K.TOP_CHUNKS
) -> DataFrame:
    """The ``k`` most relevant chunks of a shared corpus for each task, after near-duplicate
    removal, relative pruning and bucketing, with ``rank``, ``score`` and ``bucket``."""
    chunks = corpus_chunks(docs, doc_id)
    unique = near_dedup(chunks, "text", "seq")
    # Below the helpful mark no chunk stays, and the mark only cuts the tail of each task's ranks.
    scored = scoring.term_coverage(tasks, unique, ["seq"], at_least=K.HELPFUL, best=k)
    best = filters.relative_prune(ranking.top_k(scored, k), *K.CHUNK_PRUNE)
    return few(cut_lineage(filters.bucketize(best))).join(chunks, "seq")


@dataclass
class Curated:
    """Every stage of a curation run as a table."""

    selected: DataFrame
    docs: DataFrame
    spam: DataFrame
    chunks: DataFrame
    ranked_chunks: DataFrame
    ranked_snippets: DataFrame
    bucketed_chunks: DataFrame
    bucketed_snippets: DataFrame
    patterns: DataFrame
    answers: DataFrame
    records: DataFrame

    def report(self, tasks: DataFrame) -> DataFrame:
        """[A4 - A6]"""
        snippets = doc_children(self.docs.withColumnRenamed("seq", "place"), "snippets")
        pages = self.docs.select("task_id", "source").union(self.spam.select("task_id", "source"))
        return report.run_report(
            tasks,
            report.content_diversity(self.selected),
            report.row_counts(pages, "pages_extracted"),
            report.row_counts(self.docs, "documents"),
            report.row_counts(self.spam, "spam_filtered"),
            report.row_counts(snippets, "code_snippets"),
            report.row_counts(self.chunks, "chunks"),
            report.ranked_figures(self.ranked_chunks, "chunk"),
            report.ranked_figures(self.ranked_snippets, "snippet"),
            report.row_counts(self.patterns, "patterns"),
            report.row_counts(self.answers, "stackoverflow"),
        )


def collect_urls(
    tasks: DataFrame, web: DataFrame, code: DataFrame | None = None, semantic: DataFrame | None = None
) -> DataFrame:
    """Selected urls of each task from merged web hits and code candidates. [A1, C4, O1, W3]

    ``semantic(task_id, url, semantic)`` counts as a web hit's relevance where it is the better."""
    merged, better = ranking.merge_hits(web), None
    if semantic is not None:
        merged, better = merged.join(semantic, ["task_id", "url"], "left"), F.col("semantic")
    scored = scoring.score_candidates(merged, tasks, K.WEB_MIN_RELEVANCE, better)
    if code is not None:
        merged = ranking.merge_hits(code)
        placed = ranking.top_k(merged, ranking.most(tasks, "max_sources"))
        first = placed.join(tasks.select("task_id", "max_sources"), "task_id").filter(
            F.col("rank") <= F.col("max_sources")
        )
        first = first.drop("seq", "max_sources").withColumnRenamed("rank", "seq")
        coded = scoring.score_candidates(
            first.withColumn("seq", F.col("seq").cast("bigint")), tasks, K.CODE_MIN_RELEVANCE
        )
        scored = ranking.union_candidates(ranked_order(scored), ranked_order(coded))
    return ranking.select_urls(scored, tasks)


def ranked_order(scored: DataFrame) -> DataFrame:
    return scored.select("task_id", "seq", "url", "score")


def curate(
    tasks: DataFrame,
    hits: DataFrame,
    pages: DataFrame,
    answers: DataFrame | None = None,
    code: DataFrame | None = None,
    robots: DataFrame | None = None,
    relevance: PairScore = text_relevance,
    counter: TokenCounter = token_count,
    per_query: int | None = None,
    code_bonus: bool = False,
    semantic: DataFrame | None = None,
) -> Curated:
    """[C11] From search hits to one record per task.

    ``tasks(task_id, task, max_sources, max_code_snippets, chunk_size, allowed_domains)``, raw
    ``hits`` of S2, fetched ``pages`` of S1, ``answers`` of S5 and ``code`` candidates of S3/S4.
    ``code_bonus`` adds the length bonus that goes with vector scores (W2); ``semantic`` is that of
    ``collect_urls``.
    """
    selected = cut_lineage(collect_urls(tasks, payloads.search_hits(hits, per_query), code, semantic))
    fetched = filters.fetched_ok(pages)
    if robots is not None:
        fetched = filters.robots_allowed(fetched, robots)
    # A page is extracted once, however many tasks selected it.
    wanted = fetched.join(selected.select("url").distinct(), "url", "left_semi")
    docs = cut_lineage(
        extract_documents(wanted).select(
            "source", "title", "summary", "markdown", "snippets", "api_references", "best_practices"
        )
    )
    clean = filters.not_spam(docs)
    chosen = selected.select("task_id", F.col("place").cast("bigint").alias("seq"), F.col("url").alias("source"))
    task_docs = chosen.join(clean, "source")
    spam = chosen.join(docs.join(clean.select("source"), "source", "left_anti"), "source")
    # Chunks depend on the page and the chunk size only.
    sizes = chosen.join(tasks.select("task_id", "chunk_size"), "task_id")
    cut = clean.select("source", "markdown").join(
        sizes.select("source", "chunk_size").distinct(), "source"
    )
    pieces = chunk_documents(cut, "markdown", F.col("chunk_size"), counter)
    chunks = cut_lineage(
        sizes.join(pieces, ["source", "chunk_size"]).withColumn(
            "seq", F.struct(F.col("seq").alias("doc"), F.col("chunk_no").alias("no"))
        )
    )
    unique = near_dedup(chunks, "text", "seq", ["task_id"])
    named = tasks.select("task_id", "task")
    scored = unique.join(named, "task_id").withColumn("score", relevance(F.col("task"), F.col("text")))
    ranked_chunks = filters.relative_prune(
        ranking.top_k(scored.drop("task"), K.TOP_CHUNKS), *K.CHUNK_PRUNE
    )
    snippets = doc_children(task_docs, "snippets").withColumn(
        "seq", F.struct(F.col("seq").alias("doc"), F.col("child_no").alias("no"))
    )
    scored = snippets.join(named, "task_id").withColumn("score", relevance(F.col("task"), F.col("code")))
    most = ranking.most(tasks, "max_code_snippets")
    top = ranking.rank_snippets(scored.drop("task"), most, vectors=code_bonus).join(
        tasks.select("task_id", "max_code_snippets"), "task_id"
    )
    top = top.filter(F.col("rank") <= F.col("max_code_snippets")).drop("max_code_snippets")
    ranked_snippets = filters.relative_prune(top, *K.SNIPPET_PRUNE)
    good_chunks = cut_lineage(filters.bucketize(ranked_chunks))
    good_snippets = cut_lineage(filters.bucketize(ranked_snippets))
    kept = docs_of_sources(task_docs, kept_sources(good_chunks, good_snippets))
    detected = patterns.best_patterns(
        patterns.detect_patterns(bucket_order(good_snippets).select("task_id", "seq", "source", "code"))
    )
    if answers is None:
        answers = tasks.sparkSession.createDataFrame(
            [],
            "task_id bigint, seq bigint, question_title string, question_url string, "
            "answer_body string, score bigint, accepted boolean, tags array<string>",
        )
    replies = scoring.answer_gate(answers, tasks).drop("relevance")
    records = assemble_context(tasks, good_chunks, good_snippets, kept, detected, replies)
    return Curated(
        selected, task_docs, spam, chunks, ranked_chunks, ranked_snippets, good_chunks,
        good_snippets, detected, replies, records,
    )


def bucket_order(snippets: DataFrame) -> DataFrame:
    """Snippets in the order patterns are looked for: critical before helpful, then by rank."""
    part = F.when(F.col("bucket") == "critical", 0).otherwise(1)
    return snippets.withColumn("seq", F.struct(part.alias("part"), F.col("rank").alias("rank")))
