"""Row-local operators on a stream of fetched pages.

Every operator used here is one narrow pass, so the same code runs on ``read`` and
``readStream``. The only state is the exact-copy filter, bounded by its watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.text import content_hash
from curatrix.operators.chunking import chunk_documents
from curatrix.operators.extraction import extract_documents
from curatrix.operators.filters import fetched_ok, not_spam
from curatrix.sources.tables import PAGES


def page_stream(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(PAGES).format(format).load(path)


def document_stream(pages: DataFrame) -> DataFrame:
    """Fetched pages to clean documents; ``fetched_at`` stays as event time."""
    timed = fetched_ok(pages).withColumn("event_time", F.col("fetched_at"))
    return not_spam(extract_documents(timed))


def first_copies(docs: DataFrame, delay: str = "24 hours") -> DataFrame:
    """[A9] Drops documents whose normalised text came before, within the watermark."""
    return (
        docs.withColumn("content_hash", content_hash(F.col("markdown")))
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["content_hash"])
    )


def chunk_stream(docs: DataFrame, max_tokens: int = 500) -> DataFrame:
    return chunk_documents(docs.select("source", "event_time", "markdown"), "markdown", max_tokens)
