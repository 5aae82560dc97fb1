"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.session import cut_lineage, shared_folder

__all__ = ["byte_words", "cut_lineage", "free_name", "read_table", "row_key", "same_row", "shared_folder", "text_bytes", "text_or_empty"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def row_key(text: Column) -> Column:
    """Tells rows that share an id but not a text apart; equal rows are treated alike."""
    return F.xxhash64(text_or_empty(text))


def text_bytes(batch: pa.RecordBatch, column: str, step: int = 256) -> Iterator[bytes]:
    """The UTF-8 bytes of a text column, empty for null; few rows of a batch are held at a time."""
    array = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    for at in range(0, len(array), step):
        yield from (x or b"" for x in array.slice(at, step).cast(kind).to_pylist())


def byte_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` parts at exactly these six characters."""
    return data.split()


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``rows`` has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same_row(left: DataFrame, right: DataFrame, key: str, row: str, other_key: str, other_row: str) -> Column:
    """Join condition on an id, which may be null, and ``row_key``."""
    return left[key].eqNullSafe(right[other_key]) & (left[row] == right[other_row])
