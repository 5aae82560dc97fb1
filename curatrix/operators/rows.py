"""Arrays to rows, and small sides of joins."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.session import cut_lineage

FEW = 500_000


def few(rows: DataFrame) -> DataFrame:
    """``rows``, which are stored already, for a join with a large table: at most FEW of them are sent to
    where the table is read, more are shuffled with it."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def bits_for(rows: int, least: int, most: int) -> int:
    """Of a bucket number, for about 16 buckets a row."""
    return min(most, max(least, math.ceil(math.log2(16 * rows + 1))))


def bitmap(words: Iterable[int]) -> Column:
    """A constant array of longs, 64 bits each."""
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _maybe(kept: DataFrame, key: list[str]) -> Column:
    """Whether a bitmap of hashed keys, 2 MB at most, does not rule out that a key is in ``kept``."""
    bits = bits_for(kept.count(), 14, 24)
    bucket = F.xxhash64(*key).bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(bucket, 6).cast("int"), bucket.bitwiseAND(F.lit(63)).cast("int")
    marks = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("marks")
    words = [0] * (1 << bits - 6)
    for r in kept.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(marks).collect():
        words[r["word"]] = r["marks"]
    return F.call_function("getbit", F.get(bitmap(words), word), bit) == 1


def those(rows: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` whose key is in ``kept``, which is stored. Where those are too many to be sent, only rows
    that a bitmap does not rule out are shuffled."""
    if kept.limit(FEW + 1).count() > FEW:
        return rows.filter(_maybe(kept, key)).join(kept, key, "left_semi")
    return rows.join(F.broadcast(kept), key, "left_semi")


def among(rows: DataFrame, kept: DataFrame, key: list[str], stored: bool = False) -> DataFrame:
    """``rows`` whose key is in ``kept``. Only keys are shuffled where few others are left out: those are
    then sent to where the rows are read. Where they are many, rows are shuffled that a bitmap of them
    does not rule out; ``stored`` keeps these on disk."""
    known = rows
    for name in key:
        known = known.filter(F.col(name).isNotNull())
    others = cut_lineage(known.select(*key).join(kept, key, "left_anti").distinct())
    if others.limit(FEW + 1).count() > FEW:
        doubtful = _maybe(others, key)
        found = known.filter(doubtful).join(kept, key, "left_semi")
        return known.filter(~doubtful).union(found.persist(StorageLevel.DISK_ONLY) if stored else found)
    return known.join(F.broadcast(others), key, "left_anti")


def one_row_each(
    rows: DataFrame, keep: list, array: Column, name: str, place: str | None = None
) -> DataFrame:
    """One row per element of a computed array without nulls, with its ``place`` from 0.

    A plain explode makes Spark test the array's size in a filter below it, for which the whole
    array is worked out twice more; the outer form works it out once.
    """
    if place is None:
        made = F.explode_outer(array).alias(name)
    else:
        made = F.posexplode_outer(array).alias(place, name)
    return rows.select(*keep, made).filter(F.col(name).isNotNull())
