"""Repeated-passage removal by difference-cover anchors.

A window of ``length`` words is removed where its word sequence also starts earlier. Only short
windows at cover positions are hashed first: a set D of residues modulo a period p is a difference
cover if every residue is a difference of two of its members. For any two places i and j there is
then an offset below p at which both fall on residues of D, so two equal windows of ``length``
words share an aligned, equal anchor of ``length - p + 1`` words. With the default period of 13
and cover (0, 1, 3, 9), 4 of 13 places carry an anchor.

0. Of documents with equal texts all but the first are decided at once: each of their windows also
   starts in the first.
1. Of the others, anchors are hashed, and those that occur more than once are found.
2. They extend: only windows that hold such an anchor are hashed as a whole (96 bits), and for
   each the earliest place is found. Every other place of an equal window is removed.
3. Texts are joined with their first places, and the words that removed windows cover are dropped.

Within each batch equal keys meet before the shuffle, which then holds one row per key and batch,
so neither a passage of a third of all documents nor a group of copies fills one task. Windows are
judged on the input, so one pass decides all of them.

Defined results: a null text has no words; a text of fewer words than a window is kept whole; of
windows with equal words the one with the smallest (id, start) stays, a null id sorts after all
others; rows that share an id but not a text are documents of their own in the order of a hash of
their texts; equal rows with equal ids are one document and get equal results; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import byte_words, same_row, text_bytes

PERIOD, COVER = 13, (0, 1, 3, 9)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def check_cover(period: int, cover: tuple[int, ...], length: int) -> int:
    """Words of an anchor; raises if the cover does not hold for windows of ``length`` words."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period}")
    if length < period:
        raise ValueError(f"a window of {length} words holds no aligned anchor of period {period}")
    return length - period + 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of every window of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b = np.uint64(base)
    with np.errstate(over="ignore"):
        out = h[:n] * b
        for k in range(1, size):
            out = (out + h[k : k + n]) * b
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(29)
    return out


def _first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first row of each distinct key (rows in order), and how many it stands for."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    new = np.ones(len(order), bool)
    for k in keys:
        s = k[order]
        if len(s):
            new[1:] &= s[1:] == s[:-1]
    if len(order):
        new[1:] = ~new[1:]
        new[0] = True
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _anchors(period: int, cover: tuple[int, ...], size: int):
    """Rows (hash, key, text hash, place, meets): one row per distinct anchor of a batch, which
    is known to be repeated if the batch holds it twice; its other places are known as well and
    need not meet anything. A place that is known is written as ``-1 - place``."""
    residue = np.zeros(period, bool)
    residue[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows, places = [], [], []
            for i, data in enumerate(text_bytes(batch, "text")):
                words = byte_words(data)
                if len(words) >= size + period - 1:
                    h = window_hashes(word_hashes(words), size, _BASE[0])
                    at = np.flatnonzero(residue[np.arange(len(h)) % period])
                    hashes.append(h[at])
                    places.append(at.astype(np.int32))
                    rows.append(np.full(len(at), i, np.int32))
            if not hashes:
                continue
            h, row, place = np.concatenate(hashes), np.concatenate(rows), np.concatenate(places)
            first, n = _first_of_each(h)
            known = np.ones(len(h), bool)
            known[first] = n > 1
            place = np.where(known, -1 - place, place)
            meets = np.zeros(len(h), bool)
            meets[first] = True
            for a in range(0, len(h), 500_000):
                some = slice(a, a + 500_000)
                index = pa.array(row[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        # 48 bits: an anchor that meets another by chance only asks for a few windows more.
                        pa.array((h[some] >> np.uint64(16)).view(np.int64)),
                        batch.column(0).take(index),
                        batch.column(1).take(index),
                        pa.array(place[some].astype(np.int32)),
                        pa.array(meets[some]),
                    ],
                    ["hash", "key", "row", "place", "meets"],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of anchors that are known to be repeated or meet an equal one; rows in hash order."""
    rest: pa.RecordBatch | None = None

    def judged(b: pa.RecordBatch) -> pa.RecordBatch:
        h = b.column(0).to_numpy(zero_copy_only=False)
        same = h[1:] == h[:-1]
        more = np.zeros(len(h), bool)
        more[1:] |= same
        more[:-1] |= same
        place = b.column(3).to_numpy(zero_copy_only=False)
        more |= place < 0
        kept = b.filter(pa.array(more))
        return pa.RecordBatch.from_arrays(
            [kept.column(1), kept.column(2), pa.array(np.where(place < 0, -1 - place, place)[more].astype(np.int32))], ["key", "row", "place"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        now = batch if rest is None else pa.concat_batches([rest, batch])
        h = now.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(h, h[-1], "left"))
        # At most one row per key and batch of the input waits here.
        if cut:
            yield judged(now.slice(0, cut))
        rest = now.slice(cut)
    if rest is not None:
        yield judged(rest)


def _starts(places: np.ndarray, n_words: int, length: int, period: int) -> np.ndarray:
    """Starts of the windows that hold an anchor at one of ``places`` at an offset below the
    period."""
    n = n_words - length + 1
    if n <= 0 or not len(places):
        return np.empty(0, np.int64)
    mark = np.zeros(n_words + 2, np.int64)
    np.add.at(mark, np.maximum(places - period + 1, 0), 1)
    np.add.at(mark, places + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[:n] > 0)


def _windows(length: int, period: int):
    """Rows (hi, lo, key, row, start): the earliest place of each distinct window of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            his, los, rows, starts = [], [], [], []
            by = [("key", "ascending"), ("row", "ascending")]
            order = pc.sort_indices(batch.select(["key", "row"]), by, null_placement="at_end").to_pylist()
            texts, anchors = list(text_bytes(batch, "text")), batch.column(3)
            for i in order:
                words = byte_words(texts[i])
                s = _starts(np.unique(np.array(anchors[i].values, np.int64)), len(words), length, period)
                if len(s):
                    h = word_hashes(words)
                    his.append(window_hashes(h, length, _BASE[0])[s])
                    los.append(window_hashes(h, length, _BASE[1])[s])
                    rows.append(np.full(len(s), i, np.int32))
                    starts.append(s.astype(np.int32))
            if not his:
                continue
            hi, lo, row, start = (np.concatenate(x) for x in (his, los, rows, starts))
            # Rows are in the order of (key, row, start), so the first of each window is the earliest.
            first, _ = _first_of_each(hi, lo)
            index = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hi[first].view(np.int64)),
                    pa.array((lo[first] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    batch.column(0).take(index),
                    batch.column(1).take(index),
                    pa.array(start[first]),
                ],
                ["hi", "lo", "key", "row", "start"],
            )

    return run


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each window's first row; rows in the order of (hi, lo, key, row, start)."""
    last = None
    for batch in batches:
        if batch.num_rows:
            hi, lo = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            new = np.ones(len(hi), bool)
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            new[0] = last != (hi[0], lo[0])
            last = hi[-1], lo[-1]
            yield batch.filter(pa.array(new)).select(["key", "row", "start"])


def _keep(length: int, period: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, kept, removed = [], [], []
            anchors, firsts, copies = batch.column(3), batch.column(4), batch.column(5).to_pylist()
            for i, data in enumerate(text_bytes(batch, "text")):
                words = byte_words(data)
                stay = words
                if copies[i] and len(words) >= length:
                    stay = []
                elif anchors[i].is_valid:
                    s = _starts(np.unique(np.array(anchors[i].values, np.int64)), len(words), length, period)
                    if firsts[i].is_valid:
                        s = np.setdiff1d(s, np.array(firsts[i].values, np.int64), assume_unique=False)
                    mark = np.zeros(len(words) + 1, np.int64)
                    mark[s] += 1
                    np.add.at(mark, s + length, -1)
                    stay = [w for w, m in zip(words, np.cumsum(mark)[:-1], strict=True) if not m]
                text = b" ".join(stay)
                n_words.append(len(words))
                kept.append(text.decode())
                removed.append(len(words) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["key", "n_words", "n_removed", "kept_text"],
            )

    return run


def remove_repeats(
    docs: DataFrame, key: str, text: str, length: int = 20, period: int = PERIOD, cover: tuple[int, ...] = COVER
) -> DataFrame:
    """(key, n_words, n_removed, kept_text): the words that stay, joined by one space."""
    size = check_cover(period, cover, length)
    # 32 bits tell rows apart that share an id; every shuffled row carries them.
    row = F.hash(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).alias("key"), row.alias("row"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def named(table: DataFrame, prefix: str) -> DataFrame:
        return table.withColumnsRenamed({"key": f"{prefix}_key", "row": f"{prefix}_row"})

    def with_rows(left: DataFrame, right: DataFrame, prefix: str, how: str) -> DataFrame:
        return left.join(right, same_row(left, right, "key", "row", f"{prefix}_key", f"{prefix}_row"), how)

    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    alone = rows.groupBy(digest.alias("digest")).agg(F.min("key").alias("key"), F.min("row").alias("row")).drop("digest")
    alone = named(alone.withColumn("alone", F.lit(True)), "alone")
    single = with_rows(rows, alone, "alone", "left_semi")
    found = single.mapInArrow(
        _anchors(period, cover, size), f"hash long, key {kind}, row int, place int, meets boolean"
    )
    # What need not meet anything is dealt out evenly.
    aside = F.shiftrightunsigned(F.xxhash64("hash", "row", "place"), 16)
    spread = F.when(F.col("meets"), F.col("hash")).otherwise(aside)
    dealt = found.withColumn("hash", spread).drop("meets").repartition("hash").sortWithinPartitions("hash")
    repeated = dealt.mapInArrow(_repeated, f"key {kind}, row int, place int")
    anchors = named(repeated.groupBy("key", "row").agg(F.collect_list("place").alias("anchors")), "anchor")
    held = with_rows(single, anchors, "anchor", "inner").select("key", "row", "text", "anchors")
    windows = held.mapInArrow(_windows(length, period), f"hi long, lo int, key {kind}, row int, start int")
    ordered = windows.repartition("hi", "lo").sortWithinPartitions("hi", "lo", F.asc_nulls_last("key"), "row", "start")
    first = ordered.mapInArrow(_earliest, f"key {kind}, row int, start int")
    firsts = named(first.groupBy("key", "row").agg(F.collect_list("start").alias("firsts")), "first")
    every = with_rows(with_rows(with_rows(rows, alone, "alone", "left"), anchors, "anchor", "left"), firsts, "first", "left")
    copy = F.col("alone").isNull().alias("copy")
    made = every.select("key", "row", "text", "anchors", "firsts", copy).mapInArrow(
        _keep(length, period), f"key {kind}, n_words long, n_removed long, kept_text string"
    )
    return made.withColumnRenamed("key", key)
