"""Phrase collocation mining by stripes.

A phrase's prefix keys a stripe: an associative counter of the words that follow it. Tasks fill
stripes for blocks of text, a shuffle brings the stripes of a prefix together, and they are merged
element by element. A merged stripe gives the prefix's extensions with their counts, the total of
its continuations, and the largest extension, which is what decides whether the prefix is subsumed.

Texts are read and told into words once: blocks of word numbers are stored, and every pass reads those.
One pass counts words, the next word pairs by a 64-bit hash only. Phrases then grow one word a level: stripes of pairs are filled where the pair's hash is frequent, longer ones where both phrases one
word shorter may be frequent. That is asked of a bitmap of fixed size, so nothing broadcast grows with the
data; a false yes costs a counter that is dropped when counts are known, and no frequent phrase is lost. Within
a block phrases are told apart by exact word numbers, and afterwards as strings.

Stripes travel in ``buckets`` by a hash of the prefix: a block sends one row for each of them, however many
prefixes it holds, and those of one bucket are merged by Arrow. A place of the text fills at most one counter
a level.

A prefix that holds a thousandth of all words or more (fewer than a thousand can) has its stripe dealt out by the next word; totals
and maxima of the parts are then summed and compared. Everything is counted per language.

Defined results: a null text is empty, a null language is ``und``; texts longer than a block are
cut between pieces, which no phrase crosses; repeated rows count each time; ties have one order
(score, count, then bytes of the phrase); a language without a frequent phrase has no row; an empty
table gives no rows; only the text and language columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.llm.common import cut_lineage, text_bytes

#: A byte that no UTF-8 text holds stands for the end of a piece.
BREAK = b"\xff"
CUTS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", BREAK * 10)
LAST_CUT = re.compile(rb"(?s).*[.,;:!?\x0A-\x0D]")
#: floor(1000 a n / (l r)); products of 18 and 19 decimal digits are exact in 38.
RATIO = "(CAST(1000 * a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(19, 0)))"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Settings:
    longest: int = 5  # words of a phrase
    least: int = 100  # occurrences of a candidate
    top: int = 2000  # phrases of each language
    block: int = 8_000_000  # bytes of text that a task counts together
    bits: int = 24  # 2 ** bits places of the bitmap of frequent phrases
    parts: int = 64  # parts of the stripe of a very frequent prefix
    buckets: int = 512  # rows that the stripes of a block travel in, at most


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(language, lower-cased text) with pieces ended by line feeds; no more than about ``size`` bytes are held."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        for lang, data in zip(batch.column(1).to_pylist(), text_bytes(batch, "text"), strict=True):
            while len(data) > size:
                cut = LAST_CUT.match(data, 0, size)
                if cut is None:
                    break
                yield lang, data[: cut.end()].lower()
                data = data[cut.end() :]
            held.setdefault(lang, []).append(data.lower())
            total += len(data)
            if total >= size:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, total = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def _chain(marks: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Marks of phrases with one word more."""
    with np.errstate(over="ignore"):
        x = marks * _MIX[0] + more
        return (x ^ (x >> np.uint64(29))) * _MIX[1]


def word_marks(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_mark(phrase: bytes, lang: str) -> np.ndarray:
    marks = word_marks(phrase.split(b" "), lang)
    made = marks[:1]
    for m in marks[1:]:
        made = _chain(made, m)
    return made


def _held(marks: np.ndarray, maybe: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bitmap ``maybe`` holds each of ``marks``."""
    place = marks >> np.uint64(64 - bits)
    return (maybe[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Block:
    """The words of a text as numbers, pieces ended by -1."""

    def __init__(self, lang: str, vocabulary: pa.Array, word_marks: np.ndarray, ids: np.ndarray) -> None:
        self.lang, self.vocabulary, self.word_marks = lang, vocabulary, word_marks
        self.ids = ids.astype(np.int64)

    @classmethod
    def of(cls, text: bytes, lang: str) -> Block:
        words = text.translate(CUTS).replace(BREAK, b" " + BREAK + b" ").split()
        coded = pa.array([*words, BREAK], pa.binary()).dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        marks = word_marks(coded.dictionary.to_pylist(), lang)
        ids[ids == ids[-1]] = -1
        return cls(lang, coded.dictionary, marks, ids)

    @property
    def marks(self) -> np.ndarray:
        return self.word_marks[self.ids]

    def counts(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        n = np.bincount(self.ids[self.ids >= 0], minlength=len(self.vocabulary))
        used = np.flatnonzero(n)
        return self.vocabulary.take(pa.array(used)), n[used], self.word_marks[used]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the block's word pairs, and how often each occurs."""
        inside = (self.ids[:-1] >= 0) & (self.ids[1:] >= 0)
        marks = self.marks
        return np.unique(_chain(marks[:-1], marks[1:])[inside], return_counts=True)

    def stripes(self, n: int, maybe: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words of each prefix (``n - 1`` columns), where each one's counter begins, numbers
        of next words and their counts."""
        w = self.ids
        size = len(w) - n + 1
        if size <= 0:
            return np.zeros((0, n - 1), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Pairs are asked for themselves, longer phrases for the two that are one word shorter.
        asked = max(n - 1, 2)
        among = len(w) - asked + 1
        each = self.marks
        marks = each[:among]
        for k in range(1, asked):
            marks = _chain(marks, each[k : among + k])
        may = _held(marks, maybe, bits)
        good = may if n == 2 else may[:-1] & may[1:]
        for k in range(n):
            good &= w[k : k + size] >= 0
        at = np.flatnonzero(good)
        span = len(self.vocabulary)
        code = w[at]
        for k in range(1, n - 1):
            code = np.unique(code * span + w[at + k], return_inverse=True)[1]
        pairs, first, counts = np.unique(code * span + w[at + n - 1], return_index=True, return_counts=True)
        begins = np.flatnonzero(np.append(True, np.diff(pairs // span) != 0)) if len(pairs) else np.zeros(0, np.int64)
        here = at[first]
        prefix = w[here[begins][:, None] + np.arange(n - 1)]
        return prefix, np.append(begins, len(pairs)), w[here + n - 1], counts

    def phrases(self, numbers: np.ndarray) -> pa.Array:
        """Phrases of the words of each row of ``numbers``."""
        words = [self.vocabulary.take(pa.array(column)) for column in numbers.T]
        joined = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, b" ")
        return joined.cast(pa.string())


def store_blocks(docs: DataFrame, s: Settings) -> DataFrame:
    """(lang, vocabulary, marks, ids) of the blocks of (text, lang): their words, joined by spaces, the hash of
    each, and the word numbers of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in blocks(batches, s.block):
            block = Block.of(text, lang)
            packed = [b" ".join(block.vocabulary.to_pylist()), block.word_marks.tobytes(), block.ids.astype(np.int32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *(pa.array([x], pa.binary()) for x in packed)], ["lang", "vocabulary", "marks", "ids"])

    return docs.mapInArrow(run, "lang string, vocabulary binary, marks binary, ids binary")


def stored_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for lang, vocabulary, marks, ids in zip(*batch.columns, strict=True):
            words = pa.array(vocabulary.as_buffer().to_pybytes().split(b" "), pa.binary())
            yield Block(lang.as_py(), words, np.frombuffer(marks.as_buffer(), np.uint64), np.frombuffer(ids.as_buffer(), np.int32))


def count_words(stored: DataFrame, s: Settings) -> DataFrame:
    """(lang, phrase, a, mark): all words that occur ``least`` times; and the number of words of each
    language, without a phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "a", "mark"]
        for block in stored_blocks(batches):
            words, n, marks = block.counts()
            yield pa.RecordBatch.from_arrays([pa.array([block.lang] * len(n), pa.string()), words.cast(pa.string()), pa.array(n), pa.array(marks.view(np.int64))], names)
            yield pa.RecordBatch.from_arrays([pa.array([block.lang]), pa.nulls(1, pa.string()), pa.array([int(n.sum())], pa.int64()), pa.array([0], pa.int64())], names)

    made = stored.mapInArrow(run, "lang string, phrase string, a long, mark long")
    summed = made.groupBy("lang", "phrase", "mark").agg(F.sum("a").alias("a"))
    return summed.filter((F.col("a") >= s.least) | F.col("phrase").isNull())


def count_pairs(stored: DataFrame, s: Settings) -> DataFrame:
    """(mark, a) of the word pairs that occur ``least`` times, by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in stored_blocks(batches):
            pairs, n = block.pairs()
            for at in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], ["mark", "a"])

    made = stored.mapInArrow(run, "mark long, a long")
    return made.groupBy("mark").agg(F.sum("a").alias("a")).filter(F.col("a") >= s.least)


def bitmap(marks: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the phrases of ``marks`` (mark), of ``2 ** bits`` places."""
    # Bitmaps of 32,768 places are merged where they are made; 2 ** (bits - 15) of them come here.
    # Buckets and their bits are numbered from place 1.
    place = F.shiftrightunsigned("mark", 64 - bits) + 1
    rows = marks.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held")).collect()
    made = np.zeros(max(1 << bits - 3, 4096), np.uint8)
    for r in rows:
        at = 4096 * (r["bucket"] - 1)
        made[at : at + 4096] |= np.frombuffer(bytes(r["held"]), np.uint8)
    return made


def fill_stripes(stored: DataFrame, n: int, maybe: np.ndarray, hot: np.ndarray, s: Settings) -> DataFrame:
    """(lang, bucket, prefixes, sizes, nexts, counts): the stripes of each block, those of a bucket in one row;
    ``sizes`` are those of the counters that follow one another in ``nexts`` and ``counts``. Stripes of the
    prefixes with a hash in ``hot`` are in parts by a hash of the next word."""
    held, wide = maybe.tobytes(), hot.astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held, np.uint8)
        for block in stored_blocks(batches):
            prefix, offsets, nexts, counts = block.stripes(n, bits, s.bits)
            if not len(prefix):
                continue
            marks = block.word_marks[prefix[:, 0]]
            for k in range(1, n - 1):
                marks = _chain(marks, block.word_marks[prefix[:, k]])
            owner = np.repeat(np.arange(len(prefix)), np.diff(offsets))
            part = np.where(np.isin(marks, wide)[owner], block.word_marks[nexts] % np.uint64(s.parts), np.uint64(0))
            bucket = (_chain(marks[owner], part) >> np.uint64(32)).astype(np.int64) % s.buckets
            # Each bucket's stripes together, and each stripe's counters.
            key = bucket * len(prefix) + owner
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, np.diff(key) != 0))
            of = key[first] // len(prefix)
            rows = np.flatnonzero(np.append(True, np.diff(of) != 0))
            stripes = pa.array(np.append(rows, len(of)).astype(np.int32))
            counters = pa.array(np.append(first[rows], len(key)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.lang] * len(rows), pa.string()),
                    pa.array(of[rows].astype(np.int32)),
                    pa.ListArray.from_arrays(stripes, block.phrases(prefix[key[first] % len(prefix)])),
                    pa.ListArray.from_arrays(stripes, pa.array(np.diff(np.append(first, len(key))).astype(np.int32))),
                    pa.ListArray.from_arrays(counters, block.phrases(nexts[order][:, None])),
                    pa.ListArray.from_arrays(counters, pa.array(counts[order], pa.int64())),
                ],
                ["lang", "bucket", "prefixes", "sizes", "nexts", "counts"],
            )

    return stored.mapInArrow(run, "lang string, bucket int, prefixes array<string>, sizes array<int>, nexts array<string>, counts array<long>")


def merge_stripes(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, total, largest, nexts, counts, marks) of each prefix, or part of a prefix, with an
    extension that occurs ``least`` times; only such extensions are listed."""
    schema = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("total", pa.int64()), ("largest", pa.int64()), ("nexts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])
    stripe, phrase = ["lang", "bucket", "prefix"], ["lang", "bucket", "prefix", "next"]

    def counters(batch: pa.RecordBatch) -> pa.Table:
        lang, bucket, prefixes, sizes, nexts, counts = batch.columns
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(nexts).to_numpy(zero_copy_only=False))
        of = np.repeat(np.arange(len(prefixes.flatten())), sizes.flatten().to_numpy(zero_copy_only=False))
        return pa.table([lang.take(pa.array(row)), bucket.take(pa.array(row)), prefixes.flatten().take(pa.array(of)), nexts.flatten(), counts.flatten()], [*phrase, "count"])

    def summed(some: pa.Table) -> pa.Table:
        return some.group_by(phrase, use_threads=False).aggregate([("count", "sum")]).rename_columns([*phrase, "count"])

    def merged(some: pa.Table) -> Iterator[pa.RecordBatch]:
        order = [(k, "ascending") for k in stripe]
        figures = some.group_by(stripe, use_threads=False).aggregate([("count", "sum"), ("count", "max")])
        figures = figures.filter(pc.field("count_max") >= least).sort_by(order)
        listed = some.filter(pc.field("count") >= least).group_by(stripe, use_threads=False).aggregate([("next", "list"), ("count", "list")]).sort_by(order)
        for at in range(0, listed.num_rows, 1000):
            of, lists = figures.slice(at, 1000), listed.slice(at, 1000)
            marks = [
                _chain(phrase_mark(p.encode(), g), word_marks([w.encode() for w in nexts], g)).view(np.int64)
                for g, p, nexts in zip(*(lists[c].to_pylist() for c in ("lang", "prefix", "next_list")), strict=True)
            ]
            columns = [of["lang"], of["prefix"], of["count_sum"], of["count_max"], lists["next_list"], lists["count_list"], pa.array(marks, pa.list_(pa.int64()))]
            yield from pa.table(columns, schema=schema).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by language and bucket; the last bucket may go on, so its counters wait.
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                held = summed(counters(some) if held is None else pa.concat_tables([held, counters(some)]))
                last = (pc.field("lang") == some.column(0)[-1]) & (pc.field("bucket") == some.column(1)[-1])
                yield from merged(held.filter(~last))
                held = held.filter(last)
        if held is not None:
            yield from merged(held)

    dealt = stripes.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return dealt.mapInArrow(run, "lang string, prefix string, total long, largest long, nexts array<string>, counts array<long>, marks array<long>")


def _extensions(stripes: DataFrame) -> DataFrame:
    each = stripes.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts", "marks")).alias("e"))
    return each.select("lang", F.concat_ws(" ", "prefix", "e.nexts").alias("phrase"), F.col("e.counts").alias("a"), F.col("e.marks").alias("mark"))


def phrase_counts(docs: DataFrame, text: str, lang: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """(lang, n) of all words; (lang, phrase, words, a) of frequent words and phrases; and (lang, phrase,
    largest): the most frequent phrase that is one word longer and holds it."""
    s = settings
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    stored = cut_lineage(store_blocks(rows, s))
    found = cut_lineage(count_words(stored, s))
    totals = found.filter("phrase IS NULL AND a > 0").select("lang", F.col("a").alias("n"))
    every = totals.agg(F.sum("n")).first()[0] or 0
    level = found.filter("phrase IS NOT NULL")
    counts = level.select("lang", "phrase", F.lit(1).alias("words"), "a")
    largest = None
    for n in range(2, s.longest + 1):
        # At most 1,000 phrases of one length hold a thousandth of all words each.
        hot = np.array([r["mark"] for r in level.filter(F.col("a") * 1000 > every).select("mark").collect()], np.int64)
        maybe = bitmap(count_pairs(stored, s) if n == 2 else level, s.bits)
        stripes = cut_lineage(merge_stripes(fill_stripes(stored, n, maybe, hot, s), s.least))
        level = _extensions(stripes)
        counts = counts.unionByName(level.select("lang", "phrase", F.lit(n).alias("words"), "a"))
        right = stripes.select("lang", F.col("prefix").alias("phrase"), "largest")
        left = level.select("lang", F.substring_index("phrase", " ", -(n - 1)).alias("phrase"), F.col("a").alias("largest"))
        both = right.unionByName(left)
        largest = both if largest is None else largest.unionByName(both)
    return totals, counts, largest.groupBy("lang", "phrase").agg(F.max("largest").alias("largest"))


def mine(docs: DataFrame, text: str, lang: str, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    totals, counts, largest = phrase_counts(docs, text, lang, settings)
    counts = cut_lineage(counts)
    # A longer candidate that holds a phrase occurs no more often than it; if as often, so does one
    # that is a single word longer.
    candidates = counts.filter("words > 1").join(largest, ["lang", "phrase"], "left").filter("largest IS NULL OR largest < a")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    each = candidates.select("lang", "phrase", "words", "a", cut)
    parts = each.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    known = parts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    scored = known.withColumn("score", F.expr(RATIO)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The first of each part of a language, then of all parts: no task sorts a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part")
    some = flat.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= settings.top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= settings.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
