"""Task x item relevance without a cross join. [J5, T2, T14 - T16, C4]"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions.text import at_most, task_terms, text_or_empty, text_relevance
from curatrix.functions.urls import allowed_domain, url_rank
from curatrix.operators.ranking import top_k
from curatrix.operators.rows import one_row_each

# Tasks carry this module's code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = re.compile("[a-z0-9_]{3,}")
ANCHORS = (3, 6, 12)  # a term has at least three characters
ROWS_PER_BLOCK = 2048
# No result depends on these: sizes of blocks, parts that meet a block of units, numbers of a matrix, runs kept.
ITEMS_PER_BLOCK, CHARS_PER_BLOCK, UNITS_PER_BLOCK, SPREAD, CELLS, RUNS_KEPT = 1024, 1 << 21, 256, 64, 1 << 20, 50_000


def task_term_table(tasks: DataFrame, task_id: str = "task_id", task: str = "task") -> DataFrame:
    """(task_id, term, times, n_terms): the terms of every task with their multiplicity."""
    terms = tasks.select(task_id, task_terms(F.col(task)).alias("terms"))
    return (
        one_row_each(terms, [task_id, F.size("terms").alias("n_terms")], F.col("terms"), "term")
        .groupBy(task_id, "n_terms", "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def item_terms(items: DataFrame, terms: DataFrame, item_id: list[str], text: str) -> DataFrame:
    """(item_id, term): which of the ``terms`` occur inside which item, each pair once."""
    alone = terms.select("term").distinct()
    weights = alone.select(F.col("term").alias("unit"), F.lit(1).alias("n_terms"), "term", F.lit(1).cast("bigint").alias("times"))
    return _shares(items, weights, item_id, text).select(*item_id, F.col("unit").alias("term"))


def term_coverage(
    tasks: DataFrame,
    items: DataFrame,
    item_id: list[str],
    text: str = "text",
    task_id: str = "task_id",
    task: str = "task",
    at_least: float | None = None,
    best: int | None = None,
) -> DataFrame:
    """[J5, T2, F14] (task_id, item_id, score) for all pairs with at least one shared term.

    Pairs that share no term score 0 and are left out. With ``at_least`` only pairs of that score
    are given; with ``best`` a superset of the rows of each task that score as high as its
    ``best``-th row, all ties included, so a top k behind it sees few rows. No pair is shuffled.
    """
    terms = task_term_table(tasks, task_id, task)
    if at_least is not None and at_least > 0:
        weights = terms.filter(F.col(task_id).isNotNull()).select(
            F.struct(task_id, "n_terms").alias("unit"), "n_terms", "term", "times"
        )
        items = items.dropna(subset=item_id)
        pairs = _shares(items, weights, item_id, text, at_least, best)
        return pairs.select(F.col(f"unit.{task_id}").alias(task_id), *item_id, "score")
    sums = terms.groupBy(task_id, "term").agg(F.sum("times").alias("times"), F.first("n_terms").alias("n_terms"))
    weights = sums.select(F.col(task_id).alias("unit"), "n_terms", "term", "times")
    return _shares(items, weights, item_id, text, None, best).select(F.col("unit").alias(task_id), *item_id, "score")


def _shares(
    items: DataFrame,
    weights: DataFrame,
    item_id: list[str],
    text: str,
    at_least: float | None = None,
    best: int | None = None,
) -> DataFrame:
    """(unit, item_id, score): the share of the terms of a unit that occur inside an item, where any does.

    ``weights(unit, n_terms, term, times)``. A block join, as for vectors: items are packed where they
    are read into blocks of ITEMS_PER_BLOCK, their distinct runs of ``[a-z0-9_]`` and each item's run
    numbers, so a block is smaller than its texts and is dealt out once for every UNITS_PER_BLOCK
    units. A term is made of such characters, so it occurs in a text iff it is a piece of one run. A
    pair of blocks is one matrix product of counts; its pairs leave it scored.
    """
    repeated = items.groupBy(*item_id).count().filter("count > 1")
    if not repeated.isEmpty():
        # The rows of one id are one item; a run does not go on behind a line feed.
        every = F.concat_ws("\n", F.collect_list(text_or_empty(F.col(text))))
        items = items.groupBy(*item_id).agg(every.alias(text))
    blocks, n_blocks = _unit_blocks(weights)
    blocks = blocks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    low = items.select(F.struct(*item_id).alias("item"), F.lower(text_or_empty(F.col(text))).alias("low"))
    kind = low.schema["item"].dataType.simpleString()
    packed = low.mapInArrow(_packed_runs, f"items array<{kind}>, sizes array<int>, numbers array<int>, runs string, place int")
    part = F.pmod(F.xxhash64(F.spark_partition_id(), "place"), F.lit(SPREAD)).cast("int")
    packed = packed.withColumn("b", part).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    both = packed.join(blocks, ["a", "b"]).select("a", "units", "items", "sizes", "numbers", "runs")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Units] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number, units, rows, sizes, numbers, runs = (batch.column(c)[i] for c in range(6))
                if number.as_py() not in known:
                    if len(known) == 8:
                        known.clear()
                    known[number.as_py()] = _Units(units.values, best)
                yield from known[number.as_py()].scored(
                    rows.values, np.asarray(sizes.values), np.asarray(numbers.values), runs.as_py(), at_least
                )

    unit = weights.schema["unit"].dataType.simpleString()
    found = both.mapInArrow(scored, f"unit {unit}, item {kind}, score double")
    return found.select("unit", *[F.col(f"item.{c}").alias(c) for c in item_id], "score")


def _unit_blocks(weights: DataFrame) -> tuple[DataFrame, int]:
    """(a, units): blocks of units with their terms, and how many."""
    terms = F.collect_list(F.struct("term", "times")).alias("terms")
    each = weights.groupBy("unit", "n_terms").agg(terms).select(
        "unit", "n_terms", F.concat_ws(" ", "terms.term").alias("terms"), F.col("terms.times").alias("times")
    )
    n_blocks = max(1, -(-each.count() // UNITS_PER_BLOCK))
    block = F.pmod(F.xxhash64("unit"), F.lit(n_blocks)).cast("int").alias("a")
    return each.groupBy(block).agg(F.collect_list(F.struct("unit", "n_terms", "terms", "times")).alias("units")), n_blocks


def _packed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of items: their keys, how many distinct runs each has, the runs' numbers and the runs."""
    place = 0
    for batch in batches:
        start, chars, sizes, numbers, runs = 0, 0, [], [], {}
        for row, low in enumerate(batch.column(1)):
            text = low.as_py()
            own = set(RUN.findall(text))
            chars += len(text)
            sizes.append(len(own))
            numbers.extend([runs.setdefault(run, len(runs)) for run in own])
            if len(sizes) == ITEMS_PER_BLOCK or chars > CHARS_PER_BLOCK or row == batch.num_rows - 1:
                keys = batch.column(0).slice(start, len(sizes))
                lists = [pa.ListArray.from_arrays([0, len(v)], v) for v in (pa.concat_arrays([keys]), pa.array(sizes, pa.int32()), pa.array(numbers, pa.int32()))]
                columns = [*lists, pa.array([" ".join(runs)]), pa.array([place], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["items", "sizes", "numbers", "runs", "place"])
                place += 1
                start, chars, sizes, numbers, runs = row + 1, 0, [], [], {}


class _Units:
    """A block of units, made ready to score blocks of items."""

    def __init__(self, units: pa.StructArray, best: int | None):
        self.keys, lists = units.field("unit"), [t.split(" ") for t in units.field("terms").to_pylist()]
        self.n_terms = np.asarray(units.field("n_terms"), dtype=np.float64)
        self.number: dict[str, int] = {}
        for terms in lists:
            for term in terms:
                self.number.setdefault(term, len(self.number))
        self.times = np.zeros((len(self.number), len(lists)))
        for unit, (terms, times) in enumerate(zip(lists, units.field("times").to_pylist(), strict=True)):
            self.times[[self.number[t] for t in terms], unit] = times
        self.anchored: dict[str, list[str]] = {}
        for term in self.number:
            size = max(n for n in ANCHORS if n <= len(term))
            self.anchored.setdefault(term[:size], []).append(term)
        self.sizes = sorted({len(anchor) for anchor in self.anchored})
        self.best, self.high = best, np.full((best or 0, len(lists)), -1.0)  # the best scores so far
        self.held: dict[str, tuple[int, ...]] = {}

    def terms_of(self, run: str) -> tuple[int, ...]:
        """Numbers of the terms inside a run, each found by its first 3, 6 or 12 characters."""
        if run not in self.held:
            if len(self.held) >= RUNS_KEPT:
                self.held.clear()
            found = set()
            for size in self.sizes:
                for at in range(len(run) - size + 1):
                    for term in self.anchored.get(run[at : at + size], ()):
                        if run.startswith(term, at):
                            found.add(self.number[term])
            self.held[run] = tuple(sorted(found))
        return self.held[run]

    def scored(
        self, items: pa.Array, sizes: np.ndarray, numbers: np.ndarray, runs: str, at_least: float | None
    ) -> Iterator[pa.RecordBatch]:
        if not runs or not self.number:
            return
        terms = [self.terms_of(run) for run in runs.split(" ")]
        counts = np.array([len(t) for t in terms])
        flat = np.array([n for t in terms for n in t], dtype=np.int64)
        starts = np.cumsum(counts) - counts
        ends = np.cumsum(sizes)
        step = max(1, CELLS // len(self.number))
        for low in range(0, len(sizes), step):
            high = min(low + step, len(sizes))
            own = numbers[ends[low] - sizes[low] : ends[high - 1]]
            each = counts[own]
            inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            holds = np.zeros((high - low, len(self.number)))
            rows = np.repeat(np.repeat(np.arange(high - low), sizes[low:high]), each)
            holds[rows, flat[np.repeat(starts[own], each) + inside]] = 1
            scores = (holds @ self.times) / self.n_terms
            wanted = scores > 0 if at_least is None else (scores > 0) & (scores >= at_least)
            if self.best:
                every = np.vstack([self.high, scores])
                self.high = np.partition(every, len(every) - self.best, axis=0)[-self.best :]
                wanted &= scores >= self.high.min(axis=0)
            item, unit = np.nonzero(wanted)
            if len(item):
                columns = [self.keys.take(pa.array(unit)), items.take(pa.array(item + low)), pa.array(scores[item, unit])]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "item", "score"])


def leading_terms(found: DataFrame, terms: DataFrame, task_id: str, at_least: float) -> DataFrame:
    """(task_id, term): the rarest terms of every task, one of which each item that covers a share of
    ``at_least`` must hold.

    A task's terms stand from the rarest to the most frequent. An item whose first term in that
    order is the i-th shares at most the weight from there on; the term leads if that is enough.
    Terms that no item holds weigh in ``n_terms`` only.
    """
    often = found.groupBy("term").agg(F.count(F.lit(1)).alias("items"))
    from_here = Window.partitionBy(task_id).orderBy(F.desc("items"), F.desc("term")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    weighed = terms.join(often, "term").withColumn("left", F.sum("times").over(from_here))
    return weighed.filter(F.col("left") / F.col("n_terms") >= at_least).select(task_id, "term")


def candidate_pairs(found: DataFrame, leading: DataFrame, item_id: list[str], task_id: str) -> DataFrame:
    """(task_id, item_id): pairs that share a leading term, each once."""
    return found.join(leading, "term").select(task_id, *item_id).distinct()


def score_pairs(pairs: DataFrame, task: str = "task", text: str = "text") -> DataFrame:
    """[T2] Coverage of pairs that are already joined: row-local, no shuffle."""
    return pairs.withColumn("score", text_relevance(F.col(task), F.col(text)))


def combined_relevance(coverage: Column, semantic: Column | None = None) -> Column:
    """[T16] The better of term coverage and the semantic (or lexical) score."""
    return coverage if semantic is None else F.greatest(coverage, F.coalesce(semantic, F.lit(0.0)))


def score_candidates(
    candidates: DataFrame,
    tasks: DataFrame,
    at_least: float,
    semantic: Column | None = None,
) -> DataFrame:
    """[C4] Candidates of a task that its domain list allows and that are relevant enough, with
    ``score`` = own score + url rank + 2.5 x relevance.

    ``candidates(task_id, seq, title, url, snippet, score)``, ``tasks(task_id, task,
    allowed_domains)``. The domain filter comes before the text is looked at.
    """
    joined = candidates.join(tasks.select("task_id", "task", "allowed_domains"), "task_id")
    allowed = joined.filter(allowed_domain(F.col("url"), F.col("allowed_domains")))
    text = F.concat_ws(" ", text_or_empty(F.col("title")), text_or_empty(F.col("snippet")))
    relevance = combined_relevance(text_relevance(F.col("task"), text), semantic)
    return (
        allowed.withColumn("relevance", relevance)
        .filter(F.col("relevance") >= at_least)
        .withColumn("score", F.col("score") + url_rank(F.col("url")) + 2.5 * F.col("relevance"))
        .drop("task", "allowed_domains")
    )


def answer_gate(
    answers: DataFrame, tasks: DataFrame, semantic: Column | None = None, body_chars: int | None = None
) -> DataFrame:
    """Answers of a task whose title and body, or its first ``body_chars`` characters, are
    relevant enough."""
    joined = answers.join(tasks.select("task_id", "task"), "task_id")
    body = at_most(F.col("answer_body"), body_chars)
    text = F.concat_ws(" ", text_or_empty(F.col("question_title")), body)
    relevance = combined_relevance(text_relevance(F.col("task"), text), semantic)
    return (
        joined.withColumn("relevance", relevance)
        .filter(F.col("relevance") >= K.ANSWER_MIN_RELEVANCE)
        .drop("task")
    )


def matching_questions(
    tasks: DataFrame, questions: DataFrame, at_least: float = K.ANSWER_MIN_RELEVANCE, max_results: int = 5
) -> DataFrame:
    """[Q4] For each task its ``max_results`` questions of a dump with the highest score, of those
    that share a tag with it and whose title holds enough of its terms.

    ``tasks(task_id, task, tags)``, ``questions(question_id, title, tags, score)``. Titles are
    matched first, through terms, so a tag that many tasks and questions have pairs nothing.
    """
    covered = term_coverage(tasks, questions, ["question_id"], "title", at_least=at_least)
    named = covered.withColumnRenamed("score", "coverage").join(tasks.select("task_id", F.col("tags").alias("asked")), "task_id")
    matched = named.join(questions, "question_id").filter(F.arrays_overlap("asked", "tags"))
    return top_k(matched.drop("asked"), max_results, ties=["question_id"])


def vector_scores(
    tasks: DataFrame,
    items: DataFrame,
    top_k: int,
    task_id: str = "task_id",
    item_id: str = "item_id",
    vector: str = "embedding",
) -> DataFrame:
    """[J5, T14] (task_id, item_id, score): a superset of every task's ``top_k`` by cosine, ties
    by item id.

    An exact block join: both sides are packed into blocks of about ROWS_PER_BLOCK vectors, one row
    each, and every pair of blocks meets by its two numbers, so the pairs are dealt out evenly and
    nothing passes through the driver. A pair of blocks is one matrix product; each partition keeps
    a running top k per task of a block.
    """
    left, n_left = _packed(tasks, task_id, vector, "a")
    right, n_right = _packed(items, item_id, vector, "b")
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = right.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    pairs = left.join(right, ["a", "b"]).select("a", "a_ids", "a_flat", "b_ids", "b_flat")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                number, *arrays = (batch.column(c)[i] for c in range(5))
                ids, flat, rows, others = (np.asarray(x.values) for x in arrays)
                if number.as_py() != block and held is not None:
                    yield _ranked(held, task_id, item_id)
                    held = None
                block = number.as_py()
                scores = _unit(flat.reshape(len(ids), -1)) @ _unit(others.reshape(len(rows), -1)).T
                every = np.broadcast_to(rows, scores.shape)
                if held is not None:
                    scores, every = np.hstack([held[2], scores]), np.hstack([held[1], every])
                order = np.lexsort((every, -scores))[:, :top_k]  # ties go to the smaller item id
                held = ids, np.take_along_axis(every, order, 1), np.take_along_axis(scores, order, 1)
        if held is not None:
            yield _ranked(held, task_id, item_id)

    return pairs.mapInArrow(best, f"{task_id} bigint, {item_id} bigint, score double")


def _packed(rows: DataFrame, key: str, vector: str, name: str) -> tuple[DataFrame, int]:
    """(name, name_ids, name_flat): blocks of vectors, one after the other, and how many."""
    known = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    known = known.filter(F.col("v").isNotNull())
    blocks = max(1, -(-known.count() // ROWS_PER_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    grouped = known.groupBy(block.alias(name)).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    ids = F.transform("rows", lambda r: r["id"]).alias(f"{name}_ids")
    return grouped.select(name, ids, F.flatten(F.transform("rows", lambda r: r["v"])).alias(f"{name}_flat")), blocks


def _ranked(held: tuple[np.ndarray, np.ndarray, np.ndarray], task_id: str, item_id: str) -> pa.RecordBatch:
    ids, rows, scores = held
    columns = [np.repeat(ids, scores.shape[1]), rows.ravel(), scores.ravel()]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[task_id, item_id, "score"])


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a row without length stays 0, so its cosine is 0."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
