"""Term coverage by blocks: nothing of it depends on how rows fall into blocks, and no pair is shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from curatrix.functions.text import text_relevance
from curatrix.operators import ranking, rows, scoring


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd_1") for _ in range(rng.choice([2, 3, 5, 8, 14]))) for _ in range(80)]
    tasks = [(i, " ".join(rng.choice(words) for _ in range(8))) for i in range(30)] + [(30, None), (31, "of")]
    items = [(i, rng.choice([" ", "-", "\n", "É"]).join(rng.choice(words) for _ in range(rng.choice([0, 3, 40])))) for i in range(200)]
    items += [(200, None), (201, words[3] * 300)]
    return (
        spark.createDataFrame(tasks, "task_id bigint, task string"),
        spark.createDataFrame(items, "item bigint, text string").repartition(3),
    )


def plain(tasks, items):
    pairs = tasks.crossJoin(items).select("task_id", "item", text_relevance(F.col("task"), F.col("text")).alias("s"))
    return {(r.task_id, r.item): r.s for r in pairs.collect() if r.s > 0}


def scores(rows):
    got = [(r.task_id, r.item, r.score) for r in rows.collect()]
    assert len(got) == len({g[:2] for g in got})
    return {g[:2]: g[2] for g in got}


def test_blocks_of_any_size(tables, monkeypatch):
    tasks, items = tables
    want = plain(tasks, items)
    for units, rows, cells in ((256, 1024, 1 << 22), (7, 5, 40), (1, 1, 1)):
        monkeypatch.setattr(scoring, "UNITS_PER_BLOCK", units)
        monkeypatch.setattr(scoring, "ITEMS_PER_BLOCK", rows)
        monkeypatch.setattr(scoring, "CELLS", cells)
        assert scores(scoring.term_coverage(tasks, items, ["item"])) == want


def test_best_keeps_every_tie_of_the_top_k(tables):
    tasks, items = tables

    def top(rows):
        return sorted((r.task_id, r["rank"], r.item) for r in ranking.top_k(rows, 4, ties=["item"]).collect())

    for floor in (None, 0.3):
        whole = scoring.term_coverage(tasks, items, ["item"], at_least=floor)
        cut = scoring.term_coverage(tasks, items, ["item"], at_least=floor, best=4)
        assert top(cut) == top(whole) and cut.count() < whole.count()


def test_repeated_and_null_keys(spark):
    tasks = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "task_id bigint, task string")
    items = spark.createDataFrame(
        [(1, "alpha"), (1, "beta"), (2, "alp"), (2, "ha"), (None, "gamma"), (None, "beta")], "item bigint, text string"
    )
    assert scores(scoring.term_coverage(tasks, items, ["item"])) == {(1, 1): 1.0, (1, None): 0.5, (2, None): 1.0}
    assert scores(scoring.term_coverage(tasks, items, ["item"], at_least=0.5)) == {(1, 1): 1.0}


@pytest.mark.parametrize("floor", [None, 0.3])
def test_no_pair_is_shuffled(tables, floor):
    """Pairs of a task and an item number many times the rows; none is dealt out by its keys."""
    tasks, items = tables
    plan = scoring.term_coverage(tasks, items, ["item"], at_least=floor)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*\bitem#", plan)


def test_few_rows_are_not_shuffled_with_many(spark, monkeypatch):
    many = spark.range(1000).selectExpr("id", "repeat('x', 99) AS text").repartition(3)
    asked = spark.createDataFrame([(3,), (3,), (5,)], "id bigint").repartition(2)

    def plan(side):
        joined = many.join(side, "id")
        assert sorted(r.id for r in joined.collect()) == [3, 3, 5]
        return joined._jdf.queryExecution().analyzed().toString()

    assert "strategy=broadcast" in plan(rows.few(asked))
    monkeypatch.setattr(rows, "FEW", 2)
    assert "strategy=broadcast" not in plan(rows.few(asked))
