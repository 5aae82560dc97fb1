import random

import pytest
from pyspark.sql import functions as F

from curatrix.functions import lexical as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def windows(needle, hay):
    n = len(needle)
    return max(ratio(needle, hay[max(0, e - n) : e]) for e in range(1, len(hay) + n))


def partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    best = windows(a, b)
    return max(best, windows(b, a)) if len(a) == len(b) else best


def test_pruned_windows_find_the_best_window():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12)))
        b = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 25)))
        assert L.indel_ratio(a, b) == pytest.approx(ratio(a, b))
        assert L.partial_ratio(a, b) == pytest.approx(partial(a, b))


def test_token_set():
    assert L.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert L.token_set_ratio("a b", "a b c") == 1.0
    assert L.token_set_ratio("", "a") == 0.0
    assert L.token_set_ratio("abc x", "abc y") == pytest.approx(2 * 4 / 10)
    assert 0 < L.token_set_ratio("abc", "abd") < 1


def test_on_a_table(spark):
    df = spark.createDataFrame([("read csv", "how to read csv files"), ("x", None)], "a string, b string")
    got = [r.s for r in df.select(L.lexical_score(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [1.0, 0.0]


def test_few_windows_are_aligned(monkeypatch):
    """Prose against prose: every window shares most characters, but few can beat the best."""
    rng = random.Random(5)
    words = ["value", "system", "number", "water", "people", "order", "state", "under"]
    task, title = (" ".join(rng.choice(words) for _ in range(n)) for n in (30, 200))
    want, calls, plain = windows(task, title), [], L._lcs
    monkeypatch.setattr(L, "_lcs", lambda *a: calls.append(1) or plain(*a))
    assert L.partial_ratio(task, title) == pytest.approx(want)
    assert len(calls) < (len(title) - len(task)) / 4
