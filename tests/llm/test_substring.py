import random

import brute
import numpy as np
import pytest

from curatrix.llm import substring_dedup as D

SCHEMA = "doc_id long, text string, row string, key string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "k", 1) for i, t in rows], SCHEMA)


def passages(seed, n=60):
    r = random.Random(seed)
    shared = [" ".join(r.choices("abcdefgh", k=r.randrange(15, 60))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(f"u{r.randrange(3000)}" for _ in range(r.randrange(0, 30))), r.choice(shared), r.choice(["", "\n", "\t x "]), r.choice(["ha " * r.randrange(50), ""])]
        r.shuffle(parts)
        rows.append((i * 7 % n, " ".join(parts)))
    return rows + [(500, None), (501, ""), (502, "short text"), (503, rows[0][1]), (504, "Été " * 25)]


@pytest.mark.parametrize(("length", "period", "cover"), [(20, 13, (0, 1, 3, 9)), (9, 7, (1, 2, 4))])
def test_equals_loops(spark, length, period, cover):
    for batch in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            rows = passages(length + period)
            made = D.remove_repeats(frame(spark, rows).repartition(3), "doc_id", "text", length, period, cover).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        stay = brute.repeats(rows, length)
        assert {r["doc_id"]: r["kept_text"] for r in made} == {i: " ".join(w) for i, w in stay.items()}
        for r in made:
            assert r["n_words"] - r["n_removed"] == len(stay[r["doc_id"]])
            assert r["n_words"] == len(brute.words(dict(rows)[r["doc_id"]]))


def test_any_two_places_share_an_offset():
    for i in range(13):
        for j in range(13):
            assert any((i + d) % 13 in D.COVER and (j + d) % 13 in D.COVER for d in range(13))
    with pytest.raises(ValueError, match="cover"):
        D.check_cover(13, (0, 1, 3), 20)
    with pytest.raises(ValueError, match="anchor"):
        D.check_cover(13, D.COVER, 12)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (4, text), (None, text), (7, text + " more"), (8, "x " + text)]
    made = D.remove_repeats(frame(spark, rows), "doc_id", "text").collect()
    assert sorted(((r["doc_id"], r["kept_text"]) for r in made), key=str) == sorted(
        [(4, text), (4, text), (None, ""), (7, "more"), (8, "x")], key=str
    )


def test_starts_of_windows_that_hold_an_anchor():
    for places in ([0], [5, 25], [3, 4, 30]):
        found = D._starts(np.array(places), 40, 20, 13)
        assert found.tolist() == [s for s in range(21) if any(s <= p < s + 13 for p in places)]


def test_empty_table(spark):
    assert D.remove_repeats(frame(spark, []), "doc_id", "text").count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i % 30011}" for i in range(60000))
    made = D.remove_repeats(frame(spark, [(1, text)]), "doc_id", "text").first()
    assert (made["n_words"], made["n_removed"]) == (60000, 60000 - 30011)
