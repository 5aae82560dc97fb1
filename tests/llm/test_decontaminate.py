import random

import brute
import pytest

from curatrix.llm import decontaminate as D

SCHEMA = "doc_id long, text string, row string, w string, item string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "w", "i") for i, t in rows], SCHEMA)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def case(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choices("abcdefghij", k=r.choice((2, 5, 13, 14, 30))))) for i in range(8)]
    items += [(50, None), (51, "..."), (52, items[0][1].upper()), (53, "É À"), (54, items[3][1])]
    docs = []
    for i in range(40):
        parts = [" ".join(r.choices("abcdefghijxyz", k=r.randrange(60)))]
        for _ in range(r.randrange(3)):
            parts.append(str(r.choice(items)[1]).title() + r.choice([".", " ", "--"]))
        r.shuffle(parts)
        docs.append((i, " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "é à É À"), (103, "?!")], items


@pytest.mark.parametrize("small", [D.BROADCAST_SHINGLES, 0])
def test_equals_loops(spark, monkeypatch, small):
    monkeypatch.setattr(D.contained_windows, "__defaults__", (small,))
    for seed in (1, 2):
        docs, items = case(seed)
        made = D.decontaminate(frame(spark, docs), "doc_id", "text", items_of(spark, items), "item_id", "text").collect()
        want = brute.contamination(docs, items)
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in made} == want
        for r in made:
            n, hit, _ = want[r["doc_id"]]
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_repeated_rows_and_null_ids(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = [(1, passage), (1, passage), (1, "clean text"), (None, passage + " and " + passage)]
    items = items_of(spark, [(3, passage)])
    made = D.decontaminate(frame(spark, docs), "doc_id", "text", items, "item_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in made) == [("1", 2, 0), ("1", 13, 13), ("1", 13, 13), ("None", 27, 26)]
    kept = D.drop_contaminated(frame(spark, docs), "doc_id", "text", items, "item_id", "text")
    assert [tuple(r) for r in kept.collect()] == [(1, "clean text", "r", "w", "i")]


def test_empty_tables(spark):
    docs, items = case(3)
    none = items_of(spark, [])
    made = D.decontaminate(frame(spark, docs), "doc_id", "text", none, "item_id", "text").collect()
    assert len(made) == len(docs) and not any(r["contaminated"] for r in made)
    assert D.decontaminate(frame(spark, []), "doc_id", "text", items_of(spark, items), "item_id", "text").count() == 0


def test_no_python_and_no_pairing(spark):
    docs, items = case(4)
    plan = D.decontaminate(frame(spark, docs), "doc_id", "text", items_of(spark, items), "item_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
