import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import simhash_segments as S
from curatrix.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, node string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def near_copies(seed=5, groups=6, each=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.choice((40, 300)))
        for _ in range(each):
            text = list(base)
            for _ in range(r.randrange(4)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append(" ".join(text))
    r.shuffle(rows)
    return list(enumerate(rows)) + [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "one two"), (906, rows[0])]


@pytest.mark.parametrize("text", [None, "", "A b", "a B c", "É x y z É x y z", "the the the the"])
def test_fingerprint(text):
    made = S.fingerprint((text or "").encode())[0] % 2**64
    assert made == brute.simhash(text)


@pytest.mark.parametrize(("distance", "n", "block"), [(3, 1, 4096), (3, 1, 3), (5, 1, 16), (4, 2, 5), (0, 1, 4096)])
def test_equals_loops(spark, monkeypatch, distance, n, block):
    monkeypatch.setattr(S.links, "__defaults__", (3, block))
    rows = near_copies()
    made = S.simhash_components(frame(spark, rows), "doc_id", "text", distance=distance, n=n).collect()
    assert len(made) == len(rows)
    texts = dict(rows)
    ids = [r["doc_id"] for r in made]
    fps = [S.fingerprint((texts[i] or "").encode(), n=n) for i in ids]
    assert [r["fp"] for r in made] == [f[0] for f in fps]
    assert [r["component_id"] for r in made] == brute.components(fps, ids, distance)


def test_manhattan_is_a_lower_bound():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 2000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << r.integers(0, 64, 2000, dtype=np.uint64))

    def counts(x):
        return np.stack([np.bitwise_count(x >> np.uint64(2 * k) & np.uint64(3)) for k in range(32)]).astype(int)

    assert (np.abs(counts(a) - counts(b)).sum(axis=0) <= np.bitwise_count(a ^ b)).all()


def test_embedding_is_the_counts_per_segment(spark):
    values = [0, -1, 1, 2**63 - 1, -(2**63), 0x123456789ABCDEF]
    rows = spark.createDataFrame([(v,) for v in values], "fp long").select("fp", S.embedding(F.col("fp")).alias("e")).collect()
    for row in rows:
        bits, packed = row["fp"] % 2**64, row["e"] % 2**64
        assert [packed >> 2 * k & 3 for k in range(32)] == [(bits >> 2 * k & 3).bit_count() for k in range(32)]


def test_one_of_each_and_repeated_rows(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "lone words of a text"), (9, None), (8, "")]
    kept = S.one_of_each(frame(spark, rows), "doc_id", "text")
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, "a b c d e"), (None, "lone words of a text"), (8, "")], key=str)


def test_empty_table(spark):
    assert S.simhash_components(frame(spark, []), "doc_id", "text").count() == 0
    assert S.one_of_each(frame(spark, []), "doc_id", "text").count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    random.Random(2).shuffle(chain)
    edges = spark.createDataFrame([*chain, *star, (7, 7), (200, 199), (199, 200)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 199: 199, 200: 199}
