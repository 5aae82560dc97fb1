"""Language identification: its parts beside plain loops, and held-out accuracy."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from curatrix.llm import language_id as L
from curatrix.llm import queries
from curatrix.llm.common import read_table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")


def slot(points, bits):
    gram = 0
    for p in points:
        gram = gram << 21 | p
    mask = 2**64 - 1
    x = (gram + len(points)) * 0x9E3779B97F4A7C15 & mask
    return ((x ^ x >> 31) * 0xC2B2AE3D27D4EB4F & mask) >> 64 - bits


@pytest.mark.parametrize("at_once", [3, 7, 1 << 20])
def test_counts_equal_loops(monkeypatch, at_once):
    monkeypatch.setattr(L, "LETTERS_AT_ONCE", at_once)
    for text in ("", "a", "Ab", "Straße über ÉÉ 漢字 🙂 x", "abcabcabc" * 5):
        lower = text.lower()
        want = Counter(slot([ord(c) for c in lower[i : i + n]], 12) for n in (1, 2, 3) for i in range(len(lower) - n + 1))
        slots, counts = L.term_counts(text, 12, 3)
        assert dict(zip(slots.tolist(), counts.tolist(), strict=True)) == dict(want)


def test_leader_equals_scalar_updates():
    r = random.Random(4)
    s = L.Settings(bits=3, alpha=0.3, l1=0.05, l2=0.4)
    made = L.Leader(8, 3, s)
    z, n = [[0.0] * 3 for _ in range(8)], [[0.0] * 3 for _ in range(8)]

    def weight(i, k):
        if abs(z[i][k]) <= s.l1:
            return 0.0
        return -(z[i][k] - math.copysign(s.l1, z[i][k])) / ((s.beta + math.sqrt(n[i][k])) / s.alpha + s.l2)

    for _ in range(60):
        slots, label = sorted(r.sample(range(8), 3)), r.randrange(3)
        values = [r.uniform(0.1, 1) for _ in slots]
        made.learn(np.array(slots), np.array(values), label)
        w = [[weight(i, k) for k in range(3)] for i in slots]
        x = [sum(v * row[k] for v, row in zip(values, w, strict=True)) for k in range(3)]
        total = sum(map(math.exp, x))
        for j, i in enumerate(slots):
            for k in range(3):
                g = values[j] * (math.exp(x[k]) / total - (k == label))
                z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / s.alpha * w[j][k]
                n[i][k] += g * g
    assert np.allclose(made.z, z) and np.allclose(made.n, n)
    want = np.array([[weight(i, k) for k in range(3)] for i in range(8)])
    assert np.allclose(made.weights(np.arange(8)), want)


def test_temperature_is_the_likeliest():
    r = np.random.default_rng(1)
    true = r.normal(0, 1.5, (4000, 3))
    p = np.exp(true) / np.exp(true).sum(axis=1, keepdims=True)
    labels = np.array([r.choice(3, p=x) for x in p])
    assert abs(L.temperature(true * 5, labels) - 5) < 0.5
    assert 0.02 < L.temperature(np.eye(3)[labels], labels) < 1  # all right: confident, but bounded


def trained(spark, table_rows, **how):
    table = spark.createDataFrame(table_rows, "doc_id long, text string, lang string")
    return L.train(table, "text", "lang", L.Settings(bits=10, **how))


def test_odd_rows(spark):
    rows = [(i, "the of and that " * 3, "en") for i in range(20)] + [(30 + i, "der die das und ", "de") for i in range(5)] + [(50, None, "fr"), (51, "le la les", None)]
    model = trained(spark, rows)
    assert model.langs == ("de", "en")
    odd = [(1, None, "x"), (2, "", "x"), (3, "12 34 !? ٣ ²_", "x"), (4, "the and of", "x"), (4, "the and of", "x"), (None, "das und die " * 100_000, None), (6, "1" * 500_000 + "é", "x")]
    table = spark.createDataFrame(odd, "score long, text string, lang_pred string")
    made = L.predict(table, "text", model, "lang_pred", "score")
    assert made.columns == ["text", "lang_pred", "score"]
    got = [(r["lang_pred"], r["score"]) for r in made.collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3] == got[4] and got[3][0] == "en" and got[5][0] == "de" and got[6][0] in ("de", "en")
    assert all(0 <= p <= 1 for _, p in got)
    assert L.predict(table.limit(0), "text", model).count() == 0
    none = trained(spark, [])
    assert [tuple(r)[-2:] for r in L.predict(table.select("text"), "text", none).collect()] == [("und", 0.0)] * 7
    one = trained(spark, rows[:3])
    assert {r["lang_pred"] for r in L.predict(table.select("text"), "text", one).collect()} == {"und", "en"}


def test_the_fit_is_bounded_and_balanced(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(["the", "of", "thing", "other"], k=9)), "en") for i in range(400)] + [(500 + i, " ".join(r.choices(["und", "der", "ding"], k=9)), "de") for i in range(40)]
    rows += rows[:200]
    model = trained(spark, rows, rows=60)
    made = L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", model).collect()
    assert all(x["lang"] == x["lang_pred"] for x in made)


def test_frequencies_cover_all_rows(spark):
    rows = [(i, f"text {i % 7} é", "en") for i in range(50)] + [(99, None, "en")]
    s = L.Settings(bits=12)
    n, found = L.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", s)
    want = Counter(x for _, t, _ in rows if t for x in L.term_counts(t, 12, 3)[0].tolist())
    assert n == 50 and {i: c for i, c in enumerate(found.tolist()) if c} == dict(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op13_language_id"](spark, SF).collect()}
    docs = {r["doc_id"]: r for r in read_table(spark, SF, "documents").collect()}
    assert set(rows) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    judged = [rows[i]["lang_pred"] == d["lang"] for i, d in docs.items() if rows[i]["held_out"] and d["lang"] and L.has_letter(d["text"])]
    assert len(judged) > 100 and np.mean(judged) >= 0.98
