import itertools
import random

import brute
import numpy as np
import pytest

from curatrix.llm import crf_lines, nbsvm

GOOD, BAD = "the of and in on at", "BUY!! NOW!! | ### $$$"


def corpus(n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        lines = []
        for _ in range(r.randrange(1, 8)):
            body = [f"{r.choice('klmn')}{r.choice('aeiou')}{r.choice('prst')}{r.choice('aeiou')}" for _ in range(r.randrange(6, 30))]
            lines.append(" ".join(body).capitalize() + "." if good else " | ".join(w + r.choice(["###", "$$$"]) for w in body).upper())
        docs.append((i, "\n".join(lines), "x", 0.5))
        labels.append((i, int(good), 0))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, label string, score double", "doc_id long, quality int, toxic int"


def test_nbsvm_on_rows_it_has_not_seen(spark):
    docs, labels = corpus(400, 1)
    held = {i for i, *_ in docs if i % 4 == 2}
    frame = spark.createDataFrame(docs, DOCS)
    model = nbsvm.train(frame, spark.createDataFrame([x for x in labels if x[0] not in held], LABELS), "doc_id", "text", "quality")
    made = {r["doc_id"]: r["score"] for r in nbsvm.score(frame, "text", model, "made").select("doc_id", "made").withColumnRenamed("made", "score").collect()}
    right = [(made[i] >= 0.7) == bool(q) for i, q, _ in labels if i in held]
    assert np.mean(right) > 0.97
    assert all(0 <= s <= 1 for s in made.values())


def test_nbsvm_edges(spark):
    docs, labels = corpus(60, 2)
    frame = spark.createDataFrame([*docs, (900, None, None, None), (901, "", None, None), (902, docs[0][1], None, None), (None, "x " * 50000, None, None)], DOCS)
    lab = spark.createDataFrame([*labels, (3, None, None), (None, 1, 0), (12345, 1, 0)], LABELS)
    model = nbsvm.train(frame, lab, "doc_id", "text", "quality")
    made = nbsvm.score(frame, "text", model)
    assert made.columns == ["doc_id", "text", "label", "score"]
    by_id = {r["doc_id"]: r["score"] for r in made.collect()}
    assert len(by_id) == 64 and by_id[900] == by_id[901] and by_id[902] == by_id[0]
    one = nbsvm.train(frame, lab.filter("quality = 1"), "doc_id", "text", "quality")
    assert {round(r["score"], 4) for r in nbsvm.score(frame, "text", one).collect()} == {1.0}
    none = nbsvm.train(frame, lab.limit(0), "doc_id", "text", "quality")
    assert {r["score"] for r in nbsvm.score(frame, "text", none).collect()} == {0.5}
    assert nbsvm.score(frame.limit(0), "text", model).count() == 0
    lost = nbsvm.train(frame.limit(0), lab, "doc_id", "text", "quality")
    assert len({r["score"] for r in nbsvm.score(frame, "text", lost).collect()}) == 1


def test_descent_reaches_the_dual_optimum():
    r = np.random.default_rng(3)
    rows = [np.flatnonzero(r.random(12) < 0.4) for _ in range(60)]
    values = r.normal(size=12)
    y = np.where(np.array([values[i].sum() for i in rows]) + r.normal(size=60) * 0.3 > 0, 1, -1)
    w = nbsvm.descend(rows, values, y, 1.0, 400, 0.01)
    x = np.zeros((60, 12))
    for k, i in enumerate(rows):
        x[k, i] = nbsvm.scaled_row(i, values, 0.01)

    def loss(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()

    assert all(loss(w) <= loss(w + r.normal(size=12) * s) + 2e-2 for s in (0.01, 0.1, 0.5) for _ in range(40))


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(4)
    lengths = np.array([3, 0, 1, 7, 4])
    e, moves = r.normal(size=(lengths.sum(), 2)), r.normal(size=(2, 2))
    states, at = crf_lines.viterbi(e, lengths, moves), 0
    for n in lengths:
        part = e[at : at + n]
        best = max(itertools.product((0, 1), repeat=int(n)), key=lambda p: sum(part[i, s] for i, s in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)), default=())
        assert tuple(states[at : at + n]) == best
        at += n


def test_fit_separates():
    x = np.eye(len(crf_lines.FEATURES))[[0, 3, 3, 0, 3, 0, 0, 3]]
    w, moves = crf_lines.fit(x, np.array([2, 4, 2]), np.array([0, 1, 1, 0, 1, 0, 0, 1]), crf_lines.Settings())
    assert w[0, 0] > w[0, 1] and w[3, 1] > w[3, 0] and moves.shape == (2, 2)


def repeated(w, size=8):
    windows = {}
    for s in range(len(w) - size + 1):
        windows.setdefault(tuple(w[s : s + size]), []).append(s)
    return len({k for places in windows.values() if len(places) > 1 for s in places for k in range(s, s + size)})


def counts(text):
    w, seen, dup = brute.words(text), set(), 0
    for line in (text or "").split("\n"):
        if brute.words(line):
            dup += line in seen
            seen.add(line)
    joined = "".join(w)
    return len(w), len(joined), sum(c in "#*$%&|<>" for c in joined), dup, repeated(w)


@pytest.mark.parametrize("fitted", [True, False])
def test_quality_rules(spark, fitted):
    docs, labels = corpus(200, 5)
    r = random.Random(6)
    docs += [(500 + i, " ".join(r.choices("abcd", k=r.randrange(200))) + "\n" + "É # x\n" * r.randrange(4), None, None) for i in range(30)]
    docs += [(800, None, None, None), (801, "", None, None), (802, "\n \n", None, None), (803, docs[0][1], None, None), (804, "w " * 30000, None, None), (None, "Some words.", None, None)]
    frame = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame(labels if fitted else [], LABELS)
    model = crf_lines.train(frame, lab, "doc_id", "text", "quality")
    assert (model == crf_lines.Model()) != fitted
    texts = {i: t for i, t, *_ in docs}
    made = crf_lines.judge(frame, "doc_id", "text", model).collect()
    assert len(made) == len(docs)
    for row in made:
        got = tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        want = counts(texts[row["doc_id"]])
        assert got == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert row["kept"] == (not row["base_failed"] and row["content_share"] >= 0.5)
    good = {i: bool(q) for i, q, _ in labels}
    passing = [r_ for r_ in made if r_["doc_id"] in good and not r_["base_failed"]]
    assert np.mean([r_["kept"] == good[r_["doc_id"]] for r_ in passing]) > 0.97
    assert crf_lines.judge(frame.limit(0), "doc_id", "text", model).count() == 0
