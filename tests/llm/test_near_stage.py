"""The pipeline's near-duplicate stage beside plain loops over fingerprints."""

import random

import brute

import corpus_pipeline


def test_one_of_each_group_stays(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)] + ["!!", "A,"]
    texts = []
    for _ in range(25):  # copies with up to three words changed
        base = r.choices(vocabulary, k=400)
        copy = list(base)
        for at in r.sample(range(400), r.randrange(4)):
            copy[at] = "changed"
        texts += [" ".join(base), " ".join(copy), " ".join(base).upper()]
    passage = r.choices(vocabulary, k=90)  # a family that shares three quarters of its words
    texts += [" ".join(passage + r.choices(vocabulary, k=30)) for _ in range(40)]
    texts += [None, "", "lone", "one two", "!!! ???", "$$ %%", texts[0]]
    r.shuffle(texts)
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(None, "no id but a text of its own", "a"), (None, texts[0], "b"), (3, texts[3], "z"), (3, texts[3], "a"), (4, "an id twice", "q")]
    fps = [[(brute.simhash(t) ^ 2**63) - 2**63] for _, t, _ in rows]
    groups = {}
    for n, c in enumerate(brute.components(fps, list(range(len(rows))), 3)):
        groups.setdefault(c, []).append(rows[n])
    first = lambda x: (x[0] is None, x[0] or 0)
    kept = [min(g, key=first)[:2] for g in groups.values()]
    made = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted(((x["doc_id"], x["text"]) for x in made), key=str) == sorted(kept, key=str)
    if (3, texts[3]) in kept:
        assert [x["source"] for x in made if x["doc_id"] == 3 and x["text"] == texts[3]] == [min("a", "z", "s3")]


def test_nothing_in_nothing_out(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, root string, row string, first string")
    made = corpus_pipeline.near_duplicates(spark, docs, "")
    assert made.columns == docs.columns and made.count() == 0
    one = spark.createDataFrame([(1, "a b", "x", "y", "z")], docs.schema)
    assert [tuple(r) for r in corpus_pipeline.near_duplicates(spark, one, "").collect()] == [(1, "a b", "x", "y", "z")]
