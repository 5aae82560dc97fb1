"""Registered queries beside their SQL or plain loops, and the pipeline stage by stage."""

import os
import zlib

import brute
import numpy as np
import oracle
import pytest

import corpus_pipeline
from curatrix.llm import crf_lines, nbsvm, queries, simhash_segments
from curatrix.llm.common import read_table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
needs_model = pytest.mark.skipif(not os.path.exists(queries.SENTENCEPIECE_MODEL), reason="the public model file is not here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in read_table(spark, SF, "documents").collect()}


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    got = oracle._canonical(frame.columns, [tuple(r) for r in frame.collect()])
    made = oracle.connect(SF).execute(queries.ORACLE_SQL[name])
    assert got == oracle._canonical([d[0] for d in made.description], made.fetchall())


@needs_model
def test_codec(spark, texts):
    import sentencepiece

    peer = sentencepiece.SentencePieceProcessor(model_file=queries.SENTENCEPIECE_MODEL)
    rows = queries.QUERIES["op1_sentencepiece"](spark, SF).collect()
    assert {r["doc_id"]: r["token_ids"] for r in rows} == {i: peer.encode(t or "") for i, t in texts.items()}
    assert all(r["lossless"] and r["parity"] for r in rows)


def test_quality_scores(spark):
    sf = SF.replace("sf0.001", "sf0.01") if os.path.isdir(SF.replace("sf0.001", "sf0.01")) else SF
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_nbsvm"](spark, sf).collect()}
    labels = read_table(spark, sf, "labels").collect()
    assert len(rows) == read_table(spark, sf, "documents").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    right = [rows[x["doc_id"]]["predicted"] == x["quality"] for x in labels if rows[x["doc_id"]]["held_out"]]
    assert np.mean(right) >= 0.93


def test_quality_rules(spark, texts):
    rows = queries.QUERIES["op5_crf_lines"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        words = brute.words(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_repeat_words"] == crf_lines.repeated_words([w.encode() for w in words])
    labels = {x["doc_id"]: x["quality"] for x in read_table(spark, SF, "labels").collect()}
    judged = [(r["kept"], labels[r["doc_id"]] == 1) for r in rows if r["doc_id"] in labels and r["n_words"] >= 20]
    assert np.mean([a == b for a, b in judged]) >= 0.93


def test_fingerprints_and_groups(spark, texts):
    rows = queries.QUERIES["op8_simhash_segments"](spark, SF).collect()
    ids = [r["doc_id"] for r in rows]
    some = [r for r in rows if len(texts[r["doc_id"]]) < 1500]
    assert all(int(r["fingerprint"], 16) == brute.simhash(texts[r["doc_id"]]) for r in some)
    signed = [[(int(r["fingerprint"], 16) ^ 2**63) - 2**63] for r in rows]
    assert [r["component_id"] for r in rows] == brute.components(signed, ids, 3)


def test_personal_data(spark, texts):
    rows = queries.QUERIES["op9_pii_bootstrap"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        base = brute.personal(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in base))
        assert [r[f"n_{k}"] for k in queries.BASE_PERSONAL] == [sum(x[2] == k for x in base) for k in queries.BASE_PERSONAL]
        assert {f"{k}:{a}:{b}" for a, _, k, b in base} <= set(r["spans"].split(","))


@needs_model
def test_pipeline_equals_loops(spark, texts):
    docs = read_table(spark, SF, "documents")
    model = nbsvm.train(docs, read_table(spark, SF, "labels"), "doc_id", "text", "quality")
    ratio, weights = (np.frombuffer(x, np.float32).astype(float) for x in (model.ratio, model.weights))

    def odds(text):
        return nbsvm.log_odds(nbsvm.indicators(text.encode(), model.bits), ratio, weights, model.offset, model.floor)

    left = {i: t for i, t in texts.items() if 1 / (1 + np.exp(-odds(t))) >= 0.7}
    near = corpus_pipeline.NEAR
    ids = sorted(left)
    fps = [simhash_segments.fingerprint(left[i].encode(), near["shingle"]) for i in ids]
    left = {i: left[i] for i, c in zip(ids, brute.components(fps, ids, near["distance"]), strict=True) if i == c}
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    found = brute.contamination(list(left.items()), items)
    left = {i: t for i, t in left.items() if not (found[i][1] and 20 * found[i][1] >= found[i][0])}
    want = {i: brute.redacted(t, brute.personal(t)) for i, t in left.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want
    assert all(r["lossless"] and r["parity"] and r["n_chars"] == len(r["text"]) for r in rows)


def test_stages_keep_the_columns(spark):
    rows = [(1, None, None, None, None, "a", 0.1), (2, "", "en", "s", 0, "b", None), (2, "", "en", "s", 0, "b", None), (None, "word " * 30, "en", "s", 150, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            made = stage(spark, table, SF)
            assert made.columns == docs.columns, name
            assert made.count() <= table.count()


@needs_model
def test_the_last_stage_keeps_rows_and_replaces_its_own_columns(spark):
    docs = spark.createDataFrame([(1, None, "a", "x"), (2, "", "b", None), (2, "", "b", None), (None, "Word. " * 30, None, "y")], "doc_id long, text string, lang string, token_ids string")
    for table in (docs, docs.limit(0)):
        made = corpus_pipeline.STAGES[-1][1](spark, table, SF)
        assert made.columns[:3] == ["doc_id", "text", "lang"] and dict(made.dtypes)["token_ids"] == "array<int>"
        assert made.count() == table.count()
        assert all(r["lossless"] and r["parity"] for r in made.collect())
