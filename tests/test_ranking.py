import random

import numpy as np
from pyspark.sql import functions as F

from curatrix.functions.text import text_relevance
from curatrix.operators import filters, ranking, scoring


def test_select_urls_equals_the_greedy_loop(spark):
    rng = random.Random(2)
    rows, tasks, want = [], [], {}
    for task in range(12):
        wanted = rng.choice([3, 5, 20])
        tasks.append((task, wanted))
        hits = []
        for seq in range(rng.randrange(1, 80)):
            url = f"https://www.site{rng.randrange(6)}.org/{rng.randrange(30)}"
            hits.append((task, seq, url, float(rng.randrange(8))))
        rows += hits
        best = {}
        for _, _, url, score in hits:
            best[url] = max(score, best.get(url, -1.0))
        chosen, domains = [], {}
        for url in sorted(best, key=lambda u: -best[u])[: 2 * wanted]:
            domain = url.split("/")[2]
            if domains.get(domain, 0) < 3 and len(chosen) < wanted:
                chosen.append(url)
                domains[domain] = domains.get(domain, 0) + 1
        want[task] = chosen
    scored = spark.createDataFrame(rows, "task_id bigint, seq bigint, url string, score double")
    limits = spark.createDataFrame(tasks, "task_id bigint, max_sources int")
    got = {t: [] for t in want}
    for r in ranking.select_urls(scored, limits).orderBy("task_id", "place").collect():
        got[r.task_id].append(r.url)
    assert got == want


def test_merge_hits_first_of_equals_wins(spark):
    rows = [(1, 0, "u", "old", 1.0), (1, 1, "v", "v", 2.0), (1, 2, "u", "new", 3.0), (1, 3, "u", "late", 3.0)]
    hits = spark.createDataFrame(rows, "task_id bigint, seq bigint, url string, title string, score double")
    got = {r.url: (r.seq, r.title, r.score) for r in ranking.merge_hits(hits).collect()}
    assert got == {"u": (0, "new", 3.0), "v": (1, "v", 2.0)}


def test_coverage_under_a_floor(spark):
    """Equal to the plain filter, ties with the floor included, from far fewer pairs."""
    rng = random.Random(9)
    rare = [f"rare{i:03d}" for i in range(400)]  # none inside another
    common = ["system", "value", "number"]
    tasks = [(i, " ".join([*common, *rng.sample(rare, 5), rare[i], rare[i]])) for i in range(40)] + [(40, "a of"), (41, None), (42, "absent words only")]
    items = [(i, " ".join([*common, *rng.sample(rare, 6)])) for i in range(300)] + [(300 + i, tasks[i][1]) for i in range(20)]
    items += [(400, None), (401, ""), (402, "system " * 3000)]
    t = spark.createDataFrame(tasks, "task_id bigint, task string")
    d = spark.createDataFrame(items, "item bigint, text string")
    plain = {(r.task_id, r.item): r.score for r in scoring.term_coverage(t, d, ["item"]).collect()}
    for floor in (0.0, 0.1, 0.3, 0.4, 0.5, 0.6, 1.0, 1.1):
        got = scoring.term_coverage(t, d, ["item"], at_least=floor).collect()
        assert {(r.task_id, r.item): r.score for r in got} == {k: v for k, v in plain.items() if v >= floor}
        assert len(got) == len({(r.task_id, r.item) for r in got})
    terms = scoring.task_term_table(t)
    found = scoring.item_terms(d, terms, ["item"], "text")
    leading = scoring.leading_terms(found, terms, "task_id", 0.5)
    pairs = scoring.candidate_pairs(found, leading, ["item"], "task_id").count()
    assert len(plain) > 40 * 300 and pairs < len(plain) / 5
    empty = scoring.term_coverage(t, d.limit(0), ["item"], at_least=0.5)
    assert empty.count() == 0 and scoring.term_coverage(t.limit(0), d, ["item"], at_least=0.5).count() == 0


def test_term_coverage_equals_substring_search(spark):
    rng = random.Random(4)
    alphabet = "abc_9"
    vocabulary = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 4, 7, 13, 30]))) for _ in range(60)]
    tasks = [(i, " ".join(rng.choice(vocabulary) for _ in range(9)) + " the") for i in range(15)]
    items = [(i, "".join(rng.choice(vocabulary + [" ", "-", "É"]) for _ in range(rng.choice([0, 5, 60])))) for i in range(60)]
    t = spark.createDataFrame(tasks, "task_id bigint, task string")
    d = spark.createDataFrame(items, "item bigint, text string")
    joined = {(r.task_id, r.item): r.score for r in scoring.term_coverage(t, d, ["item"]).collect()}
    pairs = t.crossJoin(d).select("task_id", "item", text_relevance(F.col("task"), F.col("text")).alias("s"))
    plain = {(r.task_id, r.item): r.s for r in pairs.collect() if r.s > 0}
    for task_id, task in tasks:
        terms = [w for w in task.replace("-", " ").split() if len(w) > 2 and w != "the"]
        for item, text in items:
            share = sum(w in text.lower() for w in terms) / len(terms) if terms else 0.0
            assert abs(plain.get((task_id, item), 0.0) - share) < 1e-12
    assert joined.keys() == plain.keys()
    assert all(abs(joined[k] - plain[k]) < 1e-12 for k in plain)


def test_vector_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(200, [0.0] * 8)]
    items = spark.createDataFrame(rows, "item_id bigint, embedding array<float>")
    tasks = items.filter("item_id < 9").select(F.col("item_id").alias("task_id"), "embedding")

    def best():
        scored = scoring.vector_scores(tasks, items, 5)
        return sorted((r.task_id, r.rank, r.item_id) for r in ranking.top_k(scored, 5, ties=["item_id"]).collect())

    whole = best()
    monkeypatch.setattr(scoring, "ROWS_PER_BLOCK", 7)
    assert best() == whole
    assert [x for x in whole if x[0] == 3][0] == (3, 1, 3)


def test_prune_and_buckets_at_the_marks(spark):
    rows = [(1, s) for s in (0.6, 0.40, 0.3999, 0.33, 0.3299)] + [(2, s) for s in (0.25, 0.2499, 0.18, 0.17)]
    scored = spark.createDataFrame(rows, "task_id bigint, score double")
    pruned = filters.relative_prune(scored, 0.18, 0.55)
    got = sorted((r.task_id, r.score, r.bucket) for r in filters.bucketize(pruned).collect())
    assert got == [
        (1, 0.33, "helpful"), (1, 0.3999, "helpful"), (1, 0.4, "critical"), (1, 0.6, "critical"),
        (2, 0.25, "helpful"),
    ]
    assert pruned.filter("task_id = 2").count() == 3


def test_snippet_length_bonus(spark):
    rows = [(1, 0, 0.5, "x" * 100), (1, 1, 0.45, "x" * 5000)]
    scored = spark.createDataFrame(rows, "task_id bigint, seq bigint, score double, code string")
    best = ranking.rank_snippets(scored, 1, vectors=True).first()
    assert best.seq == 1 and abs(best.score - 0.6) < 1e-12
    assert ranking.rank_snippets(scored, 1, vectors=False).first().seq == 0
