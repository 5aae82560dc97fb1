"""Operators take all that is there unless a number is asked for."""

import inspect

from pyspark.sql import functions as F

from curatrix.functions import queries as Q
from curatrix.plans.curate import collect_urls, curate
from curatrix.plans.rank_queries import page_hits
from curatrix.sources import payloads, tables


def test_all_hits_of_a_query(spark):
    rows = [(1, "q", i, "t", f"https://a.org/{i}", "", "b") for i in range(30)]
    hits = spark.createDataFrame(rows, tables.SEARCH_HITS)
    assert payloads.search_hits(hits).count() == 30 and payloads.search_hits(hits, 8).count() == 8
    assert inspect.signature(curate).parameters["per_query"].default is None


def test_pages_are_found_by_their_whole_text_and_cut_after_the_gates(spark):
    plain = "Some plain words about gardens. " * 20
    rows = [(i, f"https://other{i}.net/x", "redis caching python", "", "redis caching in python") for i in range(30)]
    rows += [(100, "https://example.org/deep", "Notes", "", plain + " redis caching in python")]
    docs = spark.createDataFrame(rows, "page_id long, source string, title string, summary string, markdown string")
    task = (1, "redis caching python", 5, ["example.org"])
    free = (2, "redis caching python", 40, [])
    tasks = spark.createDataFrame([task, free], "task_id long, task string, max_sources int, allowed_domains array<string>")
    hits, semantic = page_hits(tasks, docs)
    assert hits.filter("task_id = 1").count() == 31
    chosen = collect_urls(tasks, payloads.search_hits(hits), None, semantic)
    assert [r.url for r in chosen.filter("task_id = 1").collect()] == ["https://example.org/deep"]
    assert chosen.filter("task_id = 2").count() == 31


def test_all_concepts_of_a_long_task(spark):
    task = spark.createDataFrame([(" ".join(f"concept{i:02}" for i in range(35)),)], "task string")
    made = task.select(Q.extract_signals(F.col("task")).alias("s"), Q.extract_signals(F.col("task"), 20).alias("few")).first()
    assert len(made.s.concepts) == 35 and made.few.concepts == made.s.concepts[:20]


def test_the_ninth_hit_of_a_query_can_win(spark):
    from curatrix.operators.ranking import merge_hits
    from curatrix.sources.payloads import search_hits

    rows = [(1, "q", i, f"t{i}", f"https://site{i}.example/x", None, "b") for i in range(8)] + [(1, "q", 8, "last", "https://docs.python.org/3/", None, "b")]
    hits = spark.createDataFrame(rows, "task_id long, query string, seq long, title string, href string, url string, body string")
    merged = merge_hits(search_hits(hits))
    assert merged.count() == 9
    assert merged.orderBy("score", ascending=False).first()["title"] == "last"


def test_all_concepts_of_a_task_are_kept(spark):
    from pyspark.sql import functions as F

    from curatrix.functions.queries import extract_signals

    task = " ".join(f"concept{i:02d}" for i in range(30))
    made = spark.createDataFrame([(task,)], "task string").select(extract_signals(F.col("task")).alias("s")).first()["s"]
    assert len(made["concepts"]) == 30
