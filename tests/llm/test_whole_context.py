from pyspark.sql import functions as F

from curatrix.llm import pii_bootstrap as P


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_context_does_not_end_at_a_neighbour(spark):
    text = "é mail a@b.org id X-7741, then user 83921 ssn 10.0.0.1,10.0.0.2 end " + "long" * 100 + " word " + "w" * 300 + " Y-99q end"
    rows = docs_of(spark, [(1, text)]).select(F.col("doc_id").alias("key"), F.lit(7).cast("long").alias("row"), "text")
    made = {x["found"]: (x["before"].split()[-3:], x["after"].split()[0]) for x in P.spans(rows).collect()}
    assert made == {
        "a@b.org": (["é", "mail"], "id"), "X-7741": (["mail", "a@b.org", "id"], "then"), "83921": (["X-7741,", "then", "user"], "ssn"),
        "10.0.0.1": (["user", "83921", "ssn"], ","), "10.0.0.2": (["ssn", "10.0.0.1", ","], "end"), "Y-99q": (["long" * 100, "word", "w" * 300], "end"),
    }


def test_identifiers_behind_others_are_found(spark):
    seeds = [(i, f"log user 839{i} host name 10.0.0.{i} end") for i in range(10, 30)]
    others = [(400 + i, f"log user 839{i} host name X-77q{i} end") for i in (41, 42)]
    lists = [(500 + i, f"log host-83{i} host-84{i} 10.0.1.{i} end") for i in range(10, 30)] + [(200, "log host-8399 host-8499 Y-11q51 end")]
    made = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in P.find_personal_data(docs_of(spark, seeds + others + lists), "doc_id", "text").collect()}
    assert all(made[i] == ["context_ip"] for i, _ in others) and made[200] == ["context_ip"]


def test_scores_follow_a_chain_of_patterns_to_its_end(spark):
    # Pattern n vouches for candidate n only with the candidates of the patterns before it.
    edges, seeds = [], [(f"s{i}", "ip") for i in range(12)]
    for n in range(8):
        edges += [(f"p{n}", f"s{i}") for i in range(12)] + [(f"p{n}", f"c{n}")]
        edges += [(f"p{n}", f"c{n - 1}"), (f"p{n}", f"d{n - 1}"), (f"p{n}", f"e{n - 1}")] if n else []
        edges += [(f"p{n}", f"d{n}"), (f"p{n}", f"e{n}")]
    table = spark.createDataFrame(edges, "pattern string, instance string")
    known = spark.createDataFrame(seeds, "instance string, kind string")
    settings = {"confident": 0.75, "accept": 0.75}
    short = P.score_instances(table, known, P.Settings(rounds=3, **settings)).select("instance").collect()
    whole = P.score_instances(table, known, P.Settings(rounds=None, **settings)).select("instance").collect()
    assert {r["instance"] for r in short} < {r["instance"] for r in whole}
    assert {r["instance"] for r in whole} == {f"{c}{n}" for c in "cde" for n in range(8)}


def test_long_texts_cost_in_proportion(spark):
    import time

    def seconds(n):
        text = " ".join(f"mail a{i}@b.org,é{i}@c.org ssn X-{i} card 4111 1111 1111 1111" for i in range(n))
        start = time.time()
        made = P.redact(docs_of(spark, [(1, text)]), "doc_id", "text").first()["text"]
        assert made == " ".join(f"mail <EMAIL>,<EMAIL> ssn X-{i} card <CARD>" for i in range(n)).replace(",<EMAIL>", ",é<EMAIL>")
        return time.time() - start

    seconds(100)
    small, large = seconds(1_000), seconds(8_000)
    assert large < max(8 * small, 30)
