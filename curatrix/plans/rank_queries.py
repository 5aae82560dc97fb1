"""Registered queries on scoring, ranking, buckets, reports, context records and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions import extract as E
from curatrix.functions import lexical, vectors
from curatrix.functions.text import token_count
from curatrix.operators import assemble, filters, patterns, prompts, ranking, report, scoring
from curatrix.operators.extraction import extract_documents
from curatrix.operators.rows import few
from curatrix.plans import curate as plan
from curatrix.plans.extract_queries import PATTERNS, REFERENCES, TIPS
from curatrix.plans.registry import query
from curatrix.plans.text_queries import folded, greedy, tokens, units_of
from curatrix.plans.url_queries import _HITS as HITS
from curatrix.plans.url_queries import _MERGED as MERGED
from curatrix.plans.url_queries import ANSWER_SQL, DOMAIN, RANK, TERMS, answers_of, code_candidates, tasks_with_domains
from curatrix.session import cut_lineage
from curatrix.sources import payloads
from curatrix.sources.tables import pages_of_raw

# --- term coverage --------------------------------------------------------------------------


def coverage(items: str, key: str, text: str = "text") -> str:
    """CTE ``covered(task_id, key, score)``: every pair, by substring search."""
    return f"""task_words AS MATERIALIZED (SELECT task_id, {TERMS} AS terms FROM tasks),
    lowered AS MATERIALIZED (SELECT {key}, lower({text}) AS low FROM {items}),
    covered AS MATERIALIZED (
        SELECT task_id, {key}, len(list_filter(terms, lambda w: contains(low, w)))::DOUBLE / len(terms) AS score
        FROM task_words, lowered WHERE len(terms) > 0)"""


def ranked(source: str, tie: str, k: int, partition: str = "task_id") -> str:
    return f"""ranked AS MATERIALIZED (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY score DESC, {tie}) AS rank FROM {source})
        WHERE rank <= {k})"""


_PRUNED = """pruned AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY task_id) AS best FROM ranked)
        WHERE score >= greatest(0.18, 0.55 * best))"""
_BUCKETED = """bucketed AS MATERIALIZED (
        SELECT *, CASE WHEN score >= 0.40 THEN 'critical' ELSE 'helpful' END AS bucket FROM pruned WHERE score >= 0.25)"""


def _scores(rows, *names):
    for name in names or ("score",):
        rows = rows.withColumn(name, F.round(name, 6))
    return rows


def _longs(rows, *names):
    for name in names:
        rows = rows.withColumn(name, F.col(name).cast("bigint"))
    return rows


def _covered(t, at_least=None, best=None):
    return scoring.term_coverage(t("tasks"), t("documents"), ["doc_id"], at_least=at_least, best=best)


def _ranked(t, k=K.TOP_CHUNKS, at_least=None):
    """A floor that a later step sets anyway only cuts the tail of each task: ranks stay."""
    return ranking.top_k(_covered(t, at_least, k), k, ties=["doc_id"])


@query(
    f"WITH {coverage('documents', 'doc_id')} SELECT task_id, doc_id, round(score, 6) AS score FROM covered WHERE score > 0",
    ("tasks",),
)
def term_coverage(t):
    return _scores(_covered(t))


@query(
    f"""WITH w AS (SELECT task_id, {TERMS} AS terms, body FROM hits JOIN tasks USING (task_id)
                  ) SELECT task_id, body, round(CASE WHEN len(terms) = 0 THEN 0 ELSE
        len(list_filter(terms, lambda w: contains(lower(body), w)))::DOUBLE / len(terms) END, 6) AS score FROM w""",
    ("tasks", "hits"),
)
def text_relevance_pairs(t):
    pairs = t("hits").join(t("tasks"), "task_id")
    return _scores(scoring.score_pairs(pairs, "task", "body")).select("task_id", "body", "score")


@query(
    f"""WITH {coverage('documents', 'doc_id')}, positive AS (SELECT * FROM covered WHERE score > 0),
    {ranked('positive', 'doc_id', 16)} SELECT task_id, doc_id, rank, round(score, 6) AS score FROM ranked""",
    ("tasks",),
)
def rank_chunks(t):
    return _longs(_scores(_ranked(t)), "rank")


@query(
    f"""WITH {coverage('documents', 'doc_id')}, positive AS (SELECT * FROM covered WHERE score > 0),
    {ranked('positive', 'doc_id', 16)}, {_PRUNED} SELECT task_id, doc_id, rank, round(score, 6) AS score FROM pruned""",
    ("tasks",),
)
def relative_prune(t):
    return _longs(_scores(filters.relative_prune(_ranked(t, at_least=K.CHUNK_PRUNE[0]), *K.CHUNK_PRUNE)), "rank")


_DOC_BUCKETS = f"""{coverage('documents', 'doc_id')}, positive AS (SELECT * FROM covered WHERE score > 0),
    {ranked('positive', 'doc_id', 16)}, {_PRUNED}, {_BUCKETED}"""


def _bucketed(t):
    return filters.bucketize(filters.relative_prune(_ranked(t, at_least=K.HELPFUL), *K.CHUNK_PRUNE))


@query(f"WITH {_DOC_BUCKETS} SELECT task_id, doc_id, rank, bucket FROM bucketed", ("tasks",))
def bucketize(t):
    return _longs(_bucketed(t), "rank").select("task_id", "doc_id", "rank", "bucket")


@query(
    f"""WITH {_DOC_BUCKETS} SELECT bucket, count(*) AS rows, round(avg(score), 6) AS avg_score,
    count(quality) AS labelled, round(avg(quality), 6) AS avg_quality
    FROM bucketed LEFT JOIN labels USING (doc_id) GROUP BY bucket""",
    ("tasks",),
)
def bucket_report(t):
    return _scores(report.bucket_report(_bucketed(t), t("labels")), "avg_score", "avg_quality")


@query(
    f"""WITH {coverage('documents', 'doc_id')}, gated AS (SELECT * FROM covered WHERE score >= 0.5)
    SELECT task_id, count(*) AS docs FROM gated GROUP BY task_id""",
    ("tasks",),
)
def min_relevance(t):
    kept = filters.min_relevance(_covered(t, 0.5), 0.5)
    return kept.groupBy("task_id").agg(F.count(F.lit(1)).alias("docs"))


# --- flagship: chunks, near duplicates, coverage, top-k, buckets -----------------------------

_CORPUS = f"""{units_of('documents', 'doc_id', '500')}, {folded('units', '500')},
    chunks AS MATERIALIZED (SELECT doc AS doc_id, chunk_no, doc * 4294967296 + chunk_no AS seq, text FROM chunked),
    {greedy('chunks', 'seq')},
    uniq AS MATERIALIZED (SELECT seq, text FROM chunks JOIN firsts ON firsts.id = seq
                          WHERE seq NOT IN (SELECT id FROM dropped)),
    {coverage('uniq', 'seq')}, positive AS (SELECT * FROM covered WHERE score > 0),
    {ranked('positive', 'seq', 16)}, {_PRUNED}, {_BUCKETED}"""


@query(
    f"""WITH RECURSIVE {_CORPUS}
    SELECT task_id, rank, doc_id, chunk_no, round(score, 6) AS score, bucket, text
    FROM bucketed JOIN chunks USING (seq)""",
    ("tasks",),
)
def rank_corpus(t):
    best = plan.rank_corpus(t("tasks"), t("documents"))
    return _longs(_scores(best), "rank", "chunk_no").select(
        "task_id", "rank", "doc_id", "chunk_no", "score", "bucket", "text"
    )


# --- snippets ---------------------------------------------------------------------------------

_SNIPPETS = f"""snips AS (SELECT c.task_id, c.seq, c.source, c.code, {TERMS} AS terms FROM code c JOIN tasks USING (task_id)),
    scored AS (SELECT task_id, seq, source, code, CASE WHEN len(terms) = 0 THEN 0 ELSE
               len(list_filter(terms, lambda w: contains(lower(code), w)))::DOUBLE / len(terms) END
               + least(0.15, length(code) / 5000.0::DOUBLE) AS score FROM snips)"""


def _scored_code(t):
    pairs = t("code").join(t("tasks").select("task_id", "task"), "task_id")
    return scoring.score_pairs(pairs, "task", "code").drop("task")


@query(
    f"WITH {_SNIPPETS}, {ranked('scored', 'seq', 20)} SELECT task_id, seq, rank, round(score, 6) AS score FROM ranked",
    ("tasks", "code"),
)
def rank_snippets(t):
    best = ranking.rank_snippets(_scored_code(t), 20, vectors=True)
    return _longs(_scores(best), "rank").select("task_id", "seq", "rank", "score")


@query()
def lexical_score(t):
    """Fuzzy score of every hit with its own task; no SQL states an alignment of this kind."""
    pairs = t("hits").join(t("tasks").select("task_id", "task"), "task_id")
    return pairs.select(
        "task_id", "seq", F.round(lexical.lexical_score(F.col("task"), F.col("title")), 6).alias("score")
    )


# --- vectors ------------------------------------------------------------------------------------

_VECTORS = """unit AS MATERIALIZED (SELECT vec_id, embedding, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
    scored AS (SELECT a.vec_id AS task_id, b.vec_id AS item_id, list_cosine_similarity(a.v, b.v) AS score
               FROM unit a, unit b WHERE a.vec_id % 100 = 0)"""


def _vector_ranked(t, k):
    vecs = t("embeddings")
    # The stated query set: ids divisible by 100, against all vectors.
    asked = vecs.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("task_id"), "embedding")
    items = vecs.select(F.col("vec_id").alias("item_id"), "embedding")
    return ranking.top_k(scoring.vector_scores(asked, items, k), k, ties=["item_id"])


@query(
    f"""WITH {_VECTORS}, {ranked('scored', 'item_id', 24)}
    SELECT task_id, item_id, rank, round(score, 6) AS score FROM ranked"""
)
def cosine_top_k(t):
    return _longs(_scores(_vector_ranked(t, 24)), "rank")


@query(
    f"""WITH {_VECTORS}, {ranked('scored', 'item_id', 16)}, {_PRUNED}, {_BUCKETED}
    SELECT task_id, bucket, count(*) AS items, round(avg(score), 6) AS avg_score FROM bucketed GROUP BY ALL"""
)
def cosine_buckets(t):
    best = filters.bucketize(filters.relative_prune(_vector_ranked(t, 16), *K.CHUNK_PRUNE))
    grouped = best.groupBy("task_id", "bucket").agg(
        F.count(F.lit(1)).alias("items"), F.avg("score").alias("avg_score")
    )
    return _scores(grouped, "avg_score")


@query(
    """SELECT a.vec_id, round(list_cosine_similarity([x::DOUBLE FOR x IN a.embedding], [x::DOUBLE FOR x IN b.embedding]), 6)
       AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def cosine_neighbours(t):
    vecs = t("embeddings").select("vec_id", "embedding")
    following = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nearby"))
    pairs = vecs.join(following, "vec_id")
    score = vectors.semantic_or_lexical(F.col("embedding"), F.col("nearby"), F.lit(0.0))
    return _scores(pairs.select("vec_id", score.alias("score")))


# --- records --------------------------------------------------------------------------------------

_GATE = f"""{ANSWER_SQL}, words AS (SELECT task_id, {TERMS} AS terms FROM tasks),
    gated AS MATERIALIZED (
        SELECT answer.*, len(list_filter(terms, lambda w: contains(lower(question_title || ' ' || answer_body), w)))::DOUBLE
               / len(terms) AS relevance FROM answer JOIN words USING (task_id) WHERE len(terms) > 0)"""


@query(
    f"""WITH {_GATE} SELECT task_id, seq, question_url, round(relevance, 6) AS relevance FROM gated WHERE relevance >= 0.22""",
    ("questions", "answers", "tasks"),
)
def answer_gate(t):
    kept = scoring.answer_gate(answers_of(t), t("tasks"))
    return _scores(kept, "relevance").select("task_id", "seq", "question_url", "relevance")


_COSINE = "list_cosine_similarity([x::DOUBLE FOR x IN a.embedding], [x::DOUBLE FOR x IN b.embedding])"


@query(
    f"""WITH scored AS (SELECT task_id, doc_id, {_COSINE} AS score FROM task_vectors a, doc_vectors b),
    {ranked('scored', 'doc_id', 16)} SELECT task_id, doc_id, rank, round(score, 6) AS score FROM ranked""",
    ("task_vectors", "doc_vectors"),
)
def rank_chunks_vector(t):
    scored = scoring.vector_scores(t("task_vectors"), t("doc_vectors"), K.TOP_CHUNKS, item_id="doc_id")
    return _longs(_scores(ranking.top_k(scored, K.TOP_CHUNKS, ties=["doc_id"])), "rank")


def _semantic(t, rows):
    """``rows`` with the cosine of their task's vector and that of their own number, else null."""
    own = t("doc_vectors").select(F.col("doc_id").alias("seq"), F.col("embedding").alias("own"))
    both = rows.join(t("task_vectors"), "task_id", "left").join(own, "seq", "left")
    return both.withColumn("semantic", vectors.cosine(F.col("embedding"), F.col("own"))).drop("embedding", "own")


@query(
    f"""WITH {_GATE}, better AS (
        SELECT gated.*, greatest(relevance, coalesce({_COSINE}, 0)) AS best FROM gated
        LEFT JOIN task_vectors a USING (task_id) LEFT JOIN doc_vectors b ON b.doc_id = seq)
    SELECT task_id, seq, question_url, round(best, 6) AS relevance FROM better WHERE best >= 0.22""",
    ("questions", "answers", "tasks", "task_vectors", "doc_vectors"),
)
def answer_gate_semantic(t):
    kept = scoring.answer_gate(_semantic(t, answers_of(t)), t("tasks"), F.col("semantic"))
    return _scores(kept, "relevance").select("task_id", "seq", "question_url", "relevance")


@query(
    f"""WITH {HITS}, {MERGED}, task_words AS (SELECT task_id, {TERMS} AS terms, CASE WHEN allowed = '' THEN [] ELSE
                 [replace(lower(a), 'www.', '') FOR a IN string_split(allowed, ',')] END AS listed FROM tasks),
    better AS (
        SELECT m.task_id, m.seq, m.url, m.score, greatest(coalesce({_COSINE}, 0), CASE WHEN len(terms) = 0 THEN 0.0 ELSE
               len(list_filter(terms, lambda w: contains(lower(title || ' ' || snippet), w)))::DOUBLE / len(terms) END) AS relevance
        FROM merged m JOIN task_words USING (task_id) LEFT JOIN task_vectors a USING (task_id) LEFT JOIN doc_vectors b ON b.doc_id = m.seq
        WHERE len(listed) = 0 OR len(list_filter(listed, lambda a: {DOMAIN} = a OR ends_with({DOMAIN}, '.' || a))) > 0)
    SELECT task_id, url, round(relevance, 6) AS relevance, round(score + {RANK} + 2.5 * relevance, 6) AS score
    FROM better WHERE relevance >= 0.18""",
    ("hits", "tasks", "task_vectors", "doc_vectors"),
)
def scored_candidates_semantic(t):
    merged = _semantic(t, ranking.merge_hits(payloads.search_hits(t("hits"))))
    kept = scoring.score_candidates(merged, tasks_with_domains(t), K.WEB_MIN_RELEVANCE, F.col("semantic"))
    return _scores(kept, "relevance", "score").select("task_id", "url", "relevance", "score")


def _parts(t):
    """Chunks, snippets, docs, patterns and answers of every task, from the driver tables."""
    tasks = t("tasks")
    source = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id"))
    bodies = t("documents").select("doc_id", "text", source.alias("source"))
    # A few rows a task are known by now, so no text but theirs is dealt out.
    ranked = few(cut_lineage(_bucketed(t)))
    chunks = cut_lineage(bodies.join(ranked, "doc_id")).withColumn("tokens", token_count(F.col("text")))
    code = _scored_code(t).withColumn(
        "source", F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "seq")
    )
    snippets = cut_lineage(filters.bucketize(ranking.top_k(code, 6))).select(
        "*",
        F.lit("text").alias("language"),
        F.concat(F.lit("From "), "source").alias("description"),
    )
    # Every task sees the documents its chunks and snippets come from.
    sources = cut_lineage(assemble.kept_sources(chunks, snippets))
    seen = cut_lineage(bodies.join(few(sources.select("source").distinct()), "source", "left_semi"))
    ids = few(seen.select("doc_id").distinct())
    tips = t("advice").join(ids, "doc_id", "left_semi").select("doc_id", E.best_practices(F.col("markdown")).alias("tips"))
    refs = t("calls").join(ids, "doc_id", "left_semi").select("doc_id", E.api_references(F.col("markdown")).alias("refs"))
    docs = seen.join(tips, "doc_id").join(refs, "doc_id")

    def sourced(array, *names):
        return F.transform(
            array, lambda x: F.struct(*[x[n].alias(n) for n in names])
        )

    docs = docs.select(
        F.col("doc_id").alias("seq"),
        "source",
        F.concat(F.lit("Doc "), F.col("doc_id")).alias("title"),
        F.col("text").alias("summary"),
        sourced(F.col("refs"), "library", "function", "description").alias("api_references"),
        sourced(F.col("tips"), "practice", "reason").alias("best_practices"),
    )
    linked = sources.join(cut_lineage(docs), "source")
    found = patterns.best_patterns(patterns.detect_patterns(plan.bucket_order(snippets).select("task_id", "seq", "source", "code")))
    replies = scoring.answer_gate(answers_of(t), tasks).drop("relevance")
    return tasks, chunks, snippets, linked, found, replies


def _records(t):
    return assemble.assemble_context(*_parts(t))


_CODE_RANKED = f"""snips AS (SELECT c.task_id, c.seq, c.source, c.code, {TERMS} AS terms FROM code c JOIN tasks USING (task_id)),
    snip_scored AS (SELECT task_id, seq, 'https://' || source || '.example.com/' || seq AS source, code,
               CASE WHEN len(terms) = 0 THEN 0 ELSE
               len(list_filter(terms, lambda w: contains(lower(code), w)))::DOUBLE / len(terms) END AS score FROM snips),
    snip_ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, seq) AS rank FROM snip_scored)
                    WHERE rank <= 6),
    snip_kept AS MATERIALIZED (SELECT *, CASE WHEN score >= 0.40 THEN 'critical' ELSE 'helpful' END AS bucket
                  FROM snip_ranked WHERE score >= 0.25)"""
_SHOWN = f"""{_DOC_BUCKETS}, {_CODE_RANKED},
    criticals AS (SELECT task_id, count(*) FILTER (bucket = 'critical') < 3 AS ambiguous, count(*) FILTER (bucket = 'helpful') AS helpful
                  FROM bucketed GROUP BY task_id),
    shown AS MATERIALIZED (SELECT task_id, rank, doc_id, bucket, score,
              'https://' || source || '.example.com/' || doc_id AS source,
              text AS key_detail
              FROM bucketed JOIN documents USING (doc_id) JOIN criticals USING (task_id)
              WHERE bucket = 'critical' OR ambiguous),
    code_shown AS MATERIALIZED (SELECT * FROM (
        SELECT s.*, max_code_snippets, row_number() OVER (PARTITION BY s.task_id ORDER BY s.bucket, s.rank) AS place
        FROM snip_kept s JOIN tasks USING (task_id) LEFT JOIN criticals USING (task_id)
        WHERE s.bucket = 'critical' OR coalesce(ambiguous, true)) WHERE place <= max_code_snippets),
    sources AS MATERIALIZED (SELECT task_id, source FROM shown UNION SELECT task_id, source FROM code_shown)"""


def _rows(t, column, *fields):
    items = _records(t).select("task_id", F.posexplode(column).alias("no", "x"))
    return items.select("task_id", (F.col("no") + 1).cast("bigint").alias("no"), *[f"x.{f}" for f in fields])


@query(
    f"""WITH {_SHOWN} SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY bucket, rank) AS no,
    source, bucket, round_even(score, 3) AS relevance_score, key_detail FROM shown""",
    ("tasks", "code"),
)
def context_chunks(t):
    return _rows(t, "relevant_context", "source", "bucket", "relevance_score", "key_detail")


@query(
    f"""WITH {_SHOWN} SELECT task_id, place AS no, source, bucket, round_even(score, 3) AS relevance_score, code FROM code_shown""",
    ("tasks", "code"),
)
def context_snippets(t):
    return _rows(t, "context.code_snippets", "source", "bucket", "relevance_score", "code")


@query(
    f"""WITH {_SHOWN}, kept AS (
        SELECT task_id, doc_id, row_number() OVER (PARTITION BY task_id ORDER BY doc_id) AS no, text AS summary
        FROM documents d JOIN sources ON sources.source = 'https://' || d.source || '.example.com/' || doc_id)
    SELECT task_id, no, 'Doc ' || doc_id AS title, summary FROM kept""",
    ("tasks", "code"),
)
def context_concepts(t):
    return _rows(t, "context.concepts", "title", "summary")


@query(
    f"""WITH {_SHOWN}, {_GATE}, replies AS (SELECT DISTINCT task_id FROM gated WHERE relevance >= 0.22),
    flags AS (SELECT task_id, task_id NOT IN (SELECT task_id FROM code_shown) AS no_code,
                     task_id NOT IN (SELECT task_id FROM replies) AS no_answers,
                     coalesce(ambiguous, true) AND coalesce(helpful, 0) = 0 AS few
              FROM tasks LEFT JOIN criticals USING (task_id))
    SELECT task_id, list_filter([CASE WHEN no_code THEN '{K.NO_CODE}' END, CASE WHEN no_answers THEN '{K.NO_ANSWERS}' END,
                    CASE WHEN few THEN '{K.FEW_CHUNKS}' END], lambda s: s IS NOT NULL).array_to_string('|') AS questions
    FROM flags""",
    ("tasks", "code", "questions", "answers"),
)
def open_questions(t):
    return _records(t).select("task_id", F.array_join("open_questions", "|").alias("questions"))


_KEPT_DOCS = """kept_docs AS (
        SELECT task_id, doc_id, sources.source FROM documents d
        JOIN sources ON sources.source = 'https://' || d.source || '.example.com/' || doc_id)"""


def _first_of_key(rows: str, key: str) -> str:
    return f"""keyed AS (
        SELECT *, row_number() OVER (PARTITION BY task_id, {key} ORDER BY doc_id, no) AS copy
        FROM kept_docs JOIN {rows} USING (doc_id) WHERE {key} <> ''),
    numbered AS (SELECT * REPLACE (row_number() OVER (PARTITION BY task_id ORDER BY doc_id, no) AS no)
                 FROM keyed WHERE copy = 1)
    SELECT task_id, no, source, {key} FROM numbered"""


@query(
    f"WITH {_SHOWN}, {_KEPT_DOCS}, {REFERENCES}, {_first_of_key('r', 'function')}",
    ("tasks", "code", "calls"),
)
def context_references(t):
    return _rows(t, "context.api_references", "source", "function")


@query(
    f"WITH {_SHOWN}, {_KEPT_DOCS}, {TIPS}, {_first_of_key('tips', 'practice')}",
    ("tasks", "code", "advice"),
)
def context_practices(t):
    return _rows(t, "context.best_practices", "source", "practice")


@query(
    f"""WITH {_CODE_RANKED}, {PATTERNS.replace('FROM code, rules', 'FROM (SELECT task_id, seq, source, code, bucket, rank FROM snip_kept) code, rules')
        .replace('SELECT task_id, seq, source, code, pattern_type', 'SELECT task_id, bucket, rank, source, code, pattern_type')},
    firsts AS (SELECT *, row_number() OVER (PARTITION BY task_id, pattern_type ORDER BY confidence DESC, bucket, rank) AS place,
               min(struct_pack(b := bucket, r := rank, t := type_no)) OVER (PARTITION BY task_id, pattern_type) AS seen FROM detected)
    SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY confidence DESC, seen) AS no, pattern_type, source,
           round_even(confidence, 3) AS confidence, code AS code_snippet
    FROM firsts WHERE place = 1""",
    ("tasks", "code"),
)
def context_patterns(t):
    return _rows(t, "context.implementation_patterns", "pattern_type", "source", "confidence", "code_snippet")


@query(
    f"""WITH {_GATE} SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS no, question_title,
    answer_body, score FROM gated WHERE relevance >= 0.22""",
    ("questions", "answers", "tasks"),
)
def context_answers(t):
    return _rows(t, "context.stackoverflow_answers", "question_title", "answer_body", "score")


@query(
    f"""WITH {REFERENCES}, keyed AS (SELECT *, row_number() OVER (PARTITION BY function ORDER BY doc_id, no) AS copy FROM r)
    SELECT function, doc_id, no FROM keyed WHERE copy = 1""",
    ("calls",),
)
def unique_by_key(t):
    """The first use of every called name in the whole corpus."""
    rows = t("calls").select("doc_id", F.posexplode(E.api_references(F.col("markdown"))).alias("no", "r"))
    rows = rows.select("doc_id", (F.col("no") + 1).cast("bigint").alias("no"), "r.function")
    return assemble.unique_by_key(rows, [], "function", ["doc_id", "no"])


@query(
    f"""WITH {_DOC_BUCKETS}, linked AS (SELECT DISTINCT task_id, 'src' || doc_id % 20 AS source FROM bucketed),
    pool AS (SELECT task_id, doc_id, 'src' || doc_id % 20 AS source FROM tasks, documents WHERE doc_id % (SELECT count(*) FROM tasks) = task_id)
    SELECT task_id, doc_id FROM pool WHERE task_id NOT IN (SELECT task_id FROM linked)
       OR (task_id, source) IN (SELECT (task_id, source) FROM linked)""",
    ("tasks",),
)
def docs_of_sources(t):
    source = F.concat(F.lit("src"), F.col("doc_id") % 20)
    kept = assemble.kept_sources(_bucketed(t).select("task_id", source.alias("source")))
    n = t("tasks").agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    pool = t("documents").select((F.col("doc_id") % n).alias("task_id"), "doc_id", source.alias("source"))
    pool = pool.join(t("tasks").select("task_id"), "task_id")
    return assemble.docs_of_sources(pool, kept).select("task_id", "doc_id")


_FOUND_PATTERNS = f"""{PATTERNS.replace('FROM code, rules', 'FROM (SELECT task_id, seq, source, code, bucket, rank FROM snip_kept) code, rules')
        .replace('SELECT task_id, seq, source, code, pattern_type', 'SELECT task_id, bucket, rank, source, code, pattern_type')},
    firsts AS (SELECT *, row_number() OVER (PARTITION BY task_id, pattern_type ORDER BY confidence DESC, bucket, rank) AS place,
               min(struct_pack(b := bucket, r := rank, t := type_no)) OVER (PARTITION BY task_id, pattern_type) AS seen FROM detected),
    l_patterns AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY confidence DESC, seen) AS no, pattern_type,
                   description, code, round_even(confidence, 3) AS confidence FROM firsts WHERE place = 1)"""


def _unique(name: str, rows: str, key: str) -> str:
    return f"""{name}_keyed AS (SELECT *, row_number() OVER (PARTITION BY task_id, {key} ORDER BY doc_id, no) AS copy
                 FROM kept_docs JOIN {rows} USING (doc_id) WHERE {key} <> ''),
    {name} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY task_id ORDER BY doc_id, no) AS no) FROM {name}_keyed WHERE copy = 1)"""


def _lists(kept: str) -> str:
    """CTEs of the documents' lists, for documents whose sources ``kept`` lists, and of the rest."""
    return f"""{kept}, {REFERENCES}, {TIPS}, {_unique('l_refs', 'r', 'function')}, {_unique('l_tips', 'tips', 'practice')},
    l_concepts AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY doc_id) AS no, 'Doc ' || doc_id AS title,
                   text AS summary, k.source FROM kept_docs k JOIN documents USING (doc_id) WHERE text <> ''),
    {_FOUND_PATTERNS}, {_GATE},
    l_answers AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS no, question_title, question_url,
                  answer_body, score FROM gated WHERE relevance >= 0.22)"""


_RECORD = f"""{_SHOWN}, {_lists(_KEPT_DOCS)},
    l_chunks AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY bucket, rank) AS no FROM shown),
    flags AS (SELECT task_id, task_id NOT IN (SELECT task_id FROM code_shown) AS no_code,
                     task_id NOT IN (SELECT task_id FROM l_answers) AS no_answers,
                     task_id NOT IN (SELECT task_id FROM l_refs) AS no_refs,
                     coalesce(ambiguous, true) AND coalesce(helpful, 0) = 0 AS few
              FROM tasks LEFT JOIN criticals USING (task_id)),
    said AS (SELECT task_id, 1 AS no, '{K.NO_CODE}' AS s FROM flags WHERE no_code UNION ALL
             SELECT task_id, 2, '{K.NO_ANSWERS}' FROM flags WHERE no_answers UNION ALL
             SELECT task_id, 3, '{K.FEW_CHUNKS}' FROM flags WHERE few),
    next AS (SELECT task_id, 1 AS no, '{K.NEXT_EXAMPLES}' AS s FROM flags WHERE no_code UNION ALL
             SELECT task_id, 2, '{K.NEXT_API}' FROM flags WHERE no_refs)"""
_RECORD_USES = ("tasks", "code", "questions", "answers", "calls", "advice")


def _long(records, lists, sentences=()):
    """(task_id, list, no, a, b): one row per element of the lists {name: (column, a, b)}."""

    def rows(name, column, a, b):
        return F.transform(
            column,
            lambda x, i: F.struct(
                F.lit(name).alias("list"), i.cast("bigint").alias("place"), x[a].alias("a"), x[b].cast("string").alias("b")
            ),
        )

    def lines(name):
        return F.transform(
            name,
            lambda x, i: F.struct(F.lit(name).alias("list"), i.cast("bigint").alias("place"), x.alias("a"), F.lit("").alias("b")),
        )

    every = F.concat(*(rows(n, *of) for n, of in lists.items()), *map(lines, sentences))
    each = records.select("task_id", F.explode_outer(every).alias("x")).filter("x IS NOT NULL").select("task_id", "x.*")
    # The elements of a list of sentences are numbered by what they say, all others by their place.
    fixed = F.create_map(*(F.lit(v) for k, n in _SENTENCES.items() for v in (k, n)))
    said = F.col("list").isin(*sentences) if sentences else F.lit(False)
    no = F.when(said, F.coalesce(F.try_element_at(fixed, "a"), F.lit(0)).cast("bigint")).otherwise(F.col("place") + 1)
    return each.select("task_id", "list", no.alias("no"), "a", "b")


_SENTENCES = {K.NO_CODE: 1, K.NO_ANSWERS: 2, K.FEW_CHUNKS: 3, K.NEXT_EXAMPLES: 1, K.NEXT_API: 2}


@query(
    f"""WITH {_RECORD}
    SELECT task_id, 'chunk' AS list, no, source AS a, key_detail AS b FROM l_chunks
    UNION ALL SELECT task_id, 'code', place, source, code FROM code_shown
    UNION ALL SELECT task_id, 'concept', no, title, summary FROM l_concepts
    UNION ALL SELECT task_id, 'reference', no, function, source FROM l_refs
    UNION ALL SELECT task_id, 'practice', no, practice, source FROM l_tips
    UNION ALL SELECT task_id, 'pattern', no, pattern_type, confidence::VARCHAR FROM l_patterns
    UNION ALL SELECT task_id, 'answer', no, question_title, answer_body FROM l_answers
    UNION ALL SELECT task_id, 'open_questions', no, s, '' FROM said
    UNION ALL SELECT task_id, 'recommended_next_context', no, s, '' FROM next""",
    _RECORD_USES,
)
def assemble_context(t):
    """The whole record of every task, one row per element of each list."""
    lists = {
        "chunk": ("relevant_context", "source", "key_detail"),
        "code": ("context.code_snippets", "source", "code"),
        "concept": ("context.concepts", "title", "summary"),
        "reference": ("context.api_references", "function", "source"),
        "practice": ("context.best_practices", "practice", "source"),
        "pattern": ("context.implementation_patterns", "pattern_type", "confidence"),
        "answer": ("context.stackoverflow_answers", "question_title", "answer_body"),
    }
    return _long(_records(t), lists, ("open_questions", "recommended_next_context"))


_ALL_DOCS = """linked AS (
        SELECT task_id, 'https://' || source || '.example.com/' || doc_id AS source FROM bucketed JOIN documents USING (doc_id)
        UNION SELECT task_id, source FROM snip_kept),
    kept_docs AS (
        SELECT task_id, doc_id, linked.source FROM documents d
        JOIN linked ON linked.source = 'https://' || d.source || '.example.com/' || doc_id)"""


@query(
    f"""WITH {_DOC_BUCKETS}, {_CODE_RANKED}, {_lists(_ALL_DOCS)}
    SELECT task_id, 'chunk' AS list, row_number() OVER (PARTITION BY task_id ORDER BY rank) AS no, text AS a,
           'https://' || source || '.example.com/' || doc_id AS b FROM bucketed JOIN documents USING (doc_id)
    UNION ALL SELECT task_id, 'code', row_number() OVER (PARTITION BY task_id ORDER BY rank), source, code
              FROM snip_kept JOIN tasks USING (task_id) WHERE rank <= max_code_snippets
    UNION ALL SELECT task_id, 'concept', no, title, summary FROM l_concepts
    UNION ALL SELECT task_id, 'reference', no, function, source FROM l_refs
    UNION ALL SELECT task_id, 'practice', no, practice, source FROM l_tips
    UNION ALL SELECT task_id, 'pattern', no, pattern_type, confidence::VARCHAR FROM l_patterns
    UNION ALL SELECT task_id, 'answer', no, question_title, answer_body FROM l_answers""",
    _RECORD_USES,
)
def assemble_flat(t):
    """The older layout of every task, one row per element of each list."""
    lists = {
        "chunk": ("context.llm_chunks", "text", "source"),
        "code": ("context.code_snippets", "source", "code"),
        "concept": ("context.concepts", "title", "summary"),
        "reference": ("context.api_references", "function", "source"),
        "practice": ("context.best_practices", "practice", "source"),
        "pattern": ("context.implementation_patterns", "pattern_type", "confidence"),
        "answer": ("context.stackoverflow_answers", "question_title", "answer_body"),
    }
    return _long(assemble.assemble_flat(*_parts(t)), lists)


def _prompt_section(title: str, rows: str, item: str, no: str = "no") -> str:
    return f"""(SELECT '## {title}' || chr(10) || chr(10) || string_agg({item}, chr(10) ORDER BY {no})
                FROM {rows} x WHERE x.task_id = tasks.task_id)"""


@query(
    f"""WITH {_RECORD}
    SELECT task_id, concat_ws(chr(10), '## Developer Task' || chr(10) || chr(10) || task || chr(10),
      {_prompt_section('Pre-Ranked Context (already filtered for relevance)', 'l_chunks', f"""'[' || upper(bucket) || '] ' || source || ': '
        || CASE bucket WHEN 'critical' THEN '{K.WHY_CRITICAL}' ELSE '{K.WHY_HELPFUL}' END || chr(10) || '> ' || key_detail || chr(10)""")},
      {_prompt_section('Documentation Context', 'l_concepts', "'### ' || title || chr(10) || summary || chr(10) || 'Source: ' || source || chr(10)")},
      {_prompt_section('Code Examples', 'code_shown', """'### From ' || source || ' [' || upper(bucket) || ']' || chr(10) || '```text' || chr(10)
        || code || chr(10) || '```' || chr(10) || 'Source: ' || source || chr(10)""", 'place')},
      {_prompt_section('API References', 'l_refs', "'- `' || function || '`: Usage pattern with arguments: (' || args || ')' || chr(10)")},
      {_prompt_section('Best Practices', 'l_tips', "'- ' || practice || chr(10)")},
      {_prompt_section('Implementation Patterns', 'l_patterns', """'### ' || pattern_type || ' (confidence: ' || confidence || ')' || chr(10)
        || description || chr(10) || '```' || chr(10) || code || chr(10) || '```' || chr(10)""")},
      {_prompt_section('StackOverflow Answers', 'l_answers', """'### ' || question_title || ' (score: ' || score || ')' || chr(10) || answer_body
        || chr(10) || 'Source: ' || question_url || chr(10)""")},
      {_prompt_section('Known Gaps (from pipeline)', 'said', "'- ' || s || chr(10)")})
      || {" || chr(10) || ".join("'" + x + "'" for x in K.PROMPT_CLOSING.split(chr(10)))} AS prompt
    FROM tasks""",
    _RECORD_USES,
)
def build_prompts(t):
    return prompts.build_prompts(_records(t))


# --- the whole curation -----------------------------------------------------------------------------


def page_hits(tasks, docs):
    """(hits, semantic) of extracted pages: every page whose whole text covers enough terms of a
    task, as raw hits in order of coverage, and that coverage by (task_id, url)."""
    cards = docs.select("page_id", F.concat_ws(" ", "title", "markdown").alias("text"))
    found = scoring.term_coverage(tasks, cards, ["page_id"], at_least=K.WEB_MIN_RELEVANCE)
    named = cut_lineage(found.join(docs.select("page_id", "source", "title", "summary"), "page_id"))
    order = Window.partitionBy("task_id").orderBy(F.desc("score"), "page_id")
    hits = named.select(
        "task_id",
        F.lit("corpus").alias("query"),
        F.row_number().over(order).cast("bigint").alias("seq"),
        "title",
        F.lit("").alias("href"),
        F.col("source").alias("url"),
        F.col("summary").alias("body"),
    )
    return hits, named.groupBy("task_id", F.col("source").alias("url")).agg(F.max("score").alias("semantic"))


def _curated(t):
    tasks = tasks_with_domains(t)
    # What may not be fetched takes no place among a task's urls.
    pages = filters.robots_allowed(filters.fetched_ok(pages_of_raw(t("pages"))), t("robots"))
    hits, semantic = page_hits(tasks, extract_documents(pages))
    run = plan.curate(
        tasks, hits, pages_of_raw(t("pages")), answers_of(t), code_candidates(t), t("robots"), semantic=semantic
    )
    return tasks, run


@query()
def curate(t):
    return _curated(t)[1].records


@query()
def run_report(t):
    tasks, run = _curated(t)
    return run.report(tasks)
