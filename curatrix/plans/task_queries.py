"""Registered queries on tasks: terms, signals, search queries, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions import queries as Q
from curatrix.functions import text as X
from curatrix.operators import filters, scoring
from curatrix.plans.registry import WS, query, quoted
from curatrix.plans.text_queries import stripped
from curatrix.plans.url_queries import _SUSPICIOUS, TERMS

# lambda-free list of words: split on white space, edges trimmed of the listed characters
_TRIMMED = f"""[lower(trim(w, ' ,.-:_()[]{{}}' || chr(10) || chr(9))) FOR w IN
               string_split(trim(regexp_replace(task, '{WS}+', ' ', 'g')), ' ')]"""
SIGNALS = f"""words AS (SELECT task_id, task, languages,
                     list_sort(list_distinct(list_filter({_TRIMMED}, lambda w: length(w) > 2))) AS keywords
              FROM coding_tasks),
    libs AS (SELECT *, list_filter(keywords, lambda w: w IN ({quoted(K.KNOWN_LIBRARIES)})) AS libraries,
             list_filter(keywords, lambda w: w NOT IN ({quoted(K.KNOWN_LIBRARIES)})) AS concepts FROM words)"""


def _signals(t):
    return t("coding_tasks").withColumn("s", Q.extract_signals(F.col("task")))


def _numbered(rows, array, name):
    out = rows.select("task_id", F.posexplode(array).alias("no", name))
    return out.withColumn("no", (F.col("no") + 1).cast("bigint"))


def numbered_sql(source: str, array: str, name: str) -> str:
    return f"""SELECT task_id, unnest(range(1, len({array}) + 1)) AS no, unnest({array}) AS {name} FROM {source}"""


@query(f"WITH x AS (SELECT task_id, {TERMS} AS terms FROM tasks) {numbered_sql('x', 'terms', 'term')}", ("tasks",))
def task_terms(t):
    return _numbered(t("tasks"), X.task_terms(F.col("task")), "term")


_KINDS = {"libraries": "libraries", "frameworks": "libraries", "keywords": "keywords", "concepts": "concepts", "language": "['python']"}


@query(
    f"WITH {SIGNALS}, "
    + "kinds AS ("
    + " UNION ALL ".join(
        f"SELECT task_id, '{kind}' AS kind, {array} AS items FROM libs" for kind, array in _KINDS.items()
    )
    + ") SELECT task_id, kind, unnest(range(1, len(items) + 1)) AS no, unnest(items) AS item FROM kinds",
    ("coding_tasks",),
)
def extract_signals(t):
    kinds = F.create_map(*[x for k in _KINDS for x in (F.lit(k), F.col("s")[k])])
    rows = _signals(t).select("task_id", F.explode(kinds).alias("kind", "items"))
    return rows.select(
        "task_id", "kind", F.posexplode("items").alias("no", "item")
    ).withColumn("no", (F.col("no") + 1).cast("bigint"))


_DRAFTS = ", ".join(
    f"task || ' {s}', CASE WHEN core <> '' THEN core || ' {s}' END" for s in K.QUERY_SUFFIXES
)


@query(
    f"""WITH {SIGNALS}, cores AS (SELECT *, array_to_string(list_concat(libraries[1:3], concepts[1:4]), ' ') AS core FROM libs),
    drafts AS (SELECT task_id, unnest(d) AS query, unnest(range(1, len(d) + 1)) AS pos
               FROM (SELECT task_id, [{stripped('task')}, core, {_DRAFTS}] AS d FROM cores)),
    forms AS (SELECT *, lower(trim(regexp_replace(query, '{WS}+', ' ', 'g'))) AS form FROM drafts WHERE query IS NOT NULL),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY task_id, form ORDER BY pos) AS place FROM forms WHERE form <> ''),
    numbered AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY pos) AS no, query FROM firsts WHERE place = 1)
    SELECT * FROM numbered WHERE no <= 6""",
    ("coding_tasks",),
)
def expand_queries(t):
    return _numbered(_signals(t), Q.expand_queries(F.col("task"), F.col("s")), "query")


@query(
    f"""WITH {SIGNALS}, q AS (SELECT task_id, CASE WHEN len(libraries) + len(concepts) > 0 THEN
        [task, array_to_string(list_concat(libraries[1:3], concepts[1:3], ['example', 'python']), ' ')]
        ELSE [task] END AS qs FROM libs) {numbered_sql('q', 'qs', 'query')}""",
    ("coding_tasks",),
)
def github_repo_queries(t):
    return _numbered(_signals(t), Q.github_repo_queries(F.col("task"), F.col("s")), "query")


@query(
    f"""WITH {SIGNALS}, langs AS (SELECT *, CASE WHEN languages = '' THEN ['python']
                                  ELSE string_split(languages, ',')[1:3] END AS chosen FROM libs),
    each AS (SELECT *, unnest(chosen) AS lang, unnest(range(1, len(chosen) + 1)) AS n FROM langs),
    pairs AS (SELECT task_id, n * 2 AS pos, task || ' language:' || lang AS query FROM each
             UNION ALL SELECT task_id, n * 2 + 1, array_to_string(libraries[1:2], ' ') || ' example language:' || lang
             FROM each WHERE len(libraries) > 0)
    SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY pos) AS no, query FROM pairs""",
    ("coding_tasks",),
)
def github_code_queries(t):
    languages = F.filter(F.split("languages", ","), lambda g: g != "")
    return _numbered(
        _signals(t), Q.github_code_queries(F.col("task"), F.col("s"), languages), "query"
    )


@query(
    f"""WITH {SIGNALS}, g AS (SELECT task_id, CASE WHEN len(libraries) > 0 THEN libraries[1:3] ELSE ['python'] END AS tags FROM libs)
    {numbered_sql('g', 'tags', 'tag')}""",
    ("coding_tasks",),
)
def answer_tags(t):
    return _numbered(_signals(t), Q.answer_tags(F.col("s")), "tag")


@query(
    f"""WITH {SIGNALS}, asked AS (
        SELECT task_id, {TERMS} AS terms, CASE WHEN len(libraries) > 0 THEN libraries[1:3] ELSE ['python'] END AS tags FROM libs),
    pairs AS (
        SELECT task_id, question_id, q.score, len(list_filter(terms, lambda w: contains(lower(title), w)))::DOUBLE / len(terms) AS coverage
        FROM asked a, question_dump q WHERE len(terms) > 0 AND list_has_any(a.tags, string_split(q.tags, ','))),
    placed AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, question_id) AS rank
               FROM pairs WHERE coverage >= 0.22)
    SELECT task_id, question_id, rank, round(coverage, 6) AS coverage FROM placed WHERE rank <= 5""",
    ("coding_tasks", "question_dump"),
)
def matching_questions(t):
    tasks = _signals(t).select("task_id", "task", Q.answer_tags(F.col("s")).alias("tags"))
    questions = t("question_dump").withColumn("tags", F.split("tags", ","))
    found = scoring.matching_questions(tasks, questions)
    return found.select("task_id", "question_id", F.col("rank").cast("bigint").alias("rank"), F.round("coverage", 6).alias("coverage"))


_TASK_ERROR = f"""CASE WHEN {stripped('task')} = '' THEN 'empty' WHEN length(task) > 1000 THEN 'too long'
    WHEN ({_SUSPICIOUS.format('task')}) IS NOT NULL
    THEN 'suspicious pattern ' || ({_SUSPICIOUS.format('task')}) END"""


@query(
    f"""WITH e AS (SELECT task_id, task, {_TASK_ERROR} AS task_error FROM requests)
    SELECT task_id, task_error, CASE WHEN task_error IS NULL THEN {stripped('task')} END AS valid_task FROM e""",
    ("requests",),
)
def validate_task(t):
    checked = filters.validate_task(t("requests"))
    return checked.select("task_id", "task_error", "valid_task")


@query(
    f"""WITH e AS (SELECT *, {_TASK_ERROR} AS task_error, len(list_filter(string_split(allowed, ','),
                   lambda d: d <> '' AND NOT regexp_matches(d, '{K.DOMAIN_PATTERN}'))) > 0 AS bad FROM requests)
    SELECT task_id, concat_ws('; ', CASE WHEN length(task) < 3 THEN 'task too short' END,
        'task ' || task_error,
        CASE WHEN max_sources NOT BETWEEN 3 AND 50 THEN 'max_sources not in 3..50' END,
        CASE WHEN max_code_snippets NOT BETWEEN 1 AND 100 THEN 'max_code_snippets not in 1..100' END,
        CASE WHEN chunk_size NOT BETWEEN 100 AND 2000 THEN 'chunk_size not in 100..2000' END,
        CASE WHEN max_sources > 100 THEN 'max_sources over safe limit' END,
        CASE WHEN chunk_size > 10000 THEN 'chunk_size over safe limit' END,
        CASE WHEN bad THEN 'invalid domain' END) AS errors FROM e""",
    ("requests",),
)
def validate_requests(t):
    domains = F.filter(F.split("allowed", ","), lambda d: d != "")
    checked = filters.validate_requests(t("requests").withColumn("allowed_domains", domains))
    return checked.select("task_id", F.array_join("errors", "; ").alias("errors"))
