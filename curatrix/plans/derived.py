"""Inputs that the driver tables lack (hits, API dumps, code, requests, ...), derived from them.

Each text is plain SQL that Spark and the oracle read alike, so both sides start from the same
rows, and the rows grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "tasks": """
        SELECT item_id AS task_id, text AS task,
               CAST(3 + item_id % 8 AS INT) AS max_sources,
               CAST(2 + item_id % 4 AS INT) AS max_code_snippets,
               CAST(100 + 100 * (item_id % 3) AS INT) AS chunk_size,
               CASE WHEN item_id % 4 = 0 THEN 'example.com,www.python.org' ELSE '' END AS allowed
        FROM {benchmark}""",
    # Tasks that name libraries.
    "coding_tasks": """
        SELECT item_id AS task_id,
               replace(replace(replace(text, ' the ', ' Pandas, '), ' of ', ' (FastAPI) '),
                       'tion ', ' redis: ') AS task,
               CASE WHEN item_id % 3 = 0 THEN 'go,rust,python,c'
                    WHEN item_id % 3 = 1 THEN 'java' ELSE '' END AS languages
        FROM {benchmark}""",
    "requests": """
        SELECT item_id AS task_id,
               CASE item_id % 12 WHEN 0 THEN '  ' WHEN 1 THEN 'ab'
                    WHEN 2 THEN concat(text, '<script src=x>run()</script>')
                    WHEN 3 THEN concat('javascript:', text)
                    WHEN 4 THEN repeat(text, 9)
                    WHEN 5 THEN concat(text, ' OnClick = go')
                    WHEN 6 THEN concat('Open( ''', text)
                    WHEN 7 THEN concat('  ', text, ' ')
                    WHEN 8 THEN concat('eval(', text, ')')
                    ELSE text END AS task,
               CAST(item_id * 7 % 120 AS INT) AS max_sources,
               CAST(item_id * 11 % 130 AS INT) AS max_code_snippets,
               CAST(item_id * 977 % 12000 AS INT) AS chunk_size,
               CASE item_id % 5 WHEN 0 THEN 'example.com,-bad-.org' WHEN 1 THEN 'a.b.example.org'
                    ELSE '' END AS allowed
        FROM {benchmark}""",
    "page_urls": """
        SELECT page_id,
               CASE page_id % 12
                    WHEN 1 THEN concat('https://docs.python.org/3/', page_id)
                    WHEN 2 THEN concat('https://api.PyTorch.org/docs/', page_id)
                    WHEN 3 THEN concat('http://www.medium.com/', page_id)
                    WHEN 4 THEN concat('https://github.com/org/repo', page_id)
                    WHEN 5 THEN concat('https://notpytorch.org/', page_id)
                    WHEN 6 THEN concat('https://me@www.huggingface.co:8080/', page_id)
                    WHEN 7 THEN concat('https://x.readthedocs.io/?q=', page_id)
                    WHEN 8 THEN concat('https://old.reddit.com/r/docs', page_id)
                    ELSE url END AS url
        FROM {pages}""",
    "hosts": """
        SELECT page_id,
               CASE page_id % 24
                    WHEN 0 THEN concat('10.', page_id % 256, '.0.1')
                    WHEN 1 THEN concat('172.', page_id % 40, '.3.4')
                    WHEN 2 THEN concat('192.168.', page_id % 300, '.9')
                    WHEN 3 THEN concat('8.8.', page_id % 256, '.8')
                    WHEN 4 THEN concat('169.254.169.', page_id % 256)
                    WHEN 5 THEN '::1'
                    WHEN 6 THEN concat('fc00::', page_id % 9999)
                    WHEN 7 THEN concat('fe80::', page_id % 9999)
                    WHEN 8 THEN concat('2001:db8::', page_id % 9999)
                    WHEN 9 THEN 'localhost'
                    WHEN 10 THEN concat('127.0.0.', page_id % 256)
                    WHEN 11 THEN concat('host', page_id, '.internal')
                    ELSE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) END AS host
        FROM {pages}""",
    "odd_urls": """
        SELECT page_id,
               CASE page_id % 18
                    WHEN 0 THEN concat('ftp://files.example.org/', page_id)
                    WHEN 1 THEN concat('http:///path/', page_id)
                    WHEN 2 THEN concat('http://localhost:', page_id, '/admin')
                    WHEN 3 THEN concat('https://10.0.', page_id % 256, '.1/x')
                    WHEN 4 THEN concat('https://8.8.8.8/', page_id)
                    WHEN 5 THEN concat('https://[::1]:80/', page_id)
                    WHEN 6 THEN concat('https://example.com/', repeat('a', 2030 + page_id % 10))
                    WHEN 7 THEN concat('https://example.com/?q=javascript:', page_id)
                    WHEN 8 THEN '   '
                    ELSE url END AS url
        FROM {pages}""",
    "odd_domains": """
        SELECT page_id,
               CASE page_id % 14
                    WHEN 0 THEN concat('Site', page_id, '.Example.ORG')
                    WHEN 1 THEN concat('-x', page_id, '.com')
                    WHEN 2 THEN concat('a..b', page_id)
                    WHEN 3 THEN repeat('abcdefgh.', 28 + CAST(page_id % 3 AS INT))
                    WHEN 4 THEN concat(repeat('z', 60 + CAST(page_id % 6 AS INT)), '.com')
                    WHEN 5 THEN ''
                    ELSE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) END AS domain
        FROM {pages}""",
    "crawl_pages": """
        SELECT page_id, url, CAST(200 + 100 * (page_id % 4) AS INT) AS status_code,
               CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'image/png'
                    WHEN 2 THEN 'application/json' WHEN 3 THEN 'TEXT/HTML'
                    ELSE 'application/xhtml+xml' END AS content_type,
               CASE WHEN page_id % 50 = 0 THEN repeat(html, 120) ELSE html END AS text
        FROM {pages}""",
    "robots": """
        SELECT origin,
               CASE length(origin) % 4
                    WHEN 0 THEN concat('User-agent: *', chr(10), 'Allow: /en/1', chr(10), 'Disallow: /en/')
                    WHEN 1 THEN concat('# rules', chr(10), 'User-agent: otherbot', chr(10), 'Disallow: /',
                                       chr(10), chr(10), 'User-Agent: CURATRIX', chr(10),
                                       'disallow: /%64%65/ # all of it', chr(10), 'Crawl-delay: 3')
                    WHEN 2 THEN concat('User-agent: *', chr(10), 'Disallow:', chr(10), 'Disallow: /')
                    ELSE concat('User-agent: *', chr(10), chr(10), 'Disallow: /') END AS body
        FROM (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM {pages})
        WHERE length(origin) % 5 <> 0""",
    # Some paths with percent escapes: in a word, of a two-byte character, and a stray sign.
    "escaped_pages": """
        SELECT page_id,
               CASE page_id % 4 WHEN 0 THEN replace(replace(url, '/en/', '/e%6E/'), '/de/', '/%64e/')
                    WHEN 1 THEN concat(url, '%C3%A9%zz+') ELSE url END AS url
        FROM {pages}""",
    "hits": """
        SELECT doc_id % (SELECT greatest(count(*), 1) FROM {benchmark}) AS task_id, concat('q', doc_id % 3) AS query, doc_id AS seq,
               split_part(text, chr(10), 1) AS title,
               CASE WHEN doc_id % 7 = 0 THEN '' ELSE
                    concat(CASE WHEN doc_id % 5 = 0 THEN 'https://docs.python.org/'
                                ELSE concat('https://www.', source, '.example.com/') END,
                           lang, '/', doc_id % 60) END AS href,
               CASE WHEN doc_id % 14 = 0 THEN concat('https://m.', source, '.example.org/', doc_id)
                    ELSE '' END AS url,
               text AS body
        FROM {documents}""",
    "repo_items": """
        SELECT doc_id % (SELECT greatest(count(*), 1) FROM {benchmark}) AS task_id, doc_id AS seq, concat(source, '/', lang, doc_id) AS full_name,
               CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('https://github.com/', source, '/', lang, doc_id)
                    END AS html_url,
               CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS description,
               CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars * 37 END AS stargazers_count,
               CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'master' END AS default_branch
        FROM {documents}""",
    "code_items": """
        SELECT doc_id % (SELECT greatest(count(*), 1) FROM {benchmark}) AS task_id, doc_id AS seq,
               CASE WHEN doc_id % 11 = 0 THEN '' ELSE
                    concat(CASE WHEN doc_id % 3 = 0 THEN 'lib/Examples/' ELSE 'src/' END, lang, doc_id,
                           CASE doc_id % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.rs' ELSE '.txt' END) END AS path,
               CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('https://github.com/f/', doc_id) END AS html_url,
               CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat(source, '/r') END AS full_name,
               concat('https://github.com/', source, '/r') AS repo_url
        FROM {documents}""",
    "questions": """
        SELECT conv_id % (SELECT greatest(count(*), 1) FROM {benchmark}) AS task_id, conv_id AS seq, conv_id + 1000 AS question_id,
               concat(text, ' &lt;b&gt; &amp;amp; &#39;x&#39;') AS title,
               conv_id % 5 <> 0 AS is_answered,
               CASE WHEN conv_id % 7 = 0 THEN NULL ELSE conv_id * 10 + 1 END AS accepted_answer_id
        FROM {conversations} WHERE turn = 0""",
    "question_dump": """
        SELECT conv_id AS question_id, text AS title, CAST(length(text) AS BIGINT) AS score,
               CASE conv_id % 4 WHEN 0 THEN 'redis,pandas' WHEN 1 THEN 'python' WHEN 2 THEN 'fastapi,go'
                    ELSE 'rust' END AS tags
        FROM {conversations} WHERE turn = 0""",
    "answers": """
        SELECT conv_id * 10 + turn AS answer_id,
               concat('<p>', text, '</p><pre><code>x &lt; 1</code></pre>') AS body,
               length(text) AS score
        FROM {conversations} WHERE role = 'assistant'""",
    # Prose made into advice, calls and code, so that the extraction rules have work.
    "advice": """
        SELECT doc_id, replace(replace(replace(text, '. ', concat('.', chr(10))), ' of ', ' Should '),
                               ' la ', ' best practice ') AS markdown
        FROM {documents}""",
    "calls": """
        SELECT doc_id, replace(replace(replace(text, ', ', '.get(x) '), 'tion ', '(a, b) '),
                               ' de ', ' np.de(') AS markdown
        FROM {documents}""",
    "fences": """
        SELECT doc_id, source,
               concat('# ', source, chr(10), chr(10), '```',
                      CASE doc_id % 3 WHEN 0 THEN 'Python' WHEN 1 THEN '' ELSE 'c++' END, chr(10),
                      replace(text, '. ', concat(';', chr(10))), chr(10), '```', chr(10),
                      '## Part ', doc_id, chr(10), chr(10), '```', chr(10), 'one line only', chr(10),
                      '```', chr(10), '```js', chr(10), lang, ' = 1;', chr(10),
                      '// ', text, chr(10), '```', chr(10), '#### End  of ', lang, chr(10)) AS markdown
        FROM {documents}""",
    "blocks": """
        SELECT doc_id, source,
               CASE doc_id % 6 WHEN 0 THEN 'language-py' WHEN 1 THEN 'highlight-JS' WHEN 2 THEN 'shell'
                    ELSE '' END AS class_name,
               CASE doc_id % 5
                    WHEN 0 THEN concat('import os', chr(10), 'def f():', chr(10), text)
                    WHEN 1 THEN concat('  $ run', chr(10), text)
                    WHEN 2 THEN concat('a: 1', chr(10), '  b-c: 2', chr(10), 'd :3', chr(10), text)
                    WHEN 3 THEN concat('const x = 1;', chr(10), text)
                    ELSE text END AS code
        FROM {documents}""",
    "code": """
        SELECT doc_id % (SELECT greatest(count(*), 1) FROM {benchmark}) AS task_id, doc_id AS seq, source,
               replace(replace(replace(replace(replace(replace(replace(replace(text,
                   ' of ', ' TOKEN '), ' is ', ' login '), ' le ', ' select '), ' la ', ' commit '),
                   ' und ', ' try '), ' ist ', ' retry '), ' el ', ' redis '), ' los ', ' @cache ')
                   AS code
        FROM {documents}""",
    "log_rows": """
        SELECT doc_id, concat('Bearer ', source, '.x ', text, ' token = "', lang, doc_id, '"') AS msg,
               CASE WHEN doc_id % 2 = 0 THEN 'Token' ELSE 'note' END AS k,
               CASE WHEN doc_id % 3 = 0 THEN 'abcd' ELSE concat('value-', doc_id) END AS v,
               concat('sk-or-', 'v1-', lang, doc_id) AS item
        FROM {documents}""",
    # Vectors of tasks and documents: those of the same number.
    "task_vectors": """
        SELECT item_id AS task_id, embedding FROM {benchmark}
        JOIN {embeddings} ON vec_id = item_id""",
    "doc_vectors": """
        SELECT doc_id, embedding FROM {documents}
        JOIN {embeddings} ON vec_id = doc_id""",
    "cache_rows": """
        SELECT concat('u', user_id % 200) AS key, ts AS cached_at, event_type AS payload
        FROM {events}
        WHERE event_type <> 'error'""",
    "cache_requests": """
        SELECT DISTINCT concat('u', user_id) AS key FROM {events}""",
}

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one of the derived tables, by name."""
    if name in BASE:
        return base(spark, sf_dir, name)
    text = SQL[name]
    return spark.sql(text, **{b: base(spark, sf_dir, b) for b in BASE if "{" + b + "}" in text})


def oracle_ctes(*names: str) -> str:
    """``WITH`` clause that defines derived tables for the oracle."""
    texts = [f"{n} AS ({SQL[n].format(**{b: b for b in BASE})})" for n in names]
    return "WITH " + ",\n".join(texts)
