"""Registered queries on urls, hosts, pages filters, candidates and url selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions import urls as U
from curatrix.operators import filters, ranking, report
from curatrix.plans.curate import collect_urls
from curatrix.plans.registry import WS, query, quoted
from curatrix.session import shared_folder
from curatrix.sources import payloads, tables
from curatrix.sources.tables import CODE_ITEMS, REPO_ITEMS

AUTHORITY = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
DOMAIN = f"replace(lower({AUTHORITY}), 'www.', '')"
_RANK = " + ".join(
    "CASE WHEN " + " OR ".join(f"contains(lower(url), '{n}')" for n in needles) + f" THEN {points} ELSE 0.0 END"
    for needles, points in K.URL_RANK_RULES
)
RANK = f"CAST({_RANK} AS DOUBLE)"
BOOST = (
    "CAST(CASE "
    + " ".join(
        f"WHEN {DOMAIN} = '{d}' OR ends_with({DOMAIN}, '.{d}') THEN {points}"
        for d, points in K.PREFERRED_DOMAINS
    )
    + " ELSE 0.0 END AS DOUBLE)"
)


@query(f"SELECT page_id, url, {DOMAIN} AS domain FROM page_urls", ("page_urls",))
def url_domain(t):
    return t("page_urls").select("page_id", "url", U.url_domain(F.col("url")).alias("domain"))


@query(f"SELECT page_id, round({RANK}, 6) AS url_rank FROM page_urls", ("page_urls",))
def url_rank(t):
    return t("page_urls").select("page_id", F.round(U.url_rank(F.col("url")), 6).alias("url_rank"))


@query(f"SELECT page_id, {BOOST} AS boost FROM page_urls", ("page_urls",))
def domain_boost(t):
    return t("page_urls").select("page_id", U.domain_boost(F.col("url")).alias("boost"))


@query(
    f"""WITH d AS (SELECT page_id, {DOMAIN} AS domain FROM page_urls)
    SELECT page_id, domain IN ('python.org', 'example.com') OR ends_with(domain, '.python.org')
                    OR ends_with(domain, '.example.com') AS allowed FROM d""",
    ("page_urls",),
)
def allowed_domain(t):
    listed = F.array(F.lit("www.Python.org"), F.lit("example.com"))
    return t("page_urls").select(
        "page_id", U.allowed_domain(F.col("url"), listed).alias("allowed")
    )


_SUSPICIOUS = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches({{0}}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {i}"
        for i, p in enumerate(K.SUSPICIOUS_PATTERNS, start=1)
    )
    + " END"
)
_PRIVATE_V4 = " OR ".join(
    f"n BETWEEN {low} AND {high}"
    for low, high in [
        (167772160, 184549375),
        (2886729728, 2887778303),
        (3232235520, 3232301055),
        (2130706432, 2147483647),
        (2851995648, 2852061183),
        (0, 16777215),
    ]
)


def _private(table: str, host: str, keep: str) -> str:
    """Private hosts by arithmetic on the four octets; IPv6 by its first hextet."""
    return f"""parts AS (SELECT {keep}, {host} AS h, string_split({host}, '.') AS p FROM {table}),
    numbers AS (SELECT {keep}, h, CASE WHEN len(p) = 4 AND regexp_full_match(h, '[0-9.]+')
                AND list_bool_and([TRY_CAST(x AS BIGINT) BETWEEN 0 AND 255 FOR x IN p])
                THEN TRY_CAST(p[1] AS BIGINT) * 16777216 + TRY_CAST(p[2] AS BIGINT) * 65536
                   + TRY_CAST(p[3] AS BIGINT) * 256 + TRY_CAST(p[4] AS BIGINT) END AS n FROM parts),
    private AS (SELECT {keep}, coalesce({_PRIVATE_V4}, false) OR h IN ('localhost', 'localhost.localdomain')
                OR h = '::1' OR regexp_matches(h, '^f[cd][0-9a-f][0-9a-f]:')
                OR regexp_matches(h, '^fe[89ab][0-9a-f]:') AS private FROM numbers)"""


@query(f"WITH {_private('hosts', 'host', 'page_id, host')} SELECT * FROM private", ("hosts",))
def private_host(t):
    return t("hosts").select("page_id", "host", U.is_private_host(F.col("host")).alias("private"))


@query(
    f"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
                   lower(CASE WHEN starts_with({AUTHORITY}, '[')
                         THEN regexp_extract({AUTHORITY}, '^\\[([^\\]]*)', 1)
                         ELSE regexp_replace({AUTHORITY}, ':.*$', '') END) AS host FROM odd_urls),
    {_private('u', 'host', 'page_id, url, scheme')}
    SELECT page_id, CASE WHEN trim(url) = '' THEN 'empty' WHEN length(url) > 2048 THEN 'too long'
                    WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN u.host = '' THEN 'no hostname'
                    WHEN ({_SUSPICIOUS.format('url')}) IS NOT NULL THEN 'suspicious pattern'
                    WHEN private THEN 'internal host' END AS error
    FROM private JOIN u USING (page_id, url, scheme)""",
    ("odd_urls",),
)
def url_errors(t):
    return t("odd_urls").select("page_id", U.url_error(F.col("url")).alias("error"))


@query(
    f"""SELECT page_id, CASE WHEN trim(domain) = '' THEN 'empty' WHEN length(domain) > 253 THEN 'too long'
        WHEN NOT regexp_matches(domain, '{K.DOMAIN_PATTERN}') THEN 'format' END AS error,
        CASE WHEN trim(domain) <> '' AND length(domain) <= 253
             AND regexp_matches(domain, '{K.DOMAIN_PATTERN}') THEN lower(domain) END AS normal
        FROM odd_domains""",
    ("odd_domains",),
)
def domain_errors(t):
    domain = F.col("domain")
    return t("odd_domains").select(
        "page_id", U.domain_error(domain).alias("error"), U.normal_domain(domain).alias("normal")
    )


@query(
    """SELECT page_id, CAST(length(text) AS BIGINT) AS n FROM crawl_pages
    WHERE status_code < 400 AND text IS NOT NULL
      AND regexp_matches(content_type, 'text|json|markdown|xhtml|xml')""",
    ("crawl_pages",),
)
def fetched_ok(t):
    good = filters.fetched_ok(t("crawl_pages"))
    return good.select("page_id", F.length("text").cast("bigint").alias("n"))


@query(
    """SELECT url, status_code, content_type, sha256(text) AS text_sha256 FROM crawl_pages
    WHERE status_code < 400""",
    ("crawl_pages",),
)
def pages_read(t):
    """Crawl pages written as a table and read with their declared schema."""
    pages = t("crawl_pages").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    folder = f"{shared_folder(pages.sparkSession)}/pages-{uuid.uuid4().hex}"
    pages.drop("page_id").write.parquet(folder)
    read = tables.read_pages(pages.sparkSession, folder).filter("status_code < 400")
    return read.select("url", "status_code", "content_type", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT page_id, CAST(status_code AS VARCHAR) AS run_date, url FROM crawl_pages", ("crawl_pages",))
def results_written(t):
    """Rows appended under their run date, read back with the date from the folders."""
    rows = t("crawl_pages").select("page_id", "url", "status_code")
    folder = f"{shared_folder(rows.sparkSession)}/results-{uuid.uuid4().hex}"
    tables.write_results(rows, folder, F.col("status_code").cast("string"))
    return rows.sparkSession.read.schema("page_id bigint, url string, run_date string").json(folder)


@query(
    """SELECT key, max(ts) AS cached_at, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS payload
    FROM (SELECT *, concat('u', user_id) AS key FROM events) GROUP BY key"""
)
def cache_written(t):
    """Entries of every event appended in two parts; readers take the newest entry of a key."""
    events = t("events").select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("ts").alias("cached_at"), "event_id", "event_type")
    entries = events.withColumn("payload", F.concat_ws(":", F.lpad(F.col("event_id").cast("string"), 20, "0"), "event_type"))
    folder = f"{shared_folder(events.sparkSession)}/cache-{uuid.uuid4().hex}"
    tables.write_cache(entries.filter("event_id % 2 = 0"), folder)
    tables.write_cache(entries.filter("event_id % 2 <> 0"), folder)
    read = tables.read_cache(events.sparkSession, folder)
    newest = read.groupBy("key").agg(F.max(F.struct("cached_at", "payload")).alias("e"))
    return newest.select("key", "e.cached_at", F.substring_index("e.payload", ":", -1).alias("payload"))


@query("SELECT doc_id FROM documents WHERE length(text) >= 200")
def min_page_length(t):
    return filters.long_enough(t("documents")).select("doc_id")


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
                  url_decode(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)) AS path FROM escaped_pages),
    j AS (SELECT p.*, CASE WHEN robots.origin IS NOT NULL THEN length(p.origin) % 4 END AS kind
          FROM p LEFT JOIN robots USING (origin))
    SELECT page_id FROM j WHERE CASE kind
        WHEN 0 THEN starts_with(path, '/en/1') OR NOT starts_with(path, '/en/')
        WHEN 1 THEN NOT starts_with(path, '/de/')
        ELSE true END""",
    ("robots", "escaped_pages"),
)
def robots_allowed(t):
    return filters.robots_allowed(t("escaped_pages"), t("robots")).select("page_id")


#: Hits of each (task, query) that ``search_hits`` reports: its limit is the feature. All others read every hit.
PER_QUERY = 8

_HITS = f"""named AS (SELECT * REPLACE (coalesce(nullif(href, ''), nullif(url, '')) AS url) FROM hits),
    web AS (SELECT task_id, seq, title, url, body AS snippet, {BOOST} AS score FROM named WHERE url IS NOT NULL)"""


_FIRST_HITS = _HITS.replace("FROM hits", "FROM hits QUALIFY row_number() OVER (PARTITION BY task_id, query ORDER BY seq) <= 8")


@query(f"WITH {_FIRST_HITS} SELECT * FROM web", ("hits",))
def search_hits(t):
    return payloads.search_hits(t("hits"), PER_QUERY).drop("source")


_MERGED = """merged AS (
        SELECT task_id, url, min(seq) AS seq, max(score) AS score,
               arg_max(title, struct_pack(s := score, q := -seq)) AS title,
               arg_max(snippet, struct_pack(s := score, q := -seq)) AS snippet
        FROM web GROUP BY task_id, url)"""


@query(f"WITH {_HITS}, {_MERGED} SELECT * FROM merged", ("hits",))
def merge_hits(t):
    return ranking.merge_hits(payloads.search_hits(t("hits"))).drop("source")


def _numbered(rows):
    """One number for (payload, item, row), as the SQL has it for payloads of one good item."""
    seq = F.col("seq")
    return rows.withColumn("seq", seq["seq"] * 1048576 + seq["no"] * 2 + seq["k"]).drop("source")


def _repo_payload(t):
    rows = t("repo_items")
    item = F.struct("full_name", "html_url", "description", "stargazers_count", "default_branch")
    text = F.to_json(F.array(item, item.withField("html_url", F.lit(None).cast("string"))))
    return rows.select("task_id", "seq", F.from_json(text, REPO_ITEMS).alias("items"))


_REPO = """repo AS (
        SELECT task_id, seq * 1048576 AS seq, full_name AS title, concat(html_url, '#readme') AS url,
               coalesce(description, '') AS snippet,
               least(5.0::DOUBLE, 1.0 + coalesce(stargazers_count, 0) / 20000.0::DOUBLE) AS score
        FROM repo_items WHERE html_url <> ''
        UNION ALL
        SELECT task_id, seq * 1048576 + 1, concat(full_name, ' README'),
               concat('https://raw.githubusercontent.com/', full_name, '/', coalesce(default_branch, 'main'),
                      '/README.md'), coalesce(description, ''),
               least(5.5::DOUBLE, 1.5 + coalesce(stargazers_count, 0) / 18000.0::DOUBLE)
        FROM repo_items WHERE html_url <> '')"""


@query(f"WITH {_REPO} SELECT * REPLACE (round(score, 6) AS score) FROM repo", ("repo_items",))
def github_repo_candidates(t):
    rows = _numbered(payloads.github_repo_candidates(_repo_payload(t)))
    return rows.withColumn("score", F.round("score", 6))


def _code_payload(t):
    repository = F.when(
        F.col("full_name").isNotNull(), F.struct("full_name", F.col("repo_url").alias("html_url"))
    )
    item = F.struct("path", "html_url", repository.alias("repository"))
    text = F.to_json(F.array(item))
    return t("code_items").select("task_id", "seq", F.from_json(text, CODE_ITEMS).alias("items"))


_CODE = """scored AS (
        SELECT *, 2.0::DOUBLE + CASE WHEN regexp_matches(lower(path), '\\.(py|ts|js|go|java|rs|md)$') THEN 0.6 ELSE 0 END
               + CASE WHEN regexp_matches(lower(path), '/example|/docs') THEN 0.7 ELSE 0 END AS points
        FROM code_items WHERE full_name <> '' AND path <> ''),
    code AS (
        SELECT task_id, seq * 1048576 AS seq, concat(full_name, '/', path) AS title,
               CASE WHEN html_url <> '' THEN html_url ELSE concat(repo_url, '/blob/HEAD/', path) END AS url,
               concat('Code search match in ', path) AS snippet, points AS score FROM scored
        UNION ALL
        SELECT task_id, seq * 1048576 + 1, concat(full_name, '/', path, ' raw'),
               concat('https://raw.githubusercontent.com/', full_name, '/HEAD/', path),
               concat('Raw code content from ', path), points + 0.4 FROM scored)"""


@query(f"WITH {_CODE} SELECT * REPLACE (round(score, 6) AS score) FROM code", ("code_items",))
def github_code_candidates(t):
    rows = _numbered(payloads.github_code_candidates(_code_payload(t)))
    return rows.withColumn("score", F.round("score", 6))


ANSWER_SQL = f"""answer AS (
        SELECT q.task_id, q.seq,
               replace(replace(replace(replace(q.title, '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')
                   AS question_title,
               concat('https://stackoverflow.com/questions/', question_id) AS question_url,
               regexp_replace(replace(regexp_replace(body, '</?[a-zA-Z][^>]*>', chr(10), 'g'), '&lt;', '<'),
                              '^{WS}+|{WS}+$', '', 'g') AS answer_body,
               CAST(a.score AS BIGINT) AS score
        FROM questions q JOIN answers a ON a.answer_id = q.accepted_answer_id
        WHERE q.is_answered)"""


def answers_of(t):
    questions = t("questions").withColumn("tags", F.array(F.lit("python")))
    return payloads.stackoverflow_answers(questions, t("answers"))


@query(f"WITH {ANSWER_SQL} SELECT * FROM answer", ("questions", "answers"))
def stackoverflow_answers(t):
    return answers_of(t).select(
        "task_id", "seq", "question_title", "question_url", "answer_body",
        F.col("score").cast("bigint").alias("score"),
    )


_SELECT = f"""best AS (SELECT task_id, url, max(score) AS score, min(seq) AS seq FROM scored_urls
              GROUP BY task_id, url),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, seq) AS rank FROM best),
    wanted AS (SELECT ordered.*, max_sources, {DOMAIN} AS domain FROM ordered JOIN tasks USING (task_id)
               WHERE rank <= 2 * max_sources),
    spread AS (SELECT *, row_number() OVER (PARTITION BY task_id, domain ORDER BY rank) AS in_domain FROM wanted),
    placed AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY rank) AS place
               FROM spread WHERE in_domain <= 3),
    selected AS (SELECT task_id, CAST(place AS BIGINT) AS place, url, domain, round(score, 6) AS score
                 FROM placed WHERE place <= max_sources)"""


@query(
    f"""WITH {_HITS}, scored_urls AS (SELECT task_id, seq, url, score + {RANK} AS score FROM web), {_SELECT}
    SELECT * FROM selected""",
    ("hits", "tasks"),
)
def select_urls(t):
    hits = payloads.search_hits(t("hits"))
    scored = hits.withColumn("score", F.col("score") + U.url_rank(F.col("url")))
    return _placed(ranking.select_urls(scored, t("tasks")))


def _placed(selected):
    return selected.withColumn("score", F.round("score", 6)).withColumn(
        "place", F.col("place").cast("bigint")
    )


TERMS = f"""list_filter(regexp_extract_all(lower(task), '[a-z0-9_]+'),
                lambda w: length(w) > 2 AND w NOT IN ({quoted(K.STOP_WORDS)}))"""
_GATED = f"""task_words AS (SELECT task_id, max_sources, {TERMS} AS terms,
                 CASE WHEN allowed = '' THEN [] ELSE
                      [replace(lower(a), 'www.', '') FOR a IN string_split(allowed, ',')] END AS listed FROM tasks),
    candidate AS (
        SELECT 0 AS part, * FROM merged
        UNION ALL BY NAME
        SELECT 1 AS part, task_id, rank AS seq, title, url, snippet, score FROM (
            SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, first_seq) AS rank FROM (
                SELECT task_id, url, min(seq) AS first_seq, max(score) AS score,
                       arg_max(title, struct_pack(s := score, q := -seq)) AS title,
                       arg_max(snippet, struct_pack(s := score, q := -seq)) AS snippet
                FROM (SELECT * FROM repo UNION ALL SELECT * FROM code) GROUP BY task_id, url))
        JOIN tasks USING (task_id) WHERE rank <= max_sources),
    relevant AS (
        SELECT c.*, CASE WHEN len(terms) = 0 THEN 0.0 ELSE
               len(list_filter(terms, lambda w: contains(lower(title || ' ' || snippet), w)))::DOUBLE / len(terms)
               END AS relevance
        FROM candidate c JOIN task_words USING (task_id)
        WHERE len(listed) = 0 OR len(list_filter(listed, lambda a: {DOMAIN} = a OR ends_with({DOMAIN}, '.' || a))) > 0),
    scored_urls AS (
        SELECT task_id, part * 1000000000000 + seq AS seq, url, score + {RANK} + 2.5 * relevance AS score
        FROM relevant WHERE relevance >= CASE part WHEN 0 THEN 0.18 ELSE 0.16 END)"""


def tasks_with_domains(t):
    split = F.filter(F.split("allowed", ","), lambda a: a != "")
    return t("tasks").withColumn("allowed_domains", split)


def code_candidates(t):
    repositories = payloads.github_repo_candidates(_repo_payload(t))
    return repositories.unionByName(payloads.github_code_candidates(_code_payload(t)))


def _collected(t):
    return collect_urls(tasks_with_domains(t), payloads.search_hits(t("hits")), code_candidates(t))


_COLLECT = f"WITH {_HITS}, {_MERGED}, {_REPO}, {_CODE}, {_GATED}, {_SELECT}"
_COLLECT_USES = ("hits", "tasks", "repo_items", "code_items")


@query(f"{_COLLECT} SELECT * FROM selected", _COLLECT_USES)
def collected_urls(t):
    return _placed(_collected(t))


@query(
    f"""{_COLLECT} SELECT task_id, count(*) AS sources_found,
    round(count(DISTINCT domain)::DOUBLE / count(*), 6) AS content_diversity FROM selected GROUP BY task_id""",
    _COLLECT_USES,
)
def content_diversity(t):
    found = report.content_diversity(_collected(t))
    return found.withColumn("content_diversity", F.round("content_diversity", 6))
