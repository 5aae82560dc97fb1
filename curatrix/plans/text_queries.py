"""Registered queries on text: normalisation, hashes, redaction, chunking, near duplicates, cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions import text as X
from curatrix.operators import cache, filters, neardup
from curatrix.operators.chunking import chunk_documents
from curatrix.plans.registry import LINE, NOT_WORD, TOKEN, WS, query


def norm(text: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower({text}), '{WS}+', ' ', 'g'), '{NOT_WORD}', '', 'g'))"
    )


def tokens(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{TOKEN}')) AS BIGINT)"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def line_list(text: str) -> str:
    body = f"regexp_replace({text}, '(?:{LINE})$', '')"
    return f"CASE WHEN {text} = '' THEN [] ELSE string_split_regex({body}, '{LINE}') END"


@query(f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def normalize_text(t):
    return t("documents").select("doc_id", X.normalize_text(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(t):
    return t("documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, substring(sha256({norm('text')}), 1, 16) AS content_hash FROM documents")
def content_hash(t):
    return t("documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {norm('text')}")
def exact_dedup(t):
    return neardup.exact_dedup(t("documents"), "text", "doc_id").select("doc_id")


@query(
    f"""SELECT min(doc_id) AS doc_id, count(*) AS copies, substring(sha256({norm('text')}), 1, 16) AS content_hash
    FROM documents GROUP BY {norm('text')}"""
)
def exact_groups(t):
    return neardup.exact_groups(t("documents"), "text", "doc_id")


_SHINGLED = f"""normed AS MATERIALIZED (SELECT doc_id, {norm('text')} AS norm FROM documents),
    words AS (SELECT doc_id, norm, list_filter(string_split(norm, ' '), lambda w: w <> '') AS w FROM normed),
    shingled AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < 5 THEN [norm] ELSE
                 list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS sh FROM words)"""


@query(f"WITH {_SHINGLED} SELECT doc_id, CAST(len(sh) AS BIGINT) AS shingles FROM shingled")
def shingle_counts(t):
    hashed = X.shingle_hashes(F.col("text"))
    return t("documents").select("doc_id", F.size(hashed).cast("bigint").alias("shingles"))


@query(
    f"""WITH {_SHINGLED}
    SELECT doc_id, unnest(sh) AS shingle FROM shingled""",
)
def shingles(t):
    return t("documents").select("doc_id", F.explode(X.shingles(F.col("text"))).alias("shingle"))


@query(
    f"""WITH {_SHINGLED}, pairs AS (
        SELECT a.doc_id AS doc_id, len(list_intersect(a.sh, b.sh)) AS shared, len(a.sh) AS n, len(b.sh) AS m
        FROM shingled a JOIN shingled b ON b.doc_id = a.doc_id + 1),
    scored AS (SELECT doc_id, shared::DOUBLE / (n + m - shared) AS j FROM pairs)
    SELECT doc_id, round(j, 6) AS jaccard, j >= 0.85 AS duplicate FROM scored"""
)
def neighbour_similarity(t):
    prints = t("documents").select("doc_id", X.fingerprint(F.col("text")).alias("fp"))
    following = prints.select((F.col("doc_id") - 1).alias("doc_id"), F.col("fp").alias("fp_next"))
    return prints.join(following, "doc_id").select(
        "doc_id",
        F.round(X.jaccard(F.col("fp.shingle_hashes"), F.col("fp_next.shingle_hashes")), 6).alias("jaccard"),
        X.is_duplicate(F.col("fp"), F.col("fp_next")).alias("duplicate"),
    )


def greedy(source: str, key: str, text: str = "text") -> str:
    """CTEs ``edges`` (similar first rows) and ``dropped``: the greedy rule, row by row."""
    return f"""firsts AS MATERIALIZED (SELECT min({key}) AS id, {norm(text)} AS norm FROM {source} GROUP BY 2),
    w AS (SELECT id, norm, list_filter(string_split(norm, ' '), lambda x: x <> '') AS w FROM firsts),
    sh AS MATERIALIZED (SELECT id, unnest(CASE WHEN len(w) < 5 THEN [norm] ELSE
           list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS s FROM w),
    sizes AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
    shared AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
    edges AS MATERIALIZED (SELECT a, b, o::DOUBLE / (x.n + y.n - o) AS jaccard FROM shared
              JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE o::DOUBLE / (x.n + y.n - o) >= 0.85),
    nodes AS MATERIALIZED (SELECT b AS id, list(a) AS earlier, row_number() OVER (ORDER BY b) AS step FROM edges GROUP BY b),
    walk AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS gone
             UNION ALL
             SELECT n.step, CASE WHEN len(list_filter(n.earlier, lambda x: NOT list_contains(gone, x))) > 0
                            THEN list_append(gone, n.id) ELSE gone END
             FROM walk JOIN nodes n ON n.step = walk.step + 1),
    dropped AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY step DESC LIMIT 1))"""


@query(
    f"""WITH RECURSIVE {greedy('documents', 'doc_id')}
    SELECT id AS doc_id FROM firsts WHERE id NOT IN (SELECT id FROM dropped)"""
)
def near_dedup(t):
    return neardup.near_dedup(t("documents"), "text", "doc_id").select("doc_id")


@query(
    f"""WITH RECURSIVE {greedy('documents', 'doc_id')}
    SELECT b AS doc_id, min(a) AS kept_doc_id, round(arg_min(jaccard, a), 6) AS jaccard FROM edges
    WHERE b IN (SELECT id FROM dropped) AND a NOT IN (SELECT id FROM dropped) GROUP BY b"""
)
def near_dup_matches(t):
    found = neardup.near_dup_matches(t("documents"), "text", "doc_id")
    return found.withColumn("jaccard", F.round("jaccard", 6))


def _redacted(text: str) -> str:
    for pattern, mask in K.SECRET_PATTERNS:
        escaped = pattern.replace(r"\s", WS).replace("'", "''")
        text = f"regexp_replace({text}, '{escaped}', '{mask}', 'g')"
    return text


@query(f"SELECT doc_id, {_redacted('text')} AS text FROM documents")
def redact_secrets(t):
    return t("documents").select("doc_id", X.redact_secrets(F.col("text")).alias("text"))


@query(
    f"""SELECT doc_id, {_redacted('msg')} AS msg, k,
        CASE WHEN k = 'Token' AND length(v) > 4 THEN left(v, 4) || '...[REDACTED]' ELSE v END AS v,
        left(v, 4) || CASE WHEN length(v) > 4 THEN '...[REDACTED]' ELSE '' END AS secret,
        {_redacted('item')} AS item FROM log_rows""",
    ("log_rows",),
)
def redact_fields(t):
    rows = t("log_rows").select(
        "doc_id",
        "msg",
        "k",
        F.create_map("k", "v").alias("fields"),
        F.struct(F.col("v").alias("secret"), F.array("item").alias("items")).alias("nested"),
    )
    return filters.redact_fields(rows).select(
        "doc_id",
        "msg",
        "k",
        F.col("fields")[F.col("k")].alias("v"),
        "nested.secret",
        F.col("nested.items")[0].alias("item"),
    )


_SPAM = " OR ".join(f"contains(lower(text), '{p}')" for p in K.SPAM_PHRASES)


@query(
    f"""WITH d AS (SELECT doc_id, replace(text, ' ist ', ' Click Here ') AS text FROM documents)
    SELECT doc_id, {_SPAM} AS spam FROM d"""
)
def is_seo_spam(t):
    text = F.replace(F.col("text"), F.lit(" ist "), F.lit(" Click Here "))
    return t("documents").select("doc_id", X.is_seo_spam(text).alias("spam"))


@query(
    f"""SELECT conv_id, count(*) AS turns, CAST(sum({tokens('text')}) AS BIGINT) AS tokens
    FROM conversations GROUP BY conv_id"""
)
def chat_token_counts(t):
    return t("conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum(X.token_count(F.col("text"))).cast("bigint").alias("tokens"),
    )


def folded(units: str, budget: str) -> str:
    """CTE ``chunked(doc, chunk_no, text)`` by walking ``units(doc, pos, text, tokens, grp)`` of
    all documents in step, one unit at a time."""
    return f"""fold AS (
        SELECT doc, pos, 0::BIGINT AS chunk_no, tokens AS total, grp FROM {units} WHERE pos = 1
        UNION ALL
        SELECT u.doc, u.pos,
               CASE WHEN u.grp <> fold.grp OR fold.total + u.tokens > {budget} THEN chunk_no + 1 ELSE chunk_no END,
               CASE WHEN u.grp <> fold.grp OR fold.total + u.tokens > {budget} THEN u.tokens ELSE fold.total + u.tokens END,
               u.grp
        FROM fold JOIN {units} u ON u.doc = fold.doc AND u.pos = fold.pos + 1),
    chunked AS (
        SELECT fold.doc, chunk_no,
               CASE WHEN u.grp = 0 THEN string_agg(u.text, chr(10) || chr(10) ORDER BY fold.pos)
                    ELSE string_agg(u.text, chr(10) ORDER BY fold.pos) END AS text
        FROM fold JOIN {units} u ON u.doc = fold.doc AND u.pos = fold.pos GROUP BY fold.doc, chunk_no, u.grp)"""


def units_of(source: str, key: str, budget: str) -> str:
    """CTE ``units`` of the texts of ``source``: paragraphs, or the lines of an oversized one."""
    return f"""paragraphs AS (
        SELECT doc, text, row_number() OVER (PARTITION BY doc ORDER BY pos) AS place FROM (
            SELECT doc, {stripped('raw')} AS text, pos FROM (
                SELECT {key} AS doc, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS pos
                FROM (SELECT {key}, string_split(text, chr(10) || chr(10)) AS parts FROM {source})))
        WHERE text <> ''),
    pieces AS (
        SELECT doc, place, 1 AS line, text, {tokens('text')} AS tokens, 0 AS grp FROM paragraphs
        WHERE {tokens('text')} <= {budget}
        UNION ALL
        SELECT doc, place, line, text, {tokens('text')}, place FROM (
            SELECT doc, place, unnest(parts) AS text, unnest(range(1, len(parts) + 1)) AS line
            FROM (SELECT doc, place, {line_list('text')} AS parts FROM paragraphs WHERE {tokens('text')} > {budget}))),
    units AS MATERIALIZED (
        SELECT doc, text, tokens, grp, row_number() OVER (PARTITION BY doc ORDER BY place, line) AS pos FROM pieces)"""


@query(
    f"""WITH RECURSIVE {units_of('documents', 'doc_id', '500')}, {folded('units', '500')}
    SELECT doc AS doc_id, chunk_no, text, {tokens('text')} AS tokens FROM chunked"""
)
def chunk_lines(t):
    return _typed(chunk_documents(t("documents").select("doc_id", "text")))


def _typed(chunks):
    return chunks.withColumn("chunk_no", F.col("chunk_no").cast("bigint")).withColumn(
        "tokens", F.col("tokens").cast("bigint")
    )


# A turn's lines as paragraphs.
_TURNS = """turns AS (SELECT conv_id * 1000000 + turn AS id, replace(text, chr(10), chr(10) || chr(10)) AS text
             FROM conversations)"""


@query(
    f"""WITH RECURSIVE {_TURNS}, {units_of('turns', 'id', '40')}, {folded('units', '40')}
    SELECT doc AS id, chunk_no, text, {tokens('text')} AS tokens FROM chunked"""
)
def chunk_paragraphs(t):
    turns = t("conversations").select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("id"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )
    return _typed(chunk_documents(turns, "text", 40))


@query(
    """SELECT doc_id, 'page_' || substring(sha256(text), 1, 16) AS page_key,
       'emb_' || substring(sha256(text), 1, 16) AS embedding_key,
       'task_' || substring(sha256(text || '_' || sha256(lang || '|' || source || '|a,b|' || n_chars)), 1, 16) AS task_key
       FROM documents"""
)
def cache_keys(t):
    config = X.config_hash("lang", "source", F.array_join(F.array(F.lit("a"), F.lit("b")), ","), F.col("n_chars").cast("string"))
    return t("documents").select(
        "doc_id",
        X.cache_key("page", F.col("text")).alias("page_key"),
        X.embedding_cache_key(F.col("text")).alias("embedding_key"),
        X.task_cache_key(F.col("text"), config).alias("task_key"),
    )


_CACHE = """latest AS (SELECT key, max(cached_at) AS cached_at,
                   max(struct_pack(c := cached_at, p := payload)).p AS payload FROM cache_rows GROUP BY key),
    fresh AS (SELECT * FROM latest WHERE cached_at >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND)"""


def _split(t):
    now = t("events").agg(F.max("ts")).scalar()
    return cache.cache_split(
        t("cache_requests"), cache.latest_entries(t("cache_rows")), now, K.TASK_TTL_SECONDS
    )


@query(
    f"WITH {_CACHE} SELECT key, cached_at, payload FROM fresh JOIN cache_requests USING (key)",
    ("cache_rows", "cache_requests"),
)
def cache_hits(t):
    return _split(t)[0].withColumn("cached_at", F.col("cached_at").cast("timestamp_ntz"))


@query(
    f"WITH {_CACHE} SELECT key FROM cache_requests WHERE key NOT IN (SELECT key FROM fresh)",
    ("cache_rows", "cache_requests"),
)
def cache_misses(t):
    return _split(t)[1]


@query(
    f"""WITH {_CACHE}, n AS (SELECT count(*) AS hits, (SELECT count(*) FROM cache_requests) - count(*) AS misses
        FROM fresh JOIN cache_requests USING (key))
    SELECT hits, misses, round_even(hits::DOUBLE / greatest(hits + misses, 1), 3) AS hit_rate FROM n""",
    ("cache_rows", "cache_requests"),
)
def cache_hit_rate(t):
    hits, misses = _split(t)
    both = hits.select(F.lit(1).alias("hit")).unionAll(misses.select(F.lit(0).alias("hit")))
    counted = both.agg(
        F.count_if(F.col("hit") == 1).alias("hits"), F.count_if(F.col("hit") == 0).alias("misses")
    )
    return counted.withColumn("hit_rate", cache.hit_rate(F.col("hits"), F.col("misses")))
