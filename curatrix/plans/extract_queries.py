"""Registered queries on extraction: pages, markdown, code, references, practices, patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions import extract as X
from curatrix.operators import extraction, patterns
from curatrix.operators.assemble import pattern_rows
from curatrix.operators.rows import one_row_each
from curatrix.plans.registry import WS, query
from curatrix.plans.text_queries import line_list, stripped
from curatrix.sources.tables import pages_of_raw


def unescaped(text: str) -> str:
    for entity, character in [*X.ENTITIES, ("&amp;", "&")]:
        text = f"replace({text}, '{entity}', chr({ord(character)}))"
    return text


def cleaned(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def _steps(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    return text


_SIDE = [("(?s)<!--.*?-->", "''")] + [
    (rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "''") for tag in K.REMOVED_TAGS
]
_N = "chr(10)"
_MARKUP = (
    [(r"(?is)<pre(?:\s[^>]*)?>(.*?)</pre\s*>", f"{_N} || {_N} || '```' || {_N} || '\\1' || {_N} || '```' || {_N} || {_N}")]
    + [
        (rf"(?is)<h{i}(?:\s[^>]*)?>\s*(.*?)\s*</h{i}\s*>", f"{_N} || {_N} || '{'#' * i} \\1' || {_N} || {_N}")
        for i in range(1, 7)
    ]
    + [
        (r"""(?is)<a\s[^>]*?href=["'']([^"''>]*)["''][^>]*>([^<]*)</a\s*>""", r"'[\2](\1)'"),
        (r"(?is)<(?:b|strong)(?:\s[^>]*)?>([^<]*)</(?:b|strong)\s*>", r"'**\1**'"),
        (r"(?is)<(?:i|em)(?:\s[^>]*)?>([^<]*)</(?:i|em)\s*>", r"'*\1*'"),
        (r"(?is)<li(?:\s[^>]*)?>", f"{_N} || '* '"),
        (r"(?is)<br\s*/?>", _N),
        (r"(?is)</?(?:p|div|section|article|table|tr|ul|ol|blockquote)(?:\s[^>]*)?>", f"{_N} || {_N}"),
        (r"(?s)</?[a-zA-Z!][^>]*>", "''"),
    ]
)
_TIDY = [(r"[ \t]+\n", _N), (r"\n{3,}", f"{_N} || {_N}")]


def _inner(tag: str) -> str:
    return rf"nullif(regexp_extract(page, '(?is)<{tag}(?:\s[^>]*)?>(.*)</{tag}\s*>', 1), '')"


PAGE_TEXT = f"""sided AS (SELECT page_id, url, html, {_steps('html', _SIDE)} AS page FROM pages),
    mains AS (SELECT page_id, url, html,
              coalesce({_inner('article')}, {_inner('main')}, {_inner('body')}, page) AS main FROM sided),
    titled AS (SELECT *, coalesce(nullif({cleaned(unescaped("regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1), '(?s)</?[a-zA-Z!][^>]*>', '', 'g')"))}, ''), url) AS title FROM mains),
    texts AS (SELECT page_id, url, title, main,
              {stripped(_steps(unescaped(_steps('main', _MARKUP)), _TIDY))} AS markdown FROM titled),
    summed AS (SELECT *, substring({cleaned(f"array_to_string(({line_list('markdown')})[1:8], ' ')")}, 1, 400) AS summary FROM texts)"""


def _mains(t):
    return t("pages").withColumn("main", X.main_html(F.col("html")))


@query(f"WITH {PAGE_TEXT} SELECT page_id, title FROM titled")
def page_title(t):
    return t("pages").select("page_id", X.page_title(F.col("html"), F.col("url")).alias("title"))


@query(f"WITH {PAGE_TEXT} SELECT page_id, markdown FROM texts")
def html_to_text(t):
    return _mains(t).select("page_id", X.html_to_text(F.col("main")).alias("markdown"))


_HEADS = rf"""[{cleaned(unescaped("regexp_replace(h, '(?s)</?[a-zA-Z!][^>]*>', ' ', 'g')"))}
              FOR h IN regexp_extract_all(main, '(?is)<h[1-4](?:\s[^>]*)?>(.*?)</h[1-4]\s*>', 1)]"""


@query(
    f"""WITH {PAGE_TEXT}, h AS (SELECT page_id, list_filter({_HEADS}, lambda x: x <> '') AS hs FROM texts)
    SELECT page_id, unnest(range(1, len(hs) + 1)) AS no, unnest(hs) AS heading FROM h"""
)
def page_headings(t):
    found = _mains(t).select("page_id", F.posexplode(X.html_headings(F.col("main"))).alias("no", "heading"))
    return found.withColumn("no", (F.col("no") + 1).cast("bigint"))


@query(
    f"""WITH {PAGE_TEXT} SELECT page_id, url AS source, title, summary, markdown
    FROM summed"""
)
def extract_documents(t):
    docs = extraction.extract_documents(pages_of_raw(t("pages")))
    return docs.select("page_id", "source", "title", "summary", "markdown")


def _practices(text: str) -> str:
    words = " OR ".join(f"contains(lower(x), '{w}')" for w in K.PRACTICE_WORDS)
    return f"""list_filter([{stripped('x')} FOR x IN {line_list(text)}],
               lambda x: length(x) BETWEEN 40 AND 220 AND ({words}))"""


TIPS = f"""p AS (SELECT doc_id, {_practices('markdown')} AS ps FROM advice),
    tips AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS no, unnest(ps) AS practice FROM p)"""


@query(
    f"WITH {TIPS} SELECT * FROM tips",
    ("advice",),
)
def best_practices(t):
    rows = t("advice").select("doc_id", F.posexplode(X.best_practices(F.col("markdown"))).alias("no", "p"))
    return rows.select("doc_id", (F.col("no") + 1).cast("bigint").alias("no"), "p.practice")


_CALL = rf"(?:^|[^\p{{L}}\p{{N}}_])([a-zA-Z_][\p{{L}}\p{{N}}_.]{{2,}})\(([^)]*)\)"


REFERENCES = f"""c AS (SELECT doc_id, regexp_extract_all(markdown, '{_CALL}', 1) AS names,
                   regexp_extract_all(markdown, '{_CALL}', 2) AS args FROM calls),
    r AS (SELECT doc_id, unnest(range(1, len(names) + 1)) AS no, unnest(names) AS function, unnest(args) AS args FROM c)"""


@query(
    f"""WITH {REFERENCES}
    SELECT doc_id, no, function, string_split(function, '.')[1] AS library,
           'Usage pattern with arguments: (' || args || ')' AS description FROM r""",
    ("calls",),
)
def api_references(t):
    rows = t("calls").select("doc_id", F.posexplode(X.api_references(F.col("markdown"))).alias("no", "r"))
    return rows.select("doc_id", (F.col("no") + 1).cast("bigint").alias("no"), "r.*")


_FENCE = K.FENCE_PATTERN


@query(
    f"""WITH f AS (SELECT doc_id, regexp_extract_all(markdown, '{_FENCE}', 1) AS tags,
                   regexp_extract_all(markdown, '{_FENCE}', 2) AS bodies FROM fences),
    r AS (SELECT doc_id, unnest(tags) AS tag, unnest(bodies) AS body FROM f),
    s AS (SELECT doc_id, coalesce(nullif(lower(tag), ''), 'text') AS language, {stripped('body')} AS code FROM r)
    SELECT doc_id, language, code FROM s
    WHERE length(code) >= 40 AND len({line_list('code')}) >= 2""",
    ("fences",),
)
def fenced_snippets(t):
    rows = t("fences").select("doc_id", F.explode(X.fenced_snippets(F.col("markdown"))).alias("s"))
    return rows.select("doc_id", "s.*")


@query(
    rf"""WITH h AS (SELECT doc_id, list_filter([{cleaned('h')} FOR h IN
                    regexp_extract_all(markdown, '(?m)^(#{{1,4}}){WS}+(.+)$', 2)], lambda x: x <> '') AS hs FROM fences)
    SELECT doc_id, unnest(range(1, len(hs) + 1)) AS no, unnest(hs) AS heading FROM h""",
    ("fences",),
)
def markdown_headings(t):
    rows = t("fences").select("doc_id", F.posexplode(X.markdown_headings(F.col("markdown"))).alias("no", "heading"))
    return rows.withColumn("no", (F.col("no") + 1).cast("bigint"))


_YAML = rf"len(list_filter({line_list('code')}, lambda x: regexp_matches(x, '^{WS}*[\p{{L}}\p{{N}}_-]+{WS}*:')))"


@query(
    f"""SELECT doc_id, CASE
        WHEN contains(class_name, 'py') THEN 'python' WHEN contains(lower(class_name), 'js') THEN 'javascript'
        WHEN contains(class_name, 'shell') OR starts_with({stripped('code')}, '$') THEN 'bash'
        WHEN contains(lower(code), 'import ') AND contains(lower(code), 'def ') THEN 'python'
        WHEN contains(lower(code), 'const ') OR contains(lower(code), 'function ') THEN 'javascript'
        WHEN NOT contains(code, '{{') AND NOT contains(code, '}}') AND {_YAML} >= 3 THEN 'yaml'
        ELSE 'text' END AS language FROM blocks""",
    ("blocks",),
)
def guess_language(t):
    language = X.guess_language(F.col("class_name"), F.col("code"))
    return t("blocks").select("doc_id", language.alias("language"))


@query(
    f"""WITH b AS (SELECT doc_id, regexp_replace(code, '^[\\n ]+|[\\n ]+$', '', 'g') AS code FROM blocks)
    SELECT doc_id, unnest([1, 2])::BIGINT AS no, code FROM b
    WHERE length(code) >= 40 AND len({line_list('code')}) >= 2""",
    ("blocks",),
)
def html_snippets(t):
    """The code of every document as a pre block with a code block inside: two snippets each."""
    plain = F.regexp_replace("code", "&", "&amp;")
    safe = F.regexp_replace(F.regexp_replace(plain, "<", "&lt;"), ">", "&gt;")
    html = F.concat(
        F.lit("<article><pre><code class='"), F.col("class_name"), F.lit("'>"), safe,
        F.lit("</code></pre></article>"),
    )
    rows = one_row_each(t("blocks"), ["doc_id"], X.html_snippets(X.main_html(html)), "s", "no")
    return rows.select("doc_id", (F.col("no") + 1).cast("bigint").alias("no"), "s.code")


_RULES = ", ".join(
    f"('{kind}', '{K.PATTERN_TEXT[kind]}', {no}, "
    + "["
    + ", ".join(f"struct_pack(r := '{regex}', w := {weight})" for regex, weight in rules)
    + "])"
    for no, (kind, rules) in enumerate(K.PATTERN_RULES.items(), start=1)
)
PATTERNS = f"""rules(pattern_type, description, type_no, rs) AS (VALUES {_RULES}),
    matched AS (
        SELECT code.*, pattern_type, description, type_no,
               list_filter(rs, lambda x: regexp_matches(lower(code), '(?i)' || x.r)) AS ms FROM code, rules),
    detected AS (
        SELECT task_id, seq, source, code, pattern_type, description, type_no,
               least(1.0::DOUBLE, list_sum([m.w FOR m IN ms]) / 20.0::DOUBLE) AS confidence
        FROM matched WHERE len(ms) >= 2 AND list_sum([m.w FOR m IN ms]) > 10)"""


@query(
    f"""WITH {PATTERNS} SELECT seq, pattern_type, description, code AS code_snippet,
        round(confidence, 6) AS confidence FROM detected""",
    ("code",),
)
def detect_patterns(t):
    found = patterns.detect_patterns(t("code"))
    return found.select(
        "seq", "pattern_type", "description", "code_snippet", F.round("confidence", 6).alias("confidence")
    )


@query(
    f"""WITH {PATTERNS}, placed AS (
        SELECT *, row_number() OVER (PARTITION BY task_id, pattern_type ORDER BY confidence DESC, seq) AS place
        FROM detected)
    SELECT task_id, pattern_type, source, round_even(confidence, 3) AS confidence,
           code AS code_snippet FROM placed WHERE place = 1""",
    ("code",),
)
def best_patterns(t):
    best = pattern_rows(patterns.best_patterns(patterns.detect_patterns(t("code"))))
    return best.select("task_id", "pattern_type", "source", "confidence", "code_snippet")
