"""HTML and markdown to text, headings, code, references and practices. [E2 - E10, E12]"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions.text import (
    at_most,
    clean_text,
    contains_any,
    first_items,
    let,
    lines,
    strip,
    text_or_empty,
)

# Named entities that web prose uses; & itself is undone last. Fixed values.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"),
    ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&euro;", "€"),
    ("&times;", "×"), ("&deg;", "°"), ("&larr;", "←"), ("&rarr;", "→"),
]


def _code_point(piece: Column) -> Column:
    """Text after ``&#``: a leading ``decimal;`` or ``xhex;`` becomes its character."""
    decimal = F.regexp_extract(piece, "^([0-9]{1,7});", 1)
    hexa = F.regexp_extract(piece, "^[xX]([0-9a-fA-F]{1,6});", 1)
    number = F.when(decimal != "", decimal.cast("bigint")).when(
        hexa != "", F.conv(hexa, 16, 10).cast("bigint")
    )
    legal = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    rest = F.regexp_replace(piece, "^[0-9xXa-fA-F]{1,7};", "")
    return F.when(legal, F.concat(character, rest)).otherwise(F.concat(F.lit("&#"), piece))


def unescape_html(text: Column) -> Column:
    """Numeric and common named entities to characters. Text without any is looked through once."""

    def numeric(pieces: Column) -> Column:
        return F.concat(
            pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), _code_point), "")
        )

    def named(plain: Column) -> Column:
        for entity, character in ENTITIES:
            plain = F.replace(plain, F.lit(entity), F.lit(character))
        return F.replace(plain, F.lit("&amp;"), F.lit("&"))

    def unescaped(t: Column) -> Column:
        decoded = F.when(F.contains(t, F.lit("&#")), let(F.split(t, "&#"), numeric)).otherwise(t)
        return F.when(F.contains(t, F.lit("&")), named(decoded)).otherwise(t)

    return let(text, unescaped)


def strip_tags(html: Column, glue: str) -> Column:
    return F.regexp_replace(html, "(?s)</?[a-zA-Z!][^>]*>", glue)


def _tag(name: str) -> str:
    return rf"<(?:{name})(?:\s[^>]*)?>"


def main_html(html: Column) -> Column:
    """The article, else main, else body, else all of the page; scripts and side blocks removed."""
    html = F.regexp_replace(text_or_empty(html), "(?s)<!--.*?-->", "")
    for tag in K.REMOVED_TAGS:
        html = F.regexp_replace(html, rf"(?is){_tag(tag)}.*?</{tag}\s*>", "")

    def choose(page: Column) -> Column:
        found = [
            F.nullif(F.regexp_extract(page, rf"(?is){_tag(name)}(.*)</{name}\s*>", 1), F.lit(""))
            for name in ("article", "main", "body")
        ]
        return F.coalesce(*found, page)

    return let(html, choose)


def page_title(html: Column, url: Column) -> Column:
    """[E3] Cleaned title, else the url."""
    raw = F.regexp_extract(text_or_empty(html), r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)
    title = clean_text(unescape_html(strip_tags(raw, "")))
    return F.coalesce(F.nullif(title, F.lit("")), url)


def html_headings(main: Column) -> Column:
    """[E4] Cleaned, non-empty h1 - h4 of the main html."""
    found = F.regexp_extract_all(
        main, F.lit(r"(?is)<h[1-4](?:\s[^>]*)?>(.*?)</h[1-4]\s*>"), F.lit(1)
    )
    cleaned = F.transform(found, lambda h: clean_text(unescape_html(strip_tags(h, " "))))
    return F.filter(cleaned, lambda h: h != "")


def html_to_text(main: Column) -> Column:
    """[E2] Main html as light markdown: ATX headings, fences, links, bullets, blank-line blocks."""
    text = F.regexp_replace(main, rf"(?is){_tag('pre')}(.*?)</pre\s*>", "\n\n```\n$1\n```\n\n")
    for level in (1, 2, 3, 4, 5, 6):
        mark = "#" * level
        text = F.regexp_replace(
            text, rf"(?is){_tag(f'h{level}')}\s*(.*?)\s*</h{level}\s*>", f"\n\n{mark} $1\n\n"
        )
    text = F.regexp_replace(
        text, r"(?is)<a\s[^>]*?href=[\"']([^\"'>]*)[\"'][^>]*>([^<]*)</a\s*>", "[$2]($1)"
    )
    text = F.regexp_replace(text, rf"(?is){_tag('b|strong')}([^<]*)</(?:b|strong)\s*>", "**$1**")
    text = F.regexp_replace(text, rf"(?is){_tag('i|em')}([^<]*)</(?:i|em)\s*>", "*$1*")
    text = F.regexp_replace(text, rf"(?is){_tag('li')}", "\n* ")
    text = F.regexp_replace(text, r"(?is)<br\s*/?>", "\n")
    text = F.regexp_replace(
        text, r"(?is)</?(?:p|div|section|article|table|tr|ul|ol|blockquote)(?:\s[^>]*)?>", "\n\n"
    )
    text = unescape_html(strip_tags(text, ""))
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def answer_text(body: Column) -> Column:
    """[E12] Answer html to plain text."""
    return strip(unescape_html(strip_tags(text_or_empty(body), "\n")))


def markdown_headings(markdown: Column) -> Column:
    """[E4] Cleaned ATX headings of level 1 - 4."""
    found = F.regexp_extract_all(markdown, F.lit("(?dU)" + K.MD_HEADING_PATTERN), F.lit(2))
    return F.filter(F.transform(found, clean_text), lambda h: h != "")


def guess_language(class_name: Column, code: Column) -> Column:
    """[E7] Ordered rules on the class name, then on the code."""
    def by_name(name: Column) -> Column:
        return (
            F.when(contains_any(name, ["python", "py"]), "python")
            .when(contains_any(name, ["javascript", "js"]), "javascript")
            .when(contains_any(name, ["bash", "shell"]) | F.startswith(strip(code), F.lit("$")), "bash")
            .when(contains_any(name, ["yaml", "yml"]), "yaml")
        )

    def by_code(low: Column) -> Column:
        return F.when(
            contains_any(low, ["import "]) & contains_any(low, ["def "]), "python"
        ).when(contains_any(low, ["const ", "function "]), "javascript")

    keys = F.size(F.filter(lines(code), lambda x: x.rlike(r"(?U)^\s*[\w-]+\s*:")))
    yaml = F.when(~contains_any(code, ["{", "}"]) & (keys >= 3), "yaml")
    return F.coalesce(
        let(F.lower(text_or_empty(class_name)), by_name),
        let(F.lower(code), by_code),
        yaml,
        F.lit("text"),
    )


def _long_enough(code: Column) -> Column:
    return (F.length(code) >= 40) & (F.size(lines(code)) >= 2)


def html_snippets(main: Column, max_chars: int | None = None) -> Column:
    """[E5] Every pre and every code block of the main html in page order, a nested one after
    the block around it, as array<struct<language, code>>."""
    # Only the opening < is consumed, so that blocks inside a block are found as well.
    # Attributes hold no >, so they and the body are found as one.
    pattern = F.lit(r"(?is)<(?=(pre|code)((?:\s[^>]*)?>.*?)</\1\s*>)")
    blocks = F.regexp_extract_all(main, pattern, F.lit(2))

    def snippet(block: Column) -> Column:
        attributes = F.substring_index(block, ">", 1)
        name = F.regexp_extract(attributes, r"(?i)class=[\"']([^\"']*)[\"']", 1)
        body = F.substring(block, F.length(attributes) + 2, F.length(block))
        code = F.regexp_replace(unescape_html(strip_tags(body, "\n")), r"^[\n ]+|[\n ]+\z", "")
        return let(
            code,
            lambda c: F.struct(
                guess_language(name, c).alias("language"),
                at_most(c, max_chars).alias("code"),
                _long_enough(c).alias("keep"),
            ),
        )

    return _kept(F.transform(blocks, snippet))


def _kept(snippets: Column) -> Column:
    return F.transform(
        F.filter(snippets, lambda s: s["keep"]),
        lambda s: F.struct(s["language"].alias("language"), s["code"].alias("code")),
    )


def fenced_snippets(markdown: Column, max_chars: int | None = None) -> Column:
    """[E6] Fenced blocks of at least 40 characters and 2 lines, as array<struct<language, code>>."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(markdown, F.lit(K.FENCE_PATTERN), F.lit(1)).alias("tag"),
        F.regexp_extract_all(markdown, F.lit(K.FENCE_PATTERN), F.lit(2)).alias("body"),
    )
    return _kept(
        F.transform(
            pairs,
            lambda p: let(
                strip(p["body"]),
                lambda c: F.struct(
                    F.coalesce(F.nullif(F.lower(p["tag"]), F.lit("")), F.lit("text")).alias("language"),
                    at_most(c, max_chars).alias("code"),
                    _long_enough(c).alias("keep"),
                ),
            ),
        )
    )


def api_references(markdown: Column, limit: int | None = None) -> Column:
    """[E8] ``name(args)`` calls in text order as array<struct<library, function, description>>."""
    pattern = F.lit("(?U)" + K.CALL_PATTERN)
    calls = F.arrays_zip(
        F.regexp_extract_all(markdown, pattern, F.lit(1)).alias("name"),
        F.regexp_extract_all(markdown, pattern, F.lit(2)).alias("args"),
    )
    return F.transform(
        first_items(calls, limit),
        lambda c: F.struct(
            F.substring_index(c["name"], ".", 1).alias("library"),
            c["name"].alias("function"),
            F.concat(F.lit("Usage pattern with arguments: ("), c["args"], F.lit(")")).alias(
                "description"
            ),
        ),
    )


def best_practices(markdown: Column, limit: int | None = None, max_chars: int | None = None) -> Column:
    """[E9] Lines of 40 to 220 characters that give advice, as array<struct<practice, reason>>."""

    def advises(line: Column) -> Column:
        advice = let(F.lower(line), lambda low: contains_any(low, K.PRACTICE_WORDS))
        return F.length(line).between(40, 220) & advice

    found = F.filter(F.transform(lines(markdown), strip), advises)
    return F.transform(
        first_items(found, limit),
        lambda x: F.struct(
            at_most(x, max_chars).alias("practice"), F.lit(K.PRACTICE_REASON).alias("reason")
        ),
    )


def summary(markdown: Column, n_lines: int = 8, max_chars: int = 400) -> Column:
    """[E10] The first lines, cleaned: a summary is short by its purpose."""
    head = F.array_join(F.slice(lines(markdown), 1, n_lines), " ")
    return F.substring(clean_text(head), 1, max_chars)
