"""URL parts, ranks and host rules. [U1 - U3, F3, F8 - F10]"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions.text import contains_any, let, strip, text_or_empty

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def url_authority(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), _AUTHORITY, 1)


def url_domain(url: Column) -> Column:
    """[U1] Lower-case network location, every ``www.`` removed; port and user are kept."""
    return F.replace(F.lower(url_authority(url)), F.lit("www."), F.lit(""))


def url_origin(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path with its query, ``/`` if there is none; the fragment is left out."""
    path = F.regexp_extract(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def percent_decoded(text: Column) -> Column:
    """``%XX`` escapes as UTF-8 characters, U+FFFD where their bytes are none; a plus stays a plus, and
    a percent sign without two hex digits stays as it is."""
    plain = F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.url_decode(F.regexp_replace(plain, "%(?![0-9A-Fa-f]{2})", "%25"))


def url_hostname(url: Column) -> Column:
    """Host without user, port and brackets, lower case."""
    host = F.regexp_replace(url_authority(url), "^.*@", "")
    bracketed = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_replace(host, ":.*$", "")
    return F.lower(F.when(F.startswith(host, F.lit("[")), bracketed).otherwise(plain))


def url_rank(url: Column) -> Column:
    """[U2] Additive rank from site hints anywhere in the lower-case url."""
    def rank(lowered: Column) -> Column:
        total = F.lit(0.0)
        for needles, points in K.URL_RANK_RULES:
            hit = contains_any(lowered, needles)
            total = total + F.when(hit, F.lit(points)).otherwise(F.lit(0.0))
        return total

    return let(F.lower(text_or_empty(url)), rank)


def _inside(domain: Column, parent: Column) -> Column:
    return (domain == parent) | F.endswith(domain, F.concat(F.lit("."), parent))


def domain_boost(url: Column) -> Column:
    """[U3] Boost of the first preferred domain that is the url's domain or a parent of it."""

    def boost(domain: Column) -> Column:
        points = [F.when(_inside(domain, F.lit(d)), F.lit(p)) for d, p in K.PREFERRED_DOMAINS]
        return F.coalesce(*points, F.lit(0.0))

    return let(url_domain(url), boost)


def allowed_domain(url: Column, allowed: Column) -> Column:
    """An empty list allows all; otherwise the domain or one of its parents must be listed."""
    listed = let(
        url_domain(url),
        lambda domain: F.exists(
            allowed, lambda a: _inside(domain, F.replace(F.lower(a), F.lit("www."), F.lit("")))
        ),
    )
    return (F.coalesce(F.size(allowed), F.lit(0)) <= 0) | F.coalesce(listed, F.lit(False))


def _v4_number(host: Column) -> Column:
    """Dotted quad as one number; null if it is none. Octets take no leading zero."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    pattern = "^" + r"\.".join([octet] * 4) + "$"
    parts = [F.regexp_extract(host, pattern, i).try_cast("bigint") for i in range(1, 5)]
    return parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]


def _v4_private(number: Column) -> Column:
    def inside(n: Column) -> Column:
        private = F.lit(False)
        for base, bits in K.PRIVATE_V4:
            block = ipaddress.ip_network(f"{base}/{bits}")
            private = private | n.between(int(block[0]), int(block[-1]))
        return F.coalesce(private, F.lit(False))

    return let(number, inside)


def is_private_host(host: Column, strict: bool = False) -> Column:
    """Local names and literal addresses of private blocks; DNS names pass.

    ``strict`` also looks into IPv4 addresses written inside IPv6, which pass otherwise.
    """
    low = F.lower(host)
    first = F.lpad(F.regexp_extract(low, "^([0-9a-f]{1,4}):[0-9a-f:.]*$", 1), 4, "0")
    v6 = (
        low.rlike(r"^(0{0,4}:){1,7}0{0,3}1$")  # ::1 in its short and long spellings
        | first.rlike("^f[cd]..$")  # fc00::/7
        | first.rlike("^fe[89ab].$")  # fe80::/10
    )
    private = low.isin(K.LOCAL_NAMES) | _v4_private(_v4_number(low)) | v6
    if strict:
        mapped = F.regexp_extract(low, r"^::ffff:([0-9.]+)$", 1)
        private = private | _v4_private(_v4_number(mapped))
    return F.coalesce(private, F.lit(False))


def suspicious_pattern(text: Column) -> Column:
    """Position (from 1) of the first suspicious pattern in the text, null if there is none."""
    found = F.lit(None).cast("int")
    for number, pattern in enumerate(K.SUSPICIOUS_PATTERNS, start=1):
        found = F.coalesce(found, F.when(text.rlike("(?idU)" + pattern), F.lit(number)))
    return found


def url_error(url: Column, strict: bool = False) -> Column:
    """[F8] Why the url is refused, null if it is fine."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = url_hostname(url)
    return (
        F.when(url.isNull() | (strip(url) == ""), "empty")
        .when(F.length(url) > K.URL_MAX_CHARS, "too long")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host == "", "no hostname")
        .when(suspicious_pattern(url).isNotNull(), "suspicious pattern")
        .when(is_private_host(host, strict), "internal host")
    )


def domain_error(domain: Column) -> Column:
    """Why the domain is refused, null if it is fine."""
    return (
        F.when(domain.isNull() | (strip(domain) == ""), "empty")
        .when(F.length(domain) > K.DOMAIN_MAX_CHARS, "too long")
        .when(~domain.rlike("(?d)" + K.DOMAIN_PATTERN), "format")
    )


def normal_domain(domain: Column) -> Column:
    """The accepted form of a valid domain, null for others."""
    return F.when(domain_error(domain).isNull(), strip(F.lower(domain)))
