"""URL scalars: identities, resource kinds, helper links, status classes."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffixes, words and paths that decide a resource's kind, in order of precedence.
TRANSCRIPT_SUFFIXES = r"\.(vtt|srt|ttml|txt)$"
SLIDE_SUFFIXES = r"\.(ppt|pptx|odp|key)$"
BOOK_SUFFIXES = r"\.(epub|mobi)$"
BOOK_PATHS = "(/book|/books|/chapter|/chapters|/readings?|/textbook)"
VIDEO_HOSTS = r"(youtube|youtu\.be|bilibili|vimeo|coursera|edx|khanacademy|ocw|mit\.edu)"
VIDEO_PATHS = "(/watch|/video|/lecture|/lesson|/play)"
COURSE_PATHS = "(/course|/courses|/class|/classes|/syllabus|/module|/modules)"
DIRECT_KINDS = ["book", "book_pdf", "pdf", "slides", "transcript"]
NAVIGATION_LABELS = ["open menu", "site navigation", "站点导航"]
STATUSES = ["OK", "REDIRECT", "STALE_VERSION", "AUTH_REQUIRED", "PAYWALL", "ROBOTS_BLOCKED", "RATE_LIMITED", "TEMPORARY_FAILURE", "NOT_FOUND", "DOMAIN_GONE", "MANUAL_REVIEW"]
TRAILING_MARKS = ",.;:!?，。；：！？、)（）】》」』\"'`"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """The path, also of a relative reference."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def resource_kind(url: Column, label: Column) -> Column:
    """Kind of a learning resource; the first rule that fits decides."""
    path = F.lower(url_path(url))
    text = F.lower(F.concat_ws(" ", url, F.coalesce(label, F.lit(""))))
    says = lambda *words: text.rlike("|".join(words))
    book = path.rlike(BOOK_PATHS) | says("book", "chapter")
    return (
        F.when(path.rlike(TRANSCRIPT_SUFFIXES) | says("transcript", "caption"), "transcript")
        .when(path.rlike(SLIDE_SUFFIXES) | says("slide", "ppt"), "slides")
        .when(path.rlike(BOOK_SUFFIXES), "book")
        .when(path.endswith(".pdf"), F.when(book, "book_pdf").otherwise("pdf"))
        .when(url_host(url).rlike(VIDEO_HOSTS) | path.rlike(VIDEO_PATHS) | says("video", "lecture"), "video")
        .when(book | says("reading"), "book_or_chapter")
        .when(path.rlike(COURSE_PATHS) | says("course", "syllabus"), "course_page")
        .otherwise("web_page")
    )


def provenance_helper(url: Column, label: Column, kind: Column) -> Column:
    """Links that document a collection and are no study material: static bundles, API endpoints, navigation."""
    path, text = F.lower(url_path(url)), F.lower(F.trim(F.coalesce(label, F.lit(""))))
    name = F.regexp_extract(path, "([^/]*)$", 1)
    bundle = path.rlike(r"\.(js|mjs|cjs|css|map|wasm)$") & (
        text.rlike(r"\bbundle\b|\bsource\s+map\b|\bstylesheet\b|\b(?:webassembly|wasm)\s+module\b|\bstatic\s+(?:asset|script)\b")
        | (((text == "") | (text == name)) & name.rlike(r"^(?:app|main|bundle|runtime|vendor|webpack)(?:[._-][a-z0-9]+)*\.(?:js|mjs|cjs|css|map|wasm)$"))
    )
    api = (path.rlike("(?:^|/)(?:api|graphql|wp-json)(?:/|$)") | url_host(url).rlike(r"^api\.|\.api\.")) & text.rlike(r"\b(?:api|endpoint|graphql)\b|接口|端点")
    return ~kind.isin(DIRECT_KINDS) & (bundle | api | ((kind == "web_page") & text.isin(NAVIGATION_LABELS)))


def audit_form(url: Column) -> Column:
    """Trailing marks and fragment off, scheme and host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "[" + TRAILING_MARKS + "]+$", ""), "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def status_class(code: Column, url: Column | None = None, final_url: Column | None = None, robots: Column | None = None) -> Column:
    """Audit status of an HTTP code.

    A good answer from another URL (in audit form) is a redirect; ``robots``
    holds the headers that may name a robot rule, which decides what 403 means.
    """
    moved = F.lit(False) if final_url is None else F.coalesce(audit_form(final_url) != audit_form(url), F.lit(False))
    barred = F.lit(False) if robots is None else F.coalesce(F.lower(robots).contains("robot"), F.lit(False))
    return (
        F.when(code.isNull(), "MANUAL_REVIEW")
        .when(code.between(200, 299), F.when(moved, "REDIRECT").otherwise("OK"))
        .when(code.isin(301, 302, 303, 307, 308), "REDIRECT")
        .when(code == 401, "AUTH_REQUIRED")
        .when(code == 402, "PAYWALL")
        .when(code == 403, F.when(barred, "ROBOTS_BLOCKED").otherwise("MANUAL_REVIEW"))
        .when(code == 429, "RATE_LIMITED")
        .when(code == 404, "NOT_FOUND")
        .when(code == 410, "DOMAIN_GONE")
        .when(code.between(500, 599), "TEMPORARY_FAILURE")
        .otherwise("MANUAL_REVIEW")
    )


def prose_urls(text: Column) -> Column:
    """Distinct URLs of a text in audit form, cut at CJK characters and closing marks."""
    raw = F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s<>'\"\]\[|\u3400-\u9fff)}）】》」』：；，。！？、]+"), F.lit(0))
    return F.array_distinct(F.transform(raw, audit_form))


# What stands for itself in a path, and besides in a query or fragment; escapes of the unreserved characters.
_ITSELF, _ALSO = r"A-Za-z0-9_.~/:@!$&'()*+,;=\-", "?"
_UNRESERVED = "2[DE]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE]"
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _escaped(text: Column, itself: str) -> Column:
    """A part of a URL with each character either as itself or as an escape in upper case."""
    coded = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    shown = lambda t: F.when(t.rlike(f"^[{itself}]*$"), t).otherwise(F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.rlike(f"^[{itself}]*$"), c).otherwise(coded(c))), ""))
    code = lambda piece: F.upper(F.substring(piece, 1, 2))
    kept = lambda piece: F.when(code(piece).rlike(f"^(?:{_UNRESERVED})$"), F.char(F.conv(code(piece), 16, 10).cast("long"))).otherwise(F.concat(F.lit("%"), code(piece)))
    pieces = F.split(text, "%")
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(kept(p), shown(F.substr(p, F.lit(3))))).otherwise(F.concat(F.lit("%"), shown(p))))
    return F.concat(shown(pieces[0]), F.array_join(rest, ""))


def url_identity(url: Column | str) -> Column:
    """Lower scheme and host; only unreserved escapes decoded, the others in upper case.

    Null stays null; a text without a scheme is only trimmed; an empty query or fragment is dropped.
    """
    column = F.col(url) if isinstance(url, str) else url
    text = F.regexp_replace(F.regexp_replace(column, r"(?U)\A[\s\x00-\x1f]+|\s+\z", ""), "[\t\r\n]", "")
    part = lambda k: F.regexp_extract(text, _PARTS, k)
    user = F.regexp_extract(part(2), "(?s)^(//.*@|//)?", 1)
    place = F.concat(user, F.lower(F.substr(part(2), F.length(user) + 1)))
    query = F.when(F.length(part(4)) > 1, _escaped(part(4), _ITSELF + _ALSO)).otherwise("")
    fragment = F.when(F.length(part(5)) > 1, F.concat(F.lit("#"), _escaped(F.substr(part(5), F.lit(2)), _ITSELF + _ALSO))).otherwise("")
    return F.when(text.rlike(_PARTS), F.concat(F.lower(part(1)), F.lit(":"), place, _escaped(part(3), _ITSELF), query, fragment)).otherwise(text)


@F.pandas_udf(T.StringType())
def resolved_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` as seen from ``base``; null if it cannot be read."""

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return None if h is None else urljoin(b or "", h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])


def _requested(value: str) -> str:
    parts = urlsplit(value)
    try:
        host = (parts.hostname or "").encode("idna").decode("ascii")
    except UnicodeError:
        host = parts.netloc
    try:
        place = host if parts.port is None else f"{host}:{parts.port}"
    except ValueError:
        place = parts.netloc
    return urlunsplit((parts.scheme, place, quote(parts.path, safe="/%:@!$&'()*+,;=-._~"), quote(parts.query, safe="!$&'()*+,;=:/?@%_-."), ""))


@F.pandas_udf(T.StringType())
def request_form(url: pd.Series) -> pd.Series:
    """The URL as a request sends it: an ASCII host, path and query escaped, no fragment or user."""
    return url.map(lambda x: None if x is None else _requested(x))
