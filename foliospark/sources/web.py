"""Web pages: titles, descriptions, anchors, learning links."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import urls

ANCHOR = r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
LOGIN = r"(?i)<input[^>]+type=[\"']password|\b(sign\s*in|log\s*in|login|required\s+login)\b|登录|登入"


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.description, self.canonical, self.anchors = "", "", "", []
        self._in_title, self._open = False, None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "title":
            self._in_title = True
        elif tag == "meta" and given.get("name", "").lower() == "description":
            self.description = self.description or given.get("content", "")
        elif tag == "link" and "canonical" in given.get("rel", "").lower().split():
            self.canonical = self.canonical or given.get("href", "")
        elif tag == "a" and given.get("href"):
            self._open = [given["href"], ""]

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        if self._open:
            self._open[1] += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self._in_title = False
        elif tag == "a" and self._open:
            self.anchors.append({"href": self._open[0], "label": " ".join(self._open[1].split())})
            self._open = None


PAGE = T.StructType().add("title", T.StringType()).add("description", T.StringType()).add("canonical", T.StringType()).add("anchors", T.ArrayType(T.StructType().add("href", T.StringType()).add("label", T.StringType())))


@F.pandas_udf(PAGE)
def parsed_html(html: pd.Series) -> pd.DataFrame:
    """Title, meta description, canonical link and anchors of tolerant HTML."""
    rows = []
    for text in html:
        reader = _Reader()
        reader.feed(text or "")
        reader.close()
        rows.append((" ".join(reader.title.split()), reader.description, reader.canonical, reader.anchors))
    return pd.DataFrame(rows, columns=["title", "description", "canonical", "anchors"])


def anchors(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``pos``, ``href`` of double-quoted anchors: a regular expression, no Python."""
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def page_links(pages: DataFrame) -> DataFrame:
    """Learning links of pages: resolved against the canonical URL, same-page fragments and foreign schemes dropped, classified."""
    read = pages.select("page_id", "url", parsed_html("html").alias("p"))
    base = F.when(F.col("p.canonical") != "", urls.resolved_url("url", "p.canonical")).otherwise(F.col("url"))
    each = read.select("page_id", base.alias("base"), F.posexplode("p.anchors").alias("pos", "a"))
    seen = each.select("page_id", "pos", "base", F.col("a.href").alias("href"), F.col("a.label").alias("label"), urls.resolved_url("base", "a.href").alias("link"))
    kept = seen.where(F.col("link").rlike("^(?i)https?://") & ~F.col("href").startswith("#") & (F.regexp_replace("link", "#.*$", "") != F.regexp_replace("base", "#.*$", "")))
    kind = urls.resource_kind(F.col("link"), F.col("label"))
    return kept.withColumn("kind", kind).withColumn("provenance_only", urls.provenance_helper(F.col("link"), F.col("label"), F.col("kind")))


#: Words of a title that, with a sign-in text, make a sign-in page.
LOGIN_TITLES = "login|sign in|log in"
LOGIN_CHARS = 20_000


def access_class(pages: DataFrame) -> DataFrame:
    """Adds ``login_page``: a sign-in text in the first 20 000 characters, and there the word password, or a sign-in word in the title.

    A page without a title has its file name, or its URL, as one.
    """
    head = F.substring("html", 1, LOGIN_CHARS)
    named = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    place = F.regexp_extract(urls.url_path(F.col("url")), "([^/]*)/*$", 1)
    title = F.coalesce(F.nullif(named, F.lit("")), F.nullif(place, F.lit("")), F.col("url"))
    asks = head.rlike(LOGIN) & (F.lower(head).contains("password") | F.lower(title).rlike(LOGIN_TITLES))
    return pages.withColumn("login_page", F.coalesce(asks, F.lit(False)))


def audit(urls_seen: DataFrame, cache: DataFrame) -> DataFrame:
    """URLs against a result cache keyed by digest (``http_status``, optional ``final_url`` and ``robots`` headers); what it lacks needs a review by hand."""
    keyed = urls_seen.withColumn("key", F.sha2("url", 256))
    given = cache.columns
    extra = {c: F.col(c) if c in given else F.lit(None).cast("string") for c in ("final_url", "robots")}
    joined = keyed.join(cache.withColumns(extra), "key", "left")
    status = urls.status_class(F.col("http_status"), F.col("url"), F.coalesce("final_url", "url"), F.col("robots"))
    return joined.select("url", status.alias("status"), "http_status", F.col("http_status").isNotNull().alias("cached"))
