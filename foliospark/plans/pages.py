"""Queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import urls
from foliospark.operators import coverage, links
from foliospark.plans.registry import query, table
from foliospark.sources import web

_ANCHORS = """
WITH a AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, url,
  regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS h FROM pages),
e AS (SELECT page_id, host, url, unnest(range(0, len(h)))::INT AS pos, unnest(h) AS href FROM a)
"""
_KIND = """CASE
  WHEN regexp_matches(p, '\\.(vtt|srt|ttml|txt)$') OR regexp_matches(t, 'transcript|caption') THEN 'transcript'
  WHEN regexp_matches(p, '\\.(ppt|pptx|odp|key)$') OR regexp_matches(t, 'slide|ppt') THEN 'slides'
  WHEN regexp_matches(p, '\\.(epub|mobi)$') THEN 'book'
  WHEN p LIKE '%.pdf' THEN CASE WHEN regexp_matches(p, '/book|/chapter|/readings?|/textbook') OR regexp_matches(t, 'book|chapter') THEN 'book_pdf' ELSE 'pdf' END
  WHEN regexp_matches(p, '/watch|/video|/lecture|/lesson|/play') OR regexp_matches(t, 'video|lecture') THEN 'video'
  WHEN regexp_matches(p, '/book|/chapter|/readings?|/textbook') OR regexp_matches(t, 'book|chapter|reading') THEN 'book_or_chapter'
  WHEN regexp_matches(p, '/course|/class|/syllabus|/module') OR regexp_matches(t, 'course|syllabus') THEN 'course_page'
  ELSE 'web_page' END"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = web.anchors(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", urls.url_host(F.col("url")).alias("host"), "pos", "href")


@query(_ANCHORS + "SELECT coalesce(e.host, '') AS host, coalesce(e.page_id, -1) AS page_id, count(*) AS total_links, count(DISTINCT href) AS unique_targets FROM e GROUP BY GROUPING SETS ((e.host, e.page_id), (e.host), ())")
def link_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and distinct targets per page, per host (page -1) and in total (host empty)."""
    found = links.inventory(_links(spark, sf_dir).withColumnRenamed("href", "target"), "host", "page_id")
    return found.withColumns({"host": F.coalesce("host", F.lit("")), "page_id": F.coalesce("page_id", F.lit(-1).cast("long"))})


@query(_ANCHORS + ", k AS (SELECT host, lower(regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)) AS p, lower(href) || ' ' AS t FROM e) SELECT host, " + _KIND + " AS kind, count(*) AS n FROM k GROUP BY ALL")
def page_link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each host by the kind of resource."""
    return _links(spark, sf_dir).groupBy("host", urls.resource_kind(F.col("href"), F.lit("")).alias("kind")).agg(F.count("*").alias("n"))


@query(_ANCHORS + "SELECT host, href, count(*) AS n, min(page_id) AS first_page FROM e GROUP BY ALL")
def page_link_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of each host with the first page that has them."""
    return _links(spark, sf_dir).groupBy("host", "href").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("WITH u AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[,;:!?.，。；：！？、)（）】》」』\"''`]+$', ''), '#.*$', '') AS u FROM pages) SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || substr(u, length(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1) AS form FROM u")
def url_audit_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as the audit compares them: no fragment, lower host."""
    return table(spark, sf_dir, "pages").select("page_id", urls.audit_form(F.col("url")).alias("form"))


_CODES = "SELECT page_id, url, CASE WHEN page_id % 19 = 7 THEN NULL ELSE 200 + (page_id * 37 % 420) // (1 + page_id % 2 * 2) END AS code, page_id % 3 = 0 AS moved, page_id % 2 = 0 AS barred FROM pages"


@query(f"WITH s AS (SELECT unnest({urls.STATUSES}) AS status), c AS ({_CODES}), "
       "k AS (SELECT CASE WHEN code IS NULL THEN 'MANUAL_REVIEW' WHEN code < 300 THEN CASE WHEN moved THEN 'REDIRECT' ELSE 'OK' END WHEN code IN (301, 302, 303, 307, 308) THEN 'REDIRECT' WHEN code = 401 THEN 'AUTH_REQUIRED' WHEN code = 402 THEN 'PAYWALL' "
       "WHEN code = 403 THEN CASE WHEN barred THEN 'ROBOTS_BLOCKED' ELSE 'MANUAL_REVIEW' END WHEN code = 404 THEN 'NOT_FOUND' WHEN code = 410 THEN 'DOMAIN_GONE' WHEN code = 429 THEN 'RATE_LIMITED' WHEN code BETWEEN 500 AND 599 THEN 'TEMPORARY_FAILURE' ELSE 'MANUAL_REVIEW' END AS status FROM c) "
       "SELECT s.status, count(k.status) AS n FROM s LEFT JOIN k ON s.status = k.status GROUP BY ALL")  # fmt: skip
def url_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit results of all pages by status, against a result cache with every kind of HTTP code, other final URLs and robot headers; absent statuses count zero."""
    key = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("", "url", F.lit("&k="), "page_id").alias("url"))
    code = (200 + F.floor((key * 37 % 420) / (1 + key % 2 * 2))).cast("int")
    final = F.when(key % 3 == 0, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("/moved"))).otherwise(F.concat(F.upper(F.substring("url", 1, 5)), F.expr("substring(url, 6)")))
    known = pages.where("page_id % 19 <> 7")
    cache = known.select(F.sha2("url", 256).alias("key"), code.alias("http_status"), final.alias("final_url"), F.when(key % 2 == 0, "Robots").otherwise("nginx").alias("robots"))
    statuses = spark.createDataFrame([(s,) for s in urls.STATUSES], "status string")
    counted = web.audit(pages.select("url"), cache).groupBy("status").agg(F.count("*").alias("c"))
    return statuses.join(counted, "status", "left").select("status", F.coalesce("c", F.lit(0)).alias("n"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) <> '' AS has_title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages have a title, by the tolerant parser."""
    read = table(spark, sf_dir, "pages").select("page_id", web.parsed_html("html").alias("p"))
    return read.select("page_id", (F.col("p.title") != "").alias("has_title"))


_ASKING = "CASE page_id % 5 WHEN 0 THEN 'you can log in later ' WHEN 1 THEN '<title>Log  In here</title> please login ' WHEN 2 THEN '登录 your Password ' WHEN 3 THEN 'password only ' ELSE '' END || html"


@query(f"""WITH p AS (SELECT page_id, url, {_ASKING} AS html FROM pages), h AS (SELECT page_id, substr(html, 1, 20000) AS head, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, url FROM p)
SELECT page_id, regexp_matches(head, '(?i)<input[^>]+type=["'']password|\\b(sign\\s*in|log\\s*in|login|required\\s+login)\\b|登录|登入') AND (contains(lower(head), 'password') OR regexp_matches(lower(title), 'login|sign in|log in')) AS login_page FROM h""")
def login_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that ask for a sign-in, four in five of which speak of it in one way or another."""
    said = F.element_at(F.array(*map(F.lit, ("you can log in later ", "<title>Log  In here</title> please login ", "登录 your Password ", "password only ", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    return web.access_class(table(spark, sf_dir, "pages").withColumn("html", F.concat(said, "html"))).select("page_id", "login_page")


@query(_ANCHORS + ", h AS (SELECT DISTINCT host FROM e), d AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) SELECT coalesce(h.host, d.host) AS host, CASE WHEN h.host IS NULL THEN 'right' WHEN d.host IS NULL THEN 'left' ELSE 'both' END AS side FROM h FULL JOIN d ON h.host = d.host")
def host_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with links against hosts with pages."""
    hosts = table(spark, sf_dir, "pages").select(urls.url_host(F.col("url")).alias("host"))
    return coverage.reconcile(_links(spark, sf_dir).select("host"), hosts, "host")


_RESOURCES = r"""
WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>', 1) AS h, regexp_extract_all(html, '(?is)<a\s[^>]*?href="[^"]*"[^>]*>(.*?)</a>', 1) AS t FROM pages),
e AS (SELECT page_id, url, unnest(range(0, len(h)))::INT AS pos, replace(unnest(h), '&amp;', '&') AS href, trim(regexp_replace(replace(unnest(t), '&amp;', '&'), '\s+', ' ', 'g')) AS label FROM a),
r AS (SELECT *, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || href AS link FROM e WHERE href LIKE '/%'),
k AS (SELECT *, regexp_replace(link, '#.*$', '') AS bare, lower(regexp_extract(link, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS p, lower(regexp_extract(link, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, lower(link) || ' ' || lower(label) AS t FROM r),
c AS (SELECT *, CASE WHEN regexp_matches(host, '(youtube|youtu\.be|bilibili|vimeo|coursera|edx|khanacademy|ocw|mit\.edu)') AND NOT regexp_matches(p, '\.(vtt|srt|ttml|txt|ppt|pptx|odp|key|epub|mobi|pdf)$') AND NOT regexp_matches(t, 'transcript|caption|slide|ppt') THEN 'video' ELSE """ + _KIND + r""" END AS kind FROM k)
SELECT page_id, pos, link, kind, kind = 'web_page' AND lower(label) IN ('open menu', 'site navigation', '站点导航') AS provenance_only FROM c WHERE bare <> regexp_replace(url, '#.*$', '')
"""


@query(_RESOURCES)
def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning links of pages, resolved and classified; the oracle knows rooted links, which are all that the pages have."""
    return web.page_links(table(spark, sf_dir, "pages")).select("page_id", "pos", "link", "kind", "provenance_only")
