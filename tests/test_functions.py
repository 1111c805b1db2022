"""Scalars and scanners on small literal cases."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import markdown, text, urls


def value(spark, column, **given):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in given.items()) or "x int"
    return spark.createDataFrame([tuple(given.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("title", "slug"), [("A  Big Title!", "a-big-title"), ("x_y - z", "x_y-z"), ("标题 一", "标题-一")])
def test_slug(spark, title, slug):
    assert value(spark, text.slug(F.col("t")), t=title) == slug


@pytest.mark.parametrize(("given", "number"), [("十二", 12), ("二十", 20), ("九十九", 99), ("七", 7), ("百", None), ("十", 10)])
def test_chinese_number(spark, given, number):
    assert value(spark, text.chinese_number(F.col("t")), t=given) == number


@pytest.mark.parametrize(("size", "shown"), [(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KiB"), (5 << 20, "5.0 MiB"), (3 << 30, "3.0 GiB")])
def test_human_size(spark, size, shown):
    assert value(spark, text.human_size(F.col("t")), t=size) == shown


@pytest.mark.parametrize(("name", "safe"), [("a/b:c", "a b c"), ("con", "_con"), ("...", "untitled"), ("x" * 90, "x" * 80)])
def test_safe_name(spark, name, safe):
    assert value(spark, text.safe_name(F.col("t")), t=name) == safe


def test_dates_and_words(spark):
    today = F.lit("2024-05-01").cast("date")
    for given, good in (("2024-05-01", True), ("2024-05-02", False), ("2024-02-30", False), ("2024-5-1", False), (None, False)):
        assert value(spark, text.valid_date(F.col("t"), today), t=given) is good
    assert value(spark, text.word_count(F.col("t")), t="two words 汉字 don't") == 5
    assert value(spark, text.indent_columns(F.col("t")), t="  \tx") == 4
    assert value(spark, text.stem_key(F.col("t")), t="Straße") == "strasse"
    assert value(spark, text.display_width(F.col("t")), t="a汉") == 3.0
    assert value(spark, text.version_parts(F.col("t")), t="v1.20.3-rc") == [1, 20, 3]


def test_code_is_masked_in_place():
    source = "a `x` b\n\n    code\n\n```py\nTODO\n```\n> ```\n> q\nend ``a`b`` `open\n"
    masked, unclosed = markdown.mask_code(source)
    assert len(masked) == len(source) and not unclosed
    assert "TODO" not in masked and "x" not in masked and "code" not in masked and "q" not in masked
    assert "end" in masked and "`open" in masked
    assert markdown.mask_code("~~~\nx")[1]
    assert "deep" not in markdown.mask_code("- item\n\n      deep\n")[0]
    assert "text" in markdown.mask_code("- item\n\n  text\n")[0]
    assert markdown.mask_plain("    y\n`a`").strip() == ""


def test_inline_links():
    found = markdown.inline_links(r'[a](b(c)d "t") ![i](x) [e](<a b>) [n[m]](k) \[no](z) [bad](a(b)')
    assert [t for t, _, _ in found] == ["b(c)d", "a b", "k"]
    assert markdown.inline_links("[x](" + "(" * 33 + ")" * 33 + ")") == []


@pytest.mark.parametrize(
    ("url", "label", "kind"),
    [("https://a.org/x.vtt", "", "transcript"), ("https://a.org/s.pptx", "", "slides"), ("https://a.org/b.epub", "", "book"), ("https://a.org/book/x.pdf", "", "book_pdf"), ("https://a.org/x.pdf", "", "pdf"), ("https://youtu.be/x", "", "video"), ("https://a.org/chapter/1", "", "book_or_chapter"), ("https://a.org/x", "Syllabus", "course_page"), ("https://a.org/x", "home", "web_page")],
)
def test_resource_kind(spark, url, label, kind):
    assert value(spark, urls.resource_kind(F.col("u"), F.col("l")), u=url, l=label) == kind


def test_urls(spark):
    assert value(spark, urls.url_identity(F.col("u")), u="HTTPS://U@Ex.ORG/%7ea%2fb?q=%3d") == "https://U@ex.org/~a%2Fb?q=%3D"
    assert value(spark, urls.prose_urls(F.col("u")), u="see https://A.org/x#f). 参见https://a.org/x，好") == ["https://a.org/x"]
    helper = urls.provenance_helper(F.col("u"), F.col("l"), urls.resource_kind(F.col("u"), F.col("l")))
    assert value(spark, helper, u="https://a.org/main.js", l="") is True
    assert value(spark, helper, u="https://a.org/x.pdf", l="api") is False
