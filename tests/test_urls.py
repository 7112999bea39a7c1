import pytest
from pyspark.sql import functions as F

from pageloom.config import JobConfig
from pageloom.functions import urls


@pytest.mark.parametrize(
    "given, port, url",
    [
        ("example.com", 443, "https://example.com"),
        ("http://example.com", 80, "http://example.com"),
        ("https://example.com", 443, "https://example.com"),
        ("https://test.blogspot.com/sub/name.html", 443, "https://test.blogspot.com"),
        (" http://EXAMPLE.com:81/x?y#z ", 81, "http://example.com"),
        ("https://u:p@example.com/a b", 443, "https://example.com"),
    ],
)
def test_normalize_blog_url(spark, given, port, url):
    row = spark.range(1).select(urls.normalize_blog_url(F.lit(given)).alias("n")).first()
    assert (row.n.port, row.n.url) == (port, url)


def test_file_prefix(spark):
    row = spark.range(1).select(
        urls.file_prefix(F.lit("https://example.com"), F.lit("")).alias("derived"),
        urls.file_prefix(F.lit("example.com"), F.lit("xxx")).alias("named"),
    ).first()
    assert row.derived == "example_com"
    assert row.named == "xxx"


@pytest.mark.parametrize(
    "src, want",
    [
        ("http://a.com/x.jpg", "http://a.com/x.jpg"),
        ("/a.jpg", "https://b.com/a.jpg"),
        ("a.jpg", "https://b.com/a.jpg"),
        ("//cdn.com/a.jpg", "https://cdn.com/a.jpg"),
        ("///cdn.com/a.jpg", "https:///cdn.com/a.jpg"),
        ("b.com/a.jpg", "https://b.com/a.jpg"),
        ("/b.com/a.jpg", "https://b.com/a.jpg"),
    ],
)
def test_absolute_image_url(spark, src, want):
    got = spark.range(1).select(
        urls.absolute_image_url(F.lit(src), F.lit("https://b.com"))
    ).first()[0]
    assert got == want


@pytest.mark.parametrize(
    "url, ext",
    [
        ("http://x.com/a.JPG", ".jpg"),
        ("http://x.com/a.jpg?w=1", ".jpg"),
        ("http://x.com/a.jpg?w=1.5", ".5"),
        ("http://x.com/.jpg", ""),
        ("http://x.com/a", ""),
        ("http://x.com/a.b/c", ""),
        ("http://x.com", ".com"),
    ],
)
def test_image_ext(spark, url, ext):
    assert spark.range(1).select(urls.image_ext(F.lit(url))).first()[0] == ext


@pytest.mark.parametrize(
    "url, profile",
    [
        ("https://a.com", "default"),
        ("https://a.blogspot.com/x", "blogspot"),
        ("https://a.wordpress.com", "wordpress"),
        ("https://nrdblog.cmosnet.eu/1", "nrdblog"),
        ("https://zeissikonveb.de", "zeissikonveb"),
        ("https://a.blogspot.com/?to=zeissikonveb.de", "zeissikonveb"),
    ],
)
def test_profile_of(spark, url, profile):
    assert spark.range(1).select(urls.profile_of(F.lit(url))).first()[0] == profile


@pytest.mark.parametrize(
    "text, limit, skip",
    [("5", 5, 5), ("0", 0, None), ("", None, None), ("None", None, None), ("-3", None, None), ("3000000000", 3 * 10**9, 3 * 10**9), ("9" * 30, 1 << 62, 1 << 62)],
)
def test_limit_and_skip(spark, text, limit, skip):
    row = spark.range(1).select(
        urls.parse_limit(F.lit(text)).alias("l"), urls.parse_skip(F.lit(text)).alias("s")
    ).first()
    assert (row.l, row.s) == (limit, skip)


def test_resized_fn(spark):
    cfg = JobConfig(images_size=(640, 960), images_quality=75, images_bw=False)
    row = spark.range(1).select(
        urls.resized_fn(F.lit("h"), JobConfig()), urls.resized_fn(F.lit("h"), cfg)
    ).first()
    assert tuple(row) == ("h_600_800_40_bw.jpg", "h_640_960_75.jpg")


def test_digits_only(spark):
    row = spark.range(1).select(
        urls.digits_only(F.lit("a12b3")), urls.digits_only(F.lit("none"))
    ).first()
    assert tuple(row) == ("12 3", "")
