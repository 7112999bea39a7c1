from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.functions import dates


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given, want",
    [
        ("2024-10-21T14:34:23+02:00", datetime(2024, 10, 21, 12, 34, 23)),
        ("2015-12-15T10:00:00Z", datetime(2015, 12, 15, 10)),
        ("5 march 2012", datetime(2012, 3, 5)),
        ("5. March 2012", datetime(2012, 3, 5)),
        ("Monday, March 5, 2012", datetime(2012, 3, 5)),
        ("Mar 5th, 2012 1:30 pm", None),
        ("March 5th, 2012 1:30 pm", datetime(2012, 3, 5, 13, 30)),
        ("Mon, 5 Mar 2012 10:00:00 +0200", datetime(2012, 3, 5, 8)),
        ("3/5/2012", datetime(2012, 3, 5)),
        ("25/3/2012", datetime(2012, 3, 25)),
        ("march 2012", datetime(2012, 3, 1)),
        ("2012-03-01 00:00", datetime(2012, 3, 1)),
        ("en-25-01 00:00", None),
        ("12", None),
        ("yesterday", None),
        (None, None),
    ],
)
def test_parse_article_date(spark, given, want):
    assert value(spark, dates.parse_article_date(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(
    "given, language, want",
    [
        ("Poniedziałek, 3 października 2011", "pl", "3 october 2011"),
        ("3 paź 2011", "pl", "3 october 2011"),
        ("среда, 1 мая 2013 г.", "ru", " 1 may 2013"),
        ("7. März 2019", "de", "7. march 2019"),
        ("7 january 2019", "de", "7 january 2019"),
        ("7 Maja 2019", "en", "7 maja 2019"),
    ],
)
def test_translate_month(spark, given, language, want):
    assert value(spark, dates.translate_month(F.lit(given), F.lit(language))) == want


def test_date_from_url(spark):
    as_of = datetime(2024, 1, 31)
    assert value(spark, dates.date_from_url(F.lit("https://a.com/2012/03/x.html"), as_of)) == datetime(2012, 3, 1)
    assert value(spark, dates.date_from_url(F.lit("https://a.com/en/25"), as_of)) is None
    assert value(spark, dates.date_from_url(F.lit("https://a.com"), as_of)) == as_of


@pytest.mark.parametrize(
    "given, want",
    [
        ("Monday, 5 March", "5 March"),
        ("a, b, c", "c"),
        ("a,b, c", "a,c"),
        ("no comma at all", "no comma at all"),
        ("ends, ", ""),
        ("x,y", "x,y"),
        ("", ""),
    ],
)
def test_strip_weekday(spark, given, want):
    assert value(spark, dates.strip_weekday(F.lit(given))) == want


@pytest.mark.parametrize(
    "start, end, subtitle, name",
    [
        ("2015-09-23", "2015-12-15", "23 September - 15 December 2015", "p_2015.09.23-2015.12.15.epub"),
        ("2015-09-01", "2015-09-15", "01-15 September 2015", "p_2015.09.01-2015.09.15.epub"),
        ("2014-09-01", "2015-09-15", "01 September 2014 - 15 September 2015", "p_2014.09.01-2015.09.15.epub"),
        ("2014-09-01", "2014-09-01", "01-01 September 2014", "p_2014.09.01.epub"),
        ("2014-09-01", None, "01 September 2014", "p_2014.09.01.epub"),
        (None, None, None, "p.epub"),
    ],
)
def test_subtitle_and_file_name(spark, start, end, subtitle, name):
    a, b = (F.lit(x).cast("timestamp") for x in (start, end))
    assert value(spark, dates.book_subtitle(a, b)) == subtitle
    assert value(spark, dates.book_file_name(F.lit("p"), a, b)) == name
