"""Date columns."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import let

# Month and weekday names per language, in calendar order.
ENGLISH_MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
POLISH_MONTHS = (
    "stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca",
    "lipca", "sierpnia", "września", "października", "listopada", "grudnia",
)
RUSSIAN_MONTHS = (
    "января", "февраля", "марта", "апреля", "мая", "июня",
    "июля", "августа", "сентября", "октября", "ноября", "декабря",
)
GERMAN_MONTHS = {
    "januar": "january", "februar": "february", "märz": "march", "mai": "may",
    "juni": "june", "juli": "july", "oktober": "october", "dezember": "december",
}
POLISH_WEEKDAYS = (
    "poniedziałek", "wtorek", "środa", "czwartek", "piątek", "sobota", "niedziela",
)
RUSSIAN_WEEKDAYS = (
    "понедельник", "вторник", "среда", "четверг", "пятница", "суббота", "воскресенье",
)

# Date layouts tried in order after commas, weekdays and ordinals are gone.
DATE_FORMATS = (
    "d MMMM yyyy[ HH:mm[:ss]]",
    "d MMM yyyy[ HH:mm[:ss]]",
    "MMMM d yyyy[ HH:mm[:ss]]",
    "MMM d yyyy[ HH:mm[:ss]]",
    "d MMMM yyyy h:mm a",
    "MMMM d yyyy h:mm a",
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss z",
    "MMMM yyyy",
    "yyyy/M/d[ HH:mm[:ss]]",
    "M/d/yyyy[ HH:mm[:ss]]",
    "d/M/yyyy[ HH:mm[:ss]]",
    "M.d.yyyy[ HH:mm[:ss]]",
    "d.M.yyyy[ HH:mm[:ss]]",
)

_ENGLISH_WEEKDAY = (
    r"^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?[,.]?\s+"
)


def _replace_all(c: Column, pairs: list[tuple[str, str]], regex: bool = False) -> Column:
    """Replace every pair in turn; the pairs travel as one literal array."""
    table = F.from_json(
        F.lit(json.dumps([{"k": k, "v": v} for k, v in pairs], ensure_ascii=False)),
        "array<struct<k: string, v: string>>",
    )
    replace = F.regexp_replace if regex else F.replace
    return F.aggregate(table, c, lambda acc, pair: replace(acc, pair["k"], pair["v"]))


def translate_month(c: Column, language: Column) -> Column:
    """Lower-case date text with Polish, Russian or German months in English."""
    return let(F.lower(c), lambda low: _translated(low, language))


def _translated(low: Column, language: Column) -> Column:
    polish = _replace_all(low, [(d, "") for d in POLISH_WEEKDAYS])
    polish = F.trim(F.trim(polish, F.lit(",")))
    months = list(zip(POLISH_MONTHS, ENGLISH_MONTHS))
    polish = _replace_all(polish, months + [(f" {pl[:3]} ", f" {en} ") for pl, en in months])

    russian = _replace_all(low, [(d, "") for d in RUSSIAN_WEEKDAYS])
    russian = F.trim(russian, F.lit(","))
    russian = _replace_all(russian, list(zip(RUSSIAN_MONTHS, ENGLISH_MONTHS)))
    russian = F.regexp_replace(russian, r"\sг.$", "")

    # Whole words only, so that "january" does not become "januaryy".
    german = _replace_all(
        low, [(rf"\b{de}\b", en) for de, en in GERMAN_MONTHS.items()], regex=True
    )
    return (
        F.when(language == "pl", polish)
        .when(language == "ru", russian)
        .when(language == "de", german)
        .otherwise(low)
    )


def parse_article_date(c: Column) -> Column:
    """Instant of a free-form date; text without a zone is UTC, else null."""
    text = F.lower(F.trim(c))
    text = F.regexp_replace(text, _ENGLISH_WEEKDAY, "")
    text = F.replace(text, F.lit(","), F.lit(" "))
    text = F.regexp_replace(text, r"\b(\d{1,2})(st|nd|rd|th|\.)(?=\s)", "$1")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))

    def tried(t: Column) -> Column:
        # A bare short number is no date; the cast would read it as a year.
        iso = F.when(t.rlike(r"^\d{4}-\d{1,2}"), F.try_to_timestamp(F.upper(t)))
        return F.coalesce(iso, *(F.try_to_timestamp(t, F.lit(fmt)) for fmt in DATE_FORMATS))

    return let(text, tried)


def date_from_url(url: Column, as_of: datetime) -> Column:
    """First day of the month named by URL pieces 3 and 4; ``as_of`` for short URLs."""
    parts = F.split(url, "/")
    text = F.concat(
        F.try_element_at(parts, F.lit(4)),
        F.lit("-"),
        F.try_element_at(parts, F.lit(5)),
        F.lit("-01 00:00"),
    )
    return F.when(F.size(parts) > 4, parse_article_date(text)).otherwise(F.lit(as_of))


def article_date(raw: Column, language: Column, url: Column, as_of: datetime) -> Column:
    """Date of an article: its own date text, or the URL when it has none."""
    return F.when(
        raw.isNotNull(), parse_article_date(translate_month(raw, language))
    ).otherwise(date_from_url(url, as_of))


def strip_weekday(c: Column) -> Column:
    """Text without its ``word, `` parts.

    The second alternative keeps what is not such a part and moves past it, so
    long text without commas stays linear.
    """
    return F.regexp_replace(c, r"[^,]*+, |([^,]*+,|[^,]++)", "$1")


def title_or_date(title: Column, blog_title: Column, date: Column) -> Column:
    """The title, unless it is missing or equals the blog's; then the date."""
    stand_in = title.isNull() | title.eqNullSafe(blog_title)
    return F.when(
        date.isNotNull() & stand_in, F.date_format(date, "EEEE, dd MMMM yyyy, HH:mm")
    ).otherwise(title)


def book_subtitle(start: Column, end: Column) -> Column:
    """Date range in words, repeating only what differs."""
    full = "dd MMMM yyyy"

    def same(fmt: str) -> Column:
        return F.date_format(start, fmt) == F.date_format(end, fmt)

    return (
        F.when(end.isNull(), F.date_format(start, full))
        .when(
            same("yyyy.MM"),
            F.concat(F.date_format(start, "dd"), F.lit("-"), F.date_format(end, full)),
        )
        .when(
            same("yyyy"),
            F.concat(F.date_format(start, "dd MMMM"), F.lit(" - "), F.date_format(end, full)),
        )
        .otherwise(
            F.concat(F.date_format(start, full), F.lit(" - "), F.date_format(end, full))
        )
    )


def book_file_name(prefix: Column, start: Column, end: Column) -> Column:
    day = "yyyy.MM.dd"
    first = F.concat(F.lit("_"), F.date_format(start, day))
    last = F.when(end.isNotNull() & (start != end), F.concat(F.lit("-"), F.date_format(end, day)))
    return F.concat(
        prefix, F.coalesce(first, F.lit("")), F.coalesce(F.when(start.isNotNull(), last), F.lit("")),
        F.lit(".epub"),
    )
