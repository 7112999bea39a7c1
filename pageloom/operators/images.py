"""Image references of articles and books."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.config import JobConfig
from pageloom.functions import urls
from pageloom.operators.ranking import chunk_of, rank_within, top_k
from pageloom.session import staged

COVER_SLOTS = 35

#: Lengths of URL beginnings under which rules are found; "https://" is 8 long.
LADDER = (10, 14, 18, 24, 32, 48, 64)

_BACK_REFERENCE = r"\\[1-9]|\\k<"


def drop_ignored(df: DataFrame, rules: Sequence[str], url: str = "url") -> DataFrame:
    """Rows whose URL does not start with any rule (F4); a null URL starts with none."""
    shared = [r for r in rules if not re.search(_BACK_REFERENCE, r)]
    alone = [r for r in rules if re.search(_BACK_REFERENCE, r)]
    for rule in (["|".join(f"(?:{r})" for r in shared)] if shared else []) + alone:
        df = df.filter(~F.coalesce(F.col(url).rlike(f"^(?:{rule})"), F.lit(False)))
    return df


def anchored_rules(rules: DataFrame) -> DataFrame:
    """``(pattern, anchor)``: the rule's leading literal, cut to a length of the ladder.

    The literal ends before the first operator and gives up the character that a
    quantifier follows. A rule with alternatives, or with a literal below the
    shortest length, has a null anchor.
    """
    raw = F.regexp_extract("pattern", r"^((?:[^\\\[\](){}.*+?^$|]|\\[^a-zA-Z0-9])*)", 1)
    after = F.expr("substring(pattern, length(raw) + 1, 1)")
    kept = F.when(
        after.isin("*", "?", "+", "{"), F.regexp_replace("raw", r"(?:\\[^a-zA-Z0-9]|[^\\])$", "")
    ).otherwise(F.col("raw"))
    literal = F.regexp_replace(kept, r"\\(.)", "$1")
    length = F.lit(None).cast("int")
    for step in LADDER:
        length = F.when(F.length("literal") >= step, step).otherwise(length)
    anchor = F.expr("substring(literal, 1, steps)")
    return (
        rules.select("pattern")
        .filter("pattern is not null")
        .distinct()
        .withColumn("raw", raw)
        .withColumn("literal", literal)
        .withColumn("steps", length)
        .select("pattern", F.when(~F.contains("pattern", F.lit("|")), anchor).alias("anchor"))
    )


def ignored_urls(links: DataFrame, rules: DataFrame, pass_chars: int = 1 << 20) -> DataFrame:
    """Distinct ``url`` of ``links(url)`` that start with a rule of ``rules(pattern)``.

    Each URL looks for rules under its own beginnings, so a regex is tried on URLs
    that share its literal only. Rules without an anchor become alternations, rules
    with back references one each, and are tried on every URL, ``pass_chars``
    characters of them at a time: a row that Spark broadcasts.
    """
    indexed = staged(anchored_rules(rules), "ignore-rules")
    found = links.filter("url is not null").select("url").distinct()
    starts = F.array(*(F.when(F.length("url") >= n, F.substring("url", 1, n)) for n in LADDER))
    hits = (
        found.withColumn("anchor", F.explode(F.array_compact(starts)))
        .join(indexed.filter("anchor is not null"), "anchor")
        .filter("url rlike concat('^(?:', pattern, ')')")
        .select("url")
    )
    loose = indexed.filter("anchor is null")
    chars = loose.agg(F.sum(F.length("pattern"))).first()[0]
    if chars is None:
        return hits.distinct()
    alone = F.col("pattern").rlike(_BACK_REFERENCE)
    block = F.when(alone, F.xxhash64("pattern")).otherwise(
        F.pmod(F.xxhash64("pattern"), F.lit(max(1, chars // 10_000)))
    )
    blocks = staged(
        loose.groupBy(alone.alias("alone"), block.alias("block"))
        .agg(F.sort_array(F.collect_list(F.concat(F.lit("(?:"), "pattern", F.lit(")")))).alias("parts"))
        .select("block", F.concat(F.lit("^(?:"), F.array_join("parts", "|"), F.lit(")")).alias("regex")),
        "ignore-alternations",
    )
    passes = max(1, -(-chars // pass_chars))
    for k in range(passes):
        own = blocks.filter(F.pmod(F.xxhash64("regex"), F.lit(passes)) == k)
        row = own.agg(F.collect_list("regex").alias("regexes"))
        tried = found.crossJoin(F.broadcast(row)).filter("exists(regexes, r -> url rlike r)")
        hits = hits.unionByName(tried.select("url"))
    return hits.distinct()


def drop_ignored_by_table(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """F4 with rules from a table ``rules(pattern)`` of any length.

    Distinct URLs meet the rules (:func:`ignored_urls`); rows are then anti-joined
    by URL, which keeps null URLs. No rule passes through the driver.
    """
    ignored = ignored_urls(df.select(F.col(url).alias("url")), rules)
    return df.join(ignored.withColumnRenamed("url", url), url, "left_anti")


def drop_unsupported(df: DataFrame, url: str = "url") -> DataFrame:
    """Images of a supported file type."""
    return df.filter(urls.is_supported_image(F.col(url)))


def include_images(df: DataFrame, cfg: JobConfig) -> DataFrame:
    """All rows or none; the constant folds away."""
    return df.filter(F.lit(cfg.include_images))


def drop_skipped(df: DataFrame, skipped: DataFrame) -> DataFrame:
    """Rows whose URL is not among known-bad images."""
    return df.join(skipped.select("url").distinct(), "url", "left_anti")


def stored_only(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose image is in the image store."""
    return df.join(stored.select("hash"), "hash", "left_semi")


def article_images(articles: DataFrame) -> DataFrame:
    """One row per image of an article, in article order."""
    return articles.select(
        "blog",
        "seq",
        F.col("url").alias("article_url"),
        F.posexplode("images").alias("pos", "image"),
    ).select("blog", "seq", "article_url", F.col("pos").cast("bigint").alias("pos"), "image.*")


def with_header_images(images: DataFrame, header_images: DataFrame) -> DataFrame:
    """Images of articles followed by those of the blogs' headers; repeats stay."""
    return images.unionByName(header_images)


def book_image_set(images: DataFrame, header_images: DataFrame) -> DataFrame:
    """Article and header images of each book, distinct on all fields (A5)."""
    return with_header_images(images, header_images).distinct()


def first_seen(images: DataFrame) -> DataFrame:
    """First row per blog and hash; a combinable aggregate, no sort."""
    rest = [c for c in images.columns if c not in ("blog", "hash", "pos")]
    return (
        images.groupBy("blog", "hash")
        .agg(F.min(F.struct("pos", *rest)).alias("first"))
        .select("blog", "hash", "first.*")
    )


def manifest_images(images: DataFrame) -> DataFrame:
    """One manifest row per hash; the number counts images before that.

    ``images(blog, pos, hash, resized_fn)`` with ``pos`` unique per blog: a number, or
    a struct ``(seq, pos)`` of the article's place and the image's place in it.
    """
    nested = isinstance(images.schema["pos"].dataType, T.StructType)
    numbered = rank_within(
        staged(images.select("blog", "pos", "hash", "resized_fn"), "book-images"),
        ["blog"],
        [F.col("pos")],
        [chunk_of(F.col("pos.seq" if nested else "pos"))],
        "number",
    )
    return first_seen(numbered).select(
        "blog",
        F.concat(F.lit("img"), F.col("number").cast("string")).alias("uid"),
        F.concat(F.lit("images/"), F.col("resized_fn")).alias("href"),
        "hash",
    )


def shuffle_key(image_hash: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), image_hash))


def cover_slots(images: DataFrame, seed: str = "cover", slots: int = COVER_SLOTS) -> DataFrame:
    """Images of every cover slot, repeating when a blog has fewer (O3).

    The shuffle order is a seeded hash. Its first two hex digits salt the
    per-blog choice, so no task ranks more than a small share of a blog.
    """
    keyed = (
        images.select("blog", "hash")
        .distinct()
        .withColumn("key", shuffle_key(F.col("hash"), seed))
    )
    best = top_k(keyed, ["blog"], F.col("key"), F.substring("key", 1, 2), slots, "rank")
    sizes = best.groupBy("blog").agg(F.max("rank").alias("n"))
    places = sizes.select(
        "blog", "n", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    ).withColumn("rank", (F.col("slot") % F.col("n") + 1).cast("int"))
    return places.join(best, ["blog", "rank"]).select(
        "blog", F.col("slot").cast("bigint").alias("slot"), "hash"
    )
