"""Stored images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.imagesize import image_size

# Leading bytes (hex) of image file types.
IMAGE_MAGIC = (
    ("^FFD8FF", "image/jpeg"),
    ("^89504E470D0A1A0A", "image/png"),
    ("^47494638", "image/gif"),
    ("^424D", "image/bmp"),
    ("^52494646.{8}57454250", "image/webp"),
    ("^.{8}66747970(68656963|68656978|6D696631|6D736631)", "image/heic"),
    ("^(49492A00|4D4D002A)", "image/tiff"),
)
#: Types that tell their size in the first 64 bytes.
SHORT_HEADERS = ("image/png", "image/gif", "image/bmp", "image/webp")
MIN_DIMS_SUM = 100
MIN_COVER_SIDE = 100


def image_mime(content: Column) -> Column:
    """Type told by the leading bytes, null when unknown."""
    head = F.hex(F.substring(content, 1, 12))
    chain = None
    for pattern, mime in IMAGE_MAGIC:
        hit = head.rlike(pattern)
        chain = F.when(hit, mime) if chain is None else chain.when(hit, mime)
    return chain


def is_image_mime(df: DataFrame) -> DataFrame:
    """Rows whose ``content`` is an image of a known type (F8)."""
    return df.withColumn("mime", image_mime(F.col("content"))).filter(F.col("mime").isNotNull())


def min_dims(df: DataFrame) -> DataFrame:
    """Images that are not too small to show."""
    return df.filter(F.col("w") + F.col("h") >= MIN_DIMS_SUM)


def cover_candidates(df: DataFrame) -> DataFrame:
    """Images large enough for a cover."""
    return df.filter((F.col("w") >= MIN_COVER_SIDE) & (F.col("h") >= MIN_COVER_SIDE))


def sized_images(files: DataFrame) -> DataFrame:
    """``path, hash, w, h, mime`` of the images among ``files(path, content)``.

    Sizes are read from header bytes: of most types the first ones are all that
    leaves the JVM. An image whose header is cut or broken stays, with null sizes;
    files of no known image type are dropped.
    """
    typed = files.select("path", "content", image_mime(F.col("content")).alias("mime"))
    head = F.when(F.col("mime").isin(*SHORT_HEADERS), F.substring("content", 1, 64)).otherwise(F.col("content"))
    return (
        typed.filter(F.col("mime").isNotNull())
        .withColumn("size", image_size(F.col("mime"), head))
        .select(
            "path",
            F.regexp_extract("path", r"([0-9a-f]{32})[^/]*$", 1).alias("hash"),
            "size.w",
            "size.h",
            "mime",
        )
    )


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path, hash, w, h, mime`` of stored images; each file is read once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return sized_images(files.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content"))
