import re
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions.imagesize import header_size
from pageloom.operators import images
from pageloom.sources import images as stored


def png(w, h):
    def chunk(kind, body):
        return (
            struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        )

    rows = b"".join(b"\x00" + b"\x7f\x00\x10" * w for _ in range(h))
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(rows))
        + chunk(b"IEND", b"")
    )


def test_scan_images(spark, tmp_path):
    a, b, c, d = ("a" * 32, "b" * 32, "c" * 32, "d" * 32)
    (tmp_path / f"{a}_600_800_40_bw.jpg").write_bytes(png(120, 130))
    (tmp_path / f"{b}.png").write_bytes(png(20, 30))
    (tmp_path / f"{c}.jpg").write_text("<html>not an image")
    (tmp_path / f"{d}.webp").write_bytes(b"RIFF\x00\x00\x00\x00WEBPVP8 ")
    found = stored.scan_images(spark, str(tmp_path))
    got = {r.hash: (r.w, r.h, r.mime) for r in found.collect()}
    assert got == {
        a: (120, 130, "image/png"),
        b: (20, 30, "image/png"),
        d: (None, None, "image/webp"),
    }
    assert [r.hash for r in stored.min_dims(found).collect()] == [a]
    assert [r.hash for r in stored.cover_candidates(found).collect()] == [a]


def test_mime_by_leading_bytes(spark):
    given = {
        "FFD8FFE0": "image/jpeg",
        "474946383961": "image/gif",
        "424D00": "image/bmp",
        "52494646AABBCCDD57454250": "image/webp",
        "000000186674797068656963": "image/heic",
        "3C68746D6C": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in given], "h string")
    rows = df.select("h", stored.image_mime(F.unhex("h")).alias("m")).collect()
    assert {r.h: r.m for r in rows} == given


def test_cover_slots_cycle_when_there_are_few(spark):
    df = spark.createDataFrame(
        [("few", f"h{i}") for i in range(3)] + [("many", f"h{i}") for i in range(500)],
        "blog string, hash string",
    )
    got = images.cover_slots(df.unionByName(df), seed="s").collect()
    few = {r.slot: r.hash for r in got if r.blog == "few"}
    many = {r.slot: r.hash for r in got if r.blog == "many"}
    assert set(few) == set(many) == set(range(35))
    assert few[0] == few[3] == few[33] and len(set(few.values())) == 3
    assert len(set(many.values())) == 35


def test_manifest_numbers_count_repeats(spark):
    df = spark.createDataFrame(
        [("b", 0, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", 0, "x")],
        "blog string, pos long, hash string",
    ).withColumn("resized_fn", F.concat("hash", F.lit(".jpg")))
    got = sorted((r.blog, r.uid, r.href) for r in images.manifest_images(df).collect())
    assert got == [
        ("b", "img1", "images/x.jpg"),
        ("b", "img3", "images/y.jpg"),
        ("c", "img1", "images/x.jpg"),
    ]


RULES = [
    r"https:\/\/ads\.example\.com\/.*",
    r"https://cdn.example.org/banner[0-9]+\.gif",
    r"[http|https]+:\/\/zblogowani.pl[^\s]+",
    r"https?://([a-z]+)\.\1\.net/",
    r"(x)(y)z\2",
    r"(https://)img\.net/",
    r"https://exact\.example/a*b",
    r"https://one.example/|https://two.example/",
    r"https://plus.example/abc+",
    None,
]
LINKS = [
    "https://ads.example.com/1.gif", "https://adsxexample.com/1.gif", "https://cdn.example.org/banner7.gif",
    "https://cdn.example.org/bannerx.gif", "http://zblogowani.pl/x", "https://foo.foo.net/", "https://foo.bar.net/",
    "xyzy", "xyzx", "https://img.net/q", "https://exact.example/b", "https://exact.example/aab", "https://exact.example/c",
    "https://one.example/", "https://two.example/x", "https://three.example/", "https://plus.example/abccc",
    "https://plus.example/ab", None, "", "short", "see https://ads.example.com/1.gif",
]


def plain_kept(links, rules):
    """Null URLs stay; a rule that holds must match at the start."""
    return sorted(map(str, (u for u in links if u is None or not any(r and re.match(r, u) for r in rules))))


def test_rules_of_a_table_equal_a_plain_loop(spark):
    rules = spark.createDataFrame([(r,) for r in RULES * 2], "pattern string")
    links = spark.createDataFrame([(u, k) for k, u in enumerate(LINKS + LINKS[:3])], "url string, n int")
    got = images.drop_ignored_by_table(links, rules)
    assert got.columns == ["url", "n"]
    assert sorted(str(r.url) for r in got.collect()) == plain_kept(LINKS + LINKS[:3], RULES)
    known = [r for r in RULES if r]
    assert sorted(str(r.url) for r in images.drop_ignored(links, known).collect()) == plain_kept(
        LINKS + LINKS[:3], RULES
    )
    few = images.ignored_urls(links, rules, pass_chars=30)
    assert few.count() == len({u for u in LINKS if u is not None}) - len(set(plain_kept(LINKS, RULES)) - {"None"})
    none = spark.createDataFrame([], "pattern string")
    assert images.drop_ignored_by_table(links, none).count() == len(LINKS) + 3


def test_anchors_of_rules(spark):
    rules = spark.createDataFrame([(r,) for r in RULES], "pattern string")
    got = {r.pattern: r.anchor for r in images.anchored_rules(rules).collect()}
    assert got[RULES[0]] == "https://ads.example.com/"
    assert got[RULES[6]] == "https://exact.exam"
    assert [got[r] for r in (RULES[2], RULES[3], RULES[4], RULES[5], RULES[7])] == [None] * 5
    assert None not in got


def test_hundred_thousand_rules(spark):
    rules = spark.range(100_000).select(
        F.concat(F.lit(r"https:\/\/host"), F.col("id").cast("string"), F.lit(r"\.example\.com\/[a-z]+\.gif")).alias("pattern")
    )
    links = spark.range(60_000).select(
        F.concat(F.lit("https://host"), (F.col("id") * 2).cast("string"), F.lit(".example.com/x.gif")).alias("url")
    )
    assert images.drop_ignored_by_table(links, rules).count() == 10_000


def test_many_images_of_an_article_keep_their_order(spark):
    far = [("b", 1, k, f"h{k}") for k in (0, 1, 65_536, 65_537)] + [("b", 2, 0, "h9"), ("b", 2, 1, "h1")]
    rows = spark.createDataFrame(far, "blog string, seq long, pos long, hash string")
    rows = rows.withColumn("pos", F.struct("seq", "pos")).withColumn("resized_fn", F.col("hash"))
    got = {r.hash: r.uid for r in images.manifest_images(rows).collect()}
    assert got == {"h0": "img1", "h1": "img2", "h65536": "img3", "h65537": "img4", "h9": "img5"}


def jpeg(w, h, padding=0):
    exif = b"\xff\xe1" + struct.pack(">H", 2 + padding) + b"e" * padding
    return b"\xff\xd8" + exif + b"\xff\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\x01\x11\x00" * 3


def heic(*sizes):
    def box(kind, body):
        return struct.pack(">I", 8 + len(body)) + kind + body

    extents = b"".join(box(b"ispe", b"\0" * 4 + struct.pack(">II", *s)) for s in sizes)
    meta = box(b"meta", b"\0" * 4 + box(b"hdlr", b"x" * 20) + box(b"iprp", box(b"ipco", extents)))
    return box(b"ftyp", b"heic\0\0\0\0mif1") + meta + box(b"mdat", b"p" * 50)


def tiff(w, h, order="<"):
    entries = b"".join(struct.pack(order + "HHII", *e) for e in ((254, 4, 1, 0), (256, 4, 1, w), (257, 4, 1, h)))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 3) + entries


FILES = {
    "image/png": [(png(20, 30), (20, 30)), (png(20, 30)[:20], None)],
    "image/gif": [(b"GIF89a" + struct.pack("<HH", 3, 4), (3, 4)), (b"GIF89a\1", None), (b"GIF87a\0\0\0\0", None)],
    "image/bmp": [
        (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 7, -9), (7, 9)),
        (b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 7, 8), (7, 8)),
        (b"BM", None),
    ],
    "image/jpeg": [
        (jpeg(640, 480), (640, 480)),
        (jpeg(640, 480, 60_000), (640, 480)),
        (jpeg(640, 480, 60_000)[:50_000], None),
        (b"\xff\xd8\xff\xda\0\2", None),
        (b"\xff\xd8\xffrubbish", None),
        (b"\xff\xd8" + b"\xff" * 40, None),
        (b"\xff\xd8\xff\xe0\0\0" * 3, None),
    ],
    "image/webp": [
        (b"RIFF....WEBPVP8X" + b"\0" * 8 + b"\x0f\0\0\x1f\0\0", (16, 32)),
        (b"RIFF....WEBPVP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", 99 | 49 << 14), (100, 50)),
        (b"RIFF....WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + struct.pack("<HH", 5, 6), (5, 6)),
        (b"RIFF....WEBPVP8 ", None),
        (b"RIFF....WEBPVP8X" + b"\0" * 9, None),
    ],
    "image/heic": [(heic((64, 64), (4000, 3000)), (4000, 3000)), (heic(), None), (heic((1, 1))[:60], None)],
    "image/tiff": [(tiff(10, 11), (10, 11)), (tiff(10, 11, ">"), (10, 11)), (tiff(1, 1)[:12], None)],
}


def test_sizes_from_headers():
    for mime, files in FILES.items():
        for data, size in files:
            assert header_size(mime, data) == size, (mime, data[:40])
    assert header_size(None, b"x") is header_size("image/png", None) is header_size("image/png", b"") is None


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(FILES)), st.integers(0, 2), st.integers(0, 400), st.binary(max_size=60))
def test_damaged_headers_never_raise(mime, which, cut, noise):
    data = FILES[mime][which % len(FILES[mime])][0]
    for damaged in (data[:cut], data[:cut] + noise, noise):
        size = header_size(mime, damaged)
        assert size is None or all(s > 0 for s in size)


def test_images_of_all_types_are_told_by_their_bytes(spark):
    rows = [(f"/x/{k}", data, mime, size) for mime, files in FILES.items() for k, (data, size) in enumerate(files)]
    df = spark.createDataFrame([(f"{m}{p}", bytearray(d)) for p, d, m, _ in rows], "path string, content binary")
    df = df.unionByName(spark.createDataFrame([("none", None), ("empty", bytearray())], df.schema))
    got = {r.path: (r.mime, (r.w, r.h)) for r in stored.sized_images(df).collect()}
    assert got == {f"{m}{p}": (m, s or (None, None)) for p, d, m, s in rows if m != "image/heic" or d[4:12] == b"ftypheic"}
