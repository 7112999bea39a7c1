"""URL and path columns (X1-X8, V2, F6, W8 helpers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.config import JobConfig

# Image file types the engine accepts.
SUPPORTED_IMAGE_EXTENSIONS = (".jpeg", ".jpg", ".png", ".bmp", ".gif", ".webp", ".heic")

# First matching URL fragment decides the site profile.
PROFILE_URL_FRAGMENTS = (
    ("zeissikonveb.de", "zeissikonveb"),
    ("nrdblog.cmosnet.eu", "nrdblog"),
    (".wordpress.com", "wordpress"),
    (".blogspot.", "blogspot"),
)


def _with_scheme(c: Column) -> Column:
    raw = F.replace(F.trim(c), F.lit(" "), F.lit(""))
    return F.regexp_replace(raw, r"^(?!http)", "https://")


def blog_of(c: Column) -> Column:
    """Blog key of a page URL: lower-case scheme and host, nothing else."""
    parts = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*://)(?:[^/?#@]*@)?([^/?#:]*).*$"
    return F.lower(F.regexp_replace(_with_scheme(c), parts, "$1$2"))


def normalize_blog_url(c: Column) -> Column:
    """STRUCT<port INT, url STRING>: blog key and its explicit or default port."""
    full = _with_scheme(c)
    port = F.regexp_extract(full, r"^[a-zA-Z]+://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1)
    default_port = F.when(full.startswith("http://"), F.lit(80)).otherwise(F.lit(443))
    return F.struct(
        F.coalesce(F.nullif(port.try_cast("int"), F.lit(0)), default_port).alias("port"),
        blog_of(c).alias("url"),
    )


def file_prefix(c: Column, name: Column | None = None) -> Column:
    """Explicit name when given, else the URL without scheme and separators."""
    bare = F.replace(
        F.replace(F.lower(c), F.lit("http://"), F.lit("")), F.lit("https://"), F.lit("")
    )
    derived = F.regexp_replace(bare, r"[/,.]", "_")
    if name is None:
        return derived
    return F.coalesce(F.nullif(name, F.lit("")), derived)


def url_md5(c: Column) -> Column:
    return F.md5(c)


def storage_paths(blog: Column, url: Column, root: str = "") -> Column:
    """STRUCT of the folder and file paths of a blog and one of its pages."""
    bare = F.regexp_replace(blog, r"https?://", "")
    name = F.replace(bare, F.lit("/"), F.lit("_"))
    base = F.concat_ws("/", F.lit(root), name) if root else name
    html_dir = F.concat_ws("/", base, F.lit("html"))
    return F.struct(
        base.alias("dir_path"),
        html_dir.alias("html_dir"),
        F.concat_ws("/", base, F.lit("images")).alias("images_dir"),
        F.concat_ws("/", base, F.lit("originals")).alias("originals_dir"),
        F.concat(F.concat_ws("/", html_dir, F.md5(url)), F.lit(".html")).alias("page_path"),
    )


def absolute_image_url(c: Column, blog: Column) -> Column:
    """Image reference as an absolute URL of the blog's scheme and host."""
    scheme = F.regexp_extract(blog, r"^([a-z]+)://", 1)
    host = F.regexp_extract(blog, r"^[a-z]+://(.*)$", 1)
    rooted = (
        F.when(F.contains(c, host) | c.startswith("//"), c)
        .when(c.startswith("/"), F.concat(host, c))
        .otherwise(F.concat(host, F.lit("/"), c))
    )
    slashed = (
        F.when(rooted.startswith("//"), rooted)
        .when(rooted.startswith("/"), F.concat(F.lit("/"), rooted))
        .otherwise(F.concat(F.lit("//"), rooted))
    )
    return F.when(c.startswith("http"), c).otherwise(F.concat(scheme, F.lit(":"), slashed))


def image_ext(c: Column) -> Column:
    """Suffix of the whole reference after its last dot, query cut afterwards."""
    suffix = F.lower(F.regexp_extract(c, r"[^/.][^/]*(\.[^./]*)$", 1))
    return F.split_part(suffix, F.lit("?"), F.lit(1))


def is_supported_image(c: Column) -> Column:
    return image_ext(c).isin(*SUPPORTED_IMAGE_EXTENSIONS)


def resized_fn(image_hash: Column, cfg: JobConfig) -> Column:
    width, height = cfg.images_size
    tail = f"_{width}_{height}_{cfg.images_quality}{'_bw' if cfg.images_bw else ''}.jpg"
    return F.concat(image_hash, F.lit(tail))


def original_fn(image_hash: Column) -> Column:
    return F.concat(image_hash, F.lit(".jpg"))


def url_segment(c: Column, n: int) -> Column:
    """n-th piece of the URL split at slashes, counted from zero."""
    return F.try_element_at(F.split(c, "/"), F.lit(n + 1))


def profile_of(c: Column) -> Column:
    """Site profile of a URL."""
    chain = None
    for fragment, profile in PROFILE_URL_FRAGMENTS:
        hit = F.contains(c, F.lit(fragment))
        chain = F.when(hit, profile) if chain is None else chain.when(hit, profile)
    return chain.otherwise("default")


def digits_only(c: Column) -> Column:
    """The digit runs of typed text, as an entry field keeps them."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0)), " ")


#: Larger counts mean this many: more than any table's rows, and sums of two still fit.
MOST = 1 << 62


def _count(digits: Column) -> Column:
    most = F.lit(MOST)
    return F.least(F.coalesce(digits.try_cast("bigint"), most), most)


def parse_skip(c: Column) -> Column:
    """Positive integer, or null when nothing is to be skipped."""
    typed = F.trim(c)
    return F.when(typed.rlike(r"^\+?0*[1-9][0-9]*$"), _count(typed))


def parse_limit(c: Column) -> Column:
    """All-digit limit, or null for no limit."""
    return F.when(c.rlike(r"^[0-9]+$"), _count(c))
