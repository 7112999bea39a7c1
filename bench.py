"""Headline timings as one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Every query is
executed completely into Spark's no-op sink; the session start and one warm-up
query are reported apart.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_blog_summary",
    "s2_scan_html_cache",
    "s4_scan_sitemap",
    "s6_scan_atom",
    "u1_build_inventory",
    "j1_lookup_pages",
    "e3_content",
    "e5_block_comments",
    "e10_articles",
    "e10_articles_of_posts",
    "e11_blog_metadata",
    "a4_crawl_span",
    "a6_manifest_images",
    "a7_assemble_books",
    "o1_order_by_date",
    "o3_cover_slots",
    "w2_limit_articles",
    "w4_toc_spine",
    "w6_dedupe_names",
    "x21_build_chapters",
    "t1_stream_articles",
    "book_run",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    start = time.time()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.sql.files.maxPartitionBytes", "1m")  # small tables, all cores
        .getOrCreate()
    )
    from pageloom.plans.queries import QUERIES

    QUERIES["v2_profile_dispatch"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["v4_html_nodes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    warmup = time.time() - start
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "warmup": round(warmup, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
