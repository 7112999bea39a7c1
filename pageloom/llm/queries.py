"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import (
    bpe,
    embedding_dedup,
    html_extract,
    lexical,
    mixing,
    nearest,
    phrase_index,
    quality,
    secret_scan,
    simhash_dedup,
    token_files,
    toxicity,
    whitening,
)
from pageloom.llm.common import prepared, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its check SQL."""

    def register(fn):
        QUERIES[name] = prepared(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_embedding_dedup",
    """WITH RECURSIVE v AS (
      SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
    ), links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95
    ), reach(vec_id, other) AS (
      SELECT vec_id, vec_id FROM embeddings
      UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
    ), low AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
    ), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id,
      e.vec_id = component_id AS kept
    FROM embeddings e JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings at a cosine of 0.95 or more."""
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.read_labels(spark, sf_dir))


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of the text decoded from them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), path)


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    return found.drop("found")


@query(
    "op5_html_extract",
    r"""SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
      SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(
          regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1),
          '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'),
        '\s+', ' ', 'g')) AS text
      FROM pages)""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract_text(read_table(spark, sf_dir, "pages"))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents, learnt from labels outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_documents(docs, read_table(spark, sf_dir, "labels"))


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, read back from their files."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.through_files(read_table(spark, sf_dir, "documents"), path, end_id=2)


@query(
    "op8_nearest",
    """WITH v AS (
      SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
    ), r AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
      WHERE q.vec_id % 50 = 0
    ), n AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r
    ) SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM n WHERE rank <= 5""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all embeddings for every 50th id."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest.nearest_rows(vectors, lambda vec_id: vec_id % 50 == 0, count=5)


@query(
    "op9_mixing",
    r"""WITH d AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k
      FROM documents
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
        [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS w
      FROM d GROUP BY source
    ), p AS (
      SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS budget,
        sum(cap) OVER up AS capped, sum(w) OVER () - sum(w) OVER up AS free
      FROM s WINDOW up AS (ORDER BY cap::DOUBLE / w, source ROWS UNBOUNDED PRECEDING)
    ), l AS (
      SELECT max(level) AS level FROM (
        SELECT (any_value(budget) - 0) / sum(w)::DOUBLE AS level FROM p
        UNION ALL
        SELECT (budget - capped::DOUBLE) / free::DOUBLE FROM p
        WHERE free > 0 AND cap::DOUBLE / w <= (budget - capped::DOUBLE) / free::DOUBLE)
    ), t AS (
      SELECT source, source_size, budget, least(cap::DOUBLE, (SELECT level FROM l) * w) AS target FROM p
    ), q AS (
      SELECT doc_id, size, source_size, target, budget, k, d.source,
        row_number() OVER (PARTITION BY k, d.source ORDER BY size) AS twin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    ), f AS (
      SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, twin ROWS UNBOUNDED PRECEDING) AS upto
      FROM q
    ), i AS (
      SELECT *, (upto + c * source_size)::DOUBLE / target AS finish,
        coalesce('s' || source, 'n') AS g FROM f, (VALUES (0), (1)) v(c) WHERE size > 0
    ), o AS (
      SELECT *, sum(size) OVER (ORDER BY finish, g, k, twin, c ROWS UNBOUNDED PRECEDING) AS pos FROM i
    ), n AS (SELECT g, k, twin, count(*) AS copies FROM o WHERE pos <= budget GROUP BY ALL)
    SELECT doc_id, size::BIGINT AS size, source_size, target,
      (size * coalesce(copies, 0))::BIGINT AS taken
    FROM q LEFT JOIN n ON coalesce('s' || q.source, 'n') = n.g AND q.k = n.k AND q.twin = n.twin""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix of 150 % of all words takes."""
    rows, _ = mixing.mix(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_simhash_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, 2 bits."""
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, bits=2)


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 4 leading components of their distinct integer vectors."""
    return whitening.whitened(read_table(spark, sf_dir, "embeddings"), count=4, scale=256)


@query(
    "op12_lexical_search",
    r"""WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM documents
    ), i AS (
      SELECT DISTINCT item_id, text FROM benchmark
    ), q AS (
      SELECT DISTINCT i, item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
      FROM i
    ), s AS (SELECT count(*) AS all_docs, sum(len(w))::BIGINT AS all_terms FROM d WHERE len(w) > 0
    ), tf AS (
      SELECT r, doc_id, len(w)::BIGINT AS n, t, count(*)::BIGINT AS tf
      FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL
    ), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t
    ), p AS (
      SELECT i, item_id, r, doc_id, sum(
        floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
        * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * all_docs) // all_terms))))::BIGINT AS score
      FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY ALL
    ), k AS (
      SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0
    ) SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of each test item."""
    docs = read_table(spark, sf_dir, "documents")
    return lexical.best_documents(docs, read_table(spark, sf_dir, "benchmark"), count=50)


@query(
    "op13_decontamination",
    r"""WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents
    ), i AS (
      SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark
    ), x AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest([
        array_to_string(w[p:p + least(len(w), 10) - 1], ' ')
        for p in range(1, len(w) - least(len(w), 10) + 2)]) AS win
      FROM i WHERE len(w) > 0
    ), n AS (
      SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS win FROM (
        SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM d, (SELECT DISTINCT size FROM x) WHERE len(w) >= size)
    ), m AS (SELECT r, p, n.size, item_id FROM n JOIN x ON n.win = x.win AND n.size = x.size
    ), h AS (
      SELECT r, count(DISTINCT pos) AS n_hit FROM (
        SELECT r, unnest(range(p, p + size)) AS pos FROM (SELECT DISTINCT r, p, size FROM m)) GROUP BY r
    ), e AS (
      SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m) GROUP BY r
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
      coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN e USING (r)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in 10 consecutive words of a test item."""
    docs = read_table(spark, sf_dir, "documents")
    return phrase_index.contamination(docs, read_table(spark, sf_dir, "benchmark"), words=10)
