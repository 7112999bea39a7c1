"""The stages against plain versions, and the contract of their columns."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pageloom.llm import secret_scan, toxicity

from . import brute
from .test_models import toxic_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int"


def fixture(spark, folder):
    rows, labels = toxic_table(n=240)
    docs = [(k, t, lang, f"s{k % 4}" if k % 7 else None, len(t), 1) for k, t, lang, _ in rows]
    docs += [(3000 + k, docs[k][1] + " tail", "en", "s0", None, None) for k in range(1, 60, 3)]
    docs += [(4000, "password=b7db7aa4a5fcc78305 is here and more words follow", "en", "s1", 57, 1)]
    docs += [(4001, None, None, None, None, None), (4002, "", "", "s2", 0, 0), (docs[5][0], *docs[5][1:])]
    docs.append((4003, " ".join(f"long{k}" for k in range(30_000)), "en", "s3", 1, 1))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_pipeline_equals_plain_stages(spark, tmp_path):
    docs = fixture(spark, tmp_path)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(read.select("doc_id", "text"), toxicity.read_labels(spark, str(tmp_path)))
    rows = [r for r in docs if model.severities([r[1]], {})[0][1] < model.least]
    assert len(rows) < len(docs)
    prints, low = brute.simhash_classes([r[:2] for r in rows])
    seen, kept = set(), []
    for r, c in zip(rows, low):
        if r[0] == c and c not in seen:
            seen.add(c)
            kept.append(r)
    cleaned = []
    for r in kept:
        text = r[1]
        for start, _, end in reversed(brute.base_spans(text or "")):
            text = text[:start] + "[secret]" + text[end:]
        cleaned.append((r[0], text, r[3]))
    copies = brute.mix(cleaned)[3]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for (doc_id, text, _), n in zip(cleaned, copies):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        want += [(doc_id, len(ids), digest)] * n
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got.collect()) == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "secret_scan", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_secrets_of_the_fixture_are_known_forms():
    assert secret_scan.base_spans("password=b7db7aa4a5fcc78305")[0] == (0, 0, 27)
