"""The pipeline against its stages in plain Python, on a small fixture."""

import hashlib

import numpy as np
import public_tokenizers
from test_decontaminate import best_similarity
from test_near_dedup import brute_groups
from tokenizers import Tokenizer

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_run_equals_plain_python(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs += [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5), (9004, docs[0][1], "en", "s", 1), (9005, docs[1][1] + " tail", "en", "s", 1), (9006, "Words before. " + items[0] + " And words after.", "en", "s", 1)]
    docs += [docs[2]]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [d for d in docs if d[1] and any(map(str.isalpha, d[1]))]
    names, _, _ = brute_groups([d[:2] for d in kept])
    kept = list({d[0]: d for d, c in zip(kept, names) if d[0] == c}.values())
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (i.lower().split() for i in items)]

    def leaks(text):
        words = text.lower().split()
        own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        return any(len(s & own) >= 0.7 * len(s) and best_similarity(text, i) >= 0.75 for s, i in zip(shingles, items))

    kept = [d for d in kept if not leaks(d[1])]
    ids = [e.ids for e in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch([d[1] for d in kept], add_special_tokens=False)]
    expected = sorted((d[0], len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for d, i in zip(kept, ids))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == expected
    assert len(expected) < len(docs) - 5


def test_empty_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "word_bpe"] and corpus_pipeline.ORACLE_SQL is None
