import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import quality
from tests.llm.test_copies import plain_components, plain_removed

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    (_, good), (_, one), (_, cut), (_, mix), (_, encode) = corpus_pipeline.STAGES

    kept = good(spark, docs, DATA).cache()
    chars, common = quality.references(docs)
    want = {r.doc_id for r in docs.collect() if quality.judge_text(r.text, chars, common, quality.Bins())[-1]}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == names

    single = one(spark, kept, DATA).cache()
    comp = plain_components([(r.doc_id, r.text) for r in kept.collect()], size=corpus_pipeline.SHINGLE)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in comp.items() if c == i} and single.columns == names

    short = cut(spark, single, DATA).cache()
    want = {i: (n, gone, sha) for i, n, gone, sha in plain_removed([(r.doc_id, r.text) for r in single.collect()])}
    before = {r.doc_id: r for r in single.collect()}
    for r in short.collect():
        n, gone, sha = want[r.doc_id]
        words = r.text.encode().split()
        assert len(words) == n - gone and hashlib.sha256(b" ".join(words)).hexdigest() == sha
        assert r.n_chars == len(r.text) and (gone or r == before[r.doc_id])
    assert short.count() == single.count() and short.columns == names

    mixed = mix(spark, short, DATA).cache()
    assert mixed.columns == names and {r.doc_id for r in mixed.collect()} <= want.keys()

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in short.collect()}
    rows = encode(spark, mixed, DATA).collect()
    assert len(rows) == mixed.count()
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode(text[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DATA)) == key(docs)


def test_odd_tables(spark):
    """Nulls, repeated rows, equal ids, an empty table, and columns named like those that the stages add."""
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    odd = [*rows, rows[3], rows[3] | {"doc_id": None}, rows[3] | {"doc_id": None}, rows[4] | {"source": None, "doc_id": 10**9}, rows[5] | {"text": None}, rows[6] | {"text": ""}, rows[7] | {"lang": None, "doc_id": 10**9 + 1}]
    docs = spark.createDataFrame(odd, spark.read.parquet(f"{DATA}/documents.parquet").schema)
    names = ("row", "judged", "cut", "kept", "kept_text", "n_words", "size", "copies", "more", "doc_key", "first", "encoded")
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    docs, columns = docs.cache(), docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), DATA)
        assert empty.count() == 0
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == (columns if k < 4 else empty.columns)
        assert {tuple(r[n] for n in names) for r in docs.collect()} == {tuple(f"own {n}" for n in names)}
        if k == 1:
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert len(kept) == len(set(kept)) and all(t for _, t in kept)
