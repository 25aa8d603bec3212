import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from callweave.llm import decontam, pii, simhash
from tests.llm.test_nearcopies import brute_groups

SF = "/root/testdata/sf0.001"


def test_run_equals_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    leaked = {r.doc_id for r in decontam.report(spark.createDataFrame(docs), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    kept = [d for d in docs if any(c.isalpha() for c in d.text)]
    components = brute_groups([d.text for d in kept], [d.doc_id for d in kept])
    kept = [d for d, c in zip(kept, components, strict=True) if d.doc_id == c and d.doc_id not in leaked]
    assert 0 < len(kept) < len(docs)
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    field, want = pii.default_field(), {}
    for d, (_, spans) in zip(kept, pii.all_spans(field, [d.text for d in kept]), strict=True):
        text = pii.masked(d.text, spans)
        ids = encoding.encode_ordinary(text)
        want[d.doc_id] = (text, len(text), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.text, r.n_chars, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_columns_and_stand_nulls(spark):
    rows = [(1, "the cat and the dog", "en", "s", 19), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat and the dog", "en", "s", 19), (4, "mail a@b.co and the cat", None, None, None)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = {r.doc_id: r.text for r in docs.collect()}
    assert out == {1: "the cat and the dog", 4: "mail <EMAIL> and the cat"}
    empty = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_columns_of_any_name_are_kept(spark):
    """Names that the stages use themselves are no clash, whatever their types."""
    names = ["_id", "_hash", "h", "key", "root", "fp", "id", "text_hash", "node", "winner", "keys", "item_id", "coverage", "lang_pred", "_words", "at", "n"]
    rows = [(1, "the cat and the dog went home", "en", "s", 29), (2, "the cat and the dog went home", "en", "s", 29), (None, "and the other", None, None, None), (3, "mail a@b.co and the cat", "en", "s", 23)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i) if i % 2 else F.lit(f"v{i}"))
    columns = docs.columns
    plain = simhash.one_of_each(docs)
    assert plain.columns == columns and plain.count() == 3
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    got = docs.collect()
    assert {r.text for r in got} == {"the cat and the dog went home", "and the other", "mail <EMAIL> and the cat"} and len(got) == 3
    assert all(r[name] == (i if i % 2 else f"v{i}") for r in got for i, name in enumerate(names))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 3
