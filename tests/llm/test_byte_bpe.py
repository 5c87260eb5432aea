import hashlib

import numpy as np
import pytest

from codeatlas.llm import byte_bpe
from codeatlas.llm.queries import vocabulary_file


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as p

    return byte_bpe.encoding(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)


def encode(docs):
    import public_tokenizers as p

    return byte_bpe.encode_decode(docs, vocabulary_file("byte_bpe_multi_50k.tiktoken"), p.PATTERN)


def test_equals_the_library(odd, odd_documents, tokenizer):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in encode(odd).collect())
    want = []
    for doc, text, *_ in odd_documents:
        ids = tokenizer.encode_ordinary(text or "")
        want.append((doc is not None, doc or 0, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()))
    assert got == sorted(want)


def test_empty_table(none):
    assert encode(none).count() == 0


def test_query_hashes(spark):
    from codeatlas.llm.queries import QUERIES

    r = QUERIES["op5_byte_bpe"](spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id = {r['doc_id']}").first()["text"]
    assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_every_code_point(spark, tokenizer):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}" for c in points[i : i + 4096]) for i in range(0, len(points), 4096)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: bytes(r["ids"]) for r in encode(df).collect()}
    assert all(got[k] == np.array(tokenizer.encode_ordinary(t), "<u4").tobytes() for k, t in enumerate(texts))


def test_leaves_no_table(spark, odd, tokenizer):
    before = {t.name for t in spark.catalog.listTables()}
    done = encode(odd)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert done.count() == odd.count() and "SelectedBucketsCount" in done._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_packs_are_found_in_bounded_memory():
    """The packs of many words, however they are dealt, with little memory beside the words."""
    import tracemalloc

    words = [f"word {k}".encode() for k in range(200_000)]
    byte_bpe.pack_of(words[:10])
    tracemalloc.start()
    found = byte_bpe.pack_of(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    assert found[:100].tolist() == byte_bpe.pack_of(words[:100]).tolist() and found[-7:].tolist() == byte_bpe.pack_of(words[-7:]).tolist()
