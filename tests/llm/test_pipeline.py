"""Each stage of the pipeline on its own input, against brute force in memory."""

import hashlib

import corpus_pipeline as c
import numpy as np
import public_tokenizers
import pytest
from codeatlas.llm import byte_bpe, quality_gam

from . import test_hyperminhash, test_robust_rules

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def content(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def checked(spark, docs, place, rules=True):
    """Runs the stages one by one; rows: all columns of each stage's input."""
    labels = spark.read.parquet(f"{place}/labels.parquet")
    good = c.quality_stage(spark, docs, place)
    model = quality_gam.fit(docs, labels)

    def score(text):
        raw = (text or "").encode()
        return model.score(quality_gam.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0]

    assert content(good) == [r for r in content(docs) if score(r[1]) >= quality_gam.THRESHOLD]
    ruled = c.rules_stage(spark, good, place)
    rows = content(good)
    if rules:
        kept = [r for r, v in zip(rows, test_robust_rules.verdicts(rows), strict=True) if v]
        assert content(ruled) == kept
    single = c.dedup_stage(spark, ruled, place)
    rows, out = content(ruled), []
    least = {d: x for d, _, x, _ in test_hyperminhash.brute([(r[0], r[1]) for r in rows], 80, 5)}
    for r in rows:
        if r[0] is None or least[r[0]] == r[0] and r[0] not in {x[0] for x in out}:
            out.append(r)
    assert sorted((r[0] for r in content(single)), key=repr) == sorted((r[0] for r in out), key=repr) and set(content(single)) <= set(rows)
    mixed = c.mixing_stage(spark, single, place)
    assert content(mixed) == content(single)
    coded = c.encoding_stage(spark, mixed, place)
    assert coded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    tok = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = []
    for r in content(mixed):
        ids = tok.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in coded.collect()), key=repr) == sorted(want, key=repr)
    return good, ruled, single, mixed


def test_stages(spark):
    assert [n for n, _ in c.STAGES][0] == "quality classifier" and len(c.STAGES) == 5
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for out in checked(spark, docs, DATA):
        assert out.columns == docs.columns


def test_odd_documents(spark, odd, odd_documents, tmp_path):
    """Nulls, empty texts, repeated rows and ids, further columns with any names: verdicts are those of each row, and all columns are kept."""
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.selectExpr("*", "1 as rejected_id", "2 as row", "3 as counts", "4 as out_id", "5 as tie", "6 as g")
    for out in checked(spark, docs, str(tmp_path), rules=False):
        assert out.columns == docs.columns


def test_rules_judge_rows_not_ids(spark):
    """A rejected row with a null doc_id goes; of two rows of one doc_id only the bad one goes."""
    good, bad = " ".join(f"word{k}" for k in range(80)), "too few words"
    rows = [(None, bad, "en", "web", 1), (None, good, "en", "web", 1), (777, good, "en", "web", 1), (777, bad, "en", "web", 1)] + [(k, good.replace("word", f"w{k}x"), "en", "web", 1) for k in range(40)]
    found = c.rules_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DATA)
    assert sorted((r["doc_id"] or -1, r["text"] == bad) for r in found.collect() if r["doc_id"] in (None, 777)) == [(-1, False), (777, False)]


@pytest.mark.parametrize("stage", [f for _, f in c.STAGES])
def test_empty(spark, none, stage):
    assert stage(spark, none, DATA).count() == 0


def test_tokens_lie_in_the_order_of_the_schedule(spark, odd, monkeypatch):
    """Mixing decides where a document's tokens begin, and other weights move them."""
    texts, tempered, mix = odd.select(*COLUMNS), c.pfair_mix.tempered, c.pfair_mix.mix
    tok = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(c.pfair_mix, "mix", lambda *args, **named: mix(*args, block_chars=512, **named))
    found = []
    for power in (0.2, 2.0):
        monkeypatch.setattr(c.pfair_mix, "tempered", lambda docs, power=power: tempered(docs, power))
        laid = c.written(dict(c.STAGES)["mixing to target weights"](spark, texts, DATA), "laid")
        assert content(laid) == content(texts)
        rows = laid.orderBy(c.PLACE).collect()
        want, at = [], 0
        for r in rows:
            n = len(tok.encode_ordinary(r["text"] or ""))
            want.append((r["doc_id"], n, at))
            at += n
        got = [tuple(r) for r in c.encoding_stage(spark, laid, DATA).select("doc_id", "n_tokens", "start").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        slots = {(r["doc_id"], r["source"], r["size"]): r["slot"] for r in c.pfair_mix.mix(texts, tempered(texts, power)).filter("doc_id < 60 and doc_id not in (3, 4, 5)").collect()}
        order = [slots[k] for k in ((r["doc_id"], r["source"], len(r["text"] or "")) for r in rows) if k in slots]
        assert len(order) > 50 and order == sorted(order)
        found.append(sorted(got, key=repr))
    assert found[0] != found[1]
