"""Texts of a million characters go through whole, beside short ones."""

import hashlib
import random

import pytest

from tidewater.llm import jaccard, language_model, mixing, quality_model, rules, secret_scan, tokenizer

R = random.Random(9)
LONG = " ".join(f"w{R.randrange(5000)}" for _ in range(150_000))
NEAR = LONG[: len(LONG) // 2] + " changed here " + LONG[len(LONG) // 2 :]
TEXTS = [LONG, NEAR, "short text", "x" * 300_000, LONG + " token=abcdef0123456789abcdef01"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n_chars long")


def test_rules(docs):
    rows = {r["doc_id"]: r for r in rules.quality_signals(docs).collect()}
    assert rows[0]["n_words"] == 150_000 and rows[3]["word_chars"] == 300_000


def test_near_duplicates(docs):
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0}


def test_scores(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    assert quality_model.classify(docs, labels).count() == 5
    rows = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    assert rows[0]["n_tokens"] == 150_001 and rows[3]["n_tokens"] == 2


def test_secrets_and_sizes(docs):
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs, []).collect()}
    assert rows[4]["spans"].startswith(f"assign:{len(LONG) + 1}:") and rows[0]["spans"] == ""
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}[3] == 1


def test_tokens(docs):
    import public_tokenizers as P

    out = tokenizer.encode_documents(docs.where("doc_id <> 3"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=False)
    assert all(r["decoded_sha256"] == hashlib.sha256(TEXTS[r["doc_id"]].encode()).hexdigest() for r in out.collect())
