import base64
import hashlib
import random

import pytest

from tidewater.llm import tokenizer, warc


def test_encoding_round_trip(spark):
    import numpy as np
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tokenizer.encoding(path, P.PATTERN)
    r = random.Random(1)
    texts = [None, "", " ", "it's 42!", "<|endoftext|>", "\x1c\x85 mix\u00a0ed", "a" * 3000] + ["".join(r.choice("ab  \n\t'sé漢1!\x1c\u00a0") for _ in range(400)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x")], "doc_id long, text string, ids string")
    for size in (7, 1 << 16):
        for x in tokenizer.encode_documents(df, path, P.PATTERN, size=size).collect():
            t = texts[x["doc_id"]] or ""
            ids = enc.encode_ordinary(t)
            assert x["ids"] == ids and x["n_tokens"] == len(ids)
            assert x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert x["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert tokenizer.encode_documents(df.where("false"), path, P.PATTERN).count() == 0


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nPage-Id: 999\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages():
    r = random.Random(5)
    out = [(1, "http://a/", "x"), (2, "http://b", "x"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "abc" + FAKE + "def"), (6, "u", FAKE), (7, "u", FAKE * 3), (8, "u", "WARC/1.1\r\n"), (9, "u", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"), (None, "u", "n"), (10, "é", "ü" * 500), (11, "u", "y" * 700), (11, "u", "y" * 700), (None, "u", "y" * 700), (12, "u", FAKE[:-8]), (13, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999\r\n\r\n"), (14, "u", "\r\n\r\n")]
    return out + [(i, f"http://p{i}", "".join(r.choice([FAKE, "WARC/1.1\r\n", "\r\n\r\n", "text ", "é", "WARC-Type: x\r\n"]) for _ in range(r.randrange(12)))) for i in range(15, 60)]


@pytest.mark.parametrize("split", ["1m", "500"])
def test_archives_round_trip(spark, tmp_path, split):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as size", "3 as first")
    path = str(tmp_path / "w")
    warc.write(df.coalesce(2), path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = sorted(map(tuple, warc.records(spark, path).collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    seen, want = {}, []
    for i, _, h in sorted(rows, key=lambda x: (x[2] or "", x[0] is None, x[0] or 0)):
        b = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        want.append((i, len(b), d, "revisit", seen[d]) if d in seen else (i, len(b), d, "response", None))
        seen.setdefault(d, i)
    assert got == sorted(want, key=str)


def test_shorter_payloads_are_all_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long payload"), (4, "u", "long payload")], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), least=5)
    assert sorted((r["page_id"], r["record_type"]) for r in warc.records(spark, str(tmp_path / "w")).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.records(spark, str(tmp_path / "w")).count() == 0


def test_a_payload_of_many_magic_lines(spark, tmp_path):
    html = (FAKE + "é\x7f\x00") * 4000 + "WARC/1.1\r\n" * 4000
    df = spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", "x")], "page_id long, url string, html string")
    warc.write(df.coalesce(1), str(tmp_path / "w"))
    b = html.encode()
    got = {r["page_id"]: tuple(r)[1:] for r in warc.records(spark, str(tmp_path / "w")).collect()}
    d = base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert got[1] == (len(b), d, "response", None) and got[2] == (len(b), d, "revisit", 1) and got[3][0] == 1
