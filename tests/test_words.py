"""Pairs of neighbouring words, held against a plain reading."""

from collections import Counter

import numpy as np

from tidewater.operators import words


def test_pairs_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(words, "PIECE_WORDS", 5)
    docs = ["a b a c a a b".split(), ["x", "y"], "a a a".split(), "a b c d".split()]
    near, skip = Counter(), Counter()
    for d in docs:
        for i, w in enumerate(d):
            around = [d[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(d)]
            near.update((w, y) for y in around)
            skip.update((w, y) for y in set(around))
    code = {w: k for k, w in enumerate(sorted({w for d in docs for w in d}))}
    flat, doc = np.array([code[w] for d in docs for w in d]), np.repeat(range(len(docs)), [len(d) for d in docs])
    for pairs, want in ((words.both_ways, near), (words.around, skip)):
        assert Counter(zip(*map(np.ndarray.tolist, pairs(flat, doc)))) == {(code[a], code[b]): n for (a, b), n in want.items()}
    df = words.counted(spark.createDataFrame([(d,) for d in docs], "ws array<string>"), words.around)
    assert {(r["a"], r["b"]): r["n"] for r in df.collect()} == dict(skip)


def test_token_features_need_no_shuffle(spark):
    from tidewater import registry

    for name in ("token_shape_features", "bigram_mean_prob"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" not in plan
