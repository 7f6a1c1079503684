"""Neighbours block against block, held against all pairs in a plain reading."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(0, 4, 3)], int(rng.integers(0, 3))) for i in range(200)]
    rows += [(i, [1.0, 1.0, 1.0], 1) for i in range(200, 260)]  # many copies
    rows += [(7, [1.0, 1.0, 1.0], 1), (7, [1.0, 1.0, 1.0], 2), (7, [9.0, 9.0, 9.0], 2)]  # an id that comes back
    rows += [(300, None, 1), (301, [1.0, None, 2.0], 1), (302, [1.0, 2.0], 1), (303, [3.0, 2.0], 2), (304, [float("nan"), 0.0, 0.0], 0), (305, [1.0, 1.0, 1.0], None), (306, [1e18, -1e18, 0.0], 0), (None, [1.0, 1.0, 1.0], 1)]
    return rows


def plain(rows, asked, same_label):
    found = []
    for a, x, l in rows:
        for b, y, m in rows:
            if a is None or b is None or a == b or not asked(a) or same_label and (l is None or m is None or l != m):
                continue
            bad = x is None or y is None or None in x or None in y or len(x) != len(y)
            d = None if bad else round(math.sqrt(sum((float(np.float32(u)) - float(np.float32(v))) ** 2 for u, v in zip(x, y))), 6)
            found.append((a, b, d))
    return found


def key(r):
    d = r[2]
    return (2, 0) if d is None else (1, 0) if math.isnan(d) else (0, d)


@pytest.mark.parametrize("same_label", [False, True])
@pytest.mark.parametrize("rows_a_block", [40, 100_000])
def test_nearest_of_odd_vectors(spark, monkeypatch, same_label, rows_a_block):
    monkeypatch.setattr(neighbours, "deal", lambda b, q, within=[], f=neighbours.deal: f(b, q, within, rows_a_block))
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    found = neighbours.nearest(df, F.lit(True), 5, ["label"] if same_label else []).select("q", "n", "dist").collect()
    want = {}
    for r in sorted(plain(rows, lambda a: True, same_label), key=lambda r: (r[0], key(r), r[1])):
        want.setdefault(r[0], []).append(r)
    want = [r for q in want for r in want[q][:5]]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_radius_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "deal", lambda b, q, within=[], f=neighbours.deal: f(b, q, within, 40))
    rows = odd_rows()
    found = neighbours.pairs(spark.createDataFrame(rows, SCHEMA), F.expr("vec_id % 20 = 0"), radius=1.0).select("q", "n", "dist").collect()
    want = [r for r in plain(rows, lambda a: a % 20 == 0, False) if r[2] is not None and r[2] <= 1.0]
    assert sorted(map(tuple, found)) == sorted(want)


def test_round_as_spark_does(spark):
    d = [0.0, 1.0000005, 2.0000015, 0.1234565, 0.12345649999999999, 5e-7, 4.9999999e-7, 123456.7890125, 1e15 + 0.3, 1e300, float("inf")]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in d], "d double").select(F.round("d", 6)).collect()]
    assert neighbours.round6(np.array(d)).tolist() == want


def test_laplacian_links_vectors_of_different_labels(spark, tmp_path):
    from tidewater.operators.graphs import knn_laplacian

    rows = [(i, [float(i)], i % 2) for i in range(4)] + [(10, [50.0], 7)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r["i"], r["j"]): r["v"] for r in knn_laplacian(spark, str(tmp_path)).collect()}
    assert found[(0, 1)] == -1 and found[(10, 3)] == -1 and found[(0, 0)] == 3 and found[(3, 3)] == 4
