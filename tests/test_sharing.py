"""Pairs of ids that share a value, held against all pairs."""

import random

from pyspark.sql import functions as F

from tidewater.operators import neighbours, sharing


def values(most):
    r = random.Random(3)
    rows = [(i, f"v{int(60 * r.random() ** 3)}") for i in range(150) for _ in range(r.randint(0, most))]
    return rows + rows[:20] + [(None, "v1"), (4, None), (-5, "v0")]


def plain(rows):
    held = {}
    for i, v in rows:
        if i is not None and v is not None:
            held.setdefault(i, set()).add(v)
    return sorted((a, b) for a in held for b in held if a != b and held[a] & held[b])


def test_pairs_come_once(spark, monkeypatch):
    monkeypatch.setattr(sharing, "PIECE_ROWS", 7)
    rows = values(3)
    assert sorted(map(tuple, sharing.sharing(spark.createDataFrame(rows, "id long, v string")).collect())) == plain(rows)


def test_pairs_of_many_values_come_once(spark, monkeypatch):
    monkeypatch.setattr(sharing, "deal", lambda b, q, f=neighbours.deal: f(b, q, rows=40))
    monkeypatch.setattr(sharing, "BATCH_PAIRS", 50)
    rows = values(9)
    want = [(a, b) for a, b in plain(rows) if a < b]
    found = sharing.sharing_many(spark.createDataFrame(rows, "id long, v string"))
    assert sorted(map(tuple, found.collect())) == want
    assert not any("Aggregate" in line for line in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0].splitlines())


def test_a_large_key_is_dealt_to_pieces(spark):
    df = spark.range(5000).selectExpr("id", "0 as k", "cast(null as int) as other")
    found = sharing.within(df, ["k"], F.col("x.id") < F.col("y.id"))
    assert found.count() == 5000 * 4999 // 2
    assert found.select("x.piece_").distinct().count() == 3


def test_predictions_of_odd_ratings(spark, tmp_path, monkeypatch):
    import duckdb

    from tidewater.operators import learning

    monkeypatch.setattr(learning, "BLOCK_USERS", 5)
    r = random.Random(8)
    orders = [(k, r.randint(0, 30) if k % 9 else None) for k in range(120)]
    lines = [(r.randint(0, 130), r.randint(0, 25) if r.random() > 0.1 else None, float(r.randint(1, 50)) if r.random() > 0.2 else None) for _ in range(400)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = learning.cf_predict(spark, str(tmp_path))
    assert "ObjectHashAggregate" not in df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    show = lambda rows: sorted(str((u, i, v if v is None else round(v, 5))) for u, i, v in rows)
    assert show(df.collect()) == show(con.execute(learning.CF).fetchall())
