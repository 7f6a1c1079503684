import duckdb
import pytest

from tidewater.llm import mixing, rules

TEXTS = [None, "", " \t\n", "one two", "a b c a b c a b c " * 12, "x " * 60, "### $$$ " * 40, "Hello world\nHello world\n\nHello world\n" * 20, "é ü ß " * 30, "word " * 49 + "end", "SHOUT NOW " * 40, "the cat sat on the mat " * 3 + " ".join(f"w{i}" for i in range(60))]


def documents(spark, texts=TEXTS):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "clash", 7) for i, t in enumerate(texts)] + [(3, "one two", "s0", "clash", 7), (None, "plain " * 9, "s1", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, words string, size int")


def other(df):
    con = duckdb.connect()
    con.register("documents_", df.toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents_")
    return con


def key(r):
    return str(tuple(round(x, 9) if isinstance(x, float) else x for x in r))


@pytest.mark.parametrize("bits", [24, 2])
def test_signals_match_sql(spark, monkeypatch, bits):
    monkeypatch.setattr(rules, "POSITION_BITS", bits)
    df = documents(spark)
    got = sorted(map(key, rules.quality_signals(df).collect()))
    assert got == sorted(map(key, other(df).execute(rules.ORACLE).fetchall()))


def test_filter_keeps_columns_and_agrees(spark):
    df = documents(spark).withColumnsRenamed({"size": "kept", "source": "row"})
    kept = sorted(r["doc_id"] for r in rules.quality_signals(df).where("kept").collect())
    out = rules.quality_filter(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == kept and kept


def test_order_is_by_rejection_per_cost():
    order = rules.ordered([rules.Rule("dear", None), rules.Rule("cheap", None), rules.Rule("idle", None)], [("dear", 1.0, 0.5), ("cheap", 0.1, 0.2), ("idle", 0.1, 0.0)])
    assert [r.name for r in order] == ["cheap", "dear", "idle"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert rules.quality_signals(empty).count() == 0 and rules.quality_filter(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_matches_sql(spark):
    df = documents(spark)
    got = sorted(map(key, mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken", "repeats", "position").collect()))
    assert got == sorted(map(key, other(df).execute(mixing.ORACLE).fetchall()))


def test_mix_meets_targets(spark):
    df = spark.createDataFrame([(i, "w " * (i % 40), "abcd"[min(3, i % 7)]) for i in range(300)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    for s in "abcd":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-6


def test_mixed_documents_repeat(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1), (2, "c d " * 20, "y", 2), (3, None, "y", 3)], "doc_id long, text string, source string, position int")
    out = mixing.mixed_documents(df).collect()
    assert sorted(r["doc_id"] for r in out).count(1) == 3 and all(r["text"] for r in out)


def test_mixed_documents_keep_null_ids(spark):
    rows = [(1, "a b", "x"), (None, "e f g", "x"), (None, "e f g", "x"), (None, "h " * 30, None), (2, "c d " * 20, "y"), (None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(df).collect()
    want = sum(r["repeats"] for r in plan)
    out = mixing.mixed_documents(df).collect()
    assert len(out) == want
    for source in ("x", "y", None):
        assert sum(r["doc_id"] is None and r["source"] == source for r in out) == sum(r["repeats"] for r in plan if r["doc_id"] is None and r["source"] == source)
    assert any(r["doc_id"] is None for r in out)


def test_mixed_documents_keep_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b", "x", 5)] * 2 + [(2, "c d " * 20, "y", 6), (3, "", "y", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key int").selectExpr("*", "1 AS mix_place", "2 AS mix_position", "3 AS carry_0", "4 AS position", "5 AS row")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    plan = mixing.mix(df).collect()
    found = [r["doc_id"] for r in out.collect()]
    for doc in (1, 2, 3):
        assert found.count(doc) == sum(r["repeats"] for r in plan if r["doc_id"] == doc)
    assert found.count(1) > 2


def place(r):
    return (r["position"] is None, r["position"] or 0.0, r["doc_id"] is None, r["doc_id"] or 0)


def test_query_comes_in_training_order(spark, tmp_path):
    rows = [(i if i % 11 else None, "w " * (i * 7 % 40), "abcd"[min(3, i % 7)] if i % 13 else None) for i in range(300)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, source string")
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = mixing.op8_curriculum_mix(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "repeats", "position"]
    found = out.collect()
    assert len(found) == 600 and [place(r) for r in found] == sorted(map(place, found))
    assert any(r["repeats"] > 1 for r in found) and any(r["position"] is None for r in found)
    assert sorted(map(key, found)) == sorted(map(key, other(df).execute(mixing.ORACLE).fetchall()))


def test_training_sequence_places_every_reading(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), "aaaabc"[i % 6]) for i in range(600)], "doc_id long, text string, source string")
    plan = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    run = [r for r in mixing.training_sequence(df).collect() if r["pass"] is not None]
    assert [r["due"] for r in run] == sorted(r["due"] for r in run)
    assert sorted((r["doc_id"], r["pass"]) for r in run) == sorted((d, p) for d, r in plan.items() for p in range(r["repeats"]))
    assert max(r["pass"] for r in run) > 0
    for d, r in plan.items():
        own = [x for x in run if x["doc_id"] == d]
        assert sum(x["words"] for x in own) == r["taken"]
        assert not own or min(x["due"] for x in own) == r["position"]
    for source, slope in (("a", 0.5), ("b", 0.0), ("c", -0.5)):
        own = [r for r in run if r["source"] == source]
        for t in (0.25, 0.5, 0.75):
            read = sum(r["words"] for r in own if r["due"] < t)
            assert abs(read / own[0]["goal"] - (t + slope * (t * t - t))) <= 9 / own[0]["goal"] + 1e-9
