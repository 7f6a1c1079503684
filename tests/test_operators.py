"""Worked examples and rules of single operators."""

from tidewater.functions.strings import _common_subsequence
from tidewater.operators.graphs import closure


def test_common_subsequence():
    assert _common_subsequence("a b c d".split(), "b x d".split()) == [1, 3]
    assert _common_subsequence(["a"], ["b"]) == []


def test_closure_of_a_long_chain(spark):
    edges = spark.range(40).selectExpr("id as a", "id + 1 as b").union(spark.range(1).selectExpr("100L", "101L"))
    found = {r["id"]: r["component"] for r in closure(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_laplacian_rls_scores_every_vector(spark, tmp_path):
    from tidewater.operators.learning import laplacian_rls

    rows = [(i, [float(i * 7 % 10 >= 5) * 8 + i % 13 / 13, i % 11 / 11], i * 7 % 10) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = laplacian_rls(spark, str(tmp_path)).collect()
    assert sorted(r["vec_id"] for r in found) == list(range(1200))
    assert all((r["score"] > 0) == (r["vec_id"] * 7 % 10 >= 5) for r in found)


def test_laplacian_rls_without_labels(spark, tmp_path):
    from tidewater.operators.learning import laplacian_rls

    spark.createDataFrame([(1, [1.0, 2.0], 7), (3, [1.0, 2.0], 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, laplacian_rls(spark, str(tmp_path)).collect())) == [(1, 0.0), (3, 0.0)]


def test_rest_imports_without_the_llm_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidewater.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_nothing_else_imports_the_llm_subpackage():
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "tidewater")):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "tidewater.llm" not in open(os.path.join(folder, f)).read(), f


def test_topological_levels_and_cycles(spark):
    from tidewater.operators.graphs import topo_levels

    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 1), (1, 3, 2), (9, 3, 1), (1, 2, 5)], "a long, b long, w int")
    assert {tuple(r) for r in topo_levels(edges).collect()} == {(1, 0, 0), (9, 0, 0), (2, 1, 5), (3, 2, 6)}
    assert topo_levels(edges.union(spark.createDataFrame([(3, 1, 1)], "a long, b long, w int"))).count() == 0
    assert topo_levels(edges.limit(0)).count() == 0


def test_number_words_vote(spark):
    from tidewater.functions.strings import indented, number_words

    given = {"three light": 3, "and network": 2, "lamp": None, "Twin bulb, TWO": 2, "four five": None, "": None, None: None, "ONE four four": 4}
    df = spark.createDataFrame([(t,) for t in given], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", number_words("t").alias("n")).collect()} == given
    assert indented(None) is None and indented("{broken") is None and indented('{"k":1}') == '{\n  "k": 1\n}'
