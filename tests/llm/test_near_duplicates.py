import random

import pytest

from tidewater.llm import jaccard, shared, vectors
from tidewater.llm.jaccard import drop_near_duplicates, near_duplicates
from tidewater.llm.vectors import near_duplicate_vectors


def brute(rows):
    """Components by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(n=160):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    shared_passage = r.choices(vocabulary, k=30)
    rows = []
    for i in range(n):
        kind = i % 5
        if kind == 0 or not rows:
            words = r.choices(vocabulary, k=r.randrange(5, 120))
        elif kind == 1:
            words = shared_passage + r.choices(vocabulary, k=r.randrange(0, 20))
        else:
            words = (rows[r.randrange(len(rows))][1] or "w").split() or ["w"]
            for _ in range(r.randrange(0, 3)):
                words = list(words)
                words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE two"), (2005, "one two three"), (2003, "one two"), (None, "lone words here"), (None, "one two")]
    return rows


@pytest.mark.parametrize("pivots", [1, 16])
def test_components_match_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, cid string, n int")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_many_near_copies_of_one_text(spark, monkeypatch):
    """Chains of edits: most pairs of the group are near the threshold, and no pivot links with all."""
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 64)
    r = random.Random(9)
    base = [f"v{i}" for i in range(90)]
    rows = []
    for i in range(700):
        words = list(base) if i % 7 else list(rows[r.randrange(len(rows))][1].split()) if rows else list(base)
        for _ in range(r.randrange(0, 5)):
            words[r.randrange(len(words))] = f"u{r.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute(rows)


def test_cells_give_a_spanning_forest():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    pool = np.sort(r.integers(0, 2**63, 300, dtype=np.uint64))
    base = pool[:60]
    sets = [np.unique(np.concatenate((base[r.random(60) < 0.93], r.choice(pool[60:], r.integers(0, 9))))) for _ in range(120)]
    start = r.integers(0, 100, 120)
    for t, left in ((0, np.ones(120, bool)), (0, np.arange(120) < 50), (1, np.arange(120) < 30)):
        rows = pa.table({"kind": [0] * 120, "h": [1] * 120, "t": [t] * 120, "i": [0] * 120, "j": [0 if left.all() else 1] * 120, "left": left, "num": np.arange(120), "n": [len(s) for s in sets], "component": start, "parity": pa.array([jaccard._parity(s) for s in sets], pa.binary())})
        got = [(a.as_py(), b.as_py()) for a, b in zip(*jaccard._cell_links(rows.append_column("shingles", pa.array([s.tobytes() for s in sets], pa.binary())), 80).columns)]
        links = [(i, j) for i in range(120) for j in range(120) if (i < j if left.all() else left[i] and not left[j]) and start[i] != start[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

        def parts(edges):
            label = start.copy()
            for i, j in edges:
                label[label == label[i]] = label[j]
            return {tuple(np.flatnonzero(label == x)) for x in label}

        assert all((i, j) in links or (j, i) in links for i, j in got) and links
        assert parts(got) == parts(links) and len(got) < 120
        kept = {x.as_py() for x in jaccard._likely(rows, 80).column("num")}
        assert {i for pair in links for i in pair} <= kept


def test_false_positives_of_the_copied_filter_lose_no_links(spark, monkeypatch):
    made, real = [], jaccard._filters

    def first_lets_all_through(keys, filters=1):
        made.append(real(keys, filters))
        return [~(w & 0) for w in made[0]] if len(made) == 1 else made[-1]

    monkeypatch.setattr(jaccard, "_filters", first_lets_all_through)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute(rows)
    assert len(made) >= 2


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_component_stays(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t"), (2, "a b c d e f g h i j k l m n o p q r s t"), (3, "other words than those before"), (3, "other words than those before"), (4, None)]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, component_id string")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


def test_null_ids_stay_once_and_only_without_links(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z a1 b1 c1 d1 e1 f1"
    rows = [(1, near), (None, near), (None, near + " g1"), (None, "alone here"), (None, "alone here"), (None, near.upper().replace("A", "Q")), (None, None), (None, ""), (None, "")]
    out = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, near), (None, "alone here"), (None, near.upper().replace("A", "Q")), (None, None), (None, ""), (None, "")], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    found = {r["id"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 130)}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_match_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)
    r = np.random.default_rng(2)
    base = r.normal(size=(12, 16))
    x = [v + s * r.normal(size=16) * 0.05 for v in base for s in range(5)] + [base[0] * 3, base[0], base[0]]
    rows = [(int(i * 3), [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None], 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] + [1.0] * 15, 1), (906, [1.0, 2.0], 1), (0, rows[0][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "cid")
    got = sorted(map(tuple, near_duplicate_vectors(df).collect()))
    good = [(i, np.array(e, dtype=float)) for i, e, _ in rows if e and len(e) == 16 and None not in e and np.isfinite(e).all() and any(e)]
    links = {k: [j for j in range(len(good)) if j != k and good[k][1] @ good[j][1] / np.linalg.norm(good[k][1]) / np.linalg.norm(good[j][1]) >= 0.95] for k in range(len(good))}
    want = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(good[j][0] for j in seen)
        want.append((good[k][0], len(links[k]), low, good[k][0] == low))
    want += [(i, 0, i, True) for i in (900, 901, 902, 903, 904, 905, 906)]
    assert got == sorted(want)


def test_vectors_of_extreme_magnitudes(spark):
    big, small, least = 1e200, 1e-200, 5e-324
    rows = [(1, [big, big]), (2, [big, 1.0001e200]), (3, [small, small]), (4, [2 * small, 2 * small]), (5, [1.0, 1.0]), (6, [least, least]), (7, [1.7e308, -1.7e308]), (8, [1.0, -1.0]), (9, [-big, -big])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df).collect()}
    assert got == {i: (5, 1) for i in (1, 2, 3, 4, 5, 6)} | {7: (1, 7), 8: (1, 7), 9: (0, 9)}


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicate_vectors(df).collect() == []
