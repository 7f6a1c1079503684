def test_stages_in_order(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mix", "encode"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] == sizes[2] > 0
    assert corpus_pipeline.run(spark, sf).count() == sizes[3]


def test_stages_take_odd_rows(spark):
    import corpus_pipeline

    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", "a"), (2, good + " more", "en", "a"), (1, good, "en", "a"), (None, good.replace("5", "6"), None, "a"), (3, None, None, "b"), (4, "", None, None), (5, " ".join(f"long{i}" for i in range(90_000)), "de", None), (6, "x" * 300_000, "de", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS words", "2 AS row", "3 AS kept", "4 AS mix_key", "5 AS component_id")
    for docs, want in ((df, {1, None, 5}), (df.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == df.columns, name
            docs = docs.checkpoint()
        assert {r["doc_id"] for r in docs.collect()} == want
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_queries_are_registered():
    from tidewater.llm import registry

    assert {k.split("_")[0] for k in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}


def test_queries_with_sql_match(spark):
    import duckdb

    from tidewater.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, text in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, sf)
        found = con.execute(text)
        at = [[c[0] for c in found.description].index(c) for c in df.columns]
        show = lambda r: str(tuple(round(x, 7) if isinstance(x, float) else x for x in r))
        assert sorted(map(show, df.collect())) == sorted(show([r[i] for i in at]) for r in found.fetchall()), name
