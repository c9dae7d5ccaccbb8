def test_pipeline_runs(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    out = p.run(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0 < out.count() < n and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_keep_columns(spark, odd_docs):
    import corpus_pipeline as p

    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert p.STAGES[-1][1](spark, docs, "").count() == docs.count() > 0


def test_stages_on_no_rows(spark, no_docs):
    import corpus_pipeline as p

    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_near_duplicates_of_the_tables_equal_brute_force(spark):
    """One document of each group of alike texts stays, over all pairs of the smallest table."""
    import corpus_pipeline as p
    from test_dedup import brute_copies

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_copies([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = sorted(r["doc_id"] for r in p.without_near_duplicates(spark, docs, "").select("doc_id").collect())
    assert kept == sorted({*want.values()}) and len(kept) < len(want)


def test_entry_lists_the_queries():
    import __spark_entry__ as e

    q = e.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {f"{k.split('_')[0]}_" for k in q} and "pipeline" in q
    assert set(e.oracle_sql()) <= set(q)
