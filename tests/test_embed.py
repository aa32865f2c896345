from askframe.operators.embed import hashed_vectors


def test_sql_and_arrow_hashing_agree_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = {r.doc_id: (list(r.tf), r.sq) for r in hashed_vectors(docs, "text", ["doc_id"]).collect()}
    b = {r.doc_id: (list(r.tf), r.sq) for r in hashed_vectors(docs, "text", ["doc_id"], engine="sql").collect()}
    assert a == b and len(a) == docs.count()


def test_known_bucket(spark):
    df = spark.createDataFrame([(1, "abc ABC, abc!"), (2, None)], "id long, t string")
    rows = {r.id: r for r in hashed_vectors(df, "t", ["id"]).collect()}
    assert rows[1].tf[152] == 3 and rows[1].sq == 9          # md5('abc')[:8] % 384 == 152
    assert sum(rows[2].tf) == 0 and rows[2].sq == 0


def test_every_script_has_tokens(spark):
    from pyspark.sql import functions as F
    from askframe.operators.embed import hashed_vectors
    texts = ["Какой процент по вкладу", "سود کی شرح کیا ہے", "Größe für", "日本語 テスト", "naïve café 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for engine in ("arrow", "sql"):
        got = {r.id: (r.tf, r.sq) for r in hashed_vectors(df, "t", ["id"], engine=engine, outputs=("tf", "sq")).collect()}
        assert all(sq > 0 for _, sq in got.values()) and sum(got[2][0]) == 2 and sum(got[0][0]) == 4
        if engine == "arrow":
            first = got
    assert first == got


def test_what_is_remembered_does_not_change_counts(monkeypatch):
    import numpy as np
    from askframe.operators import embed
    texts = ["a b c", None, "d " * 50, "", "a"]
    whole = embed._counts_for(texts, 16, embed._Buckets(16))
    monkeypatch.setattr(embed, "_CACHE_MAX", 2)
    small = embed._counts_for(texts, 16, embed._Buckets(16))
    assert all(np.array_equal(a, b) for a, b in zip(whole, small))
    assert whole[0][0].sum() == 3 and whole[0][2].max() == 50 and whole[1].tolist()[1] == 0


def test_hashing_takes_small_batches_and_gives_the_same_vectors(spark, monkeypatch):
    from askframe.operators import embed as E
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        df = spark.range(600).selectExpr("id", "CASE WHEN id % 7 <> 0 THEN concat('w', id % 50, ' tail w', id) END AS text").coalesce(1)
        out = E.hashed_vectors(df, "text", ["id"], dim=16, outputs=("tf", "sq"))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
        got = {r.id: (r.tf, r.sq) for r in out.collect()}
        want = {r.id: (r.tf, r.sq) for r in E.hashed_vectors(df, "text", ["id"], dim=16, engine="sql", outputs=("tf", "sq")).collect()}
        assert got == want and len(got) == 600
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_long_tokens_are_hashed_but_not_kept():
    from askframe.operators import embed
    buckets, long = embed._Buckets(16), "x" * 1000
    for token in (long, "short", long):
        assert buckets[token] == embed.token_bucket(token, 16)
    assert list(buckets) == ["short"]
