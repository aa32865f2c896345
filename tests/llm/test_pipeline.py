from collections import Counter

import corpus_pipeline
import __spark_entry__ as E
from pyspark.sql import functions as F

from askframe.llm import mixing, pieces, quality_classifier, simhash, toxicity

from corpora import documents


def test_registered():
    q = E.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "pieces"]
    assert "pipeline" in q and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11))


def test_run_equals_the_operators_one_by_one(spark, tables):
    docs, labels = documents()
    docs += [(5000 + i, t, "en", "s0", n) for i, (_, t, _, _, n) in enumerate(docs[:40])]
    folder = tables(documents=docs, labels=labels)
    got = corpus_pipeline.run(spark, folder)
    good = {r["doc_id"] for r in quality_classifier.op8(spark, folder).collect() if r["predicted"] == 1}
    mild = {r["doc_id"] for r in toxicity.op1(spark, folder).collect() if r["predicted"] == 0}
    texts = {}
    for d, t, *_ in docs:
        texts.setdefault(d, t or "")
    rest = sorted(good & mild)
    fps = {d: simhash.fingerprint(texts[d].encode()) for d in rest}
    root = {d: d for d in rest}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(rest):
        for b in rest[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    kept = {top(d) for d in rest}
    uses = Counter(r["doc_id"] for r in got.collect())
    assert set(uses) == kept and max(uses.values()) <= 2
    one = spark.read.parquet(f"{folder}/documents.parquet").where(F.col("doc_id").isin(list(kept))).dropDuplicates(["doc_id"])
    assert uses == Counter(r["doc_id"] for r in mixing.stage(spark, one, folder).collect())
    with open(pieces.MODEL, "rb") as f:
        model = pieces.model_of(f.read())
    assert all(pieces.decode(model, r["ids"]) == texts[r["doc_id"]].encode() and r["lossless"] for r in got.collect())


def test_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables(documents=[], labels=[])).collect() == []
