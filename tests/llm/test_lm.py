import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askframe.llm import common, lm

from corpora import documents


def split(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\v\f\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w] + [None]


def rest(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5


@pytest.fixture(scope="module")
def docs():
    d, _ = documents(200)
    return d + [(7000, "Ä É Straße É", None, None, None), (None, "no id", None, None, None)]


def test_op3_counts_equal_brute_force(spark, tables, docs):
    c = Counter(w for d, t, *_ in docs if rest(d) != 1 for w in split(t))
    n, v = sum(c.values()), len(c)
    rows = lm.op3(spark, tables(documents=docs)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in docs)
    by = {d: t for d, t, *_ in docs}
    for r in rows:
        words = split(by[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (rest(r["doc_id"]) == 1, len(words), n)
        assert r["n_known"] == sum(c[w] > 0 for w in words)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_small_blocks_give_the_same_counts(spark, tables, docs):
    table = spark.read.parquet(tables(documents=docs) + "/documents.parquet")
    held = common.in_fold(F.col("doc_id"), 5, 1)
    pick = ["doc_id", "n_tokens", "n_known", "train_tokens"]
    key = lambda rows: sorted((tuple(r[c] for c in pick) for r in rows), key=repr)
    a, b = (lm.score(table, held, n).collect() for n in (2_000_000, 500))
    assert key(a) == key(b)
    base = lambda rows: sorted(round(r["base_score"], 6) for r in rows)
    assert base(a) == base(b)


def test_classes_agree_between_spark_and_python(spark):
    words = ["a", "ab", "abc", "abcd", "straße", "é", "🎉x", "naïve", "|"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", lm.ending_class_column(F.col("w")).alias("k")).collect()
    assert all(r["k"] == lm.ending_class(r["w"]) for r in got)


def test_contexts_start_anew_with_each_text():
    one, two = lm.contexts(np.array([5, 6, 7, 8, 9, 9], dtype=np.int32), np.array([3, 1, 2]))
    s = lm.START
    assert one.tolist() == [s, 5, 6, s, s, 9] and two.tolist() == [s, s, 5, s, s, s]


def test_probabilities_add_up_and_training_learns():
    draw = np.random.default_rng(0)
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    a = draw.integers(0, 20, 200_000).astype(np.int32)
    target = (a * 7 + 3) % 20  # the class before decides
    two = draw.integers(0, 20, len(a)).astype(np.int32)
    share = (np.bincount(target, minlength=lm.CLASSES) + 0.5) / (len(a) + 0.5 * lm.CLASSES)
    model = lm.Model.start(share)
    for seed in range(4):
        model.learn(a, two, target, share, seed)
    log_z = model.normalisers()
    every = np.arange(lm.CLASSES, dtype=np.int32)
    for x, y in ((0, 1), (lm.START, lm.START), (5, 300)):
        p = model.log10(np.full(lm.CLASSES, x), np.full(lm.CLASSES, y), every, log_z)
        assert math.isclose((10 ** p).sum(), 1, rel_tol=1e-4)
    assert model.log10(a[:5000], two[:5000], target[:5000], log_z).mean() > math.log10(0.5)
    assert noise.sum() == pytest.approx(1)


def test_words_of_a_class_and_the_unknown_add_up():
    c = np.array([5, 2, 1])
    inside = (np.append(c, 0) + 0.5) / (c.sum() + 0.5 * (len(c) + 1))
    assert math.isclose(inside.sum(), 1)


def test_held_out_texts_gain_over_the_base(spark, tables):
    import random
    draw = random.Random(5)
    docs = [(i, " ".join(f"{'xy'[i % 2]}{draw.randrange(30)}" for _ in range(300)), None, None, None) for i in range(300)]
    rows = [r for r in lm.op3(spark, tables(documents=docs)).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 10 * len(rows)


def test_empty_tables(spark, tables):
    assert lm.op3(spark, tables(documents=[])).collect() == []
    only = [(d, "a b", None, None, None) for d in range(40) if rest(d) == 1]
    rows = lm.op3(spark, tables(documents=only)).collect()
    assert len(rows) == len(only) and all(r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in rows)
